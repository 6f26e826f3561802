"""Queries of the mask tables (E1-E18) over lineitem and part, and of the concept diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundspark.functions import vectors as V
from groundspark.operators import concepts as K
from groundspark.operators import masks as M
from groundspark.operators.util import draw
from groundspark.session import table

from . import adapters as A
from .book import query
from .corpus_queries import CANON_SQL, sql_draw

AREA = 500 * 500.0
TYPES = ["economy", "large", "medium", "promo", "small", "standard"]
DET = """
det as (select l_orderkey as frame, l_linenumber::bigint as line, l_partkey as det_id, lower(p_type) as label, least(l_discount * 10, 1.0) as dino_score, 1.0::double - l_tax as sam_score, (l_quantity * 200)::bigint as mask_area, l_quantity * 10 as w, l_quantity * 4 + l_linenumber * 10 as h, l_discount * 5 as clip_sim from lineitem join part on l_partkey = p_partkey),
capped as (select * from (select *, row_number() over (partition by frame order by dino_score desc, line, det_id) as rank from det where dino_score >= 0.3) where rank <= 30),
kept as (select * from capped where label not in ('medium') and sam_score >= 0.93 and mask_area >= 3000 and mask_area / 250000.0::double <= 0.6 and mask_area / (w * h) >= 0.25 and greatest(w, h) / least(w, h) <= 8),
idx as (select *, row_number() over (partition by frame, label order by label = 'promo' desc, dino_score desc, sam_score desc, clip_sim desc, line, det_id) - 1 as instance_id from kept),
named as (select *, frame || '_obj_' || label || '_' || lpad(instance_id::varchar, 3, '0') as mask_name from idx)"""


def kept(spark, sf):
    d = A.detections(spark, sf)
    return M.filter_detections(d, ["frame"], AREA, background=["medium"], min_sam=0.93).withColumn("is_priority", F.col("label") == "promo")


def indexed(spark, sf):
    return M.index_masks(kept(spark, sf), ["frame"])


@query("e1_detection_cascade", "with " + DET + " select frame, line, det_id, label, mask_area, rank from kept")
def e1_detection_cascade(spark, sf):
    return kept(spark, sf).select("frame", "line", "det_id", "label", "mask_area", "rank")


@query("e2_best_mask", "with " + DET + " select frame, label, arg_max(line, sam_score * 1000 - line) as line, max(sam_score) as sam_score from det group by 1, 2")
def e2_best_mask(spark, sf):
    return M.best_mask(A.detections(spark, sf), "frame", "label")


VEC = "v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as z from embeddings)"
COS = "round(list_dot_product({a}, {b}) / ((sqrt(list_dot_product({a}, {a})) + 1e-8) * (sqrt(list_dot_product({b}, {b})) + 1e-8)), 9)"


@query("e3_assign_labels", f"""with {VEC}, c as (select vec_id as cid, z as c from v where vec_id < 10),
s as (select vec_id, {COS.format(a='z', b='c')} as sim, cid, cid % 2 = 0 as priority from v cross join c),
r as (select *, row_number() over (partition by vec_id order by sim desc, not priority, cid) as r from s)
select vec_id as obj_id, round(sim, 6) as clip_sim, case when sim >= 0.3 then 'c' || cid end as label from r where r = 1""")
def e3_assign_labels(spark, sf):
    o = A.objects(spark, sf)
    concepts = o.where("obj_id < 10").select(F.concat(F.lit("c"), F.col("obj_id").cast("string")).alias("concept"), (F.col("obj_id") % 2 == 0).alias("priority"), F.col("z").alias("c"))
    return M.assign_labels(o, concepts).select("obj_id", F.round("clip_sim", 6).alias("clip_sim"), "label")


@query("e4_ensemble_vectors", f"""with {VEC}, n as (select label, list_transform(z, lambda x: x / (sqrt(list_dot_product(z, z)) + 1e-8)) as z from v),
m as (select label, d, avg(x) as x from (select label, unnest(z) as x, unnest(range(len(z))) as d from n) group by 1, 2),
l as (select label, list(x order by d) as a from m group by 1)
select label as concept_id, list_transform(a, lambda x: round(x / (sqrt(list_dot_product(a, a)) + 1e-8), 6)) as v from l""")
def e4_ensemble_vectors(spark, sf):
    return M.ensemble_vectors(A.objects(spark, sf), "concept_id").select("concept_id", V.rounded_list("v").alias("v"))


@query("e5_mask_index", "with " + DET + " select frame, line, det_id, label, instance_id, mask_name from named")
def e5_mask_index(spark, sf):
    return indexed(spark, sf).select("frame", "line", "det_id", "label", "instance_id", "mask_name")


@query("e6_concept_counts", "with " + DET + " select c.concept, (coalesce(n, 0) + coalesce(n, 0))::bigint as n from (select unnest(['economy', 'large', 'medium', 'promo', 'small', 'standard', 'ball']) as concept) c left join (select label as concept, count(*) as n from named group by 1) using (concept)")
def e6_concept_counts(spark, sf):
    i = indexed(spark, sf)
    concepts = [*TYPES, "ball"]
    return M.concept_counts(i, concepts, M.concept_counts(i, concepts))


@query("e8_packed_masks", "with " + DET + ", v as (select label, row_number() over (order by label) - 1 as id from (select distinct label from named)) select frame, list(mask_name order by label, mask_name) as masks, list(id::int order by label, mask_name) as concept_ids from named join v using (label) group by frame")
def e8_packed_masks(spark, sf):
    i = indexed(spark, sf)
    vocab = M.concept_vocab(i.select(F.col("label").alias("concept")), spark.createDataFrame([], "concept_id int, concept string"))
    return M.pack_masks(i, vocab, ["frame"])


@query("e9_concept_vocabulary", "with " + DET + ", e as (select unnest(['ball', 'small', 'large']) as concept, unnest([0, 1, 5]) as concept_id) select concept, concept_id from e union all select label, (6 + row_number() over (order by label) - 1)::int from (select distinct label from named where label not in (select concept from e))")
def e9_concept_vocabulary(spark, sf):
    old = spark.createDataFrame([(0, "ball"), (1, "small"), (5, "large")], "concept_id int, concept string")
    return M.concept_vocab(indexed(spark, sf).select(F.col("label").alias("concept")), old)


@query("e10_resume", "with " + DET + " select frame, line, det_id from named where frame % 3 <> 0")
def e10_resume(spark, sf):
    i = indexed(spark, sf)
    return M.resume(i, i.where("frame % 3 = 0"), "frame").select("frame", "line", "det_id")


@query("e11_frequency_report", "with " + DET + ", m as (select case when frame % 10 = 0 then 'bad_' || frame else mask_name end as mask_name, label, frame from named), p as (select label, count(*) as packed from named where frame % 2 = 0 group by 1), g as (select label, count(*) as parsed from m where frame % 10 <> 0 group by 1) select label, coalesce(parsed, 0)::bigint as parsed, coalesce(packed, 0)::bigint as packed, null::bigint as bad from g full join p using (label) union all select null, count(*) filter (frame % 10 <> 0), null, count(*) filter (frame % 10 = 0) from m")
def e11_frequency_report(spark, sf):
    i = indexed(spark, sf)
    names = i.select(F.when(F.col("frame") % 10 == 0, F.concat(F.lit("bad_"), F.col("frame").cast("string"))).otherwise(F.col("mask_name")).alias("mask_name"))
    return M.frequency_report(names, i.where("frame % 2 = 0"))


E12_SQL = """
with t as (select p_partkey as k, (p_partkey % 50) || '/' || case when p_partkey % 10 < 3 then p_partkey - p_partkey % 10 else p_partkey end as tail from part where p_partkey is not null),
i as (select 'a/' || tail as path from t), f as (select case when k % 3 = 0 then 'a/' when k % 3 = 1 then 'b/' else 'b/x/' end || tail as path from t),
ix as (select distinct path from i), k1 as (select split_part(path, '/', -1) as k, min(path) as p from ix group by 1 having count(*) = 1), k2 as (select split_part(path, '/', -2) || '/' || split_part(path, '/', -1) as k, min(path) as p from ix group by 1 having count(*) = 1)
select f.path, coalesce(ix.path, k1.p, k2.p) as resolved from f left join ix on f.path = ix.path left join k1 on split_part(f.path, '/', -1) = k1.k left join k2 on split_part(f.path, '/', -2) || '/' || split_part(f.path, '/', -1) = k2.k"""


@query("e12_resolved_keys", E12_SQL)
def e12_resolved_keys(spark, sf):
    """Every part: seven of ten names are of one part, the others of up to three parts in different folders."""
    p, k = table(spark, sf, "part").where("p_partkey is not null"), F.col("p_partkey")
    tail = F.concat((k % 50).cast("string"), F.lit("/"), F.when(k % 10 < 3, k - k % 10).otherwise(k).cast("string"))
    head = F.when(k % 3 == 0, "a/").when(k % 3 == 1, "b/").otherwise("b/x/")
    return M.resolve_keys(p.select(F.concat(head, tail).alias("path")), p.select(F.concat(F.lit("a/"), tail).alias("path")))


E13_SQL = """
with l as (select unnest(['error', 'click', 'view', 'purchase', 'signup', 'ball']) as concept, unnest(range(6)) as local_id), g as (select unnest(['click', 'error', 'signup', 'view', 'ball']) as concept, unnest(range(5)) as global_id),
c as (select event_type as concept, count(*) as n from events group by 1), j as (select local_id, concept, global_id, coalesce(n, 0) as n from l left join g using (concept) left join c using (concept)),
r as (select *, case when global_id is null then 'not_in_concept_list' when n < 5 then 'freq<5 (count=' || n || ')' end as drop_reason from j),
w as (select local_id, greatest(least(pow((select quantile_disc(n, 0.5) from r where drop_reason is null) / n, 0.5), 2.0), 0.5) as raw from r where drop_reason is null)
select r.local_id::int as local_id, concept, case when drop_reason is null then global_id else -1 end::int as global_id, n as count, round(coalesce(raw / (select avg(raw) from w), 1), 6) as weight, drop_reason from r left join w using (local_id)"""


@query("e13_concept_registry", E13_SQL)
def e13_concept_registry(spark, sf):
    return registry_of(spark, table(spark, sf, "events"))


def registry_of(spark, events):
    names = ["error", "click", "view", "purchase", "signup", "ball"]
    local = spark.createDataFrame(list(enumerate(names)), "local_id int, concept string")
    counts = events.groupBy(F.col("event_type").alias("concept")).agg(F.count("*").alias("n"))
    g = spark.createDataFrame(list(enumerate(["click", "error", "signup", "view", "ball"])), "global_id int, concept string")
    return M.concept_registry(local, counts, g).withColumn("weight", F.round("weight", 6))


@query("e14_picked_counts", "select event_type as concept, count(*) as n from events group by 1")
def e14_picked_counts(spark, sf):
    n = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    row = lambda source, value: n.select(F.lit(source).alias("source"), F.col("event_type").alias("concept"), value.alias("value"))
    return M.pick_counts(row("packed", F.lit("x")).unionByName(row("parsed", F.col("n").cast("string"))).unionByName(row("counts", F.lit("1"))))


@query("e15_mask_usage", "with " + DET + ", p as (select frame, list(line) as ls from named group by 1), m as (select l_orderkey as frame from (select distinct l_orderkey from lineitem)), per as (select frame, len(ls) as before, len(list_filter(ls, lambda x: x % 2 = 0)) as kept from p) select count(*) as frames, count(*) filter (before is null) as missing, 0::bigint as empty, count(*) filter (before > 0 and kept = 0) as all_dropped, sum(before)::bigint as masks, sum(kept)::bigint as kept, sum(before - kept)::bigint as dropped from m left join per using (frame)")
def e15_mask_usage(spark, sf):
    d = A.detections(spark, sf)
    packs = indexed(spark, sf).groupBy("frame").agg(F.collect_list("line").alias("concept_ids"))
    registry = spark.createDataFrame([(i, i if i % 2 == 0 else -1) for i in range(20)], "local_id long, global_id long")
    return M.mask_usage(d.select("frame").distinct(), packs, registry)


@query("e16_valid_candidates", "with " + DET + " select frame, count(*) as n, sum((mask_area / 250000.0::double >= 0.01 and line % 3 <> 0)::int)::bigint as n_valid, max((line = 5)::int) as has_patch from det group by 1")
def e16_valid_candidates(spark, sf):
    d = A.detections(spark, sf)
    return M.valid_candidates(d.select("frame", (F.col("mask_area") / AREA).alias("area_frac"), F.when(F.col("line") % 3 != 0, F.col("line")).otherwise(-1).alias("gid"), (F.col("line") == 5).alias("is_patch")))


@query("e17_fallback_patches", "with " + DET + " select frame, cell, rank from (select frame, line * 100000 + det_id as cell, row_number() over (partition by frame order by h desc, line * 100000 + det_id) as rank from det where frame not in (select frame from kept)) where rank <= 2")
def e17_fallback_patches(spark, sf):
    cells = A.detections(spark, sf).select("frame", (F.col("line") * 100000 + F.col("det_id")).alias("cell"), F.col("h").alias("norm"))
    return M.fallback_patches(cells, kept(spark, sf), 2).select("frame", "cell", "rank")


@query("e18_largest_mask", "with " + DET + " select frame, label, max(mask_area) as mask_area, arg_max(line, mask_area * 1000 - line) as line from det group by 1, 2")
def e18_largest_mask(spark, sf):
    return M.largest_mask(A.detections(spark, sf), "frame", "label")


# ---- concept diagnostics -------------------------------------------------------------------

LIST = "[" + ", ".join(f"'{c}'" for c in A.CONCEPTS) + "]"
MENTIONS = f"m as (select doc_id, list_sort(list_filter({LIST}, lambda c: list_contains(ts, c))) as cs from (select doc_id, list_transform(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> ''), lambda t: {CANON_SQL}) as ts from documents))"


def documents_mentions(spark, sf):
    return K.mentions(table(spark, sf, "documents"), "doc_id", "text", A.CONCEPTS)


@query("f1_mentions", f"with {MENTIONS} select doc_id, cs as concepts from m")
def f1_mentions(spark, sf):
    return documents_mentions(spark, sf)


@query("f2_concept_sparsity", f"""with {MENTIONS}, n as (select c as concept, count(*) as n from (select unnest(cs) as c from m) group by 1)
select c.concept, coalesce(n, 0)::bigint as n, round(coalesce(n, 0) / (select count(*) from m), 6)::double as frequency, round((select count(*) from m where len(cs) > 0) / (select count(*) from m), 6)::double as coverage, (select sum(len(cs)) from m)::bigint as mentions from (select unnest({LIST}) as concept) c left join n using (concept)""")
def f2_concept_sparsity(spark, sf):
    return K.sparsity(documents_mentions(spark, sf), "doc_id", A.CONCEPTS).withColumn("frequency", F.round("frequency", 6)).withColumn("coverage", F.round("coverage", 6))


COOC = f"with {MENTIONS}, g as (select a, b from (select unnest({LIST}) as a) cross join (select unnest({LIST}) as b)), p as (select a, b, count(*) as n from (select a, unnest(cs) as b from (select unnest(cs) as a, cs from m)) group by 1, 2), co as (select a, b, coalesce(n, 0)::bigint as n from g left join p using (a, b))"


@query("f4_cooccurrence", COOC + " select * from co")
def f4_cooccurrence(spark, sf):
    return K.cooccurrence(documents_mentions(spark, sf), A.CONCEPTS)


SCORES = COOC + ", s as (select x.a, x.b, @@ as score from co x join co y on y.a = x.a and y.b = x.a join co z on z.a = x.b and z.b = x.b)"
JACCARD = SCORES.replace("@@", "x.n / greatest(y.n + z.n - x.n, 1)::double")
PMI = SCORES.replace("@@", "greatest(ln(greatest(x.n / (select count(*) from m)::double, 1e-12) / greatest(y.n / (select count(*) from m)::double * (z.n / (select count(*) from m)::double), 1e-12)), 0.0)")


@query("f5_jaccard", JACCARD + " select a, b, round(score, 6) as score from s")
def f5_jaccard(spark, sf):
    return scores(spark, sf, "jaccard")


@query("f5_pmi", PMI + " select a, b, round(score, 6) as score from s")
def f5_pmi(spark, sf):
    return scores(spark, sf, "pmi")


def scores(spark, sf, metric):
    m = documents_mentions(spark, sf)
    s = K.cooc_metric(K.cooccurrence(m, A.CONCEPTS), m.count(), metric, clip=True)
    return s.withColumn("score", F.round("score", 6))


@query("f6_top_pairs", JACCARD + " select a, b, round(score, 6) as score from s where a < b order by round(score, 6) desc, a, b limit 20")
def f6_top_pairs(spark, sf):
    return K.top_pairs(scores(spark, sf, "jaccard"), 20)


@query("f7_set_patterns", f"with {MENTIONS} select array_to_string(cs, '|') as pattern, count(*) as n from m where len(cs) > 0 group by 1 having count(*) >= 6 order by n desc, pattern limit 28")
def f7_set_patterns(spark, sf):
    return K.set_patterns(documents_mentions(spark, sf), drop_empty=True)


PROB = "p as (select user_id as key, event_type as concept, least(avg(value) / 100, 1) as p from events group by 1, 2), w as (select unnest(['click', 'error', 'purchase', 'signup', 'view']) as concept, unnest([1.0, 2.0, 0.5, 1.5, 1.0])::double as weight)"


def probabilities(spark, sf):
    p = table(spark, sf, "events").groupBy(F.col("user_id").alias("key"), F.col("event_type").alias("concept")).agg(F.least(F.avg("value") / 100, F.lit(1.0)).alias("p"))
    return p, spark.createDataFrame([("click", 1.0), ("error", 2.0), ("purchase", 0.5), ("signup", 1.5), ("view", 1.0)], "concept string, weight double")


@query("f8_existence_loss", f"with {PROB}, l as (select key, (1 - least(greatest(1 - product(1 - p + 1e-7), 0), 1)) * avg(weight) as loss from p join w using (concept) group by 1) select key, round(loss, 6) as loss from l union all select null, round(avg(loss), 6) from l")
def f8_existence_loss(spark, sf):
    return K.existence_loss(*probabilities(spark, sf)).withColumn("loss", F.round("loss", 6))


@query("f8_implication_loss", f"with {PROB}, e as (select unnest(['click', 'error', 'purchase']) as a, unnest(['view', 'click', 'signup']) as b), h as (select e.a, e.b, avg(greatest(x.p - y.p, 0)) as h, first((u.weight + v.weight) / 2) as w from e join p x on x.concept = e.a join p y on y.concept = e.b and y.key = x.key join w u on u.concept = e.a join w v on v.concept = e.b group by 1, 2) select round(sum(h * w) / sum(w), 6) as loss from h")
def f8_implication_loss(spark, sf):
    p, w = probabilities(spark, sf)
    edges = spark.createDataFrame([("click", "view"), ("error", "click"), ("purchase", "signup")], "a string, b string")
    return K.implication_loss(p, edges, w).select(F.round("loss", 6).alias("loss"))


EVENTS = f"""
fr as (select event_id, user_id as clip, row_number() over (partition by user_id order by ts, event_id) - 1 as frame_idx, event_type as label, value from events),
ty as (select list(t order by t) as ts from (select distinct event_type as t from events)),
ut as (select event_id as utt, clip, frame_idx, ts[{sql_draw(1, 'event_id')} % len(ts) + 1] as concept from fr cross join ty)"""


def spoken(spark, sf):
    """Frames, and every event as an utterance of a drawn concept."""
    f = A.frame_events(spark, sf)
    types = f.select("label").distinct().agg(F.array_sort(F.collect_list("label")).alias("ts"))
    u = f.crossJoin(F.broadcast(types))
    return f, u.select(F.col("event_id").alias("utt"), "clip", "frame_idx", F.get("ts", (draw(1, "event_id") % F.size("ts")).cast("int")).alias("concept"))


F10_SQL = f"""with {EVENTS},
v as (select utt, u.concept, max((f.frame_idx = u.frame_idx)::int) as paired, 1 as near from ut u join fr f on f.clip = u.clip and f.label = u.concept and f.frame_idx between u.frame_idx - 10 and u.frame_idx + 10 group by 1, 2),
a as (select utt, ut.concept, coalesce(paired, 0) as paired, coalesce(near, 0) as near from ut left join v using (utt)),
r as (select concept, paired, near from a union all select null, paired, near from a)
select concept, count(*) as n, sum(paired)::bigint as paired, sum(near)::bigint as near, round(sum(paired) / count(*), 6)::double as paired_rate, round(sum(near) / count(*), 6)::double as near_rate from r group by 1"""


@query("f10_temporal_misalignment", F10_SQL)
def f10_temporal_misalignment(spark, sf):
    f, u = spoken(spark, sf)
    return K.temporal_misalignment(u, f).withColumn("paired_rate", F.round("paired_rate", 6)).withColumn("near_rate", F.round("near_rate", 6))


F11_SQL = f"""with {EVENTS}, sz as (select clip, count(*) as size from fr group by 1), ma as (select clip, frame_idx as at, label as concept, value / 200 as a, (event_id % 9 + 1) / 10.0::double as c from fr where value > 0),
h as (select utt, u.clip, u.frame_idx, u.concept, s.at - u.frame_idx as o, a, c from ut u join ma s on s.clip = u.clip and s.concept = u.concept and s.at between u.frame_idx - 10 and u.frame_idx + 10),
b as (select utt, clip, frame_idx, concept, max((o = 0)::int) as paired, count(*) filter (o <> 0) as n, min(abs(o)) filter (o <> 0) as near_, first(o order by a desc, o) filter (o <> 0) as o, first(a order by a desc, o) filter (o <> 0) as a, first(c order by a desc, o) filter (o <> 0) as c from h group by 1, 2, 3, 4),
f as (select *, n / greatest(least(frame_idx, 10) + least(size - 1 - frame_idx, 10), 1)::double as share from b join sz using (clip) where paired = 0 and n > 0),
s as (select *, round((100 * exp(-0.5::double * pow((a - 0.12::double) / 0.1::double, 2)) + 40 * exp(-0.5::double * pow((near_ / 5.0::double - 0.4::double) / 0.45::double, 2)) + 45 * exp(-0.5::double * pow((share - 0.25::double) / 0.18::double, 2)) + 25 * exp(-0.5::double * pow((c - 0.55::double) / 0.25::double, 2))) / case when concept = 'error' then 2 else 1 end, 9) as score from f where a between 0.01 and 0.45 and share <= 0.55 and c >= 0.1),
r as (select *, row_number() over (partition by concept order by score desc, utt) as rank from s)
select utt, concept, o as "offset", round(a, 6) as area_frac, round(c, 6) as compactness, round(share, 6) as share, round(score, 5) as score, rank from r where rank <= 4 order by r.score desc, concept, utt limit 30"""


@query("f11_mined_examples", F11_SQL)
def f11_mined_examples(spark, sf):
    f, u = spoken(spark, sf)
    m = f.select("clip", "frame_idx", F.col("label").alias("concept"), (F.col("value") / 200).alias("area_frac"), ((F.col("event_id") % 9 + 1) / 10).alias("compactness"))
    sizes = f.groupBy("clip").agg(F.count("*").alias("n"))
    out = K.mine_misaligned(u, m, sizes, avoid=["error"])
    return out.select("utt", "concept", "offset", *[F.round(c, 6).alias(c) for c in ("area_frac", "compactness", "share")], F.round("score", 5).alias("score"), "rank")


MATCHED = """, la as (select clip, frame_idx, case when clip % 2 = 0 then 'big ' || label || '-box' else label || 's' end as label from fr),
v as (select utt, u.concept, max((f.frame_idx = u.frame_idx)::int) as paired, 1 as near from ut u join la f on f.clip = u.clip and @@ and f.frame_idx between u.frame_idx - 10 and u.frame_idx + 10 group by 1, 2),
a as (select utt, ut.concept, coalesce(paired, 0) as paired, coalesce(near, 0) as near from ut left join v using (utt)),
r as (select concept, paired, near from a union all select null, paired, near from a)
select concept, count(*) as n, sum(paired)::bigint as paired, sum(near)::bigint as near, round(sum(paired) / count(*), 6)::double as paired_rate, round(sum(near) / count(*), 6)::double as near_rate from r group by 1"""


def matched(spark, sf, match):
    """Labels with words or letters round the concept."""
    f, u = spoken(spark, sf)
    label = F.when(F.col("clip") % 2 == 0, F.concat(F.lit("big "), "label", F.lit("-box"))).otherwise(F.concat("label", F.lit("s")))
    out = K.temporal_misalignment(u, f.withColumn("label", label), match=match)
    return out.withColumn("paired_rate", F.round("paired_rate", 6)).withColumn("near_rate", F.round("near_rate", 6))


@query("f10_matched_by_word", f"with {EVENTS}" + MATCHED.replace("@@", "list_contains(string_split_regex(f.label, '[^a-z]+'), u.concept)"))
def f10_matched_by_word(spark, sf):
    return matched(spark, sf, "token")


@query("f10_matched_within", f"with {EVENTS}" + MATCHED.replace("@@", "contains(f.label, u.concept)"))
def f10_matched_within(spark, sf):
    return matched(spark, sf, "substring")


@query("e4_fused_vectors", "with v as (select vec_id // 2 as i, vec_id % 2 as k, list_transform(embedding, lambda x: x::double) as z from embeddings), f as (select a.i, list_transform(range(1, len(a.z) + 1), lambda d: a.z[d] + b.z[d]) as s from v a join v b on a.i = b.i and a.k = 0 and b.k = 1) select i as pair, list_transform(s, lambda x: round(x / (sqrt(list_dot_product(s, s)) + 1e-8), 6)) as v from f")
def e4_fused_vectors(spark, sf):
    o = A.objects(spark, sf).withColumn("pair", F.floor(F.col("obj_id") / 2))
    both = o.where("obj_id % 2 = 0").select("pair", F.col("z").alias("a")).join(o.where("obj_id % 2 = 1").select("pair", F.col("z").alias("b")), "pair")
    return both.select("pair", V.rounded_list(M.fuse(F.col("a"), F.col("b"))).alias("v"))


@query("e18_any_visible", "with d as (select l_orderkey as frame, l_linenumber as line, lower(p_type) as label from lineitem join part on l_partkey = p_partkey) select distinct a.frame from d a join d b on a.frame = b.frame and a.label = b.label where a.line = 1 and b.line > 1")
def e18_any_visible(spark, sf):
    """The first detection's label is what the text mentions, the others are masks."""
    d = A.detections(spark, sf)
    return M.any_visible(d.where("line = 1").select("frame", F.col("label").alias("concept")), d.where("line > 1"))


@query("e4_prompts", "with c as (select distinct lower(p_type) as concept from part), t as (select unnest(['a photo of a ', 'a close-up photo of a ', 'a small ', 'a toy ']) as t, unnest(range(4)) as place) select concept, place::int as place, t || case concept when 'small' then 'small thing' else concept end as prompt from c cross join t")
def e4_prompts(spark, sf):
    concepts = table(spark, sf, "part").select(F.lower("p_type").alias("concept")).distinct()
    return M.prompts(concepts, contexts=M.CONTEXTS | {"small": "small thing"})


@query("e11_bad_names", "with " + DET + " select 'bad_' || frame as mask_name from named where frame % 10 = 0 order by 1 limit 50")
def e11_bad_names(spark, sf):
    names = indexed(spark, sf).select(F.when(F.col("frame") % 10 == 0, F.concat(F.lit("bad_"), F.col("frame").cast("string"))).otherwise(F.col("mask_name")).alias("mask_name"))
    return M.bad_names(names)
