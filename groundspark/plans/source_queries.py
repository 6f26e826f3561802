"""Queries of sources, sinks, packed masks and streams, over files that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundspark.functions import text as X
from groundspark.functions import vectors as V
from groundspark.operators import corpus as C
from groundspark.operators import masks as M
from groundspark.operators import metrics as D
from groundspark.operators import pixels as Q
from groundspark.session import shared_path, table
from groundspark.sources import files as S
from groundspark.streaming import jobs as J

from . import adapters as A
from .book import query
from .corpus_queries import FRAMES
from .vector_queries import EMA


@query("a1_transcript_files", "select format('conv_{:05d}', conv_id) as video_name, turn as row_idx, (turn * 17 // 60) || ':' || lpad((turn * 17 % 60)::varchar, 2, '0') as time_raw, role as speaker, text as utterance from conversations")
def a1_transcript_files(spark, sf):
    path = shared_path(spark, "transcripts")
    t = A.transcripts(spark, sf)
    t.select(F.col("time_raw").alias("Time"), F.col("speaker").alias("Speaker"), F.col("utterance").alias("Utterance"), C.stem("video_name").alias("Video Name"), "row_idx").write.csv(path, header=True, escape='"', quoteAll=True)
    return S.read_transcripts(spark, path).select("video_name", "row_idx", "time_raw", "speaker", "utterance")


@query("a2_metadata_files", "select item_id, text from benchmark")
def a2_metadata_files(spark, sf):
    path = shared_path(spark, "metadata")
    b = table(spark, sf, "benchmark").groupBy(F.floor(F.col("item_id") / 64).alias("g")).agg(F.collect_list(F.struct("item_id", "text")).alias("data"))  # files of 64 items
    b.select("data").write.option("maxRecordsPerFile", 1).json(path)
    return S.read_metadata(spark, path, "item_id: bigint, text: string")


@query("a3_split_files", "select doc_id, case when doc_id % 10 = 0 then 'val' else 'train' end as split from documents")
def a3_split_files(spark, sf):
    path = shared_path(spark, "splits")
    S.write_splits(table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, "val").otherwise("train").alias("split")), path)
    return spark.read.parquet(path).select("doc_id", "split")


INDEX_SQL = "select l_orderkey::varchar as frame_relpath, l_linenumber as instance_id, lower(p_type) as concept_clip, (l_quantity * 200)::bigint as mask_area from lineitem join part on l_partkey = p_partkey"


def index_lines(spark, sf):
    d = A.detections(spark, sf)
    return d.select(F.col("frame").cast("string").alias("frame_relpath"), F.col("line").cast("int").alias("instance_id"), F.col("label").alias("concept_clip"), "mask_area")


@query("a4_mask_index", INDEX_SQL)
def a4_mask_index(spark, sf):
    path = shared_path(spark, "index")
    index_lines(spark, sf).write.json(path)
    return S.read_mask_index(spark, path).select("frame_relpath", "instance_id", "concept_clip", "mask_area")


@query("a5_listed_files", "select count(*) as n_docs, true as listed from documents")
def a5_listed_files(spark, sf):
    """Files written by Spark are listed with the lengths that a reader of their contents finds."""
    path = shared_path(spark, "listed")
    table(spark, sf, "documents").select("doc_id").write.parquet(path)
    back = spark.read.parquet(path).select("_metadata.file_name", "_metadata.file_size").groupBy("file_name", "file_size").agg(F.count("*").alias("n"))
    files = S.list_files(spark, path, "*.parquet").select(F.substring_index("path", "/", -1).alias("name"), "length")
    both = back.join(files, F.col("file_name") == F.col("name"), "full")
    return both.agg(F.sum("n").alias("n_docs"), F.every(F.coalesce(F.col("length") == F.col("file_size"), F.lit(False))).alias("listed"))


@query("a6_frame_labels", "select event_id::varchar as frame_key, event_type as label from events union all select event_id::varchar, 'x' from events where event_id % 3 = 0")
def a6_frame_labels(spark, sf):
    e = table(spark, sf, "events")
    one = lambda k: F.concat(F.lit(f'{{"{k}": "'), F.upper("event_type"), F.lit('"}'))
    json = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"objects": ['), one("concept"), F.lit(', {"name": "X"}]}'))).otherwise(F.concat(F.lit('{"masks": ['), one("label"), F.lit("]}")))
    return S.frame_labels(e.select(F.col("event_id").cast("string").alias("frame_key"), json.alias("json")))


@query("a7_coco_instances", "select l_orderkey * 10 + l_linenumber as instance_id, o_orderpriority as file_name, p_name as raw_label from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey")
def a7_coco_instances(spark, sf):
    images = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("file_name"))
    categories = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    li = table(spark, sf, "lineitem")
    ann = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("image_id"), F.col("l_partkey").alias("category_id"), F.array(F.col("l_quantity")).alias("bbox"), F.col("l_quantity").alias("area"), F.lit(0).alias("iscrowd"))
    return S.coco_instances(images, categories, ann).select("instance_id", "file_name", "raw_label")


@query("a8_union_boxes", "select l_orderkey::varchar as file_name, [min(l_quantity), min(l_linenumber)::double, greatest(max(l_quantity + 5) - min(l_quantity), 1), greatest(max(l_linenumber + 2) - min(l_linenumber), 1)::double] as bbox from lineitem group by 1")
def a8_union_boxes(spark, sf):
    li = table(spark, sf, "lineitem")
    box = F.struct(F.lit(None).cast("string").alias("name"), F.col("l_quantity").alias("xmin"), F.col("l_linenumber").cast("double").alias("ymin"), (F.col("l_quantity") + 5).alias("xmax"), (F.col("l_linenumber") + 2).cast("double").alias("ymax"))
    return S.union_boxes(li.groupBy(F.col("l_orderkey").cast("string").alias("file_name")).agg(F.collect_list(box).alias("objects"), F.lit("f").alias("folder"))).select("file_name", "bbox")


@query("a8_xml_boxes", """with o as (select p_partkey as k, unnest(range(p_partkey % 4)) as i, p_size, lower(p_type) as t from part),
b as (select k, min(i * 3 + p_size)::double as x, min(i + 0.5)::double as y, max(i * 5 + p_size)::double as x2, max(i + 2)::double as y2 from o where (k + i) % 5 <> 0 group by 1)
select 'img_' || p_partkey as file_name, case when p_partkey % 4 > 0 and p_partkey % 7 > 0 then lower(p_type) when p_partkey % 4 > 1 then lower(p_type) else 'n' || p_partkey % 10 end as label, case when x is not null then [x, y, greatest(x2 - x, 1), greatest(y2 - y, 1)] end as bbox
from part left join b on k = p_partkey""")
def a8_xml_boxes(spark, sf):
    """Annotations written as XML, many to a file: without objects, without boxes (every fifth), without a first name (every seventh), with white space."""
    p = table(spark, sf, "part")
    pad = lambda c: F.concat(F.lit(" "), c.cast("string"), F.lit(" "))
    box = lambda i: F.struct(pad(i * 3 + F.col("p_size")).alias("xmin"), pad(i + F.lit(0.5)).alias("ymin"), pad(i * 5 + F.col("p_size")).alias("xmax"), pad(i + 2).alias("ymax"))
    name = lambda i: F.when((i > 0) | (F.col("p_partkey") % 7 > 0), F.lower("p_type"))
    one = lambda i: F.struct(name(i).alias("name"), F.when((F.col("p_partkey") + i) % 5 > 0, box(i)).alias("bndbox"))
    objects = F.when(F.col("p_partkey") % 4 > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("p_partkey") % 4 - 1), one))
    path = shared_path(spark, "xml")
    rows = p.select(F.concat(F.lit("n"), (F.col("p_partkey") % 10).cast("string")).alias("folder"), F.concat(F.lit("img_"), F.col("p_partkey").cast("string")).alias("filename"), objects.alias("object"))
    spread = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # a file is read by one task, so its size has a bound
    spread.write.format("xml").option("rootTag", "annotations").option("rowTag", "annotation").option("maxRecordsPerFile", 20_000).save(path)
    return S.read_boxes(spark, path)


@query("a9_synset_words", "select 'n' || lpad(p_partkey::varchar, 8, '0') as key, list_distinct_ordered as names from (select p_partkey, case when p_name = lower(p_type) then [p_name] else [p_name, lower(p_type)] end as list_distinct_ordered from part)")
def a9_synset_words(spark, sf):
    line = F.concat(F.format_string("n%08d", "p_partkey"), F.lit("  "), F.col("p_name"), F.lit(", "), F.col("p_type"), F.lit(", "), F.upper("p_name"))
    return table(spark, sf, "part").select(S.parse_words(line).alias("w")).select("w.*")


A10_SQL = "select p_name as concept, p_partkey::int as concept_id from part where p_partkey % 3 = 0 union all select p_name, 0 from part where p_partkey % 3 <> 0 union all select lower(p_type), 1 from part where p_partkey % 3 = 1"


@query("a10_concept_lists", A10_SQL)
def a10_concept_lists(spark, sf):
    """Every part, dealt over the shapes: an object with the part's number, a list, an object without numbers."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    listed = F.to_json(F.array("p_name", F.lower("p_type")))
    numbered = F.to_json(F.create_map(F.col("p_name"), k.cast("string")))
    places = F.to_json(F.create_map(F.col("p_name"), F.col("p_type")))
    return S.concept_list(p.select(F.when(k % 3 == 0, numbered).when(k % 3 == 1, listed).otherwise(places).alias("json")))


@query("a11_evaluation_files", "select event_type as class, count(*)::varchar as total from events group by 1")
def a11_evaluation_files(spark, sf):
    path = shared_path(spark, "eval")
    p = A.predictions(spark, sf)
    S.write_eval(p, D.accuracy_report(p).where("class is not null"), path)
    return spark.read.csv(f"{path}/metrics", header=True).select("class", "total")


@query("a12_scores", "select event_type as category, round(100 * avg((value < 20)::int), 6) as score from events group by 1")
def a12_scores(spark, sf):
    p = A.predictions(spark, sf).groupBy("class").agg(F.avg(F.col("correct").cast("double")).alias("acc"))
    return S.load_scores(p).withColumn("score", F.round("score", 6))


@query("b2_b3_sentences", FRAMES + "select transcript_filename, row_idx, ss as sentences from t4")
def b2_b3_sentences(spark, sf):
    t = C.filter_speakers(C.add_end_time(C.valid_transcripts(A.transcripts(spark, sf))), ["user"])
    return t.select("transcript_filename", "row_idx", X.split_sentences(X.strip_annotations("utterance")).alias("sentences"))


@query("b19_scaled_boxes", "select p_partkey, round(greatest(least(c - h * 1.2::double, 100), 0), 6) as x1, round(greatest(least(c + h * 1.2::double, 100), 0), 6) as x2 from (select p_partkey, (p_partkey % 50 + p_partkey % 50 + p_size) / 2.0::double as c, p_size / 2.0::double as h from part)")
def b19_scaled_boxes(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 50).cast("double").alias("x1"), (F.col("p_partkey") % 50 + F.col("p_size")).cast("double").alias("x2"), F.lit(1.0).alias("y1"), F.lit(2.0).alias("y2"), F.lit(100).alias("width"), F.lit(100).alias("height"))
    return M.scale_box(p).select("p_partkey", F.round("x1", 6).alias("x1"), F.round("x2", 6).alias("x2"))


@query("b21_video_frames", FRAMES + "select frame_filename, trunc(timestamp * (25 + length(video_filename) % 2))::int as video_frame from named")
def b21_video_frames(spark, sf):
    f = C.preprocess(A.transcripts(spark, sf), ["user"])
    videos = f.select("video_filename").distinct().withColumn("rate", (25 + F.length("video_filename") % 2).cast("double"))
    return Q.frame_numbers(f, videos).select("frame_filename", "video_frame")


@query("b25_fused_scores", "select event_id, round(case when event_id % 4 = 0 then value else 0.5 * value + 0.5 * user_id end, 6) as alpha, round(case when event_id % 4 = 0 then value else greatest(value, user_id) end, 6) as largest from events")
def b25_fused_scores(spark, sf):
    e = table(spark, sf, "events")
    o = F.when(F.col("event_id") % 4 != 0, F.col("user_id").cast("double"))
    return e.select("event_id", F.round(V.combine_scores(F.col("value"), o), 6).alias("alpha"), F.round(V.combine_scores(F.col("value"), o, "max"), 6).alias("largest"))


def packed(spark, sf):
    """Masks of 8 x 8 from the signs of the embeddings."""
    e = table(spark, sf, "embeddings").where("size(embedding) = 64")
    bits = F.array_join(F.transform("embedding", lambda x: F.when(x > 0, "01").otherwise("00")), "")
    return e.select(F.col("vec_id").alias("key"), F.unhex(bits).alias("mask"))


GRID = "with g as (select vec_id as key, unnest(embedding) > 0 as on_, unnest(range(64)) as i from embeddings where len(embedding) = 64), px as (select key, i // 8 as y, i % 8 as x from g where on_)"


@query("b28_normalized_masks", GRID + " select key, count(*) filter (on_)::bigint * 4 as area from g group by 1")
def b28_normalized_masks(spark, sf):
    m = packed(spark, sf).select("key", F.col("mask").alias("data"), F.lit(8).alias("height"), F.lit(8).alias("width"))
    wide = Q.normalize_mask(m, 16, 16)
    return Q.packed_geometry(wide, 16, 16).select("key", F.col("area").cast("long").alias("area"))


@query("b29_mask_geometry", GRID + " select key, count(*)::double as area, round(count(*) / 64.0, 6)::double as area_frac, round(count(*) / ((max(x) - min(x) + 1) * (max(y) - min(y) + 1))::double, 6) as fill, round(avg(x), 6) as cx, round(avg(y), 6) as cy from px group by 1")
def b29_mask_geometry(spark, sf):
    g = Q.packed_geometry(packed(spark, sf), 8, 8)
    return g.select("key", "area", *[F.round(c, 6).alias(c) for c in ("area_frac", "fill", "cx", "cy")])


@query("b30_masked_pooling", "with v as (select vec_id // 4 as sample, vec_id % 4 as cell, list_transform(embedding, lambda x: x::double) as f from embeddings), k as (select sample, cell, f, unnest([0, 1]) as k from v), w as (select sample, cell, f, k, case when k = 0 then 1.0 else (cell % 3) / 2.0 end::double as w from k), d as (select sample, k, unnest(range(len(f))) as d, w, unnest(f) as x from w), m as (select sample, k, d, sum(x * w) / greatest(sum(w), 1e-6) as x from d group by 1, 2, 3) select sample, k, list(round(x, 6) order by d) as v from m group by 1, 2")
def b30_masked_pooling(spark, sf):
    e = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("sample"), (F.col("vec_id") % 4).alias("cell"), V.doubles("embedding").alias("f"))
    w = e.select("sample", "cell", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).withColumn("w", F.when(F.col("k") == 0, 1.0).otherwise((F.col("cell") % 3) / 2.0))
    return Q.masked_pool(e, w).select("sample", "k", V.rounded_list("v").alias("v"))


POOL = """with v as (select vec_id as key, list_transform(embedding, lambda x: x::double) as z from embeddings where len(embedding) = 64),
m as (select key, z, unnest([0, 1]) as k, unnest([list_transform(z, lambda x: (x > 0)::int::double), list_transform(z, lambda x: least(4 * abs(x), 1.0))]) as m from v),
s as (select key, z, k, list_transform(range(16), lambda i: (m[(i // 4) * 16 + (i % 4) * 2 + 1] + m[(i // 4) * 16 + (i % 4) * 2 + 2] + m[(i // 4) * 16 + (i % 4) * 2 + 9] + m[(i // 4) * 16 + (i % 4) * 2 + 10]) / 4) as w from m),
r as (select *, list_transform(range(16), lambda i: list_max(list_transform(list_filter(range(16), lambda j: abs(j // 4 - i // 4) <= 1 and abs(j % 4 - i % 4) <= 1), lambda j: w[j + 1])) - w[i + 1]) as ring from s)"""


def maps_and_masks(spark, sf):
    """Embeddings as maps of 4 channels, 4 x 4, with two masks of 8 x 8: the signs, and four times the sizes."""
    v = table(spark, sf, "embeddings").where("size(embedding) = 64").select(F.col("vec_id").alias("key"), V.doubles("embedding").alias("fmap"))
    masks = [F.transform("fmap", lambda x: (x > 0).cast("double")), F.transform("fmap", lambda x: F.least(4 * F.abs(x), F.lit(1.0)))]
    return v.withColumn("masks", F.array(*masks))


@query("b30_packed_pooling", POOL + " select key, k, round(list_sum(w), 6) as mass, list_transform(range(4), lambda c: round(list_dot_product(z[c * 16 + 1:c * 16 + 16], w) / greatest(list_sum(w), 1e-6), 6)) as pooled, list_transform(range(4), lambda c: round(list_dot_product(z[c * 16 + 1:c * 16 + 16], ring) / greatest(list_sum(ring), 1e-6), 6)) as context from r")
def b30_packed_pooling(spark, sf):
    six = lambda c: V.rounded_list(c).alias(c)
    return Q.pool_packed(maps_and_masks(spark, sf), (4, 4, 4), (8, 8), 1).select("key", "k", F.round("mass", 6).alias("mass"), six("pooled"), six("context"))


@query("b30_context_ring", """with v as (select vec_id as key, list_transform(embedding, lambda x: least(4 * abs(x::double), 1.0)) as m from embeddings where len(embedding) = 64)
select key, list_transform(range(64), lambda i: round(list_max(list_transform(list_filter(range(64), lambda j: abs(j // 8 - i // 8) <= 2 and abs(j % 8 - i % 8) <= 2), lambda j: m[j + 1])) - m[i + 1], 6)) as ring from v""")
def b30_context_ring(spark, sf):
    soft = maps_and_masks(spark, sf).select("key", F.get("masks", F.lit(1)).alias("mask"))
    return Q.context_ring(soft, 8, 8, 2).select("key", F.transform("ring", lambda x: F.round(x, 6)).alias("ring"))


@query("b31_selected_nouns", "with t as (select item_id as key, unnest(string_split_regex(trim(lower(text)), '\\s+')) as lemma, unnest(range(len(string_split_regex(trim(lower(text)), '\\s+')))) as i from benchmark), o as (select key, lemma, min(i) as i from t where i % 2 = 0 and lemma not in ('the', 'and') and length(lemma) >= 2 group by 1, 2) select key, lemma, place::int as place from (select *, row_number() over (partition by key order by i) as place from o) where place <= 5")
def b31_selected_nouns(spark, sf):
    words = table(spark, sf, "benchmark").select(F.col("item_id").alias("key"), F.posexplode(F.split(F.trim(F.lower("text")), r"\s+")).alias("i", "lemma"))
    tagged = words.select("key", "i", "lemma", F.when(F.col("i") % 2 == 0, "NOUN").otherwise("VERB").alias("tag"), F.col("lemma").isin("the", "and").alias("is_stop"))
    return Q.select_nouns(tagged, words.select(F.col("lemma").alias("token")).distinct())


@query("c22_event_frames", "with ev as (select o_orderkey as event, o_custkey as video, o_orderkey % 7 * 0.3::double as s, o_orderkey % 7 * 0.3::double + 0.9::double as e from orders), own as (select l_orderkey * 2 as event, l_linenumber::bigint as idx from lineitem), vid as (select o_custkey as video, row_number() over (partition by o_custkey order by o_orderkey) - 1 as idx from orders), a as (select event, idx from ev join own using (event)), b as (select event, idx from ev join vid using (video) where event not in (select event from own) and idx >= floor(s * 5) and idx <= greatest(ceil(e * 5) - 1, floor(s * 5))) select * from a union all select * from b")
def c22_event_frames(spark, sf):
    from pyspark.sql import Window

    o = table(spark, sf, "orders")
    s = (F.col("o_orderkey") % 7) * F.lit(0.3)
    events = o.select(F.col("o_orderkey").alias("event"), F.col("o_custkey").alias("video"), s.alias("start"), (s + F.lit(0.9)).alias("end"))
    own = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 2).alias("event"), F.col("l_linenumber").cast("long").alias("idx"), F.lit("f").alias("frame"))
    video = o.select(F.col("o_custkey").alias("video"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("long").alias("idx"), F.lit("g").alias("frame"))
    return C.resolve_event_frames(events, own, video).select("event", "idx")


@query("c23_caption_mismatches", "select conv_id as image_id, turn as sent_id from conversations where turn % 5 = 0 or conv_id % 9 = 4")
def c23_caption_mismatches(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("image_id"), F.col("turn").alias("sent_id"), "text")
    annotations = c.withColumn("caption", F.when(F.col("sent_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).drop("text")
    return C.caption_mismatches(annotations, c.where("image_id % 9 <> 4").withColumnRenamed("text", "raw"))


@query("c23_caption_integrity", "select conv_id * 10 + turn as sent_id, case when conv_id % 11 = 0 then 'image' when turn % 5 = 4 then 'sentence' when turn % 5 = 0 then 'caption' when conv_id % 9 = 4 then 'source' when conv_id % 7 = 3 then 'image_id' else 'file_name' end as reason from conversations where conv_id % 11 = 0 or turn % 5 in (0, 4) or conv_id % 9 = 4 or conv_id % 7 = 3 or conv_id % 13 = 5")
def c23_caption_integrity(spark, sf):
    """Conversations as images, turns as captions; every way of disagreeing occurs."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text", (F.col("conv_id") * 10 + F.col("turn")).alias("sent_id"))
    name = F.concat(F.lpad(F.col("conv_id").cast("string"), 12, "0"), F.lit(".jpg"))
    ids = c.select("conv_id").distinct()
    images = ids.where("conv_id % 11 <> 0").select(F.col("conv_id").alias("id"), name.alias("file_name"))
    sentences = c.where("turn % 5 <> 4").select("sent_id", (F.col("conv_id") + 1000000).alias("imgid"), F.when(F.col("turn") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("raw"))
    source = ids.where("conv_id % 9 <> 4").select((F.col("conv_id") + 1000000).alias("imgid"), F.when(F.col("conv_id") % 7 == 3, F.col("conv_id") + 1).otherwise(F.col("conv_id")).alias("cocoid"), F.concat(F.lit("train_"), F.when(F.col("conv_id") % 13 == 5, F.lit("other.jpg")).otherwise(name)).alias("filename"))
    return C.caption_integrity(c.select("sent_id", F.col("conv_id").alias("image_id"), F.col("text").alias("caption")), images, sentences, source)


@query("c23_caption_splits", "select distinct case role when 'system' then 'train' else role end as split, case role when 'system' then 'restval' else role end as source_split from conversations")
def c23_caption_splits(spark, sf):
    role = F.when(F.col("role") == "system", "restval").otherwise(F.col("role"))
    return C.caption_splits(table(spark, sf, "conversations").select(role.alias("split")))


@query("d8_label_sources", "select p_type, list_sort(list(distinct p_brand)) as sources from part group by 1")
def d8_label_sources(spark, sf):
    return D.label_sources(table(spark, sf, "part"), "p_type", "p_brand")


SEEN = "from (select distinct frame_relpath, instance_id, concept_clip from (" + INDEX_SQL + "))"


def ingested(spark, sf):
    """Every line comes twice, in files that several batches read."""
    path, out = shared_path(spark, "incoming"), shared_path(spark, "ingested")
    lines = index_lines(spark, sf).select("frame_relpath", "instance_id", "concept_clip")
    lines.union(lines).write.option("compression", "gzip").json(path)
    third = max(1, len(spark.read.text(path).inputFiles()) // 3)
    stream = spark.readStream.schema("frame_relpath string, instance_id int, concept_clip string").option("maxFilesPerTrigger", third).json(path)
    J.ingest_index(stream, ["frame_relpath", "instance_id", "concept_clip"], "concept_clip", out, shared_path(spark, "state")).awaitTermination()
    return out


@query("s1_streamed_index", "select concept_clip, count(*) as n " + SEEN + " group by 1")
def s1_streamed_index(spark, sf):
    return J.read_counts(spark, ingested(spark, sf))


@query("s1_ingested_rows", "select * " + SEEN)
def s1_ingested_rows(spark, sf):
    return J.read_index(spark, ingested(spark, sf))


@query("e10_index_union", """
with i as (select l_orderkey as n, l_linenumber as k, lower(p_type) as c from lineitem join part on l_partkey = p_partkey),
g as (select n, k, c, 0 as generation from i where n % 3 <> 1 union all select n, k, upper(c), 1 from i where n % 2 = 0 and k > 1),
l as (select n, max(generation) as generation from g group by 1)
select 'dir_' || n as frame, k as instance_id, c as concept_clip, generation from g join l using (n, generation)""")
def e10_index_union(spark, sf):
    """Two thirds of the frames in a first generation, every second in another without its first masks; both with lines that don't parse."""
    path = shared_path(spark, "generations")
    lines = index_lines(spark, sf).withColumn("n", F.col("frame_relpath").cast("long")).withColumn("frame_relpath", F.concat(F.lit("dir/"), F.col("frame_relpath"), F.lit(".a.jpg")))
    later = lines.where("n % 2 = 0 and instance_id > 1").withColumn("concept_clip", F.upper("concept_clip"))
    for i, part in enumerate((lines.where("n % 3 <> 1"), later)):
        json, broken = F.to_json(F.struct("frame_relpath", "instance_id", "concept_clip")), F.concat(F.lit('{"frame_relpath": "'), F.col("frame_relpath"))
        part.select(F.explode(F.array(json, broken)).alias("value")).write.text(f"{path}/{i}")
    return S.merged_index(spark, path).select(S.frame_base("frame_relpath").alias("frame"), "instance_id", "concept_clip", "generation")


@query("s2_streamed_codebook", EMA + " select proto_id::int as proto_id, round(size, 6) as ema_size from nz")
def s2_streamed_codebook(spark, sf):
    path, out = shared_path(spark, "objects"), shared_path(spark, "codebook")
    o, p = A.objects(spark, sf), A.prototypes(spark, sf)
    o.select("obj_id", "z").write.parquet(path)
    start = p.select("proto_id", V.l2_normalize("p").alias("p"), F.lit(1.0).alias("ema_size"), V.l2_normalize("p").alias("ema_sum"))
    stream = spark.readStream.schema("obj_id long, z array<double>").parquet(path)  # without a limit of files all that are there are one batch
    J.stream_ema(stream, start, out, shared_path(spark, "state")).awaitTermination()
    return spark.read.parquet(f"{out}/0").select("proto_id", F.round("ema_size", 6).alias("ema_size"))
