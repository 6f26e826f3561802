"""Concept diagnostics: mentions, coverage, co-occurrence, temporal misalignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundspark.functions import text as X
from groundspark.functions import vectors as V

from .util import cap_per_group, written


def mentions(df: DataFrame, key: str, text: str, concepts: list[str]) -> DataFrame:
    """key and the sorted distinct concepts (a short fixed list) that a text mentions after canonicalisation; found among the concepts' surface forms where the row is read."""
    forms = X.surface_forms(concepts)
    if not forms:
        return df.select(key, F.array().cast("array<string>").alias("concepts"))
    table = F.create_map(*[F.lit(x) for kv in forms.items() for x in kv])
    hits = F.array_intersect(X.tokenize_alpha(text), F.array(*map(F.lit, forms)))
    found = F.array_sort(F.array_distinct(F.transform(hits, lambda t: F.element_at(table, t))))
    return df.select(key, F.coalesce(found, F.array().cast("array<string>")).alias("concepts"))


def long_mentions(m: DataFrame, key: str) -> DataFrame:
    return m.select(key, F.explode("concepts").alias("concept"))


def concept_table(df: DataFrame, concepts: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(c,) for c in concepts], "concept string")


def sparsity(m: DataFrame, key: str, concepts: list[str]) -> DataFrame:
    """concept, n, frequency (zeros kept) with the share of rows that mention any concept and all mentions."""
    n = long_mentions(m, key).groupBy("concept").agg(F.count("*").alias("n"))
    all_ = m.agg(F.count("*").alias("rows"), F.sum((F.size("concepts") > 0).cast("long")).alias("covered"), F.coalesce(F.sum(F.size("concepts")), F.lit(0)).alias("mentions"))
    out = concept_table(m, concepts).join(n, "concept", "left").crossJoin(F.broadcast(all_)).withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("concept", F.col("n").cast("long").alias("n"), F.try_divide(F.col("n"), F.col("rows")).alias("frequency"), F.try_divide(F.col("covered"), F.col("rows")).alias("coverage"), F.col("mentions").cast("long").alias("mentions"))


def cooccurrence(m: DataFrame, concepts: list[str]) -> DataFrame:
    """a, b, n for every ordered pair of concepts (zeros kept); the diagonal holds the counts."""
    pairs = m.select(F.explode("concepts").alias("a"), "concepts").select("a", F.explode("concepts").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    c = concept_table(m, concepts)
    grid = c.withColumnRenamed("concept", "a").crossJoin(F.broadcast(c.withColumnRenamed("concept", "b")))  # the square of a short fixed list
    return grid.join(pairs, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def cooc_metric(cooc: DataFrame, rows: int | Column, metric: str = "jaccard", clip: bool = False, eps: float = 1e-12) -> DataFrame:
    """a, b, score: jaccard, pmi or log1p of the counts. rows: number of utterances."""
    own = cooc.where("a = b")
    j = cooc.join(own.select("a", F.col("n").alias("na")), "a").join(own.select("b", F.col("n").alias("nb")), "b")
    n = (F.lit(rows) if isinstance(rows, int) else rows).cast("double")
    union = F.greatest(F.col("na") + F.col("nb") - F.col("n"), F.lit(1))
    pmi = F.log(F.greatest(F.col("n") / n, F.lit(eps)) / F.greatest(F.col("na") / n * (F.col("nb") / n), F.lit(eps)))
    score = {"jaccard": F.col("n") / union, "pmi": F.greatest(pmi, F.lit(0.0)) if clip else pmi, "log1p": F.log1p(F.col("n").cast("double"))}[metric]
    return j.select("a", "b", score.alias("score"))


def top_pairs(scores: DataFrame, n: int = 200) -> DataFrame:
    """the n best pairs a < b."""
    return scores.where("a < b").orderBy(F.desc("score"), "a", "b").limit(n)


def set_patterns(m: DataFrame, min_count: int = 6, most: int = 28, drop_empty: bool = False) -> DataFrame:
    """the most frequent exact concept sets."""
    rows = m.where(F.size("concepts") > 0) if drop_empty else m
    return rows.groupBy(F.array_join("concepts", "|").alias("pattern")).agg(F.count("*").alias("n")).where(F.col("n") >= min_count).orderBy(F.desc("n"), "pattern").limit(most)


def existence_loss(df: DataFrame, weights: DataFrame) -> DataFrame:
    """F8: per key: 1 - soft-or of the probabilities (key, concept, p) of mentioned concepts, times their mean weight; and its mean over keys (key null)."""
    j = df.join(weights, "concept").groupBy("key").agg(F.collect_list("p").alias("ps"), F.avg("weight").alias("w"))
    per = j.select("key", ((1 - V.soft_or(F.array_sort("ps"))) * F.col("w")).alias("loss"))
    return per.unionByName(per.agg(F.lit(None).cast(per.schema["key"].dataType).alias("key"), F.avg("loss").alias("loss")))


def implication_loss(df: DataFrame, edges: DataFrame, weights: DataFrame, mode: str = "mean") -> DataFrame:
    """F8: weighted mean over edges a -> b of mean max(0, p(a) - p(b)). Edge weight: a, b, mean or geomean of the concepts' weights."""
    w = lambda k: weights.select(F.col("concept").alias(k), F.col("weight").alias(f"w{k}"))
    e = edges.join(w("a"), "a").join(w("b"), "b")
    how = {"a": F.col("wa"), "b": F.col("wb"), "mean": (F.col("wa") + F.col("wb")) / 2, "geomean": F.sqrt(F.col("wa") * F.col("wb"))}[mode]
    p = lambda k: df.select("key", F.col("concept").alias(k), F.col("p").alias(f"p{k}"))
    per = p("a").join(e.withColumn("w", how), "a").join(p("b"), ["key", "b"]).groupBy("a", "b").agg(F.avg(F.greatest(F.col("pa") - F.col("pb"), F.lit(0.0))).alias("hinge"), F.first("w").alias("w"))
    return per.agg(F.try_divide(F.sum(F.col("hinge") * F.col("w")), F.sum("w")).alias("loss"))


#: Concepts that fill a scene, whose examples count half.
AVOIDED = "floor ground kitchen road room sand".split()


def grams(c: str, n: int = 3) -> Column:
    """The distinct runs of n characters of a text; a shorter text is one run."""
    runs = lambda chars: F.transform(F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0))), lambda i: F.array_join(F.slice(chars, i + 1, n), ""))
    return F.array_distinct(V.let(F.split(c, ""), runs))


def substrings(labels: DataFrame, concepts: DataFrame) -> DataFrame:
    """Label, concept for every concept that is somewhere in a label (both distinct), for any number of either.

    A concept is joined by its run of three characters (of its length, if shorter) that the fewest labels have, and what it
    meets there is checked. A concept with a run that no label has meets nothing. The empty concept is in every label.
    """
    c = concepts.where("concept <> ''").withColumn("n", F.least(F.length("concept"), F.lit(3)))
    sizes = [r.n for r in c.select("n").distinct().collect()]  # three at most
    runs = F.array_distinct(F.flatten(F.array(*[F.when(F.length("label") >= n, grams("label", n)).otherwise(F.array().cast("array<string>")) for n in sizes]))) if sizes else F.array().cast("array<string>")
    has = written(labels.where("label is not null").select("label", F.explode(runs).alias("gram")))
    own = F.coalesce(*[F.when(F.col("n") == n, grams("concept", n)) for n in (1, 2, 3)])
    counted = c.select("concept", F.explode(own).alias("gram")).join(has.groupBy("gram").agg(F.count("*").alias("labels")), "gram", "left").na.fill(0, ["labels"])
    rare = counted.groupBy("concept").agg(F.min(F.struct("labels", "gram")).alias("least")).where("least.labels > 0").select("concept", "least.gram")
    met = has.join(rare, "gram").where(F.contains("label", F.col("concept"))).select("label", "concept")
    return met.unionByName(labels.where("label is not null").crossJoin(F.broadcast(concepts.where("concept = ''").limit(1))).select("label", "concept"))


def matched_labels(labels: DataFrame, concepts: DataFrame, match: str = "exact") -> DataFrame:
    """labels (clip, frame_idx, label) with the concepts (column concept) they stand for: equal, one of the label's words (token), or anywhere in it (substring)."""
    if match == "exact":
        return labels.select("clip", "frame_idx", F.col("label").alias("concept"))
    each = labels.select("label").distinct()
    if match == "token":
        known = each.select("label", F.explode(F.array_distinct(X.tokenize_alpha("label"))).alias("concept")).join(concepts.select("concept").distinct(), "concept", "left_semi")
    else:
        known = substrings(each, concepts.select("concept").distinct())
    return labels.select("clip", "frame_idx", "label").join(known, "label").drop("label")


#: Frames of a block, so that few of what is seen lie near the edge of one.
BLOCK = 64


def within(u: DataFrame, seen: DataFrame, window: int, how: str = "inner") -> DataFrame:
    """u (clip, frame_idx, concept) with offset and the other columns of seen (clip, at, concept: each once) up to window frames away.

    A mention is in one block of frames, what is seen in the one or two it can be met from: joined by equality, neither side is
    multiplied by the window. how left: a mention with others in its block, or none, has rows with a null offset, too.
    """
    size = max(BLOCK, 2 * window + 1)
    block = lambda c: F.floor(c / size)
    spread = seen.withColumn("__b", F.explode(F.sequence(block(F.col("at") - window), block(F.col("at") + window))))
    j = u.withColumn("__b", block(F.col("frame_idx"))).join(spread, ["clip", "__b", "concept"], how)
    away = F.col("at") - F.col("frame_idx")
    j = j.withColumn("offset", F.when(F.abs(away) <= window, away)).drop("__b")
    return j if how == "left" else j.where("offset is not null")


def visibility(utts: DataFrame, labels: DataFrame, window: int, match: str = "exact") -> DataFrame:
    """(utt, concept) with paired and near flags: the concept is labelled in the paired frame, or within window frames of the clip.

    utts: utt, clip, frame_idx, concept; labels: clip, frame_idx, label. Mentions and labels meet in blocks of frames.
    """
    seen = matched_labels(labels, utts, match).distinct().withColumnRenamed("frame_idx", "at")
    u = utts.select("utt", "clip", "frame_idx", "concept").distinct()
    near = within(u, seen, window, "left").groupBy("utt", "clip", "frame_idx", "concept").agg(F.max((F.col("offset") == 0).cast("int")).alias("paired"), F.max(F.when(F.col("offset").isNotNull(), 1)).alias("near"))
    v = near.groupBy("utt", "concept").agg(F.coalesce(F.max("paired"), F.lit(0)).alias("paired"), F.coalesce(F.max("near"), F.lit(0)).alias("near"), F.count("*").alias("places"))
    return v.select("utt", "concept", "paired", "near", F.explode(F.sequence(F.lit(1), F.col("places"))).alias("place")).drop("place")


def temporal_misalignment(utts: DataFrame, labels: DataFrame, window_sec: float = 2.0, fps: float = 5.0, match: str = "exact") -> DataFrame:
    """concept (null: any), n, paired, near and both rates."""
    v = visibility(utts, labels, int(round(window_sec * fps)), match)
    any_ = v.groupBy("utt").agg(F.max("paired").alias("paired"), F.max("near").alias("near")).select(F.lit(None).cast("string").alias("concept"), "paired", "near")
    rows = v.select("concept", "paired", "near").unionByName(any_)
    g = rows.groupBy("concept").agg(F.count("*").alias("n"), F.sum("paired").alias("paired"), F.sum("near").alias("near"))
    return g.withColumn("paired_rate", F.col("paired") / F.greatest("n", F.lit(1))).withColumn("near_rate", F.col("near") / F.greatest("n", F.lit(1)))


def mine_misaligned(utts: DataFrame, masks: DataFrame, frames: DataFrame, window: int = 10, fps: float = 5.0, per_concept: int = 4, top: int = 30, avoid: list[str] = AVOIDED, only_bare: bool = True) -> DataFrame:
    """mentions whose paired frame lacks the concept while frames up to window away show it: the best per_concept of each concept, the best top of all.

    utts: utt, clip, frame_idx, concept (a row a mention). masks: clip, frame_idx, concept, area_frac, compactness. frames: clip, n
    (its frames are 0 .. n - 1). only_bare: no concept of the utterance is in the paired frame. The largest mask (the earliest of
    equals) has an area of 0.01 .. 0.45 and fills a tenth of its box; at most 0.55 of the frames in reach show it. Score: 100, 40,
    45 and 25 times the Gaussians of area, time to the nearest, visible share and compactness; half of it for avoided concepts.
    """
    largest = masks.where("area_frac > 0").groupBy("clip", "frame_idx", "concept").agg(F.max(F.struct("area_frac", "compactness")).alias("m"))
    largest = largest.select("clip", F.col("frame_idx").alias("at"), "concept", "m.*")
    u = utts.select("utt", "clip", "frame_idx", "concept").distinct()
    hits = within(u, largest, window)
    by = Window.partitionBy("utt", "clip", "frame_idx")
    away = F.col("offset") != 0
    found = hits.groupBy("utt", "clip", "frame_idx", "concept").agg(
        F.max((~away).cast("int")).alias("paired"), F.count(F.when(away, 1)).alias("n"), F.min(F.when(away, F.abs("offset"))).alias("nearest"),
        F.max(F.when(away, F.struct("area_frac", (-F.col("offset")).alias("o"), "compactness"))).alias("best"),
    )
    found = found.withColumn("seen", F.max("paired").over(by)).where((F.col("seen") == 0) if only_bare else (F.col("paired") == 0)).where("n > 0").join(frames.select("clip", F.col("n").alias("size")), "clip")
    reach = F.least(F.col("frame_idx"), F.lit(window)) + F.least(F.col("size") - 1 - F.col("frame_idx"), F.lit(window))
    f = found.select("utt", "concept", (-F.col("best.o")).alias("offset"), "best.area_frac", "best.compactness", "nearest", (F.col("n") / F.greatest(reach, F.lit(1))).alias("share"))
    f = f.where("area_frac between 0.01 and 0.45 and share <= 0.55 and compactness >= 0.10")
    score = 100 * V.gaussian("area_frac", 0.12, 0.10) + 40 * V.gaussian(F.col("nearest") / fps, 0.4, 0.45) + 45 * V.gaussian("share", 0.25, 0.18) + 25 * V.gaussian("compactness", 0.55, 0.25)
    scored = f.withColumn("score", F.round(F.when(F.col("concept").isin(avoid), score / 2).otherwise(score), 9))
    ranked = cap_per_group(scored, ["concept"], per_concept, F.desc("score"), F.col("utt"), name="rank")
    return ranked.orderBy(F.desc("score"), "concept", "utt").limit(top).select("utt", "concept", "offset", "area_frac", "compactness", "share", "score", "rank")
