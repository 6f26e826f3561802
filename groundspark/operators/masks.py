"""Mask-candidate tables: detections to labelled, ranked, packed masks and the concept registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundspark.functions import text as X
from groundspark.functions import vectors as V

from .blocks import best_partners
from .util import cap_per_group, global_index, written

MOST = 4096  # concepts that are sent as one array
#: The canonical concepts, in order.
CANONICAL = "ball basket car cat chair computer crib door foot hand paper puzzle stairs table window".split()


#: Prompts of a concept, and concepts that a prompt names otherwise.
TEMPLATES = ["a photo of a {}", "a close-up photo of a {}", "a small {}", "a toy {}"]
CONTEXTS = {"leg": "human leg", "arm": "human arm", "hand": "human hand", "foot": "human foot", "face": "human face", "head": "human head", "baby": "baby person", "child": "child person"}


def scale_box(df: DataFrame, scale: float = 1.2) -> DataFrame:
    """Box x1, y1, x2, y2 scaled about its centre and clipped to width x height."""
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    hw, hh = (F.col("x2") - F.col("x1")) / 2 * scale, (F.col("y2") - F.col("y1")) / 2 * scale
    clip = lambda v, top: F.greatest(F.least(v, top.cast("double")), F.lit(0.0))
    return df.withColumns({"x1": clip(cx - hw, F.col("width")), "x2": clip(cx + hw, F.col("width")), "y1": clip(cy - hh, F.col("height")), "y2": clip(cy + hh, F.col("height"))})


def box_geometry(w: Column, h: Column, area: Column, image_area: float) -> dict[str, Column]:
    """B29 of masks given by box and area: area fraction, fill fraction of the box, aspect ratio."""
    return {"area_frac": area / F.lit(float(image_area)), "fill": F.try_divide(area.cast("double"), w * h), "aspect": F.try_divide(F.greatest(w, h), F.least(w, h))}


def pixel_geometry(pixels: DataFrame, *keys: str, height: int, width: int) -> DataFrame:
    """B29 of masks as pixel rows (x, y): area, box, fractions, aspect ratio, centroid."""
    g = pixels.groupBy(*keys).agg(F.count("*").alias("area"), F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    w, h = F.col("x2") - F.col("x1") + 1, F.col("y2") - F.col("y1") + 1
    return g.withColumns(box_geometry(w, h, F.col("area"), height * width))


def filter_detections(df: DataFrame, keys: list[str], image_area: float, min_score: float = 0.30, top: int = 30, background: list[str] = (), min_sam: float = 0.87, min_area: float = 3000, max_frac: float = 0.6, min_fill: float = 0.25, max_aspect: float = 8.0) -> DataFrame:
    """Score, then the best top of each frame, then background, SAM score, area, fraction, fill and aspect (the cap comes first)."""
    capped = cap_per_group(df.where(F.col("dino_score") >= min_score), keys, top, F.desc("dino_score"), F.col("line"), F.col("det_id"), name="rank")
    g = box_geometry(F.col("w"), F.col("h"), F.col("mask_area"), image_area)
    ok = ~F.col("label").isin(list(background)) & (F.col("sam_score") >= min_sam) & (F.col("mask_area") >= min_area) & (g["area_frac"] <= max_frac) & (g["area_frac"] < 0.995) & (g["fill"] >= min_fill) & (g["aspect"] <= max_aspect)
    return capped.where(ok)


def best_mask(df: DataFrame, *keys: str) -> DataFrame:
    """The mask of the highest SAM score, the first line on ties."""
    return df.groupBy(*keys).agg(F.max_by("line", F.struct("sam_score", -F.col("line"))).alias("line"), F.max("sam_score").alias("sam_score"))


def assign_labels(masks: DataFrame, concepts: DataFrame, thr: float = 0.30) -> DataFrame:
    """Masks (z) with the concept (concept, priority, c) of the highest cosine; priority wins ties; below thr the label is null.

    Up to MOST concepts are sent to the tasks as one array; more are met in blocks.
    """
    if concepts.count() > MOST:
        rows = written(masks.withColumn("__row", F.monotonically_increasing_id()))
        ranked = F.concat(F.when(F.col("priority"), "0").otherwise("1"), "concept")  # priority first among equals
        best = best_partners(rows.select(F.col("__row").alias("id"), V.l2_normalize("z").alias("v")), concepts.select(ranked.alias("id"), V.l2_normalize("c").alias("v")))
        found = best.select(F.col("id").alias("__row"), F.col("score").alias("clip_sim"), F.when(F.col("score") >= thr, F.substring("best", F.lit(2), F.length("best"))).alias("label"))
        return rows.join(found, "__row", "left").drop("__row")
    table = concepts.agg(F.sort_array(F.collect_list(F.struct((~F.col("priority")).alias("extra"), "concept", "c"))).alias("cs"))
    scored = masks.crossJoin(F.broadcast(table)).withColumn("best", F.array_max(F.transform("cs", lambda x, i: F.struct(F.round(V.cosine("z", x["c"]), 9).alias("sim"), (-i).alias("i"), x["concept"].alias("concept")))))
    return scored.withColumn("clip_sim", F.col("best.sim")).withColumn("label", F.when(F.col("clip_sim") >= thr, F.col("best.concept"))).drop("cs", "best")


def prompts(concepts: DataFrame, templates: list[str] = TEMPLATES, contexts: dict[str, str] = CONTEXTS) -> DataFrame:
    """Concept, place and prompt: every template with the concept (column concept), or with what its context names it; the input of an encoder."""
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in contexts.items() for x in kv]), F.lower("concept")), F.col("concept")) if contexts else F.col("concept")
    texts = F.array(*[F.concat(*[x for i, part in enumerate(t.split("{}")) for x in ([named] if i else []) + [F.lit(part)]]) for t in templates])
    return concepts.select("concept", F.posexplode(texts).alias("place", "prompt"))


def ensemble_vectors(df: DataFrame, *keys: str, vector: str = "z") -> DataFrame:
    """Mean of the normalised vectors of a key, normalised again."""
    one = df.select(*keys, F.posexplode(V.l2_normalize(vector)).alias("d", "x")).groupBy(*keys, "d").agg(F.avg("x").alias("x"))
    return one.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("v")).select(*keys, V.l2_normalize("v").alias("v"))


def fuse(a: Column, b: Column) -> Column:
    """Normalised sum of two vectors."""
    return V.l2_normalize(F.zip_with(a, b, lambda x, y: x + y))


def index_masks(df: DataFrame, keys: list[str]) -> DataFrame:
    """E5: kept masks ranked by priority, score, SAM and similarity, with the instance number within frame and label and an output name."""
    w = Window.partitionBy(*keys, "label").orderBy(F.desc("is_priority"), F.desc("dino_score"), F.desc("sam_score"), F.desc("clip_sim"), "line", "det_id")
    rows = df.where("label is not null").withColumn("instance_id", F.row_number().over(w) - 1)
    return rows.withColumn("mask_name", F.concat_ws("_", *[F.col(k).cast("string") for k in keys], F.lit("obj"), X.sanitize_label("label"), F.format_string("%03d", "instance_id")))


def concept_counts(df: DataFrame, concepts: list[str], previous: DataFrame | None = None) -> DataFrame:
    """Concept, n for all concepts (zeros kept, case ignored), added to previous counts."""
    spark = df.sparkSession
    base = spark.createDataFrame([(c,) for c in concepts], "concept string")
    n = df.groupBy(F.lower("label").alias("concept")).agg(F.count("*").alias("n"))
    if previous is not None:
        n = n.unionByName(previous.select("concept", "n")).groupBy("concept").agg(F.sum("n").alias("n"))
    return base.join(n, "concept", "left").select("concept", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def pack_masks(df: DataFrame, vocab: DataFrame, keys: list[str]) -> DataFrame:
    """One row a frame: mask names and concept ids, sorted by label and name; labels without an id are left out."""
    rows = df.join(vocab.select("concept", "concept_id"), df["label"] == vocab["concept"])
    packed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("label", "mask_name", "concept_id"))).alias("ms"))
    return packed.select(*keys, F.transform("ms", lambda m: m["mask_name"]).alias("masks"), F.transform("ms", lambda m: m["concept_id"].cast("int")).alias("concept_ids"))


def concept_vocab(labels: DataFrame, existing: DataFrame | None = None, canonical: list[str] = CANONICAL) -> DataFrame:
    """Concept, concept_id: canonical ones first, the rest sorted; existing ids stay and new labels follow."""
    spark = labels.sparkSession
    found = labels.select("concept").distinct()
    if existing is None:
        existing = spark.createDataFrame(list(enumerate(canonical)), "concept_id int, concept string")
    new = found.join(existing.select("concept"), "concept", "left_anti")
    start = existing.agg(F.coalesce(F.max("concept_id") + 1, F.lit(0))).first()[0]
    numbered = global_index(new, F.col("concept"), name="r")
    return existing.select("concept", "concept_id").unionByName(numbered.select("concept", (F.col("r") + start).cast("int").alias("concept_id")))


def resume(df: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key isn't done yet."""
    return df.join(done.select(*keys).distinct(), list(keys), "left_anti")


def frequency_report(names: DataFrame, packed: DataFrame) -> DataFrame:
    """Label, parsed, packed, with label null for the totals of names that match the form and that don't (bad)."""
    m = names.withColumn("m", X.mask_filename("mask_name"))
    by = m.where("m.label is not null").groupBy(F.col("m.label").alias("label")).agg(F.count("*").alias("parsed"))
    done = packed.groupBy("label").agg(F.count("*").alias("packed"))
    rows = by.join(done, "label", "full").select("label", F.coalesce("parsed", F.lit(0)).cast("long").alias("parsed"), F.coalesce("packed", F.lit(0)).cast("long").alias("packed"), F.lit(None).cast("long").alias("bad"))
    return rows.unionByName(m.agg(F.lit(None).cast("string").alias("label"), F.count("m.label").alias("parsed"), F.lit(None).cast("long").alias("packed"), F.sum(F.col("m.label").isNull().cast("long")).alias("bad")))


def bad_names(names: DataFrame, most: int = 50) -> DataFrame:
    """The first of the mask names that don't have the form, in order."""
    return names.where(X.mask_filename("mask_name")["label"].isNull() & F.col("mask_name").isNotNull()).select("mask_name").orderBy("mask_name").limit(most)


def resolve_keys(frames: DataFrame, index: DataFrame) -> DataFrame:
    """Each path of frames with the index path that is equal, else has the same unique last name, else the same unique last two names."""
    one = lambda n: F.substring_index("path", "/", -n)
    out = frames.select(F.col("path").alias("wanted")).withColumn("path", F.col("wanted"))
    index = index.select("path").distinct()
    exact = index.select(F.col("path").alias("k0"), F.col("path").alias("p0"))
    by = lambda n: index.groupBy(one(n).alias(f"k{n}")).agg(F.count("*").alias("c"), F.first("path").alias(f"p{n}")).where("c = 1").drop("c")
    out = out.withColumn("k0", F.col("path")).withColumn("k1", one(1)).withColumn("k2", one(2))
    for t, k in ((exact, "k0"), (by(1), "k1"), (by(2), "k2")):
        out = out.join(t, k, "left")
    return out.select(F.col("wanted").alias("path"), F.coalesce("p0", "p1", "p2").alias("resolved"))


def concept_registry(local: DataFrame, counts: DataFrame, global_: DataFrame, min_masks: int = 5, alpha: float = 0.5, clip_min: float = 0.5, clip_max: float = 2.0) -> DataFrame:
    """Local (local_id, concept) to global ids (-1: dropped, with the reason), counts and weights.

    Weight: (lower median / count) ^ alpha, clipped, over its mean, of kept concepts; one elsewhere.
    """
    j = local.join(global_.select("concept", "global_id"), "concept", "left").join(counts.select("concept", F.col("n").alias("count")), "concept", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    reason = F.when(F.col("global_id").isNull(), "not_in_concept_list").when(F.col("count") < min_masks, F.format_string(f"freq<{min_masks} (count=%d)", "count"))
    j = j.withColumn("drop_reason", reason)
    kept = j.where("drop_reason is null")
    median = kept.agg(F.expr("percentile_disc(0.5) within group (order by count)").alias("med"))
    raw = F.greatest(F.least(F.pow(F.col("med") / F.col("count"), F.lit(alpha)), F.lit(clip_max)), F.lit(clip_min))
    weighed = kept.crossJoin(F.broadcast(median)).withColumn("raw", raw)
    mean = weighed.agg(F.avg("raw").alias("mean"))
    w = weighed.crossJoin(F.broadcast(mean)).select("local_id", (F.col("raw") / F.col("mean")).alias("weight"))
    return j.join(w, "local_id", "left").select("local_id", "concept", F.when(F.col("drop_reason").isNull(), F.col("global_id")).otherwise(-1).alias("global_id"), "count", F.coalesce("weight", F.lit(1.0)).alias("weight"), "drop_reason")


def pick_counts(df: DataFrame) -> DataFrame:
    """(concept, n) of the first source with any usable value: packed, parsed, counts (rows: source, concept, value as text)."""
    good = df.withColumn("n", F.col("value").try_cast("long")).where("n is not null").withColumn("o", F.when(F.col("source") == "packed", 0).when(F.col("source") == "parsed", 1).otherwise(2))
    first = good.agg(F.min("o").alias("o"))
    return good.join(F.broadcast(first), "o").select("concept", "n")


def mask_usage(frames: DataFrame, packs: DataFrame, registry: DataFrame) -> DataFrame:
    """Frames asked for, missing, empty, all dropped; masks before, kept, dropped (dropped ones stay with id -1)."""
    r = registry.select(F.col("local_id").alias("concept_id"), "global_id")
    masks = packs.select("frame", F.explode_outer("concept_ids").alias("concept_id")).join(r, "concept_id", "left")
    per = masks.groupBy("frame").agg(F.count("concept_id").alias("before"), F.sum((F.coalesce("global_id", F.lit(-1)) >= 0).cast("long")).alias("kept"))
    j = frames.select("frame").join(per, "frame", "left")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return j.agg(F.count("*").alias("frames"), n(F.col("before").isNull()).alias("missing"), n(F.col("before") == 0).alias("empty"), n((F.col("before") > 0) & (F.col("kept") == 0)).alias("all_dropped"), F.coalesce(F.sum("before"), F.lit(0)).alias("masks"), F.coalesce(F.sum("kept"), F.lit(0)).alias("kept"), F.coalesce(F.sum(F.col("before") - F.col("kept")), F.lit(0)).alias("dropped"))


def valid_candidates(df: DataFrame, min_frac: float = 0.01) -> DataFrame:
    """Per frame: candidates, valid ones (area fraction, slot and id), and whether a patch stands in."""
    ok = (F.col("area_frac") >= min_frac) & (F.col("gid") >= 0)
    return df.groupBy("frame").agg(F.count("*").alias("n"), F.sum(ok.cast("long")).alias("n_valid"), F.max(F.col("is_patch").cast("int")).alias("has_patch"))


def fallback_patches(cells: DataFrame, valid: DataFrame, k: int = 4) -> DataFrame:
    """Frames without a valid candidate take the k cells of the largest norm."""
    w = Window.partitionBy("frame").orderBy(F.desc("norm"), "cell")
    return cells.join(valid.select("frame").distinct(), "frame", "left_anti").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def largest_mask(df: DataFrame, *keys: str) -> DataFrame:
    """The largest mask of each key, the first line on ties."""
    return df.groupBy(*keys).agg(F.max("mask_area").alias("mask_area"), F.max_by("line", F.struct("mask_area", -F.col("line"))).alias("line"))


def any_visible(mentions: DataFrame, masks: DataFrame) -> DataFrame:
    """Frames with any of the concepts that their text mentions (frame, concept)."""
    return mentions.join(masks.select("frame", F.col("label").alias("concept")).distinct(), ["frame", "concept"], "left_semi").select("frame").distinct()
