"""Label mapping, instance pools, forced-choice trials, scoring and run comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundspark.functions import text as X
from groundspark.functions import vectors as V

from .blocks import best_partners
from .metrics import accuracy_report
from .util import cap_per_group, draw, global_index, written

#: Candidate labels of multi-word or rare classes (an empty list blocks the class), and categories left out of trials.
CANDIDATES = {
    "motorcycle": ["bike", "bicycle"], "laptop": ["computer", "ipad", "monitor"], "cell phone": ["phone"], "refrigerator": ["fridge"],
    "handbag": ["purse", "bag"], "suitcase": ["bag", "box", "case"], "potted plant": ["plant", "pot"], "dining table": ["table"], "vase": ["pot"],
    "traffic light": ["light"], "stop sign": ["sign"],
    "sports ball": ["ball"], "baseball glove": ["gloves"], "baseball bat": ["stick"], "tennis racket": ["stick"], "frisbee": ["toy"],
    "wine glass": ["glass"], "hot dog": ["sausage"], "donut": ["cookie", "cake"],
    "teddy bear": ["teddy", "bear"], "hair drier": ["dryer"], "toaster": ["toast", "oven"],
    "parking meter": [], "fire hydrant": [], "tie": [], "skis": [], "snowboard": [], "surfboard": [], "broccoli": [], "remote": [], "keyboard": [],
}


def phrase_variants(c: Column) -> Column:
    """A phrase, its cleaned form and the singular and plural of its last word, in order."""
    p = X.clean_phrase(c)
    head = F.element_at(F.split(p, " "), -1)
    rest = F.substring(p, F.lit(1), F.length(p) - F.length(head))
    return F.array_distinct(F.array(X.normalize_name(c), p, F.concat(rest, X.singularize(head)), F.concat(rest, X.pluralize(head))))


def head_variants(c: Column) -> Column:
    head = F.element_at(F.split(X.clean_phrase(c), " "), -1)
    return F.array_distinct(F.array(head, X.singularize(head), X.pluralize(head)))


def map_labels(raw: DataFrame, vocab: DataFrame, overrides: dict[str, str] | None = None, table: dict[str, list[str]] = CANDIDATES, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """H1: raw_label -> mapped (null: dropped) and reason. The first good candidate in the vocabulary wins.

    Order: override (final), exact, candidate table (an empty list blocks; a miss falls through), synonyms, phrase variants, head variants.
    """
    label = X.normalize_name("raw_label")
    lists = lambda d: F.try_element_at(F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]) if v else F.array().cast("array<string>"))]), label) if d else F.lit(None).cast("array<string>")
    over = lists({k: [v] for k, v in (overrides or {}).items()})
    blocked = F.size(lists(table)) == 0
    named = lambda cs, why: F.transform(F.coalesce(cs, F.array().cast("array<string>")), lambda x: F.struct(x.alias("cand"), F.lit(why).alias("why")))
    expand = lambda cs: F.flatten(F.transform(F.coalesce(cs, F.array().cast("array<string>")), lambda x: F.array_distinct(F.concat(phrase_variants(x), head_variants(x)))))
    tail = F.concat(named(F.array(label), "exact"), named(expand(lists(table)), "candidate"), named(expand(lists(synonyms or {})), "synonym"), named(phrase_variants(F.col("raw_label")), "phrase_variant"), named(head_variants(F.col("raw_label")), "head_variant"))
    only_exact = named(F.array(label), "exact")
    all_ = F.when(over.isNotNull(), named(over, "override")).when(F.coalesce(blocked, F.lit(False)), only_exact).otherwise(tail)
    rows = raw.select("raw_label").distinct().withColumn("missed", F.when(over.isNotNull(), "override_oov_or_bad").when(F.coalesce(blocked, F.lit(False)), "blocked_default").otherwise("no_match"))
    cands = rows.select("raw_label", F.posexplode(all_).alias("rank", "c")).select("raw_label", "rank", "c.*").where(X.is_good_label("cand", X.COCO_STOP))
    hits = cands.join(vocab.select(F.col("token").alias("cand")).distinct(), "cand", "left_semi").groupBy("raw_label").agg(F.min_by(F.struct("cand", "why"), "rank").alias("best"))
    return rows.join(hits, "raw_label", "left").select("raw_label", F.col("best.cand").alias("mapped"), F.coalesce("best.why", "missed").alias("reason"))


def mapping_report(mapped: DataFrame) -> DataFrame:
    """H2: reason, n, exact, mapped, dropped."""
    same = F.col("mapped") == X.normalize_name("raw_label")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return mapped.groupBy("reason").agg(F.count("*").alias("n"), n(same).alias("exact"), n(~same).alias("changed"), n(F.col("mapped").isNull()).alias("dropped"))


def filter_instances(df: DataFrame, mapped: DataFrame, min_area: float = 1024, min_side: float = 16) -> DataFrame:
    """H3: instances (w, h, iscrowd, raw_label) that aren't crowds, are large enough and have a mapped label."""
    ok = (F.col("iscrowd") == 0) & (F.col("w") * F.col("h") >= min_area) & (F.col("w") >= min_side) & (F.col("h") >= min_side)
    return df.where(ok).join(mapped.where("mapped is not null").select("raw_label", F.col("mapped").alias("label")), "raw_label")


def build_pools(df: DataFrame, cap: int = 200, seed: int = 0) -> DataFrame:
    """H4: label, place (from 0), instance_id: at most cap drawn instances of a label."""
    return cap_per_group(df, ["label"], cap, draw(seed, "instance_id"), F.col("instance_id"), name="place").select("label", (F.col("place") - 1).alias("place"), "instance_id")


def eligible_categories(labels: DataFrame, vocab: DataFrame, excluded: list[str] = ()) -> DataFrame:
    """H7: labels in the vocabulary that aren't excluded."""
    return labels.where(~F.col("label").isin(list(excluded)) & (F.col("label") != "")).select("label").distinct().join(vocab.select(F.col("token").alias("label")), "label", "left_semi")


def _foils(targets: DataFrame, pools: DataFrame, n_foils: int, seed: int, *key: str) -> DataFrame:
    """targets with foils: n distinct other labels in drawn order, each with one drawn instance.

    Labels are numbered. A slot draws a place among the labels that are still left, which becomes a number by stepping over the
    target's and those taken before: n_foils draws a trial, whatever the number of labels, which are joined by number.
    """
    sizes = pools.groupBy("label").agg(F.count("*").alias("n"))
    labels = written(global_index(sizes, F.col("label"), name="li"))
    n = labels.count()
    if n < n_foils + 1:
        raise ValueError("too few labels for that many foils")
    step = lambda taken, x: F.aggregate(F.array_sort(taken), x, lambda y, t: F.when(y >= t, y + 1).otherwise(y))
    place = lambda slot: draw(seed, *key, slot) % (F.lit(n - 1).cast("long") - slot)
    taken = F.aggregate(F.sequence(F.lit(0), F.lit(n_foils - 1)), F.array("li"), lambda t, slot: F.concat(t, F.array(step(t, place(slot)))))
    t = targets.join(labels.select("label", "li"), "label").select(*key, F.posexplode(F.slice(taken, 2, n_foils)).alias("slot", "f_li"))
    numbered = labels.select(F.col("li").alias("f_li"), F.col("label").alias("f_label"), "n")
    rows = t.join(numbered, "f_li").withColumn("f_place", (draw(seed + 1, *key, "slot") % F.col("n")).cast("int"))
    p = pools.select(F.col("label").alias("f_label"), F.col("place").alias("f_place"), F.col("instance_id").alias("f_id"))
    foils = rows.join(p, ["f_label", "f_place"]).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("slot", "f_label", "f_id"))).alias("fs"))
    return targets.join(foils, list(key)).withColumn("foil_categories", F.transform("fs", lambda x: x["f_label"])).withColumn("foil_ids", F.transform("fs", lambda x: x["f_id"])).drop("fs")


def make_trials(pools: DataFrame, n_foils: int = 3, n_repeats: int = 5, seed: int = 0) -> DataFrame:
    """H5: trials of every pooled instance, n_repeats each, numbered from 0."""
    targets = pools.select("label", F.col("instance_id").alias("target_id"), F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))).alias("rep"))
    t = _foils(targets, pools, n_foils, seed, "target_id", "rep")
    return global_index(t, F.col("label"), F.col("target_id"), F.col("rep"), name="trial_num").select("trial_num", F.col("label").alias("target_category"), "target_id", "foil_categories", "foil_ids")


def make_fixed_trials(pools: DataFrame, n: int = 100, n_foils: int = 3, seed: int = 0) -> DataFrame:
    """H6: n trials a category with drawn targets; trial_num restarts in each."""
    sizes = pools.groupBy("label").agg(F.count("*").alias("n"))
    t = sizes.select("label", "n", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("trial_num")).withColumn("place", (draw(seed + 7, "label", "trial_num") % F.col("n")).cast("int"))
    t = t.join(pools, ["label", "place"]).select("label", "trial_num", F.col("instance_id").alias("target_id"))
    return _foils(t, pools, n_foils, seed, "label", "trial_num").select(F.col("label").alias("target_category"), "trial_num", "target_id", "foil_categories", "foil_ids")


def invalid_trials(trials: DataFrame, vocab: DataFrame) -> DataFrame:
    """H8: trials with a category outside the vocabulary, a repeated foil, or the target among the foils."""
    cats = trials.select("trial_num", F.explode(F.concat(F.array("target_category"), "foil_categories")).alias("token"))
    out = cats.join(vocab.select("token"), "token", "left_anti").select("trial_num")
    odd = trials.where((F.size(F.array_distinct("foil_categories")) < F.size("foil_categories")) | F.array_contains("foil_categories", F.col("target_category"))).select("trial_num")
    return out.union(odd).distinct()


def invalid_labels(trials: DataFrame, vocab: DataFrame, mode: str = "vocab", bad: list[str] = X.BAD_LABELS) -> DataFrame:
    """H8: label of the targets that make stored trials unusable: no good label, or in mode vocab one that isn't in the vocabulary."""
    labels = trials.select(F.col("target_category").alias("label")).distinct()
    poor = labels.where(~F.coalesce(X.is_good_label("label", bad), F.lit(False)))
    if mode != "vocab":
        return poor
    known = vocab.select(F.col("token").alias("label")).distinct()
    return labels.join(known, "label", "left_anti").unionByName(poor).distinct()


def trials_are_valid(trials: DataFrame, vocab: DataFrame, mode: str = "vocab", stored_mode: str | None = None) -> bool:
    """H8: whether stored trials can be used: made in the same mode (an unknown one fits any), with labels, all of them sound."""
    if stored_mode and stored_mode.strip().lower() != mode:
        return False
    return bool(trials.head(1)) and not invalid_labels(trials, vocab, mode).head(1)


def relabel(trials: DataFrame, mapping: dict[str, str], vocab: DataFrame | None = None) -> DataFrame:
    """H9: categories of targets and foils renamed; with a vocabulary (token) only to words that are in it."""
    if vocab is not None:
        known = {r.token for r in vocab.where(F.col("token").isin(list(set(mapping.values())))).select("token").distinct().collect()}  # no more than the mapping has
        mapping = {k: v for k, v in mapping.items() if v in known}
    if not mapping:
        return trials
    change = lambda c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), c), c)
    return trials.withColumn("target_category", change(F.col("target_category"))).withColumn("foil_categories", F.transform("foil_categories", change))


def score_trials(df: DataFrame) -> DataFrame:
    """Probs, pred (first of equals), correct (index 0), entropy."""
    return df.withColumn("probs", V.softmax("scores")).withColumn("pred", V.argmax("scores")).withColumn("correct", F.col("pred") == 0).withColumn("entropy", V.entropy("probs"))


def forced_choice(trials: DataFrame, vecs: DataFrame, queries: DataFrame, alpha: float = 0.5, objects: DataFrame | None = None) -> DataFrame:
    """trial_num, scores of target and foils: cosine of the category's query (label, t) and each image (instance_id, z).

    objects: candidates (instance_id, z) whose best score is fused with the image's.
    """
    slots = trials.select("trial_num", F.col("target_category").alias("label"), F.posexplode(F.concat(F.array("target_id"), "foil_ids")).alias("slot", "instance_id"))
    s = slots.join(vecs, "instance_id").join(queries, "label").withColumn("g", V.cosine("z", "t"))
    if objects is not None:
        o = slots.join(objects.select("instance_id", F.col("z").alias("oz")), "instance_id").join(queries, "label").groupBy("trial_num", "slot").agg(F.max(V.cosine("oz", "t")).alias("o"))
        s = s.join(o, ["trial_num", "slot"], "left").withColumn("g", V.combine_scores(F.col("g"), F.col("o"), "alpha", alpha))
    return s.groupBy("trial_num", F.col("label").alias("class")).agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "g"))), lambda x: x["g"]).alias("scores"))


LOWEST = -1e9  # object score of an image without candidates


def forced_choice_predictions(trials: DataFrame, frames: DataFrame, queries: DataFrame, objects: DataFrame | None = None, kind: str = "image", mode: str = "alpha", alpha: float = 0.5) -> DataFrame:
    """trial_num, class, s_global, s_object and s_combined (a score a slot, the target first), and the first largest slot of each (pred_global, pred_object, pred_combined).

    kind image: the category's text against the images of target and foils; kind text: the target's image against the texts of all
    categories. frames: instance_id, z of each frame of an image's clip, of which the best counts. queries: label, t. objects:
    instance_id, z, is_null of candidates; the best one that isn't null counts, LOWEST without any.
    """
    if kind == "image":
        slots = trials.select("trial_num", F.col("target_category").alias("class"), F.col("target_category").alias("label"), F.posexplode(F.concat(F.array("target_id"), "foil_ids")).alias("slot", "instance_id"))
    else:
        slots = trials.select("trial_num", F.col("target_category").alias("class"), F.col("target_id").alias("instance_id"), F.posexplode(F.concat(F.array("target_category"), "foil_categories")).alias("slot", "label"))
    asked = slots.join(queries, "label")
    best = lambda vecs, name: asked.join(vecs, "instance_id").groupBy("trial_num", "slot").agg(F.max(V.cosine("z", "t")).alias(name))
    s = slots.join(best(frames.select("instance_id", "z"), "g"), ["trial_num", "slot"])
    if objects is not None:
        s = s.join(best(objects.where("not is_null").select("instance_id", "z"), "o"), ["trial_num", "slot"], "left").withColumn("o", F.coalesce("o", F.lit(LOWEST)))
    else:
        s = s.withColumn("o", F.lit(None).cast("double"))
    s = s.withColumn("c", V.combine_scores(F.col("g"), F.col("o"), mode, alpha))
    rows = s.groupBy("trial_num", "class").agg(F.sort_array(F.collect_list(F.struct("slot", "g", "o", "c"))).alias("x"))
    lists = {"global": "g", "object": "o", "combined": "c"}
    out = rows.select("trial_num", "class", *[F.transform("x", lambda v: v[f]).alias(f"s_{n}") for n, f in lists.items()])  # noqa: B023
    if objects is None:
        out = out.withColumn("s_object", F.lit(None).cast("array<double>"))
    return out.withColumns({f"pred_{n}": V.argmax(f"s_{n}") for n in lists})


def build_clips(anchors: DataFrame, frames: DataFrame, m: int = 5, stride: int = 1) -> DataFrame:
    """M frames round an anchor's place in its clip (clip, frame_num), steps of stride, clamped to the clip; without frames the anchor is repeated."""
    clip = frames.groupBy("clip").agg(F.sort_array(F.collect_list("frame_num")).alias("fs"))
    j = anchors.join(clip, "clip", "left")
    exact = F.array_position("fs", F.col("frame_num")).cast("int") - 1
    centre = F.when(exact >= 0, exact).otherwise(F.least(F.greatest(F.size(F.filter("fs", lambda x: x < F.col("frame_num"))), F.lit(0)), F.size("fs") - 1))
    pick = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.get("fs", F.least(F.greatest(centre + (i - m // 2) * stride, F.lit(0)), F.size("fs") - 1)))
    return j.select("anchor", "clip", F.when(F.col("fs").isNull(), F.array_repeat("frame_num", m)).otherwise(pick).alias("frames"))


def hybrid_report(preds: DataFrame) -> DataFrame:
    """By run: overall, in-vocabulary and other accuracy with totals."""
    c, v = F.col("correct").cast("double"), F.col("in_vocab")
    return preds.groupBy("run_id").agg(F.count("*").alias("total"), F.avg(c).alias("accuracy"), F.sum(v.cast("long")).alias("in_vocab_total"), F.avg(F.when(v, c)).alias("in_vocab_accuracy"), F.sum((~v).cast("long")).alias("oov_total"), F.avg(F.when(~v, c)).alias("oov_accuracy"))


def branches(trials: DataFrame, vocab: DataFrame | None, mode: str = "hybrid", kind: str = "image") -> DataFrame:
    """trial_num, class, branch (encoder or units) and target_in_vocab of every trial.

    mode encoder: all trials go to the text encoder; units: all to the labelled units; hybrid: to the encoder where the target's
    label (kind image) or every candidate's label (kind text) is in the vocabulary. Without a vocabulary none is. The division is
    by an anti join of exploded candidates: the vocabulary may be of any size.
    """
    t = trials.select("trial_num", F.col("target_category").alias("class"), "foil_categories")
    if vocab is None:
        return t.select("trial_num", "class", F.lit("encoder" if mode == "encoder" else "units").alias("branch"), F.lit(False).alias("target_in_vocab"))
    known = vocab.select("token").distinct()
    own = F.transform(F.array("class"), lambda c: F.struct(c.alias("token"), F.lit(True).alias("target")))
    others = F.transform("foil_categories", lambda c: F.struct(c.alias("token"), F.lit(False).alias("target")))
    missing = t.select("trial_num", F.explode(F.concat(own, others)).alias("c")).select("trial_num", "c.token", "c.target").join(known, "token", "left_anti")
    by = missing.groupBy("trial_num").agg(F.max("target").alias("target_missing"))
    out = t.join(by, "trial_num", "left").withColumn("target_in_vocab", ~F.coalesce("target_missing", F.lit(False)))
    sound = {"encoder": F.lit(True), "units": F.lit(False), "hybrid": F.col("target_in_vocab") if kind == "image" else F.col("target_missing").isNull()}[mode]
    return out.select("trial_num", "class", F.when(sound, "encoder").otherwise("units").alias("branch"), "target_in_vocab")


def branch_report(preds: DataFrame) -> DataFrame:
    """Class (null: all), and correct, total and accuracy (null without a trial) of all trials, of those with a target in and out of the vocabulary, and by branch.

    preds: class, correct, branch, target_in_vocab.
    """
    known, encoder = F.col("target_in_vocab"), F.col("branch") == "encoder"
    parts = {"all": F.lit(True), "in_vocab_target": known, "oov_target": ~known, "encoder_branch": encoder, "units_branch": ~encoder}
    columns = []
    for name, which in parts.items():
        right = F.count_if(which & F.col("correct"))
        columns += [right.alias(f"{name}_correct"), F.count_if(which).alias(f"{name}_total"), F.try_divide(right, F.count_if(which)).alias(f"{name}_accuracy")]
    return preds.groupBy("class").agg(*columns).unionByName(preds.agg(F.lit(None).cast("string").alias("class"), *columns).where("all_total > 0"))


def class_table(preds: DataFrame, classes: list[str]) -> DataFrame:
    """Run and one accuracy column a class."""
    return preds.groupBy("run_id").pivot("class", classes).agg(F.avg(F.col("correct").cast("double")))


def compare_runs(base: DataFrame, exp: DataFrame, sort_by: str = "delta") -> DataFrame:
    """Class, base, exp, delta for classes of both runs, and the macro means (class null). sort_by: alpha, or baseline, experiment or delta, the largest first."""
    order = {"alpha": F.asc_nulls_last("class"), "baseline": F.desc("base"), "experiment": F.desc("exp"), "delta": F.desc("delta")}[sort_by]
    a = base.groupBy("class").agg(F.avg(F.col("correct").cast("double")).alias("base"))
    b = exp.groupBy("class").agg(F.avg(F.col("correct").cast("double")).alias("exp"))
    j = a.join(b, "class").withColumn("delta", F.col("exp") - F.col("base"))
    return j.unionByName(j.agg(F.lit(None).cast("string").alias("class"), F.avg("base").alias("base"), F.avg("exp").alias("exp"), F.avg("delta").alias("delta"))).orderBy(order)


def metrics_by_class(preds: DataFrame) -> DataFrame:
    """Overall, macro and per class by run."""
    return accuracy_report(preds, "run_id")


def unit_vectors(acts: DataFrame, probes: DataFrame, k: int = 5) -> DataFrame:
    """Unit, v: the mean of the normalised vectors (instance_id, z) of the unit's k strongest probes (instance_id, unit, a)."""
    top = cap_per_group(acts, ["unit"], k, F.desc(F.round("a", 9)), F.col("instance_id")).join(probes, "instance_id")
    return top.select("unit", F.posexplode(V.l2_normalize("z")).alias("d", "x")).groupBy("unit", "d").agg(F.avg("x").alias("x")).groupBy("unit").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("v"))


def label_units(acts: DataFrame, probes: DataFrame, concepts: DataFrame, k: int = 5) -> DataFrame:
    """Unit -> concept: the concept (concept, c) of the highest cosine with the unit's vector; any number of both, in blocks."""
    left = unit_vectors(acts, probes, k).select(F.col("unit").alias("id"), V.l2_normalize("v").alias("v"))
    best = best_partners(left, concepts.select(F.col("concept").alias("id"), V.l2_normalize("c").alias("v")))
    return best.select(F.col("id").alias("unit"), F.col("best").alias("concept"), F.col("score").alias("sim"))


def best_units(labelled: DataFrame) -> DataFrame:
    """Concept -> its best unit."""
    return labelled.groupBy("concept").agg(F.max_by("unit", F.struct("sim", -F.col("unit"))).alias("unit"), F.max("sim").alias("sim"))


def units_of_labels(labelled: DataFrame, vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """Label, unit, sim, direct for every label (label, t): its best unit among those labelled with it (unit, concept, sim), else the unit (unit, v) of the highest cosine with its text's vector."""
    own = labels.select("label").join(best_units(labelled).withColumnRenamed("concept", "label"), "label")
    missing = labels.join(own.select("label"), "label", "left_anti")
    near = best_partners(missing.select(F.col("label").alias("id"), V.l2_normalize("t").alias("v")), vectors.select(F.col("unit").alias("id"), V.l2_normalize("v").alias("v")))
    return own.select("label", "unit", "sim", F.lit(False).alias("direct")).unionByName(near.select(F.col("id").alias("label"), F.col("best").alias("unit"), F.col("score").alias("sim"), F.lit(True).alias("direct")))


def score_by_units(trials: DataFrame, acts: DataFrame, units: DataFrame) -> DataFrame:
    """Trials scored by the activation of the target category's unit on each image; trials without a unit are left out."""
    slots = trials.join(units.select(F.col("concept").alias("target_category"), "unit"), "target_category").select("trial_num", F.col("target_category").alias("class"), "unit", F.posexplode(F.concat(F.array("target_id"), "foil_ids")).alias("slot", "instance_id"))
    s = slots.join(acts, ["instance_id", "unit"]).groupBy("trial_num", "class").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "a"))), lambda x: x["a"]).alias("scores"))
    return s.withColumn("correct", V.argmax("scores") == 0)


def concept_set(sources: list[DataFrame], exclude: DataFrame, most: int = 50_000) -> DataFrame:
    """Concept, source: cleaned names of ordered sources (column name), excluded ones taken out, the first source wins.

    A source with a column token_id is a vocabulary: its first most words count, usable or not, and no other source is cut.
    """
    rows = None
    for i, s in enumerate(sources):
        s = s.orderBy("token_id").limit(most) if "token_id" in s.columns else s
        usable = s.where(X.is_reasonable_token("name")) if i else s  # names of the first source are taken as they are
        part = usable.select(X.clean_phrase("name").alias("concept"), F.lit(i).alias("source")).where("concept <> ''")
        rows = part if rows is None else rows.unionByName(part)
    kept = rows.join(exclude.select(X.clean_phrase("name").alias("concept")), "concept", "left_anti")
    return kept.groupBy("concept").agg(F.min("source").alias("source"))


def probe_set(trials: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """Distinct images of targets and foils, at most a drawn number."""
    ids = trials.select(F.explode(F.concat(F.array("target_id"), "foil_ids")).alias("instance_id")).distinct()
    return ids.orderBy(draw(seed, "instance_id"), "instance_id").limit(most)


def probe_boxes(trials: DataFrame, instances: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """instance_id, file_name, bbox of the boxes of targets and foils (instance_id, file_name, bbox), each file and box once (with the least id), at most a drawn number; instances without a file or a box are left out."""
    ids = trials.select(F.explode(F.concat(F.array("target_id"), "foil_ids")).alias("instance_id")).distinct()
    known = ids.join(instances.where("file_name is not null and bbox is not null").select("instance_id", "file_name", F.col("bbox").cast("array<double>").alias("bbox")), "instance_id")
    once = known.groupBy("file_name", "bbox").agg(F.min("instance_id").alias("instance_id"))
    return once.orderBy(draw(seed, "file_name", F.array_join(F.col("bbox").cast("array<string>"), ",")), "file_name", "bbox").limit(most).select("instance_id", "file_name", "bbox")


def filter_by_similarity(frames: DataFrame, categories: DataFrame) -> DataFrame:
    """Frames (obj_id, concept_id, z) whose nearest category (proto_id, p) is their own."""
    from .prototypes import hard_assign

    ids = categories.agg(F.sort_array(F.collect_list("proto_id")).alias("ids"))
    return hard_assign(frames, categories).crossJoin(F.broadcast(ids)).where(F.get("ids", F.col("proto")) == F.col("concept_id")).select("obj_id", "concept_id", "sim")
