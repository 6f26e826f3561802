"""Branches, units for labels, concept sets, probes and blocked nearest partners against plain loops."""

import math

import numpy as np
from pyspark.sql import functions as F

from groundspark.operators import blocks
from groundspark.operators import evaluation as E
from groundspark.operators import prototypes as G

TRIALS = [(0, "cat", ["dog", "cup"]), (1, "dog", ["cat", "zzz"]), (2, "zzz", ["cat", "dog"]), (3, "cup", []), (4, "yyy", ["zzz", "zzz"])]
VOCAB = {"cat", "dog", "cup"}


def test_branches(spark):
    t = spark.createDataFrame(TRIALS, "trial_num long, target_category string, foil_categories array<string>")
    v = spark.createDataFrame([(x,) for x in VOCAB] + [("cat",), (None,)], "token string")
    for mode in ("hybrid", "units", "encoder"):
        for kind in ("image", "text"):
            got = {r.trial_num: (r.branch, r.target_in_vocab) for r in E.branches(t, v, mode, kind).collect()}
            for n, target, foils in TRIALS:
                sound = {"encoder": True, "units": False, "hybrid": target in VOCAB if kind == "image" else {target, *foils} <= VOCAB}[mode]
                assert got[n] == ("encoder" if sound else "units", target in VOCAB)
    assert {r.branch for r in E.branches(t, None).collect()} == {"units"} and {r.branch for r in E.branches(t, None, "encoder").collect()} == {"encoder"}


def test_branch_report(spark):
    rows = [("cat", True, "encoder", True), ("cat", False, "units", True), ("dog", True, "units", False)]
    got = {r["class"]: r for r in E.branch_report(spark.createDataFrame(rows, "class string, correct boolean, branch string, target_in_vocab boolean")).collect()}
    assert got["cat"].all_accuracy == 0.5 and got["cat"].encoder_branch_accuracy == 1 and got["cat"].oov_target_accuracy is None and got["dog"].in_vocab_target_total == 0
    assert got[None].all_total == 3 and got[None].units_branch_correct == 1 and got[None].units_branch_accuracy == 0.5


def unit(v):
    return v / (np.linalg.norm(v) + 1e-8)


def test_blocked_partners_and_units_of_labels(spark):
    g = np.random.default_rng(5)
    left, right = {f"l{i:02}": unit(g.standard_normal(5)) for i in range(37)}, {i: unit(g.standard_normal(5)) for i in range(53)}
    right[7] = right[3]  # ties
    left["l00"] = right[3]
    frame = lambda d, kind: spark.createDataFrame([(k, v.tolist()) for k, v in d.items()] + [(None, [1.0] * 5)], f"id {kind}, v array<double>")
    want = {}
    for k, v in left.items():
        s = {i: round(float(v @ w), 9) for i, w in right.items()}
        want[k] = min(s, key=lambda i: (-s[i], i))  # noqa: B023
    for rows in (4, 4096):
        got = {r.id: (r.best, r.score) for r in blocks.best_partners(frame(left, "string"), frame(right, "long"), rows).collect()}
        assert {k: b for k, (b, _) in got.items()} == want and abs(got["l05"][1] - left["l05"] @ right[want["l05"]]) < 1e-8
    labelled = spark.createDataFrame([(1, "a", 0.4), (2, "a", 0.9), (3, "b", 0.2), (4, "x", 0.5)], "unit int, concept string, sim double")
    vectors = spark.createDataFrame([(i, right[i].tolist()) for i in range(5)], "unit int, v array<double>")
    labels = spark.createDataFrame([("a", right[0].tolist()), ("b", right[1].tolist()), ("c", right[4].tolist()), ("d", (right[2] + 0.01).tolist())], "label string, t array<double>")
    got = {r.label: (r.unit, r.direct) for r in E.units_of_labels(labelled, vectors, labels).collect()}
    assert got == {"a": (2, False), "b": (3, False), "c": (4, True), "d": (2, True)}


def test_more_concepts_than_one_array(spark):
    acts = spark.createDataFrame([(i, u, float(i * u % 7)) for i in range(20) for u in range(1, 4)], "instance_id long, unit int, a double")
    probes = spark.range(20).select(F.col("id").alias("instance_id"), F.array(F.sin("id"), F.cos("id")).alias("z"))
    concepts = spark.range(5000).select(F.format_string("c%04d", "id").alias("concept"), F.array(F.sin(F.col("id") / 100), F.cos(F.col("id") / 100)).alias("c"))
    got = {r.unit: r.concept for r in E.label_units(acts, probes, concepts).collect()}
    vectors = {r.unit: np.array(r.v) for r in E.unit_vectors(acts, probes).collect()}
    for u, v in vectors.items():
        s = [round(float(unit(v) @ unit(np.array([math.sin(i / 100), math.cos(i / 100)]))), 9) for i in range(5000)]
        assert got[u] == f"c{s.index(max(s)):04}"


def test_only_the_vocabulary_is_cut(spark):
    names = lambda *xs: spark.createDataFrame([(x,) for x in xs], "name string")
    vocab = spark.createDataFrame([("late word", 9), ("the", 0), ("first", 1), ("second", 2), ("cat", 3)], "name string, token_id long")
    common = names(*[f"common {i}" for i in range(30)], "second", "cat")
    got = {r.concept: r.source for r in E.concept_set([names("Dog", "cat"), vocab, common], names("common_3"), 3).collect()}
    assert got == {"dog": 0, "cat": 0, "first": 1, "second": 1} | {f"common {i}": 2 for i in range(30) if i != 3}


def test_probes_by_file_and_box(spark):
    trials = spark.createDataFrame([(1, [2, 3]), (4, [5, 6, 9])], "target_id long, foil_ids array<long>")
    rows = [(1, "a", [1.0, 2.0]), (2, "a", [1.0, 2.0]), (3, "a", [1.0, 3.0]), (4, "b", [1.0, 2.0]), (5, None, [1.0]), (6, "c", None), (7, "d", [1.0])]
    inst = spark.createDataFrame(rows, "instance_id long, file_name string, bbox array<double>")
    assert {r.instance_id for r in E.probe_boxes(trials, inst, 10).collect()} == {1, 3, 4}
    assert E.probe_boxes(trials, inst, 2).count() == 2


def test_usage_summary(spark):
    u = [0.5, 0.25, 0.25, 0.0]
    df = spark.createDataFrame([(i, x, r) for (i, x), r in zip(enumerate(u), (1, 2, 3, 4), strict=True)], "proto_id int, usage double, rank int")
    r = G.usage_summary(df).first()
    x = np.sort(u)
    assert r.k == 4 and abs(r.effective_k - math.exp(-sum(p * math.log(p) for p in u if p))) < 1e-6
    assert abs(r.gini - (2 * sum((i + 1) * v for i, v in enumerate(x)) / (4 * sum(u)) - 5 / 4)) < 1e-12
    assert G.usage_summary(df.withColumn("usage", F.lit(0.0))).first().gini == 0


def test_foils_from_more_labels_than_one_array(spark):
    pools = spark.range(5000).select(F.format_string("l%04d", "id").alias("label"), F.lit(0).alias("place"), F.col("id").alias("instance_id"))
    got = E.make_trials(pools, 21, 1, 3).collect()
    assert len(got) == 5000 and [r.trial_num for r in sorted(got, key=lambda r: r.trial_num)] == list(range(5000))
    for r in got:
        assert len({r.target_category, *r.foil_categories}) == 22 and [f"l{i:04}" for i in r.foil_ids] == r.foil_categories
    assert len({c for r in got for c in r.foil_categories}) == 5000  # all labels are drawn
    few = spark.range(4).select(F.format_string("l%d", "id").alias("label"), F.lit(0).alias("place"), F.col("id").alias("instance_id"))
    assert all(len(set(r.foil_categories)) == 3 and r.target_category not in r.foil_categories for r in E.make_fixed_trials(few, 50, 3, 1).collect())


def test_masks_with_more_concepts_than_one_array(spark, monkeypatch):
    from groundspark.operators import masks as M

    g = np.random.default_rng(3)
    m = spark.createDataFrame([(i, g.standard_normal(4).tolist()) for i in range(50)], "mask int, z array<double>")
    c = spark.createDataFrame([(f"c{i % 30}_{i}", i % 7 == 0, (g.standard_normal(4) if i % 2 else np.ones(4)).tolist()) for i in range(60)], "concept string, priority boolean, c array<double>")
    few = {r.mask: (r.label, round(r.clip_sim, 9)) for r in M.assign_labels(m, c, 0.5).collect()}
    monkeypatch.setattr(M, "MOST", 10)
    assert {r.mask: (r.label, round(r.clip_sim, 9)) for r in M.assign_labels(m, c, 0.5).collect()} == few and len(few) == 50
