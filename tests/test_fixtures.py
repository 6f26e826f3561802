"""Hand-computed rows of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundspark.functions import text as X
from groundspark.functions import vectors as V
from groundspark.operators import bags as B
from groundspark.operators import captions as P
from groundspark.operators import concepts as K
from groundspark.operators import corpus as C
from groundspark.operators import evaluation as E
from groundspark.operators import masks as M
from groundspark.operators import metrics as D
from groundspark.operators import prototypes as G
from groundspark.operators.util import cap_per_group, global_index


def test_timestamps(spark):
    rows = {"1:05": 65, ":30": 30, "2": 120, "1:3": 90, "1:3 ": 63, "1.5-2.0": 110, "12;07": 727, "0.123": None, "-": None, "nan": None, "x:yz": None, None: None}
    df = spark.createDataFrame([(k,) for k in rows], "t string").select("t", X.parse_timestamp("t").alias("s"))
    assert {r.t: r.s for r in df.collect()} == rows


def test_transcript_rows(spark):
    rows = [("S_1.csv", 0, "0:05", "M", "Look at the ball. (laughs) Kitty!", "S_1.mp4"), ("S_1.csv", 1, "0:09", "child", "ba", "S_1.mp4")]
    df = spark.createDataFrame(rows, "transcript_filename string, row_idx long, time_raw string, speaker string, utterance string, video_name string")
    out = C.preprocess(df).orderBy("frame_filename").collect()
    assert [r.frame_filename for r in out] == [f"S_1_00{u}_{k:02d}.jpg" for u in (1, 2) for k in range(10)]
    assert {r.utterance for r in out} == {"look at the ball .", "kitty !"}
    assert np.allclose([r.timestamp for r in out], [5 + k / 5 for k in range(20)])
    text = spark.createDataFrame([("so (inaudible) there.",)], "u string").select(X.split_sentences(X.strip_annotations("u")).alias("s")).first().s
    assert text == ["so <unk> there ."]


def test_canonical_tokens(spark):
    words = {"feet": "foot", "kitties": "cat", "steps": "stairs", "stairs": "stair", "tables": "tabl", "bus": "bu", "is": "is"}
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", X.canonical(F.col("w")).alias("c"))
    assert {r.w: r.c for r in df.collect()} == words


def test_vocabularies(spark):
    df = spark.createDataFrame([("the " * 5 + "ball " * 3 + "a " * 3 + "zoo zoo",)], "t string")
    assert {r.token: r.token_id for r in C.build_vocab(df, X.tokenize_ws("t")).collect()} == {"the": 4, "a": 5, "ball": 6}
    df = spark.createDataFrame([("b " * 6 + "a " * 6 + "c " * 5,)], "t string")
    assert {r.token: r.token_id for r in C.build_caption_vocab(df, X.tokenize_ws("t")).collect()} == {"b": 4, "a": 5}


def test_inequality(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "n long")
    assert D.gini(df, "n").first().gini == pytest.approx(0.166667, abs=1e-6)
    assert D.effective_number(df, "n").first().effective == pytest.approx(2.666667, abs=1e-6)


def test_misalignment(spark):
    u = spark.createDataFrame([(0, "c_001", 5, "ball")], "utt long, clip string, frame_idx long, concept string")
    seen = spark.createDataFrame([("c_001", 7, "ball")], "clip string, frame_idx long, label string")
    other = spark.createDataFrame([("c_002", 7, "ball")], "clip string, frame_idx long, label string")
    get = lambda labels, w: tuple(K.visibility(u, labels, w).select("paired", "near").first())
    assert get(seen, 10) == (0, 1) and get(seen, 1) == (0, 0) and get(other, 10) == (0, 0)


def test_registry(spark):
    local = spark.createDataFrame([(0, "ball"), (1, "cat"), (2, "rare")], "local_id int, concept string")
    counts = spark.createDataFrame([("ball", 100), ("cat", 10), ("rare", 1)], "concept string, n long")
    ids = spark.createDataFrame([("ball", 0), ("cat", 1), ("rare", 2)], "concept string, global_id int")
    r = {x.concept: x for x in M.concept_registry(local, counts, ids).collect()}
    assert [r[c].global_id for c in ("ball", "cat", "rare")] == [0, 1, -1]
    assert [round(r[c].weight, 4) for c in ("ball", "cat", "rare")] == [0.6667, 1.3333, 1.0]
    assert r["rare"].drop_reason == "freq<5 (count=1)"


def test_tracks(spark):
    rows = [(1, 0, 0, [1.0, 0.0], True), (1, 0, 1, [0.0, 1.0], True), (1, 1, 0, [0.8, 0.6], True), (1, 2, 0, [1.0, 1.0], False)]
    t = sorted(B.build_tracks(spark.createDataFrame(rows, "sample_id long, m int, k int, z array<double>, valid boolean")).collect(), key=lambda r: r.r)
    assert [x.n_obs for x in t] == [2, 1]
    assert np.allclose(t[0].z, [0.948683, 0.316228], atol=1e-6) and np.allclose(t[1].z, [0, 1])


def test_forced_choice(spark):
    preds = spark.createDataFrame([("ball", True), ("ball", False), ("cat", True), ("cat", True)], "class string, correct boolean")
    total = [r for r in D.accuracy_report(preds).collect() if r["class"] is None][0]
    assert total.accuracy == 0.75 and total.macro == 0.75
    assert E.score_trials(spark.createDataFrame([([0.5, 0.5, 0.5],)], "scores array<double>")).first().correct


def test_trials_do_not_depend_on_partitions(spark):
    pools = spark.createDataFrame([(f"l{i % 5}", i // 5, i) for i in range(15)], "label string, place int, instance_id long")
    a = sorted(map(str, E.make_trials(pools.repartition(1), 3, 5).collect()))
    b = sorted(map(str, E.make_trials(pools.repartition(7), 3, 5).collect()))
    assert a == b and len(a) == 75
    for r in E.make_trials(pools, 3, 5).collect():
        assert len(set(r.foil_categories)) == 3 and r.target_category not in r.foil_categories
        assert all(f"l{i % 5}" == c for i, c in zip(r.foil_ids, r.foil_categories, strict=True))


def test_splits(spark):
    df = spark.range(101).withColumnRenamed("id", "k")
    assert {r.split: r["count"] for r in C.split_dataset(df, "k").groupBy("split").count().collect()} == {"train": 90, "val": 5, "test": 6}


def test_sinkhorn(spark):
    r = np.random.default_rng(0)
    objs = spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(40)], "obj_id long, z array<double>")
    protos = spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(4)], "proto_id int, p array<double>")
    q = np.array([x.q for x in G.sinkhorn(objs, protos, 40, 0.5).collect()])
    assert np.allclose(q.sum(1), 1) and np.allclose(q.sum(0), 10, atol=0.05)


def test_kmeans_finds_clusters(spark):
    r = np.random.default_rng(1)
    rows = [(i, (np.eye(3)[i % 3] + r.normal(size=3) * 0.05).tolist()) for i in range(60)]
    c = np.array([x.p for x in G.kmeans_cosine(spark.createDataFrame(rows, "obj_id long, z array<double>"), 3, 4).collect()])
    assert np.allclose(np.sort(c.max(1)), 1, atol=0.02) and set(c.argmax(1)) == {0, 1, 2}


def test_vector_functions(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<double>")
    r = df.select(V.logsumexp("x").alias("l"), V.softmax("x").alias("s"), V.l2_normalize("x").alias("u"), V.argmax("x").alias("a")).first()
    assert r.l == pytest.approx(math.log(sum(map(math.exp, (1, 2, 3))))) and sum(r.s) == pytest.approx(1) and np.linalg.norm(r.u) == pytest.approx(1) and r.a == 2


def test_global_index_and_caps(spark):
    df = spark.range(1000).withColumn("d", F.md5(F.col("id").cast("string").cast("binary")))
    idx = [r.idx for r in global_index(df, F.col("d"), partitions=7).orderBy("d").collect()]
    assert idx == list(range(1000))
    capped = cap_per_group(df.withColumn("g", F.col("id") % 3), ["g"], 5, F.col("id")).collect()
    assert sorted(r.id for r in capped) == list(range(15))


def test_rouge_of_equal_captions(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], ["a", "b", "c"]), (2, ["a", "x", "b"], ["a", "b"]), (3, [], ["a"])], "key long, hyp array<string>, ref array<string>")
    r = {x.key: x.rouge_l for x in P.rouge_l(df).collect()}
    p, q = 2 / 3, 1.0
    assert r[1] == pytest.approx(1) and r[2] == pytest.approx(2.44 * p * q / (q + 1.44 * p)) and r[3] == 0


def test_label_mapping(spark):
    raw = spark.createDataFrame([("laptop",), ("Wine Glass",), ("keyboard",), ("red balls",), ("zzz",), ("donut",), ("cat",)], "raw_label string")
    vocab = spark.createDataFrame([("computer",), ("glass",), ("keyboards",), ("ball",), ("cake",), ("kitty",)], "token string")
    r = {x.raw_label: (x.mapped, x.reason) for x in E.map_labels(raw, vocab, {"cat": "kitty"}).collect()}
    assert r == {"laptop": ("computer", "candidate"), "Wine Glass": ("glass", "candidate"), "keyboard": (None, "blocked_default"), "red balls": ("ball", "head_variant"), "zzz": (None, "no_match"), "donut": ("cake", "candidate"), "cat": ("kitty", "override")}


def test_no_cartesian_product_in_the_misalignment_plan(spark):
    from groundspark.plans import registry

    plan = registry.QUERIES["f10_temporal_misalignment"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
