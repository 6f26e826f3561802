"""Queries without an SQL twin against plain loops over the whole table, and small tables of hot groups and odd columns."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from groundspark.functions import text as X
from groundspark.operators import bags, corpus, evaluation, labels, masks, metrics, prototypes, util
from groundspark.plans import registry
from groundspark.sources import files
from tests.compare import database

SF = "/root/testdata/sf0.001"


def unit(v):
    n = math.sqrt(sum(x * x for x in v)) + 1e-8
    return [x / n for x in v]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def cosine(a, b):
    return dot(unit(a), unit(b))


@pytest.fixture(scope="module")
def vectors():
    rows = database(SF).execute("select vec_id, label, list_transform(embedding, lambda x: x::double) from embeddings order by 1").fetchall()
    return {i: (label, v) for i, label, v in rows}


@pytest.fixture(scope="module")
def bag(vectors):
    """sample -> frame -> [(k, vector)] of valid candidates."""
    out = defaultdict(lambda: defaultdict(list))
    for i, (_, v) in vectors.items():
        if i % 7 != 3:
            out[i // 20][i % 20 // 4].append((i % 4, v))
    return out


def greedy_tracks(frames, thr=0.2, most=16):
    tracks = []
    for m in sorted(frames):
        cands = [unit(v) for _, v in sorted(frames[m])]
        best = [max(((dot(t, z), -j) for j, (t, _) in enumerate(tracks)), default=(-2.0, 1)) for z in cands]
        before, used, new = len(tracks), set(), []
        for i in sorted(range(len(cands)), key=lambda i: (-best[i][0], i)):
            s, j = best[i][0], -best[i][1]
            if before and s >= thr and j not in used:
                used.add(j)
                t, n = tracks[j]
                tracks[j] = (unit([(x * n + y) / (n + 1) for x, y in zip(t, cands[i], strict=True)]), n + 1)
            else:
                new.append((cands[i], 1))
        tracks = sorted(tracks + new, key=lambda t: -t[1])[:most]
    return tracks


def test_tracks(spark, bag):
    got = defaultdict(dict)
    for r in registry.QUERIES["g9_tracks"](spark, SF).collect():
        got[r.sample_id][r.r] = (r.n_obs, list(r.z))
    want = {s: greedy_tracks(f) for s, f in bag.items()}
    assert got.keys() == want.keys()
    for s, tracks in want.items():
        assert [got[s][r][0] for r in range(len(got[s]))] == [n for _, n in tracks]
        for r, (t, _) in enumerate(tracks):
            assert got[s][r][1] == pytest.approx(t[:4], abs=2e-6)


def test_track_frames(spark, bag):
    got = {(r.sample_id, r.r): list(r.frames) for r in registry.QUERIES["g24_track_frames"](spark, SF).collect()}
    want = {}
    for s, frames in bag.items():
        for r, (t, _) in enumerate(greedy_tracks(frames)):
            best = sorted((-round(max(cosine(t, v) for _, v in cs), 9), m) for m, cs in frames.items())[:4]
            want[s, r] = sorted(m for _, m in best) + [best[0][1]] * (4 - len(best))
    assert got == want


def softmax(xs, tau):
    e = [math.exp((x - max(xs)) / tau) for x in xs]
    return [x / sum(e) for x in e]


def test_track_coherence(spark, bag, vectors):
    protos = [vectors[i][1] for i in range(8)]
    q = lambda v: softmax([cosine(v, p) for p in protos], 0.07)
    up = down = pairs = 0.0
    for s, frames in bag.items():
        means = []
        for t, _ in greedy_tracks(frames):
            kls = []
            for cs in frames.values():
                near = [(round(cosine(t, v), 9), -k, v) for k, v in cs]
                s_, _, v = max(near)
                if s_ >= 0.30:
                    kls.append(sum(a * (math.log(max(a, 1e-8)) - math.log(max(b, 1e-8))) for a, b in zip(q(t), q(v), strict=True)))
            if len(kls) >= 2:
                means.append(sum(kls) / len(kls))
                pairs += len(kls)
        if means:
            w = s % 3 + 1
            up, down = up + w * sum(means) / len(means), down + w
    row = registry.QUERIES["g16_track_coherence"](spark, SF).first()
    assert row.pairs == pairs and row.coherence == pytest.approx(up / down if down else None, abs=2e-6)


def test_diverse_selection(spark, vectors):
    protos = [vectors[i][1] for i in range(8)]
    soft = {i: softmax([cosine(v, p) for p in protos], 0.07) for i, (_, v) in vectors.items()}
    usage = sorted((-round(sum(q[k] for q in soft.values()) / len(soft), 9), k) for k in range(8))[:8]
    got = {(r.proto_id, r.place): r.obj_id for r in registry.QUERIES["g23_diverse_selection"](spark, SF).collect()}
    want = {}
    for _, k in usage:
        top = sorted(((-round(q[k], 9), i) for i, q in soft.items()))[:12]
        pool, taken = [(-s, i) for s, i in top], []
        for cap in (0.92, 0.95, 1.0 + 1e-9):
            while len(taken) < 4:
                near = {i: max((cosine(vectors[i][1], vectors[j][1]) for j in taken), default=0.0) for _, i in pool}
                free = [(round(soft[i][k] - 0.35 * near[i], 9), -n, i) for n, (_, i) in enumerate(pool) if i not in taken and not (taken and near[i] > cap)]
                if not free:
                    break
                taken.append(max(free)[2])
        want |= {(k, n + 1): i for n, i in enumerate(taken)}
    assert got == want


# ---- hot groups, ties and odd columns on small tables ------------------------------------------


def test_caps_are_cut_before_the_shuffle(spark):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("label")).repartition(5)
    capped = util.cap_per_group(df, ["label"], 20, F.desc("id"), name="place")
    plan = capped._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert sorted(r.id for r in capped.where("label = 'hot'").collect()) == list(range(2940, 3000, 3))


def test_low_caps_of_masks_pools_and_vocabulary(spark):
    det = spark.createDataFrame([(1, i, i, "x", 0.3 + i / 100, 0.95, 5000, 100.0, 100.0) for i in range(9)], "frame long, line long, det_id long, label string, dino_score double, sam_score double, mask_area long, w double, h double")
    assert sorted(r.line for r in masks.filter_detections(det, ["frame"], 250_000, top=4).collect()) == [5, 6, 7, 8]
    pool = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)], "instance_id long, label string")
    got = [(r.label, r.place) for r in evaluation.build_pools(pool, 7, 1).collect()]
    assert sorted(got) == [(c, p) for c in "ab" for p in range(7)]
    texts = spark.createDataFrame([("b a a c b a",)], "text string")
    vocab = corpus.build_event_vocab(texts, X.tokenize_basic("text"), max_size=6).collect()
    assert {r.token for r in vocab} == {"a", "b"}


def test_split_of_a_hot_category(spark):
    rows = [(i, "hot" if i % 2 else None if i % 4 == 0 else f"c{i % 8}") for i in range(400)] + [(5, "hot")]
    df = spark.createDataFrame(rows, "id long, category string").repartition(4)
    out = corpus.split_per_category(df, "category", "id", fraction=0.3).collect()
    n, dev = defaultdict(int), defaultdict(int)
    for r in out:
        n[r.category] += 1
        dev[r.category] += r.split == "dev"
    assert len(out) == len(rows) and all(dev[c] == math.floor(n[c] * 0.3) for c in n)


def test_gini_and_lorenz_with_ties(spark):
    values = [3, 1, 1, 7, 3, 3, 0, 12]
    df = spark.createDataFrame([(v,) for v in values], "n long")
    x, s = sorted(values), sum(values)
    want = 2 * sum((i + 1) * v for i, v in enumerate(x)) / (len(x) * s) - (len(x) + 1) / len(x)
    assert metrics.gini(df, "n").first().gini == pytest.approx(want)
    points = sorted((r.x, r.y) for r in metrics.lorenz(df, "n").collect())
    assert points == [(pytest.approx(i / 8), pytest.approx(sum(x[:i]) / s)) for i in range(9)]


def test_score_columns_are_guessed_in_order(spark):
    frame = lambda rows, schema: {(r.category, r.score) for r in files.load_scores(spark.createDataFrame(rows, schema)).collect()}
    assert frame([("a", "b", 0.5, 2.0)], "class string, Category string, value double, ACC double") == {("b", 2.0)}
    assert frame([("x", 0.25), ("y", None)], "Cat string, Percent double") == {("x", 25.0)}
    assert frame([("x", "3.5"), ("y", "none")], "label string, score string") == {("x", 3.5)}
    assert frame([("x", 60)], "who string, hits int") == {("x", 60.0)}
    with pytest.raises(ValueError):
        frame([("x", 1, 2)], "who string, a int, b int")


def test_stop_words_differ_by_data_set(spark):
    df = spark.createDataFrame([("old",), ("parking",), ("object",), ("stuff",), ("tv",), ("ball",)], "w string")
    good = lambda stop: [r.w for r in df.where(X.is_good_label("w", stop)).collect()]
    assert good(X.COCO_STOP) == ["object", "tv", "ball"]
    assert good(X.BAD_LABELS) == ["old", "parking", "object", "tv", "ball"]
    assert good(X.NAME_STOP) == ["parking", "tv", "ball"]
    assert good(X.CLASS_STOP) == ["old", "parking", "object", "stuff", "tv", "ball"]


def test_label_cascades_with_their_own_tables(spark):
    vocab = spark.createDataFrame([(w,) for w in ("car", "phone", "kitty", "tree", "pot", "computer", "plane")], "token string")
    raw = spark.createDataFrame([(w,) for w in ("automobile", "Telephone", "maple_tree", "streetcar", "sweet pepper", "cat", "potted plant", "laptop computer", "notebook")], "raw_label string")
    got = {r.raw_label: r.mapped for r in labels.map_classes(raw, vocab).collect()}
    assert got == {"automobile": "car", "Telephone": "phone", "maple_tree": "tree", "streetcar": "car", "sweet pepper": None, "cat": None, "potted plant": None, "laptop computer": "computer", "notebook": None}
    got = {r.raw_label: (r.mapped, r.reason) for r in labels.map_categories(raw, vocab).collect()}
    assert got["cat"] == ("kitty", "synonym_or_variant") and got["potted plant"] == ("pot", "synonym_or_variant") and got["notebook"] == ("computer", "synonym_or_variant") and got["streetcar"] == (None, "vocab_no_match")
    names = spark.createDataFrame([("n1", ["tabby", "cat"]), ("n2", ["airliner"]), ("n3", ["wing, airplane"]), ("n4", [])], "id string, names array<string>")
    assert {r.id: r.mapped for r in labels.map_names(names, vocab, "id").collect()} == {"n1": "kitty", "n2": None, "n3": "plane", "n4": None}


def test_forced_choice_without_candidates(spark):
    trials = spark.createDataFrame([(0, "a", 1, ["b"], [2])], "trial_num long, target_category string, target_id long, foil_categories array<string>, foil_ids array<long>")
    frames = spark.createDataFrame([(1, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.6, 0.8])], "instance_id long, z array<double>")
    queries = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "label string, t array<double>")
    objects = spark.createDataFrame([(2, [1.0, 0.0], False), (1, [1.0, 0.0], True)], "instance_id long, z array<double>, is_null boolean")
    one = evaluation.forced_choice_predictions(trials, frames, queries, objects).first()
    assert one.s_global == pytest.approx([1, 0.6], abs=1e-6) and one.s_object[0] == evaluation.LOWEST and (one.pred_global, one.pred_object, one.pred_combined) == (0, 1, 1)
    bare = evaluation.forced_choice_predictions(trials, frames, queries, kind="text").first()
    assert bare.s_global == pytest.approx([1, 1], abs=1e-6) and bare.s_object is None and bare.pred_object is None and bare.pred_combined == 0


def test_similarities_of_odd_vectors(spark):
    objs = spark.createDataFrame([(1, [3.0, 4.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0])], "obj_id long, z array<double>")
    protos = spark.createDataFrame([(1, [0.0, 2.0]), (0, [5.0, 0.0])], "proto_id int, p array<double>")
    got = {r.obj_id: r.sims for r in prototypes.similarities(objs, protos).collect()}
    assert got[1] == pytest.approx([0.6, 0.8], abs=1e-6) and got[2] is None and got[3] is None and got[4] == [0.0, 0.0]
    assert prototypes.similarities(objs.limit(0), protos).count() == 0
    assert {tuple(r.sims or ()) for r in prototypes.similarities(objs, protos.limit(0)).collect()} == {()}


def test_new_labels_are_numbered_behind_the_old(spark):
    old = spark.createDataFrame([(7, "b")], "concept_id int, concept string")
    got = {r.concept: r.concept_id for r in masks.concept_vocab(spark.createDataFrame([("d",), ("a",), ("b",), ("a",)], "concept string"), old).collect()}
    assert got == {"b": 7, "a": 8, "d": 9}


def test_null_candidates_close_every_bag(spark):
    tracks = spark.createDataFrame([(1, 0, [1.0], 2)], "sample_id long, r int, z array<double>, n_obs int")
    samples = spark.createDataFrame([(1,), (2,)], "sample_id long")
    assert {(r.sample_id, r.r, r.is_null) for r in bags.with_null(tracks, samples, [0.0]).collect()} == {(1, 0, False), (1, 1, True), (2, 0, True)}
