"""Whitening and centroid clustering against brute force, with the odd cases of their contracts."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundspark.llm import centroids, queries, topk, whitening
from tests.compare import database, same

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def clusters(rows, k=16, rounds=3, width=64):
    """(vec_id, cluster, distance, centroid) by plain loops."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [v for _, v in order[:k]]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, x, strict=True)) for x in c]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        by = {}
        for _, v in kept:
            by.setdefault(nearest(v)[0], []).append(v)
        c = [[sum(x) // len(by[i]) for x in zip(*by[i], strict=True)] if i in by else c[i] for i in range(len(c))]
    return [(i, *nearest(v), c[nearest(v)[0]]) for i, v in kept]


def table(spark, rows, more=""):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<float>{more}")


def vectors(n, seed, width=64, scale=0.3):
    r = np.random.default_rng(seed)
    return (r.standard_normal((n, width)) * scale).astype(np.float32)


def test_clusters_against_sql(spark):
    same(queries.QUERIES["op12_centroids"](spark, SF), database(SF), queries.ORACLE["op12_centroids"])


def test_clusters_against_loops(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(300, 5))]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[3][1]), (900, None), (901, [0.1] * 63), (902, [0.1] * 63 + [None]), (903, [NAN] * 64), (904, [INF] + [0.0] * 63), (905, []), (906, [0.0] * 65)]
    got = centroids.cluster(table(spark, rows).repartition(7)).collect()
    want = clusters(rows)
    plain = sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance, r.centroid) for r in got)
    assert plain == sorted((i is None, i or 0, c, d, x) for i, c, d, x in want)
    total = sum(d for _, _, d, _ in want)
    assert {r.inertia for r in got} == {total}
    for k in range(16):
        assert {r.cluster_inertia for r in got if r.cluster == k} <= {sum(d for _, c, d, _ in want if c == k)}


def test_clusters_of_few_equal_and_large(spark):
    few = [(i, [float(i)] * 64) for i in range(5)]
    assert sorted((r.vec_id, r.distance) for r in centroids.cluster(table(spark, few)).collect()) == [(i, 0) for i in range(5)]
    equal = [(i, [0.5] * 64) for i in range(40)]
    assert {(r.cluster, r.distance) for r in centroids.cluster(table(spark, equal)).collect()} == {(0, 0)}  # ties: smaller number
    large = [(i, (v * 1000).tolist()) for i, v in enumerate(vectors(60, 2))]
    got = {r.vec_id: (r.cluster, r.distance) for r in centroids.cluster(table(spark, large), k=4).collect()}
    assert got == {i: (c, d) for i, c, d, _ in clusters(large, 4)}
    with pytest.raises(ValueError):
        centroids.cluster(table(spark, [(1, [1e12] * 64)]))
    assert centroids.cluster(table(spark, [])).count() == 0
    assert centroids.digests(table(spark, [(1, None)])).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_clusters_of_other_widths_keys_and_columns(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(80, 9, 100))]
    named = table(spark, rows).select(F.concat(F.lit("k"), "vec_id").alias("planes"), F.col("embedding").alias("key"), F.lit(1).alias("cluster"), F.lit(2).alias("v"))
    got = centroids.cluster(named, 3, width=100, key="planes", column="key")
    assert got.columns[0] == "planes" and got.count() == 80
    plain = {r.vec_id: r.distance for r in centroids.cluster(table(spark, rows), 3, width=100).collect()}
    assert plain == {i: d for i, _, d, _ in clusters(rows, 3, width=100)}


@pytest.mark.parametrize("low,high", [(-3, 3), (-128, 127), (0, 0), (-1, 0), (5, 300)])
def test_packing(low, high):
    v = np.random.default_rng(3).integers(low, high + 1, (50, 70))
    p = centroids.pack(v, centroids.planes_of(low, high))
    assert (centroids.dots(p, p[:9]) == v @ v[:9].T).all()
    assert (centroids.squares(p) == (v**2).sum(1)).all()
    assert (centroids.unpacked_sums(p, 70) == v.sum(0)).all()


def whitened(rows, most=8):
    """Exact sums by fractions, then numpy."""
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(len(v) for _, v in kept)
    x = np.array([[math.floor(1024 * c) + 100000 for c in [*v, *[0.0] * (width - len(v))]] for _, v in kept], object)
    n, s = len(x), x.sum(0)
    off = n * x - s
    v = np.array([[float(Fraction(int((off[:, a] * off[:, b]).sum()), n**3)) for b in range(width)] for a in range(width)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    w = (off / n).astype(float) @ u / np.sqrt(e)
    return [i for i, _ in kept], n, (off**2).sum(1), w, e / v.trace()


def test_whitening_against_exact_sums(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(400, 11) * np.linspace(0.2, 2, 64, dtype=np.float32))]
    rows += [(3, rows[5][1]), (800, None), (801, [0.1] * 63 + [None]), (802, [NAN] * 64), (803, [-INF] + [0.0] * 63), (804, [-200.0] * 64), (805, [0.25] * 10)]
    ids, n, deviation, w, share = whitened(rows)
    got = whitening.whiten(table(spark, rows).repartition(5)).collect()
    assert len(got) == 8 * len(ids) and {r.n for r in got} == {n}
    assert {r.identity_error for r in got} <= {got[0].identity_error} and got[0].identity_error < 1e-9
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
        assert abs(r.explained / share[r.component - 1] - 1) < 1e-9 and r.deviation == r.deviation_exact
    for c, rs in by.items():
        want = sorted(zip(ids, deviation.tolist(), w[:, c - 1], strict=True), key=lambda t: t[:2])
        have = sorted(((r.vec_id, r.deviation, r.whitened) for r in rs), key=lambda t: t[:2])
        assert [t[:2] for t in have] == [t[:2] for t in want]
        a, b = np.array([t[2] for t in have]), np.array([t[2] for t in want])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9


def test_whitening_beyond_63_bits_and_without_variance(spark):
    wide = [(i, (v * 1e6).tolist()) for i, v in enumerate(vectors(120, 4, 12, 100.0))]
    ids, n, deviation, w, share = whitened(wide)
    got = whitening.whiten(table(spark, wide)).collect()
    assert {(r.vec_id, int(r.deviation_exact)) for r in got} == set(zip(ids, deviation.tolist(), strict=True))
    assert all(r.deviation is None or r.deviation == r.deviation_exact for r in got) and any(r.deviation is None for r in got)
    first = {r.vec_id: r.whitened for r in got if r.component == 1}
    assert np.allclose(np.abs([first[i] for i in ids]), np.abs(w[:, 0]), atol=1e-9)
    equal = whitening.whiten(table(spark, [(i, [0.5, 0.25, 0.0]) for i in range(4)])).collect()
    assert len(equal) == 12 and {(r.whitened, r.explained, r.identity_error, r.deviation) for r in equal} == {(None, None, None, 0)}
    line = whitening.whiten(table(spark, [(i, [i / 8, 0.25]) for i in range(4)])).collect()
    assert {r.component for r in line if r.whitened is None} == {2} and line[0].identity_error < 1e-9
    assert {r.component for r in whitening.whiten(table(spark, [(1, [0.5])])).collect()} == {1}


def test_whitening_of_nothing_and_clashing_names(spark):
    assert whitening.whiten(table(spark, [])).count() == whitening.whiten(table(spark, [(1, None), (2, [])])).count() == 0
    with pytest.raises(ValueError):
        whitening.whiten(table(spark, [(1, [1e30])]))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(30, 8, 6))]
    named = table(spark, rows).select(F.col("vec_id").cast("string").alias("x"), F.col("embedding").alias("key"), F.lit(1).alias("n"), F.lit(1).alias("component"))
    assert whitening.whiten(named, key="x", column="key").where("x = '3'").count() == 6


def test_cross_products_of_limbs():
    y = np.random.default_rng(2).integers(0, 2**20, (130, 5))
    into = np.zeros((2, 5, 5), np.int64)
    whitening.cross_counts(whitening.sliced(y, 20), into)
    assert (np.triu(y.T @ y) == into[0] + (into[1] << whitening.LIMB)).all()


def test_queries_of_vectors_at_any_partitioning(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    a, b = (centroids.digests(e.repartition(p)).orderBy("vec_id").collect() for p in (1, 9))
    assert a == b
    rows = [(r.vec_id, r.embedding) for r in e.collect()]
    ids, n, deviation, w, _ = whitened(rows)
    got = queries.QUERIES["op11_whitening"](spark, SF)
    first = {r.vec_id: r for r in got.where("component = 8").collect()}
    assert [first[i].deviation for i in ids] == deviation.tolist()
    assert np.allclose(np.abs([first[i].whitened for i in ids]), np.abs(w[:, 7]), atol=1e-9)


def best(v, k=10):
    """query -> [(score, id)] of every hundredth row by brute force; v: integers."""
    out = {}
    for q in range(0, len(v), 100):
        scores = v @ v[q]
        order = np.lexsort((np.arange(len(v)), -scores))
        out[q] = [(int(scores[i]), int(i)) for i in order[: k + 1] if i != q][:k]
    return out


@pytest.mark.parametrize("zero_root", [False, True])
def test_top_k_of_mixed_norms(spark, monkeypatch, zero_root):
    r = np.random.default_rng(7)
    n = 20_000 if zero_root else 10_000
    v = r.standard_normal((n, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if zero_root:
        v[spark.range(n).orderBy(F.xxhash64("id")).first().id] = 0  # the centre of the root
    else:
        v[r.random(n) < 0.85] *= 0.02
    v = v.astype(np.float32)
    levels = []
    grow = topk.grow
    monkeypatch.setattr(topk, "grow", lambda *a: (levels.append(grow(*a)) or levels[-1]))
    got = {}
    for x in topk.nearest_of_hundredths(table(spark, [(i, x.tolist()) for i, x in enumerate(v)]).repartition(4)).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.score, x.vec_id))
    assert got == best(np.floor(1024 * v.astype(float)).astype(np.int64))
    assert 1 < len(levels[0][1]) <= 6


def test_top_k_of_rows_that_nothing_splits(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 64)
    v = np.zeros((600, 4), np.float32)
    v[np.arange(600), np.arange(600) % 4 // 3] = np.where(np.arange(600) % 50 == 0, 1.0, 0.25)
    got = {}
    for x in topk.nearest_of_hundredths(table(spark, [(i, x.tolist()) for i, x in enumerate(v)])).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.score, x.vec_id))
    assert got == best(np.floor(1024 * v.astype(float)).astype(np.int64))
