"""Blocked scores of texts against bags: numpy over all pairs, at block sizes that split everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundspark.operators import blocks


def lse(x, axis):
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def brute(texts, bags, tau):
    """side, id -> own, lse, best, entropy."""
    i, j = sorted(texts), sorted(bags)
    score = np.array([[tau * lse(np.array(bags[b]) @ texts[t] / tau, 0) for b in j] for t in i])
    out = {}
    for side, ids, others, s in (("text", i, j, score), ("bag", j, i, score.T)):
        norm = lse(s, 1)
        p = np.exp(s - norm[:, None])
        best = np.round(s, 9).argmax(1)
        for k, me in enumerate(ids):
            out[side, me] = (s[k][others.index(me)] if me in others else None, norm[k], others[best[k]], norm[k] - (p[k] * s[k]).sum())
    return out


def frames(spark, texts, bags):
    t = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in texts.items()], "sample_id long, t array<double>, g int")
    c = spark.createDataFrame([(b, r, v.tolist(), b % 2) for b, vs in bags.items() for r, v in enumerate(vs)], "sample_id long, r int, z array<double>, g int")
    return t, c


def data():
    r = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v)
    texts = {i: unit(r.standard_normal(6)) for i in range(23)}
    bags = {b: [unit(r.standard_normal(6)) for _ in range(1 + b * b % 11)] for b in range(3, 30)}
    bags[5] = [unit(r.standard_normal(6)) for _ in range(40)]  # far larger than a small block
    bags[7], texts[8] = list(bags[6]), texts[9].copy()  # ties
    return texts, bags


def close(got, want):
    assert {(r.side, r.id) for r in got} == set(want)
    for r in got:
        own, norm, best, entropy = want[r.side, r.id]
        assert (own is None) == (r.own is None) and (own is None or abs(own - r.own) < 1e-9)
        assert abs(norm - r.lse) < 1e-9 and best == r.best and abs(entropy - r.entropy) < 1e-8


@pytest.mark.parametrize("rows", [1, 4, 4096])
def test_all_pairs(spark, rows):
    texts, bags = data()
    t, c = frames(spark, texts, bags)
    close(blocks.bag_scores(t, c, 0.05, rows=rows).collect(), brute(texts, bags, 0.05))


def test_slices_of_a_task(spark, monkeypatch):
    texts, bags = data()
    t, c = frames(spark, texts, bags)
    monkeypatch.setattr(blocks, "CELLS", 500)
    close(blocks.bag_scores(t, c, 0.2, rows=64).collect(), brute(texts, bags, 0.2))


def test_blocks_are_bounded(spark):
    units = spark.range(500).select((F.col("id") % 3).alias("batch"), "id", F.lit(0).alias("piece"), (F.col("id") % 4 + 1).alias("n"))
    sizes = blocks._blocks(units, 10).join(units.select("id", "n"), "id").groupBy("batch", "block").agg(F.sum("n").alias("n")).collect()
    assert max(r.n for r in sizes) <= 13 and len(sizes) >= 125


def test_batches_and_rows_that_take_no_part(spark):
    texts, bags = data()
    t, c = frames(spark, texts, bags)
    t = t.unionByName(spark.createDataFrame([(None, [1.0] * 6, 0), (90, None, 0)], t.schema))
    c = c.unionByName(spark.createDataFrame([(None, 0, [1.0] * 6, 1), (91, 0, None, 1)], c.schema))
    got = blocks.bag_scores(t, c, 0.05, F.col("g"), 4).collect()
    for g in (0, 1):
        close([r for r in got if r.batch == g], brute({k: v for k, v in texts.items() if k % 2 == g}, {k: v for k, v in bags.items() if k % 2 == g}, 0.05))
    assert blocks.contrastive_summary(blocks.bag_scores(t.limit(0), c)).count() == 0


def test_summaries(spark):
    texts, bags = data()
    t, c = frames(spark, texts, bags)
    s = blocks.bag_scores(t, c, 0.05, rows=16)
    want = brute(texts, bags, 0.05)
    both = [i for i in texts if i in bags]
    got = blocks.contrastive_summary(s).first()
    assert got.n == len(both)
    assert abs(got.loss - np.mean([(want["text", i][1] + want["bag", i][1]) / 2 - want["text", i][0] for i in both])) < 1e-9
    assert abs(got.row_accuracy - np.mean([want["text", i][2] == i for i in both])) < 1e-9
    w = spark.createDataFrame([(i, float(i)) for i in texts], "id long, w double")
    by = {r.side: r for r in blocks.weighted_summary(s, w).collect()}
    assert abs(by["bag"].loss - sum(i * (want["bag", i][1] - want["bag", i][0]) for i in both) / sum(both)) < 1e-9
    assert abs(by["text"].accuracy - sum(i * (want["text", i][2] == i) for i in both) / sum(both)) < 1e-9
