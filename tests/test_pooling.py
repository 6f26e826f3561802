"""Packed pooling and context rings against loops, at odd sizes."""

import math

import numpy as np
import pytest

from groundspark.operators import pixels as Q


def area(m, h, w):
    big_h, big_w = m.shape
    return np.array([[m[y * big_h // h : math.ceil((y + 1) * big_h / h), x * big_w // w : math.ceil((x + 1) * big_w / w)].mean() for x in range(w)] for y in range(h)])


def linear(m, h, w):
    def at(i, size, to):
        s = max((i + 0.5) * size / to - 0.5, 0)
        a = min(int(s), size - 1)
        return a, min(a + 1, size - 1), s - a

    out = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            a, b, f = at(y, m.shape[0], h)
            c, d, g = at(x, m.shape[1], w)
            out[y, x] = (1 - f) * ((1 - g) * m[a, c] + g * m[a, d]) + f * ((1 - g) * m[b, c] + g * m[b, d])
    return out


def ring(m, r):
    h, w = m.shape
    return np.array([[max(m[v, u] for v in range(max(0, y - r), min(h, y + r + 1)) for u in range(max(0, x - r), min(w, x + r + 1))) - m[y, x] for x in range(w)] for y in range(h)])


@pytest.mark.parametrize("size,to,r", [((7, 11), (3, 5), 1), ((5, 5), (5, 5), 2), ((3, 4), (7, 9), 3), ((9, 3), (4, 6), 1), ((1, 1), (1, 1), 1), ((13, 8), (5, 3), 4)])
def test_pooling(spark, size, to, r):
    g = np.random.default_rng(sum(size))
    rows, want = [], {}
    for key in range(5):
        f, masks = g.standard_normal((2, *to)), g.random((key, *size)) * 1.4 - 0.2
        if key > 1:
            masks[0] = 0
        rows.append((key, f.ravel().tolist(), [m.ravel().tolist() for m in masks]))
        for k, m in enumerate(np.clip(masks, 0, 1)):
            s = m if size == to else area(m, *to) if size[0] >= to[0] and size[1] >= to[1] else linear(m, *to)
            mean = lambda x: (f * x).sum((1, 2)) / max(x.sum(), 1e-6)  # noqa: B023, E731
            want[key, k] = mean(s), mean(ring(s, r)), s.sum()
    rows += [(90, None, [[0.0] * (size[0] * size[1])]), (91, [0.0], []), (92, rows[0][1], [[0.5] * (size[0] * size[1] + 1)]), (93, rows[0][1], None)]
    df = spark.createDataFrame(rows, "key long, fmap array<double>, masks array<array<double>>")
    got = Q.pool_packed(df, (2, *to), size, r).collect()
    assert {(x.key, x.k) for x in got} == set(want) and len(got) == len(want)
    for x in got:
        p, c, mass = want[x.key, x.k]
        assert np.allclose(x.pooled, p, atol=1e-9) and np.allclose(x.context, c, atol=1e-9) and abs(x.mass - mass) < 1e-9
    assert {x.context for x in Q.pool_packed(df, (2, *to), size).collect()} == {None}


def test_rings(spark):
    g = np.random.default_rng(1)
    masks = {k: g.random((7, 4)) for k in range(6)}
    df = spark.createDataFrame([(k, m.ravel().tolist()) for k, m in masks.items()] + [(9, None), (10, [1.0])], "key long, mask array<double>")
    for r in (0, 1, 5):
        got = {x.key: x.ring for x in Q.context_ring(df, 7, 4, r).collect()}
        assert got.keys() == masks.keys() and all(np.allclose(got[k], ring(m, r).ravel() if r else 0) for k, m in masks.items())
