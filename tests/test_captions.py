"""Caption metrics with several references against plain loops."""

import math
from collections import Counter

import pytest

from groundspark.operators import captions as P

CAPTIONS = [
    (1, "the cat sat on the mat".split(), ["the cat is on the mat".split(), "a cat sat on a mat there".split()]),
    (2, "the the the the".split(), ["the dog".split(), "the the end of it".split(), None]),
    (3, "a red ball".split(), []),
    (4, [], ["some words".split()]),
    (5, "one two three four five".split(), ["one two three four five".split()] * 5),
    (6, "big dog".split(), None),
]
SCHEMA = "key long, hyp array<string>, refs array<array<string>>"


def grams(w, n):
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def rows():
    return [(k, h, [r for r in refs or [] if r is not None]) for k, h, refs in CAPTIONS]


def test_bleu(spark):
    got = P.bleu(spark.createDataFrame(CAPTIONS, SCHEMA)).first()
    logs, h, r = [], 0, 0
    for n in range(1, 5):
        hit = total = 0
        for _, hyp, refs in rows():
            best = Counter()
            for ref in refs:
                best |= grams(ref, n)
            hit += sum((grams(hyp, n) & best).values())
            total += sum(grams(hyp, n).values())
        logs.append(math.log(max(hit, 1e-9) / total))
    for _, hyp, refs in rows():
        h += len(hyp)
        r += min((abs(len(x) - len(hyp)), len(x)) for x in refs)[1] if refs else 0
    penalty = math.exp(1 - r / h) if h < r else 1
    assert [got[f"bleu_{k}"] for k in range(1, 5)] == pytest.approx([math.exp(sum(logs[:k]) / k) * penalty for k in range(1, 5)])


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_rouge(spark):
    got = {x.key: x.rouge_l for x in P.rouge_l(spark.createDataFrame(CAPTIONS, SCHEMA)).collect()}
    for k, hyp, refs in rows():
        p = max((lcs(hyp, r) / len(hyp) for r in refs if hyp), default=0)
        q = max((lcs(hyp, r) / len(r) for r in refs if r), default=0)
        assert got[k] == pytest.approx(2.44 * p * q / (q + 1.44 * p) if p and q else 0)


@pytest.mark.parametrize("sigma", [None, 6.0])
def test_cider(spark, sigma):
    got = {x.key: x.cider for x in P.cider(spark.createDataFrame(CAPTIONS, SCHEMA), sigma=sigma).collect()}
    data = rows()
    assert got.keys() == {k for k, _, _ in data}
    for k, hyp, refs in data:
        total = 0.0
        for ref in refs:
            for n in range(1, 5):
                df = Counter(g for _, _, rs in data for g in {x for r in rs for x in grams(r, n)})
                weigh = lambda w: {g: c * math.log(len(data) / max(1, df[g])) for g, c in grams(w, n).items()}  # noqa: B023, E731
                a, b = weigh(hyp), weigh(ref)
                na, nb = (math.sqrt(sum(x * x for x in v.values())) for v in (a, b))
                ab = sum((min(a[g], b[g]) if sigma else a[g]) * b[g] for g in a if g in b)
                damp = math.exp(-((len(hyp) - len(ref)) ** 2) / (2 * sigma**2)) if sigma else 1
                total += damp * ab / (na * nb) if na and nb else 0
        assert got[k] == pytest.approx(10 * total / 4 / max(1, len(refs)))
