"""Concepts within labels: the join on rare runs of characters equals a search of every label for every concept."""

import random

from groundspark.operators import concepts as C


def pairs(spark, labels, names):
    got = C.substrings(spark.createDataFrame([(x,) for x in labels], "label string"), spark.createDataFrame([(x,) for x in names], "concept string")).collect()
    out = [(r.label, r.concept) for r in got]
    assert len(out) == len(set(out))
    return set(out)


def test_hundred_thousand_concepts(spark):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcdeé ") for _ in range(n))
    labels = list({word(r.randint(0, 14)) for _ in range(300)})
    names = list({word(r.randint(3, 9)) for _ in range(160_000)})
    assert len(names) > 90_000
    assert pairs(spark, labels, names) == {(x, c) for x in labels for c in names if c in x}


def test_short_empty_and_absent(spark):
    labels, names = ["cat", "a", "", "\U0001f600x", "concat cat", None], ["cat", "a", "", "\U0001f600", "catx", "tc", "dog", None]
    assert pairs(spark, labels, names) == {(x, c) for x in labels for c in names if x is not None and c is not None and c in x}
    assert pairs(spark, [], names) == pairs(spark, labels, []) == set()
    assert pairs(spark, labels, [""]) == {(x, "") for x in labels if x is not None}
