"""Mixing against targets by fractions, multipliers by bisection and the bounds of the rounding."""

import math
import re
from fractions import Fraction

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundspark.llm import mixing, queries

SF = "/root/testdata/sf0.001"


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(totals, weights=(5, 2, 1), most=3):
    """source -> target, by resharing the excess until none is above."""
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    held, words = {}, Fraction(sum(totals.values()))
    while True:
        free = [s for s in names if s not in held]
        rest = words - sum(held.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > most * totals[s]]
        if not above:
            return held | share
        held |= {s: Fraction(most * totals[s]) for s in above}


def multiplier(sizes, target, most=3):
    """Rates least(most, exp(lam * size / mean)) whose words meet the target, by bisection."""
    mean = sum(sizes) / len(sizes)
    words = lambda lam: sum(n * min(most, math.exp(min(50, lam * n / mean))) for n in sizes)
    low, high = -1e6, 1e6
    for _ in range(200):
        low, high = ((low + high) / 2, high) if words((low + high) / 2) < target else (low, (low + high) / 2)
    return [min(most, math.exp(min(50, low * n / mean))) for n in sizes]


def against(rows, got, key="doc_id", most=3):
    """rows: (id, source, text); got: the operator's rows."""
    sizes, totals = {}, {}
    for i, s, t in rows:
        sizes.setdefault(s, []).append((i, size(t)))
        totals[s] = totals.get(s, 0) + size(t)
    want = targets(totals)
    assert sorted((str(r[key]), r.size) for r in got) == sorted((str(i), size(t)) for i, _, t in rows)
    by = {}
    source = {i: s for i, s, _ in rows}
    for r in got:
        by.setdefault(source[r[key]], []).append(r)
    for s, rs in by.items():
        assert {r.source_size for r in rs} == {totals[s]}
        assert all(abs(r.target - float(want[s])) <= 1e-9 * max(1, float(want[s])) for r in rs)
        assert all(r.taken == r.copies * r.size <= most * r.size for r in rs)
        assert all(math.floor(r.rate) <= r.copies <= math.ceil(r.rate) for r in rs)
        if totals[s]:
            words = sum(r.rate * r.size for r in rs)
            assert abs(words - float(want[s])) <= 1e-6 * float(want[s])
            rates = dict(zip([n for _, n in sizes[s]], multiplier([n for _, n in sizes[s]], float(want[s])), strict=True))
            if want[s] < most * totals[s]:
                assert all(abs(r.rate - rates[r.size]) < 1e-5 for r in rs)
            else:
                assert {r.copies for r in rs} == {most}
            assert abs(sum(r.taken for r in rs) - float(want[s])) <= max(r.size for r in rs) + 1
    return by


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def test_against_bisection(spark):
    rows = [(i, "abcdef"[i % 6], " ".join(["w"] * (1 + i * i * 7 % 90))) for i in range(240)]
    rows += [(1000 + i, "g", "two words") for i in range(4)] + [(2000 + i, None, f"x\ty z\n{i}") for i in range(60)] + [(3000, "a", None), (3001, "b", ""), (3002, "z", " \x0b "), (3003, "é", "\U0001f600 end")]
    got = mixing.mix(documents(spark, rows)).collect()
    by = against(rows, got)
    assert {r.taken for r in by["z"]} == {0}
    off = {s: abs(sum(r.taken for r in rs) - rs[0].target) for s, rs in by.items()}
    assert all(off[s] <= 0.02 * by[s][0].target for s in "abcdef"), off  # after the repairs


def test_reruns_agree_at_any_partitioning(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    runs = []
    for d in (docs.repartition(1), docs.repartition(7, "text"), docs):
        runs.append(sorted(map(tuple, mixing.mix(d).collect())))
    assert runs[0] == runs[1] == runs[2]


def test_query_over_given_documents(spark):
    rows = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.QUERIES["op13_mixing"](spark, SF)
    assert got.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    against(rows, got.collect())


def test_equal_rows_and_ids_that_repeat_or_lack(spark):
    rows = [(None if i % 3 else 5, "a" if i < 90 else "b", "one two three") for i in range(100)]
    got = mixing.mix(documents(spark, rows)).collect()
    assert len(got) == 100 and sum(r.taken for r in got) <= 300
    a = [r for r in got if r.source_size == 270]
    b = [r for r in got if r.source_size == 30]
    assert abs(sum(r.taken for r in a) - a[0].target) <= 3 and abs(sum(r.taken for r in b) - b[0].target) <= 3


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "a", ""), (2, "b", None)], [(1, "a", "x")], [(1, "a", "x y"), (2, "b", "")]])
def test_little(spark, rows):
    got = mixing.mix(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sum(r.taken for r in got) == sum(size(t) for _, _, t in rows)


def test_clashing_names_and_other_weights(spark):
    rows = [(i, "pq"[i % 2], "w " * (i % 7)) for i in range(50)]
    named = documents(spark, rows).select(F.concat(F.lit("k"), "doc_id").alias("size"), F.col("source").alias("text"), F.col("text").alias("source"), F.lit(1).alias("key"), F.lit(2).alias("row"))
    got = mixing.mix(named.withColumnRenamed("size", "id"), (1, 3), 2, key="id", source="text", text="source").collect()
    total = sum(size(t) for _, _, t in rows)
    by = {r.source_size: r.target for r in got}
    assert abs(sum(by.values()) - total) < 1e-6 and len(got) == 50 and all(r.copies <= 2 for r in got)


def test_word_counts_of_sliced_batches():
    texts = ["a b", None, "", "  x", "y ", "  \x1c z\r\n", "no", "", "end e"]
    column = pa.array(texts)
    for i in range(len(texts)):
        assert mixing.word_counts(column[i:]).tolist() == [size(t) for t in texts[i:]]
    assert mixing.word_counts(pa.array([], pa.string())).tolist() == [] and mixing.word_counts(pa.array([None, ""], pa.string())).tolist() == [0, 0]
