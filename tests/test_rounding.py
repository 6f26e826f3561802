"""Rounding as in SQL: exact texts of the numbers are compared."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundspark.functions import vectors as V
from groundspark.plans import registry
from tests.compare import database

SF = "/root/testdata/sf0.01"
N = 2000


def kinds():
    rng = np.random.default_rng(4)
    odd = rng.integers(-1_000_000, 1_000_000, 3000) * 2 + 1
    yield "halves", list(odd / 2e6)
    yield "large", list(0.5 * rng.uniform(-1, 1, 5000) - 5e8)
    yield "larger", list(rng.uniform(-1, 1, 3000) * 10.0 ** rng.integers(0, 20, 3000))
    yield "special", [0.0, -0.0, -1e-7, 1e-7, 5e-7, -5e-7, 4.9999999999999994e-7, 0.0078125, -1e-300, 1e300, 1e305, -1e305, float("inf"), float("-inf"), float("nan"), None]


@pytest.mark.parametrize("kind,xs", list(kinds()), ids=lambda x: x if isinstance(x, str) else "")
def test_rounded(spark, tmp_path, kind, xs):
    spark.createDataFrame([(i, None if x is None else float(x)) for i, x in enumerate(xs)], "i long, x double").coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    want = [str(r[0]) for r in database(str(tmp_path)).execute("select round(x, 6) from t order by i").fetchall()]
    t = spark.read.parquet(f"{tmp_path}/t.parquet").orderBy("i")
    assert [str(r[0]) for r in t.select(V.rounded(F.col("x"))).collect()] == want
    assert [str(r[0][0]) for r in t.select(V.rounded_list(F.array("x"))).collect()] == want


def tables(spark, at, rows):
    os.symlink(f"{SF}/part.parquet", f"{at}/part.parquet")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{at}/embeddings.parquet")
    return str(at)


def agree(spark, at, name):
    sql = database(at).execute(registry.ORACLE[name])
    names = [c[0] for c in sql.description]
    want = sorted(map(str, sql.fetchall()))
    assert sorted(str(tuple(r)) for r in registry.QUERIES[name](spark, at).select(*names).collect()) == want
    return want


@pytest.mark.parametrize("far", [10 * N, 10**10])
def test_images_without_objects(spark, tmp_path, far):
    """Only ids between a sixth and a third (and those of the texts) are near, so that images have frames but no object: combined scores near -5e8."""
    z = np.random.default_rng(1).normal(size=(N, 64)).tolist()
    rows = [(i if i < 6 or N / 6 < i < N / 3 else i + far, z[i], i % 10) for i in range(N)]
    want = agree(spark, tables(spark, tmp_path, rows), "h11_text_choice")
    assert sum("-1000000000.0" in w for w in want) > 300


@pytest.mark.parametrize("name", ["h11_text_choice", "h11_image_choice"])
def test_rows_without_vector(spark, tmp_path, name):
    """They count as objects; some images have no other, nor has one of the texts."""
    z = np.random.default_rng(2).normal(size=(N, 64)).tolist()
    rows = [(i, None if i == 3 or i % 100 > 95 else z[i], i % 10) for i in range(N)]
    want = agree(spark, tables(spark, tmp_path, rows), name)
    assert any("None, None, None, None" in w for w in want)
