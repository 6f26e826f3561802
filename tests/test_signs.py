"""Values just under zero are -0.0 after rounding, as in SQL: exact texts of the numbers are compared."""

import os

import pytest

from groundspark.plans import registry
from tests.compare import database

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tiny(spark, tmp_path_factory):
    """Vectors of one large entry; all have -1e-7 in front, all but the first six also at the large entries of those six."""
    at = str(tmp_path_factory.mktemp("signs"))
    for t in ("part", "events"):
        os.symlink(f"{SF}/{t}.parquet", f"{at}/{t}.parquet")
    rows = []
    for i in range(100):
        z = [0.0] * 64
        z[0] = -1e-7
        if i >= 6:
            z[8:14] = [-1e-7] * 6
        z[8 + i if i < 6 else 14 + i % 50] = 1.0
        rows.append((i, z, i % 10))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.mark.parametrize("name", ["b30_masked_pooling", "b30_packed_pooling", "g3_recall", "h11_text_choice"])
def test_signs_of_zeros(spark, tiny, name):
    found = registry.QUERIES[name](spark, tiny)
    sql = database(tiny).execute(registry.ORACLE[name])
    names = [c[0] for c in sql.description]
    want = sorted(map(str, sql.fetchall()))
    got = sorted(str(tuple(r)) for r in found.select(*names).collect())
    assert any("-0.0," in w or "-0.0]" in w for w in want) and got == want
