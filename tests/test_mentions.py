"""Surface forms are just the tokens that the canonical rule makes a concept."""

import itertools

from pyspark.sql import functions as F

from groundspark.functions import text as X
from groundspark.operators import concepts as C


def test_surface_forms(spark):
    concepts = ["foot", "cat", "stair", "step", "bu", "bus", "is", "table", "tabl", "a", "as", "s", "es", "the", "kitty", "princes", "class"]
    tokens = set(X.ALIASES) | set(X.ALIASES.values()) | {c + e for c in concepts for e in ("", "s", "es", "ses", "ess", "e")} | {"".join(t) for n in (1, 2, 3, 4) for t in itertools.product("aes", repeat=n)}
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", X.canonical(F.col("t")).alias("c")).collect()
    want = {r.t: r.c for r in rows if r.c in concepts}
    forms = X.surface_forms(concepts)
    assert {t: c for t, c in forms.items() if t in tokens} == want and set(forms) <= tokens


def test_mentions_of_odd_texts(spark):
    df = spark.createDataFrame([(1, "Cats, the CAT; foot feet"), (2, None), (3, ""), (4, "##cat ▁table"), (1, "dog")], "k long, text string")
    got = sorted((r.k, r.concepts) for r in C.mentions(df, "k", "text", ["cat", "foot", "table", "tabl", "the"]).collect())
    assert got == [(1, []), (1, ["cat", "foot", "the"]), (2, []), (3, []), (4, ["cat", "table"])]
    assert C.mentions(df, "k", "text", []).count() == 5


def test_lorenz_in_runs(spark, monkeypatch):
    from groundspark.operators import metrics as M

    monkeypatch.setattr(M, "RUN", 7)
    values = [1] * 40 + [2] * 15 + [9, 9, 30]
    got = sorted((round(r.x, 9), round(r.y, 9)) for r in M.lorenz(spark.createDataFrame([(v,) for v in values], "v long"), "v").collect())
    want = [(0.0, 0.0)] + [(round((i + 1) / len(values), 9), round(sum(values[: i + 1]) / sum(values), 9)) for i in range(len(values))]
    assert got == want
