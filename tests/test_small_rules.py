"""Sentence forms, label modes, vocabulary gates, sort modes, prompts and empty inputs, by hand."""

import math

from groundspark.operators import corpus as C
from groundspark.operators import evaluation as E
from groundspark.operators import masks as M
from groundspark.operators import metrics as D


def test_sentences_of_ids(spark):
    ids = {1: [2, 4, 5, 3, 0, 0], 2: [4, 1, 3], 3: [2, 3], 4: [], 5: [0, 4], 6: [2, 3, 4, 2], 7: [3], 8: [2]}
    vocab = spark.createDataFrame([("ball", 4), ("cat", 5)], "token string, token_id long")
    got = {r.k: r.sentence for r in C.decode_sentences(spark.createDataFrame(list(ids.items()), "k int, token_ids array<int>"), "k", vocab).collect()}
    assert got == {1: "ball cat", 2: "ball <unk>", 3: "", 4: "", 5: "", 6: "<eos> ball <sos>", 7: "", 8: ""}


def test_label_modes(spark):
    t = spark.createDataFrame([("cat",), ("a",), ("the",), ("zebra",)], "target_category string")
    v = spark.createDataFrame([("cat",), ("the",)], "token string")
    assert {r.label for r in E.invalid_labels(t, v).collect()} == {"a", "the", "zebra"}
    assert {r.label for r in E.invalid_labels(t, v, "raw").collect()} == {"a", "the"}
    good = t.where("target_category in ('cat', 'zebra')")
    assert E.trials_are_valid(good, v, "raw") and not E.trials_are_valid(good, v) and not E.trials_are_valid(good, v, "raw", "vocab") and E.trials_are_valid(good, v, "raw", " RAW ") and not E.trials_are_valid(t.limit(0), v)


def test_renaming_needs_the_vocabulary(spark):
    t = spark.createDataFrame([("cat", ["dog", "cat"])], "target_category string, foil_categories array<string>")
    v = lambda *w: spark.createDataFrame([(x,) for x in w], "token string")
    assert tuple(E.relabel(t, {"cat": "kitty"}, v("kitty")).first()) == ("kitty", ["dog", "kitty"])
    assert tuple(E.relabel(t, {"cat": "kitty"}, v("cat")).first()) == ("cat", ["dog", "cat"])
    assert tuple(E.relabel(t, {"cat": "kitty"}).first()) == ("kitty", ["dog", "kitty"])


def test_sort_modes(spark):
    run = lambda **c: spark.createDataFrame([(k, i < v) for k, v in c.items() for i in range(10)], "class string, correct boolean")
    a, b = run(x=9, y=2, z=5), run(x=1, y=6, z=10)
    order = lambda mode: [r["class"] for r in E.compare_runs(a, b, mode).collect() if r["class"]]
    assert order("alpha") == ["x", "y", "z"] and order("baseline") == ["x", "z", "y"] and order("experiment") == ["z", "y", "x"] and order("delta") == ["z", "y", "x"]


def test_prompts_and_bad_names(spark):
    got = {(r.concept, r.place): r.prompt for r in M.prompts(spark.createDataFrame([("Hand",), ("ball",)], "concept string")).collect()}
    assert got["Hand", 0] == "a photo of a human hand" and got["ball", 3] == "a toy ball" and len(got) == 8
    names = spark.createDataFrame([("zzz",), ("bad",), (None,), ("bad",)], "mask_name string")
    assert [r.mask_name for r in M.bad_names(names, 2).collect()] == ["bad", "bad"]


def test_gini_of_nothing(spark):
    df = spark.createDataFrame([("a", 0), ("a", 0), ("b", 1), ("b", 3)], "k string, n long")
    got = {r.k: r.gini for r in D.gini(df, "n", "k", empty=math.nan).collect()}
    assert math.isnan(got["a"]) and abs(got["b"] - 0.25) < 1e-12
    assert D.gini(df.limit(0), "n").first().gini == 0 and math.isnan(D.gini(df.limit(0), "n", empty=math.nan).first().gini)
    assert abs(D.gini(df, "n").first().gini - 0.625) < 1e-12
