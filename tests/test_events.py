"""Event pairs against plain loops."""

import math
import random
import re

from pyspark.sql import functions as F

from groundspark.operators import corpus as C


def test_slices(spark):
    sizes = {1: 10, 2: 1, 3: 4}
    frames = spark.createDataFrame([(e, i, f"{e}/{i}") for e, n in sizes.items() for i in range(n)], "event long, idx long, frame string")
    times = [(0.0, 0.3), (0.31, 0.9), (5.0, 6.0), (-1.0, -0.5), (1.0, 0.2), (None, 1.0), (0.4, None), (0.6, 0.6)]
    utts = [(e, u, s, t, es) for e in (1, 2, 3, 4) for u, (s, t) in enumerate(times) for es in [0.0]] + [(1, 100, 3.0, 3.5, 2.9), (1, 101, 1.0, 2.0, None)]
    got = {(r.event, r.u, r.idx) for r in C.pair_events(spark.createDataFrame(utts, "event long, u int, us double, ue double, es double"), frames).where("frame = concat(event, '/', idx)").collect()}
    want = set()
    for e, u, us, ue, es in utts:
        n = sizes.get(e, 0)
        if None in (us, ue, es):
            idx = range(n)
        else:
            s = math.floor(max(0.0, us - es) * 5)
            t = max(s, math.ceil(max(0.0, ue - es) * 5))
            idx = range(min(s, n - 1), min(t, n - 1) + 1) if n else ()
        want |= {(e, u, i) for i in idx}
    assert got == want


def test_slices_join_nothing_that_is_not_returned(spark):
    frames = spark.range(1000).selectExpr("id div 100000 as event", "id as idx")
    utts = spark.range(50).selectExpr("id div 100000 as event", "id as u", "id * 1.0D as us", "id * 1.0D + 0.1D as ue", "0D as es")
    plan = C.pair_events(utts, frames)._jdf.queryExecution().executedPlan().toString()
    assert C.pair_events(utts, frames).count() == 50 * 2 and "Generate" in plan and "NestedLoop" not in plan


def test_sentences(spark):
    texts = {1: " One. Two!  Three?\nFour; still. Five. Six.", 2: "no stop", 3: "", 4: None, 5: "..  . x"}
    frames = spark.createDataFrame([(e, i) for e in (1, 2, 3, 4, 6) for i in range(e)], "event long, idx long")
    got = C.pair_sentences(spark.createDataFrame(list(texts.items()), "event long, narration string"), frames).collect()
    want = {(e, u, s, i) for e, t in texts.items() if e != 5 for u, s in enumerate([x for x in re.split(r"(?<=[.!?])\s+", (t or "").strip()) if x.strip()][:4]) for i in range(e)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_mentions_meet_in_blocks_of_frames(spark):
    """What is within a window is found over the edges of blocks, and no mention is shuffled once for every offset."""
    from groundspark.operators import concepts as K

    r = random.Random(5)
    utts = [(i, r.choice("ab"), r.randrange(300), r.choice("xyz")) for i in range(400)]
    seen = sorted({(r.choice("ab"), r.randrange(-20, 320), r.choice("xyz")) for _ in range(300)})
    u = spark.createDataFrame(utts, "utt long, clip string, frame_idx long, concept string")
    s = spark.createDataFrame(seen, "clip string, at long, concept string")
    for window in (0, 10, 200):
        got = sorted((x.utt, x.offset) for x in K.within(u, s, window).collect())
        assert got == sorted((i, at - f) for i, c, f, k in utts for d, at, m in seen if (c, k) == (d, m) and abs(at - f) <= window)
        seen_by = K.visibility(u, s.select("clip", F.col("at").alias("frame_idx"), F.col("concept").alias("label")), window).collect()
        assert sorted((x.utt, x.near) for x in seen_by) == [(i, int(any((c, k) == (d, m) and abs(at - f) <= window for d, at, m in seen))) for i, c, f, k in utts]
    plan = K.within(u, s, 1000)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1  # of what is seen, into the one or two blocks it can be met from
