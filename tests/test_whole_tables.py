"""Queries over whole tables, counted again by plain Python: every row has its part in them."""

import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from groundspark.operators.util import draw
from groundspark.plans import registry
from tests.compare import database, same

EVENTS = [(i, i % 4, ["click", "view", "error"][i * 7 % 3], i * 10, float(i % 90)) for i in range(1, 90)]  # ids of all remainders


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(EVENTS, "event_id long, user_id long, event_type string, ts long, value double").write.parquet(f"{path}/events.parquet")
    parts = [(k, f"name {k}", "LARGE") for k in [*range(40), 1003, 1010, 1011, 1012, 5000]]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string").write.parquet(f"{path}/part.parquet")
    return path


def rows(spark, sf, name):
    return registry.QUERIES[name](spark, sf).collect()


def frames():
    clips = defaultdict(list)
    for e in sorted(EVENTS, key=lambda e: (e[1], e[3], e[0])):
        clips[e[1]].append(e)
    return clips


def test_every_part_is_resolved(spark, sf):
    keys = [r.p_partkey for r in spark.read.parquet(f"{sf}/part.parquet").collect()]
    tail = {k: f"{k % 50}/{k - k % 10 if k % 10 < 3 else k}" for k in keys}
    path = {k: ("a/", "b/", "b/x/")[k % 3] + tail[k] for k in keys}
    index = {"a/" + t for t in tail.values()}
    want = []
    for p in path.values():
        ways = [[x for x in index if x == p], *([x for x in index if x.split("/")[-n:] == p.split("/")[-n:]] for n in (1, 2))]
        want.append((p, next((w[0] for w in ways if len(w) == 1), None)))
    got = [tuple(r) for r in rows(spark, sf, "e12_resolved_keys")]
    assert sorted(got) == sorted(want) and any(p.endswith("/5000") for p, _ in got)


def test_every_part_is_parsed(spark, sf):
    got = Counter((r.concept, r.concept_id) for r in rows(spark, sf, "a10_concept_lists"))
    want = Counter()
    for r in spark.read.parquet(f"{sf}/part.parquet").collect():
        k = r.p_partkey
        want.update([(r.p_name, k)] if k % 3 == 0 else [(r.p_name, 0), ("large", 1)] if k % 3 == 1 else [(r.p_name, 0)])
    assert got == want


def test_all_events_are_counted(spark, sf):
    n = Counter(e[2] for e in EVENTS)
    assert {r.concept: r["count"] for r in rows(spark, sf, "e13_concept_registry")} == {c: n[c] for c in ("error", "click", "view", "purchase", "signup", "ball")}


def spoken(spark):
    types = sorted({e[2] for e in EVENTS})
    ids = spark.createDataFrame([(e[0],) for e in EVENTS], "event_id long")
    return {r.event_id: types[r.d % len(types)] for r in ids.select("event_id", draw(1, "event_id").alias("d")).collect()}


def test_every_event_is_an_utterance(spark, sf):
    said, n, paired, near = spoken(spark), Counter(), Counter(), Counter()
    for clip in frames().values():
        for i, e in enumerate(clip):
            c = said[e[0]]
            seen = {j - i for j, x in enumerate(clip) if x[2] == c and abs(j - i) <= 10}
            for k in (c, None):
                n[k] += 1
                paired[k] += 0 in seen
                near[k] += bool(seen)
    got = {r.concept: (r.n, r.paired, r.near) for r in rows(spark, sf, "f10_temporal_misalignment")}
    assert got == {k: (n[k], paired[k], near[k]) for k in n} and n[None] == len(EVENTS)


def test_examples_are_mined_from_all_events(spark, sf):
    bell = lambda x, mu, sigma: math.exp(-0.5 * ((x - mu) / sigma) ** 2)
    said, want = spoken(spark), defaultdict(list)
    for clip in frames().values():
        for i, e in enumerate(clip):
            reach = [j for j in range(max(0, i - 10), min(len(clip), i + 11)) if j != i]
            hits = [(clip[j][4] / 200, i - j, (clip[j][0] % 9 + 1) / 10) for j in reach if clip[j][2] == said[e[0]] and clip[j][4] > 0]
            if not hits or (e[2] == said[e[0]] and e[4] > 0):
                continue
            area, _, compact = max(hits)
            share = len(hits) / len(reach)
            if 0.01 <= area <= 0.45 and share <= 0.55 and compact >= 0.1:
                score = 100 * bell(area, 0.12, 0.1) + 40 * bell(min(abs(o) for _, o, _ in hits) / 5, 0.4, 0.45) + 45 * bell(share, 0.25, 0.18) + 25 * bell(compact, 0.55, 0.25)
                want[said[e[0]]].append((-round(score / (2 if said[e[0]] == "error" else 1), 9), e[0]))
    got = {(r.concept, r.utt) for r in rows(spark, sf, "f11_mined_examples")}
    assert got == {(c, u) for c, xs in want.items() for _, u in sorted(xs)[:4]} and any(u % 10 for _, u in got)


def test_every_event_is_an_anchor(spark, sf):
    want = {}
    for clip in frames().values():
        kept = [j for j in range(len(clip)) if j % 3 != 1]
        for i, e in enumerate(clip):
            centre = kept.index(i) if i in kept else min(sum(j < i for j in kept), len(kept) - 1)
            want[e[0]] = [kept[min(max(centre + k * 2, 0), len(kept) - 1)] for k in range(-2, 3)]
    got = {r.anchor: list(r.frames) for r in rows(spark, sf, "h12_clips")}
    assert got == want and len(got) == len(EVENTS)


def test_concept_set_takes_every_name(spark, tmp_path):
    """Names beyond the first hundred parts are concepts, too."""
    duckdb.execute(f"copy (select * replace ('name ' || p_partkey as p_name) from '/root/testdata/sf0.001/part.parquet') to '{tmp_path}/part.parquet' (format parquet)")
    n = duckdb.execute(f"select count(*) from '{tmp_path}/part.parquet'").fetchone()[0]
    found = registry.QUERIES["h18_concept_set"](spark, str(tmp_path))
    assert n > 100 and found.where("source = 1 and concept like 'name %'").count() == n
    same(found, database(str(tmp_path)), registry.ORACLE["h18_concept_set"])


def test_warm_start_takes_every_text(spark, tmp_path):
    """More texts than a sample of the operator's usual size has."""
    z = np.random.default_rng(3).normal(size=(9000, 4)).astype(np.float32)
    rows = pa.table({"vec_id": pa.array([i // 2 * 20 + i % 2 * 5 for i in range(9000)], pa.int64()), "embedding": pa.array(z.tolist(), pa.list_(pa.float32())), "label": pa.array([0] * 9000, pa.int32())})  # noqa: F841
    duckdb.connect().register("rows", rows).execute(f"copy rows to '{tmp_path}/embeddings.parquet' (format parquet)")
    same(registry.QUERIES["g8_warm_start"](spark, str(tmp_path)), database(str(tmp_path)), registry.ORACLE["g8_warm_start"])
