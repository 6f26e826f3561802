"""SimHash near-duplicates by multi-index hashing.

Fingerprint: XXH64 (seed 42) of every shingle, bitwise majority. Fingerprints within three bits
differ by one bit at most in one of two 32-bit segments, so the table holds every distinct
fingerprint under both segment values, and a probe enumerates the ball of radius one: the value
itself and each value with a one cleared (of a pair, one side has the one). Matches are verified
by their complete distance. Equal fingerprints are one row from the start; a segment value with
more than BLOCK rows is dealt out as pairs of blocks, and each task returns a spanning forest of
its links instead of all pairs, so no group is ever expanded or gathered whole.

Defined results: null and blank texts have fingerprint zero and are linked like any other; a text
shorter than a shingle is one shingle; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, free_name, words, written
from .components import components

BLOCK = 4096  # rows of a segment value that a task compares with as many others
PAIRS = 4_000_000  # compared at a time

_hash = partial(xxhash.xxh64_intdigest, seed=42)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes (uint64), as an unsigned number."""
    n = len(hashes)
    if not n:
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    total = np.zeros(64, np.int64)
    whole = n - n % 255
    if whole:
        total += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).astype(np.int64).sum(0)
    total += bits[whole:].sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """SimHash of one text (UTF-8)."""
    w = words(text.lower() if text else None)
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(size)), strict=False)) if len(w) >= size else [b" ".join(w)]
    return majority(np.fromiter(map(_hash, shingles), np.uint64, max(1, len(w) - size + 1)))


def fingerprints(df: DataFrame, text: str = "text", out: str = "simhash", drop: tuple[str, ...] = ()) -> DataFrame:
    """df with the fingerprint of column text (a long with the same 64 bits) in the column out."""
    keep = [c for c in df.columns if c != out and c not in drop]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter(map(fingerprint, as_bytes(batch.column(len(keep)))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(prints.view(np.int64))], [*keep, out])

    return df.select(*keep, F.col(text).alias(free_name(df, "__text"))).mapInArrow(run, schema)


class Forest:
    """Union-find over 0 .. n-1 that takes links as arrays."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        while len(u):
            a, b = self.up[u], self.up[v]
            off = a != b
            u, v, a, b = u[off], v[off], a[off], b[off]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
            while (jump := self.up[self.up] != self.up).any():
                self.up[jump] = self.up[self.up[jump]]


def _forest(key: np.ndarray, kind: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links in runs of equal keys; kind 0 rows (table) are compared with all others."""
    starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
    sizes = np.diff(np.append(starts, len(key)))
    table = np.add.reduceat((kind == 0).astype(np.int64), starts)
    use = (table > 0) & (sizes > 1)
    forest = Forest(len(prints))
    order = np.lexsort((kind, np.repeat(np.arange(len(starts)), sizes)))  # table rows first in each run
    prints = prints[order].view(np.uint64)
    rows = np.repeat(starts[use], table[use]) + np.concatenate([np.arange(t) for t in table[use]]) if use.any() else np.zeros(0, np.int64)
    ends = np.repeat((starts + sizes)[use], table[use])
    i = 0
    width = ends - rows - 1  # each table row with all later rows of its run
    total = np.cumsum(width)
    while i < len(rows):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS, "right")))
        n = width[i:j]
        left = np.repeat(rows[i:j], n)
        right = np.repeat(rows[i:j] + 1 - np.cumsum(n) + n, n) + np.arange(n.sum())
        near = np.bitwise_count(prints[left] ^ prints[right]) <= radius
        forest.link(left[near], right[near])
        i = j
    child = np.flatnonzero(forest.up != np.arange(len(prints)))
    return prints[child].view(np.int64), prints[forest.up[child]].view(np.int64)


def links(distinct: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """Distinct fingerprints (column simhash) -> edges (a, b) that connect just what chains of links connect."""
    if radius > 3:
        raise ValueError("two segments and balls of radius one guarantee three bits at most")
    halves = [F.col("simhash").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("simhash", 32)]

    def entries(k: int) -> F.Column:
        value, tag = halves[k], F.lit(k << 32)
        cleared = F.filter(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.when(F.expr("1L") == F.getbit(value, i), value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))), lambda x: x.isNotNull())
        return F.concat(F.array(F.struct((value + tag).alias("key"), F.lit(0).alias("kind"))), F.transform(cleared, lambda x: F.struct((x + tag).alias("key"), F.lit(1).alias("kind"))))

    rows = distinct.select("simhash", F.explode(F.concat(entries(0), entries(1))).alias("e")).select("e.key", "e.kind", "simhash")
    hot = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("simhash"), F.col("blocks")).cast("int")
    dealt = rows.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", own)
    dealt = dealt.select("key", "kind", "simhash", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("key", "kind", "simhash", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            if parts and sum(len(x[0]) for x in parts):
                a, b = _forest(*(np.concatenate(x) for x in zip(*parts, strict=True)), radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            c = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            key = np.stack([c[0], c[3].astype(np.int64), c[4].astype(np.int64)], 1)
            now = (key, c[1], c[2])
            last = key[-1]
            same = (key == last).all(1)
            first = len(key) - int(np.argmin(same[::-1])) if not same.all() else 0
            if first or (held and (held[-1][0][-1] != key[0]).any()):
                yield from flush([*held, tuple(x[:first] for x in now)])
                held = []
            held.append(tuple(x[first:] for x in now))
        yield from flush(held)

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 3) -> DataFrame:
    """key, simhash and component_id (the smallest key that links reach, its own included) of every row."""
    prints = written(fingerprints(documents.select(key, text), text, drop=(text,)))
    distinct = written(prints.groupBy("simhash").agg(F.min(key).alias("first")))
    roots = components(links(distinct.select("simhash"), radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "simhash"), "simhash", "left").select("simhash", "first", F.coalesce("root", "simhash").alias("root"))
    rooted = written(rooted)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(rooted.join(least, "root").select("simhash", "component_id"), "simhash").select(key, "simhash", "component_id")


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    return near_duplicates(documents).select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")
