"""Duplicate passages by relative Lempel-Ziv parsing against content-defined reference blocks.

Every window of WINDOW words picks its least GRAM-gram as anchor (by hash, leftmost on ties), so
equal windows of any two documents pick equal anchors. The consecutive windows with one anchor form
a block: the reference is the index of all blocks, each with the first document that holds it. A
document is parsed greedily from left to right: a factor starts at the first window that the index
holds and takes block after block for as long as they continue in the same place of the same
reference document. At factor boundaries, where blocks of one anchor differ, every window is checked
alone against the windows of all other blocks of that anchor (which is every place where it could
stand). All factors have WINDOW words or more; together they are the duplicate spans.

Only blocks whose anchor occurs again leave the first pass, and of copies of a block one stands for
all, so a passage in a third of all documents is one row at each step but the last join. Grams,
blocks and windows are told apart by 64-bit polynomial hashes, two independent ones each (anchor
and block, anchor and window). Texts are told apart by key and XXH64.

Defined results: null text has no words; the first document (smallest key) with a passage keeps it;
a passage repeated within one document only is kept; rows of equal key aren't duplicates of each
other, whatever their texts, and each gives a row of its own; rows of null key keep all words and
are no reference; empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices, words, written

WINDOW, GRAM = 50, 25
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
CACHED = 400_000  # word hashes remembered by a Python worker
TAKEN = 4_000_000  # characters of text hashed at a time
PLACE = np.uint64((1 << 23) - 1)  # low bits of a gram's order that hold its place
PIECE = 1 << 22  # windows whose anchors are chosen at a time, so that places fit


class WordHashes(dict):
    """Word -> 64-bit hash, computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any word ranges of a sequence."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        power = np.full(n + 1, BASE)
        power[0] = 1
        self.power = np.multiply.accumulate(power)
        back = np.full(n + 1, INVERSE)
        back[0] = 1
        self.back = np.multiply.accumulate(back)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(hashes * self.power[:n])])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each width neighbours."""
    n = len(x) - width + 1
    padded = np.concatenate([x, np.full(-len(x) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(grams: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """Place of the least gram of every window, piece windows at a time."""
    width = WINDOW - GRAM + 1
    out = np.empty(len(grams) - width + 1, np.int64)
    for a in range(0, len(out), piece):
        part = grams[a : a + piece + width - 1]
        out[a : a + piece] = (sliding_least((part & ~PLACE) | np.arange(len(part), dtype=np.uint64), width) & PLACE).astype(np.int64) + a
    return out


def blocks_of(roll: Rolling, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks of documents of given first word and size: document's index, first window, windows, anchor and block hash."""
    total = len(roll.sums) - 1
    none = np.zeros(0, np.int64)
    if total < WINDOW or not (sizes >= WINDOW).any():
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    place = np.arange(total - GRAM + 1)
    grams = roll.ranges(place, place + GRAM)
    chosen = anchors(grams)
    doc = np.repeat(np.arange(len(sizes)), sizes)[: len(chosen)]
    first = np.arange(len(chosen))
    inside = first - starts[doc] <= sizes[doc] - WINDOW
    first, doc, chosen = first[inside], doc[inside], chosen[inside]
    cut = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])]))
    n = np.diff(np.append(cut, len(first)))
    begin = first[cut]
    return doc[cut], begin, n, grams[chosen[cut]], roll.ranges(begin, begin + n - 1 + WINDOW)


def blocks(documents: DataFrame, key: str, text: str) -> DataFrame:
    """k, t (hash of the text), anchor, block, start (word), n (windows) of every block of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            raw, keys, marks = as_bytes(batch.column(2)), *(batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for a, b in slices(np.array([len(x) if x else 0 for x in raw]), TAKEN):
                ws = [words(x) for x in raw[a:b]]
                sizes = np.array([len(w) for w in ws])
                starts = np.cumsum(sizes) - sizes
                roll = Rolling(known.of([w for x in ws for w in x]))
                doc, begin, n, anchor, block = blocks_of(roll, starts, sizes)
                if len(doc):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[a:b][doc]), pa.array(marks[a:b][doc]), pa.array(anchor.view(np.int64)), pa.array(block.view(np.int64)), pa.array((begin - starts[doc]).astype(np.int32)), pa.array(n.astype(np.int32))], ["k", "t", "anchor", "block", "start", "n"])

    return rows_of(documents, key, text).mapInArrow(run, "k long, t long, anchor long, block long, start int, n int")


def rows_of(documents: DataFrame, key: str, text: str) -> DataFrame:
    """k, t (hash of the text) and text of documents with a key."""
    return documents.select(F.col(key).cast("long").alias("k"), F.xxhash64(text).alias("t"), F.col(text).alias("text")).where("k is not null")


def boundary_windows(documents: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """k, anchor, block, i, window (hash) of the windows of the wanted blocks (k, t, places: array of start, n, anchor, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for i in range(batch.num_rows):
                places = batch.column(2)[i].values
                roll = Rolling(known.of(words(as_bytes(batch.column(1).slice(i, 1))[0])))
                start, n = places.field("start").to_numpy().astype(np.int64), places.field("n").to_numpy().astype(np.int64)
                owner = np.repeat(np.arange(len(n)), n)
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                first = start[owner] + at
                cols = [np.full(len(owner), batch.column(0)[i].as_py()), places.field("anchor").to_numpy()[owner], places.field("block").to_numpy()[owner], at.astype(np.int32), roll.ranges(first, first + WINDOW).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["k", "anchor", "block", "i", "window"])

    docs = rows_of(documents, key, text).join(wanted, ["k", "t"], "left_semi").dropDuplicates(["k", "t"])
    return docs.join(wanted, ["k", "t"]).select("k", "text", "places").mapInArrow(run, "k long, anchor long, block long, i int, window long")


def duplicate_blocks(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k, t and hits of documents with any: array of start, n (windows), mask (those that hit; null: all), source (document) and at (word of it; null behind a mask)."""
    rows = written(blocks(documents, key, text))
    again = rows.groupBy("anchor").agg(F.count("*").alias("c"), F.min("k").alias("a"), F.max("k").alias("b"), F.min("block").alias("x"), F.max("block").alias("y")).where("a < b")
    again = written(again.select("anchor", (F.col("x") != F.col("y")).alias("differ")))  # so that both sides of the join are dealt anew, and a hot anchor's rows can be split
    shared = written(rows.join(again, "anchor"))
    first = shared.groupBy("anchor", "block").agg(F.min(F.struct("k", "t", "start", "n")).alias("f"), F.max("k").alias("last"), F.first("differ").alias("differ"))
    first = written(first.select("anchor", "block", "f.*", "last", "differ"))
    wanted = written(first.where("differ").groupBy("k", "t").agg(F.collect_list(F.struct("start", "n", "anchor", "block")).alias("places")))
    windows = written(boundary_windows(documents, wanted, key, text))
    earliest = windows.groupBy("anchor", "window").agg(F.min("k").alias("source"), F.max("k").alias("latest")).where("source < latest").drop("latest")
    found = windows.join(written(earliest), ["anchor", "window"]).where("source < k")
    partly = found.groupBy("anchor", "block").agg(F.sum(F.expr("shiftleft(1L, i)")).alias("mask"), F.min("source").alias("other"))
    status = first.join(partly, ["anchor", "block"], "left").where("k < last or mask is not null")
    status = written(status.select("anchor", "block", F.col("k").alias("source"), F.col("start").alias("at"), "mask", "other"))
    hits = shared.drop("differ").join(status, ["anchor", "block"]).where("k > source or mask is not null")
    own = F.col("k") == F.col("source")
    hit = F.struct("start", "n", F.when(own, F.col("mask")).alias("mask"), F.when(own, F.col("other")).otherwise(F.col("source")).alias("source"), F.when(~own, F.col("at")).alias("at"))
    return hits.select("k", "t", hit.alias("h")).groupBy("k", "t").agg(F.collect_list("h").alias("hits"))


def parsed(start: np.ndarray, n: np.ndarray, mask: np.ndarray, source: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Greedy factors of one document: start and words, source document and word there (-1 behind a mask), from left to right."""
    out: list[list[int]] = []  # start, end, source, place there

    def take(s: int, windows: int, src: int, place: int) -> None:
        if out and out[-1][2] == src and s == out[-1][1] - WINDOW + 1 and (place < 0 or out[-1][3] < 0 or place - s == out[-1][3] - out[-1][0]):
            out[-1][1] = s + windows - 1 + WINDOW
            if out[-1][3] < 0 <= place:
                out[-1][3] = place - s + out[-1][0]
        else:
            out.append([s, s + windows - 1 + WINDOW, src, place])

    by = np.argsort(start, kind="stable")
    for s, w, m, src, place in zip(*(x[by].tolist() for x in (start, n, mask, source, at)), strict=True):
        if m < 0:
            take(s, w, src, place)
            continue
        i = 0
        while m >> i:
            skip = ((m >> i) & -(m >> i)).bit_length() - 1
            i += skip
            run = (~(m >> i) & -~(m >> i)).bit_length() - 1  # ones in a row
            take(s + i, run, src, -1)
            i += run
    return [(a, b - a, src, place) for a, b, src, place in out]


def remove_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, kept (text of the kept words, joined by one space), n_words, n_removed and factors (start, n words, source document, place there) of every row."""
    hits = duplicate_blocks(documents, key, text)
    kinds = [("start", pa.int32()), ("n", pa.int32()), ("source", pa.int64()), ("place", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(np.array([len(x) if x else 0 for x in as_bytes(batch.column(1))]), TAKEN):
                part = batch.slice(a, b - a)
                kept, sizes, gone, factors = [], [], [], []
                for raw, places in zip(as_bytes(part.column(1)), part.column(2), strict=True):
                    ws = words(raw)
                    spans: list[tuple[int, int, int, int]] = []
                    left = ws
                    if places.is_valid:
                        v = places.values
                        spans = parsed(*(v.field(c).fill_null(-1).to_numpy() for c in ("start", "n", "mask", "source", "at")))
                        done, left = 0, []
                        for s, n, _, _ in spans:
                            left += ws[done:s]
                            done = max(done, s + n)
                        left += ws[done:]
                    kept.append(b" ".join(left))
                    sizes.append(len(ws))
                    gone.append(len(ws) - len(left))
                    factors.append([dict(zip(("start", "n", "source", "place"), x, strict=True)) for x in spans])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(factors, pa.list_(pa.struct(kinds)))], [key, "kept", "n_words", "n_removed", "factors"])

    kind = documents.schema[key].dataType.simpleString()
    docs = documents.select(F.col(key).alias("__key"), F.col(text).alias("__text"), F.col(key).cast("long").alias("k"), F.xxhash64(text).alias("t"))
    rows = docs.join(hits, ["k", "t"], "left").select("__key", "__text", "hits")
    return rows.mapInArrow(run, f"`{key}` {kind}, kept string, n_words long, n_removed long, factors array<struct<start:int,n:int,source:bigint,place:int>>")


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    return remove_duplicates(documents).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
