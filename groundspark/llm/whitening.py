"""Embedding whitening by a bit-sliced scatter matrix.

Entries become integers, floor(scale c) + shift. In a task each dimension's bit planes (of x less the
table's least x, so that none is wasted) are packed across rows into uint64 words, and
sum x_a x_b = sum over planes p, q of 2^(p + q) popcount(plane p of a & plane q of b). A task returns
its popcounts weighted within limbs of LIMB bits, which Spark adds up as decimals, so the cross-products
of all rows are exact at any size. They are centred as integers, n sum x_a x_b - S_a S_b, then divided
by n^2 and decomposed by eigh on the driver: width x width numbers, WIDTH at most. A last pass projects
each row's n x - S on the components; the covariance of what it gives is measured by covar_pop.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped; shorter
vectors count as padded by entries of zero; rows of one id, or of none, are rows on their own. A
component without variance (eigenvalue below EPS of the trace) has a null whitened and doesn't count in
identity_error; explained is null if all rows are equal. deviation is null where it passes 63 bits:
deviation_exact, a decimal, has it always (beyond 38 digits it is null too). Empty tables give empty
results. Wider vectors than WIDTH and entries beyond 2^40 raise a ValueError before the scatter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import finite, list_matrix, with_key, written

LIMB = 24  # bits of weight that share one long
ROWS = 4096  # of a block that is packed at a time
WIDTH = 1024  # dimensions at most: the driver holds their squares
EPS = 1e-13


def sliced(y: np.ndarray, planes: int) -> np.ndarray:
    """(rows, dimensions) of integers from 0 -> (dimensions, planes, words): bit planes packed across rows."""
    n, width = y.shape
    out = np.zeros((width, planes, -(-n // 64) * 8), np.uint8)
    columns = np.ascontiguousarray(y.T)
    for p in range(planes):
        out[:, p, : -(-n // 8)] = np.packbits(((columns >> p) & 1).astype(np.uint8), axis=1, bitorder="little")
    return out.view("<u8")


def cross_counts(packed: np.ndarray, into: np.ndarray) -> None:
    """Adds AND-popcounts, weighted by 2^((p + q) % LIMB), to into[(p + q) // LIMB, a, b] for b >= a."""
    width, planes, _ = packed.shape
    weight = 1 << (np.add.outer(np.arange(planes), np.arange(planes)) % LIMB).astype(np.int64)
    limb = np.add.outer(np.arange(planes), np.arange(planes)) // LIMB
    each = np.ones(packed.shape[2], np.float32)  # a block's counts stay below 2^24, where float32 is exact
    for a in range(width):
        for p in range(planes):
            if not packed[a, p].any():
                continue
            ones = (np.bitwise_count(packed[a:] & packed[a, p]).astype(np.float32) @ each).astype(np.int64) * weight[p]
            for at in np.unique(limb[p]):
                into[at, a, a:] += ones[:, limb[p] == at].sum(1)


def plane_sums(packed: np.ndarray) -> np.ndarray:
    """Sums by dimension."""
    return np.bitwise_count(packed).sum(-1, dtype=np.int64) @ (1 << np.arange(packed.shape[1], dtype=np.int64))


def _integers(column: pa.Array, width: int, scale: int, shift: int) -> np.ndarray:
    return np.floor(scale * list_matrix(column, width)).astype(np.int64) + shift


def scatter(data: DataFrame, width: int, low: int, planes: int) -> tuple[list[int], list[list[int]]]:
    """Sums and cross-products of x - low over all rows (x: array of longs), as exact Python integers."""
    limbs = (2 * planes - 2) // LIMB + 1
    a, b = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cross, sums = np.zeros((limbs, width, width), np.int64), np.zeros(width, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                packed = sliced(_rows(batch.column(0).slice(at, ROWS), width) - low, planes)
                cross_counts(packed, cross)
                sums += plane_sums(packed)
        for limb in range(limbs):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), limb)), pa.array(cross[limb][a, b])], ["a", "b", "limb", "value"])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(np.full(width, -1)), pa.array(np.zeros(width, np.int64)), pa.array(sums)], ["a", "b", "limb", "value"])

    found = data.select("x").mapInArrow(run, "a long, b long, limb long, value long").groupBy("a", "b", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    sums, cross = [0] * width, [[0] * width for _ in range(width)]
    for r in found.collect():  # width^2 / 2 rows a limb
        if r["b"] < 0:
            sums[r["a"]] = int(r["value"])
        else:
            cross[r["a"]][r["b"]] += int(r["value"]) << (LIMB * r["limb"])
    return sums, cross


def components(n: int, sums: list[int], cross: list[list[int]], most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues by fall, unit eigenvectors as columns (largest entry positive), and the trace of the covariance."""
    width = len(sums)
    v = np.zeros((width, width))
    for a in range(width):
        for b in range(a, width):
            v[a, b] = v[b, a] = (n * cross[a][b] - sums[a] * sums[b]) / (n * n)  # division of integers: rounded once
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    top = np.abs(vectors).argmax(0)
    return values, vectors * np.sign(vectors[top, np.arange(vectors.shape[1])]), math.fsum(v.diagonal())


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def whiten(vectors: DataFrame, most: int = 8, scale: int = 1024, shift: int = 100_000, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained, identity_error and deviation_exact: a row for each remaining vector and component."""
    spark = vectors.sparkSession
    given = vectors.select(F.col(key).alias("key"), F.col(column).cast("array<double>").alias("v")).where(finite("v"))
    n, width, least, low, high = given.agg(F.count("*"), F.max(F.size("v")), F.min(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    kind = given.schema["key"].dataType
    schema = with_key(key, kind, "component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)")
    if not n or not width:
        return spark.createDataFrame([], schema)
    if width > WIDTH:
        raise ValueError(f"vectors have more than {WIDTH} entries")
    if least < width:  # padding
        low, high = min(low, 0.0), max(high, 0.0)
    if max(abs(low), abs(high)) * scale >= 2.0**40:
        raise ValueError("entries are too large for exact sums")
    low, high = math.floor(scale * low) + shift, math.floor(scale * high) + shift

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _integers(batch.column(1), width, scale, shift)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), width).cast(pa.list_(pa.int64()))], ["key", "x"])

    data = written(given.mapInArrow(integers, with_key("key", kind, "x array<bigint>")))
    sums, cross = scatter(data, width, low, max(1, (high - low).bit_length()))
    values, axes, trace = components(n, sums, cross, most)
    sound = values > EPS * trace if trace > 0 else np.zeros(len(values), bool)
    sizes = np.where(sound, 1 / np.sqrt(np.where(sound, values, 1.0)), np.nan)
    wide = n * (high - low) >= 2**62 or width * (n * (high - low)) ** 2 >= 2**63  # beyond: Python's integers
    sums = np.array(sums, object if wide else np.int64)

    def projected(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """n x - S and the whitened components of a batch."""
        x = _rows(batch.column(batch.schema.get_field_index("x")), width) - low
        off = n * (x.astype(object) if wide else x) - sums
        return off, (off / n).astype(float) @ axes * sizes

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, w = projected(batch)
            yield pa.RecordBatch.from_arrays([pa.array(w[:, i]) for i in range(w.shape[1])], [f"w{i}" for i in range(w.shape[1])])

    pairs = [(i, j) for i in np.flatnonzero(sound).tolist() for j in np.flatnonzero(sound).tolist() if i <= j]
    error = None
    if pairs:
        measured = data.select("x").mapInArrow(scored, ", ".join(f"w{i} double" for i in range(len(values))))
        spread = measured.agg(*[F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs]).first()
        error = max(abs(s - (i == j)) for s, (i, j) in zip(spread, pairs, strict=True))
    number = np.arange(1, len(values) + 1, dtype=np.int32)
    share = [float(v / trace) if trace > 0 else None for v in values]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                off, w = projected(some)
                each = np.repeat(np.arange(len(w)), len(number))
                deviation = (off**2).sum(1)
                exact = pa.array([str(d) for d in deviation] if wide else [None] * len(w), pa.string())
                short = pa.array([d if d < 2**63 else None for d in deviation.tolist()] if wide else deviation, pa.int64())
                whitened = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(each)), pa.array(np.tile(number, len(w))), short.take(pa.array(each)), whitened, exact.take(pa.array(each))], ["key", "component", "deviation", "whitened", "exact"])

    out = data.mapInArrow(rows, with_key("key", kind, "component int, deviation long, whitened double, exact string"))
    explained = F.array(*[F.lit(s).cast("double") for s in share])[F.col("component") - 1]
    exact = F.coalesce(F.col("exact").try_cast("decimal(38,0)"), F.col("deviation").cast("decimal(38,0)"))
    return out.select(F.col("key").alias(key), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"), exact.alias("deviation_exact"))
