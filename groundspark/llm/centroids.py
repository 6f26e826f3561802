"""Centroid clustering by bit-plane popcounts.

Components become integers, floor(scale x). Each bit plane of 64 components of a vector is packed into
one uint64 (two's complement: the top plane counts negative), so a vector is a few words, and its dot
product with a centroid is the sum over pairs of planes of their weights times popcount(a & b). Squared
distances follow from dot products alone and are exact. The planes are written once; a round reads
them, and a task returns one row a cluster with count, distances and componentwise sums (bit counts of
its planes, weighted), which Spark adds up. Only the centroids (k rows) are on the driver.

Defined results: vectors that are null, of another width, or hold null or non-finite components take no
part. Rows are vectors on their own: rows of one id, or of none, are each assigned, and ids that lack
come last among the starts. With fewer rows than k there are as many centroids as rows. Equal distances
go to the smaller number. Empty centroids stay. An empty table gives an empty result. Components whose
squared distances could pass 62 bits raise a ValueError before any work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import finite, list_matrix, with_key, written

ROWS = 4096  # of a batch that are compared with the centroids at a time


def plane_weights(planes: int) -> np.ndarray:
    """1, 2, 4, ... and the sign plane's negative weight."""
    w = 1 << np.arange(planes, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def pack(ints: np.ndarray, planes: int) -> np.ndarray:
    """(rows, components) of integers -> (rows, planes, words) of uint64."""
    n, width = ints.shape
    words = -(-width // 64)
    out = np.zeros((n, planes, words * 8), np.uint8)
    for p in range(planes):
        out[:, p, : -(-width // 8)] = np.packbits(((ints >> p) & 1).astype(np.uint8), axis=1, bitorder="little")
    return out.view("<u8")


def unpacked_sums(packed: np.ndarray, width: int) -> np.ndarray:
    """Componentwise sums of packed vectors: weighted counts of their planes' bits."""
    bits = np.unpackbits(packed.view(np.uint8), axis=2, bitorder="little")[:, :, :width]
    return plane_weights(packed.shape[1]) @ bits.sum(0, dtype=np.int64)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact dot products of every packed row of a with every one of b."""
    wa, wb = plane_weights(a.shape[1]), plane_weights(b.shape[1])
    out = np.zeros((len(a), len(b)), np.int64)
    for i in range(a.shape[1]):
        part = np.zeros_like(out)
        for j in range(b.shape[1]):
            for w in range(a.shape[2]):
                part += wb[j] * np.bitwise_count(a[:, i, w, None] & b[None, :, j, w])
        out += wa[i] * part
    return out


def squares(a: np.ndarray) -> np.ndarray:
    """Squared lengths of packed rows, by the same popcounts."""
    w = plane_weights(a.shape[1])
    out = np.zeros(len(a), np.int64)
    for i in range(a.shape[1]):
        for j in range(i, a.shape[1]):
            out += (1 + (i < j)) * w[i] * w[j] * np.bitwise_count(a[:, i] & a[:, j]).sum(1, dtype=np.int64)
    return out


def nearest(packed: np.ndarray, norms: np.ndarray, centroids: np.ndarray, centroid_norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid, the smaller number of equal ones."""
    d = norms[:, None] + centroid_norms[None, :] - 2 * dots(packed, centroids)
    best = d.argmin(1)
    return best, d[np.arange(len(d)), best]


def planes_of(low: int, high: int) -> int:
    """Planes of two's complement that hold low to high."""
    return 1 + max((high if high >= 0 else ~high).bit_length(), (low if low >= 0 else ~low).bit_length())


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, width: int = 64, key: str = "vec_id", column: str = "embedding", seed: int | str = 1) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia and centroid (array of longs) of every vector that takes part."""
    spark = vectors.sparkSession
    given = vectors.select(F.col(key).alias("key"), F.col(column).cast("array<double>").alias("v")).where((F.size("v") == width) & finite("v"))
    bounds = given.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    kind = given.schema["key"].dataType
    schema = with_key(key, kind, "cluster int, distance long, cluster_inertia long, inertia long, centroid array<bigint>")
    if bounds[0] is None:
        return spark.createDataFrame([], schema)
    low, high = (math.floor(scale * x) for x in bounds)
    planes = planes_of(low, high)
    if 2 * planes + (width - 1).bit_length() > 62:
        raise ValueError("components are too large for distances of 62 bits")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = pack(np.floor(scale * list_matrix(batch.column(1), width)).astype(np.int64), planes)
            flat = pa.array(packed.reshape(len(packed), -1).view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(flat, packed.shape[1] * packed.shape[2]).cast(pa.list_(pa.int64()))], ["key", "planes"])

    data = written(given.mapInArrow(encode, with_key("key", kind, "planes array<bigint>")))
    words = -(-width // 64)

    def unflat(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy().view(np.uint64).reshape(-1, planes, words)

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for at in range(0, batch.num_rows, ROWS):
            yield (some := batch.slice(at, ROWS)), unflat(some.column(some.schema.get_field_index("planes")))

    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    starts = data.orderBy(hashed.asc_nulls_last(), "planes").limit(k).select("planes").collect()
    packed = np.array([r[0] for r in starts], np.int64).view(np.uint64).reshape(-1, planes, words)
    centroids = np.array([unpacked_sums(packed[i : i + 1], width) for i in range(len(packed))])

    def totals(centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
        """cluster -> rows, distances and componentwise sums of what is nearest to it."""
        c, cn = pack(centroids, planes), (centroids**2).sum(1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, inertia, sums = (np.zeros(s, np.int64) for s in (len(c), len(c), (len(c), width)))
            for batch in batches:
                for _, x in parts(batch):
                    best, d = nearest(x, squares(x), c, cn)
                    for i in np.unique(best):
                        mine = best == i
                        n[i] += mine.sum()
                        inertia[i] += d[mine].sum()
                        sums[i] += unpacked_sums(x[mine], width)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(c), dtype=np.int32)), pa.array(n), pa.array(inertia), pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), width).cast(pa.list_(pa.int64()))], ["cluster", "n", "d", "s"])

        found = data.select("planes").mapInArrow(run, "cluster int, n long, d long, s array<bigint>").groupBy("cluster")
        return {r[0]: (r[1], r[2], list(r[3:])) for r in found.agg(F.sum("n"), F.sum("d"), *[F.sum(F.col("s")[i]) for i in range(width)]).collect()}

    for _ in range(rounds):
        for i, (n, _, sums) in totals(centroids).items():
            if n:
                centroids[i] = [s // n for s in sums]
    last = totals(centroids)
    inertia = [last[i][1] for i in range(len(centroids))]
    c, cn = pack(centroids, planes), (centroids**2).sum(1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, x in parts(batch):
                best, d = nearest(x, squares(x), c, cn)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(best.astype(np.int32)), pa.array(d)], ["key", "cluster", "distance"])

    out = data.mapInArrow(assign, with_key("key", kind, "cluster int, distance long"))
    of = lambda values: F.array(*[F.lit(v) for v in values])[F.col("cluster")]
    return out.select(F.col("key").alias(key), "cluster", "distance", of(inertia).cast("long").alias("cluster_inertia"), F.lit(sum(inertia)).cast("long").alias("inertia"), of([c.tolist() for c in centroids]).cast("array<bigint>").alias("centroid"))


def digests(embeddings: DataFrame) -> DataFrame:
    """The query: 16 clusters, three rounds, with the hash of each row's centroid."""
    found = cluster(embeddings)
    text = F.array_join(F.col("centroid").cast("array<string>"), ",")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(text, 256).alias("centroid_sha256"))
