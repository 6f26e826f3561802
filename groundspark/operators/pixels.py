"""Packed masks as binary columns: normalising, geometry and pooling in Arrow batches (pixels are never exploded)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normalize_mask(df: DataFrame, h: int = 224, w: int = 224) -> DataFrame:
    """Key, mask (one byte a pixel, 0 or 1) of h x w by nearest neighbour. Input: key, data, height, width; bytes over 127, or over 0 where the largest is 1, are set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, y, x in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                a = np.frombuffer(data, np.uint8).reshape(y, x)
                on = a > 0 if a.max(initial=0) <= 1 else a > 127
                out.append(on[(np.arange(h) * y // h)[:, None], (np.arange(w) * x // w)[None, :]].astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["key", "mask"])

    return df.select("key", "data", "height", "width").mapInArrow(run, f"key {df.schema['key'].dataType.simpleString()}, mask binary")


def packed_geometry(df: DataFrame, h: int, w: int) -> DataFrame:
    """Key, area, area_frac, fill, aspect, compactness, cx, cy of packed masks."""
    names = ["area", "area_frac", "fill", "aspect", "compactness", "cx", "cy"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(1).to_pylist():
                a = np.frombuffer(data, np.uint8).reshape(h, w) > 0
                y, x = np.nonzero(a)
                if not len(y):
                    rows.append([0.0] * len(names))
                    continue
                bh, bw = np.ptp(y) + 1, np.ptp(x) + 1
                p = np.pad(a, 1)
                inner = p[1:-1, 1:-1] & p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
                edge = max(1, int(a.sum() - inner.sum()))
                rows.append([len(y), len(y) / (h * w), len(y) / (bh * bw), max(bh, bw) / min(bh, bw), 4 * np.pi * len(y) / edge**2, x.mean(), y.mean()])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([float(r[i]) for r in rows]) for i in range(len(names)))], ["key", *names])

    return df.select("key", "mask").mapInArrow(run, f"key {df.schema['key'].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in names))


def masked_pool(cells: DataFrame, weights: DataFrame) -> DataFrame:
    """Sample, k, v: mean of the cells' features (sample, cell, f: array) weighted by each mask (sample, k, cell, w), over max(sum w, 1e-6)."""
    j = weights.join(cells, ["sample", "cell"]).select("sample", "k", "w", F.posexplode("f").alias("d", "x"))
    g = j.groupBy("sample", "k", "d").agg((F.sum(F.col("x") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1e-6))).alias("x"))
    return g.groupBy("sample", "k").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("v"))


def area_means(masks: np.ndarray, h: int, w: int) -> np.ndarray:
    """(n, H, W) -> (n, h, w): means over the cells from floor(i H / h) to ceil((i + 1) H / h), read from a summed-area table."""
    n, big_h, big_w = masks.shape
    table = np.zeros((n, big_h + 1, big_w + 1))
    table[:, 1:, 1:] = masks.cumsum(1).cumsum(2)
    y0, y1 = np.arange(h) * big_h // h, -(-(np.arange(h) + 1) * big_h // h)
    x0, x1 = np.arange(w) * big_w // w, -(-(np.arange(w) + 1) * big_w // w)
    at = lambda y, x: table[:, y[:, None], x[None, :]]
    return (at(y1, x1) - at(y0, x1) - at(y1, x0) + at(y0, x0)) / ((y1 - y0)[:, None] * (x1 - x0)[None, :])


def _between(size: int, to: int) -> np.ndarray:
    """(to, size): weights of linear interpolation with the pixels' centres as points."""
    at = np.maximum((np.arange(to) + 0.5) * size / to - 0.5, 0)
    low = np.minimum(at.astype(int), size - 1)
    out = np.zeros((to, size))
    np.add.at(out, (np.arange(to), low), 1 - (at - low))
    np.add.at(out, (np.arange(to), np.minimum(low + 1, size - 1)), at - low)
    return out


def resampled(masks: np.ndarray, h: int, w: int) -> np.ndarray:
    """Soft masks at another size: area means when shrinking in both directions, else linear in both."""
    if masks.shape[1:] == (h, w):
        return masks
    if masks.shape[1] >= h and masks.shape[2] >= w:
        return area_means(masks, h, w)
    return _between(masks.shape[1], h) @ masks @ _between(masks.shape[2], w).T


def ring_of(masks: np.ndarray, ring: int) -> np.ndarray:
    """Largest soft value within ring cells, less the own: a running maximum along rows, then along columns."""
    wide = masks
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (ring, ring)
        p, size = np.pad(wide, pad, constant_values=-np.inf), wide.shape[axis]
        wide = np.maximum.reduce([p.take(range(i, i + size), axis) for i in range(2 * ring + 1)])
    return np.clip(wide - masks, 0, 1)


def pool_packed(df: DataFrame, shape: tuple[int, int, int], size: tuple[int, int], ring: int = 0) -> DataFrame:
    """Key, k (place of the mask), pooled, context and mass of packed maps and masks, in one Arrow pass.

    df: key, fmap (array: channels, rows, columns of shape in a row), masks (array of arrays of weights 0 .. 1, rows and columns of
    size in a row; weights beyond are clamped). Masks are brought to the map's size. pooled: the map's mean by the mask's weights,
    over max(sum, 1e-6); context: the same by the ring round it (null without a ring); mass: sum of the weights. Rows whose map or
    one of whose masks lacks or has another size take no part.
    """
    c, h, w = shape
    fits = F.size("fmap") == c * h * w
    whole = F.forall("masks", lambda m: m.isNotNull() & (F.size(m) == size[0] * size[1]))
    given = df.where(F.coalesce(fits & whole, F.lit(False))).select("key", F.col("fmap").cast("array<double>").alias("fmap"), F.col("masks").cast("array<array<double>>").alias("masks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                maps = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, c, h * w)
                counts = part.column(2).value_lengths().to_numpy(zero_copy_only=False)
                flat = part.column(2).flatten().flatten().to_numpy(zero_copy_only=False)
                soft = resampled(np.clip(np.nan_to_num(flat.reshape(-1, *size)), 0, 1), h, w)
                row = np.repeat(np.arange(part.num_rows), counts)
                pool = lambda m: np.einsum("kp,kcp->kc", m.reshape(len(m), -1), maps[row]) / np.maximum(m.sum((1, 2)), 1e-6)[:, None]  # noqa: B023, E731
                lists = lambda v: pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), c).cast(pa.list_(pa.float64()))
                k = np.concatenate([np.arange(n) for n in counts]) if len(counts) else np.zeros(0, int)
                context = lists(pool(ring_of(soft, ring))) if ring > 0 else pa.nulls(len(row), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(k.astype(np.int32)), lists(pool(soft)), context, pa.array(soft.sum((1, 2)))], ["key", "k", "pooled", "context", "mass"])

    return given.mapInArrow(run, f"key {df.schema['key'].dataType.simpleString()}, k int, pooled array<double>, context array<double>, mass double")


def context_ring(df: DataFrame, h: int, w: int, ring: int = 2) -> DataFrame:
    """Key, ring (array of weights 0 .. 1) of the cells within some cells round each soft mask (key, mask: array of h x w weights); zeros with a ring of 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            soft = np.clip(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, h, w), 0, 1)
            out = ring_of(soft, ring) if ring > 0 else np.zeros_like(soft)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), h * w).cast(pa.list_(pa.float64()))], ["key", "ring"])

    given = df.where(F.coalesce((F.size("mask") == h * w) & F.forall("mask", lambda x: x.isNotNull()), F.lit(False)))
    return given.select("key", F.col("mask").cast("array<double>").alias("mask")).mapInArrow(run, f"key {df.schema['key'].dataType.simpleString()}, ring array<double>")


def select_nouns(tagged: DataFrame, vocab: DataFrame, most: int = 5, tags: tuple[str, ...] = ("NOUN", "PROPN")) -> DataFrame:
    """Key, lemma, place: the first nouns of a text (key, i, lemma, tag, is_stop) in the vocabulary, each once, two letters or more."""
    from pyspark.sql import Window

    ok = tagged.where(F.col("tag").isin(list(tags)) & ~F.col("is_stop") & (F.length("lemma") >= 2)).join(vocab.select(F.col("token").alias("lemma")), "lemma", "left_semi")
    once = ok.groupBy("key", "lemma").agg(F.min("i").alias("i"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("i"))).where(F.col("place") <= most).select("key", "lemma", "place")


def frame_numbers(df: DataFrame, videos: DataFrame) -> DataFrame:
    """Video frame number of each frame row: int(timestamp * rate) of its video."""
    return df.join(videos.select("video_filename", "rate"), "video_filename").withColumn("video_frame", (F.col("timestamp") * F.col("rate")).cast("int")).drop("rate")
