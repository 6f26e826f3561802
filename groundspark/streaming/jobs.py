"""Incremental jobs: mask-index ingest with running concept counts, and the online codebook."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.operators import prototypes as G
from groundspark.session import committed


def stream_mask_index(spark: SparkSession, path: str, schema: str, key: list[str], concept: str, watermark: tuple[str, str] | None = None) -> DataFrame:
    """Running counts a concept of JSON lines that come into a folder; repeated keys count once.

    watermark: (event time column, delay) bounds the state of the keys; without it the state holds every key (see ingest_index).
    """
    rows = spark.readStream.schema(schema).json(path)
    if watermark:
        rows = rows.withWatermark(*watermark).dropDuplicatesWithinWatermark(key)
    else:
        rows = rows.dropDuplicates(key)
    return rows.groupBy(concept).agg(F.count("*").alias("n"))


def add_batch(batch: DataFrame, batch_id: int, key: list[str], concept: str, path: str) -> None:
    """The rows of a batch whose key isn't in the index yet, written to path/index/batch_id, then the counts after it to path/counts/batch_id.

    The counts are the commit: what comes later reads only batches that have them, and a batch that is run again reads
    only those before it, so it writes the same tables. The index is scanned, not shuffled, while a batch's keys are few.
    """
    spark = batch.sparkSession
    done = [i for i in committed(spark, f"{path}/counts") if i < batch_id]
    rows = batch.dropDuplicates(key)
    same = lambda a, b: reduce(and_, (a[k].eqNullSafe(b[k]) for k in key))
    if done:
        before = spark.read.schema(batch.schema).parquet(*[f"{path}/index/{i}" for i in done]).select(*key)
        asked = rows.select(*key)
        known = before.join(asked, same(before, asked), "left_semi")
        rows = rows.join(known, same(rows, known), "left_anti")
    rows.write.mode("overwrite").parquet(f"{path}/index/{batch_id}")
    n = spark.read.schema(batch.schema).parquet(f"{path}/index/{batch_id}").groupBy(concept).agg(F.count("*").alias("n"))
    if done:
        n = n.unionByName(spark.read.schema(n.schema).parquet(f"{path}/counts/{done[-1]}")).groupBy(concept).agg(F.sum("n").alias("n"))
    n.write.mode("overwrite").parquet(f"{path}/counts/{batch_id}")


def ingest_index(stream: DataFrame, key: list[str], concept: str, path: str, checkpoint: str):
    """An index without repeated keys and its counts a concept, without state in the stream: what has been seen is the written index itself."""
    return stream.writeStream.foreachBatch(lambda batch, i: add_batch(batch, i, key, concept, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed batches."""
    return spark.read.parquet(*[f"{path}/index/{i}" for i in committed(spark, f"{path}/counts")])


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """The counts after the last committed batch."""
    return spark.read.parquet(f"{path}/counts/{committed(spark, f'{path}/counts')[-1]}")


def stream_ema(stream: DataFrame, start: DataFrame, path: str, checkpoint: str, decay: float = 0.99):
    """The codebook after every batch of objects, written to path/batch_id: a batch that is run again writes the same table."""
    spark = start.sparkSession
    start.write.mode("ignore").parquet(f"{path}/start")

    def update(batch: DataFrame, batch_id: int) -> None:
        before = f"{path}/start" if batch_id == 0 else f"{path}/{batch_id - 1}"
        state = spark.read.parquet(before)
        G.ema_update(state, G.batch_sums(batch, state.select("proto_id", "p")), decay).write.mode("overwrite").parquet(f"{path}/{batch_id}")

    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
