"""Deterministic draws, global order and per-group caps: the base of splits, samples and numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundspark.session import shared_path


def draw(seed: int | str, *columns: str | Column) -> Column:
    """A long in 0 .. 2^32 - 1 that depends on the seed and the columns only (md5, so other engines can repeat it)."""
    parts = [F.lit(str(seed))] + [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def global_index(df: DataFrame, *order: Column, name: str = "idx", partitions: int | None = None, weight: Column | None = None) -> DataFrame:
    """df with the row's place (from 0) in the global order, or the weights (whole numbers) of the rows before it; order must be unique.

    Range partitions are sorted and numbered alone and moved on by the sizes of those before, so no task holds all rows.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy("__p").agg(F.sum(weight).alias("n") if weight is not None else F.count("*").alias("n")).orderBy("__p").collect()  # one row a partition
    before, at = {}, 0
    for r in sizes:
        before[r["__p"]] = at
        at += r["n"]
    start = F.try_element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("__p")) if before else F.lit(0)
    w = Window.partitionBy("__p").orderBy(*order)
    local = F.coalesce(F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) if weight is not None else F.row_number().over(w) - 1
    return ranged.withColumn(name, (local + start).cast("long")).drop("__p")


def cap_per_group(df: DataFrame, keys: list[str], n: int, *order: Column, name: str | None = None) -> DataFrame:
    """The first n rows of each group, with their rank from 1 as name if asked for.

    A plain rank with a limit: Spark cuts every group to n in each task before the shuffle (WindowGroupLimit, for n up to
    spark.sql.optimizer.windowGroupLimitThreshold, 1000), so of a hot group n rows a task arrive in one place.
    """
    rank = name or "__r"
    cut = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)
    return cut if name else cut.drop(rank)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: made once, and kept when an executor is lost."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
