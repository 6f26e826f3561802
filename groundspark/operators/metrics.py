"""Counts, inequality measures, weighted means and accuracies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_counts(df: DataFrame, label: str) -> DataFrame:
    """D1."""
    return df.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label)


def histogram(df: DataFrame, value: Column) -> DataFrame:
    """Size, n for every size from 0 to the largest."""
    counts = df.groupBy(value.cast("int").alias("size")).agg(F.count("*").alias("n")).where("size is not null")
    all_ = counts.agg(F.max("size").alias("m")).where("m is not null").select(F.explode(F.sequence(F.lit(0), "m")).alias("size"))
    return all_.join(counts, "size", "left").select("size", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def gini(counts: DataFrame, value: str, *keys: str, empty: float = 0.0) -> DataFrame:
    """D3: Gini coefficient of the counts of each key (all counts share a key where none is given); empty (0, or NaN) where there are none or their sum is zero.

    Equal counts are one row with their number, so a window holds distinct counts only, however many concepts there are.
    """
    keys = list(keys) or ["__all"]
    d = counts.withColumn("__all", F.lit(1)).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("m"))
    before = F.sum("m").over(Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")
    ranks = F.col("m") * F.col("before") + F.col("m") * (F.col("m") + 1) / 2  # sum of the ranks of equal counts
    n, s = F.sum("m"), F.sum(F.col("v") * F.col("m"))
    g = F.when(s > 0, (2 * F.sum(ranks * F.col("v")) / (n * s)) - (n + 1) / n).otherwise(F.lit(empty))
    ranked = d.withColumn("before", before)
    return ranked.agg(g.alias("gini")) if keys == ["__all"] else ranked.groupBy(*keys).agg(g.alias("gini"))


RUN = 100_000  # equal counts that one row stands for when points are made


def lorenz(counts: DataFrame, value: str) -> DataFrame:
    """D3: n + 1 points (x, y) of the Lorenz curve. Only distinct counts are put in order; each point follows from its place among equals, which are dealt out in runs."""
    d = counts.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("m"))
    w = Window.partitionBy(F.lit(1)).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("upto", F.sum("m").over(w)).withColumn("sum", F.sum(F.col("v") * F.col("m")).over(w))
    whole = counts.agg(F.sum(value).alias("__s"), F.count("*").alias("__n"))
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = d.crossJoin(F.broadcast(whole)).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / RUN))))  # whole is one row
    each = runs.repartition(tasks, "v", "run").withColumn("i", F.explode(F.sequence(F.col("run") * RUN + 1, F.least((F.col("run") + 1) * RUN, "m"))))
    back = F.col("m") - F.col("i")
    points = each.select(((F.col("upto") - back) / F.col("__n")).alias("x"), F.try_divide(F.col("sum") - back * F.col("v"), F.col("__s")).cast("double").alias("y"))
    return points.union(whole.select(F.lit(0.0), F.lit(0.0)))


def effective_number(counts: DataFrame, value: str, kind: str = "inverse") -> DataFrame:
    """1 / sum(p^2), or exp(entropy) with kind 'entropy'."""
    s = counts.agg(F.sum(value).alias("s"))
    p = F.col(value) / F.col("s")
    rows = counts.where(F.col(value) > 0).crossJoin(F.broadcast(s))
    out = F.try_divide(F.lit(1.0), F.sum(p * p)) if kind == "inverse" else F.exp(-F.sum(p * F.log(p)))
    return rows.agg(out.alias("effective"))


def medians(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Lower and middle median."""
    return df.groupBy(*keys).agg(F.expr(f"percentile_disc(0.5) within group (order by {value})").alias("lower_median"), F.median(value).alias("median"))


def weighted_metrics(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Weighted mean (rows without a value count for nothing; no rows: 0) and its exponential."""
    ok = F.col(value).isNotNull()
    mean = F.coalesce(F.try_divide(F.sum(F.when(ok, F.col(value) * F.col(weight))), F.sum(F.when(ok, F.col(weight)))), F.lit(0.0))
    return df.groupBy(*keys).agg(mean.alias("mean"), F.exp(mean).alias("perplexity"))


def stage_metrics(outputs: DataFrame) -> DataFrame:
    """Stage, metric, value of batch outputs (stage, batch_size, n_tokens, values: map of metric to value).

    Metrics weigh by examples, ce_loss by tokens; its exponential is the perplexity. Batches without a metric don't count for it; one that no batch of a stage has isn't given.
    """
    rows = outputs.select("stage", "batch_size", "n_tokens", F.explode("values").alias("metric", "value")).withColumn("weight", F.when(F.col("metric") == "ce_loss", F.col("n_tokens")).otherwise(F.col("batch_size")))
    m = weighted_metrics(rows.where("value is not null"), ["stage", "metric"], "value", "weight")
    return m.select("stage", "metric", F.col("mean").alias("value")).unionByName(m.where("metric = 'ce_loss'").select("stage", F.lit("perplexity").alias("metric"), F.col("perplexity").alias("value")))


def accuracy_report(df: DataFrame, *keys: str) -> DataFrame:
    """Class, correct, total, accuracy, with class null for the overall row, and macro (mean over classes) there."""
    c = F.col("correct").cast("long")
    by = df.groupBy(*keys, "class").agg(F.sum(c).alias("correct"), F.count("*").alias("total")).withColumn("accuracy", F.try_divide(F.col("correct"), F.col("total")))
    one = by.select(*keys, "class", "correct", "total", "accuracy", F.lit(None).cast("double").alias("macro"))
    all_ = by.groupBy(*keys).agg(F.lit(None).cast("string").alias("class"), F.sum("correct").alias("correct"), F.sum("total").alias("total"), F.try_divide(F.sum("correct"), F.sum("total")).alias("accuracy"), F.avg("accuracy").alias("macro"))
    return one.unionByName(all_)


def label_sources(df: DataFrame, label: str, source: str) -> DataFrame:
    """Sorted distinct sources of each label."""
    return df.groupBy(label).agg(F.sort_array(F.collect_set(source)).alias("sources"))


def distance_stats(df: DataFrame, concept: str, distance: str) -> DataFrame:
    """N, mean, median, min, max of a distance, overall (concept null) and by concept from 0."""
    stats = [F.count("*").alias("n"), F.avg(distance).alias("mean"), F.median(distance).alias("median"), F.min(distance).alias("min"), F.max(distance).alias("max")]
    by = df.where(F.col(concept) >= 0).groupBy(concept).agg(*stats)
    return by.unionByName(df.agg(F.lit(None).cast(df.schema[concept].dataType).alias(concept), *stats))
