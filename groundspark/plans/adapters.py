"""Projections of the given tables to the inputs of the operators (transcripts, detections, bags, trials ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.functions import vectors as V
from groundspark.operators.util import draw
from groundspark.session import table

CONCEPTS = "the and is in that with of for by to".split()


def transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """conversations as transcript rows: one file a conversation, 17 seconds a turn."""
    c = table(spark, sf, "conversations")
    secs = F.col("turn") * 17
    name = F.format_string("conv_%05d", F.col("conv_id"))
    return c.select(F.concat(name, F.lit(".csv")).alias("transcript_filename"), F.col("turn").alias("row_idx"), F.format_string("%d:%02d", F.floor(secs / 60), (secs % 60).cast("long")).alias("time_raw"), F.col("role").alias("speaker"), F.col("text").alias("utterance"), F.concat(name, F.lit(".mp4")).alias("video_name"))


def frame_events(spark: SparkSession, sf: str) -> DataFrame:
    """events as frame labels: clip = user, frame = place of the event in the user's time order."""
    from pyspark.sql import Window

    e = table(spark, sf, "events")
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select("event_id", F.col("user_id").alias("clip"), idx.cast("long").alias("frame_idx"), F.col("event_type").alias("label"), "value")


def detections(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with part as detections: frame = order, label = part type."""
    li, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    j = li.join(part, li.l_partkey == part.p_partkey)
    return j.select(
        F.col("l_orderkey").alias("frame"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_partkey").alias("det_id"), F.lower("p_type").alias("label"), F.least(F.col("l_discount") * 10, F.lit(1.0)).alias("dino_score"), (F.lit(1.0) - F.col("l_tax")).alias("sam_score"), (F.col("l_quantity") * 200).cast("long").alias("mask_area"),
        (F.col("l_quantity") * 10).alias("w"), (F.col("l_quantity") * 4 + F.col("l_linenumber") * 10).alias("h"), (F.col("l_discount") * 5).alias("clip_sim"),
    )


def objects(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings as objects: obj_id, concept_id, z (array of doubles)."""
    return table(spark, sf, "embeddings").where("vec_id is not null and embedding is not null").select(F.col("vec_id").alias("obj_id"), F.col("label").alias("concept_id"), V.doubles("embedding").alias("z"))


def prototypes(spark: SparkSession, sf: str, k: int = 8) -> DataFrame:
    """The objects with the k lowest ids as a codebook."""
    return objects(spark, sf).where(F.col("obj_id") < k).select(F.col("obj_id").cast("int").alias("proto_id"), F.col("z").alias("p"))


def bags(spark: SparkSession, sf: str) -> DataFrame:
    """objects as bags of candidates: 20 to a sample, in frames of 4."""
    i = F.col("obj_id")
    return objects(spark, sf).select(F.floor(i / 20).alias("sample_id"), F.floor((i % 20) / 4).cast("int").alias("m"), (i % 4).cast("int").alias("k"), "z", (i % 7 != 3).alias("valid"), F.col("concept_id").alias("gid"))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """events as scored trials: run = user parity, class = type, correct = value below 20."""
    e = table(spark, sf, "events")
    return e.select((F.col("user_id") % 2).cast("string").alias("run_id"), F.col("event_id").alias("trial_idx"), F.col("event_type").alias("class"), (F.col("value") < 20).alias("correct"), (draw(1, "event_id") % 2 == 0).alias("in_vocab"))


def instances(spark: SparkSession, sf: str) -> DataFrame:
    """part as labelled instances: label = part type, box from size and price."""
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("instance_id"), F.lower("p_type").alias("raw_label"), F.col("p_name").alias("name"), (F.col("p_partkey") % 90 + 10).cast("double").alias("w"), (F.col("p_partkey") % 70 + 12).cast("double").alias("h"), (F.col("p_partkey") % 11 == 0).cast("int").alias("iscrowd"))
