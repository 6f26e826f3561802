"""Training-corpus pipeline: toxicity, near duplicates, benchmark leaks, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as
the next stage's docs. All but the last return the columns of documents. Decisions are on rows, not
on ids: rows of one doc_id, or of none, are judged each by its own text. Of rows that agree in all
columns the near-duplicate stage keeps one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.llm import decontaminate, pieces, secrets, simhash, toxicity
from groundspark.llm.common import written
from groundspark.llm.queries import piece_model
from groundspark.session import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject; it learns from labelled rows of its own input that aren't held out."""
    model = toxicity.train(toxicity.train_rows(docs, table(spark, sf_dir, "labels")).where(~toxicity.held_out()))
    return toxicity.score(docs.select(*COLUMNS), model, "__score", with_text=True).where("predicted = 0").select(*COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group that SimHash links connect: that of the smallest doc_id (rows without one come last), then of the smallest hash."""
    order = F.struct(F.col("doc_id").isNull().alias("loose"), "doc_id", F.xxhash64(*COLUMNS).alias("h1"), F.xxhash64(F.lit(1), *COLUMNS).alias("h2"))
    keyed = docs.select(*COLUMNS, order.alias("place"))
    first = simhash.near_duplicates(keyed, "place").where("place = component_id").select("place").distinct()
    return keyed.join(first, "place", "left_semi").dropDuplicates(["place"]).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item."""
    keyed = docs.select(*COLUMNS, F.struct(F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")).alias("place"))
    leaks = decontaminate.contaminated(keyed, table(spark, sf_dir, "benchmark"), "place").select("place").distinct()
    return keyed.join(leaks, "place", "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with what the forest takes for secrets replaced; n_chars follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    return pieces.digests(docs, piece_model())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("pieces", tokenize),
]

ORACLE_SQL = None  # automata, forests and merges aren't SQL; tests/llm checks the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
