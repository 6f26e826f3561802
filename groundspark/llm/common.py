"""Small helpers of the operators: written intermediate tables, string columns as bytes, row slices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundspark.session import shared_path


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: it survives lost executors and is made once."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of fewer rows than Spark's 10,000, which are too large for whole texts; a value that the user has set stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def free_name(df: DataFrame, name: str) -> str:
    """name, made longer until no column of df has it."""
    while name in df.columns:
        name += "_"
    return name


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 of a string column."""
    return column.cast(pa.binary()).to_pylist()


def words(text: bytes | None) -> list[bytes]:
    """[^\\x20\\x09-\\x0D]+ of a text: bytes.split() cuts at just these six."""
    return text.split() if text else []


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about most in sum, each of one row at least."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total + n > most and i > start:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def finite(column: str) -> Column:
    """True where an array of numbers is there and holds neither nulls nor non-finite entries."""
    return F.coalesce(F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def list_matrix(column: pa.Array, width: int) -> np.ndarray:
    """Arrays of doubles as rows, padded by zeros."""
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def with_key(name: str, kind: T.DataType, rest: str) -> T.StructType:
    """A schema of a key column and what rest, as DDL, has after it."""
    return T.StructType([T.StructField(name, kind), *T.StructType.fromDDL(rest).fields])
