"""Session helpers shared by the bench, the tests and the examples."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, name: str = "groundspark") -> SparkSession:
    """A local session with the settings the library is tuned for (AQE on, UTC, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("GROUNDSPARK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def on_workers_path(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever the driver was started (clusters ship it by --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; the path may be in any store that Spark reads."""
    on_workers_path(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FOLDERS: dict[str, str] = {}  # application id -> temporary folder of a local session without spark.checkpoint.dir


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, else the one given to setCheckpointDir.

    Where neither is set, a local session (tests, one machine) gets a temporary folder of its own; a cluster, whose
    executors can't see such a folder, gets an error.
    """
    context = spark.sparkContext
    if path := spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir():
        return path
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _FOLDERS:
        _FOLDERS[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='groundspark-')}"
    return _FOLDERS[context.applicationId]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below the one of this application."""
    return f"{shared_folder(spark)}/groundspark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Deletes what this application has written to the shared folder; results that still read it must be stored before."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/groundspark/{context.applicationId}")
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def committed(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the folders below path that Spark has written to their end (they hold its mark _SUCCESS), rising."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    pattern = hadoop(f"{path}/*/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return sorted(int(n) for f in found if (n := f.getPath().getParent().getName()).isdigit())
