"""Session settings and the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


_own: list[str] = []


def local_session(cores: int = 8, name: str = "tidemark") -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset (tests on one machine) a temporary
    folder is made, set for checkpoints, and removed at exit; a cluster must set it."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="tidemark-"))
            atexit.register(shutil.rmtree, _own[0], True)
        named = _own[0]
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


def shared_path(spark: SparkSession, what: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df):
    """``df`` with its lineage cut. A checkpoint would work out the rows twice, once to count them and
    once to write them; a written table does it once."""
    return written(df, "cut")


def written(df, what: str, partition_by: list[str] | None = None):
    """``df`` written once to the shared folder as Parquet and read again: a stage that several
    consumers share without recomputing it, and that survives the loss of executors."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    w = df.write
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
