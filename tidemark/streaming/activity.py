"""Activity as streams: capture, windowed counts, sessions."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.session import shared_path


def read_log(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 4) -> DataFrame:
    """A log table as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    r = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    if os.path.isdir(path):
        return r.parquet(path)
    return r.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def run_once(df: DataFrame, mode: str, what: str, keys: list[str] | None = None) -> DataFrame:
    """Process everything that is there and return the sink's content. Complete results replace each
    other; of updates, which a batch has only for what it touched, the newest row per ``keys`` counts;
    appended ones go to Parquet with a checkpoint, both in the shared folder."""
    if mode == "update" and not keys:
        raise ValueError("updates need the keys of their rows")
    spark = df.sparkSession
    out, state = shared_path(spark, what), shared_path(spark, f"{what}-state")
    if mode == "append":
        df.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    else:
        def put(batch: DataFrame, no: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch_no={no}")
            last.append(f"{out}/batch_no={no}")

        last: list[str] = []
        df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        if not last:
            return spark.createDataFrame([], df.schema)
        if mode == "update":
            got = spark.read.schema(StructType([*df.schema, StructField("batch_no", LongType())])).parquet(out)
            newest = got.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), "batch_no").alias("newest"))
            return newest.select("newest.*")
        out = last[-1]
    return spark.read.schema(df.schema).parquet(out)


def capture(events: DataFrame) -> DataFrame:
    """Tool events as interactions: reads and edits of known files, one row per chunk of the file."""
    kind = F.when(F.col("tool") == "Read", "read").when(F.col("tool").isin("Edit", "Write"), "edit")
    return events.withColumn("interaction", kind).where("interaction IS NOT NULL")


def windowed_counts(log: DataFrame, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """Interactions per project and window; rows later than ``late`` are left out of append output."""
    t = log.where("timestamp >= TIMESTAMP_NTZ '2000-01-01 00:00:00'").withColumn("t", F.col("timestamp").cast("timestamp"))
    w = t.withWatermark("t", late).groupBy(F.window("t", width).alias("w"), "project_id")
    got = w.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("interaction") == "read").alias("reads"))
    return got.select("project_id", F.col("w.start").cast("timestamp_ntz").alias("day"), "total", "reads")


def hot_files(log: DataFrame) -> DataFrame:
    """Running totals per file."""
    n = lambda k: F.count_if(F.col("interaction") == k)
    return log.groupBy("project_id", "file_path").agg(n("read").alias("reads"), n("edit").alias("edits"), F.count(F.lit(1)).alias("total"))


def first_and_last(log: DataFrame) -> DataFrame:
    """First, last and number of interactions per project and kind, kept as custom state; each batch
    emits the state of the groups it touched."""

    def step(key, batches, state: GroupState):
        lo, hi, n = state.get if state.exists else (None, None, 0)
        for pdf in batches:
            us = pdf["us"]
            lo = int(us.min()) if lo is None else min(lo, int(us.min()))
            hi = int(us.max()) if hi is None else max(hi, int(us.max()))
            n += len(pdf)
        state.update((lo, hi, n))
        yield pd.DataFrame({"project_id": [key[0]], "interaction": [key[1]], "first_us": [lo], "last_us": [hi], "n": [n]})

    rows = log.where("timestamp IS NOT NULL AND project_id IS NOT NULL AND interaction IS NOT NULL").select("project_id", "interaction", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("us"))
    return rows.groupBy("project_id", "interaction").applyInPandasWithState(
        step, "project_id string, interaction string, first_us bigint, last_us bigint, n bigint", "lo bigint, hi bigint, n bigint", "update", GroupStateTimeout.NoTimeout)
