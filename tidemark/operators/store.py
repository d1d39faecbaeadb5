"""Changes to tables as functions from tables to tables."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql.types import StringType
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.session import shared_path


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with equal keys. Of several new rows with
    one key the one with the greatest ``order`` counts (any one without it)."""
    if order:
        new = new.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
    else:
        new = new.dropDuplicates(keys)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """The table and the rows really added: the first new row of each key that is not there yet."""
    first = new.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")
    added = first.join(old.select(*keys).distinct(), keys, "left_anti")
    return old.unionByName(added.select(*old.columns)), added


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Nulls of the named columns replaced."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def delete_where_in(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows without a match in ``keys``."""
    return df.join(keys.select(*on).distinct(), on, "left_anti")


def delete_files(chunks: DataFrame, edges: DataFrame, vectors: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks of the given files go, and with them their vectors and edges at either end."""
    gone = chunks.join(files.select("project_id", "file_path").distinct(), ["project_id", "file_path"], "left_semi").select("id")
    kept = edges
    for end in ("source_id", "target_id"):
        kept = kept.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return delete_where_in(chunks, files, ["project_id", "file_path"]), kept.select(*edges.columns), vectors.join(gone, "id", "left_anti")


def expire(df: DataFrame, time: str, as_of: str, days: int) -> DataFrame:
    """Rows not older than ``days``; rows without a time stay."""
    return df.where(F.col(time).isNull() | (F.col(time) >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")))


def purge_orphans(log: DataFrame, chunks: DataFrame) -> DataFrame:
    """Log rows whose chunk is there."""
    return log.join(chunks.select(F.col("id").alias("chunk_id")).distinct(), "chunk_id", "left_semi").select(*log.columns)


def merge_patch(target, patch):
    """A JSON merge patch: objects merge by key, null removes, anything else replaces."""
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merge_patch(out.get(k), v)
    return out


def _object(text) -> dict:
    try:
        found = json.loads(text) if text else {}
    except ValueError:
        found = {}
    return found if isinstance(found, dict) else {}


_plain_json = json.JSONEncoder(separators=(",", ":"), ensure_ascii=False).encode


@F.pandas_udf(StringType())
def json_patch(target: pd.Series, patch: pd.Series) -> pd.Series:
    """Merge patch on JSON texts, with the types of their values; a null patch changes nothing, text that
    is no JSON object counts as {}."""
    return pd.Series([t if p is None else _plain_json(merge_patch(_object(t), _object(p))) for t, p in zip(target, patch)], dtype=object)


@F.pandas_udf(StringType())
def shallow_update(target: pd.Series, patch: pd.Series) -> pd.Series:
    """JSON objects with the top-level keys of others put in their place, types and nulls kept; otherwise
    as ``json_patch``."""
    return pd.Series([t if p is None else _plain_json(_object(t) | _object(p)) for t, p in zip(target, patch)], dtype=object)


def delete_edges(edges: DataFrame, ids: DataFrame, edge_type: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges without those that have a chunk of ``ids`` (id) at either end, all or of one type; and how
    many went: ``n``. An edge with such chunks at both ends went once."""
    gone = ids.select("id").distinct().withColumn("_gone", F.lit(True))
    marked = edges
    for end in ("source_id", "target_id"):
        marked = marked.join(gone.select(F.col("id").alias(end), F.col("_gone").alias(f"_{end}")), end, "left")
    hit = F.col("_source_id").isNotNull() | F.col("_target_id").isNotNull()
    if edge_type is not None:
        hit = hit & (F.col("edge_type") == edge_type)
    hit = F.coalesce(hit, F.lit(False))
    return marked.where(~hit).select(*edges.columns), marked.where(hit).agg(F.count(F.lit(1)).alias("n"))


def delete_project_edges(edges: DataFrame, chunks: DataFrame, project: str, edge_type: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``delete_edges`` for all chunks of a project."""
    return delete_edges(edges, chunks.where(F.col("project_id") == project), edge_type)


def set_values(values: DataFrame, new: dict[str, str]) -> DataFrame:
    """A table of ``key, value`` with the given values set."""
    return upsert(values, values.sparkSession.createDataFrame(sorted(new.items()), "key string, value string"), ["key"])


def mark_indexed(projects: DataFrame, project: str, as_of: str, commit: str | None = None) -> DataFrame:
    """Projects with the time of an index run; the commit is only replaced if there is one."""
    own = F.col("id") == project
    new = {"last_indexed": F.when(own, F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("last_indexed"))}
    if commit:
        new["last_indexed_commit"] = F.when(own, F.lit(commit)).otherwise(F.col("last_indexed_commit"))
    return projects.withColumns(new)


def clear_git(commits: DataFrame, changes: DataFrame, sync: DataFrame, project: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The commit tables without one project's rows."""
    return tuple(df.where(~F.col("project_id").eqNullSafe(project)) for df in (commits, changes, sync))


def with_ids(df: DataFrame, order: list[str], after: int = 0) -> DataFrame:
    """``df`` with consecutive ids above ``after`` in the given order. Sorted ranges are written in
    parallel; a range's first id follows from the sizes of those before it, and a row's place in its file
    from the file."""
    spark = df.sparkSession
    path = shared_path(spark, "numbered")
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = sorted((r["_file"], r["n"]) for r in back.groupBy("_file").agg(F.count(F.lit(1)).alias("n")).collect())  # one row a file
    first, rows = after, []
    for name, n in sizes:
        rows.append((name, first))
        first += n
    starts = spark.createDataFrame(rows, "_file string, _first bigint")
    return back.join(F.broadcast(starts), "_file").select((F.col("_first") + F.col("_row") + 1).alias("id"), *df.columns)


def file_status(scan: DataFrame, index: DataFrame) -> DataFrame:
    """``project_id, file_path, status``: new, changed, deleted or same, from two tables of
    ``project_id, file_path, file_hash`` with one row per file."""
    s, i = scan.withColumnRenamed("file_hash", "now"), index.withColumnRenamed("file_hash", "then")
    j = s.join(i, ["project_id", "file_path"], "full")
    status = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("then"), "changed").otherwise("same")
    return j.select("project_id", "file_path", status.alias("status"))


def assert_parity(chunks: DataFrame, vectors: DataFrame) -> None:
    """Raises if chunks and vectors do not belong together one to one."""
    a, b = chunks.join(vectors, "id", "left_anti").limit(1).count(), vectors.join(chunks, "id", "left_anti").limit(1).count()
    if a or b:
        raise ValueError("chunks and vectors differ")
