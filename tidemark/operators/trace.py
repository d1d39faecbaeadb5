"""Activity analytics over the interaction and search logs. All times are relative to ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def since(c: str, as_of: str, days: int) -> Column:
    """Rows of the last ``days`` days, the border included."""
    return F.col(c) >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")


def take(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows; a negative number means all of them."""
    return df if n < 0 else df.limit(n)


def hot_files(log: DataFrame, as_of: str, days: int = 30, limit: int = 20, project: str | None = None) -> DataFrame:
    """Files by number of interactions."""
    log = log.where(since("timestamp", as_of, days))
    if project is not None:
        log = log.where(F.col("project_id") == project)
    n = lambda k: F.count_if(F.col("interaction") == k)
    got = log.groupBy("project_id", "file_path").agg(n("read").alias("reads"), n("edit").alias("edits"), n("search_hit").alias("searches"), F.count(F.lit(1)).alias("total"))
    return take(got.orderBy(F.desc("total"), F.asc_nulls_last("file_path"), F.asc_nulls_last("project_id")), limit)


def knowledge_gaps(log: DataFrame, as_of: str, days: int = 30, limit: int = 20) -> DataFrame:
    """Queries without results."""
    got = log.where(since("timestamp", as_of, days) & (F.col("result_count") == 0)).groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("last_seen"))
    return take(got.orderBy(F.desc("n"), "query"), limit)


def top_queries(log: DataFrame, as_of: str, days: int = 30, limit: int = 20) -> DataFrame:
    """Queries by frequency, with their average number of results."""
    got = log.where(since("timestamp", as_of, days)).groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("result_count"), 1).alias("avg_results"), F.max("timestamp").alias("last_seen"))
    return take(got.orderBy(F.desc("n"), "query"), limit)


def decaying_files(log: DataFrame, as_of: str, days: int = 30, limit: int = 20) -> DataFrame:
    """Files that were used more than three times in the window before the last one and lost more
    than two thirds of it since."""
    now = since("timestamp", as_of, days)
    before = since("timestamp", as_of, 2 * days) & ~now
    got = log.where(since("timestamp", as_of, 2 * days)).groupBy("project_id", "file_path").agg(F.count_if(before).alias("before"), F.count_if(now).alias("now"))
    ratio = F.col("before") / (F.col("now") + 1)
    got = got.where((F.col("before") > 3) & (ratio > 3)).withColumn("ratio", ratio)
    got = take(got.orderBy(F.desc("ratio"), F.asc_nulls_last("file_path"), F.asc_nulls_last("project_id")), limit)
    return got.withColumn("ratio", F.bround("ratio", 1))


def interaction_counts(log: DataFrame, as_of: str, days: int = 30, kinds: tuple[str, ...] = ("read", "edit"), chunks: DataFrame | None = None, project: str | None = None) -> DataFrame:
    """Interactions per chunk; with a project only those whose chunk still is in it."""
    got = log.where(since("timestamp", as_of, days) & F.col("interaction").isin(*kinds))
    if project is not None:
        got = got.join(chunks.where(F.col("project_id") == project).select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    return got.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))


def project_stats(chunks: DataFrame) -> DataFrame:
    """Chunks by domain and distinct files of each project."""
    return chunks.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("chunk_domain") == "content").alias("content_chunks"),
        F.count_if(F.col("chunk_domain") == "code").alias("code_chunks"), F.countDistinct("file_path").alias("files"))


def file_line_counts(chunks: DataFrame) -> DataFrame:
    """The last line of every file; 0 counts as unknown."""
    return chunks.groupBy("project_id", "file_path").agg(F.nullif(F.max("end_line"), F.lit(0)).alias("lines"))


def edge_stats(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges by type whose source is a chunk of the project."""
    own = chunks.select(F.col("id").alias("source_id"), "project_id")
    return edges.join(own, "source_id").groupBy("project_id", "edge_type").agg(F.count(F.lit(1)).alias("n"))


def recent_searches(log: DataFrame, limit: int = 50) -> DataFrame:
    """The newest rows of the search log."""
    return take(log.orderBy(F.desc_nulls_last("timestamp"), F.desc("id")).select("id", "query", "project_id", "result_count", "timestamp"), limit)


def health(chunks: DataFrame, vectors: DataFrame, log: DataFrame, searches: DataFrame, files: DataFrame) -> DataFrame:
    """One row per check: parity of chunks and vectors, orphans, sizes of the logs."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check_name"), "n")
    parts = [
        count(chunks, "chunks"), count(vectors, "vectors"),
        count(chunks.join(vectors, "id", "left_anti"), "chunks_without_vector"),
        count(vectors.join(chunks, "id", "left_anti"), "vectors_without_chunk"),
        count(log, "interactions"), count(searches, "searches"),
        count(log.where("chunk_id IS NOT NULL").join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti"), "orphan_interactions"),
        count(chunks.join(files.select("project_id", "file_path").distinct(), ["project_id", "file_path"], "left_anti"), "chunks_without_file"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
