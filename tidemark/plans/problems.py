"""Queries of the general problems: references, sessions, incremental runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import incremental as inc, references as ref, sessions as ses
from tidemark.session import shared_path
from tidemark.sources.tables import table

KINDS = ["read", "edit", "search_hit"]
EVENT = ("project_id", "timestamp", "interaction", ["chunk_id", "file_path", "source_tool"])
#: Arrival batches that the session table is built from.
BATCHES = 4
#: Arrivals of scan records and commits, each followed by a run.
ARRIVALS = 2


def _reference_tables(spark, d):
    return ref.chunk_reference_tables(*(table(spark, d, t) for t in ("chunks", "chunk_interactions", "search_log", "edges")))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    """Direct and inherited orphans over the whole foreign-key graph: files belong to projects, chunks
    to files, vectors, edges and logs to chunks."""
    ts = lambda c: F.col(c).cast("timestamp")
    path = lambda c: F.concat_ws("|", F.col("project_id"), F.col(c))
    chunks = table(spark, d, "chunks")
    logs = [e for e in _reference_tables(spark, d) if e.name != "chunks"]
    entities = [
        ref.Entity("projects", table(spark, d, "projects").select(F.col("id").alias("key"), F.col("id").alias("project"), F.lit(None).cast("timestamp").alias("time"))),
        ref.Entity("file_index", table(spark, d, "file_index").select(path("file_path").alias("key"), path("file_path").alias("file"), F.col("project_id").alias("project"), ts("last_indexed").alias("time"))),
        ref.Entity("chunks", chunks.select(F.col("id").cast("string").alias("key"), F.col("id").alias("chunk_id"), path("file_path").alias("file"), ts("created_at").alias("time"))),
        ref.Entity("chunks_vec", table(spark, d, "chunks_vec").select(F.col("id").cast("string").alias("key"), F.col("id").alias("chunk_id"), F.lit(None).cast("timestamp").alias("time"))),
        *logs,
    ]
    keys = [
        ref.ForeignKey("file_index", "project", "projects", "project"), ref.ForeignKey("chunks", "file", "file_index", "file"),
        ref.ForeignKey("chunks_vec", "chunk_id", "chunks", "chunk_id"), *ref.CHUNK_KEYS,
    ]
    return ref.orphans(entities, keys)


def _chunk_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Of the cascade's rows those that name a chunk that is not there or came later."""
    return _orphans(spark, d).where("kind = 'direct'").where(F.col("ref_table").isin(*(k.child for k in ref.CHUNK_KEYS)))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """References to chunks that are not there or came later."""
    return _chunk_orphans(spark, d).select("ref_table", "ref_key", F.col("parent_key").cast("bigint").alias("chunk_id"), "period")


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table and month."""
    return ref.orphan_counts(_chunk_orphans(spark, d))


def p2_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Direct and inherited orphans of the whole graph by table, parent, distance and month."""
    return _orphans(spark, d).groupBy("ref_table", "parent_table", "kind", "depth", "period").agg(F.count(F.lit(1)).alias("n_refs"))


def _session_table(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "chunk_interactions")
    store = ses.SessionTable(spark, shared_path(spark, "sessions"), *EVENT, KINDS)
    lo, hi = events.agg(F.min("id"), F.max("id")).first()
    if lo is None:
        return store.sessions()
    step = (hi - lo) // BATCHES + 1
    for k in range(BATCHES):  # the ids are in order of arrival
        store.apply(events.where((F.col("id") >= lo + k * step) & (F.col("id") < lo + (k + 1) * step)))
    return store.sessions()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of every project, built by incremental batches."""
    return _session_table(spark, d).select(F.col("grp").alias("project_id"), "start_us", "end_us", "n_events")


def p6_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with duration and events per interaction."""
    return _session_table(spark, d).select(
        F.col("grp").alias("project_id"), "start_us", "end_us", ((F.col("end_us") - F.col("start_us")) / 1e6).alias("duration_s"), "n_events", *(f"n_{k}" for k in KINDS))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Files and commits that the last successful run has not covered, by a run after each of several
    arrivals. Records of one file, and commits of one project, arrive in any order of their times."""
    scan, commits = table(spark, d, "file_scan"), table(spark, d, "git_commits")
    arrivals = {n: inc.Arrivals(spark, shared_path(spark, f"arrived-{n}"), df.schema) for n, df in (("files", scan), ("commits", commits))}
    job = inc.pending_items(spark, shared_path(spark, "incremental"), arrivals["files"], arrivals["commits"], table(spark, d, "file_index"), table(spark, d, "projects"))
    for k in range(ARRIVALS):
        for n, df, key in (("files", scan, ["project_id", "file_path", "scanned_at"]), ("commits", commits, ["project_id", "hash"])):
            arrivals[n].add(df.where(F.pmod(F.xxhash64(*key), F.lit(ARRIVALS)) == k))
        job.run()
    return job.result()


_REFS_SQL = """
WITH refs AS (
  SELECT 'chunk_interactions' ref_table, CAST(id AS VARCHAR) ref_key, chunk_id, "timestamp" t FROM chunk_interactions WHERE chunk_id IS NOT NULL
  UNION ALL SELECT DISTINCT 'search_log', CAST(id AS VARCHAR), CAST(x AS BIGINT), "timestamp"
    FROM (SELECT id, "timestamp", unnest(regexp_extract_all(result_chunk_ids, '-?[0-9]+')) x FROM search_log)
  UNION ALL SELECT 'edges', concat(source_id, '|', target_id, '|', edge_type), target_id,
    try_cast(replace(json_extract_string(metadata, '$.built_at'), 'Z', '') AS TIMESTAMP) FROM edges WHERE target_id IS NOT NULL),
timed AS (SELECT ref_table, ref_key, chunk_id, CASE WHEN t >= TIMESTAMP '2000-01-01' THEN t END t FROM refs),
found AS (SELECT r.ref_table, r.ref_key, r.chunk_id, coalesce(strftime(r.t, '%Y-%m'), 'unknown') period
  FROM timed r LEFT JOIN chunks c ON c.id = r.chunk_id WHERE c.id IS NULL OR c.created_at > r.t)
"""
_CASCADE_SQL = _REFS_SQL + """,
fi AS (SELECT concat_ws('|', project_id, file_path) f, project_id, last_indexed t, project_id IS NOT NULL AND project_id NOT IN (SELECT id FROM projects) gone FROM file_index),
ch AS (SELECT id, created_at t, concat_ws('|', project_id, file_path) f FROM chunks),
co AS (SELECT id, t, f NOT IN (SELECT f FROM fi) direct, f IN (SELECT f FROM fi WHERE gone) below FROM ch),
rf AS (SELECT ref_table, chunk_id, t, true timed FROM timed UNION ALL SELECT 'chunks_vec', id, NULL, false FROM chunks_vec WHERE id IS NOT NULL),
a AS (SELECT 'file_index' ref_table, 'projects' parent_table, 'direct' kind, 0 depth, t FROM fi WHERE gone
  UNION ALL SELECT 'chunks', 'file_index', 'direct', 0, t FROM co WHERE direct UNION ALL SELECT 'chunks', 'file_index', 'inherited', 1, t FROM co WHERE below
  UNION ALL SELECT ref_table, 'chunks', 'direct', 0, rf.t FROM rf LEFT JOIN co ON co.id = rf.chunk_id WHERE co.id IS NULL OR (timed AND co.t > rf.t)
  UNION ALL SELECT ref_table, 'chunks', 'inherited', CASE WHEN direct THEN 1 ELSE 2 END, rf.t FROM rf JOIN co ON co.id = rf.chunk_id WHERE direct OR below)
SELECT ref_table, parent_table, kind, depth, coalesce(strftime(t, '%Y-%m'), 'unknown') period, count(*) n_refs FROM a GROUP BY ALL
"""
_SESSIONS_SQL = """
WITH e AS (SELECT DISTINCT chunk_id, project_id, file_path, interaction, source_tool, "timestamp" FROM chunk_interactions),
u AS (SELECT lower(trim(project_id)) p, epoch_us("timestamp") us, lower(trim(coalesce(interaction, 'unknown'))) kind FROM e
  WHERE project_id IS NOT NULL AND "timestamp" >= TIMESTAMP '2000-01-01'),
m AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 1800000000 THEN 0 ELSE 1 END fresh FROM u WINDOW w AS (PARTITION BY p ORDER BY us)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY p ORDER BY us ROWS UNBOUNDED PRECEDING) s FROM m)
"""
_P7_SQL = """
WITH fs AS (SELECT project_id, regexp_replace(file_path, '^\\./', '') k, max_by(lower(file_hash), scanned_at) h FROM file_scan
  WHERE file_hash <> '' AND scanned_at IS NOT NULL GROUP BY ALL),
fi AS (SELECT project_id, regexp_replace(file_path, '^\\./', '') k, max_by(lower(file_hash), last_indexed) h FROM file_index
  WHERE file_hash <> '' AND last_indexed IS NOT NULL GROUP BY ALL),
mark AS (SELECT c.project_id, max(c."timestamp") t FROM git_commits c JOIN projects p ON p.id = c.project_id AND p.last_indexed_commit <> ''
  AND starts_with(c.hash, lower(p.last_indexed_commit)) GROUP BY ALL)
SELECT 'file' item_kind, fs.project_id, fs.k item_key, CASE WHEN fi.h IS NULL THEN 'new' ELSE 'changed' END change
  FROM fs LEFT JOIN fi USING (project_id, k) WHERE fi.h IS NULL OR fi.h <> fs.h
UNION ALL SELECT 'commit', c.project_id, c.hash, 'new' FROM git_commits c LEFT JOIN mark USING (project_id) WHERE mark.t IS NULL OR c."timestamp" > mark.t
"""

QUERIES = {f.__name__: f for f in (p2_found, p2_counts, p2_cascade, p6_found, p6_sessions, p7_found)}
SQL = {
    "p2_found": _REFS_SQL + "SELECT * FROM found",
    "p2_counts": _REFS_SQL + "SELECT ref_table, period, 'direct' kind, count(*) n_refs FROM found GROUP BY ALL",
    "p2_cascade": _CASCADE_SQL,
    "p6_found": _SESSIONS_SQL + "SELECT p project_id, min(us) start_us, max(us) end_us, count(*) n_events FROM n GROUP BY p, s",
    "p6_sessions": _SESSIONS_SQL + "SELECT p project_id, min(us) start_us, max(us) end_us, (max(us) - min(us)) / 1e6 duration_s, count(*) n_events, "
    + ", ".join(f"count(*) FILTER (kind = '{k}') n_{k}" for k in KINDS) + " FROM n GROUP BY p, s",
    "p7_found": _P7_SQL,
}
