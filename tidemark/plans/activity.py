"""Queries over the logs, the commit history, and changes to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import gitlog, store, trace
from tidemark.sources.tables import table

AS_OF = "2025-10-28 00:00:00"
GIT_AS_OF, GIT_DAYS = 996_624_000, 1188
_since = lambda days: f"\"timestamp\" >= TIMESTAMP '{AS_OF}' - INTERVAL {days} DAY"


def git_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Commits and file changes made from the order tables: orders are commits, lines are changes."""
    key = lambda c: (F.concat(F.lit("p"), F.col(c) % 5).alias("project_id"), F.md5(F.col(c).cast("string")))
    p, h = key("o_orderkey")
    commits = table(spark, d, "orders").select(p, h.alias("hash"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("timestamp"), F.col("o_orderpriority").alias("summary"))
    n = F.col("l_partkey") % 200
    binary = F.col("l_linenumber") == 7
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", n.alias("n"),
        F.struct(
            F.col("l_linenumber").alias("no"), F.when(~binary, F.floor("l_quantity")).alias("insertions"), F.when(~binary, F.floor(F.round(F.col("l_discount") * 100))).alias("deletions"),
            F.when(F.col("l_returnflag") == "R", "D").when(F.col("l_returnflag") == "A", "R").otherwise("M").alias("change_type"), binary.alias("is_binary")).alias("v"))
    # One line per order and file; names are made of the numbers after they have met.
    first = rows.groupBy("l_orderkey", "n").agg(F.min("v").alias("v"))
    p, h = key("l_orderkey")
    path = F.concat(F.lit("d"), F.col("n") % 7, F.lit("/f"), F.col("n"), F.lit(".md"))
    return commits, first.select(p, h.alias("commit_hash"), path.alias("file_path"), "v.insertions", "v.deletions", "v.change_type", "v.is_binary")


GIT_SQL = f"""
WITH commits AS (SELECT concat('p', o_orderkey % 5) project_id, md5(CAST(o_orderkey AS VARCHAR)) hash, CAST(epoch(o_orderdate) AS BIGINT) ts FROM orders),
lines AS (SELECT concat('p', l_orderkey % 5) project_id, md5(CAST(l_orderkey AS VARCHAR)) hash, concat('d', (l_partkey % 200) % 7, '/f', l_partkey % 200, '.md') file_path,
  CASE WHEN l_linenumber <> 7 THEN CAST(floor(l_quantity) AS BIGINT) END insertions, CASE WHEN l_linenumber <> 7 THEN CAST(floor(round(l_discount * 100)) AS BIGINT) END deletions,
  CASE l_returnflag WHEN 'R' THEN 'D' WHEN 'A' THEN 'R' ELSE 'M' END change_type, l_linenumber = 7 is_binary, l_linenumber no FROM lineitem),
changes AS (SELECT * FROM lines QUALIFY row_number() OVER (PARTITION BY project_id, hash, file_path ORDER BY no, insertions NULLS FIRST, deletions NULLS FIRST, change_type, is_binary) = 1),
j AS (SELECT c.*, coalesce(insertions, 0) i, coalesce(deletions, 0) d FROM changes c JOIN commits m USING (project_id, hash) WHERE NOT is_binary AND ts >= {GIT_AS_OF} - {GIT_DAYS} * 86400)
"""


def _git(spark, d):
    commits, changes = git_tables(spark, d)
    return changes, gitlog.in_window(commits, GIT_AS_OF, GIT_DAYS)


def trace_hot(spark, d):
    """Files by number of interactions."""
    return trace.hot_files(table(spark, d, "chunk_interactions"), AS_OF)


def trace_gaps(spark, d):
    """Queries without results."""
    return trace.knowledge_gaps(table(spark, d, "search_log"), AS_OF)


def trace_queries(spark, d):
    """Queries by frequency."""
    return trace.top_queries(table(spark, d, "search_log"), AS_OF)


def trace_decay(spark, d):
    """Files that lost their readers."""
    return trace.decaying_files(table(spark, d, "chunk_interactions"), AS_OF, 20)


def interaction_counts(spark, d):
    """Reads and edits per chunk."""
    return trace.interaction_counts(table(spark, d, "chunk_interactions"), AS_OF)


def interaction_counts_project(spark, d):
    """Reads and edits per present chunk of a project."""
    return trace.interaction_counts(table(spark, d, "chunk_interactions"), AS_OF, chunks=table(spark, d, "chunks"), project="lantern-core")


def project_stats(spark, d):
    """Chunks and files of each project."""
    return trace.project_stats(table(spark, d, "chunks"))


def file_lines(spark, d):
    """Last line of each file."""
    return trace.file_line_counts(table(spark, d, "chunks"))


def edge_stats(spark, d):
    """Edges by project and type."""
    return trace.edge_stats(table(spark, d, "edges"), table(spark, d, "chunks"))


def recent_searches(spark, d):
    """The newest searches."""
    return trace.recent_searches(table(spark, d, "search_log"))


def list_projects(spark, d):
    """All projects in order."""
    return table(spark, d, "projects").select("id", "path", "type", "graph_enabled").orderBy("id")


def health(spark, d):
    """Checks and counters."""
    return trace.health(*(table(spark, d, t) for t in ("chunks", "chunks_vec", "chunk_interactions", "search_log", "file_index")))


def git_churn(spark, d):
    """Files by commits."""
    return gitlog.churn(*_git(spark, d))


def git_hotspots(spark, d):
    """Directories by churn."""
    return gitlog.hotspots(*_git(spark, d))


def _reads(spark, d):
    """Reads of the same files, made from the event table."""
    n = F.floor((F.col("user_id") * 13 + F.col("event_id") % 3) / 4) % 200
    return table(spark, d, "events").where("event_type IN ('view', 'purchase')").select(F.concat(F.lit("d"), n % 7, F.lit("/f"), n, F.lit(".md")).alias("file_path"), F.col("ts").alias("timestamp"))


def git_crossover(spark, d):
    """Commits and reading days per file."""
    return gitlog.crossover(*_git(spark, d), _reads(spark, d), limit=50)


def crossover_signals(spark, d):
    """The crossover report with its thresholds and signals."""
    return gitlog.crossover_signals(git_crossover(spark, d))


def git_parse(spark, d):
    """Commits parsed from log texts (one per project, written from the commit table)."""
    return gitlog.parse_log(_logs(spark, d))[0].distinct()


def git_numstat(spark, d):
    """File changes parsed from log texts, renames and binary files among them."""
    return gitlog.parse_log(_logs(spark, d))[1]


def _logs(spark, d):
    c = table(spark, d, "git_commits")
    n = F.conv(F.substring("hash", 1, 4), 16, 10).cast("int")
    stat = (F.when(n % 4 == 0, F.concat_ws("\t", n % 50, n % 7, F.concat(F.lit("src/f"), n % 90, F.lit(".py"))))
            .when(n % 4 == 1, F.concat_ws("\t", F.lit("-"), F.lit("-"), F.concat(F.lit("img/"), n % 30, F.lit(".png"))))
            .when(n % 4 == 2, F.concat_ws("\t", n % 9, F.lit(0), F.concat(F.lit("lib/{a"), n % 5, F.lit(" => b}/x.go"))))
            .otherwise(F.concat_ws("\t", F.lit(1), F.lit(2), F.concat(F.lit("old"), n % 6, F.lit(".md => new.md")))))
    entry = F.concat(F.col("hash"), F.lit("\x00"), F.col("timestamp").cast("string"), F.lit("\x00"), F.coalesce("summary", F.lit("")), F.lit("\n\n"), stat, F.lit("\n"))
    # A captured log is one text per project and month, as a fetch in slices would give it.
    month = F.floor(F.col("timestamp") / 2_592_000)
    return c.groupBy("project_id", month.alias("part")).agg(F.array_join(F.collect_list(entry), "").alias("raw"))


_STAT_SQL = """
WITH c AS (SELECT project_id, hash, CAST(concat('0x', substr(hash, 1, 4)) AS INT) n FROM git_commits)
SELECT project_id, hash commit_hash,
  CASE n % 4 WHEN 0 THEN concat('src/f', n % 90, '.py') WHEN 1 THEN concat('img/', n % 30, '.png') WHEN 2 THEN 'lib/b/x.go' ELSE 'new.md' END file_path,
  CASE n % 4 WHEN 2 THEN concat('lib/a', n % 5, '/x.go') WHEN 3 THEN concat('old', n % 6, '.md') END old_file_path,
  CAST(CASE n % 4 WHEN 0 THEN n % 50 WHEN 2 THEN n % 9 WHEN 3 THEN 1 END AS BIGINT) insertions, CAST(CASE n % 4 WHEN 0 THEN n % 7 WHEN 2 THEN 0 WHEN 3 THEN 2 END AS BIGINT) deletions,
  CASE WHEN n % 4 >= 2 THEN 'R' ELSE 'M' END change_type, n % 4 = 1 is_binary FROM c
"""


def change_status(spark, d):
    """Files that are new, changed, deleted or the same against the index, by their greatest hash."""
    one = lambda t: table(spark, d, t).where("file_hash <> ''").groupBy("project_id", F.regexp_replace("file_path", r"^\./", "").alias("file_path")).agg(F.max(F.lower("file_hash")).alias("file_hash"))
    return store.file_status(one("file_scan"), one("file_index"))


def orphan_purge(spark, d):
    """Interactions whose chunk is there."""
    return store.purge_orphans(table(spark, d, "chunk_interactions"), table(spark, d, "chunks")).select("id", "chunk_id")


def ttl_purge(spark, d):
    """Search rows that are not too old."""
    return store.expire(table(spark, d, "search_log"), "timestamp", AS_OF, 30).select("id", "timestamp")


def edge_insert(spark, d):
    """Reversed edges inserted unless their key is there: the rows really added."""
    e = table(spark, d, "edges").select("source_id", "target_id", "edge_type", "weight")
    new = e.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "edge_type", F.col("weight"), F.col("source_id").alias("no"))
    return store.insert_or_ignore(e, new, ["source_id", "target_id", "edge_type"], "no")[1].select("source_id", "target_id", "edge_type", "weight")


def project_upsert(spark, d):
    """Projects with the content ones made mixed and one added."""
    p = table(spark, d, "projects").select("id", "path", "type")
    new = p.where("type = 'content'").withColumn("type", F.lit("mixed")).unionByName(spark.createDataFrame([("new-project", "/srv/new-project", "code")], p.schema))
    return store.upsert(p, new, ["id"])


def delete_files(spark, d):
    """Counts after the HTML files are deleted with their vectors and edges."""
    chunks = table(spark, d, "chunks")
    gone = chunks.where("file_path LIKE '%.html'").select("project_id", "file_path")
    c, e, v = store.delete_files(chunks, table(spark, d, "edges"), table(spark, d, "chunks_vec"), gone)
    n = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    return n(c, "chunks").unionByName(n(e, "edges")).unionByName(n(v, "vectors"))


def delete_project_edges(spark, d):
    """Edges that have no end in a project."""
    return store.delete_project_edges(table(spark, d, "edges"), table(spark, d, "chunks"), "lantern-core")[0].select("source_id", "target_id", "edge_type")


def chunk_defaults(spark, d):
    """Chunks with the defaults of missing columns."""
    return store.with_defaults(table(spark, d, "chunks").select("id", "chunk_domain", "chunk_type", "language", "name"), {"chunk_domain": "content", "chunk_type": "block", "language": "text"})


def metadata_patch(spark, d):
    """Metadata after a merge patch that sets one key and removes another."""
    patched = store.json_patch("metadata", F.lit('{"categories": null, "seen": {"by": 1}}'))
    return table(spark, d, "chunks").select("id", patched.alias("metadata"))


def metadata_update(spark, d):
    """Metadata after a shallow update."""
    return table(spark, d, "chunks").select("id", store.shallow_update("metadata", F.lit('{"seen": ["yes", 2]}')).alias("metadata"))


QUERIES = {f.__name__: f for f in (
    trace_hot, trace_gaps, trace_queries, trace_decay, interaction_counts, interaction_counts_project, project_stats, file_lines, edge_stats, recent_searches, list_projects, health,
    git_churn, git_hotspots, git_crossover, crossover_signals, git_parse, git_numstat, change_status, orphan_purge, ttl_purge, edge_insert, project_upsert, delete_files, delete_project_edges, chunk_defaults, metadata_patch, metadata_update)}

_CROSS = GIT_SQL + """, ch AS (SELECT file_path, count(DISTINCT hash) churn, sum(i + d) lines_changed FROM j WHERE change_type <> 'D' GROUP BY 1),
ev AS (SELECT CAST(floor((user_id * 13 + event_id % 3) / 4) AS BIGINT) % 200 n, ts FROM events WHERE event_type IN ('view', 'purchase')),
rd AS (SELECT concat('d', n % 7, '/f', n, '.md') file_path, count(DISTINCT CAST(ts AS DATE)) reads FROM ev GROUP BY 1),
x AS (SELECT coalesce(ch.file_path, rd.file_path) file_path, coalesce(churn, 0) churn, coalesce(reads, 0) reads, CAST(coalesce(lines_changed, 0) AS BIGINT) lines_changed
  FROM ch FULL JOIN rd ON ch.file_path = rd.file_path ORDER BY coalesce(ch.churn, 0) + coalesce(rd.reads, 0) DESC, 1 LIMIT 50)
"""
_QUART = "(SELECT CASE WHEN n < 4 THEN mx ELSE (l[lo] * (4 - (pos - 4 * lo)) + l[lo + 1] * (pos - 4 * lo)) / 4.0 END FROM (SELECT *, least(greatest(pos // 4, 1), n - 1) lo FROM (SELECT list_sort(list({c})) l, count(*) n, max({c}) mx, (count(*) + 1) * 3 pos FROM x)))"
SQL = {
    "trace_hot": f"SELECT project_id, file_path, count(*) FILTER (interaction = 'read') reads, count(*) FILTER (interaction = 'edit') edits, count(*) FILTER (interaction = 'search_hit') searches, count(*) total FROM chunk_interactions WHERE {_since(30)} GROUP BY 1, 2 ORDER BY total DESC, file_path NULLS LAST, project_id NULLS LAST LIMIT 20",
    "trace_gaps": f"SELECT query, count(*) n, max(\"timestamp\") last_seen FROM search_log WHERE {_since(30)} AND result_count = 0 GROUP BY 1 ORDER BY n DESC, query LIMIT 20",
    "trace_queries": f"SELECT query, count(*) n, round(avg(result_count), 1) avg_results, max(\"timestamp\") last_seen FROM search_log WHERE {_since(30)} GROUP BY 1 ORDER BY n DESC, query LIMIT 20",
    "trace_decay": f"""SELECT project_id, file_path, before, now, round_even(before / (now + 1), 1) ratio FROM (SELECT project_id, file_path, count(*) FILTER (NOT ({_since(20)})) before, count(*) FILTER ({_since(20)}) now
      FROM chunk_interactions WHERE {_since(40)} GROUP BY 1, 2) WHERE before > 3 AND before / (now + 1) > 3 ORDER BY before / (now + 1) DESC, file_path NULLS LAST, project_id NULLS LAST LIMIT 20""",
    "interaction_counts": f"SELECT chunk_id, count(*) n FROM chunk_interactions WHERE {_since(30)} AND interaction IN ('read', 'edit') GROUP BY 1",
    "interaction_counts_project": f"SELECT i.chunk_id, count(*) n FROM chunk_interactions i JOIN chunks c ON c.id = i.chunk_id AND c.project_id = 'lantern-core' WHERE i.{_since(30)} AND interaction IN ('read', 'edit') GROUP BY 1",
    "project_stats": "SELECT project_id, count(*) total, count(*) FILTER (chunk_domain = 'content') content_chunks, count(*) FILTER (chunk_domain = 'code') code_chunks, count(DISTINCT file_path) files FROM chunks GROUP BY 1",
    "file_lines": "SELECT project_id, file_path, nullif(max(end_line), 0) \"lines\" FROM chunks GROUP BY 1, 2",
    "edge_stats": "SELECT project_id, edge_type, count(*) n FROM edges e JOIN chunks c ON c.id = e.source_id GROUP BY 1, 2",
    "recent_searches": "SELECT id, query, project_id, result_count, \"timestamp\" FROM search_log ORDER BY \"timestamp\" DESC NULLS LAST, id DESC LIMIT 50",
    "list_projects": "SELECT id, path, type, graph_enabled FROM projects",
    "health": """SELECT 'chunks' check_name, count(*) n FROM chunks UNION ALL SELECT 'vectors', count(*) FROM chunks_vec UNION ALL SELECT 'chunks_without_vector', count(*) FROM chunks WHERE id NOT IN (SELECT id FROM chunks_vec)
      UNION ALL SELECT 'vectors_without_chunk', count(*) FROM chunks_vec WHERE id NOT IN (SELECT id FROM chunks) UNION ALL SELECT 'interactions', count(*) FROM chunk_interactions UNION ALL SELECT 'searches', count(*) FROM search_log
      UNION ALL SELECT 'orphan_interactions', count(*) FROM chunk_interactions WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT id FROM chunks)
      UNION ALL SELECT 'chunks_without_file', count(*) FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM file_index f WHERE f.project_id = c.project_id AND f.file_path = c.file_path)""",
    "git_churn": GIT_SQL + "SELECT file_path, count(DISTINCT hash) commits, CAST(sum(i) AS BIGINT) insertions, CAST(sum(d) AS BIGINT) deletions, CAST(sum(i + d) AS BIGINT) churn FROM j WHERE change_type <> 'D' GROUP BY 1 ORDER BY commits DESC, file_path LIMIT 20",
    "git_hotspots": GIT_SQL + "SELECT CASE WHEN instr(file_path, '/') > 0 THEN concat(split_part(file_path, '/', 1), '/') ELSE '.' END directory, count(DISTINCT hash) commits, CAST(sum(i + d) AS BIGINT) churn, count(DISTINCT file_path) files FROM j GROUP BY 1 ORDER BY churn DESC, 1 LIMIT 20",
    "git_crossover": _CROSS + "SELECT * FROM x",
    "crossover_signals": _CROSS + f", t AS (SELECT *, CAST({_QUART.format(c='churn')} AS DOUBLE) p75_churn, CAST({_QUART.format(c='reads')} AS DOUBLE) p75_reads FROM x)"
    " SELECT *, CASE WHEN churn >= p75_churn AND p75_churn > 0 AND reads = 0 THEN 'BLIND' WHEN churn >= p75_churn AND p75_churn > 0 AND reads >= p75_reads AND p75_reads > 0 THEN 'HOT' WHEN churn >= p75_churn AND p75_churn > 0 AND reads > 0 THEN 'TURBULENT'"
    " WHEN churn = 0 AND reads > 0 THEN 'ZOMBIE' WHEN reads >= p75_reads AND p75_reads > 0 THEN 'STABLE' ELSE 'COLD' END signal FROM t",
    "git_parse": "SELECT DISTINCT project_id, hash, \"timestamp\", coalesce(substr(summary, 1, 500), '') summary FROM git_commits",
    "git_numstat": _STAT_SQL,
    "change_status": """WITH s AS (SELECT project_id, regexp_replace(file_path, '^\\./', '') file_path, max(lower(file_hash)) h FROM file_scan WHERE file_hash <> '' GROUP BY ALL), i AS (SELECT project_id, regexp_replace(file_path, '^\\./', '') file_path, max(lower(file_hash)) h FROM file_index WHERE file_hash <> '' GROUP BY ALL)
      SELECT project_id, file_path, CASE WHEN i.h IS NULL THEN 'new' WHEN s.h IS NULL THEN 'deleted' WHEN s.h <> i.h THEN 'changed' ELSE 'same' END status FROM s FULL JOIN i USING (project_id, file_path)""",
    "orphan_purge": "SELECT id, chunk_id FROM chunk_interactions WHERE chunk_id IN (SELECT id FROM chunks)",
    "ttl_purge": f"SELECT id, \"timestamp\" FROM search_log WHERE \"timestamp\" IS NULL OR {_since(30)}",
    "edge_insert": "SELECT target_id source_id, source_id target_id, edge_type, weight FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges o WHERE o.source_id = e.target_id AND o.target_id = e.source_id AND o.edge_type = e.edge_type)",
    "project_upsert": "SELECT id, path, CASE WHEN type = 'content' THEN 'mixed' ELSE type END type FROM projects UNION ALL SELECT 'new-project', '/srv/new-project', 'code'",
    "delete_files": """WITH g AS (SELECT id FROM chunks WHERE file_path LIKE '%.html') SELECT 'chunks' what, count(*) n FROM chunks WHERE id NOT IN (SELECT id FROM g)
      UNION ALL SELECT 'edges', count(*) FROM edges WHERE source_id NOT IN (SELECT id FROM g) AND target_id NOT IN (SELECT id FROM g) UNION ALL SELECT 'vectors', count(*) FROM chunks_vec WHERE id NOT IN (SELECT id FROM g)""",
    "delete_project_edges": "WITH g AS (SELECT id FROM chunks WHERE project_id = 'lantern-core') SELECT source_id, target_id, edge_type FROM edges WHERE source_id NOT IN (SELECT id FROM g) AND target_id NOT IN (SELECT id FROM g)",
    "chunk_defaults": "SELECT id, coalesce(chunk_domain, 'content') chunk_domain, coalesce(chunk_type, 'block') chunk_type, coalesce(language, 'text') \"language\", name FROM chunks",
    "metadata_patch": """SELECT id, CAST(json_merge_patch(coalesce(metadata, '{}'), '{"categories": null, "seen": {"by": 1}}') AS VARCHAR) metadata FROM chunks""",
    "metadata_update": """SELECT id, CAST(json_merge_patch(coalesce(metadata, '{}'), '{"seen": ["yes", 2]}') AS VARCHAR) metadata FROM chunks""",
}
