"""Queries over index runs, and what is deleted and read by them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import indexing, store
from tidemark.plans.activity import AS_OF
from tidemark.sources.tables import table

_PATH = r"(\.[^./]*)$"


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Files made of the chunks, one of each, with the chunk's suffix."""
    path = F.regexp_replace("file_path", _PATH, F.concat(F.lit("-"), F.col("id").cast("string"), F.lit("$1")))
    return table(spark, d, "chunks").select("project_id", path.alias("file_path"), F.col("content").alias("text"), "language").withColumn("file_hash", F.md5("text"))


def _empty(spark: SparkSession, d: str) -> indexing.Index:
    chunks = spark.createDataFrame([], "id bigint, project_id string, file_path string, chunk_domain string, chunk_type string, name string, language string, start_line int, end_line int, content string")
    files = spark.createDataFrame([], "project_id string, file_path string, file_hash string, chunk_count int, last_indexed timestamp_ntz")
    return indexing.Index(chunks, spark.createDataFrame([], "id bigint, embedding array<float>"), spark.createDataFrame([], "source_id bigint, target_id bigint, edge_type string, weight double"), files, table(spark, d, "projects"))


def _two_runs(spark, d):
    """A run over all files but the HTML ones; then Go files are gone, Python files changed, HTML files new."""
    files = _files(spark, d)
    first, result = indexing.index_run(_empty(spark, d), files.where("file_path NOT LIKE '%.html'"), "2025-10-01 00:00:00")
    later = files.where("file_path NOT LIKE '%.go'").withColumn("text", F.when(F.col("file_path").like("%.py"), F.concat("text", F.lit("\nx = 1"))).otherwise(F.col("text"))).withColumn("file_hash", F.md5("text"))
    return result, *indexing.index_run(first, later, AS_OF)


_COUNTS = ["project_id", "total_files", "indexed_files", "deleted_files"]


def index_run(spark, d):
    """Files of a first run by project."""
    files = _files(spark, d)
    return indexing.index_run(_empty(spark, d), files, AS_OF)[1].select(*_COUNTS)


def index_rerun(spark, d):
    """Files of a second run by project, of which only new, changed and deleted ones are looked at."""
    return _two_runs(spark, d)[2].select(*_COUNTS)


def index_chunks(spark, d):
    """The chunks after two runs."""
    return _two_runs(spark, d)[1].chunks


def index_files(spark, d):
    """The file index after two runs."""
    return _two_runs(spark, d)[1].files.select("project_id", "file_path", "file_hash", "last_indexed")


def changed_projects(spark, d):
    """Projects that a run has something to do for."""
    heads = table(spark, d, "git_commits").groupBy("project_id").agg(F.max_by("hash", F.struct("timestamp", "hash")).alias("commit"))
    modified = table(spark, d, "file_scan").groupBy("project_id").agg(F.max("modified_at").alias("modified_at"))
    return indexing.changed_projects(table(spark, d, "projects"), heads, modified)


def fetched_chunks(spark, d):
    """HTML chunks as pages fetched from the web, indexed."""
    c = table(spark, d, "chunks").where("file_path LIKE '%.html'")
    pages = c.select(F.concat(F.lit("https://"), "project_id", F.lit(".example/"), "file_path", F.lit("?v=1")).alias("url"), F.col("content").alias("page"))
    return indexing.index_run(_empty(spark, d), indexing.pages_as_files(pages), AS_OF)[0].files.select("project_id", "file_path", "file_hash")


def smart_read(spark, d):
    """Every file, its first chunk standing for its text, as a reader gets it."""
    c = table(spark, d, "chunks")
    return indexing.smart_read(c.groupBy("project_id", "file_path").agg(F.min_by("content", "id").alias("text")), c)


def edge_delete(spark, d):
    """Links and tags of Python chunks deleted: edges left, by type, and how many went."""
    ids = table(spark, d, "chunks").where("language = 'python'").select("id")
    edges = table(spark, d, "edges")
    parts = []
    for t in ("link", "tag", None):
        kept, n = store.delete_edges(edges, ids, t)
        kept = kept.groupBy("edge_type").agg(F.count(F.lit(1)).alias("kept"))
        # The number of those that went is one row, and that is all that is joined.
        parts.append(kept.withColumn("of_type", F.lit(t or "all")).join(F.broadcast(n.withColumn("of_type", F.lit(t or "all"))), "of_type"))
    return reduce(DataFrame.unionByName, parts)


def project_edge_delete(spark, d):
    """Edges left after those of one project and type are deleted."""
    return store.delete_project_edges(table(spark, d, "edges"), table(spark, d, "chunks"), "lantern-core", "semantic")[0].select("source_id", "target_id", "edge_type")


QUERIES = {f.__name__: f for f in (index_run, index_rerun, index_chunks, index_files, changed_projects, fetched_chunks, smart_read, edge_delete, project_edge_delete)}
_MADE = r"f AS (SELECT project_id, regexp_replace(file_path, '(\.[^./]*)$', concat('-', id, '\1')) file_path, content FROM chunks)"
#: Files that give chunks; others are looked at in every run.
_CHUNKED = "regexp_matches(file_path, '\\.(md|mdx|py|go|ts|tsx|js|jsx|html)$') AND regexp_matches(content, '\\S')"
_NUMBERED = "array_to_string(list_transform({0}, lambda x, i: concat(lpad(CAST(i AS VARCHAR), 6, ' '), chr(9), x)), chr(10))"
SQL = {
    "index_run": f"WITH {_MADE} SELECT project_id, count(*) total_files, count(*) indexed_files, 0 deleted_files FROM f GROUP BY 1",
    "index_rerun": f"""WITH {_MADE} SELECT project_id, count(*) FILTER (file_path NOT LIKE '%.go') total_files, count(*) FILTER (file_path NOT LIKE '%.go' AND (file_path LIKE '%.py' OR file_path LIKE '%.html' OR NOT ({_CHUNKED}))) indexed_files,
      count(*) FILTER (file_path LIKE '%.go' AND {_CHUNKED}) deleted_files FROM f GROUP BY 1""",
    "index_files": f"""WITH {_MADE} SELECT project_id, file_path, md5(CASE WHEN file_path LIKE '%.py' THEN concat(content, chr(10), 'x = 1') ELSE content END) file_hash,
      CASE WHEN file_path LIKE '%.py' OR file_path LIKE '%.html' THEN TIMESTAMP '{AS_OF}' ELSE TIMESTAMP '2025-10-01' END last_indexed FROM f
      WHERE file_path NOT LIKE '%.go' AND {_CHUNKED}""",
    "changed_projects": """WITH h AS (SELECT project_id, arg_max(hash, ("timestamp", hash)) commit FROM git_commits GROUP BY 1), m AS (SELECT project_id, max(modified_at) t FROM file_scan GROUP BY 1),
w AS (SELECT p.id project_id, CASE WHEN last_indexed IS NULL THEN 'never' WHEN last_indexed_commit <> '' AND commit IS NOT NULL THEN CASE WHEN NOT starts_with(commit, lower(last_indexed_commit)) THEN 'commit' END
  WHEN m.t > last_indexed THEN 'file' END why FROM projects p LEFT JOIN h ON h.project_id = p.id LEFT JOIN m ON m.project_id = p.id)
SELECT * FROM w WHERE why IS NOT NULL""",
    "smart_read": f"""WITH t AS (SELECT project_id, file_path, string_split(arg_min(content, id), chr(10)) l, nullif(max(end_line), 0) n, count(*) n_chunks,
  string_agg(concat('  ', coalesce(chunk_type, 'block'), CASE WHEN coalesce(name, '') <> '' THEN concat(' ', name) ELSE '' END, ' L', coalesce(CAST(start_line AS VARCHAR), '?'), '-', coalesce(CAST(end_line AS VARCHAR), '?')), chr(10) ORDER BY coalesce(start_line, 0), id) o FROM chunks GROUP BY 1, 2)
SELECT project_id, file_path, CASE WHEN n IS NULL OR n < 200 THEN {_NUMBERED.format('l')} ELSE concat(file_path, ' (', n, ' lines, ', n_chunks, ' chunks)', chr(10), chr(10), 'Chunks:', chr(10), o, chr(10), chr(10), 'First 50 lines:', chr(10), {_NUMBERED.format('l[1:50]')}) END text FROM t""",
    "edge_delete": "WITH g AS (SELECT id FROM chunks WHERE \"language\" = 'python'), t AS (SELECT unnest(['link', 'tag', 'all']) of_type), e AS (SELECT *, (source_id IN (SELECT id FROM g) OR target_id IN (SELECT id FROM g)) AND of_type IN ('all', edge_type) gone FROM edges, t)"
    " SELECT edge_type, count(*) FILTER (NOT gone) kept, (SELECT count(*) FROM e z WHERE z.gone AND z.of_type = e.of_type) n, of_type FROM e GROUP BY edge_type, of_type HAVING count(*) FILTER (NOT gone) > 0",
    "project_edge_delete": "WITH g AS (SELECT id FROM chunks WHERE project_id = 'lantern-core') SELECT source_id, target_id, edge_type FROM edges WHERE NOT (edge_type = 'semantic' AND (source_id IN (SELECT id FROM g) OR target_id IN (SELECT id FROM g)))",
}
