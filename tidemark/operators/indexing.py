"""Indexing files: what changed, how it is cut, and the tables after a run.

A run is a function from the tables of the index and the present files to the tables after it. All changed
files of all projects are cut in one pass; nothing loops over files or projects.
"""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from tidemark.operators import chunking, store
from tidemark.operators.search import embed
from tidemark.session import written
from tidemark.sources.files import language, suffix_of
from tidemark.sources.html import html_text, url_path, url_project

CONTENT, CODE = (".md", ".mdx"), (".py", ".go", ".ts", ".tsx", ".js", ".jsx", ".html")
#: A file with fewer lines is read whole, of a longer one its outline and its first lines.
WHOLE_LINES, FIRST_LINES = 200, 50


class Index(NamedTuple):
    """chunks: id, project_id, file_path, chunk_domain, chunk_type, name, language, start_line, end_line,
    content; vectors: id, embedding; edges: source_id, target_id, ...; files: project_id, file_path,
    file_hash, chunk_count, last_indexed; projects: id, last_indexed, last_indexed_commit, ..."""

    chunks: DataFrame
    vectors: DataFrame
    edges: DataFrame
    files: DataFrame
    projects: DataFrame


def domain_of(path: Column, content: tuple[str, ...] = CONTENT, code: tuple[str, ...] = CODE) -> Column:
    """``content``, ``code`` or null by the suffix; a suffix of both kinds is content."""
    s = F.lower(suffix_of(path))
    return F.when(s.isin(*content), "content").when(s.isin(*code), "code")


@F.pandas_udf(ArrayType(FloatType()))
def embedded(text: pd.Series) -> pd.Series:
    return text.map(lambda t: embed(t or "", kind="passage"))


def cut_files(files: DataFrame, content: tuple[str, ...] = CONTENT, code: tuple[str, ...] = CODE, max_lines: int = 50) -> DataFrame:
    """The chunks of ``files`` (project_id, file_path, text) without ids: content by its headings, code by
    its definitions. Files of other kinds, and null and blank texts, have none."""
    key = F.to_json(F.struct("project_id", "file_path"))
    rows = files.select(key.alias("file"), "text", domain_of(F.col("file_path"), content, code).alias("chunk_domain"), language(F.col("file_path")).alias("language"))
    sections = chunking.heading_chunks(rows.where("chunk_domain = 'content'"), "file", "text").withColumn("chunk_domain", F.lit("content"))
    parts = chunking.code_chunks(rows.where("chunk_domain = 'code'"), "file", "text", "language", max_lines).withColumn("chunk_domain", F.lit("code"))
    both = sections.unionByName(parts)
    place = F.from_json("id", "project_id string, file_path string")
    return both.select(place.alias("f"), "no", "chunk_domain", "chunk_type", "name", "start_line", "end_line", "content").select(
        "f.project_id", "f.file_path", "no", "chunk_domain", "chunk_type", "name", language(F.col("f.file_path")).alias("language"), "start_line", "end_line", "content")


def index_run(index: Index, files: DataFrame, as_of: str, heads: DataFrame | None = None, incremental: bool = True, **how) -> tuple[Index, DataFrame]:
    """The tables after a run over ``files`` (project_id, file_path, file_hash, text), which are all files
    that the projects in it have now; and a result per project: ``project_id, total_files, indexed_files,
    deleted_files, total_chunks, content_chunks, code_chunks``.

    Files whose hash is the indexed one are left alone unless the run is not ``incremental``; files that
    are gone lose their chunks, vectors and edges. Of the others those that give chunks replace what was
    there; those that give none keep it and are looked at again. ``heads`` (project_id, commit) sets the
    commit that a project was indexed at; projects without one keep theirs."""
    present = files.select("project_id").distinct()
    known = index.files.join(present, "project_id", "left_semi").select("project_id", "file_path", "file_hash")
    status = written(store.file_status(files.select("project_id", "file_path", "file_hash"), known), "status")
    wanted = "status IN ('new', 'changed')" if incremental else "status <> 'deleted'"
    deleted = status.where("status = 'deleted'").select("project_id", "file_path")
    todo = files.join(status.where(wanted).select("project_id", "file_path"), ["project_id", "file_path"], "left_semi")
    pieces = written(cut_files(todo, **how), "pieces")
    done = pieces.groupBy("project_id", "file_path").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
    gone = deleted.unionByName(done.select("project_id", "file_path"))
    chunks, edges, vectors = store.delete_files(index.chunks, index.edges, index.vectors, gone)
    last = index.chunks.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = written(store.with_ids(pieces, ["project_id", "file_path", "no"], last).drop("no"), "fresh")
    hashes = done.join(files.select("project_id", "file_path", "file_hash"), ["project_id", "file_path"]).withColumn("last_indexed", F.lit(as_of).cast("timestamp_ntz"))
    entries = store.upsert(store.delete_where_in(index.files, deleted, ["project_id", "file_path"]), hashes, ["project_id", "file_path"])
    seen = present.select(F.col("project_id").alias("id"), F.lit(True).alias("_seen"))
    if heads is None:
        seen = seen.withColumn("_commit", F.lit(None).cast("string"))
    else:
        seen = seen.join(heads.select(F.col("project_id").alias("id"), F.nullif("commit", F.lit("")).alias("_commit")), "id", "left")
    projects = index.projects.join(seen, "id", "left").withColumns({
        "last_indexed": F.when(F.col("_seen"), F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("last_indexed")),
        "last_indexed_commit": F.coalesce("_commit", "last_indexed_commit")}).select(*index.projects.columns)
    n = status.groupBy("project_id").agg(F.count_if(F.col("status") != "deleted").alias("total_files"), F.count_if(F.expr(wanted)).alias("indexed_files"), F.count_if(F.col("status") == "deleted").alias("deleted_files"))
    of = lambda d: F.count_if(F.col("chunk_domain") == d)
    m = pieces.groupBy("project_id").agg(F.count(F.lit(1)).alias("total_chunks"), of("content").alias("content_chunks"), of("code").alias("code_chunks"))
    result = n.join(m, "project_id", "left").fillna(0)
    after = Index(
        chunks.unionByName(fresh.select(*chunks.columns)), vectors.unionByName(fresh.select("id", embedded("content").alias("embedding")).select(*vectors.columns)), edges, entries, projects)
    return after, result


def changed_projects(projects: DataFrame, heads: DataFrame, modified: DataFrame) -> DataFrame:
    """``project_id, why`` of the projects that a run has something to do for: ``never`` indexed, a new
    ``commit``, or without a known commit a ``file`` changed since. ``heads``: project_id, commit;
    ``modified``: project_id, modified_at, the latest of each project."""
    p = projects.select(F.col("id").alias("project_id"), F.col("last_indexed").cast("timestamp").alias("t"), F.nullif(F.lower("last_indexed_commit"), F.lit("")).alias("c"))
    j = p.join(heads, "project_id", "left").join(modified, "project_id", "left")
    by_commit = F.col("c").isNotNull() & F.col("commit").isNotNull()
    why = F.when(F.col("t").isNull(), "never").when(by_commit, F.when(~F.startswith("commit", "c"), "commit")).when(F.col("modified_at").cast("timestamp") > F.col("t"), "file")
    return j.select("project_id", why.alias("why")).where("why IS NOT NULL")


def pages_as_files(pages: DataFrame) -> DataFrame:
    """Fetched pages (url, page) as files of the project of their address; pages of other schemes than
    http and https are left out. Several pages of one path are one, the greatest."""
    got = pages.select(url_project(F.col("url")).alias("project_id"), F.concat(url_path(F.col("url")), F.lit(".md")).alias("file_path"), html_text("page").alias("text")).where("project_id IS NOT NULL")
    got = got.groupBy("project_id", "file_path").agg(F.max("text").alias("text"))
    return got.withColumn("file_hash", F.md5("text"))


def _numbered(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x, i: F.concat(F.lpad((i + 1).cast("string"), F.greatest(F.length((i + 1).cast("string")), F.lit(6)), F.lit(" ")), F.lit("\t"), x)), "\n")


def smart_read(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """``project_id, file_path, text`` of ``files`` (project_id, file_path, text) as a reader gets them:
    numbered lines of a file that is not indexed or has fewer than ``WHOLE_LINES`` lines, otherwise an
    outline of its chunks in order and its first ``FIRST_LINES`` numbered lines. Null texts stay null."""
    named = F.when(F.coalesce("name", F.lit("")) != "", F.concat(F.lit(" "), F.col("name"))).otherwise(F.lit(""))
    label = F.concat(F.lit("  "), F.coalesce("chunk_type", F.lit("block")), named, F.lit(" L"), F.coalesce(F.col("start_line").cast("string"), F.lit("?")), F.lit("-"), F.coalesce(F.col("end_line").cast("string"), F.lit("?")))
    own = chunks.join(files.select("project_id", "file_path"), ["project_id", "file_path"], "left_semi")
    outline = own.groupBy("project_id", "file_path").agg(
        F.nullif(F.max("end_line"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("n_chunks"), F.array_sort(F.collect_list(F.struct(F.coalesce("start_line", F.lit(0)).alias("s"), "id", label.alias("label")))).alias("o"))
    lines = F.split("text", "\n", -1)
    long = F.concat(F.col("file_path"), F.lit(" ("), F.col("n"), F.lit(" lines, "), F.col("n_chunks"), F.lit(" chunks)\n\nChunks:\n"), F.array_join(F.transform("o", lambda x: x["label"]), "\n"), F.lit(f"\n\nFirst {FIRST_LINES} lines:\n"), _numbered(F.slice(lines, 1, FIRST_LINES)))
    whole = F.col("n").isNull() | (F.col("n") < WHOLE_LINES)
    return files.join(outline, ["project_id", "file_path"], "left").select("project_id", "file_path", F.when(whole, _numbered(lines)).otherwise(long).alias("text"))
