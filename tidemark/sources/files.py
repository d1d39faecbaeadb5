"""Source trees as tables: scan, filters, text, hashes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql.types import StringType
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.session import written
from tidemark.sources.config import BINARY_SUFFIXES, DEFAULT_IGNORE, KEPT_DOT_FOLDERS, LANGUAGE_OF, LANGUAGE_OF_NAME


def suffix_of(path: Column) -> Column:
    """The suffix of a path's last part, with its dot; empty if there is none."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def language(path: Column) -> Column:
    """The language of a path by name or lower-cased suffix."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    return F.coalesce(F.try_element_at(table(LANGUAGE_OF_NAME), name), F.try_element_at(table(LANGUAGE_OF), F.lower(suffix_of(path))))


def glob_regex(pattern: str) -> tuple[str, bool]:
    """(regular expression on a relative path, whether it negates) of one ignore line: ``*``, ``?``,
    ``**``, classes, a leading slash for the root, a trailing one for folders, ``!`` to negate."""
    negate = pattern.startswith("!")
    p = pattern[1:] if negate else pattern
    folder = p.endswith("/")
    p = p.rstrip("/")
    anchored = "/" in p
    p = p.lstrip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 1 :]:
            j = p.index("]", i + 1)
            out, i = out + "[" + p[i + 1 : j].replace("!", "^", 1) + "]", j + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*" if folder else "(?:/.*)?") + "$", negate


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the last pattern that matches a relative path ignores it."""
    out = F.lit(False)
    for p in patterns:
        if p.strip() and not p.startswith("#"):
            regex, negate = glob_regex(p.strip())
            out = F.when(path.rlike(regex), F.lit(not negate)).otherwise(out)
    return out


def in_scope(path: Column, content: tuple[list[str], list[str]], code: tuple[list[str], list[str]]) -> Column:
    """Content suffixes must lie below a content path and code suffixes below a code path, both for
    a suffix that is both; other suffixes are out. Each argument is (suffixes, paths)."""
    def below(paths):
        out = F.lit(False)
        for p in paths:
            p = p.strip("/")
            out = out | (F.lit(True) if p in ("", ".") else ((path == p) | path.startswith(p + "/")))
        return out

    s = suffix_of(path)
    is_content, is_code = s.isin(*content[0]) if content[0] else F.lit(False), s.isin(*code[0]) if code[0] else F.lit(False)
    return (is_content | is_code) & (~is_content | below(content[1])) & (~is_code | below(code[1]))


def wanted(path: Column, length: Column, ignore: list[str] | None = None, max_kb: int = 500) -> Column:
    """The filters of a scan on relative paths: suffixes, hidden folders, ignore patterns, size."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    hidden = F.exists(folders, lambda d: d.startswith(".") & ~d.isin(*KEPT_DOT_FOLDERS) & (d != "."))
    return ~F.lower(suffix_of(path)).isin(*[x.lower() for x in BINARY_SUFFIXES]) & (name != ".DS_Store") & ~hidden & ~ignored(path, DEFAULT_IGNORE if ignore is None else ignore) & (length <= max_kb * 1024)


#: Folders that the driver finds before tasks go on.
FOLDERS = 64


def _file_system(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None, max_kb: int = 500) -> DataFrame:
    """``file_path, length, file_hash, text`` of the wanted files below ``root``.

    The driver lists folders level by level until there are ``FOLDERS`` of them, tasks list what is
    below these; Spark's own listing would leave out names that begin with a dot or an underscore. Paths
    and sizes are filtered before any content is read.
    """
    from pyarrow import fs

    root = root.rstrip("/")
    base = _file_system(root)[1]
    found, folders = [], [base]
    while folders and len(folders) < FOLDERS:
        inside = [i for f in folders for i in _file_system(root)[0].get_file_info(fs.FileSelector(f))]
        found += [(i.path, i.size) for i in inside if i.type == fs.FileType.File]
        folders = [i.path for i in inside if i.type == fs.FileType.Directory]

    def walk(batches):
        own = _file_system(root)[0]
        for pdf in batches:
            for folder in pdf["path"]:
                got = [(i.path, i.size) for i in own.get_file_info(fs.FileSelector(folder, recursive=True)) if i.type == fs.FileType.File]
                yield pd.DataFrame(got, columns=["path", "length"])

    df = spark.createDataFrame(found, "path string, length bigint")
    if folders:
        below = spark.createDataFrame([(f,) for f in folders], "path string").repartition(len(folders))
        df = df.unionByName(below.mapInPandas(walk, "path string, length bigint"))
    df = df.withColumn("file_path", F.ltrim(F.substr("path", F.lit(len(base) + 1)), F.lit("/")))
    df = written(df.where(wanted(F.col("file_path"), F.col("length"), ignore, max_kb)), "listed")
    df = df.repartition(max(1, df.count() // 200))  # by the number of files, as their names say nothing about their size

    def read(batches):
        own = _file_system(root)[0]
        for pdf in batches:
            raw = []
            for p in pdf["path"]:
                with own.open_input_stream(p) as f:
                    raw.append(f.read())
            yield pd.DataFrame({"file_path": pdf["file_path"], "length": pdf["length"], "content": raw})

    got = df.mapInPandas(read, "file_path string, length bigint, content binary")
    return got.select("file_path", "length", F.md5("content").alias("file_hash"), decode_text("content").alias("text"))


@F.pandas_udf(StringType())
def decode_text(raw: pd.Series) -> pd.Series:
    """UTF-8 with replacement characters."""
    return raw.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace"))
