"""Commit history: parsing of logs, churn, hotspots, and churn against attention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.operators.trace import take


def valid_ref(c: Column) -> Column:
    """Commit names: 4 to 40 hex digits."""
    return c.rlike("^[0-9a-f]{4,40}$")


def parse_numstat(df: DataFrame, line: str = "line") -> DataFrame:
    """Adds ``file_path, old_file_path, insertions, deletions, change_type, is_binary`` to numstat
    lines; lines that are none are dropped. Two dashes stand for a binary file, whose counts are null."""
    cols = F.split(F.col(line), "\t", 3)
    ins, dels, path = cols[0], cols[1], F.get(cols, F.lit(2))
    binary = (ins == "-") & (dels == "-")
    # A rename is written "old => new", or "common{old => new}common" where both paths share a part.
    arrow = F.instr(path, " => ")
    opened, closed = F.instr(F.substring_index(path, " => ", 1), "{"), F.instr(F.substr(path, arrow), "}")
    is_brace = (arrow > 0) & (opened > 0) & (closed > 0)
    is_plain = (arrow > 0) & ~is_brace
    common = lambda c: F.concat(F.substr(path, F.lit(1), opened - 1), F.trim(c), F.substr(path, arrow + closed))
    left, right = F.substr(path, F.lit(1), arrow - 1), F.substr(path, arrow + 4)
    old = F.when(is_brace, common(F.substr(left, opened + 1))).when(is_plain, F.trim(left))
    new = F.when(is_brace, common(F.substring_index(right, "}", 1))).when(is_plain, F.trim(right)).otherwise(path)
    number = lambda c: F.when(~binary, c.try_cast("bigint"))
    good = (F.size(cols) == 3) & (binary | (ins.rlike(r"^\d+$") & dels.rlike(r"^\d+$")))
    return df.where(good).withColumns({
        "file_path": new, "old_file_path": old, "insertions": number(ins), "deletions": number(dels),
        "change_type": F.when(is_brace | is_plain, "R").otherwise("M"), "is_binary": binary})


def parse_log(logs: DataFrame, raw: str = "raw", project: str = "project_id") -> tuple[DataFrame, DataFrame]:
    """Commits and file changes of captured ``git log --numstat`` texts whose header lines are hash,
    epoch seconds and summary, separated by NUL. Headers with a bad time are skipped with their files."""
    entry = F.explode(F.split(F.col(raw), r"(?=(?m)^[0-9a-f]{40}\x00)"))
    e = logs.select(project, entry.alias("entry")).where(F.col("entry").rlike(r"^[0-9a-f]{40}\x00"))
    lines = F.split("entry", "\n")
    head = F.split(F.get(lines, F.lit(0)), "\x00", 3)
    e = e.select(project, head[0].alias("hash"), head[1].try_cast("bigint").alias("timestamp"), F.substring(F.coalesce(F.get(head, F.lit(2)), F.lit("")), 1, 500).alias("summary"), lines.alias("lines")).where("timestamp IS NOT NULL")
    commits = e.select(project, "hash", "timestamp", "summary")
    changes = e.select(project, F.col("hash").alias("commit_hash"), F.explode(F.slice("lines", 2, 1_000_000_000)).alias("line"))
    return commits, parse_numstat(changes).drop("line")


def in_window(commits: DataFrame, as_of_epoch: int, days: int, project: str | None = None) -> DataFrame:
    got = commits.where(F.col("timestamp") >= as_of_epoch - days * 86_400)
    return got if project is None else got.where(F.col("project_id") == project)


def _joined(changes: DataFrame, commits: DataFrame) -> DataFrame:
    c = commits.select("project_id", F.col("hash").alias("commit_hash"))
    return changes.where(~F.col("is_binary")).join(c, ["project_id", "commit_hash"])


_lines = lambda *c: sum((F.coalesce(F.col(x), F.lit(0)) for x in c), F.lit(0))


def churn(changes: DataFrame, commits: DataFrame, limit: int = 20) -> DataFrame:
    """Files by number of commits; deletions of files do not count. ``changes`` has one row per commit and
    file, so rows are commits."""
    j = _joined(changes, commits).where("change_type <> 'D'")
    got = j.groupBy("file_path").agg(F.count(F.lit(1)).alias("commits"), F.sum(_lines("insertions")).alias("insertions"), F.sum(_lines("deletions")).alias("deletions"), F.sum(_lines("insertions", "deletions")).alias("churn"))
    return take(got.orderBy(F.desc("commits"), "file_path"), limit)


def hotspots(changes: DataFrame, commits: DataFrame, limit: int = 20) -> DataFrame:
    """Top-level directories by churn."""
    at = F.instr("file_path", "/")
    directory = F.when(at > 0, F.substring_index("file_path", "/", 1)).otherwise(F.lit("."))
    directory = F.when(at > 0, F.concat(directory, F.lit("/"))).otherwise(directory)
    j = _joined(changes, commits).withColumn("directory", directory)
    got = j.groupBy("directory").agg(F.countDistinct("project_id", "commit_hash").alias("commits"), F.sum(_lines("insertions", "deletions")).alias("churn"), F.countDistinct("file_path").alias("files"))
    return take(got.orderBy(F.desc("churn"), "directory"), limit)


def crossover(changes: DataFrame, commits: DataFrame, reads: DataFrame, limit: int = 20) -> DataFrame:
    """Files with the commits that changed them and the days on which they were read or edited.
    ``changes`` has one row per commit and file; ``reads``: file_path, timestamp."""
    c = _joined(changes, commits).where("change_type <> 'D'").groupBy("file_path").agg(F.count(F.lit(1)).alias("churn"), F.sum(_lines("insertions", "deletions")).alias("lines_changed"))
    r = reads.where("file_path IS NOT NULL").groupBy("file_path").agg(F.countDistinct(F.to_date("timestamp")).alias("reads"))
    got = c.join(r, "file_path", "full").select("file_path", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("churn", "reads", "lines_changed")))
    return take(got.orderBy(F.desc(F.col("churn") + F.col("reads")), "file_path"), limit)


def third_quartile(values: Column) -> Column:
    """The upper quartile of an array by the exclusive method; the greatest of fewer than four values,
    0 of none."""
    s = F.array_sort(values)
    n = F.size(s)
    pos = (n + 1) * 3
    low = F.least(F.greatest(F.floor(pos / 4), F.lit(1)), n - 1).cast("int")
    part = pos - low * 4
    at = (F.element_at(s, low) * (4 - part) + F.element_at(s, low + 1) * part) / 4.0
    return F.when(n == 0, F.lit(0.0)).when(n < 4, F.array_max(s).cast("double")).otherwise(at)


def classify(churn_: Column, reads: Column, high_churn: Column, high_reads: Column) -> Column:
    """The signal of a file from its churn and reads and the upper quartiles of both."""
    hc, hr = (churn_ >= high_churn) & (high_churn > 0), (reads >= high_reads) & (high_reads > 0)
    return (F.when(hc & (reads == 0), "BLIND").when(hc & hr, "HOT").when(hc & (reads > 0), "TURBULENT")
            .when((churn_ == 0) & (reads > 0), "ZOMBIE").when(hr, "STABLE").otherwise("COLD"))


def crossover_signals(found: DataFrame) -> DataFrame:
    """``found`` (a report with a limit, so few rows) with thresholds of its own rows and signals."""
    w = W.partitionBy(F.lit(1))
    q = lambda c: third_quartile(F.collect_list(c).over(w))
    t = found.withColumns({"p75_churn": q("churn"), "p75_reads": q("reads")})
    return t.withColumn("signal", classify(F.col("churn"), F.col("reads"), F.col("p75_churn"), F.col("p75_reads")))
