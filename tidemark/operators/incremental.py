"""Processing only what is new or changed since the last successful run.

A job keeps a high watermark on a monotonic sequence. A run fixes its upper limit before it reads,
takes the records above the watermark up to that limit, writes their output to a folder of its own,
and commits the folder together with the new watermark in one manifest. A run that breaks off
before the commit leaves neither; the next run takes the same records again.

Times of events are no such sequence: records come late, and several have the same time. Records are
therefore numbered as they arrive (``Arrivals``), and a run brings up to date every item that the new
arrivals touch (``PendingJob``), whatever their times.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.skew import lookup
from tidemark.sources.manifest import Manifest


class IncrementalJob:
    """One job's committed outputs and watermark below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, Manifest(spark, path)

    def watermark(self) -> int | None:
        """The sequence number up to which everything is done; None before the first run."""
        return self.table.current()[1].get("watermark")

    def output(self, schema) -> DataFrame:
        """All committed output."""
        runs = self.table.current()[1].get("runs", [])
        paths = [f"{self.table.path}/data/{r}" for r in runs]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def run(self, source: DataFrame, seq: str, work: Callable[[DataFrame], DataFrame], fail_before_commit: bool = False) -> int:
        """Process the records of ``source`` above the watermark; the version after the run.

        Records with a null ``seq`` have no place in the sequence and are left for a run that gives
        them one. Without new records nothing is committed. ``fail_before_commit`` breaks the run
        off at the worst moment, for tests.
        """
        base, now = self.table.current()
        low = now.get("watermark")
        high = source.agg(F.max(seq)).first()[0]
        if high is None or (low is not None and high <= low):
            return base
        due = source.where(F.col(seq) <= F.lit(high))
        if low is not None:
            due = due.where(F.col(seq) > F.lit(low))
        folder = self.table.new_data()
        work(due).write.parquet(folder)
        if fail_before_commit:
            raise RuntimeError("broken off before the commit")
        return self.table.commit(base, {"watermark": high, "runs": [*now.get("runs", []), folder.rsplit("/", 1)[1]]})


class Arrivals:
    """Records in order of arrival below ``path``. A batch is written to a folder of its own, and the
    manifest that adds the folder gives it the next number; a batch that breaks off is not there."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.table, self.schema = spark, Manifest(spark, path), schema

    def add(self, batch: DataFrame) -> int:
        """Add one batch; its number. Of two writers at once one gets a ``ConflictError``."""
        base, now = self.table.current()
        folder = self.table.new_data()
        batch.write.parquet(folder)
        return self.table.commit(base, {"batches": [*now.get("batches", []), folder.rsplit("/", 1)[1]]})

    def read(self) -> DataFrame:
        """All records that have arrived by now with ``seq``, the number of their batch. Batches
        that are added later are not in it."""
        folders = [f"{self.table.path}/data/{b}" for b in self.table.current()[1].get("batches", [])]
        if not folders:
            return self.spark.createDataFrame([], self.schema).withColumn("seq", F.lit(0))
        folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        number = F.create_map(*(F.lit(x) for k, f in enumerate(folders, 1) for x in (f.rsplit("/", 1)[1], k)))
        return self.spark.read.schema(self.schema).parquet(*folders).withColumn("seq", number[folder])


class PendingJob:
    """What of the arrived records is pending, kept by runs over what is new.

    ``sources``: ``Arrivals`` by name. ``touched(name, due, all)`` gives the keys of the items on
    which the new records of a source bear, ``pending(name, keys, all)`` those of them that are pending
    by all records of the source up to the run's limit. A run writes for each touched item its state,
    with a null ``change`` if it is not pending (any more); per item the newest run counts. So the
    result after any runs is that of one run over everything.
    """

    KEY = ["item_kind", "project_id", "item_key"]
    OUT = "item_kind string, project_id string, item_key string, change string, run bigint"

    def __init__(self, spark: SparkSession, path: str, sources: dict[str, Arrivals], touched: Callable, pending: Callable):
        self.sources, self.touched, self.pending = sources, touched, pending
        self.jobs = {name: IncrementalJob(spark, f"{path}/{name}") for name in sources}

    def run(self, fail_before_commit: bool = False) -> None:
        """Take in all records that have arrived since the last successful run."""
        for name, job in self.jobs.items():
            arrived = self.sources[name].read()

            def work(due, name=name, arrived=arrived):
                upto = due.agg(F.max("seq")).first()[0]  # greater in every committed run
                keys = self.touched(name, due, arrived).distinct()
                now = self.pending(name, keys, arrived)
                same = [F.col(f"k.{c}").eqNullSafe(F.col(f"n.{c}")) for c in self.KEY]
                state = keys.alias("k").join(now.alias("n"), same, "left")
                return state.select(*(f"k.{c}" for c in self.KEY), "n.change", F.lit(upto).cast("bigint").alias("run"))

            job.run(arrived, "seq", work, fail_before_commit)

    def result(self) -> DataFrame:
        """``item_kind, project_id, item_key, change`` of all pending items."""
        parts = [job.output(self.OUT).groupBy(*self.KEY).agg(F.max_by("change", "run").alias("change")) for job in self.jobs.values()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)  # an item comes from one source
        return out.where("change IS NOT NULL")


def _hash(c: str):
    """Hex digits in lower case; null and empty are no hash."""
    return F.nullif(F.lower(F.trim(F.col(c))), F.lit(""))


def _path(c: str):
    return F.regexp_replace(F.col(c), r"^\./", "")


def file_changes(scan: DataFrame, index: DataFrame) -> DataFrame:
    """Files whose present hash differs from the indexed one: ``item_kind, project_id, item_key,
    change, time_us``.

    The present hash is the latest by ``scanned_at`` among scans with a hash, the indexed one the
    latest by ``last_indexed`` among rows with both. Rows without them, from reads that failed or
    runs that broke off, do not count. Of equal times the greater hash counts. Repeated rows change
    nothing. ``time_us`` is the time of the scan in microseconds, no place in a sequence.
    """
    def latest(df, time):
        got = df.select("project_id", _path("file_path").alias("item_key"), F.struct(F.unix_micros(F.col(time).cast("timestamp")).alias("t"), _hash("file_hash").alias("h")).alias("s"))
        return got.where("s.t IS NOT NULL AND s.h IS NOT NULL AND item_key IS NOT NULL").groupBy("project_id", "item_key").agg(F.max("s").alias("s"))

    now, then = latest(scan, "scanned_at").alias("n"), latest(index, "last_indexed").alias("o")
    same = F.col("n.project_id").eqNullSafe(F.col("o.project_id")) & (F.col("n.item_key") == F.col("o.item_key"))
    both = now.join(then, same, "left")
    change = F.when(F.col("o.s").isNull(), "new").when(F.col("n.s.h") != F.col("o.s.h"), "changed")
    return both.select(F.lit("file").alias("item_kind"), "n.project_id", "n.item_key", change.alias("change"), F.col("n.s.t").alias("time_us")).where("change IS NOT NULL")


def commit_watermarks(commits: DataFrame, projects: DataFrame) -> DataFrame:
    """Per project the timestamp of the commit that ``last_indexed_commit`` names in full or by its
    first digits: ``project_id, mark``. A name that fits no commit gives no row; of several commits
    that fit, the latest counts, as does the greatest name of a project that is listed twice. A
    project may hold a large share of all commits."""
    named = projects.select(F.col("id").alias("project_id"), _hash("last_indexed_commit").alias("named")).where("named IS NOT NULL")
    named = named.groupBy("project_id").agg(F.max("named").alias("named"))
    return (
        lookup(commits.select("project_id", _hash("hash").alias("hash"), "timestamp"), "project_id", named)
        .where(F.expr("startswith(hash, named)")).groupBy("project_id").agg(F.max("timestamp").alias("mark"))
    )


def commit_changes(commits: DataFrame, projects: DataFrame) -> DataFrame:
    """Commits later than their project's watermark, or all of a project without one: the columns of
    ``file_changes``. Rows without hash or timestamp have no place in the sequence and are left out;
    a commit that is listed twice is one."""
    marks = commit_watermarks(commits, projects)
    due = lookup(commits.where("hash IS NOT NULL AND timestamp IS NOT NULL"), "project_id", marks).where("mark IS NULL OR timestamp > mark")
    return due.groupBy("project_id", F.col("hash").alias("item_key")).agg(F.max("timestamp").alias("t")).select(
        F.lit("commit").alias("item_kind"), "project_id", "item_key", F.lit("new").alias("change"), (F.col("t") * 1_000_000).alias("time_us"))


def pending_items(spark: SparkSession, path: str, scan: Arrivals, commits: Arrivals, index: DataFrame, projects: DataFrame) -> PendingJob:
    """``file_changes`` and ``commit_changes`` over arriving scan records and commits. ``index`` and
    ``projects`` say what was covered before the first run."""

    def files(df):
        return df.select(F.lit("file").alias("item_kind"), "project_id", _path("file_path").alias("item_key")).where("item_key IS NOT NULL")

    def hashes(df):
        return df.select(F.lit("commit").alias("item_kind"), "project_id", F.col("hash").alias("item_key")).where("item_key IS NOT NULL")

    def touched(name, due, arrived):
        if name == "files":
            return files(due)
        # A new commit that its project names moves the project's mark, and with it all its commits.
        moved = commit_watermarks(due, projects).select("project_id", F.lit(True).alias("moved"))
        return hashes(due).unionByName(hashes(lookup(arrived, "project_id", moved).where("moved")))

    def pending(name, keys, arrived):
        if name == "files":
            own = arrived.alias("a").withColumn("item_key", _path("file_path")).join(
                keys.select(F.col("project_id").alias("p"), F.col("item_key").alias("k")), F.col("project_id").eqNullSafe(F.col("p")) & (F.col("item_key") == F.col("k")), "left_semi")
            return file_changes(own, index)
        # All commits of the projects concerned, since the one that is named may be any of them.
        concerned = keys.where("project_id IS NOT NULL").select("project_id").distinct().withColumn("concerned", F.lit(True))
        return commit_changes(lookup(arrived, "project_id", concerned).where("concerned OR project_id IS NULL"), projects)

    return PendingJob(spark, path, {"files": scan, "commits": commits}, touched, pending)
