"""Sessions of activity, kept in a table that each new batch updates in place.

Events are first folded into slots of one gap's length per group: two consecutive events of a slot
are less than a gap apart, so a slot never holds a session boundary. That fold is a plain
aggregation with map-side combine. What is left per group is bounded by time (86,400 / gap slots a
day), however hot the group, so the ordered pass over slots fits any task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tidemark.sources.manifest import Manifest

GAP_US = 30 * 60 * 1_000_000
DAY_US = 86_400 * 1_000_000
MIN_US = 946_684_800_000_000  # 2000-01-01


def _day(us: Column) -> Column:
    return F.floor(us / F.lit(DAY_US)).cast("int")


#: Events that one task takes at most, on average; a batch is spread over so many buckets a day.
BUCKET_ROWS = 2_000_000
#: Writes that may hold events of one day before they are written anew as one.
MAX_WRITES = 8


def clean_events(df: DataFrame, group: str, time: str, kind: str, other: list[str]) -> DataFrame:
    """Usable events, repeated ones among them: ``grp, us, kind, a, b``.

    ``grp`` is trimmed and lower-cased; rows with null or empty group, null time or a time before
    2000 are left out. Rows equal in group, time, kind and the columns ``other`` (spelt as they are)
    are one event; ``a`` and ``b`` identify it in 128 bits.
    """
    raw = [group, time, kind, *other]
    parts = [x for c in raw for x in (F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    us = F.unix_micros(F.col(time).cast("timestamp"))
    grp = F.lower(F.trim(F.col(group)))
    return (
        df.where(F.col(group).isNotNull() & F.col(time).isNotNull())
        .select(grp.alias("grp"), us.alias("us"), F.lower(F.trim(F.coalesce(F.col(kind), F.lit("unknown")))).alias("kind"),
                F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *reversed(parts)).alias("b"))
        .where((F.col("us") >= MIN_US) & (F.col("grp") != ""))
    )


def _counts(kinds: list[str]) -> list[Column]:
    return [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds]


def slots(events: DataFrame, kinds: list[str], gap_us: int = GAP_US) -> DataFrame:
    """Events folded into slots: ``grp, start_us, end_us, n_events, n_<kind>...``."""
    return (
        events.groupBy("grp", F.floor(F.col("us") / F.lit(gap_us)).alias("slot"))
        .agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("n_events"), *_counts(kinds))
        .drop("slot")
    )


def merge_intervals(parts: DataFrame, kinds: list[str], gap_us: int = GAP_US) -> DataFrame:
    """Slots or sessions joined where at most ``gap_us`` lies between them."""
    w = W.partitionBy("grp").orderBy("start_us", "end_us")
    before = F.max("end_us").over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("start_us") - before > gap_us), 1).otherwise(0)
    totals = ["n_events", *(f"n_{k}" for k in kinds)]
    return (
        parts.withColumn("new", new).withColumn("no", F.sum("new").over(w))
        .groupBy("grp", "no")
        .agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), *(F.sum(c).alias(c) for c in totals))
        .drop("no")
    )


def sessionize(df: DataFrame, group: str, time: str, kind: str, other: list[str], kinds: list[str], gap_us: int = GAP_US) -> DataFrame:
    """All sessions of ``df`` in one pass, without a stored table."""
    return merge_intervals(slots(clean_events(df, group, time, kind, other).distinct(), kinds, gap_us), kinds, gap_us)


class SessionTable:
    """Sessions stored by the day of their start, updated batch by batch.

    Each batch's local sessions are compared with the stored ones within a gap, sessions that a
    batch bridges become one, and the affected days are replaced together by one manifest commit.
    Batches may come in any order and overlap; an event that an earlier batch brought is not counted
    again. A batch that fails leaves the table as it was and can be repeated. An empty batch changes
    nothing. Extra columns are ignored.
    """

    def __init__(self, spark: SparkSession, path: str, group: str, time: str, kind: str, other: list[str], kinds: list[str], gap_us: int = GAP_US):
        self.spark, self.table = spark, Manifest(spark, path)
        self.columns, self.kinds, self.gap = (group, time, kind, other), kinds, gap_us
        self.schema = "grp string, start_us bigint, end_us bigint, n_events bigint" + "".join(f", `n_{k}` bigint" for k in kinds)

    def _read(self, days: dict[str, str], what: str, schema: str) -> DataFrame:
        """The given days of the table; ``days`` maps a day to the write that holds it."""
        paths = [f"{self.table.path}/data/{v}/{what}/day={d}" for d, v in sorted(days.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def sessions(self) -> DataFrame:
        """The newest version of the table."""
        return self._read({d: x["write"] for d, x in self.table.current()[1].get("days", {}).items()}, "sessions", self.schema)

    def apply(self, batch: DataFrame) -> int:
        """Merge one batch; the number of the version that holds it."""
        base, now = self.table.current()
        days, seen = dict(now.get("days", {})), {d: list(v) for d, v in now.get("seen", {}).items()}
        write = self.table.new_data()
        name = write.rsplit("/", 1)[1]

        span = batch.select(F.unix_micros(F.col(self.columns[1]).cast("timestamp")).alias("us")).where(F.col("us") >= MIN_US)
        n, lo, hi = span.agg(F.count(F.lit(1)), F.min("us"), F.max("us")).first()
        if not n:
            return base
        near = {d: v for d, v in seen.items() if lo // DAY_US <= int(d) <= hi // DAY_US}
        events = clean_events(batch, *self.columns).select("a", "b", "grp", "us", "kind", _day(F.col("us")).alias("day"), F.lit(False).alias("old"))
        # Days that too many writes hold are taken over whole, so that their number stays bounded.
        full = [d for d, v in near.items() if len(v) >= MAX_WRITES]
        if near:
            old = self.spark.read.schema("a bigint, b bigint, grp string, us bigint, kind string").parquet(*(f"{self.table.path}/data/{v}/seen/day={d}" for d, vs in sorted(near.items()) for v in vs))
            events = events.unionByName(old.withColumns({"day": _day(F.col("us")), "old": F.lit(True)}))
        # One shuffle by day and bucket finds the events that are new, folds repeated ones, and lays
        # them out as they are written; that copy is what later batches are compared with.
        bucket = F.pmod("a", F.lit(-(-n // BUCKET_ROWS)))
        events = events.withColumn("bucket", bucket).repartition("day", "bucket").groupBy("day", "bucket", "a", "b", "grp", "us", "kind").agg(F.bool_or("old").alias("old"))
        keep = ~F.col("old") | F.col("day").isin([int(d) for d in full]) if full else ~F.col("old")
        events.where(keep).drop("bucket").write.partitionBy("day").parquet(f"{write}/seen")
        stored = self.spark.read.schema("grp string, us bigint, kind string, old boolean, day int").parquet(f"{write}/seen")
        fresh = stored.where("NOT old")
        touched = sorted(r[0] for r in fresh.select("day").distinct().collect()) if full else [int(x.split("=")[1]) for x in self.table.subfolders(f"{write}/seen")]
        if not touched:
            return base
        gap_days = -(-self.gap // DAY_US)
        close = {}
        for d, x in days.items():
            first, last = int(d) - gap_days, (x["last_us"] + self.gap) // DAY_US
            if any(first <= t <= last for t in touched):
                close[d] = x
        stored = self._read({d: x["write"] for d, x in close.items()}, "sessions", self.schema)
        merged = merge_intervals(slots(fresh, self.kinds, self.gap).unionByName(stored), self.kinds, self.gap)
        merged = merged.withColumn("day", _day(F.col("start_us")))
        merged.repartition("day").write.partitionBy("day").parquet(f"{write}/sessions")

        for d in close:
            del days[d]
        last = self.spark.read.schema(self.schema + ", day int").parquet(f"{write}/sessions").groupBy("day").agg(F.max("end_us").alias("m")).collect()  # one row a day
        for r in last:
            days[str(r["day"])] = {"write": name, "last_us": r["m"]}
        for t in touched:
            seen.setdefault(str(t), []).append(name)
        seen |= {d: [name] for d in full}
        return self.table.commit(base, {"days": days, "seen": seen})
