"""References to records that do not exist.

Direct orphans are found with one lookup per foreign key; children of orphaned records are orphans
by inheritance and are found by semi-joins down the foreign-key graph until nothing is added.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.skew import hot_keys, lookup
from tidemark.session import cut

EPOCH_2000 = "2000-01-01 00:00:00"


@dataclass(frozen=True)
class Entity:
    """A table in the graph. ``rows`` has the columns ``key`` (string, identifies the row) and
    ``time`` (timestamp or null) and the columns that foreign keys use; others are ignored."""

    name: str
    rows: DataFrame


@dataclass(frozen=True)
class ForeignKey:
    """``child.column`` must equal ``parent.parent_column``. With ``check_time`` a parent whose
    ``time`` is later than the child's counts as missing (it arrived after the reference)."""

    child: str
    column: str
    parent: str
    parent_column: str
    check_time: bool = False


def sane_time(c):
    """Times before 2000 count as missing."""
    return F.when(c >= F.lit(EPOCH_2000).cast("timestamp"), c)


def _direct(fk: ForeignKey, tables: dict[str, DataFrame], hot: DataFrame) -> DataFrame:
    child, parent = tables[fk.child], tables[fk.parent]
    refs = child.select("key", "time", F.col(fk.column).alias("_ref")).where(F.col("_ref").isNotNull())
    dim = parent.groupBy(F.col(fk.parent_column).alias("_ref")).agg(F.min("time").alias("_made"), F.lit(True).alias("_there"))
    found = lookup(refs, "_ref", dim, hot=hot)
    missing = F.col("_there").isNull()
    late = F.col("_made") > F.col("time") if fk.check_time else F.lit(False)
    why = F.when(missing, "missing").when(late, "late")
    return found.select(
        F.lit(fk.child).alias("ref_table"),
        F.col("key").alias("ref_key"),
        F.lit(fk.column).alias("ref_column"),
        F.lit(fk.parent).alias("parent_table"),
        F.col("_ref").cast("string").alias("parent_key"),
        "time",
        why.alias("reason"),
    ).where(F.col("reason").isNotNull())


def orphans(entities: list[Entity], keys: list[ForeignKey]) -> DataFrame:
    """One row per orphaned reference: ``ref_table, ref_key, ref_column, parent_table, parent_key,
    kind, reason, depth, period``.

    ``kind`` is ``direct`` (reason ``missing`` or ``late``) or ``inherited`` (reason ``parent``: the
    parent exists but is an orphan itself; ``depth`` is its distance from a direct one). ``period``
    is the month of the child's time, ``unknown`` without one. Null references are none. Repeated
    child rows are references of their own; a parent key that occurs twice exists once, since its
    earliest time. Empty tables give no rows; every reference into an empty parent is missing.
    A child that is a direct orphan by one key may also be an inherited one by another. The cascade
    ends when a round adds nothing, however long the chains are; a row enters it once, so cycles end too.
    """
    tables = {e.name: e.rows for e in entities}
    parents = {k.parent for k in keys}
    hot = {(k.child, k.column): hot_keys(tables[k.child].select(F.col(k.column).alias("_ref")), ["_ref"]) for k in keys}
    parts = [_direct(k, tables, hot[k.child, k.column]).withColumns({"kind": F.lit("direct"), "depth": F.lit(0)}) for k in keys]
    # Only tables that are themselves parents can pass orphanhood on.
    frontier: dict[str, DataFrame] = {}
    for p in sorted(parents):
        own = [d.select("ref_key") for k, d in zip(keys, parts) if k.child == p]
        if own:
            frontier[p] = cut(reduce(DataFrame.unionByName, own).distinct())
    known = dict(frontier)
    for depth in count(1):
        frontier = {p: f for p, f in frontier.items() if not f.isEmpty()}
        if not frontier:
            break
        fresh: dict[str, list[DataFrame]] = {}
        for k in keys:
            if k.parent not in frontier:
                continue
            gone = tables[k.parent].join(frontier[k.parent].withColumnRenamed("ref_key", "key"), "key", "left_semi")
            gone = gone.select(F.col(k.parent_column).alias("_ref")).where(F.col("_ref").isNotNull()).distinct().withColumn("_gone", F.lit(True))
            refs = tables[k.child].select("key", "time", F.col(k.column).alias("_ref"))
            hit = lookup(refs, "_ref", gone, hot=hot[k.child, k.column]).where("_gone")
            level = hit.select(
                F.lit(k.child).alias("ref_table"), F.col("key").alias("ref_key"), F.lit(k.column).alias("ref_column"),
                F.lit(k.parent).alias("parent_table"), F.col("_ref").cast("string").alias("parent_key"), "time",
                F.lit("parent").alias("reason"), F.lit("inherited").alias("kind"), F.lit(depth).alias("depth"),
            )
            parts.append(level)
            if k.child in parents:
                fresh.setdefault(k.child, []).append(level.select("ref_key"))
        frontier = {}
        for p, found in fresh.items():
            new = reduce(DataFrame.unionByName, found).distinct()
            if p in known:
                new = new.join(known[p], "ref_key", "left_anti")
            frontier[p] = cut(new)
            known[p] = frontier[p] if p not in known else cut(known[p].unionByName(frontier[p]))
    period = F.coalesce(F.date_format("time", "yyyy-MM"), F.lit("unknown"))
    return reduce(DataFrame.unionByName, parts).withColumn("period", period).drop("time")


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphans per table, month and kind."""
    return found.groupBy("ref_table", "period", "kind").agg(F.count(F.lit(1)).alias("n_refs"))


def chunk_reference_tables(chunks: DataFrame, interactions: DataFrame, searches: DataFrame, edges: DataFrame) -> list[Entity]:
    """The tables that name chunk ids, as entities with ``chunk_id``. A list of ids in any notation
    is read as its runs of digits; an id that is twice in one list is one reference."""
    ts = lambda c: F.col(c).cast("timestamp")
    ids = F.array_distinct(F.regexp_extract_all("result_chunk_ids", F.lit(r"-?\d+"), F.lit(0)))
    built = F.try_to_timestamp(F.get_json_object("metadata", "$.built_at"))
    return [
        Entity("chunks", chunks.select(F.col("id").cast("string").alias("key"), F.col("id").alias("chunk_id"), ts("created_at").alias("time"))),
        Entity("chunk_interactions", interactions.select(F.col("id").cast("string").alias("key"), "chunk_id", sane_time(ts("timestamp")).alias("time"))),
        Entity("search_log", searches.select(F.col("id").cast("string").alias("key"), F.explode(ids).alias("chunk_id"), sane_time(ts("timestamp")).alias("time"))
               .withColumn("chunk_id", F.expr("try_cast(chunk_id AS bigint)"))),
        Entity("edges", edges.select(F.concat_ws("|", "source_id", "target_id", "edge_type").alias("key"), F.col("target_id").alias("chunk_id"), sane_time(built).alias("time"))),
    ]


CHUNK_KEYS = [ForeignKey(t, "chunk_id", "chunks", "chunk_id", check_time=True) for t in ("chunk_interactions", "search_log", "edges")]
