"""Mixtures of sources with target weights, by hierarchical budgeting.

Sources are leaves of a tree (here domain, language, source). Each node's weight is the sum of its
leaves'. What a leaf cannot give, even repeated as often as it may be, its siblings take over in
proportion to their weights, then the siblings of its parent, and so on up to the root. Each leaf
then contributes the first documents, in a seeded order that is drawn anew for every repetition,
whose tokens fill its budget. Everything is a DataFrame: there may be any number of sources.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.operators.skew import lookup
from tidemark.session import written

#: Buckets of documents by their draw; prefix sums run within buckets and over bucket totals.
BUCKETS = 1024


def plain_tokens(text: str) -> Column:
    """Runs of letters, digits and underscores, and other single characters that are not white space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[\p{L}\p{N}_]+|(?U:[^\s\p{L}\p{N}_])")), F.lit(0))


def bpe_tokens(text: str, ranks_path: str, pattern: str) -> Column:
    """Number of tokens of a public byte-level BPE; ``ranks_path`` names its vocabulary file."""

    @F.pandas_udf("int")
    def count(batches: "pd.core.series.Series") -> pd.Series:
        enc = _encoding(ranks_path, pattern)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in batches], dtype="int32")

    return count(F.col(text))


_encodings: dict = {}


def _encoding(path: str, pattern: str):
    if path not in _encodings:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def sized(docs: DataFrame, id_col: str, source_col: str, domain_col: str, lang_col: str, tokens: Column) -> DataFrame:
    """``id, source, domain, lang, tokens`` of documents that have an id, a source and tokens, written
    once: the texts are counted in one pass, and all that follows reads these few columns.

    Sources and domains are compared trimmed and in lower case, languages by their first subtag in
    lower case. Null domains are ``unknown``, null languages ``und``."""
    clean = lambda c: F.lower(F.trim(F.col(c)))
    got = docs.select(F.col(id_col).alias("id"), clean(source_col).alias("source"), F.coalesce(clean(domain_col), F.lit("unknown")).alias("domain"),
                      F.coalesce(F.substring_index(clean(lang_col), "-", 1), F.lit("und")).alias("lang"), tokens.alias("tokens"))
    # A filter on the tokens before they are written would have them counted twice.
    return written(got.where("id IS NOT NULL AND source IS NOT NULL"), "sized").where("tokens > 0")


def leaves(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source of ``targets`` (source, target_share, max_repeats): its ``tokens``, 0 where it
    has no documents, and the ``domain`` and ``lang`` that most of its documents have (of equal numbers
    the greater name). ``docs`` comes from ``sized``; documents of other sources are left out."""
    n = docs.groupBy("source", "domain", "lang").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    total = n.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    best = lambda c: n.groupBy("source", c).agg(F.sum("n").alias("n")).groupBy("source").agg(F.max(F.struct("n", c)).alias("m")).select("source", f"m.{c}")
    own = total.join(best("domain"), "source").join(best("lang"), "source")
    got = targets.select("source", "target_share", "max_repeats").join(own, "source", "left")
    return got.fillna(0, ["tokens"]).fillna("unknown", ["domain", "lang"])


def budgets(leaves: DataFrame, levels: list[str], total: float | None = None) -> DataFrame:
    """``leaves`` with ``wanted`` and ``budget``. Needs the columns ``levels`` (from the root down),
    ``target_share`` as weight, ``tokens`` and ``max_repeats``; ``supply`` is the product of the last two.

    ``wanted`` is the weight times ``total`` (default: the tokens of all leaves), ``budget`` what the
    leaf gives after shortages went to siblings first and to the relatives of each ancestor next. In
    each group the lack is shared at one rate per weight, up to what each leaf still has. The rate
    follows from the leaves in the order in which they run dry: it is the greatest rate at which a
    leaf would not run dry if all before it did.
    """
    whole = F.sum("tokens").over(W.partitionBy(F.lit(1))) if total is None else F.lit(float(total))  # a row per source
    out = leaves.withColumns({"supply": F.col("tokens") * F.col("max_repeats"), "wanted": F.col("target_share") * whole})
    out = out.withColumn("budget", F.least("wanted", F.col("supply").cast("double")))
    for depth in range(len(levels), -1, -1):
        group = W.partitionBy(*levels[:depth]) if depth else W.partitionBy(F.lit(1))
        out = out.withColumns({"_room": F.col("supply") - F.col("budget"), "_lack": F.sum("wanted").over(group) - F.sum("budget").over(group)})
        open_ = (F.col("_room") > 1e-9) & (F.col("target_share") > 0)
        out = out.withColumns({"_dry": F.when(open_, F.col("_room") / F.col("target_share")), "_w": F.when(open_, F.col("target_share")).otherwise(0.0)})
        line = group.orderBy(F.asc_nulls_last("_dry"), "source")
        before = F.coalesce(F.sum(F.when(open_, F.col("_room"))).over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
        rest = F.sum("_w").over(line.rowsBetween(0, W.unboundedFollowing))
        out = out.withColumn("_rate", F.try_divide(F.col("_lack") - before, rest))
        out = out.withColumn("_rate", F.max(F.when(F.col("_rate") <= F.col("_dry"), F.col("_rate"))).over(group))
        more = F.when(F.col("_rate").isNull(), F.col("supply").cast("double")).otherwise(F.least(F.col("supply").cast("double"), F.col("budget") + F.col("_rate") * F.col("target_share")))
        out = out.withColumn("budget", F.when((F.col("_lack") > 1e-9) & open_, more).otherwise(F.col("budget"))).drop("_room", "_lack", "_dry", "_w", "_rate")
    return out


def mix(docs: DataFrame, plan: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The mixture and its shares: ``(selected, shares)``. ``docs`` comes from ``sized``, ``plan`` from
    ``budgets``.

    ``selected``: ``id, source, copies`` with the number of times each chosen document is used, at
    most max_repeats; ``shares``: ``source, target_share, budget, tokens, uses, share`` as really
    reached. A budget is filled up to the document that would exceed it, so a leaf falls short by less
    than its longest document. Repeated ids are documents of their own; null texts, ids and sources
    were left out.
    """
    full = F.least(F.floor(F.coalesce(F.try_divide("budget", "tokens"), F.lit(0.0))).cast("int"), F.col("max_repeats"))
    plan = written(plan.withColumn("full", full).withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens")), "plan")
    own = lookup(docs.select("id", "source", "tokens"), "source", plan.select("source", "full", "rest")).where("full IS NOT NULL")
    # The last, partial epoch is a token prefix in the order of a seeded draw. Sums within buckets of
    # the draw and over the bucket totals keep a source with a third of all rows out of one task.
    text = F.concat_ws("|", F.lit(seed), "source", "full", F.col("id").cast("string"))
    draw = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    own = own.withColumn("draw", draw).withColumn("bucket", F.floor(F.col("draw") / F.lit((1 << 60) // BUCKETS)))
    totals = own.groupBy("source", "bucket").agg(F.sum("tokens").alias("here"))
    upto = F.sum("here").over(W.partitionBy("source").orderBy("bucket"))  # at most BUCKETS rows a source
    placed = own.join(totals.withColumn("before", upto - F.col("here")), ["source", "bucket"])
    # Only the bucket in which the budget ends has to be ordered.
    border = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("here") > F.col("rest"))
    once = F.when(F.col("before") + F.col("here") <= F.col("rest"), 1).otherwise(0)
    clear = placed.where(~border).select("id", "source", "tokens", (F.col("full") + once).alias("copies"))
    run = F.col("before") + F.sum("tokens").over(W.partitionBy("source", "bucket").orderBy("draw", "id"))
    edge = placed.where(border).withColumn("upto", run).select("id", "source", "tokens", (F.col("full") + F.when(F.col("upto") <= F.col("rest"), 1).otherwise(0)).alias("copies"))
    selected = clear.unionByName(edge).where("copies > 0")
    reached = selected.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("uses"))
    shares = plan.select("source", "target_share", "budget").join(reached, "source", "left").fillna(0, ["tokens", "uses"])
    shares = shares.withColumn("share", F.coalesce(F.try_divide("tokens", F.sum("tokens").over(W.partitionBy(F.lit(1)))), F.lit(0.0)))
    return selected.select("id", "source", "copies"), shares

