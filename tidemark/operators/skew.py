"""Joins against a unique key when a few keys may hold a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

#: At most this many keys are treated as hot, so what is broadcast never exceeds it.
MAX_HOT = 2000


def hot_keys(df: DataFrame, keys: list[str], least: int = 10_000) -> DataFrame:
    """The keys with at least ``least`` rows, the ``MAX_HOT`` most frequent ones at most.

    Counting combines on the map side, so the shuffle carries one row per key and partition. A key
    that is left out has at most 1/MAX_HOT of all rows, which one task can hold.
    """
    known = [F.col(k).isNotNull() for k in keys]
    counts = df.where(reduce(lambda a, b: a & b, known)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= least)
    found = counts.orderBy(F.desc("_rows"), *keys).limit(MAX_HOT).select(*keys).collect()
    return df.sparkSession.createDataFrame([tuple(r) for r in found], counts.select(*keys).schema)


def lookup(df: DataFrame, key: str | list[str], dim: DataFrame, least: int = 10_000, hot: DataFrame | None = None) -> DataFrame:
    """Left join of ``df`` with ``dim``, whose ``key`` (a column or several) is unique.

    Rows of hot keys meet a broadcast of at most ``MAX_HOT`` rows of ``dim`` and are not shuffled;
    all other rows go through a shuffled join. Null keys match nothing and keep null columns. Who looks
    up the same column repeatedly hands in its ``hot_keys`` as ``hot``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    hot = hot_keys(df, keys, least) if hot is None else hot
    if hot.isEmpty():
        return df.join(dim, keys, "left")
    hot_dim = hot.join(dim, keys, "left")
    few = df.join(F.broadcast(hot_dim), keys, "inner")
    rest = df.join(F.broadcast(hot), keys, "left_anti").join(dim, keys, "left")
    return few.unionByName(rest)
