"""The most similar vectors of every vector, by an adaptive scan of dimensions within probed lists.

1. Equal vectors become one representative, the smallest id; what is shuffled for that are 16-byte keys.
2. A fixed random rotation spreads the variance evenly over the dimensions, so that a partial
   distance over the first d of D dimensions, times D/d, estimates the whole one.
3. Centroids from a bounded sample split the vectors into cells of about ``cell_size``, so there are more
   cells, not greater ones, where there are more vectors. A vector goes to its own cell, and to those
   whose border to its own cell is nearer than a margin. The margin is measured: for a bounded set of
   vectors the true neighbours are found by brute force among all rows, and the margin is the one that
   reaches ``recall`` of them.
4. A cell's vectors are split into lists in the task that has them. Every vector visits the nearest
   lists in turn. The first gives it a bound, the distance of its k-th best so far; from then on
   distances are accumulated by blocks of columns, and after each block a hypothesis test (partial
   distance against the bound, widened by ``epsilon / sqrt(d)``) abandons the candidates that can
   hardly come below the bound. Each list visited tightens it.
5. What is left is compared in double precision on the vectors as they were given, in the same task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.operators.skew import lookup
from tidemark.session import written

#: Rows that the centroids are fitted on, at most; fewer where fewer cells need them.
SAMPLE = 200_000
#: Cells, at most: four rows of the sample each. Cells of more than CELL_ROWS vectors are cut into
#: parts by a hash of the id, and who visits the cell visits all parts.
MAX_CELLS = SAMPLE // 4
CELL_ROWS = 24_576
#: Vectors whose neighbours are found by brute force to measure the margin.
MEASURED = 400
#: Columns of the first block, which every pair of a probed list goes through, and of the next ones.
FIRST_BLOCK, BLOCK = 48, 16


def usable(batch: pa.RecordBatch, dims: int, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the rows that have an id and ``dims`` finite values that are not all zero."""
    ids, vectors = batch.column(0), batch.column(1)
    ok = pc.and_(pc.equal(pc.fill_null(pc.list_value_length(vectors), -1), dims), pc.is_valid(ids))
    ids, vectors = ids.filter(ok), vectors.filter(ok)
    flat = vectors.flatten()
    m = pc.fill_null(flat, math.nan).to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, dims)
    good = np.isfinite(m).all(axis=1) & m.any(axis=1)
    return ids.to_numpy(zero_copy_only=False)[good].astype(np.int64), m[good]


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision."""
    m = m.astype(np.float64)
    top = np.abs(m).max(axis=1, keepdims=True)  # squares of very great or small values would not fit
    m = m / top
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def binary(m: np.ndarray) -> pa.Array:
    """Rows as a column of bytes."""
    m = np.ascontiguousarray(m)
    width = m.shape[1] * m.dtype.itemsize
    offsets = np.arange(len(m) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(offsets), pa.py_buffer(m)])


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    step = max(1, (1 << 24) // max(1, len(c)))
    for _ in range(rounds):
        near = np.concatenate([np.argmax(x[i : i + step] @ c.T, axis=1) for i in range(0, len(x), step)])
        order = np.argsort(near, kind="stable")
        starts = np.flatnonzero(np.diff(near[order], prepend=-1))
        c[near[order][starts]] = np.add.reduceat(x[order], starts)
        norm = np.linalg.norm(c, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, c / np.maximum(norm, 1e-9), x[rng.integers(0, len(x), len(c))])
    return c.astype(np.float32)


def borders(x: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The own cell of each row, and its distance from the border of that cell to every other cell."""
    sim = x @ cells.T
    own = np.argmax(sim, axis=1)
    apart = np.sqrt(np.maximum(1e-12, 2 - 2 * (cells[own] @ cells.T)))
    return own, (sim[np.arange(len(x)), own][:, None] - sim) / apart


class Scan:
    """The ``k`` nearest members of one cell for every query, in single precision on rotated vectors."""

    def __init__(self, members: np.ndarray, member_ids: np.ndarray, k: int, keep: int, list_size: int, probes: int, epsilon: float):
        self.ids, self.k, self.keep, self.eps = member_ids, k, keep, epsilon
        self.centroids = fit_centroids(members, max(1, round(len(members) / list_size)), 5)
        home = np.argmax(members @ self.centroids.T, axis=1)
        self.order = np.argsort(home, kind="stable")
        self.members = np.ascontiguousarray(members[self.order])
        self.start = np.searchsorted(home[self.order], np.arange(len(self.centroids) + 1))
        self.probes = min(probes, len(self.centroids))

    def _first(self, q, q_ids, lo, hi):
        """The best of the list ``lo:hi`` by whole distances: (distance, member) per query."""
        y, width = self.members[lo:hi], min(self.keep, hi - lo)
        d = np.maximum(0, 2 - 2 * (q @ y.T))
        d[q_ids[:, None] == self.ids[self.order[lo:hi]][None, :]] = np.inf
        top = np.argpartition(d, width - 1, axis=1)[:, :width]
        d = np.take_along_axis(d, top, 1)
        by = np.argsort(d, axis=1)
        d, top = np.take_along_axis(d, by, 1), np.take_along_axis(top, by, 1)
        return d, np.where(np.isinf(d), -1, top + lo)

    def _survivors(self, q, bound, y):
        """(query, member, squared distance) of the pairs that no test abandons."""
        dims = q.shape[1]
        have = min(FIRST_BLOCK, dims)
        slack = lambda d: (d / dims) * (1 + self.eps / math.sqrt(d)) ** 2 if d < dims else 1 + 1e-5
        # One product gives by how much each partial distance is below its limit.
        left = np.hstack([2 * q[:, :have], np.ones((len(q), 1), np.float32), (bound * slack(have) - (q[:, :have] ** 2).sum(1))[:, None]])
        right = np.hstack([y[:, :have], -(y[:, :have] ** 2).sum(1)[:, None], np.ones((len(y), 1), np.float32)])
        below = left.astype(np.float32) @ right.T
        a, b = np.nonzero(below >= 0)
        part = bound[a] * slack(have) - below[a, b]
        while have < dims:
            lo, have = have, min(have + BLOCK, dims)
            part = part + ((q[a, lo:have] - y[b, lo:have]) ** 2).sum(1)
            ok = part <= bound[a] * slack(have)
            a, b, part = a[ok], b[ok], part[ok]
        return a, b, part

    def nearest(self, q: np.ndarray, q_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) positions of the ``keep`` best of every query."""
        n, keep = len(q), self.keep
        dist, at = np.full((n, keep), np.inf, np.float32), np.full((n, keep), -1, np.int64)
        sim = q @ self.centroids.T
        lists = np.argsort(-sim, axis=1, kind="stable")[:, : self.probes]
        for turn in range(self.probes):
            by = np.argsort(lists[:, turn], kind="stable")
            cuts = np.searchsorted(lists[by, turn], np.arange(len(self.centroids) + 1))
            found = []
            for no in range(len(self.centroids)):
                lo, hi = self.start[no], self.start[no + 1]
                for a in range(cuts[no], cuts[no + 1] if hi > lo else 0, 2048):
                    who = by[a : min(a + 2048, cuts[no + 1])]
                    if turn == 0:
                        d, j = self._first(q[who], q_ids[who], lo, hi)
                        dist[who, : d.shape[1]], at[who, : d.shape[1]] = d, j
                        continue
                    # Without a bound nothing is abandoned: squared distances of unit vectors end at 4.
                    i, j, d = self._survivors(q[who], np.minimum(dist[who, self.k - 1], 4.0), self.members[lo:hi])
                    i, j = who[i], lo + j
                    other = self.ids[self.order[j]] != q_ids[i]
                    found.append((i[other], j[other], d[other]))
            if found:
                self._merge(dist, at, *(np.concatenate(x) for x in zip(*found)))
        i, c = np.nonzero(at >= 0)
        return i, self.order[at[i, c]]

    def _merge(self, dist, at, i, j, d):
        """Take the new pairs into the best of their queries."""
        who = np.unique(i)
        i = np.concatenate([i, np.repeat(who, self.keep)])
        j, d = np.concatenate([j, at[who].ravel()]), np.concatenate([d, dist[who].ravel()])
        order = np.lexsort((d, i))
        i, j, d = i[order], j[order], d[order]
        first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
        place = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
        ok = place < self.keep
        at[i[ok], place[ok]], dist[i[ok], place[ok]] = j[ok], d[ok]


class Neighbours:
    """The ``k`` most similar other vectors of every usable one by cosine.

    Rows that have no id or whose vector is null, not of ``dims`` finite values, or zero take no
    part. Equal cosines go to the smaller id. Repeated vectors are neighbours of each other with
    cosine 1, however many there are. Fewer than k + 1 vectors give what there is; empty tables give
    empty results. Extra columns are ignored. Ids are unique. Every row is indexed; the centroids are
    fitted on at most ``SAMPLE`` rows and the margin on ``MEASURED`` vectors against all rows.
    ``df`` is read several times and should be a stored table.
    """

    def __init__(self, df: DataFrame, id_col: str, vec_col: str, dims: int = 64, k: int = 5, recall: float = 0.995, probes: int = 12, epsilon: float = 1.5, list_size: int = 100, cell_size: int = 8192, seed: int = 3):
        self.spark, self.dims, self.k, self.recall, self.seed = df.sparkSession, dims, k, recall, seed
        self.scan_with = (k, k + 3, list_size, probes, epsilon)
        source = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
        self.dtype = np.float32 if source.schema["vec"].dataType.elementType.simpleString() == "float" else np.float64
        dtype = self.dtype

        def keyed(batches):
            for batch in batches:
                ids, m = usable(batch, dims, dtype)
                x = np.round(unit(m), 12) + 0.0
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([xxhash.xxh3_128_digest(r.tobytes()) for r in x], pa.binary())], ["id", "key"])

        keys = written(source.mapInArrow(keyed, "id bigint, key binary"), "keys")
        multi = keys.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        #: Every member of a group of equal vectors, and the group's smallest id.
        self.copies = written(lookup(keys, "key", multi).where("rep IS NOT NULL").select("id", "rep"), "copies")
        others = self.copies.where("id <> rep").select("id")
        self.reps = source.join(others, "id", "left_anti").select("id", "vec")
        self.total = keys.count() - others.count()
        self.rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))[0].astype(np.float32)
        self.cells = max(1, min(MAX_CELLS, round(self.total / cell_size)))
        self.centroids, self.parts, self.margin = self._fit()

    def _fit(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Centroids of the cells, the parts of each, and the margin."""
        dims, dtype, k = self.dims, self.dtype, self.k
        if not self.total:
            return np.zeros((1, dims), np.float32), np.ones(1, np.int64), 0.0
        size = min(SAMPLE, max(50_000, 4 * self.cells))
        share = min(1.0, 1.1 * size / self.total)

        def as_bytes(batches):
            for batch in batches:
                ids, m = usable(batch, dims, dtype)
                yield pa.RecordBatch.from_arrays([pa.array(ids), binary(m)], ["id", "v"])

        some = self.reps.sample(share, self.seed) if share < 1 else self.reps
        rows = some.mapInArrow(as_bytes, "id bigint, v binary").limit(size).toPandas()
        x = unit(np.frombuffer(b"".join(rows["v"]), dtype).reshape(-1, dims)).astype(np.float32)
        cent = fit_centroids(x, self.cells) if len(x) else np.zeros((1, dims), np.float32)
        pick = np.random.default_rng(self.seed).permutation(len(x))[:MEASURED]
        q, q_ids = x[pick], rows["id"].to_numpy()[pick]
        shared = self.spark.sparkContext.broadcast((cent, q, q_ids, borders(q, cent)[1]))  # at most MAX_CELLS centroids

        def measure(batches):
            cent, q, q_ids, apart = shared.value
            count = np.zeros(len(cent), np.int64)
            best, need = np.full((len(q), k), -9.0, np.float32), np.zeros((len(q), k), np.float32)
            for batch in batches:
                ids, m = usable(batch, dims, dtype)
                if not len(ids):
                    continue
                y = unit(m).astype(np.float32)
                home = np.argmax(y @ cent.T, axis=1)
                count += np.bincount(home, minlength=len(cent))
                sim = np.where(q_ids[:, None] == ids[None, :], -9, q @ y.T)
                both, of = np.hstack([best, sim]), np.hstack([need, apart[:, home]])
                top = np.argpartition(-both, k - 1, axis=1)[:, :k]
                best, need = np.take_along_axis(both, top, 1), np.take_along_axis(of, top, 1)
            a, b = np.nonzero(best > -5)
            c = np.flatnonzero(count)
            yield pd.DataFrame({
                "q": np.concatenate([a, np.full(len(c), -1)]).astype(np.int32), "value": np.concatenate([best[a, b], c]).astype(np.float64),
                "other": np.concatenate([need[a, b], count[c]]).astype(np.float64)})

        def as_arrow(batches):
            for pdf in measure(batches):
                yield pa.RecordBatch.from_pandas(pdf, preserve_index=False)

        got = written(self.reps.mapInArrow(as_arrow, "q int, value double, other double"), "measured")
        parts = np.ones(len(cent), np.int64)
        for r in got.where("q < 0").groupBy("value").agg(F.sum("other").alias("n")).collect():  # one row a cell
            parts[int(r["value"])] = -(-int(r["n"]) // CELL_ROWS)
        place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("value")))
        need = [r["other"] for r in got.where("q >= 0").withColumn("place", place).where(F.col("place") <= k).select("other").collect()]  # MEASURED * k
        return cent, parts, max(0.0, float(np.quantile(need, self.recall, method="higher"))) if need else 0.0

    def neighbours(self) -> DataFrame:
        """``id, other, cosine`` candidates among representatives; the k best of each are right but for the
        accepted loss."""
        dims, dtype, scan_with = self.dims, self.dtype, self.scan_with
        shared = self.spark.sparkContext.broadcast((self.centroids, self.parts, self.margin, self.rotation))

        def enter(batches):
            """Each vector once for every part of a cell that it is in or visits."""
            cent, parts, margin, _ = shared.value
            for batch in batches:
                ids, m = usable(batch, dims, dtype)
                if not len(ids):
                    continue
                own, apart = borders(unit(m).astype(np.float32), cent)
                apart[np.arange(len(ids)), own] = -1
                row, cell = np.nonzero(apart <= margin)
                times = parts[cell]
                row, cell = np.repeat(row, times), np.repeat(cell, times)
                part = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                at_home = (cell == own[row]) & (part == (ids[row] * 0x9E3779B1 & 0x7FFFFFFF) % parts[cell])
                for lo in range(0, len(row), 4000):
                    s = slice(lo, lo + 4000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell[s].astype(np.int32)), pa.array(part[s].astype(np.int32)), pa.array(ids[row[s]]), binary(m[row[s]]), pa.array(at_home[s])], ["cell", "part", "id", "v", "home"])

        def probe(pdf: pd.DataFrame) -> pd.DataFrame:
            k, keep, *how = scan_with
            home, ids = pdf["home"].to_numpy(), pdf["id"].to_numpy()
            if not home.any():
                return pd.DataFrame({"id": [], "other": [], "cosine": []}).astype({"id": "int64", "other": "int64", "cosine": "float64"})
            x = unit(np.frombuffer(b"".join(pdf["v"]), dtype).reshape(-1, dims))
            low = x.astype(np.float32) @ shared.value[3]
            members = np.flatnonzero(home)
            scan = Scan(low[members], ids[members], k, keep, *how)
            out = []
            for lo in range(0, len(ids), 8192):
                i, j = scan.nearest(low[lo : lo + 8192], ids[lo : lo + 8192])
                i, j = i + lo, members[j]
                cos = np.einsum("ij,ij->i", x[i], x[j])
                order = np.lexsort((ids[j], -cos, i))
                i, j, cos = i[order], j[order], cos[order]
                first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.empty(0, np.int64)
                ok = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i)))) < k
                out.append(pd.DataFrame({"id": ids[i[ok]], "other": ids[j[ok]], "cosine": cos[ok]}))
            return pd.concat(out)

        rows = self.reps.mapInArrow(enter, "cell int, part int, id bigint, v binary, home boolean")
        return rows.groupBy("cell", "part").applyInPandas(probe, "id bigint, other bigint, cosine double")

    def top(self) -> DataFrame:
        """``id, other, cosine, place``: the k nearest of every vector, copies included."""
        k = self.k
        place = F.row_number().over(W.partitionBy("id").orderBy(F.desc("cosine"), "other"))
        ranked = lambda df: df.withColumn("place", place).where(F.col("place") <= k)
        near = self.neighbours()
        if self.copies.isEmpty():
            return ranked(near)
        # The smallest k + 1 ids of each group, picked in two levels so that no group fills a task.
        least = lambda *by: F.row_number().over(W.partitionBy("rep", *by).orderBy("id"))
        few = self.copies.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("no", least("salt")).where(F.col("no") <= k + 1)
        few = written(few.withColumn("no", least()).where(F.col("no") <= k + 1).select("rep", F.col("id").alias("copy")), "few")
        wide = near.join(few.select(F.col("rep").alias("other"), "copy"), "other", "left").select("id", F.coalesce("copy", "other").alias("other"), "cosine")
        wide = written(ranked(wide), "ranked")
        groups = few.select(F.col("rep").alias("id")).distinct()
        # What a member of a group can have: the group's smallest ids, and the nearest of its representative.
        pairs = few.select("rep", F.col("copy").alias("other"), F.lit(1.0).alias("cosine")).unionByName(wide.join(groups, "id", "left_semi").select(F.col("id").alias("rep"), "other", "cosine"))
        lists = pairs.groupBy("rep").agg(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "other")).alias("c"))  # at most 2 k + 1
        members = lookup(self.copies, "rep", lists).select("id", F.filter("c", lambda x: x["other"] != F.col("id")).alias("c"))
        own = members.select("id", F.posexplode(F.slice(F.array_sort("c"), 1, k)).alias("place", "c"))
        own = own.select("id", F.col("c.other").alias("other"), (-F.col("c.far")).alias("cosine"), (F.col("place") + 1).alias("place"))
        return wide.join(groups, "id", "left_anti").select("id", "other", "cosine", "place").unionByName(own)
