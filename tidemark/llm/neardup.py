"""Near-duplicate texts by a MinHash LSH forest with exact verification.

1. One pass turns each text into its set of word shingles, a signature of 16-bit minima and a
   128-bit sketch (the minima's lowest bits). Texts with equal sets become one representative.
2. Every signature is entered into ``TREES`` sorted tries: rows sorted by tree and label (``LABEL``
   successive minima). Neighbours in that order share the longest prefixes. Matches are first taken
   at full label length and then at ever shorter prefixes, each step adding the pairs that the longer
   one did not have, until a pair at the threshold is found with the target recall.
3. A prefix shared by more than ``dense`` rows is not shortened further there. Its members, and only
   they, go to a second forest with longer labels and as many trees as the target needs at the depth
   that it stops at; what is still dense in it is compared block by block in separate tasks, so
   nothing is dropped. Each forest is given half of the loss that the target allows. Pairs whose
   sketches are further apart than a pair at the threshold gets (four standard deviations) are not
   passed on.
4. Candidate pairs are verified on the full shingle sets, and copies are added to the result.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.operators.components import components
from tidemark.operators.skew import lookup
from tidemark.session import written

WORDS = re.compile(r"[^\W_]+")
N_PERM = 128
#: Tries of the first forest and minima of a label; together at most N_PERM, so that tries are independent.
TREES, LABEL = 25, 5
#: Minima of a label of the second forest, and the prefix that it is shortened to.
LABEL2, DEPTH2 = 8, 6
#: Rows that a broadcast of candidate ids may have (8 bytes each); beyond it the join is shuffled.
BROADCAST_IDS = 1_000_000
#: Rows of one key that a task keeps in memory.
HELD = 100_000

_rng = np.random.default_rng(20240607)
_A = _rng.integers(1, 2**63, N_PERM, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**63, N_PERM, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """64-bit hashes of words, kept while the vocabulary fits."""

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


def shingle_sets(texts, width: int, least_words: int, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted by text; and the number per text (0 for texts
    that are null or have fewer than ``least_words`` words)."""
    words, counts = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            w = WORDS.findall(t.lower())
            if len(w) >= max(least_words, width):
                words.append(np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w)))
                counts[i] = len(w)
    if not words:
        return np.empty(0, np.uint64), counts
    flat = np.concatenate(words)
    n = len(flat) - width + 1
    acc = np.zeros(n, np.uint64)
    for j in range(width):
        acc = mix(acc + flat[j : j + n] * np.uint64(2 * j + 1))
    doc = np.repeat(np.arange(len(texts)), counts)
    inside = doc[:n] == doc[width - 1 :]
    acc, doc = acc[inside], doc[:n][inside]
    order = np.lexsort((acc, doc))
    acc, doc = acc[order], doc[order]
    first = np.ones(len(acc), bool)
    first[1:] = (acc[1:] != acc[:-1]) | (doc[1:] != doc[:-1])
    acc, doc = acc[first], doc[first]
    return acc, np.bincount(doc, minlength=len(texts))


def signatures(sets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """16-bit minima, one row per non-empty set."""
    starts = np.concatenate([[0], np.cumsum(counts[counts > 0])[:-1]]).astype(np.int64)
    out = np.empty((len(starts), N_PERM), np.uint16)
    for p in range(N_PERM):
        low = np.minimum.reduceat(sets * _A[p] + _B[p], starts)
        out[:, p] = mix(low).astype(np.uint16)
    return out


def sketch_bits(sig: np.ndarray) -> np.ndarray:
    """The minima's lowest bits as two 64-bit words."""
    return np.packbits((sig & 1).astype(np.uint8), axis=1).view(np.int64)


def depth_for(threshold: float, trees: int, label: int, recall: float) -> int:
    """The length down to which labels must be shortened so that a pair at the threshold shares such a
    prefix in one of ``trees`` independent tries with probability ``recall``; 1 if none is enough."""
    return next((d for d in range(label, 1, -1) if 1 - (1 - threshold**d) ** trees >= recall), 1)


def trees_for(threshold: float, depth: int, recall: float) -> int:
    """Tries that reach ``recall`` at ``depth`` if each draws its minima from the same N_PERM.

    Of a pair at the threshold m minima agree, m binomial; given m, a drawn prefix agrees with
    probability C(m, depth) / C(N_PERM, depth), independently of the others."""
    m = range(N_PERM + 1)
    share = np.array([math.comb(N_PERM, x) * threshold**x * (1 - threshold) ** (N_PERM - x) for x in m])
    agree = np.array([math.comb(x, depth) / math.comb(N_PERM, depth) for x in m])
    return next(t for t in range(1, 100_000) if (share * (1 - (1 - agree) ** t)).sum() >= recall)


def _label_columns(tree: int, length: int, second: bool) -> np.ndarray:
    if not second:
        return np.arange(tree * length, (tree + 1) * length)
    return np.random.default_rng(7919 * (tree + 1)).choice(N_PERM, length, replace=False)


def _sketch(min_sim: float) -> int:
    p = (1 + min_sim) / 2
    return math.floor(N_PERM * p - 4 * math.sqrt(N_PERM * p * (1 - p)))


def _forest(sigs: DataFrame, threshold: float, depth: int, trees: int, length: int, dense: int, second: bool) -> DataFrame:
    """``a, b`` candidates, and ``a, null`` for members of dense prefixes. ``sigs``: id, n, sig."""
    cols = [_label_columns(t, length, second) for t in range(trees)]

    def enter(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            sig = np.frombuffer(b"".join(pdf["sig"]), np.uint16).reshape(len(pdf), N_PERM)
            sk = sketch_bits(sig)
            for t, c in enumerate(cols):
                key = np.full(len(pdf), t, np.uint64)
                for j in c[:depth]:
                    key = mix(key * np.uint64(31) + sig[:, j])
                rest = np.zeros(len(pdf), np.int64)
                for j in c[depth:]:
                    rest = (rest << 16) | sig[:, j]
                yield pd.DataFrame({"key": key.astype(np.int64), "rest": rest, "id": pdf["id"].to_numpy(), "n": pdf["n"].to_numpy(), "s1": sk[:, 0], "s2": sk[:, 1]})

    need = _sketch(threshold)

    def descend(batches):
        """Rows come sorted by key and rest; runs of one key may span batches."""
        held: list[pd.DataFrame] = []
        hot = None  # the key of ``held`` if rows of it were let go of before

        def done(pdf, hot):
            key, rest, ids, n = (pdf[c].to_numpy() for c in ("key", "rest", "id", "n"))
            sk = np.ascontiguousarray(pdf[["s1", "s2"]].to_numpy()).view(np.uint64)
            out, crowded, longer = [], np.zeros(len(pdf), bool), None
            for cut in range(length - depth + 1):  # minima cut off the full label
                part = rest >> (16 * cut)
                prefix = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
                size = np.bincount(prefix)[prefix]
                # Of a key that was let go of before, not all rows are here.
                stop = (size > dense) | ((key == hot) & (cut == length - depth) if hot is not None else False)
                out.append((ids[stop & ~crowded], None))
                crowded |= stop
                at, step = np.flatnonzero((size > 1) & ~stop), 1
                while len(at := at[at < len(pdf) - step]) and len(at := at[prefix[at] == prefix[at + step]]):
                    a = at if longer is None else at[longer[at] != longer[at + step]]
                    b = a + step
                    same = N_PERM - (np.bitwise_count(sk[a, 0] ^ sk[b, 0]).astype(np.int16) + np.bitwise_count(sk[a, 1] ^ sk[b, 1]))
                    ok = (same >= need) & (np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b])) & (ids[a] != ids[b])
                    if ok.any():
                        out.append((ids[a[ok]], ids[b[ok]]))
                    step += 1
                longer = prefix
            a, b = np.concatenate([x for x, _ in out]), np.concatenate([np.full(len(x), -1) if y is None else y for x, y in out])
            if len(a):
                left = np.concatenate([np.full(len(x), y is None) for x, y in out])
                yield pd.DataFrame({"a": np.where(left, a, np.minimum(a, b)), "b": np.where(left, -1, np.maximum(a, b)), "dense": left}).drop_duplicates()

        for pdf in batches:
            if not len(pdf):
                continue
            last = pdf["key"].iloc[-1]
            if held and held[0]["key"].iloc[0] == last:
                held.append(pdf)
                if sum(map(len, held)) > HELD:  # one key: all rows so far are dense, as are those to come
                    rows, hot = pd.concat(held), last
                    yield from done(rows, hot)
                    # Of the last label, which may go on, a few rows stay to be paired with those to come.
                    held = [rows[rows["rest"].to_numpy() == rows["rest"].iloc[-1]].head(dense + 1)]
                continue
            tail = pdf["key"].to_numpy() == last
            yield from done(pd.concat([*held, pdf[~tail]]), hot)
            held, hot = [pdf[tail]], None
        if held:
            yield from done(pd.concat(held), hot)

    rows = sigs.mapInPandas(enter, "key bigint, rest bigint, id bigint, n int, s1 bigint, s2 bigint")
    rows = rows.repartition("key").sortWithinPartitions("key", "rest", "id")
    return rows.mapInPandas(descend, "a bigint, b bigint, dense boolean").distinct()


def _blocks(sigs: DataFrame, ids: DataFrame, threshold: float, size: int) -> DataFrame:
    """All pairs of the signatures named in ``ids`` that the sketch lets pass, block against block.

    Used for members of prefixes that are dense even with the second forest's full labels."""
    need = _sketch(threshold)
    n_blocks = max(1, math.ceil(ids.count() / size))
    own = sigs.join(ids, "id", "left_semi").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)))
    side = own.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("other"), "block", "id", "n", "sig")
    side = side.select(F.least("other", "block").alias("x"), F.greatest("other", "block").alias("y"), "id", "n", "sig", "block")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint16).reshape(len(pdf), N_PERM)
        sk, ids_, n, blk = sketch_bits(sig).view(np.uint64), pdf["id"].to_numpy(), pdf["n"].to_numpy(), pdf["block"].to_numpy()
        x, y = pdf["x"].iloc[0], pdf["y"].iloc[0]
        left, right = np.flatnonzero(blk == x), np.flatnonzero(blk == y)
        out = []
        for i in left:
            same = N_PERM - (np.bitwise_count(sk[i, 0] ^ sk[right, 0]).astype(np.int16) + np.bitwise_count(sk[i, 1] ^ sk[right, 1]))
            ok = right[(same >= need) & (np.minimum(n[i], n[right]) >= threshold * np.maximum(n[i], n[right]))]
            ok = ok[ids_[ok] > ids_[i]] if x == y else ok[ids_[ok] != ids_[i]]
            out.append(pd.DataFrame({"a": np.minimum(ids_[i], ids_[ok]), "b": np.maximum(ids_[i], ids_[ok])}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []}, dtype="int64")

    return side.groupBy("x", "y").applyInPandas(compare, "a bigint, b bigint")


def _within(ids: DataFrame, df: DataFrame) -> DataFrame:
    """Rows of ``df`` whose id is in ``ids``; broadcast only if the ids are few enough."""
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        return df.join(F.broadcast(ids), "id", "left_semi")
    return df.join(ids, "id", "left_semi")


def _jaccard(width: int):
    @F.pandas_udf("double")
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            p, q = WORDS.findall(x.lower()), WORDS.findall(y.lower())
            s = set(zip(*(p[i:] for i in range(width))))
            t = set(zip(*(q[i:] for i in range(width))))
            both = len(s & t)
            return both / (len(s) + len(t) - both)

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")

    return f


class NearDuplicates:
    """Near-duplicates among the texts of ``df``.

    ``id_col`` must be a unique bigint. Texts that are null, empty or have fewer than ``least_words``
    words take no part. Repeated texts are copies and link with similarity 1. Very long texts are
    taken whole. Empty tables give empty results; other columns are ignored whatever their names.
    """

    def __init__(self, df: DataFrame, id_col: str, text_col: str, width: int = 3, threshold: float = 0.6, least_words: int = 20, recall: float = 0.995, dense: int = 400):
        self.texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        self.width, self.threshold, self.least, self.recall, self.dense = width, threshold, least_words, recall, dense
        self._sign()

    def _sign(self) -> None:
        width, least = self.width, self.least

        def sign(batches):
            hashes = WordHashes()
            for pdf in batches:
                for k in range(0, len(pdf), 500):
                    part = pdf.iloc[k : k + 500]
                    sets, counts = shingle_sets(part["text"].tolist(), width, least, hashes)
                    keep = counts > 0
                    if not keep.any():
                        continue
                    sig = signatures(sets, counts)
                    starts = np.concatenate([[0], np.cumsum(counts[keep])[:-1]]).astype(np.int64)
                    m = mix(sets)
                    yield pd.DataFrame({
                        "id": part["id"].to_numpy()[keep], "n": counts[keep].astype(np.int32), "k1": np.add.reduceat(m, starts).astype(np.int64),
                        "k2": np.bitwise_xor.reduceat(mix(m + np.uint64(1)), starts).astype(np.int64), "sig": [r.tobytes() for r in sig],
                    })

        signed = written(self.texts.where("id IS NOT NULL AND text IS NOT NULL").mapInPandas(sign, "id bigint, n int, k1 bigint, k2 bigint, sig binary"), "signatures")
        key = signed.select("id", "n", "k1", "k2")
        rep = key.groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
        # Only sets that occur more than once; one set may be that of a third of all rows.
        self.copies = written(lookup(key, ["k1", "k2", "n"], rep).where("rep IS NOT NULL").select("id", "rep", "copies"), "copies")
        others = self.copies.where("id <> rep").select("id")
        self.signed = signed.select("id", "n", "sig").join(others, "id", "left_anti")

    def links(self) -> DataFrame:
        """``a, b, similarity`` between representatives (the smallest id of each group of copies)."""
        recall = (1 + self.recall) / 2
        depth = depth_for(self.threshold, TREES, LABEL, recall)
        got = written(_forest(self.signed, self.threshold, depth, TREES, LABEL, self.dense, False), "candidates")
        pairs = got.where("NOT dense").select("a", "b")
        crowd = got.where("dense").select(F.col("a").alias("id"))
        if not crowd.isEmpty():
            some = self.signed.join(crowd, "id", "left_semi")
            more = written(_forest(some, self.threshold, DEPTH2, trees_for(self.threshold, DEPTH2, recall), LABEL2, self.dense, True), "candidates")
            pairs = pairs.union(more.where("NOT dense").select("a", "b"))
            rest = more.where("dense").select(F.col("a").alias("id")).distinct()
            if not rest.isEmpty():
                pairs = pairs.union(_blocks(some, rest, self.threshold, 4000))
            pairs = pairs.distinct()
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        texts = _within(ids, self.texts)
        both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        return both.select("a", "b", _jaccard(self.width)("ta", "tb").alias("similarity")).where(F.col("similarity") >= self.threshold)

    def pairs(self) -> DataFrame:
        """``id_a, id_b``: every pair of texts, copies included. Its size is that of the answer; use
        ``classes`` where groups of copies are large."""
        links = written(self.links().select("a", "b"), "links")
        # Groups of copies are cut into parts of about 1,000: who meets a group meets each part of it.
        parts = F.ceil(F.col("copies") / 1000).cast("bigint")
        member = self.copies.select("rep", "id", parts.alias("parts"), F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"))
        groups = self.copies.groupBy("rep").agg(F.max(parts).alias("parts"))

        def spread(df, column, to):
            """``df`` with a row for every copy of ``column``, the representative itself among them."""
            wide = lookup(df, column, groups.withColumnRenamed("rep", column)).withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts").cast("int"), F.lit(1)) - 1)))
            got = wide.join(member.select(F.col("rep").alias(column), "part", F.col("id").alias(to)), [column, "part"], "left")
            return got.withColumn(to, F.coalesce(to, column)).drop("parts", "part")

        both = spread(spread(links, "a", "x"), "b", "y").select("x", "y")
        one = member.select("rep", "part", F.col("id").alias("x"))
        other = member.select("rep", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("part"), F.col("id").alias("y"))
        same = one.join(other, ["rep", "part"]).where("x < y").select("x", "y")
        return both.union(same).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

    def classes(self) -> DataFrame:
        """``id, class_id, n_links``: the group of every text with at least one link; ``class_id`` is
        its smallest id, ``n_links`` the texts that the text is similar to."""
        links = written(self.links().select("a", "b"), "links")
        copies = self.copies.groupBy("rep").agg(F.max("copies").alias("copies"))
        weight = lambda c: copies.select(F.col("rep").alias(c), F.col("copies").alias(f"w_{c}"))
        two = links.union(links.select("b", "a")).join(weight("b"), "b", "left")
        degree = two.groupBy(F.col("a").alias("rep")).agg(F.sum(F.coalesce("w_b", F.lit(1))).alias("d"))
        comp = components(links).select(F.col("id").alias("rep"), "component")
        reps = degree.join(comp, "rep", "full").join(copies, "rep", "full")
        reps = reps.select("rep", F.coalesce("component", "rep").alias("class_id"), (F.coalesce("d", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"))
        members = reps.join(self.copies.select("rep", "id"), "rep", "left")
        return members.select(F.coalesce("id", "rep").alias("id"), "class_id", "n_links")
