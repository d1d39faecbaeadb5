"""Evaluation passages in training texts.

Texts are reduced to their letters and digits (compatibility forms and accents folded, lower case).
Stretches that have too few short sequences of any item to come near a run are left out first, which
loses nothing. Windows start at minimiser positions: the least hash of every ``gap`` neighbouring
character sequences, so that two texts which share a long enough stretch also share a window in it.
Every window is embedded by a random walk that maps edit distance to Hamming distance: at each step
the current character is written out, and a random bit of (step, character) decides whether to
advance. Keys made of sampled positions of the embedding are matched with those of the items, in as
many tables as the target recall needs; then the edits of every candidate are counted exactly.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

NOT_ALNUM = re.compile(r"[\W_]+")
#: Items up to this many characters in all, four times as many over all tables, are sent to every task;
#: more go through a shuffled join.
BROADCAST_CHARS = 8_000_000
#: Items whose runs are so short that the walk needs more tables are compared without it.
MAX_TABLES = 300
#: Letters of stretches that are held before they are matched.
HELD = 1_000_000
K = 6
#: Steps of the walk after which two embeddings have met again after an edit, on average (measured).
WALK = 14


def squeeze(text: str) -> str:
    """Letters and digits only, in lower case, without accents and compatibility forms."""
    if text.isascii():
        return NOT_ALNUM.sub("", text.lower())
    return NOT_ALNUM.sub("", unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold()))


def item_windows(text: str, words: int) -> list[str]:
    """The squeezed runs of ``words`` consecutive words; words are separated by white space and have
    a letter or digit."""
    w = [s for s in map(squeeze, text.split()) if s]
    return ["".join(w[i : i + words]) for i in range(len(w) - words + 1)]


class Embedder:
    """Window positions and keys. ``shortest`` is the length of the shortest run to be found."""

    def __init__(self, shortest: int, max_edits: int = 0, recall: float = 0.99, seed: int = 11):
        """Without edits a run is found by one window, so one table has all. With edits every table draws
        its own minimisers, embedding and sample, so that tables fail independently of each other: a
        table finds a run if no edit falls into the sequences that decide on its first window, and no
        sampled position of the embedding differs. Windows are as long as the shortest run allows."""
        self.gap, self.width, self.k, self.steps, self.samples, self.tables = self.plan(shortest, max_edits, recall)
        rng = np.random.default_rng(seed)
        walks = 1 if max_edits == 0 else self.tables
        self.bits = rng.integers(0, 2, (walks, self.steps, 256), dtype=np.uint8)
        self.salt = rng.integers(0, 2**32, self.tables, dtype=np.uint32) * np.uint32(max_edits > 0)
        self.at = [np.sort(rng.choice(self.steps, self.samples, replace=False)) for _ in range(self.tables)]
        self.mult = rng.integers(1, 2**62, (self.tables, self.samples), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    @staticmethod
    def plan(shortest: int, max_edits: int, recall: float) -> tuple[int, int, int, int, int, int]:
        """Gap, width, sequence length, steps, samples and tables."""
        gap = max(1, shortest // 2) if max_edits == 0 else max(1, min(8, shortest // 4))
        width = max(1, shortest - gap + 1)
        k, steps = min(K, width), 3 * width
        # Positions that differ after e edits, as a share: e random walks of some steps each.
        differs = min(0.5, WALK * max_edits / steps)
        samples = min(24, steps) if max_edits == 0 else min(steps, max(4, min(24, math.ceil(math.log(0.3) / math.log(1 - differs)))))
        calm = max(0.02, 1 - (2 * gap + k) / shortest) ** max_edits
        p = calm * (1 - differs) ** samples
        return gap, width, k, steps, samples, 1 if max_edits == 0 else max(1, math.ceil(math.log(1 - recall) / math.log1p(-p)))

    def anchors(self, codes: np.ndarray, lengths: np.ndarray, table: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Window starts in the concatenation of texts of the given lengths, and the hashes there."""
        n = len(codes) - self.k + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint32)
        h = np.full(n, self.salt[table], np.uint32)
        for j in range(self.k):
            h = (h ^ codes[j : j + n]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        # No window may take in the end of a text; such starts get the greatest value.
        ends = np.cumsum(lengths)
        left = np.repeat(ends, lengths)[:n] - np.arange(n)
        h[left < self.k] = np.uint32(0xFFFFFFFF)
        low, high = _slide(h, self.gap, np.minimum), None
        high = _slide(np.concatenate([np.zeros(self.gap - 1, np.uint32), low, np.zeros(n - len(low), np.uint32)]), self.gap, np.maximum)[:n]
        starts = np.flatnonzero((h == high) & (left >= min(self.k, self.width)))
        return starts, h[starts]

    def keyed(self, streams: list[str]):
        """Per table the number of the text and the key of every window."""
        codes, lengths = _codes(streams)
        ends = np.cumsum(lengths)
        for t in range(self.tables):
            starts, first = self.anchors(codes, lengths, t)
            yield np.searchsorted(ends, starts, "right"), self.keys(codes, ends, starts, first, t) + np.uint64(t)

    def keys(self, codes: np.ndarray, ends: np.ndarray, starts: np.ndarray, first: np.ndarray, table: int = 0) -> np.ndarray:
        """The key of every window in one table, which begins with the hash that chose the window;
        windows that a text's end cuts are padded."""
        if not len(starts):
            return np.empty(0, np.uint64)
        stop = np.minimum(starts + self.width, ends[np.searchsorted(ends, starts, "right")])
        padded = np.concatenate([codes, np.zeros(1, codes.dtype)])
        pos, key = starts.copy(), first.astype(np.uint64)
        bits = self.bits[table % len(self.bits)]
        wanted = {int(j): s for s, j in enumerate(self.at[table])}
        for j in range(max(wanted) + 1):
            ch = padded[pos]
            ch[pos >= stop] = 0
            if j in wanted:
                x = (key ^ ch) * self.mult[table, wanted[j]]
                key = x ^ (x >> np.uint64(29))
            pos += bits[j][(ch * np.uint32(0x85EBCA6B)) >> np.uint32(24)]
            np.minimum(pos, stop, out=pos)
        return key


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours, by doubling."""
    if len(x) <= width:
        return np.full(1, op.reduce(x)) if len(x) else x
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = op(out[: len(out) - step], out[step:])
        have += step
    return out


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), lengths


class Sieve:
    """Stretches of text in which a run can be. An edit spoils at most ``q`` of a run's sequences of ``q``
    letters, so a part within ``max_edits`` of a run of ``shortest`` letters has ``need`` of them at
    least. What has fewer of all items' sequences, and then of those of one of 64 groups of items, is no
    part of a match; longer runs are covered by the stretches of their parts. Hashes that meet by chance
    only let more through."""

    def __init__(self, shortest: int, max_edits: int, letters: int):
        self.q = max(1, min(10, shortest // (2 * max_edits + 1)))
        self.need = max(0, shortest - self.q + 1 - self.q * max_edits)
        self.span = shortest + max_edits
        self.slots, self.few = (1 << min(most, max(16, (n * letters).bit_length())) for n, most in ((16, 27), (4, 22)))

    def grams(self, codes: np.ndarray) -> np.ndarray:
        """The hash of every sequence of ``q`` letters, by doubling."""
        n = len(codes) - self.q + 1
        if n <= 0:
            return np.empty(0, np.uint32)
        h, have = codes * np.uint32(0x9E3779B1), 1
        while have < self.q:
            step = min(have, self.q - have)
            h = (h[: len(h) - step] * np.uint32(0x85EBCA6B)) ^ h[step:]
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)
            have += step
        return h ^ (h >> np.uint32(16))

    def marks(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """A bit for every slot that one of the texts has, and for fewer slots the groups that have it."""
        seen, groups = np.zeros(self.slots, bool), np.zeros(self.few, np.uint64)
        for t in texts:
            h = self.grams(_codes([t])[0])
            seen[h & np.uint32(self.slots - 1)] = True
            groups[h & np.uint32(self.few - 1)] |= np.uint64(1 << group_of(t))
        return np.packbits(seen, bitorder="little"), groups

    def stretches(self, streams: list[str], marks: tuple[np.ndarray, np.ndarray]) -> list[list[tuple[str, int]]]:
        """Of every text the parts that can hold a match, each with a bit for every group it can be of."""
        if self.need == 0:
            return [[(s, 2**64 - 1)] if s else [] for s in streams]
        seen, groups = marks
        width = self.span - self.q + 1
        # Sequences from one text into the next count too: that only lets more through.
        slot = self.grams(_codes(streams)[0]) & np.uint32(self.slots - 1)
        hit = (seen[slot >> np.uint32(3)] >> (slot & np.uint32(7)).astype(np.uint8)) & np.uint8(1)
        good = np.flatnonzero(_sums(hit, width) >= self.need)
        first = self._cut(streams, good, np.zeros(len(good), np.uint64))
        flat = [p for parts in first for p, _ in parts]
        h, good, of = self.grams(_codes(flat)[0]) & np.uint32(self.few - 1), [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for lo in range(0, len(h), 50_000):
            bits = np.unpackbits(groups[h[lo : lo + 50_000 + width]].view(np.uint8).reshape(-1, 8), axis=1)
            can = np.packbits(_sums(bits, width)[:50_000] >= self.need, axis=1).view(np.uint64)[:, 0]
            good.append(lo + np.flatnonzero(can))
            of.append(can[can > 0])
        second = iter(self._cut(flat, np.concatenate(good), np.concatenate(of)))
        return [[p for _ in parts for p in next(second)] for parts in first]

    def _cut(self, streams: list[str], good: np.ndarray, of: np.ndarray) -> list[list[tuple[str, int]]]:
        """The parts of every text that spans from the positions ``good`` of the concatenation cover, with
        the bits that one of their positions has."""
        out = [[] for _ in streams]
        if not len(good):
            return out
        new = np.concatenate([[0], np.flatnonzero(np.diff(good) > self.span) + 1])
        first, stop = good[new], good[np.append(new[1:], len(good)) - 1] + self.span
        lengths = np.fromiter(map(len, streams), np.int64, len(streams))
        ends = np.cumsum(lengths)
        for a, b, text, bits in zip(first.tolist(), stop.tolist(), np.searchsorted(ends, first, "right").tolist(), np.bitwise_or.reduceat(of, new).tolist()):
            while text < len(streams) and ends[text] - lengths[text] < b:
                base = int(ends[text] - lengths[text])
                if part := streams[text][max(0, a - base) : b - base]:
                    out[text].append((part, bits))
                text += 1
        return out


def group_of(item: str) -> int:
    return zlib.crc32(item.encode("utf-8", "surrogatepass")) % 64


def _sums(x: np.ndarray, width: int) -> np.ndarray:
    """Sums of every ``width`` neighbouring rows of bits, by doubling; fewer rows at the end."""
    n = len(x)
    part = np.concatenate([x, np.zeros((width - 1, *x.shape[1:]), x.dtype)]).astype(np.uint8 if width < 256 else np.int32, copy=False)
    out, at, have = np.zeros_like(part[:n]), 0, 1
    while have <= width:
        if width & have:
            out += part[at : at + n]
            at += have
        if 2 * have <= width:
            part = part[: len(part) - have] + part[have:]
        have *= 2
    return out


def edits_within(run: str, text: str, most: int) -> int | None:
    """The fewest edits, up to ``most``, between ``run`` and a part of ``text``."""
    if run in text:
        return 0
    if most == 0:
        return None
    if len(run) <= most:  # too short for the pieces below
        return _fewest(run, text)
    # Of most + 1 pieces of the run one is untouched, so only what lies around its places is compared.
    cuts = [len(run) * i // (most + 1) for i in range(most + 2)]
    around = []
    for a, b in zip(cuts, cuts[1:]):
        at = text.find(run[a:b])
        while at >= 0:
            around.append((max(0, at - a - most), at - a + len(run) + most))
            at = text.find(run[a:b], at + 1)
    best, around = most + 1, sorted(around)
    while around:
        lo, hi = around[0]
        n = 1
        while n < len(around) and around[n][0] <= hi:
            hi = max(hi, around[n][1])
            n += 1
        around = around[n:]
        best = min(best, _fewest(run, text[lo:hi]))
    return best if best <= most else None


def _fewest(run: str, text: str) -> int:
    """The fewest edits between ``run`` and a part of ``text``, a column of the table in two integers."""
    where: dict[str, int] = {}
    for i, c in enumerate(run):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(run)) - 1, 1 << len(run) - 1
    up, down, score = full, 0, len(run)
    best = score
    for c in text:
        eq = where.get(c, 0)
        xv, xh = eq | down, (((eq & up) + up) ^ up) | eq
        ph, mh = down | (full & ~(xh | up)), up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            best = min(best, score)
        ph, mh = ph << 1 & full, mh << 1 & full
        up, down = mh | (full & ~(xv | ph)), ph & xv
    return best


def fewest_edits(runs: list[str], text: str, most: int) -> int | None:
    """The fewest edits, up to ``most``, between one of ``runs`` and a part of ``text``."""
    if any(r in text for r in runs):
        return 0
    best = most + 1
    for r in runs:
        if best > 1 and (e := edits_within(r, text, best - 1)) is not None:
            best = e
    return best if best <= most else None


def find_leaks(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, item_text_col: str, words: int = 12, max_edits: int = 0, recall: float = 0.99) -> DataFrame:
    """``doc_id, item_id``: documents that contain ``words`` consecutive words of an item, up to
    ``max_edits`` edits of its letters and digits; see ``count_edits``."""
    return count_edits(docs, id_col, text_col, items, item_col, item_text_col, words, max_edits, recall).select("doc_id", "item_id")


def count_edits(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, item_text_col: str, words: int = 12, max_edits: int = 0, recall: float = 0.99) -> DataFrame:
    """``doc_id, item_id, edits``: documents that contain ``words`` consecutive words of an item, and with
    how few edits of its letters and digits, if at most ``max_edits``.

    Null, empty and short texts on either side match nothing, as do items with fewer words. Rows
    with a null id are left out; repeated ids of documents give a row each. Documents are read whole,
    however long. Items are searched by classes of the length of their shortest run, which sets that of
    the windows, so that a few items of short words do not weaken the search for all. Where a class is
    too short for the walk at so many edits, its items are compared with every stretch that the sieve
    leaves. Equal runs always share a key, so those are never missed.
    """
    spark = docs.sparkSession
    own = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("item_text")).where("item_id IS NOT NULL AND item_text IS NOT NULL")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    doc_type, item_type = (f.schema[0].dataType.simpleString() for f in (texts, own))

    @F.pandas_udf("int")
    def shortest(t: pd.Series) -> pd.Series:
        return t.map(lambda x: min(map(len, item_windows(x, words)), default=None)).astype("Int32")

    own = own.withColumn("m", shortest("item_text")).where("m IS NOT NULL")
    sizes = {r.m: r.n for r in own.groupBy("m").agg(F.sum(F.length("item_text")).alias("n")).collect()}  # a row per length
    classes: list[list[int]] = []
    for m in sorted(sizes):
        if not classes or m >= 2 * classes[-1][0]:
            classes.append([])
        classes[-1].append(m)
    found = spark.createDataFrame([], f"doc_id {doc_type}, item_id {item_type}, edits int")
    for n, some in enumerate(classes):
        emb = Embedder(some[0], max_edits, recall) if Embedder.plan(some[0], max_edits, recall)[-1] <= MAX_TABLES else None
        got = _leaks_of(texts, own.where(F.col("m").between(some[0], some[-1])).drop("m"), some[0], sum(sizes[m] for m in some), emb, words, max_edits, found.schema)
        found = found.unionByName(got) if n else got
    return found


def _leaks_of(texts: DataFrame, own: DataFrame, least: int, size: int, emb: Embedder | None, words: int, max_edits: int, schema) -> DataFrame:
    """``count_edits`` for items whose runs have at least ``least`` letters; all items are compared with
    all stretches if there is no walk."""
    spark = texts.sparkSession
    sieve = Sieve(least, max_edits, size)

    if size <= BROADCAST_CHARS and size * (emb.tables if emb else 1) <= 4 * BROADCAST_CHARS:
        rows = [(i, squeeze(t), item_windows(t, words)) for i, t in own.collect()]  # at most BROADCAST_CHARS characters
        tables = []
        for number, key in emb.keyed([s for _, s, _ in rows]) if emb else ():
            order = np.argsort(key, kind="stable")
            tables.append((key[order], number[order].astype(np.int32)))
        shared = spark.sparkContext.broadcast(([(i, w) for i, _, w in rows], np.array([group_of(s) for _, s, _ in rows], np.uint64), tables, sieve.marks(s for _, s, _ in rows)))

        def matched(held):
            rows, group, tables, _ = shared.value
            owner, parts, bits = zip(*((d, p, b) for d, (_, parts) in enumerate(held) for p, b in parts))
            bits = np.array(bits, np.uint64)
            if emb:
                pairs = []
                for (number, key), (known, item_of) in zip(emb.keyed(parts), tables):
                    a, b = np.searchsorted(known, key, "left"), np.searchsorted(known, key, "right")
                    many = b - a
                    at = np.arange(many.sum()) + np.repeat(a - np.cumsum(many) + many, many)
                    part, item = np.repeat(number, many), item_of[at]
                    pairs.append(np.unique((part * len(rows) + item)[bits[part] >> group[item] & np.uint64(1) > 0]))
                pairs = np.unique(np.concatenate(pairs))
            else:
                pairs = np.flatnonzero(bits[:, None] >> group & np.uint64(1))
            fewest = {}
            for p, j in zip((pairs // len(rows)).tolist(), (pairs % len(rows)).tolist()):
                least = fewest.get((owner[p], j), max_edits + 1)
                if least and (e := fewest_edits(rows[j][1], parts[p], least - 1)) is not None:
                    fewest[owner[p], j] = e
            if fewest:
                yield pd.DataFrame([(held[d][0], rows[j][0], e) for (d, j), e in fewest.items()], columns=["doc_id", "item_id", "edits"])

        def scan(batches):
            held, letters = [], 0
            for pdf in batches:
                for lo in range(0, len(pdf), 1000):
                    part = pdf.iloc[lo : lo + 1000]
                    streams = [squeeze(t) for t in part["text"]]
                    for i, parts in zip(part["doc_id"].tolist(), sieve.stretches(streams, shared.value[3])):
                        if parts:
                            held.append((i, parts))
                            letters += sum(len(p) for p, _ in parts)
                    if letters > HELD:
                        yield from matched(held)
                        held, letters = [], 0
            if held:
                yield from matched(held)

        return texts.mapInPandas(scan, schema)

    def mark(batches):
        seen, groups = sieve.marks(())
        for pdf in batches:
            more = sieve.marks(map(squeeze, pdf["item_text"]))
            seen, groups = seen | more[0], groups | more[1]
        yield pd.DataFrame({"seen": [seen.tobytes()], "groups": [groups.tobytes()]})

    marks = sieve.marks(())
    for r in own.mapInPandas(mark, "seen binary, groups binary").toLocalIterator():
        marks = marks[0] | np.frombuffer(r.seen, np.uint8), marks[1] | np.frombuffer(r.groups, np.uint64)
    shared = spark.sparkContext.broadcast(marks)

    def kept(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 1000):
                part = pdf.iloc[lo : lo + 1000]
                streams = [squeeze(t) for t in part["text"]]
                yield part["doc_id"].to_numpy(), sieve.stretches(streams, shared.value)

    def doc_keys(batches):
        for ids, parts in kept(batches):
            owner = np.repeat(np.arange(len(ids)), [len(p) for p in parts])
            if len(owner):
                for number, key in emb.keyed([x for p in parts for x, _ in p]):
                    yield pd.DataFrame({"doc_id": ids[owner[number]], "key": key.astype(np.int64)}).drop_duplicates()

    def item_keys(batches):
        for pdf in batches:
            for number, key in emb.keyed([squeeze(t) for t in pdf["item_text"]]):
                yield pd.DataFrame({"item_id": pdf["item_id"].to_numpy()[number], "key": key.astype(np.int64)}).drop_duplicates()

    def doc_ids(batches):
        for ids, parts in kept(batches):
            yield pd.DataFrame({"doc_id": ids[[len(p) > 0 for p in parts]]}).drop_duplicates()

    doc_type, item_type = (schema[i].dataType.simpleString() for i in (0, 1))
    if emb:
        pairs = texts.mapInPandas(doc_keys, f"doc_id {doc_type}, key bigint").join(own.mapInPandas(item_keys, f"item_id {item_type}, key bigint"), "key").select("doc_id", "item_id").distinct()
    else:
        pairs = texts.mapInPandas(doc_ids, f"doc_id {doc_type}").distinct().crossJoin(own.select("item_id").distinct())

    @F.pandas_udf("int")
    def count(t: pd.Series, i: pd.Series) -> pd.Series:
        return pd.Series([fewest_edits(item_windows(y, words), squeeze(x), max_edits) for x, y in zip(t, i)], dtype="Int32")

    return pairs.join(own, "item_id").join(texts, "doc_id").select("doc_id", "item_id", count("text", "item_text").alias("edits")).where("edits IS NOT NULL")
