"""Retrieval: inverted index with BM25, exact vector search for a set of queries, rank fusion."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.text import contains_pattern, porter, stem, tokens
from tidemark.session import written

K1, B = 1.2, 0.75
OPERATORS = {"AND", "OR", "NOT"}


_stored: dict[tuple[str, str], tuple[DataFrame, tuple[int, float]]] = {}


class TextIndex:
    """Postings of a corpus: ``word, stem, id, tf, dl``, where dl is the length of the document.
    ``stemmed`` searches fold words to stems; both kinds share one index.

    The postings are written once, sorted by word, so a search reads the row groups of its words only;
    a stem mostly begins its words and is found in the same places. With ``name`` (that of a table that
    does not change) later indexes of the session use what was written. The statistics (documents,
    average length, frequencies of terms) are over the whole corpus, also where a query filters it.
    Null texts are documents without words.
    """

    def __init__(self, docs: DataFrame, id_col: str = "id", text_col: str = "content", stemmed: bool = True, name: str | None = None):
        self.stemmed, self.name = stemmed, name
        self.raw = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        self._kept = None

    def _index(self) -> tuple[DataFrame, tuple[int, float]]:
        """The postings, and number and average length of the documents."""
        spark = self.raw.sparkSession
        key = (spark.sparkContext.applicationId, self.name or "")
        if self._kept is None and self.name:
            self._kept = _stored.get(key)
        if self._kept is None:
            words = self.raw.select("id", tokens(F.col("text")).alias("w")).select("id", F.size("w").alias("dl"), F.explode("w").alias("word"))
            found = words.groupBy("word", "id").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
            post = written(found.select("word", stem("word").alias("stem"), "id", "tf", "dl").sortWithinPartitions("word"), "postings")
            n = self.raw.count()
            self._kept = post, (n, (post.agg(F.sum("tf")).first()[0] or 0) / max(1, n))
            if self.name:
                _stored[key] = self._kept
        return self._kept

    def _postings(self, terms: list[str], prefix: bool) -> DataFrame:
        """Postings of the wanted terms only: ``q_term, id, tf, dl``."""
        post = self._index()[0]
        term = F.col("stem" if self.stemmed else "word")
        if prefix:  # a term may begin with several of the prefixes
            hit = reduce(lambda a, b: a | b, (term.startswith(t) for t in terms))
            meant = F.explode(F.filter(F.array(*map(F.lit, terms)), lambda t: term.startswith(t)))
        else:
            hit, meant = term.isin(*terms), term
        return post.where(hit).select(meant.alias("q_term"), "id", "tf", "dl").groupBy("q_term", "id").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))

    def search(self, queries: list[tuple[int, str]], keep: DataFrame | None = None, limit: int | None = 10, prefix: bool = False) -> DataFrame:
        """``query_no, id, score, rank``: the best documents of each query; a lower score is better.

        Words are joined by AND; the upper-case words OR and NOT between words are operators, and an
        operator without its operands makes the query empty. A word with an underscore is a phrase of its
        parts and is counted as one term. With ``prefix`` every word stands for all that begin with it.
        ``keep`` (ids) filters after the statistics. Ties go to the smaller id. Without a limit all
        documents that match come out, unranked.
        """
        spark = self.raw.sparkSession
        parsed = [(no, g) for no, text in queries if (g := parse_query(text, porter if self.stemmed else str))]
        terms = lambda p: p if prefix else (" ".join(p),)
        rows = sorted({(no, k, t, sign) for no, groups in parsed for k, g in enumerate(groups) for sign, ps in ((True, g["all"]), (False, g["none"])) for p in ps for t in terms(p)})
        if not rows:
            return spark.createDataFrame([], "query_no int, id bigint, score double" + ", rank int" * (limit is not None))
        plan = spark.createDataFrame(rows, "query_no int, grp int, q_term string, wanted boolean")
        need = spark.createDataFrame([(q, g, len({t for a, b, t, w in rows if (a, b) == (q, g) and w})) for q, g in sorted({r[:2] for r in rows})], "query_no int, grp int, need bigint")
        wanted = sorted({r[2] for r in rows})
        post = self._postings(sorted({w for t in wanted for w in t.split()}), prefix)
        if phrases := [t for t in wanted if " " in t]:
            post = written(post, "hits")  # read as parts of phrases, too
            post = post.where(F.col("q_term").isin(*wanted)).unionByName(self._phrases(post, phrases))
        post = written(post, "hits")  # read for frequencies and for scores
        n_docs, mean = self._index()[1]
        df = post.groupBy("q_term").agg(F.count(F.lit(1)).alias("df"))
        # The query plan is as small as the queries, and so are the frequencies of their terms.
        hit = post.join(F.broadcast(plan), "q_term").join(F.broadcast(df), "q_term")
        idf = F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
        idf = F.when(idf > 0, idf).otherwise(1e-6)
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / mean))
        # A term is at most one row of a query, group and document.
        got = hit.groupBy("query_no", "grp", "id").agg(
            F.sum(F.when(F.col("wanted"), part)).alias("s"), F.count_if(F.col("wanted")).alias("have"), F.count_if(~F.col("wanted")).alias("bad"))
        got = got.join(F.broadcast(need), ["query_no", "grp"]).where("have = need AND bad = 0")
        got = got.groupBy("query_no", "id").agg((-F.sum("s")).alias("score"))
        if keep is not None:
            got = got.join(keep, "id", "left_semi")
        return got.select("query_no", "id", "score") if limit is None else ranked(got, ["query_no"], limit)

    def _phrases(self, post: DataFrame, phrases: list[str]) -> DataFrame:
        """Postings of phrases: how often each occurs in the documents that have all its words."""
        spark, stemmed = self.raw.sparkSession, self.stemmed
        parts = spark.createDataFrame([(p, w, len(set(p.split()))) for p in phrases for w in set(p.split())], "phrase string, q_term string, need int")
        all_ = post.join(F.broadcast(parts), "q_term").groupBy("phrase", "need", "id").agg(F.count(F.lit(1)).alias("have"), F.first("dl").alias("dl")).where("have = need")

        @F.pandas_udf("bigint")
        def times(phrase: pd.Series, w: pd.Series) -> pd.Series:
            def one(p, words):
                p, s = p.split(), [porter(x) for x in words] if stemmed else list(words)
                return sum(s[i : i + len(p)] == p for i in range(len(s)))

            return pd.Series([one(*x) for x in zip(phrase, w)], dtype="int64")

        return all_.join(self.raw, "id").select(F.col("phrase").alias("q_term"), "id", times("phrase", tokens(F.col("text"))).alias("tf"), "dl").where("tf > 0")


def ranked(found: DataFrame, by: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows of each list by score; ties go to the smaller id."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.round("score", 9), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit)


def parse_query(text: str, norm) -> list[dict] | None:
    """Alternatives of a cleaned query: each has phrases that all must occur and phrases that must
    not. None for blank queries and misplaced operators."""
    import re

    from tidemark.functions.text import ACCENTED, PLAIN

    words = re.sub(r"[^\w\s]", " ", text).split()
    table = str.maketrans(ACCENTED, PLAIN)
    groups, now, expect, negate = [], {"all": [], "none": []}, True, False
    for w in words:
        if w in OPERATORS:
            if expect:
                return None
            expect = True
            if w == "OR":
                groups.append(now)
                now = {"all": [], "none": []}
            negate = w == "NOT"
            continue
        parts = tuple(norm(p) for p in re.findall(r"[^\W_]+", w.lower().translate(table)))
        if parts:
            now["none" if negate else "all"].append(parts)
        expect = negate = False
    if expect or not now["all"]:
        return None
    return [*groups, now]


def embed(text: str, dims: int = 64, kind: str = "query") -> list[float]:
    """A hashing embedder of unit length for tests; a model can take its place."""
    v = np.zeros(dims)
    for w in f"{kind} {text}".lower().split():
        h = xxhash.xxh64_intdigest(w)
        v[h % dims] += 1 if (h >> 32) & 1 else -1
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def usable_vectors(vectors: DataFrame, dims: int = 64) -> DataFrame:
    """``id, v`` of rows with ``dims`` finite values."""
    v = F.col("embedding")
    fine = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.coalesce(fine, F.lit(False))).select("id", v.cast("array<double>").alias("v"))


def vector_search(vectors: DataFrame, queries: list[tuple[int, list[float]]], limit: int = 30) -> DataFrame:
    """``query_no, id, distance, similarity, rank`` of the nearest vectors by Euclidean distance.

    The queries are a given, small set; every Arrow batch is compared with all of them and passes on
    its own best only, so the ranking sees limit rows per query and batch.
    """
    no = np.array([q for q, _ in queries], np.int32)
    m = np.array([v for _, v in queries], np.float64)

    def near(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x, ids = np.vstack(pdf["v"]), pdf["id"].to_numpy()
            d = np.sqrt(np.maximum(0, ((x[None] - m[:, None]) ** 2).sum(2)))
            for q in range(len(m)):
                order = np.lexsort((ids, np.round(d[q], 9)))[:limit]
                yield pd.DataFrame({"query_no": np.full(len(order), no[q], np.int32), "id": ids[order], "distance": d[q][order]})

    got = usable_vectors(vectors).mapInPandas(near, "query_no int, id bigint, distance double")
    rank = F.row_number().over(W.partitionBy("query_no").orderBy(F.round("distance", 9), "id"))
    got = got.withColumn("rank", rank).where(F.col("rank") <= limit)
    return got.withColumn("similarity", 1 / (1 + F.col("distance")))


def rrf(lists: list[DataFrame], k: int = 60, limit: int = 10, by: tuple[str, ...] = ("query_no",)) -> DataFrame:
    """Reciprocal rank fusion of lists of ``by, id, rank``: ``by, id, score, rank``. Ties keep the order
    of the first list, then of the next."""
    tagged = [df.select(*by, "id", (F.lit(1.0) / (k + F.col("rank"))).alias("s"), F.struct(F.lit(i).alias("l"), F.col("rank").cast("int").alias("r")).alias("at")) for i, df in enumerate(lists)]
    got = reduce(DataFrame.unionByName, tagged).groupBy(*by, "id").agg(F.round(F.sum("s"), 6).alias("score"), F.min("at").alias("at"))
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "at", "id"))
    return got.withColumn("rank", place).where(F.col("rank") <= limit).drop("at")


def boost(found: DataFrame, counts: DataFrame, weight: float = 0.1, cap: int = 10, by: tuple[str, ...] = ("query_no",)) -> DataFrame:
    """Adds up to ``weight`` for up to ``cap`` interactions (``chunk_id, n``) and ranks anew; equal
    scores keep their order."""
    n = F.least(F.coalesce("n", F.lit(0)), F.lit(cap))
    # The results are few; only their counts are wanted.
    some = counts.withColumnRenamed("chunk_id", "id").join(F.broadcast(found.select("id").distinct()), "id", "left_semi")
    got = found.join(some, "id", "left").withColumn("score", F.round(F.col("score") + weight * n / cap, 6)).withColumnRenamed("rank", "before").drop("n")
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "before"))
    return got.withColumn("rank", place).drop("before")


def normalise(found: DataFrame, by: list[str]) -> DataFrame:
    """Scores brought to 0..1 within each list; a list of one keeps its score, a flat one gets 1."""
    w = W.partitionBy(*by)
    lo, hi, n = F.min("score").over(w), F.max("score").over(w), F.count(F.lit(1)).over(w)
    return found.withColumn("score", F.when(n <= 1, F.col("score")).when(hi == lo, F.lit(1.0)).otherwise(F.round((F.col("score") - lo) / (hi - lo), 6)))


def in_filter(chunks: DataFrame, project: str | None = None, domain: str = "all", language: str | None = None, file_pattern: str | None = None) -> DataFrame:
    """The ids of chunks that a search is limited to. ``file_pattern`` is a part of the path, in which
    ``%`` and ``_`` are wildcards; case does not matter."""
    tests = [(project, F.col("project_id") == project), (None if domain == "all" else domain, F.col("chunk_domain") == domain), (language, F.col("language") == language)]
    for given, test in tests:
        if given is not None:
            chunks = chunks.where(test)
    return (chunks if file_pattern is None else chunks.where(contains_pattern(F.col("file_path"), file_pattern))).select("id")


def clamped(limit: int, most: int = 50) -> int:
    """A limit between 1 and ``most``, as users may ask for."""
    return max(1, min(most, limit))


def hybrid(index: TextIndex, vectors: DataFrame, counts: DataFrame, queries: list[tuple[int, str]], chunks: DataFrame, keep: DataFrame | None = None, limit: int = 10, scope: DataFrame | None = None) -> DataFrame:
    """BM25 and vector ranks fused, then boosted by use: ``query_no, id, score, rank``.

    ``keep`` (ids) filters both branches after their own cut of three times the limit on the vector
    side. Blank queries give nothing; a query that finds nothing is tried again with its words as
    prefixes. With ``scope`` (``scope, id``) every query is run once in each scope: each has its own lists,
    cut and boost, and the result has the column ``scope``."""
    queries = [(n, q) for n, q in queries if q.strip()]
    by = ("query_no",) if scope is None else ("query_no", "scope")

    def cut(found):
        """The first ranks of each list by score, of the chunks that the search is limited to."""
        found = found if keep is None else found.join(keep, "id", "left_semi")
        return ranked(found if scope is None else found.join(scope, "id"), list(by), 3 * limit).select(*by, "id", "rank")

    text = cut(index.search(queries, None, None))
    vec = vector_search(vectors, [(n, embed(q)) for n, q in queries], 3 * limit).join(chunks.select("id"), "id", "left_semi")
    vec = cut(vec.withColumn("score", F.round(-F.col("similarity"), 6) + F.col("rank") * 1e-8))
    both = written(text.withColumn("branch", F.lit(0)).unionByName(vec.withColumn("branch", F.lit(1))), "ranks")
    lists = [both.where(f"branch = {b}").drop("branch") for b in (0, 1)]
    # Ranks are few: three times the limit of each query and scope.
    found = {tuple(r) for r in both.select(*by).distinct().collect()}
    scopes = [()] if scope is None else [tuple(r) for r in scope.select("scope").distinct().collect()]
    lost = [(n, *s) for n, _ in queries for s in scopes if (n, *s) not in found]
    if lost:
        again = cut(index.search([x for x in queries if x[0] in {r[0] for r in lost}], None, None, prefix=True))
        names = both.sparkSession.createDataFrame(lost, both.select(*by).schema)
        lists.append(again.join(F.broadcast(names), list(by), "left_semi"))
    return boost(rrf(lists, limit=limit, by=by), counts, by=by)


def cross(index: TextIndex, vectors: DataFrame, counts: DataFrame, queries: list[tuple[int, str]], chunks: DataFrame, projects: list[str], known: DataFrame, domain: str = "all", limit: int = 10) -> DataFrame:
    """``query_no, id, project_id, score, rank``: the hybrid searches of several projects as one list.

    Each project is searched on its own, for at least ten results, and its scores are brought to 0..1.
    A query that only one project answers keeps these; the lists of several are fused by their ranks,
    in the order of ``projects``. Projects that are not in ``known`` (id) are skipped."""
    order = chunks.sparkSession.createDataFrame(list({p: (p, i) for i, p in reversed(list(enumerate(projects)))}.values()), "scope string, no int")
    order = order.join(known.select(F.col("id").alias("scope")), "scope", "left_semi")
    scope = chunks.select("id", F.col("project_id").alias("scope"), "chunk_domain").join(F.broadcast(order.select("scope")), "scope", "left_semi")
    scope = (scope if domain == "all" else scope.where(F.col("chunk_domain") == domain)).drop("chunk_domain")
    each = normalise(hybrid(index, vectors, counts, queries, chunks, limit=max(limit, 10), scope=scope), ["query_no", "scope"]).join(F.broadcast(order), "scope")
    w = W.partitionBy("query_no")
    alone = F.min("no").over(w) == F.max("no").over(w)
    fused = each.withColumn("score", F.when(alone, F.col("score")).otherwise(F.round(1.0 / (60 + F.col("rank")), 6)))
    place = F.row_number().over(W.partitionBy("query_no").orderBy(F.desc("score"), "no", "rank"))
    return fused.withColumn("place", place).where(F.col("place") <= limit).select("query_no", "id", F.col("scope").alias("project_id"), "score", F.col("place").alias("rank"))


def log_rows(found: DataFrame, queries: list[tuple[int, str]], as_of: str, chunks: DataFrame, project: str | None = None, domain: str = "all") -> tuple[DataFrame, DataFrame]:
    """What a search adds to the logs: one search row per query, one ``search_hit`` with project and path
    per result. Blank queries are not logged."""
    spark = found.sparkSession
    q = spark.createDataFrame([(n, t) for n, t in queries if t.strip()], "query_no int, query string")
    ids = found.groupBy("query_no").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("r"))
    t = F.lit(as_of).cast("timestamp_ntz")
    listed = F.to_json(F.coalesce(F.transform("r", lambda x: x["id"]), F.array().cast("array<bigint>")))
    searches = q.join(ids, "query_no", "left").select("query", F.lit(project).cast("string").alias("project_id"), F.lit(domain).alias("domain"), listed.alias("result_chunk_ids"), F.coalesce(F.size("r"), F.lit(0)).alias("result_count"), t.alias("timestamp"))
    own = found.select("id").join(chunks.select("id", "project_id", "file_path"), "id")
    hits = own.select(F.col("id").alias("chunk_id"), "project_id", "file_path", F.lit("search_hit").alias("interaction"), F.lit("search").alias("source_tool"), t.alias("timestamp"))
    return searches, hits


def prefix_project(paths: DataFrame, projects: DataFrame) -> DataFrame:
    """``path, project_id, relative``: the project with the longest path that is the path itself or a
    folder above it. Folders of a path are exploded, so the join is on equality."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    each = paths.select("path", F.explode(above).alias("root"))
    j = each.join(projects.select(F.col("id").alias("project_id"), F.regexp_replace("path", "/+$", "").alias("root")), "root")
    best = j.groupBy("path").agg(F.max(F.struct(F.length("root").alias("n"), F.col("project_id"), F.col("root"))).alias("b"))
    return best.select("path", "b.project_id", F.ltrim(F.expr("substring(path, b.n + 1)"), F.lit("/")).alias("relative"))


def file_lines(chunks: DataFrame, numbered: bool = True) -> DataFrame:
    """Content as lines: ``id, line_no, line``; numbered lines are right-aligned to six places."""
    got = chunks.select("id", F.posexplode(F.split("content", "\n", -1)).alias("n", "line"))
    no = (F.col("n") + 1).cast("string")
    text = F.concat(F.lpad(no, F.greatest(F.length(no), F.lit(6)), F.lit(" ")), F.lit("\t"), F.col("line")) if numbered else F.col("line")
    return got.select("id", (F.col("n") + 1).alias("line_no"), text.alias("line"))
