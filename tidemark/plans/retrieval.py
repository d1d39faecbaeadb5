"""Queries over search, vectors, the graph, chunking, pages and streams."""

from __future__ import annotations

import re

from pyspark.sql import Window as W, functions as F

from tidemark.functions import text as tx
from tidemark.operators import chunking, graph, search, trace
from tidemark.operators.search import TextIndex
from tidemark.plans import edge_sql
from tidemark.plans.activity import AS_OF
from tidemark.sources import files, html
from tidemark.sources.tables import table
from tidemark.streaming import activity as streams

#: A batch of searches, as users type them.
SEARCHES = [
    (1, "incremental baseline"), (2, "merge lockfile ledger"), (3, "schema OR gateway"), (4, "tokenizer harness threshold?"), (5, "prune_journal"),
    (6, "vector snapshot"), (7, "sparse matrix"), (8, "registry fence quota"), (9, "NOT broken"), (10, "   "), (11, "canary NOT payload"), (12, "umbral contador"),
]
PLAIN = [(n, q) for n, q in SEARCHES if n in (1, 2, 4, 6, 8, 12)]
#: Projects of a cross search, and the chunks that a search is limited to.
CROSSED = ["lantern-core", "tiny-postings", "no-such-project", "detached-adapter", "lantern-core"]
SCOPE = "project_id IN ('lantern-core', 'tiny-postings', 'detached-adapter') AND chunk_domain = 'content'"


def _index(spark, d, stemmed=False):
    return TextIndex(table(spark, d, "chunks"), stemmed=stemmed, name=f"{d}/chunks")


def bm25_search(spark, d):
    """The best chunks of each query without stemming."""
    return _index(spark, d).search(PLAIN).withColumn("score", F.round("score", 6))


def bm25_filtered(spark, d):
    """The best chunks of a project and domain; the statistics stay those of the whole corpus."""
    keep = table(spark, d, "chunks").where(SCOPE).select("id")
    return _index(spark, d).search(PLAIN, keep).withColumn("score", F.round("score", 6))


def bm25_stemmed(spark, d):
    """All query forms with stemming: operators, phrases, malformed and blank queries."""
    return _index(spark, d, True).search(SEARCHES).withColumn("score", F.round("score", 6))


def prefix_search(spark, d):
    """Queries whose words are prefixes."""
    return _index(spark, d).search([(1, "tokeniz"), (2, "lock regis")], prefix=True).withColumn("score", F.round("score", 6))


def _query_vectors():
    return [(n, search.embed(q)) for n, q in PLAIN]


def knn_search(spark, d):
    """The nearest vectors of each query, filtered after the cut."""
    got = search.vector_search(table(spark, d, "chunks_vec"), _query_vectors(), 30)
    kept = got.join(table(spark, d, "chunks").where("chunk_domain = 'content'").select("id"), "id", "left_semi")
    return kept.select("query_no", "id", F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity"), "rank")


def _two_lists(spark, d):
    return search.vector_search(table(spark, d, "chunks_vec"), _query_vectors(), 30).select("query_no", "id", "rank"), _index(spark, d).search(PLAIN, limit=30).select("query_no", "id", "rank")


def rrf_merge(spark, d):
    """Keyword and vector ranks fused."""
    v, t = _two_lists(spark, d)
    return search.rrf([t, v])


def rrf_multi(spark, d):
    """Three lists fused."""
    v, t = _two_lists(spark, d)
    return search.rrf([t, v, v.where("rank <= 5")], limit=15)


def normalised_scores(spark, d):
    """Scores of each query between 0 and 1."""
    got = _index(spark, d).search(PLAIN).select("query_no", "id", (-F.col("score")).alias("score"))
    return search.normalise(got, ["query_no"]).withColumn("score", F.round("score", 5))


def _counts(spark, d):
    return trace.interaction_counts(table(spark, d, "chunk_interactions"), AS_OF)


def interaction_boost(spark, d):
    """Fused results raised by recent reads and edits."""
    return search.boost(rrf_merge(spark, d), _counts(spark, d))


def hybrid_search(spark, d):
    """Search as users get it: both branches, stemming, fusion, boost."""
    return search.hybrid(_index(spark, d, True), table(spark, d, "chunks_vec"), _counts(spark, d), SEARCHES, table(spark, d, "chunks"))


def search_results(spark, d):
    """Results with their chunk and snippet."""
    c = table(spark, d, "chunks").select("id", "project_id", "file_path", "name", tx.snippet(F.col("content")).alias("snippet"))
    return interaction_boost(spark, d).join(c, "id")


def hybrid_filtered(spark, d):
    """Both branches limited to a language and to paths of a pattern, with a limit that is clamped."""
    c = table(spark, d, "chunks")
    keep = search.in_filter(c, language="markdown", file_pattern="docs/%_", domain="content")
    return search.hybrid(_index(spark, d), table(spark, d, "chunks_vec"), _counts(spark, d), PLAIN, c, keep, search.clamped(0) * 5)


def search_rows(spark, d):
    """What searches add to the log."""
    return search.log_rows(rrf_merge(spark, d), PLAIN, AS_OF, table(spark, d, "chunks"))[0]


def search_hits(spark, d):
    """What searches add to the interactions."""
    return search.log_rows(rrf_merge(spark, d), PLAIN, AS_OF, table(spark, d, "chunks"))[1]


def cross_search(spark, d):
    """The hybrid searches of several projects, normalised and fused; unknown projects are skipped."""
    return search.cross(_index(spark, d), table(spark, d, "chunks_vec"), _counts(spark, d), PLAIN, table(spark, d, "chunks"), CROSSED, table(spark, d, "projects"))


def sanitized_queries(spark, d):
    """Distinct searches without punctuation."""
    return table(spark, d, "search_log").select("query", tx.sanitize_query(F.col("query")).alias("clean")).distinct()


def snippets(spark, d):
    """The first ten lines of every chunk."""
    return table(spark, d, "chunks").select("id", tx.snippet(F.col("content")).alias("snippet"))


def path_filter(spark, d):
    """Chunks by a pattern of their path, with wildcards."""
    return table(spark, d, "chunks").where(tx.contains_pattern(F.col("file_path"), "DOCS/%_index%")).select("id", "file_path")


def longest_prefix(spark, d):
    """The project of each absolute path."""
    p = table(spark, d, "projects")
    paths = table(spark, d, "file_index").select(F.concat(F.lit("/srv/"), "project_id", F.lit("/"), "file_path").alias("path")).distinct()
    return search.prefix_project(paths, p)


def read_lines(spark, d):
    """Chunks as numbered lines."""
    return search.file_lines(table(spark, d, "chunks"))


def languages(spark, d):
    """The language of every file by its path."""
    return table(spark, d, "file_index").select("file_path", files.language(F.col("file_path")).alias("language")).distinct()


def wanted_files(spark, d):
    """Files that a scan keeps, with patterns that ignore and negate."""
    f = table(spark, d, "file_index").select("project_id", "file_path").distinct()
    return f.where(files.wanted(F.col("file_path"), F.lit(1000), ["vendor", "*.txt", "!docs/*.txt", "archive/**/*.md"]))


def link_edges(spark, d):
    """Edges from links; each chunk also links to the file of the chunk before it."""
    return graph.link_edges(_linked(spark, d))


def _linked(spark, d):
    """Chunks with a made link to a file of the same folder, since the texts' own links leave the tables."""
    c = table(spark, d, "chunks").select("id", "project_id", "file_path", "chunk_domain", "content", "metadata")
    name = F.regexp_extract("file_path", r"([^/]*)$", 1)
    module = F.regexp_replace(F.regexp_replace("file_path", r".*/", ""), r"\.[^.]*$", "")
    line = F.concat(F.lit("\n[self]("), name, F.lit(")\n[web](https://docs.example/x)\n"))
    imports = F.concat(F.lit("from "), module, F.lit(" import x\nimport { y } from './"), module, F.lit("'\n"))
    return c.withColumn("content", F.when(F.col("id") % 3 == 0, F.concat(F.when(F.col("chunk_domain") == "code", imports).otherwise(line), "content")).otherwise(F.col("content")))


def import_edges(spark, d):
    """Edges from imports of code chunks."""
    return graph.import_edges(_linked(spark, d))


def tag_edges(spark, d):
    """Edges between chunks of a file with two tags in common."""
    return graph.tag_edges(table(spark, d, "chunks"))


def category_edges(spark, d):
    """Edges between chunks of a file with a category in common."""
    return graph.category_edges(table(spark, d, "chunks"))


def semantic_edges(spark, d):
    """Nearest vectors of every hundredth chunk, as edges."""
    v = table(spark, d, "chunks_vec")
    return graph.semantic_edges(v, v.where("id % 100 = 0"))


def rebuilt_edge_counts(spark, d):
    """Edges rebuilt from the present chunks, by type; semantic ones from every hundredth chunk to all."""
    v = table(spark, d, "chunks_vec")
    _, new = graph.rebuilt_edges(table(spark, d, "edges"), _linked(spark, d), v, v.where("id % 100 = 0"))
    return new.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


def rebuilt_project(spark, d):
    """All edges after one project's tag and category edges are built anew."""
    v = table(spark, d, "chunks_vec")
    return graph.rebuilt_edges(table(spark, d, "edges"), table(spark, d, "chunks"), v, v, ("tag", "category"), "lantern-core")[0]


def project_edges(spark, d):
    """Edges that start in a project."""
    return graph.project_edges(table(spark, d, "edges"), table(spark, d, "chunks"), "lantern-core").select("source_id", "target_id", "edge_type", "weight")


def bfs_neighbours(spark, d):
    """Chunks within two steps of every hundredth chunk."""
    c = table(spark, d, "chunks")
    return graph.neighbours(table(spark, d, "edges"), c, c.where("id % 100 = 0").select(F.col("id").alias("start")), 2)


def _nodes(spark, d):
    return table(spark, d, "chunks").select("id")


def pagerank(spark, d):
    """Ranks of all chunks and edge ends."""
    return graph.pagerank(table(spark, d, "edges"), _nodes(spark, d))


def communities(spark, d):
    """Groups of the graph."""
    return graph.communities(table(spark, d, "edges"), _nodes(spark, d))


def community_members(spark, d):
    """Size and first members of each group, the ids as text."""
    g = communities(spark, d).select("community", F.col("id").cast("string").alias("id"))
    # A group may hold a third of all chunks: the first ten of each part, then of all parts.
    first = lambda *by: F.row_number().over(W.partitionBy("community", *by).orderBy("id"))
    few = g.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("no", first("part")).where("no <= 10").withColumn("no", first()).where("no <= 10")
    sizes = g.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(few.groupBy("community").agg(F.array_sort(F.collect_list("id")).alias("first_members")), "community")


def graph_metadata(spark, d):
    """Chunks with group and rank in their metadata."""
    return graph.with_graph_metadata(table(spark, d, "chunks"), pagerank(spark, d), communities(spark, d))


def rank_metadata(spark, d):
    """Chunks with their rank in their metadata."""
    return graph.with_graph_metadata(table(spark, d, "chunks"), pagerank(spark, d))


def line_chunks(spark, d):
    """Documents as windows of lines."""
    return chunking.line_windows(table(spark, d, "documents"), "doc_id", "text", 10, 2)


def heading_chunks(spark, d):
    """Content chunks cut at their headings."""
    return chunking.heading_chunks(table(spark, d, "chunks").where("chunk_domain = 'content'"), "id", "content")


def code_chunks(spark, d):
    """Code chunks cut at their definitions."""
    return chunking.code_chunks(table(spark, d, "chunks").where("chunk_domain = 'code'"), "id", "content", "language")


def html_text(spark, d):
    """Content chunks read as web pages."""
    return table(spark, d, "chunks").where("chunk_domain = 'content'").select("id", html.html_text("content").alias("text"))


def fetched_pages(spark, d):
    """Pages fetched from the addresses in texts: project, path and text."""
    url = F.explode(F.regexp_extract_all("content", F.lit(r"https?://[^\s)\]|\"'<>]+"), F.lit(0)))
    u = table(spark, d, "chunks").select(url.alias("url")).distinct()
    return u.select("url", html.url_project(F.col("url")).alias("project_id"), html.url_path(F.col("url")).alias("file_path"))


def stream_daily(spark, d):
    """Daily interactions per project from a stream."""
    return streams.run_once(streams.windowed_counts(streams.read_log(spark, d, "chunk_interactions")), "complete", "daily")


def stream_hot(spark, d):
    """Running totals per file from a stream."""
    return streams.run_once(streams.hot_files(streams.read_log(spark, d, "chunk_interactions")), "complete", "hot")


def stream_append(spark, d):
    """The search log appended from a stream."""
    return streams.run_once(streams.read_log(spark, d, "search_log").select("id", "query", "result_count"), "append", "searches")


def stream_state(spark, d):
    """First and last interaction per project and kind, kept as custom state; newest state per key."""
    return streams.run_once(streams.first_and_last(streams.read_log(spark, d, "chunk_interactions", 1_000)), "update", "state", ["project_id", "interaction"])


QUERIES = {f.__name__: f for f in (
    bm25_search, bm25_filtered, bm25_stemmed, prefix_search, knn_search, rrf_merge, rrf_multi, normalised_scores, interaction_boost, hybrid_search, hybrid_filtered, search_results, search_rows, search_hits, cross_search,
    sanitized_queries, snippets, path_filter, longest_prefix, read_lines, languages, wanted_files, link_edges, import_edges, tag_edges, category_edges, semantic_edges, rebuilt_edge_counts, rebuilt_project, project_edges,
    bfs_neighbours, pagerank, communities, community_members, graph_metadata, rank_metadata, line_chunks, heading_chunks, code_chunks, html_text, fetched_pages, stream_daily, stream_hot, stream_append, stream_state)}


def _terms(queries) -> str:
    rows = [f"({n}, '{t}')" for n, q in queries for t in dict.fromkeys(p for g in search.parse_query(q, str) for ph in g["all"] for p in ph)]
    return "(VALUES " + ", ".join(rows) + ")"


def _bm25(queries, limit=10, keep="TRUE", match="p.w = q.t") -> str:
    return f"""
WITH d AS (SELECT id, list_filter(string_split_regex(strip_accents(lower(content)), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') w FROM chunks),
len AS (SELECT id, coalesce(len(w), 0) dl FROM d), st AS (SELECT count(*) n, avg(dl) mean FROM len),
p AS (SELECT w, id, count(*) tf FROM (SELECT id, unnest(w) w FROM d) GROUP BY ALL),
q AS (SELECT * FROM {_terms(queries)} v(query_no, t)),
hp AS (SELECT q.t, p.id, sum(p.tf) tf FROM p JOIN (SELECT DISTINCT t FROM q) q ON {match} GROUP BY ALL),
df AS (SELECT t, count(*) df FROM hp GROUP BY 1),
sc AS (SELECT query_no, hp.id, count(*) have, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) s
  FROM hp JOIN q USING (t) JOIN df USING (t) JOIN len USING (id), st GROUP BY ALL),
full_ AS (SELECT query_no, sc.id, -s score FROM sc JOIN chunks c ON c.id = sc.id WHERE have = (SELECT count(*) FROM q z WHERE z.query_no = sc.query_no) AND {keep}),
bm AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_no ORDER BY round(score, 9), id) AS INT) rank FROM full_ QUALIFY rank <= {limit})
"""


def _knn(limit=30) -> str:
    vectors = ", ".join(f"({n}, {search.embed(q)}::DOUBLE[])" for n, q in PLAIN)
    return f""", u AS (SELECT id, embedding::DOUBLE[] v FROM chunks_vec WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
kq AS (SELECT * FROM (VALUES {vectors}) v(query_no, qv)),
kn AS (SELECT query_no, id, list_distance(v, qv) distance, CAST(row_number() OVER (PARTITION BY query_no ORDER BY round(list_distance(v, qv), 9), id) AS INT) rank FROM u, kq QUALIFY rank <= {limit})
"""


def _rrf(lists: list[str], limit=10) -> str:
    union = " UNION ALL ".join(f"SELECT query_no, id, 1.0::DOUBLE / (60 + rank) s, {i} l, rank r FROM {t}" for i, t in enumerate(lists))
    return f""", un AS ({union}), rg AS (SELECT query_no, id, round(sum(s), 6) score, min((l, r)) at_ FROM un GROUP BY ALL),
rr AS (SELECT query_no, id, score, CAST(row_number() OVER (PARTITION BY query_no ORDER BY score DESC, at_, id) AS INT) rank FROM rg QUALIFY rank <= {limit})
"""


_FUSED = _bm25(PLAIN, 30) + _knn() + _rrf(["bm", "kn"])
_BOOST = f""", ic AS (SELECT chunk_id, count(*) n FROM chunk_interactions WHERE "timestamp" >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND interaction IN ('read', 'edit') GROUP BY 1),
b0 AS (SELECT query_no, rr.id, round(score + 0.1::DOUBLE * least(coalesce(n, 0), 10) / 10, 6) score, rank before FROM rr LEFT JOIN ic ON ic.chunk_id = rr.id),
bo AS (SELECT query_no, id, score, CAST(row_number() OVER (PARTITION BY query_no ORDER BY score DESC, before) AS INT) rank FROM b0)
"""
_SNIP = "CASE WHEN len(string_split(content, chr(10))) > 10 THEN concat(array_to_string(string_split(content, chr(10))[1:10], chr(10)), chr(10), '...') ELSE content END"
_USABLE = "SELECT id, embedding::DOUBLE[] v FROM chunks_vec WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
_SEM = f"""SELECT source_id, target_id, 'semantic' edge_type, round(1 - d * d / 2, 4) weight FROM (SELECT a.id source_id, b.id target_id, list_distance(a.v, b.v) d,
  row_number() OVER (PARTITION BY a.id ORDER BY round(list_distance(a.v, b.v) * list_distance(a.v, b.v), 9), b.id) place FROM u a, u b WHERE a.id % 100 = 0) WHERE place <= 20 AND source_id <> target_id AND round(1 - d * d / 2, 9) >= 0.75"""
_TAGS = "WITH m AS (SELECT id, project_id, file_path, list_distinct(from_json(json_extract(metadata, '$.{k}'), '[\"VARCHAR\"]')) v FROM chunks WHERE json_extract(metadata, '$.{k}') IS NOT NULL)"
_SAME = "a.project_id = b.project_id AND a.file_path = b.file_path AND a.id < b.id"
_ROUNDS = 60


def _pagerank_sql() -> str:
    """Rounds one by one; the ranks of the first round that changes them by less than the tolerance."""
    out = """WITH e0 AS (SELECT source_id s, target_id t, arg_max(coalesce(weight, 1.0), edge_type) w FROM edges GROUP BY ALL), e AS (SELECT s, t, w / sum(w) OVER (PARTITION BY s) p FROM e0),
nd AS (SELECT DISTINCT id, id IN (SELECT s FROM e) has FROM (SELECT s id FROM e UNION SELECT t FROM e UNION SELECT id FROM chunks)), n AS (SELECT count(*) n FROM nd), r0 AS (SELECT id, has, 1.0::DOUBLE / n r FROM nd, n)
"""
    for k in range(_ROUNDS):
        out += f""", r{k + 1} AS MATERIALIZED (SELECT o.id, o.has, o.r old, 0.85::DOUBLE * coalesce(g.got, 0) + 0.85::DOUBLE * (SELECT coalesce(sum(r), 0) FROM r{k} WHERE NOT has) / n + 0.15::DOUBLE / n r
  FROM r{k} o CROSS JOIN n LEFT JOIN (SELECT t id, sum(r * p) got FROM r{k} JOIN e ON e.s = r{k}.id GROUP BY 1) g ON g.id = o.id)
"""
    out += ", steps AS (" + " UNION ALL ".join(f"SELECT {k} k, id, old, r FROM r{k}" for k in range(1, _ROUNDS + 1)) + "), "
    return out + "pr AS (SELECT id, round(r, 6) rank FROM steps WHERE k = (SELECT min(k) FROM (SELECT k, sum(abs(r - old)) c FROM steps GROUP BY 1), n WHERE c < n * 1e-6))\n"


_KEEP = "chunk_domain = 'content' AND \"language\" = 'markdown' AND file_path ILIKE '%docs/%_%'"
_FILTERED = _bm25(PLAIN, 15, keep=_KEEP) + _knn(15).replace("\nkn AS (", "\nkn0 AS (") + f", kn AS (SELECT query_no, kn0.id, CAST(row_number() OVER (PARTITION BY query_no ORDER BY kn0.rank) AS INT) rank FROM kn0 JOIN chunks c ON c.id = kn0.id WHERE {_KEEP})" + _rrf(["bm", "kn"], 5)
#: The prefix search of a query and project that neither branch answers.
_PREFIX = _bm25(PLAIN, match="starts_with(p.w, q.t)").replace("WITH d AS", ", d AS", 1)
for _name in ("d", "len", "st", "p", "q", "hp", "df", "sc", "full_", "bm"):
    _PREFIX = re.sub(rf"(?<![\w.'{{]){_name}(?= AS \()", f"x_{_name}", _PREFIX)
    _PREFIX = re.sub(rf"\b(FROM|JOIN) {_name}\b(?! AS \()", rf"\1 x_{_name} {_name}", _PREFIX)
_PREFIX = _PREFIX.replace("x_len len USING (id), st GROUP", "x_len len USING (id), x_st st GROUP").replace("FROM x_q q z WHERE", "FROM x_q z WHERE")
_CROSS = _bm25(PLAIN) + _knn() + _PREFIX + """, ps AS (SELECT * FROM (VALUES ('lantern-core', 0), ('tiny-postings', 1), ('detached-adapter', 3)) v(scope, no) WHERE scope IN (SELECT id FROM projects)),
sc2 AS (SELECT c.id, scope, no FROM chunks c JOIN ps ON ps.scope = c.project_id),
tx AS (SELECT query_no, scope, id, 0 l, row_number() OVER (PARTITION BY query_no, scope ORDER BY round(score, 9), id) rank FROM full_ JOIN sc2 USING (id) QUALIFY rank <= 30),
vx AS (SELECT query_no, scope, id, 1 l, row_number() OVER (PARTITION BY query_no, scope ORDER BY kn.rank) rank FROM kn JOIN sc2 USING (id)),
bx AS (SELECT * FROM tx UNION ALL SELECT * FROM vx),
px AS (SELECT query_no, scope, id, 2 l, row_number() OVER (PARTITION BY query_no, scope ORDER BY round(score, 9), id) rank FROM x_full_ JOIN sc2 USING (id) WHERE (query_no, scope) NOT IN (SELECT (query_no, scope) FROM bx) QUALIFY rank <= 30),
fu AS (SELECT query_no, scope, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) score, min((l, rank)) at_ FROM (SELECT * FROM bx UNION ALL SELECT * FROM px) GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_no, scope ORDER BY score DESC, at_, id) before FROM fu QUALIFY before <= 10),
ic AS (SELECT chunk_id, count(*) n FROM chunk_interactions WHERE "timestamp" >= TIMESTAMP '{as_of}' - INTERVAL 30 DAY AND interaction IN ('read', 'edit') GROUP BY 1),
b1 AS (SELECT query_no, scope, fr.id, round(score + 0.1::DOUBLE * least(coalesce(n, 0), 10) / 10, 6) score, before FROM fr LEFT JOIN ic ON ic.chunk_id = fr.id),
b2 AS (SELECT *, row_number() OVER (PARTITION BY query_no, scope ORDER BY score DESC, before) r, count(*) OVER g n, min(score) OVER g lo, max(score) OVER g hi FROM b1 WINDOW g AS (PARTITION BY query_no, scope)),
b3 AS (SELECT query_no, b2.id, scope, no, r, CASE WHEN n <= 1 THEN score WHEN hi = lo THEN 1.0 ELSE round((score - lo) / (hi - lo), 6) END norm, count(DISTINCT no) OVER (PARTITION BY query_no) lists FROM b2 JOIN ps USING (scope)),
b4 AS (SELECT query_no, id, scope project_id, no, r, CASE WHEN lists = 1 THEN norm ELSE round(1.0::DOUBLE / (60 + r), 6) END score FROM b3)
SELECT query_no, id, project_id, score, CAST(row_number() OVER (PARTITION BY query_no ORDER BY score DESC, no, r) AS INT) rank FROM b4 QUALIFY rank <= 10
""".replace("{as_of}", AS_OF)

SQL = {
    **edge_sql.SQL,
    "bm25_search": _bm25(PLAIN) + "SELECT query_no, id, round(score, 6) score, rank FROM bm",
    "bm25_filtered": _bm25(PLAIN, keep=SCOPE) + "SELECT query_no, id, round(score, 6) score, rank FROM bm",
    "prefix_search": _bm25([(1, "tokeniz"), (2, "lock regis")], match="starts_with(p.w, q.t)") + "SELECT query_no, id, round(score, 6) score, rank FROM bm",
    "knn_search": "WITH z AS (SELECT 1)" + _knn() + "SELECT query_no, kn.id, round(distance, 6) distance, round(1 / (1 + distance), 6) similarity, rank FROM kn JOIN chunks c ON c.id = kn.id WHERE chunk_domain = 'content'",
    "rrf_merge": _FUSED + "SELECT * FROM rr",
    "rrf_multi": _bm25(PLAIN, 30) + _knn() + ", k5 AS (SELECT * FROM kn WHERE rank <= 5)" + _rrf(["bm", "kn", "k5"], 15) + "SELECT * FROM rr",
    "normalised_scores": _bm25(PLAIN) + """SELECT query_no, id, round(CASE WHEN count(*) OVER w <= 1 THEN -score WHEN max(-score) OVER w = min(-score) OVER w THEN 1.0 ELSE round((-score - min(-score) OVER w) / (max(-score) OVER w - min(-score) OVER w), 6) END, 5) score FROM bm WINDOW w AS (PARTITION BY query_no)""",
    "interaction_boost": _FUSED + _BOOST + "SELECT * FROM bo",
    "search_results": _FUSED + _BOOST + f"SELECT bo.*, project_id, file_path, name, {_SNIP} snippet FROM bo JOIN chunks USING (id)",
    "search_rows": _FUSED + ", tx AS (SELECT * FROM (VALUES " + ", ".join(f"({n}, '{q}')" for n, q in PLAIN) + f") v(query_no, query)) SELECT query, NULL::VARCHAR project_id, 'all' domain, concat('[', coalesce(string_agg(id, ',' ORDER BY rank), ''), ']') result_chunk_ids, CAST(count(id) AS INT) result_count, TIMESTAMP '{AS_OF}' \"timestamp\" FROM tx LEFT JOIN rr USING (query_no) GROUP BY query",
    "search_hits": _FUSED + f"SELECT id chunk_id, project_id, file_path, 'search_hit' interaction, 'search' source_tool, TIMESTAMP '{AS_OF}' \"timestamp\" FROM rr JOIN chunks USING (id)",
    "cross_search": _CROSS,
    "hybrid_filtered": _FILTERED + _BOOST + "SELECT * FROM bo",
    "sanitized_queries": "SELECT DISTINCT query, trim(regexp_replace(query, '[^\\p{L}\\p{M}\\p{N}_\\s]', ' ', 'g')) clean FROM search_log",
    "snippets": f"SELECT id, {_SNIP} snippet FROM chunks",
    "path_filter": "SELECT id, file_path FROM chunks WHERE file_path ILIKE '%DOCS/%_index%%'",
    "longest_prefix": "SELECT DISTINCT concat('/srv/', f.project_id, '/', file_path) path, p.id project_id, file_path relative FROM file_index f JOIN projects p ON starts_with(concat('/srv/', f.project_id, '/', file_path), p.path || '/') QUALIFY row_number() OVER (PARTITION BY f.project_id, file_path ORDER BY length(p.path) DESC) = 1",
    "read_lines": "SELECT id, CAST(n AS INT) line_no, concat(lpad(CAST(n AS VARCHAR), 6, ' '), chr(9), line) line FROM (SELECT id, unnest(string_split(content, chr(10))) line, generate_subscripts(string_split(content, chr(10)), 1) n FROM chunks)",
    "languages": "SELECT DISTINCT file_path, CASE lower(regexp_extract(file_path, '[^/](\\.[^./]+)$', 1)) WHEN '.py' THEN 'python' WHEN '.go' THEN 'go' WHEN '.ts' THEN 'typescript' WHEN '.md' THEN 'markdown' WHEN '.html' THEN 'html' END \"language\" FROM file_index",
    "wanted_files": "SELECT DISTINCT project_id, file_path FROM file_index WHERE NOT regexp_matches(file_path, '(^|/)vendor(/|$)') AND (NOT file_path LIKE '%.txt' OR regexp_matches(file_path, '^docs/[^/]*\\.txt$')) AND NOT regexp_matches(file_path, '^archive/(.*/)?[^/]*\\.md$') AND NOT regexp_matches(file_path, '(^|/)\\.[^/]*/')",
    "tag_edges": _TAGS.format(k="tags") + f", t AS (SELECT id, project_id, file_path, len(v) n, unnest(v) tag FROM m) SELECT a.id source_id, b.id target_id, 'tag' edge_type, round(count(*) / (a.n + b.n - count(*)), 4) weight FROM t a JOIN t b ON a.tag = b.tag AND {_SAME} GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= 2",
    "category_edges": _TAGS.format(k="categories") + f", t AS (SELECT id, project_id, file_path, unnest(v) c FROM m) SELECT DISTINCT a.id source_id, b.id target_id, 'category' edge_type, 1.0::DOUBLE weight FROM t a JOIN t b ON a.c = b.c AND {_SAME}",
    "semantic_edges": f"WITH u AS ({_USABLE}) " + _SEM,
    "project_edges": "SELECT source_id, target_id, edge_type, weight FROM edges WHERE source_id IN (SELECT id FROM chunks WHERE project_id = 'lantern-core')",
    "bfs_neighbours": """WITH RECURSIVE two AS (SELECT source_id a, target_id b FROM edges UNION SELECT target_id, source_id FROM edges), w AS (SELECT id start, id, 0 depth FROM chunks WHERE id % 100 = 0
      UNION SELECT start, two.b, depth + 1 FROM w JOIN two ON two.a = w.id WHERE depth < 2) SELECT start, id, min(depth) depth FROM w WHERE id IN (SELECT id FROM chunks) GROUP BY 1, 2 HAVING min(depth) > 0""",
    "pagerank": _pagerank_sql() + "SELECT * FROM pr",
    "rank_metadata": _pagerank_sql() + "SELECT c.id, CAST(json_merge_patch(coalesce(metadata, '{}'), json_object('pagerank', rank)) AS VARCHAR) metadata FROM chunks c LEFT JOIN pr ON pr.id = c.id",
    "line_chunks": """WITH l AS (SELECT doc_id id, string_split(text, chr(10)) w FROM documents WHERE text IS NOT NULL), s AS (SELECT id, w, unnest(list_filter(range(0, greatest(len(w), 1), 8), lambda s: s = 0 OR len(w) - s > 2)) s FROM l)
      SELECT id, CAST(s // 8 AS INT) window_no, CAST(s + 1 AS INT) start_line, CAST(least(s + 10, len(w)) AS INT) end_line, array_to_string(w[s + 1:s + 10], chr(10)) content FROM s WHERE regexp_matches(array_to_string(w[s + 1:s + 10], chr(10)), '\\S')""",
    "stream_daily": """SELECT project_id, date_trunc('day', "timestamp") "day", count(*) total, count(*) FILTER (interaction = 'read') reads FROM chunk_interactions WHERE "timestamp" >= TIMESTAMP '2000-01-01' GROUP BY ALL""",
    "stream_hot": "SELECT project_id, file_path, count(*) FILTER (interaction = 'read') reads, count(*) FILTER (interaction = 'edit') edits, count(*) total FROM chunk_interactions GROUP BY 1, 2",
    "stream_append": "SELECT id, query, result_count FROM search_log",
    "stream_state": """SELECT project_id, interaction, min(epoch_us("timestamp")) first_us, max(epoch_us("timestamp")) last_us, count(*) n FROM chunk_interactions WHERE "timestamp" IS NOT NULL AND project_id IS NOT NULL AND interaction IS NOT NULL GROUP BY 1, 2""",
}
_EACH = {t: f"SELECT source_id, target_id, edge_type FROM ({SQL[f'{t}_edges']})" for t in ("link", "import", "tag", "category", "semantic")}
SQL["rebuilt_edge_counts"] = "SELECT edge_type, count(*) n FROM (" + " UNION ALL ".join(_EACH.values()) + ") GROUP BY 1"
_OWN = "(SELECT * FROM chunks WHERE project_id = 'lantern-core')"
SQL["rebuilt_project"] = f"""SELECT source_id, target_id, edge_type, weight FROM edges WHERE source_id NOT IN (SELECT id FROM {_OWN}) AND target_id NOT IN (SELECT id FROM {_OWN})
  UNION ALL SELECT source_id, target_id, edge_type, weight FROM ({SQL['tag_edges'].replace('FROM chunks', f'FROM {_OWN}')}) UNION ALL SELECT source_id, target_id, edge_type, weight FROM ({SQL['category_edges'].replace('FROM chunks', f'FROM {_OWN}')})"""
