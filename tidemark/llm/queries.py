"""Queries of the problems on training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import leaks, markup, mixing, repetition, splitting
from tidemark.llm.neighbours import Neighbours
from tidemark.llm.neardup import NearDuplicates
from tidemark.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of chunks of which one is among the five nearest of the other."""
    top = Neighbours(table(spark, d, "chunks_vec"), "id", "embedding").top()
    return top.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p1_edges(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest chunks of every chunk, as semantic edges with their weight."""
    top = Neighbours(table(spark, d, "chunks_vec"), "id", "embedding").top()
    return top.select(F.col("id").alias("source_id"), F.col("other").alias("target_id"), F.round("cosine", 4).alias("weight"), "place")


def _content(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("chunk_domain = 'content'")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The markup languages and elements of every content chunk."""
    found = markup.read_markup(_content(spark, d), "id", "content")
    return found.select("id", F.explode("found").alias("f")).select("id", "f.markup", "f.element")


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    """Content chunks as clean text that keeps headings, lists, code blocks and formulas."""
    return markup.read_markup(_content(spark, d), "id", "content", True).select("id", "n_leaves", "clean")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of chunks whose three-word shingles have Jaccard similarity 0.6 or more."""
    return NearDuplicates(table(spark, d, "chunks"), "id", "content").pairs()


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each near-duplicate chunk with its group and number of links."""
    return NearDuplicates(table(spark, d, "chunks"), "id", "content").classes()


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "chunks"), "id", "content", "start_line")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The limits that each oversized chunk exceeds."""
    limits = F.array_compact(F.array(F.when(F.col("too_long"), "chars"), F.when(F.col("too_many_lines"), "lines")))
    return _pieces(spark, d).where("piece = 1").select("id", F.explode(limits).alias("exceeded"))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of the oversized chunks."""
    return _pieces(spark, d).drop("too_long", "too_many_lines")


def p8_edits(spark: SparkSession, d: str) -> DataFrame:
    """Documents that contain twelve consecutive words of an evaluation item with up to one edit of their
    letters and digits, and how many edits it takes."""
    return leaks.count_edits(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "item_text", max_edits=1)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that contain twelve consecutive words of an evaluation item: the leaks without an edit."""
    return p8_edits(spark, d).where("edits = 0").select("doc_id", "item_id")


def _plan(spark: SparkSession, d: str):
    docs = mixing.sized(table(spark, d, "documents"), "doc_id", "source", "doc_kind", "lang", mixing.plain_tokens("text"))
    return docs, mixing.budgets(mixing.leaves(docs, table(spark, d, "mix_targets")), ["domain", "lang"])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that cannot reach their target share even when repeated as often as allowed: the leaves
    whose shortage others have to take over."""
    return _plan(spark, d)[1].where("supply < wanted").select("source")


def p9_budgets(spark: SparkSession, d: str) -> DataFrame:
    """Place in the tree, supply and budget of every source."""
    got = _plan(spark, d)[1]
    return got.select("source", "domain", "lang", "tokens", "supply", F.round("wanted", 3).alias("wanted"), F.round("budget", 3).alias("budget"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mix and how often each is used."""
    return mixing.mix(*_plan(spark, d))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target, budget and share really reached of every source."""
    got = mixing.mix(*_plan(spark, d))[1]
    return got.select("source", "target_share", F.round("budget", 3).alias("budget"), "tokens", "uses", F.round("share", 9).alias("share"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents of which at least three tenths are repeated five-word sequences."""
    share = repetition.repeated_share(table(spark, d, "documents"), "doc_id", "text")
    return share.where("n_sequences - n_distinct >= 0.30BD * n_sequences").select(F.col("id").alias("doc_id"))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of repeated content of every document."""
    share = repetition.repeated_share(table(spark, d, "documents"), "doc_id", "text")
    return share.select(F.col("id").alias("doc_id"), "n_words", "n_sequences", "n_distinct", "repeated_share")


def p10_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that many documents of a source share, removed; documents that are depleted by it."""
    return repetition.line_frequency(table(spark, d, "documents"), "doc_id", "source", "text").withColumnRenamed("id", "doc_id")


_WORDS10 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w FROM documents),
g AS (SELECT doc_id, coalesce(len(w), 0) n_words, CASE WHEN len(w) >= 20 THEN len(w) - 4 END n_sequences,
  CASE WHEN len(w) >= 20 THEN len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END n_distinct FROM w)
"""
#: Cosines of all usable vectors with all others, copies among them, and the five best of each.
_NEAREST = """
WITH u AS (SELECT id, embedding::DOUBLE[] v FROM chunks_vec WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
c AS (SELECT a.id, b.id other, list_cosine_similarity(a.v, b.v) cosine FROM u a JOIN u b ON a.id <> b.id),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY round(cosine, 12) DESC, other) AS INT) place FROM c QUALIFY place <= 5)
"""
_SIMILAR = r"""
WITH RECURSIVE w AS (SELECT id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') w FROM chunks),
s AS (SELECT id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))) s FROM w WHERE len(w) >= 20),
x AS (SELECT id, len(s) n, unnest(s) g FROM s),
p AS (SELECT a.id id_a, b.id id_b FROM x a JOIN x b USING (g) WHERE a.id < b.id GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= 0.6 * (a.n + b.n - count(*)))
"""


def _leaf_sql() -> str:
    """Budgets level by level, in the way of ``mixing.budgets``."""
    out = r"""
WITH d AS (SELECT doc_id id, lower(trim(source)) source, coalesce(lower(trim(doc_kind)), 'unknown') domain, coalesce(split_part(lower(trim(lang)), '-', 1), 'und') lang,
  len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\s\x{0b}\x{85}\p{Z}\p{L}\p{N}_]')) tokens FROM documents WHERE source IS NOT NULL AND len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\s\x{0b}\x{85}\p{Z}\p{L}\p{N}_]')) > 0),
dm AS (SELECT source, domain FROM (SELECT source, domain, count(*) n FROM d GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, domain DESC) = 1),
lg AS (SELECT source, lang FROM (SELECT source, lang, count(*) n FROM d GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang DESC) = 1),
tk AS (SELECT source, sum(tokens)::BIGINT tokens FROM d GROUP BY 1),
l0 AS (SELECT source, target_share w, max_repeats, coalesce(tokens, 0)::BIGINT tokens, coalesce(domain, 'unknown') domain, coalesce(lang, 'unknown') lang
  FROM mix_targets LEFT JOIN tk USING (source) LEFT JOIN dm USING (source) LEFT JOIN lg USING (source)),
l1 AS (SELECT *, tokens * max_repeats supply, w * sum(tokens) OVER () wanted FROM l0), b2 AS (SELECT *, least(wanted, supply::DOUBLE) budget FROM l1)"""
    for depth, group in ((2, "PARTITION BY domain, lang"), (1, "PARTITION BY domain"), (0, "")):
        out += f""",
r{depth} AS (SELECT *, supply - budget room, supply - budget > 1e-9 AND w > 0 has, sum(wanted) OVER ({group}) - sum(budget) OVER ({group}) lack FROM b{depth}),
q{depth} AS (SELECT *, CASE WHEN has THEN room / w END dry, CASE WHEN has THEN w ELSE 0 END ow FROM r{depth}),
k{depth} AS (SELECT *, (lack - coalesce(sum(CASE WHEN has THEN room END) OVER ({group} ORDER BY dry NULLS LAST, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / nullif(sum(ow) OVER ({group} ORDER BY dry NULLS LAST, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) rate0 FROM q{depth}),
m{depth} AS (SELECT *, max(CASE WHEN rate0 <= dry THEN rate0 END) OVER ({group}) rate FROM k{depth}),
b{depth - 1 if depth else 'x'} AS (SELECT source, w, max_repeats, tokens, domain, lang, supply, wanted, CASE WHEN lack > 1e-9 AND has THEN CASE WHEN rate IS NULL THEN supply::DOUBLE ELSE least(supply::DOUBLE, budget + rate * w) END ELSE budget END budget FROM m{depth})"""
    return out


_LEAVES = _leaf_sql()
_MIX = _LEAVES + """,
pl AS (SELECT *, least(CAST(floor(coalesce(budget / nullif(tokens, 0), 0)) AS INT), max_repeats) full_ FROM bx),
dr AS (SELECT d.id, d.source, d.tokens, full_, budget - full_ * pl.tokens rest, CAST(concat('0x', substr(md5(concat_ws('|', 7, d.source, full_, d.id)), 1, 15)) AS BIGINT) draw FROM d JOIN pl USING (source)),
se AS (SELECT id, source, tokens, CAST(full_ + CASE WHEN sum(tokens) OVER (PARTITION BY source ORDER BY draw, id) <= rest THEN 1 ELSE 0 END AS INT) copies FROM dr),
mx AS (SELECT * FROM se WHERE copies > 0),
re AS (SELECT source, sum(tokens * copies)::BIGINT tokens, sum(copies)::BIGINT uses FROM mx GROUP BY 1)
"""
#: Full-width letters and digits, and what they stand for.
_WIDE = "".join(chr(0xFEE0 + c) for c in range(0x21, 0x7F) if chr(c).isalnum()), "".join(chr(c) for c in range(0x21, 0x7F) if chr(c).isalnum())
_PLAIN = "strip_accents(replace(lower(translate({0}, '" + _WIDE[0] + "', '" + _WIDE[1] + "')), 'ß', 'ss'))"
_LINE = r"trim(regexp_replace(regexp_replace(lower(line), '\p{N}+', '0', 'g'), '[^\p{L}0]+', ' ', 'g'))"
QUERIES = {f.__name__: f for f in (p1_found, p1_edges, p3_found, p3_clean, p4_found, p4_classes, p5_found, p5_pieces, p8_edits, p8_found, p9_found, p9_budgets, p9_mix, p9_shares, p10_found, p10_shares, p10_lines)}
SQL: dict[str, str] = {
    "p1_found": _NEAREST + "SELECT DISTINCT least(id, other) id_a, greatest(id, other) id_b FROM t",
    "p1_edges": _NEAREST + "SELECT id source_id, other target_id, round(cosine, 4) weight, place FROM t",
    "p4_found": _SIMILAR + "SELECT * FROM p",
    "p4_classes": _SIMILAR + """, two AS (SELECT id_a a, id_b b FROM p UNION ALL SELECT id_b, id_a FROM p),
r AS (SELECT a id, a c FROM two UNION SELECT two.b, r.c FROM r JOIN two ON two.a = r.id)
SELECT id, min(c) class_id, (SELECT count(*) FROM two WHERE two.a = r.id) n_links FROM r GROUP BY id""",
    "p5_found": r"""
WITH s AS (SELECT id, length(content) c, len(regexp_extract_all(regexp_replace(content, '(\r?\n)+$', ''), '\n')) + 1 l FROM chunks)
SELECT id, 'chars' exceeded FROM s WHERE c > 2000 UNION ALL SELECT id, 'lines' FROM s WHERE l > 50""",
    "p8_found": r"""
WITH i AS (SELECT item_id, list_filter(list_transform(regexp_split_to_array(item_text, '\s+'), lambda x: regexp_replace(""" + _PLAIN.format("x") + r""", '[^\p{L}\p{N}]+', '', 'g')), lambda x: x <> '') w FROM eval_items),
r AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], '') run FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) k FROM i)),
d AS (SELECT doc_id, regexp_replace(""" + _PLAIN.format("text") + r""", '[^\p{L}\p{N}]+', '', 'g') t FROM documents WHERE text IS NOT NULL)
SELECT DISTINCT doc_id, item_id FROM d JOIN r ON contains(d.t, r.run)""",
    "p9_found": _LEAVES + " SELECT source FROM l1 WHERE supply < wanted",
    "p9_budgets": _LEAVES + " SELECT source, domain, lang, tokens, supply, round(wanted, 3) wanted, round(budget, 3) budget FROM bx",
    "p9_mix": _MIX + "SELECT id, source, copies FROM mx",
    "p9_shares": _MIX + "SELECT pl.source, w target_share, round(budget, 3) budget, coalesce(re.tokens, 0) tokens, coalesce(uses, 0) uses, round(coalesce(re.tokens, 0) / (SELECT sum(tokens) FROM re), 9) share FROM pl LEFT JOIN re USING (source)",
    "p10_found": _WORDS10 + "SELECT doc_id FROM g WHERE n_sequences - n_distinct >= 0.30 * n_sequences",
    "p10_shares": _WORDS10 + "SELECT *, 1 - n_distinct / n_sequences repeated_share FROM g",
    "p10_lines": f"""
WITH l AS (SELECT doc_id, coalesce(lower(trim(source)), '') host, unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) line FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, host, {_LINE} norm, length(line) chars FROM l),
c AS (SELECT host, norm FROM n WHERE norm <> '' GROUP BY ALL HAVING count(DISTINCT doc_id) > 10),
m AS (SELECT n.*, c.norm IS NOT NULL gone FROM n LEFT JOIN c ON c.host = n.host AND c.norm = n.norm WHERE n.norm <> '')
SELECT doc_id, host, count(*) n_lines, CAST(count(*) FILTER (gone) AS BIGINT) n_removed, 1 - sum(CASE WHEN gone THEN chars ELSE 0 END) / sum(chars) chars_left_share,
  1 - sum(CASE WHEN gone THEN chars ELSE 0 END) / sum(chars) < 0.5 rejected FROM m GROUP BY ALL""",
}
# With one edit one half of a run is untouched: the other is compared where that half stands.
SQL["p8_edits"] = SQL["p8_found"].rsplit("\n", 1)[0] + """,
h AS (SELECT *, length(run) // 2 half FROM r),
p AS (SELECT item_id, run, 0 off, left(run, half) piece FROM h UNION ALL SELECT item_id, run, half, substr(run, half + 1) FROM h),
m AS (SELECT *, unnest(list_filter(range(1, length(t) - length(piece) + 2), lambda k: substr(t, k, length(piece)) = piece)) - off s FROM d JOIN p ON contains(d.t, p.piece)),
n AS (SELECT doc_id, item_id, levenshtein(run, substr(t, s + ds, length(run) + dl)) edits FROM m, unnest([-1, 0, 1]) a(ds), unnest([-1, 0, 1]) b(dl) WHERE s + ds >= 1)
SELECT doc_id, item_id, CAST(min(edits) AS INT) edits FROM n WHERE edits <= 1 GROUP BY ALL"""
