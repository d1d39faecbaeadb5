"""Repetition within documents, and lines that many documents of a host share.

The cross-document line frequency hashes normalised lines, counts in how many documents of a host
each occurs, removes lines above a limit and rejects documents of which too little is left. It says
nothing about a phrase that one document alone repeats, so the share of repeated content within a
document is measured on its own word sequences; both figures come out per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def words(text: str) -> Column:
    """Longest runs of letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def repeated_share(df: DataFrame, id_col: str, text_col: str, width: int = 5, least_words: int = 20) -> DataFrame:
    """``id, n_words, n_sequences, n_distinct, repeated_share`` per document.

    The share is one minus distinct over all ``width``-word sequences. Documents that are null, empty
    or have fewer than ``least_words`` words have null sequences and share. Texts are taken whole,
    however long. A document that is listed twice gives two rows. Works row by row, without shuffle.
    """
    least = max(least_words, width)

    def counts(w: Column) -> Column:
        # The words are the variable of a lambda, so that they are split once and not per sequence.
        sequences = F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.array_join(F.slice(w, i, width), " "))
        return F.struct(F.size(w).alias("n"), F.when(F.size(w) >= least, F.size(F.array_distinct(sequences))).alias("d"))

    c = F.transform(F.array(F.coalesce(words(text_col), F.array().cast("array<string>"))), counts)[0]
    counted = df.select(F.col(id_col).alias("id"), F.explode(F.array(c)).alias("c")).select(
        "id", F.col("c.n").alias("n_words"), F.when(F.col("c.n") >= least, F.col("c.n") - (width - 1)).alias("n_sequences"), F.col("c.d").alias("n_distinct"))
    return counted.withColumn("repeated_share", 1 - F.col("n_distinct") / F.col("n_sequences"))


def normalised_line(c: Column) -> Column:
    """Lower case, digits as 0, runs of anything else as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"\p{N}+", "0"), r"[^\p{L}0]+", " "))


def line_frequency(df: DataFrame, id_col: str, host_col: str, text_col: str, max_docs: int = 10, least_left: float = 0.5) -> DataFrame:
    """``id, host, n_lines, n_removed, chars_left_share, rejected`` per document with a line.

    A line (normalised, not empty) is removed if more than ``max_docs`` distinct documents of the
    host have it; a document that keeps less than ``least_left`` of its characters is rejected.
    Null hosts form one host of their own; hosts are compared trimmed and in lower case. Documents
    without lines are not listed. Equal lines of one document count as one document.

    One shuffle counts lines: (host, line) with distinct documents, combined on the map side. Only
    the lines above the limit go back, joined by their hash; a line that a third of all documents
    share is one row there, and the documents' lines are spread by a salt for that join.
    """
    host = F.coalesce(F.lower(F.trim(F.col(host_col))), F.lit(""))
    line = F.explode(F.split(F.col(text_col), r"\r\n|\r|\n"))
    lines = df.select(F.col(id_col).alias("id"), host.alias("host"), line.alias("line")).withColumn("norm", normalised_line(F.col("line"))).where("norm <> ''")
    # 128-bit line keys; the document's own repeats fold away before anything is counted.
    keyed = lines.select("id", F.xxhash64("host", "norm").alias("k1"), F.xxhash64("norm", F.lit(7), "host").alias("k2"), "host", F.length("line").alias("chars"))
    per_doc = keyed.groupBy("id", "host", "k1", "k2").agg(F.count(F.lit(1)).alias("times"), F.sum("chars").alias("chars"))
    salts = 16
    # Two levels: documents per (line, salt), then per line, so one line never fills a task.
    common = (
        per_doc.groupBy("k1", "k2", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")).agg(F.count(F.lit(1)).alias("n"))
        .groupBy("k1", "k2").agg(F.sum("n").alias("docs")).where(F.col("docs") > max_docs)
        .select("k1", "k2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(True).alias("common")))
    marked = per_doc.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(common, ["k1", "k2", "salt"], "left")
    gone = lambda c: F.sum(F.when(F.col("common"), F.col(c)).otherwise(0))
    out = marked.groupBy("id", "host").agg(F.sum("times").alias("n_lines"), gone("times").alias("n_removed"), (1 - gone("chars") / F.sum("chars")).alias("chars_left_share"))
    return out.withColumn("rejected", F.col("chars_left_share") < least_left)
