"""Splitting oversized texts at natural boundaries by agglomerative merging.

A text starts as atomic segments: its lines, and of very long lines the sentences, words or, where
there is nothing else, stretches of characters. Adjacent pieces lie in a heap by the strength of the
boundary between them; the weakest boundary is removed first, as long as the joined piece together
with what it repeats of its predecessor stays within both limits.
"""

from __future__ import annotations

import heapq
import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F

HEADING = re.compile(r"\s*(#{1,6}\s|={2,6}[^=]+={2,6}\s*$|<h[1-6][\s>]|\\(?:sub)*section\b|\\chapter\b)", re.I)
DEFINITION = re.compile(r"(?:export\s+|async\s+|public\s+|private\s+|static\s+)*(?:def|class|func|function|interface|type|struct|enum|impl|fn)\b|@\w")
FENCE = re.compile(r"\s*(```|~~~)")
OPEN, CLOSE = re.compile(r"\s*(<pre\b|\\begin\{(?:verbatim|lstlisting)\}|<syntaxhighlight\b|<source\b)", re.I), re.compile(r"</pre>|\\end\{(?:verbatim|lstlisting)\}|</syntaxhighlight>|</source>", re.I)
SENTENCE, SPACE = re.compile(r"[.!?…;:][\"')\]]*\s+"), re.compile(r"\s+")


def trim_end(text: str) -> str:
    """The text without the line breaks (LF or CRLF) at its very end."""
    i = len(text)
    while i and text[i - 1] == "\n":
        i -= 2 if i > 1 and text[i - 2] == "\r" else 1
    return text[:i]


class Splitter:
    """Cuts one text. ``max_chars`` and ``max_lines`` hold for pieces with their overlap."""

    def __init__(self, max_chars: int = 2000, max_lines: int = 50, overlap_lines: int = 2, overlap_chars: int = 200):
        if overlap_lines >= max_lines or 4 * overlap_chars > max_chars:
            raise ValueError("the overlap must be well below the limits")
        self.max_chars, self.max_lines, self.overlap_lines, self.overlap_chars = max_chars, max_lines, overlap_lines, overlap_chars
        self.most = max_chars // 2  # an overlap or an atom has at most this many characters

    def _cut_line(self, line: str) -> list[tuple[int, int]]:
        """(start, strength of the boundary before it) of the segments of a long line."""
        cuts, at, step = [], 0, self.most - self.overlap_chars
        while len(line) - at > self.most:
            window = line[at : at + step]
            found = None
            for strength, pattern in ((8, SENTENCE), (4, SPACE)):
                ends = [m.end() for m in pattern.finditer(window) if m.end() > step // 4]
                if ends:
                    found = (at + ends[-1], strength)
                    break
            at, strength = found or (at + step, 1)
            cuts.append((at, strength))
        return cuts

    def atoms(self, text: str) -> list[tuple[int, int, bool]]:
        """(start, strength of the boundary before it, whether it starts a line) of every atom."""
        out, pos, fenced, blank = [], 0, False, True
        indent_before = 0
        for line in re.findall(r"[^\n]*\n|[^\n]+\Z", text):
            body = line.strip()
            indent = len(line) - len(line.lstrip())
            fence = bool(FENCE.match(line))
            if fenced:
                strength = 12 if blank else 10
            elif HEADING.match(line):
                strength = 100
            elif not body:
                strength = 20
            elif DEFINITION.match(line):
                strength = 80
            elif blank:
                strength = 60 - min(indent, 20)
            elif fence or OPEN.match(line):
                strength = 50
            elif indent < indent_before:
                strength = 24
            else:
                strength = 30 if indent == 0 else 22
            out.append((pos, strength, True))
            if len(line) > self.most:
                out += [(pos + at, s, False) for at, s in self._cut_line(line)]
            if fence or (not fenced and OPEN.match(line) and not CLOSE.search(line)) or (fenced and CLOSE.search(line)):
                fenced = not fenced
            blank, indent_before = not body, indent if body else indent_before
            pos += len(line)
        return out

    def pieces(self, text: str) -> list[tuple[int, int]]:
        """Character ranges of the pieces, overlap included, in order. Text without the line breaks
        at its very end is covered completely; a text within the limits is one piece, an empty one none."""
        text = trim_end(text)
        if not text:
            return []
        if len(text) <= self.max_chars and text.count("\n") < self.max_lines:
            return [(0, len(text))]
        atoms = self.atoms(text)
        n = len(atoms)
        start = [a[0] for a in atoms] + [len(text)]
        line_no, k = [], -1
        for a in atoms:
            k += a[2]
            line_no.append(k)
        line_start = [a[0] for a in atoms if a[2]]
        lead = [0] * n  # where the piece that begins with an atom begins, overlap included
        for i in range(n):
            own, no = start[i], line_no[i]
            back = line_start[max(0, no - self.overlap_lines)]
            lead[i] = back if atoms[i][2] and own - back <= self.most else max(0, own - self.overlap_chars)
        first_line = [0] * n
        for i in range(n):
            j = i
            while start[j] > lead[i]:
                j -= 1
            first_line[i] = line_no[j]

        def fits(lo: int, hi: int) -> bool:
            return start[hi] - lead[lo] <= self.max_chars and line_no[hi - 1] - first_line[lo] + 1 <= self.max_lines

        end = list(range(1, n + 1))  # of the piece that begins with an atom
        head = list(range(n))  # of the piece that ends before atom i + 1, kept at its last atom
        heap = [(atoms[i][1], start[i + 1] - start[i - 1], i) for i in range(1, n)]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            strength, size, i = heapq.heappop(heap)
            if gone[i]:
                continue
            lo, hi = head[i - 1], end[i]
            if not fits(lo, hi):
                continue  # stays, unless what is before it comes to begin where less is repeated
            if start[hi] - start[lo] != size:
                heapq.heappush(heap, (strength, start[hi] - start[lo], i))
                continue
            end[lo], head[hi - 1], gone[i] = hi, lo, True
            if hi < n:
                heapq.heappush(heap, (atoms[hi][1], start[end[hi]] - start[lo], hi))
        out, i = [], 0
        while i < n:
            out.append((lead[i], start[end[i]]))
            i = end[i]
        return out


def exceeded(text: str, max_chars: int = 2000, max_lines: int = 50):
    """Columns for the two limits of a text column: code points, and lines that end in LF or CRLF,
    where line breaks at the very end add no line."""
    chars = F.length(text)
    # A CR at the very end is left over from nothing but CRLF, and is no line, so both may be trimmed.
    lines = F.regexp_count(F.rtrim(F.col(text), F.lit("\r\n")), F.lit("\n")) + 1
    return chars > max_chars, lines > max_lines


def split_oversized(df: DataFrame, id_col: str, text_col: str, start_line_col: str, max_chars: int = 2000, max_lines: int = 50, overlap_lines: int = 2, overlap_chars: int = 200) -> DataFrame:
    """``id, too_long, too_many_lines, piece, start_char, end_char, start_line, end_line, text``: the
    pieces of every text beyond a limit.

    Lines are counted from the row's own start line, or from 1 where that is null or below 1. Null
    and empty texts are within the limits. A text that exceeds ``max_chars`` only by line breaks at
    its end gives one piece without them. Repeated rows are cut one by one. Extra columns are
    ignored. Every row is cut where it lies, without a shuffle.
    """
    long, many = exceeded("text", max_chars, max_lines)
    base = F.when(F.col(start_line_col) >= 1, F.col(start_line_col)).otherwise(1).cast("int")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), base.alias("base"))
    rows = rows.select("id", "base", "text", F.coalesce(long, F.lit(False)).alias("c"), F.coalesce(many, F.lit(False)).alias("l")).where("c OR l")

    def run(batches):
        s = Splitter(max_chars, max_lines, overlap_lines, overlap_chars)
        for pdf in batches:
            out = []
            for id_, base_, text, c, l in pdf.itertuples(index=False, name=None):
                breaks = [m.start() for m in re.finditer("\n", text)]
                at = 0
                for no, (lo, hi) in enumerate(s.pieces(text) or [(0, 0)], 1):
                    while at < len(breaks) and breaks[at] < lo:
                        at += 1
                    piece = text[lo:hi]
                    first = base_ + at
                    last = first + piece.rstrip("\r\n").count("\n") if piece.strip("\r\n") else first + max(0, piece.count("\n") - 1)
                    out.append((id_, c, l, no, lo, hi, first, last, piece))
            yield pd.DataFrame(out, columns=["id", "too_long", "too_many_lines", "piece", "start_char", "end_char", "start_line", "end_line", "text"])

    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, too_long boolean, too_many_lines boolean, piece int, start_char int, end_char int, start_line int, end_line int, text string")
