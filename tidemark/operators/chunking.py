"""Cutting files into chunks: line windows, headings, definitions, component files.

The cutting itself works on one text at a time, so every operator is a scan without shuffle.
"""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F

SCHEMA = "chunk_type string, name string, start_line int, end_line int, content string"


def line_windows(df: DataFrame, id_col: str, text_col: str, size: int = 50, overlap: int = 2) -> DataFrame:
    """``id, window_no, start_line, end_line, content``: windows of ``size`` lines that overlap.

    A window that would hold no more than the overlap is not begun; blank windows are dropped, as
    are null texts. Built from column functions only.
    """
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the window")
    lines = F.split(F.col(text_col), "\n", -1)
    n = F.size("lines")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap)), lambda s: (s == 0) | (n - s > overlap))
    got = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), lines.alias("lines")).select("id", "lines", F.posexplode(starts).alias("window_no", "s"))
    text = F.array_join(F.slice("lines", F.col("s") + 1, size), "\n")
    return got.select("id", "window_no", (F.col("s") + 1).alias("start_line"), F.least(F.col("s") + size, n).alias("end_line"), text.alias("content")).where(F.trim(F.regexp_replace("content", r"\s+", "")) != "")


_HEADING = re.compile(r"(#{2,3})\s+(.+)")
#: What is kept of a front matter.
FRONT_KEYS = ("title", "description", "tags", "categories", "slug", "tldr", "keyTakeaways", "faq", "pubDate", "lang")


def front_matter(text: str) -> tuple[dict, str]:
    """The kept keys of a YAML front matter, and the text after it."""
    m = re.match(r"---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\Z)", text, re.S)
    if not m:
        return {}, text
    import yaml

    try:
        meta = yaml.safe_load(m[1])
    except yaml.YAMLError:
        return {}, text
    meta = meta if isinstance(meta, dict) else {}
    return {k: meta[k] for k in FRONT_KEYS if isinstance(meta.get(k), (list, dict, str, int, float, bool))}, text[m.end() :].strip()


def by_headings(text: str, least: int = 200, overlap: int = 0) -> list[dict]:
    """Sections at level 2 and 3 headings; a section shorter than ``least`` characters joins the one
    before. Headings belong to their own section, and a text before the first heading is a section
    without name."""
    meta, body = front_matter(text)
    if not body.strip():
        return []
    lines = body.split("\n")
    shift = text.count("\n") + 1 - len(lines)
    marks = [(i, m[2].strip()) for i, line in enumerate(lines) if (m := _HEADING.match(line))]
    if not marks:
        return [{"name": None, "start_line": 1, "end_line": text.count("\n") + 1, "content": body.strip(), "metadata": meta}]
    if any(line.strip() for line in lines[: marks[0][0]]):
        marks.insert(0, (0, None))
    ends = [i for i, _ in marks[1:]] + [len(lines)]
    out: list[dict] = []
    for (lo, name), hi in zip(marks, ends):
        part = "\n".join(lines[lo:hi])
        if out and len(part.strip()) < least:
            out[-1]["content"] += "\n" + part
            out[-1]["end_line"] = hi + shift
        else:
            out.append({"name": name, "start_line": lo + 1 + shift, "end_line": hi + shift, "content": part, "metadata": meta})
    if overlap:
        for before, s in zip(out[:-1], out[1:]):
            first = max(s["start_line"] - overlap, before["start_line"])
            s["content"] = "\n".join(lines[first - 1 - shift : s["start_line"] - 1 - shift]) + "\n" + s["content"]
            s["start_line"] = first
    for s in out:
        s["content"] = s["content"].strip()
    return out


def windows(lines: list[str], first: int, last: int, kind: str, name: str, size: int, overlap: int) -> list[tuple]:
    """Lines ``first..last`` (from 0) as one chunk, or as windows if they are too many."""
    n = last - first + 1
    if n <= size:
        return [(kind, name, first + 1, last + 1, "\n".join(lines[first : last + 1]))]
    out = []
    for s in range(0, n, size - overlap):
        if s and n - s <= overlap:
            break
        a, b = first + s, min(first + s + size, last + 1)
        if any(x.strip() for x in lines[a:b]):
            out.append((kind, name, a + 1, b, "\n".join(lines[a:b])))
    return out


#: Definitions of languages with braces: (pattern with the name, kind).
_BRACE = [
    (re.compile(r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([\w$]*)"), "function"),
    (re.compile(r"^func\s+(?:\([^)]*\)\s*)?(\w+)"), "function"),
    (re.compile(r"^(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)"), "function"),
    (re.compile(r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"), "class"),
    (re.compile(r"^(?:pub\s+)?struct\s+(\w+)|^type\s+(\w+)\s+struct\b"), "struct"),
    (re.compile(r"^(?:export\s+)?(?:pub\s+)?(?:interface|trait)\s+(\w+)|^type\s+(\w+)\s+interface\b"), "interface"),
    (re.compile(r"^(?:export\s+)?(?:pub\s+)?(?:const\s+)?enum\s+(\w+)"), "enum"),
    (re.compile(r"^impl\b[^{]*?(\w+)\s*\{"), "impl"),
    (re.compile(r"^(?:export\s+)?(?:declare\s+)?(?:namespace|module|mod)\s+(\w+)"), "module"),
    (re.compile(r"^(?:export\s+)?type\s+(\w+)"), "type"),
    (re.compile(r"^(?:export\s+)?(?:const|let|var)\s+([\w$]+)"), "block"),
]


def kind_of_node(node: str) -> str:
    """The kind of chunk for a syntax node's type name, by the first key word it contains."""
    # Fixed values, in this order.
    table = [
        (("function", "method", "fn"), "function"), (("class",), "class"), (("struct",), "struct"), (("interface", "trait", "protocol"), "interface"),
        (("enum",), "enum"), (("impl",), "impl"), (("module", "namespace", "mod"), "module"), (("type",), "type"),
    ]
    return next((kind for words, kind in table if any(w in node.lower() for w in words)), "block")


def python_definitions(text: str) -> list[tuple[str, str, int, int, list]] | None:
    """(kind, name, first, last, methods) of the top-level definitions; None if it does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None
    out = []
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)]) - 1
            decorated = bool(node.decorator_list)
            cls = isinstance(node, ast.ClassDef)
            methods = [] if decorated or not cls else [("method", m.name, m.lineno - 1, m.end_lineno - 1) for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)) and not m.decorator_list]
            out.append(("block" if decorated else "class" if cls else "function", node.name, first, node.end_lineno - 1, methods))
    return out


def brace_definitions(text: str) -> list[tuple[str, str, int, int, list]]:
    """Top-level definitions of languages with braces, up to the line on which their braces close."""
    lines = text.split("\n")
    out, i = [], 0
    while i < len(lines):
        hit = next(((kind, next((g for g in m.groups() if g), "")) for p, kind in _BRACE if (m := p.match(lines[i]))), None)
        if hit is None:
            i += 1
            continue
        depth, j, opened = 0, i, False
        while j < len(lines):
            bare = re.sub(r"//.*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`[^`]*`", "", lines[j])
            depth += bare.count("{") - bare.count("}")
            opened = opened or "{" in bare
            if depth <= 0 and (opened or bare.rstrip().endswith((";", ")")) or not bare.strip()):
                break
            j += 1
        j = min(j, len(lines) - 1)
        out.append((*hit, i, j, []))
        i = j + 1
    return out


def component_regions(text: str, size: int, overlap: int) -> list[tuple]:
    """Front matter, template, script and style regions of a component file."""
    lines = text.split("\n")
    out, at = [], 0
    fences = [i for i, line in enumerate(lines) if line.strip() == "---"][:2]
    if len(fences) == 2 and fences[0] == 0:
        if fences[1] > 1:
            out += windows(lines, 0, fences[1], "block", "frontmatter", size, overlap)
        at = fences[1] + 1
    no, i, start = 0, at, at

    def template(a, b):
        nonlocal no
        if a < b and any(x.strip() for x in lines[a:b]):
            no += 1
            out.extend(windows(lines, a, b - 1, "block", "template" if no == 1 else f"template-{no}", size, overlap))

    while i < len(lines):
        m = re.search(r"<(script|style)\b[^>]*>", lines[i], re.I)
        if not m:
            i += 1
            continue
        tag = m[1].lower()
        end = next((j for j in range(i, len(lines)) if f"</{tag}>" in lines[j].lower()), len(lines) - 1)
        template(start, i)
        out.extend(windows(lines, i, end, tag, tag, size, overlap))
        i = start = end + 1
    template(start, len(lines))
    return sorted(out, key=lambda c: c[2])


def code_chunks_of(text: str, language: str | None, size: int = 50, overlap: int = 2) -> list[tuple]:
    """(kind, name, start_line, end_line, content) of a code file: its definitions, with methods of
    classes that were not cut; line windows where there are none."""
    if not text or not text.strip():
        return []
    lines = text.split("\n")
    if language == "astro":
        return component_regions(text, size, overlap) or windows(lines, 0, len(lines) - 1, "block", "", size, overlap)
    found = python_definitions(text) if language == "python" else brace_definitions(text) if language else None
    if not found:
        return windows(lines, 0, len(lines) - 1, "block", "", size, overlap)
    out = []
    for kind, name, first, last, methods in found:
        out += windows(lines, first, last, kind, name, size, overlap)
        if last - first + 1 <= size:
            for k, n, a, b in methods:
                out += windows(lines, a, b, k, n, size, overlap)
    return sorted(out, key=lambda c: (c[2], -c[3]))


def _table(df: DataFrame, id_col: str, text_col: str, extra: list[str], cut) -> DataFrame:
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *extra)

    def run(batches):
        for pdf in batches:
            out = [(row[0], no, *c) for row in pdf.itertuples(index=False, name=None) if row[1] for no, c in enumerate(cut(*row[1:]))]
            yield pd.DataFrame(out, columns=["id", "no", "chunk_type", "name", "start_line", "end_line", "content"])

    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, no int, {SCHEMA}")


def code_chunks(df: DataFrame, id_col: str, text_col: str, language_col: str, size: int = 50, overlap: int = 2) -> DataFrame:
    """Chunks of code files. Null and blank texts give none; unknown languages are cut into windows."""
    return _table(df, id_col, text_col, [language_col], lambda t, lang: code_chunks_of(t, lang, size, overlap))


def heading_chunks(df: DataFrame, id_col: str, text_col: str, least: int = 200) -> DataFrame:
    """Sections of Markdown files."""
    return _table(df, id_col, text_col, [], lambda t: [("heading", s["name"], s["start_line"], s["end_line"], s["content"]) for s in by_headings(t, least)])
