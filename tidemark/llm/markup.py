"""Markup residue in documents: a recurrent block labeller and the conversion to clean text.

A document is cut into leaves: its lines, and as one leaf each whatever is literal (code blocks,
comments, scripts, displayed formulas). A leaf carries its tag path (the open literal or element it
stands in), the notations that occur in it, and hashed words. A bidirectional LSTM in numpy reads the
whole sequence of leaves, so the language of the rest of the document decides what an ambiguous
notation is, and gives every leaf a probability for each markup language and element. Those above one
half are the leaf's labels, whatever notations were seen in it.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

LANGUAGES = ("html", "markdown", "wiki", "latex")
ELEMENTS = ("heading", "list", "code_block", "formula", "inline")
LABELS = [(a, b) for a in LANGUAGES for b in ELEMENTS]
LABEL_NO = {x: i for i, x in enumerate(LABELS)}
WEIGHTS = Path(__file__).with_name("markup_weights.npz")

# Element names of HTML, and those that only wikis know.
HTML_NAMES = (
    "a abbr address article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup "
    "data del details dfn dialog div em embed fieldset figcaption figure font footer form frame head header hr html i iframe img "
    "input ins kbd label legend link main map mark meta nav noscript object optgroup option output p picture q rp rt ruby s samp "
    "section select small span strike strong sub summary sup svg table tbody td template textarea tfoot th thead time title tr tt u var video wbr"
)
WIKI_NAMES = "ref references syntaxhighlight source nowiki gallery poem noinclude includeonly onlyinclude templatestyles"



class AnyOf:
    """Alternatives as (needle, pattern): a pattern is only tried where its needle stands. Patterns begin
    with what they look for and look behind afterwards, which lets the matcher skip to it."""

    def __init__(self, *parts: tuple[str, str], flags: int = 0):
        self.parts = [(needle, re.compile(p, flags)) for needle, p in parts]

    def search(self, text: str) -> bool:
        return any(needle in text and p.search(text) is not None for needle, p in self.parts)


#: *x* and _x_, which Markdown and one kind of wiki share.
_STAR = ("*", r"\*(?<![\w*\\]\*)(?=[^\s*])[^*\n]*(?<=[^\s*])\*(?![\w*])")
_LOW = ("_", r"_(?<![\w\\]_)(?=[^\s_])[^_\n]*(?<=[^\s_])_(?!\w)")

_names = "|".join(HTML_NAMES.split())
#: (language, element, pattern) of notations within a line of text.
CUES = [
    ("html", "heading", re.compile(r"</?h[1-6](?=[\s>/])", re.I)),
    ("html", "list", re.compile(r"</?(?:ul|ol|li|dl|dt|dd|menu)(?=[\s>/])", re.I)),
    ("html", "inline", re.compile(rf"</?(?:{_names})(?=[\s>/]|$)|&(?:#\d{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|[A-Za-z]{{2,8}}\d?);|<!doctype\b", re.I)),
    ("markdown", "heading", re.compile(r"^\s{0,3}#{1,6}[ \t]+\S")),
    ("markdown", "list", re.compile(r"^\s*(?:[-+*]|\d{1,9}[.)])[ \t]+\S")),
    ("markdown", "inline", AnyOf(
        ("**", r"\*\*(?<![\w*\\]\*\*)(?=[^\s*])[^*\n]*(?<=[^\s*])\*\*(?![\w*])"), ("__", r"__(?<![\w\\]__)(?=[^\s_])[^\n]*?(?<=[^\s_])__(?!\w)"), _STAR, _LOW,
        ("~~", r"~~(?=\S)[^~\n]+(?<=\S)~~"), ("`", r"(?<!`)(`+)(?=[^`\s])[^`\n]*(?<=[^`\s])\1(?![`'])"), ("](", r"\[[^\[\]\n]*\]\([^\s)]"),
        ("][", r"\[(?<![\w\]]\[)[^\[\]\n]+\]\[[^\[\]\n]*\]"), ("]:", r"^\s{0,3}\[[^\[\]\n]+\]:\s*\S"), (">", r"^\s{0,3}>\s"), ("[^", r"\[\^\w+\]"), ("<", r"<(?:https?|mailto|ftp):[^>\s]+>"),
        ("|", r"^\s*\|.*\|\s*$"), ("**", r"^\s{0,3}\*\*\*[\s*]*$"), ("* *", r"^\s{0,3}\* \* \*[\s*]*$"), ("--", r"^\s{0,3}---[\s-]*$"), ("- -", r"^\s{0,3}- - -[\s-]*$"), ("__", r"^\s{0,3}___[\s_]*$"))),
    ("wiki", "heading", re.compile(r"^(={1,6})\s*[^=\s](?:[^\n]*?[^=\s])?\s*\1\s*$|^h[1-6]\.\s+\S")),
    ("wiki", "list", re.compile(r"^(?!\*[^\s*][^*\n]*\*(?!\w))(?:(?:[*#]+[:;]*|[:;]+)[ \t]*[^\s*#]|[*#]+[ \t]+[*#]\S)")),
    ("wiki", "inline", AnyOf(
        ("''", r"'''?(?=[^'\s])"), ("[[", r"\[\[[^\[\]\n]+\]\]"), ("{{", r"\{\{[^{}\n]+\}\}"), ("[", r"\[(?<!\w\[)(?:https?|ftp|mailto):[^\s\]|]+(?:\s[^\]\n]*)?\](?!\()"), ("|", r"\[[^\[\]|\n]+\|[^\[\]\n]+\](?!\()"),
        ("{", r"\{(?:color(?::[^}\n]*)?|(?:quote|panel|info|note|tip|warning|anchor|toc)(?::[^}\n]*)?)\}"), ("<", rf"</?(?:{'|'.join(WIKI_NAMES.split())})(?=[\s>/])"), ("{|", r"^\{\|"), ("|", r"^\|[-}+]"), ("!!", r"^!.*!!"),
        ("||", r"^\|.*\|\|"), ("__", r"__[A-Z]{3,}__"), _STAR, _LOW)),
    ("latex", "heading", re.compile(r"\\(?:part|chapter|(?:sub)*section|(?:sub)?paragraph)\*?\s*[\[{]")),
    ("latex", "list", re.compile(r"\\(?:begin|end)\{(?:itemize|enumerate|description)\}|\\item(?![A-Za-z])")),
    ("latex", "formula", re.compile(r"(?<![\\$\w])\$(?=[^\s$])[^$\n]*(?<=[^\s\\$])\$(?![\d$])|\\\((?:[^\n]*?)\\\)")),
    ("latex", "inline", re.compile(r"\\(?!(?:part|chapter|(?:sub)*section|(?:sub)?paragraph)\*?\s*[\[{]|(?:begin|end)\{(?:itemize|enumerate|description)\}|item(?![A-Za-z]))[a-z]{2,}\*?(?=[\[{])|\\[_%&#$](?=\w|\s|$)|``[^`'\n]+''|(?<=\S)~(?=\\)|(?:^|\s)% \S|\\(?:LaTeX|TeX|ldots|noindent|par|maketitle|newpage|centering)(?![A-Za-z])")),
]
#: What only one language has: counted over the document as features and, in training, as evidence.
SIGNS = [
    ("html", re.compile(r"</?(?:p|h[1-6]|ul|ol|li|div|span|a|b|em|code|table|td|tr)(?=[\s>/])", re.I)),
    ("markdown", AnyOf(
        ("##", r"^\s{0,3}#{2,6}[ \t]+\S"), ("](", r"\]\([^\s)]"), ("**", r"\*\*(?<![\w*]\*\*)(?=[^\s*])[^*\n]+\*\*(?!\w)"), ("`", r"`(?<![\w`]`)[^`\n]+`(?![`'])"), ("~~", r"~~\S"), ("> ", r"^\s{0,3}>\s"), ("![", r"!\["),
        ("- ", r"^\s*-\s+\S"), ("+ ", r"^\s*\+\s+\S"), (". ", r"^\s*\d+\.\s+\S"), (") ", r"^\s*\d+\)\s+\S"), ("__", r"__(?<!\w__)[^\W_](?:\w*[^\W_])?__(?!\w)"), ("]:", r"^\[\d+\]:"))),
    ("wiki", AnyOf(
        ("==", r"^={2,6}\s*[^=\n]+={2,6}\s*$"), ("h", r"^h[1-6]\.\s"), ("''", r"'''?\w"), ("[[", r"\[\["), ("{{", r"\{\{"), ("{|", r"^\{\|"), ("{c", r"\{color"), ("<", r"<(?:ref|syntaxhighlight|math)\b"),
        ("[http", r"\[(?<!\w\[)https?:\S+ "), ("|http", r"\[[^\[\]|\n]+\|https?:"))),
    ("latex", re.compile(r"\\(?:begin|end|(?:sub)*section|textbf|textit|emph|texttt|footnote|cite|ref|item|label)\b|\\_|``[^`'\n]+''")),
]
#: Characters without which a notation cannot occur, in the order of CUES and SIGNS.
CUE_HINTS = ["<", "<", "<&", "#", None, None, "=.", "*#:;", None, "\\", "\\", "$\\", "\\`%"]
SIGN_HINTS = ["<", None, None, "\\`"]
_special = re.compile(r"[<&\\$*_`\[\]{}#=|~'>^%+-]|\s*\d{1,9}[.)]\s|h[1-6]\.|[:;]")

OPENERS = [
    # (kind, opener, closer made from the match, labels)
    ("html:pre", re.compile(r"<pre(?=[\s>])[^>]*>?", re.I), lambda m: re.compile(r"</pre\s*>", re.I), [("html", "code_block")]),
    ("html:script", re.compile(r"<(script|style)(?=[\s>])[^>]*>?", re.I), lambda m: re.compile(rf"</{m[1]}\s*>", re.I), [("html", "inline")]),
    ("html:comment", re.compile(r"<!--"), lambda m: re.compile(r"-->"), [("html", "inline")]),
    ("wiki:code", re.compile(r"<(syntaxhighlight|source)(?=[\s>])[^>]*>?", re.I), lambda m: re.compile(rf"</{m[1]}\s*>", re.I), [("wiki", "code_block")]),
    ("wiki:nowiki", re.compile(r"<nowiki>", re.I), lambda m: re.compile(r"</nowiki>", re.I), [("wiki", "inline")]),
    ("wiki:block", re.compile(r"\{(code|noformat)(?::[^}\n]*)?\}"), lambda m: re.compile(rf"\{{{m[1]}\}}"), [("wiki", "code_block")]),
    ("latex:code", re.compile(r"\\begin\{(verbatim\*?|lstlisting|minted|Verbatim)\}"), lambda m: re.compile(rf"\\end\{{{re.escape(m[1])}\}}"), [("latex", "code_block")]),
    ("latex:math", re.compile(r"\\begin\{((?:equation|align|gather|multline|eqnarray|displaymath|math)\*?)\}"), lambda m: re.compile(rf"\\end\{{{re.escape(m[1])}\}}"), [("latex", "formula")]),
    ("latex:display", re.compile(r"(?<!\\)\\\["), lambda m: re.compile(r"\\\]"), [("latex", "formula")]),
    ("latex:dollars", re.compile(r"(?<!\\)\$\$"), lambda m: re.compile(r"\$\$"), [("latex", "formula")]),
    ("latex:tag", re.compile(r"<math(?=[\s>])[^>]*>", re.I), lambda m: re.compile(r"</math\s*>", re.I), [("latex", "formula")]),
]
_opener_hint = re.compile(r"<(?:pre|script|style|!--|syntaxhighlight|source|nowiki|math)|\{(?:code|noformat)|\\begin\{|\\\[|\$\$", re.I)
_fence = re.compile(r"^\s{0,3}(`{3,}|~{3,})\s*[\w+#.-]*\s*$")
_closing_tag = re.compile(r"</(pre)\s*>|</(syntaxhighlight|source)\s*>|\\end\{(verbatim\*?|lstlisting)\}", re.I)
_indented = re.compile(r"^(?: {4}|\t)\s*\S")
_setext = re.compile(r"^(?:=+|-{2,})\s*$")
KINDS = ["text", "blank", "fence", "indent", "setext"] + [o[0] for o in OPENERS]


@dataclass
class Leaf:
    kind: str
    text: str
    can: set = field(default_factory=set)  # labels whose notation occurs in the leaf


def leaves(text: str) -> list[Leaf]:
    """The leaves of a document, in order."""
    out: list[Leaf] = []
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    literal = None  # (leaf, closer)
    fence = None
    for line in lines:
        if fence:
            leaf, mark = fence
            leaf.text += "\n" + line
            s = line.strip()
            if s and s[0] == mark[0] and len(s) >= len(mark) and not s.strip(mark[0]):
                fence = None
            continue
        if literal is None:
            m = _fence.match(line)
            if m:
                leaf = Leaf("fence", line, {("markdown", "code_block")})
                out.append(leaf)
                fence = leaf, m[1]
                continue
        rest = line
        started = False
        while True:
            if literal is not None:
                leaf, closer = literal
                m = closer.search(rest)
                leaf.text += ("" if started else "\n") + (rest[: m.end()] if m else rest)
                if not m:
                    break
                literal, rest, started = None, rest[m.end() :], True
                if not rest.strip():
                    break
                continue
            best = None
            if _opener_hint.search(rest):
                for kind, opener, close, labels in OPENERS:
                    m = opener.search(rest)
                    if m and (best is None or m.start() < best[0].start()):
                        best = m, kind, close, labels
            if best is None:
                out.append(_text_leaf(rest, out, started))
                break
            m, kind, close, labels = best
            if rest[: m.start()].strip():
                out.append(_text_leaf(rest[: m.start()], out, started))
            leaf = Leaf(kind, m[0], set(labels))
            out.append(leaf)
            literal, rest, started = (leaf, close(m)), rest[m.end() :], True
    return _mark_indented(out)


def _text_leaf(line: str, before: list[Leaf], started: bool) -> Leaf:
    if not line.strip():
        return Leaf("blank", line)
    leaf = Leaf("text", line)
    if _special.search(line) is None:
        return leaf
    if _setext.match(line) and before and before[-1].kind == "text" and ("markdown", "list") not in before[-1].can:
        leaf.kind = "setext"
        leaf.can.add(("markdown", "heading"))
        return leaf
    chars = set(line)
    for (language, element, pattern), hints in zip(CUES, CUE_HINTS):
        if (hints is None or not chars.isdisjoint(hints)) and pattern.search(line):
            leaf.can.add((language, element))
    if ("latex", "formula") in leaf.can:  # what stands in a formula is nothing else
        bare = CUES_FORMULA.sub(" ", line)
        leaf.can = {("latex", "formula")} | {(a, b) for a, b, p in CUES if p.search(bare) and (a, b) != ("latex", "formula")}
    return leaf


CUES_FORMULA = next(p for a, b, p in CUES if (a, b) == ("latex", "formula"))


def _mark_indented(found: list[Leaf]) -> list[Leaf]:
    """Joins indented lines that follow a blank line (or begin the text) to one leaf."""
    out: list[Leaf] = []
    in_list = False
    for leaf in found:
        last = out[-1] if out else None
        if leaf.kind == "text" and _indented.match(leaf.text):
            if last is not None and last.kind == "indent":
                last.text += "\n" + leaf.text
                continue
            if (last is None or last.kind == "blank") and not in_list:
                out.append(Leaf("indent", leaf.text, {("markdown", "code_block")}))
                continue
        if leaf.kind == "blank" and last is not None and last.kind == "indent":
            last.text += "\n" + leaf.text
            continue
        if leaf.kind != "blank":
            in_list = leaf.kind == "text" and (bool({("markdown", "list"), ("wiki", "list")} & leaf.can) or (in_list and leaf.text[:1] in " \t"))
        if last is not None and last.kind == "indent" and last.text.endswith("\n"):
            pass
        out.append(leaf)
    return out


# ---------------------------------------------------------------- features

N_WORDS = 48
N_CUES = len(LABELS)
N_SIGNS = len(SIGNS)
#: Pairs of languages of which a leaf sees which has more signs in the document.
RIVALS = [(a, b) for a in range(N_SIGNS) for b in range(a)]
N_FEATURES = len(KINDS) + N_CUES + 3 * N_SIGNS + len(RIVALS) + 5 + N_WORDS
_kind_no = {k: i for i, k in enumerate(KINDS)}
_word = re.compile(r"[A-Za-z]{2,}")
_hash_cache: dict[str, int] = {}


def _bucket(w: str) -> int:
    h = _hash_cache.get(w)
    if h is None:
        if len(_hash_cache) > 200_000:
            _hash_cache.clear()
        h = _hash_cache[w] = zlib.crc32(w.encode()) % N_WORDS
    return h


def features(found: list[Leaf]) -> np.ndarray:
    """One row per leaf: tag path, notations that occur, signs of each language here and in the whole
    document (shares, logarithms, which of two has more), position, all words hashed."""
    x = np.zeros((len(found), N_FEATURES), np.float32)
    k0 = len(KINDS)
    s0 = k0 + N_CUES
    p0 = s0 + 3 * N_SIGNS + len(RIVALS)
    w0 = p0 + 5
    total = np.zeros(N_SIGNS, np.float32)
    hits_row: list[int] = []
    hits_word: list[int] = []
    hits_weight: list[float] = []
    for i, leaf in enumerate(found):
        row = x[i]
        row[_kind_no[leaf.kind]] = 1
        for c in leaf.can:
            row[k0 + LABEL_NO[c]] = 1
        t = leaf.text
        if leaf.kind == "text" and leaf.can:
            chars = set(t)
            for j, (_, p) in enumerate(SIGNS):
                if (SIGN_HINTS[j] is None or not chars.isdisjoint(SIGN_HINTS[j])) and p.search(t):
                    row[s0 + j] = 1
                    total[j] += 1
        elif leaf.kind == "fence":
            total[1] += 1
        elif leaf.kind.startswith("html:"):
            total[0] += 1
        elif leaf.kind.startswith("wiki:"):
            total[2] += 1
        elif leaf.kind.startswith("latex:code"):
            total[3] += 1
        row[p0] = i == 0
        row[p0 + 1] = i == len(found) - 1
        row[p0 + 2] = min(len(t), 400) / 400
        row[p0 + 3] = t[:1] in " \t"
        row[p0 + 4] = i > 0 and found[i - 1].kind == "blank"
        words = _word.findall(t.lower())
        hits_row += [i] * len(words)
        hits_word += map(_bucket, words)
        hits_weight += [4 / max(16, len(words))] * len(words)  # a long leaf weighs no more than 16 words
    if hits_row:
        np.add.at(x, (hits_row, np.add(hits_word, w0)), np.array(hits_weight, np.float32))
    more = [np.sign(total[a] - total[b]) for a, b in RIVALS]
    x[:, s0 + N_SIGNS : p0] = np.concatenate([total / max(1, total.sum()), np.log1p(total) / 4, more])
    return x


# ---------------------------------------------------------------- the network


def _sigmoid(z):
    return 0.5 * (np.tanh(0.5 * z) + 1)


class Network:
    """Bidirectional LSTM with one sigmoid per label. Parameters: ``W, U, b`` per direction, ``V, c``."""

    def __init__(self, parameters: dict[str, np.ndarray]):
        self.p = {k: np.ascontiguousarray(v, np.float32) for k, v in parameters.items()}
        self.hidden = self.p["Uf"].shape[0]

    @classmethod
    def load(cls, path: Path = WEIGHTS) -> "Network":
        with np.load(path) as z:
            return cls({k: z[k] for k in z.files})

    def _direction(self, x, mask, d):
        """Hidden states over (time, batch); padded steps keep the state."""
        t, n, _ = x.shape
        h, c, hs = np.zeros((n, self.hidden), np.float32), np.zeros((n, self.hidden), np.float32), []
        pre = x.reshape(t * n, -1) @ self.p["W" + d] + self.p["b" + d]
        pre = pre.reshape(t, n, -1)
        k = self.hidden
        out = np.empty((t, n, k), np.float32)
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            z = pre[s] + h @ self.p["U" + d]
            g = _sigmoid(z[:, : 3 * k])
            new = g[:, k : 2 * k] * c + g[:, :k] * np.tanh(z[:, 3 * k :])
            m = mask[s][:, None]
            c = np.where(m, new, c)
            h = np.where(m, g[:, 2 * k :] * np.tanh(new), h)
            out[s] = h
        return out

    def probabilities(self, batch: list[np.ndarray]) -> list[np.ndarray]:
        """Label probabilities for each document's leaves."""
        n, t = len(batch), max(map(len, batch))
        x, mask = np.zeros((t, n, N_FEATURES), np.float32), np.zeros((t, n), bool)
        for i, f in enumerate(batch):
            x[: len(f), i], mask[: len(f), i] = f, True
        h = np.concatenate([self._direction(x, mask, "f"), self._direction(x, mask, "b")], axis=2)
        y = _sigmoid(h @ self.p["V"] + x @ self.p["S"] + self.p["c"])
        return [y[: len(f), i] for i, f in enumerate(batch)]


#: Leaves that one batch of the network takes, padding included; longer documents are batches of their own.
BATCH_LEAVES = 4096


def label(net: Network, documents: list[list[Leaf]]) -> list[list[set]]:
    """The labels of every leaf of every document, each document read as a whole."""
    out = [[set() for _ in found] for found in documents]
    jobs = sorted(((i, features(found)) for i, found in enumerate(documents) if found), key=lambda j: len(j[1]))
    at = 0
    while at < len(jobs):
        end = at + 1
        while end < len(jobs) and (end + 1 - at) * len(jobs[end][1]) <= BATCH_LEAVES:
            end += 1
        for (i, _), p in zip(jobs[at:end], net.probabilities([f for _, f in jobs[at:end]])):
            for leaf, j in zip(*np.nonzero(p > 0.5)):
                if documents[i][leaf].kind != "blank":
                    out[i][leaf].add(LABELS[j])
        at = end
    return out


# ---------------------------------------------------------------- clean text

_tag = re.compile(r"</?[A-Za-z][^<>]*>")
_entity = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]{2,8}\d?);")


def _strip_inline(t: str, labels: set) -> str:
    import html

    if any(a == "html" for a, _ in labels):
        t = html.unescape(_tag.sub("", t)).replace("\xa0", " ")
    if ("wiki", "inline") in labels:
        t = re.sub(r"<ref[^>]*>.*?</ref>|<ref[^>]*/>|\{\{cite[^{}]*\}\}|\{color[^}]*\}|^\{\|.*|^\|[-}].*", "", t)
        t = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]", r"\1", t)
        t = re.sub(r"\[https?:\S+\s+([^\]]*)\]", r"\1", t)
        t = re.sub(r"\[([^\[\]|]+)\|[^\]]+\]", r"\1", t)
        t = re.sub(r"\{\{([^{}]*)\}\}", r"\1", t)
        t = re.sub(r"'{2,5}", "", t)
        t = re.sub(r"(?<!\w)([*_])(?=\S)([^*_]+)(?<=\S)\1(?!\w)", r"\2", t)
    if ("markdown", "inline") in labels:
        t = re.sub(r"!?\[([^\[\]]*)\](?:\([^)]*\)|\[[^\]]*\])", r"\1", t)
        t = re.sub(r"^\s{0,3}>\s?", "", t)
        t = re.sub(r"(?<!\w)(\*\*|__|~~|\*|_)(?=\S)(.+?)(?<=\S)\1(?!\w)", r"\2", t)
        t = re.sub(r"(?<!`)(`+)([^`]+)\1(?!`)", r"\2", t)
    if ("latex", "inline") in labels:
        t = re.sub(r"(?:^|\s)% .*$", "", t)
        t = re.sub(r"~?\\(?:cite|ref|label|footnote)\{[^{}]*\}", "", t)
        t = re.sub(r"\\[a-z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"\1", t)
        t = re.sub(r"``([^`']*)''", r'"\1"', t)
        t = re.sub(r"\\([_%&#$])", r"\1", t)
    return t


def clean(found: list[Leaf], labels: list[set]) -> str:
    """Plain text with headings (#), list items (-), fenced code and formulas ($) kept; leaves without
    markup are left as they are."""
    out, n = [], 0
    for leaf, own in zip(found, labels):
        elements = {b for _, b in own}
        t = leaf.text
        if not own:
            out.append(t)
        elif "code_block" in elements:
            body = re.sub(r"^\s*(?:<(?:pre|syntaxhighlight|source|code)[^>]*>|\{(?:code|noformat)[^}]*\}|\\begin\{\w+\*?\}|(?:`{3,}|~{3,})[^\n]*\n?)+|(?:</(?:pre|syntaxhighlight|source|code)>|\{(?:code|noformat)\}|\\end\{\w+\*?\}|\n\s*(?:`{3,}|~{3,}))+\s*$", "", t, flags=re.I)
            out.append("```\n" + body.strip("\n") + "\n```")
        elif leaf.kind.startswith("latex:"):
            out.append("$" + re.sub(r"^(?:\\begin\{\w+\*?\}|\\\[|\$\$|<math[^>]*>)|(?:\\end\{\w+\*?\}|\\\]|\$\$|</math>)$", "", t.strip()).strip() + "$")
        elif leaf.kind.startswith(("html:", "wiki:nowiki")):
            continue
        elif leaf.kind == "setext":
            if out:
                out[-1] = ("# " if t[0] == "=" else "## ") + out[-1].strip()
        else:
            level = 0
            if "heading" in elements:
                m = re.search(r"<h([1-6])", t, re.I) or re.match(r"h([1-6])\.", t)
                level = int(m[1]) if m else len(re.match(r"\s*([#=]*)", t)[1]) or 1 + t.count("sub")
                t = re.sub(r"^\s*(?:#+|h[1-6]\.|=+)\s*|\s*[#=]+\s*$|\\(?:part|chapter|(?:sub)*section|paragraph)\*?\{|\}\s*$", "", t)
            item = "list" in elements
            if item:
                n = len(re.match(r"\s*", t)[0])
                t = re.sub(r"^\s*(?:[-+*#:;]+|\d+[.)])\s+|\\item\s*|\\(?:begin|end)\{\w+\}", "", t)
            t = _strip_inline(t, own | ({("html", "inline")} if ("html", "heading") in own or ("html", "list") in own else set())).strip()
            if t:
                out.append("#" * level + " " * bool(level) + (" " * n + "- " if item else "") + t)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip("\n")


# ---------------------------------------------------------------- the operator

_net: list[Network] = []


def network() -> Network:
    if not _net:
        _net.append(Network.load())
    return _net[0]


def read_markup(df: DataFrame, id_col: str, text_col: str, with_text: bool = False) -> DataFrame:
    """``id, found, n_leaves`` (and ``clean``) per row; ``found`` is an array of (markup, element).

    Null and empty texts have no markup and null or empty clean text. Repeated rows are read one by
    one; extra columns are ignored. Texts are read whole, however long. Every row is read where it
    lies; nothing is shuffled.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, found array<struct<markup:string,element:string>>, n_leaves int" + ", clean string" * with_text

    def run(batches):
        net = network()
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo : lo + 256]
                docs = [leaves(t) if t else [] for t in part["text"]]
                labels = label(net, docs)
                out = {"id": part["id"].to_numpy(), "found": [[{"markup": a, "element": b} for a, b in sorted(set().union(*x))] if x else [] for x in labels], "n_leaves": np.array([len(d) for d in docs], np.int32)}
                if with_text:
                    out["clean"] = [None if t is None else clean(d, x) if d else "" for t, d, x in zip(part["text"], docs, labels)]
                yield pd.DataFrame(out)

    return rows.mapInPandas(run, schema)
