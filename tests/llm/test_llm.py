"""Operators on training data against brute force, round trips and edge cases."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import leaks, markup, markup_train, mixing, neardup, neighbours, queries, repetition
from tidemark.llm.neighbours import Neighbours
from tidemark.llm.splitting import Splitter, split_oversized

WORDS = "index query vector ledger shard token merge split cache route hash graph chunk label scan trace bloom quota fence probe".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


# ---------------------------------------------------------------- 1


def nearest(ids, x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 12)
    np.fill_diagonal(s, -9)
    return {(ids[i], ids[j]) for i in range(len(ids)) for j in sorted(range(len(ids)), key=lambda j: (-s[i, j], ids[j]))[:k] if i != j}


@pytest.mark.parametrize("cell_rows", [10_000, 90])
def test_neighbours_brute(spark, monkeypatch, cell_rows):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(0, 30, 1500)] + 0.3 * rng.normal(size=(1500, 16))).astype(np.float32)
    x[100:140] = x[100]  # a large group of copies
    x[700] = 3 * x[701]
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(1500) * 3, "v": x.tolist(), "other": 1, "list": "x"}), "id bigint, v array<float>, other int, list string")
    want = nearest([int(i) * 3 for i in range(1500)], x.astype(np.float64), 4)
    monkeypatch.setattr(neighbours, "CELL_ROWS", cell_rows)
    found = Neighbours(df, "id", "v", dims=16, k=4, cell_size=200, list_size=50)
    assert found.cells == 7 and (found.parts.max() > 1) == (cell_rows < 200)
    pairs = [(r.id, r.other) for r in found.top().collect()]
    assert len(pairs) == len(set(pairs)) == len(want) and len(want.intersection(pairs)) / len(want) > 0.97


def test_neighbours_all_alike(spark):
    """One group of copies: each has the smallest other ids; with one more vector that comes in too."""
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)] + [(20, [2.0, 4.0]), (30, [2.0, 1.0])], "id bigint, v array<double>")
    got = {(r.id, r.other, r.place) for r in Neighbours(df, "id", "v", dims=2, k=2).top().collect()}
    assert got == {(i, o, n) for i in [*range(9), 20, 30] for n, o in enumerate([x for x in range(4) if x != i][:2], 1)}


def test_neighbours_unusable(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0]), (8, []), (9, [None, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<float>")
    assert {(r.id, r.other, r.place) for r in Neighbours(df, "id", "v", dims=2).top().collect()} == {(1, 2, 1), (2, 1, 1)}
    assert Neighbours(df.limit(0), "id", "v", dims=2).top().count() == 0


# ---------------------------------------------------------------- 3

CASES = [
    ("Plain words, 3 < 4 and 5 > 2, a List<Thing> of snake_case_names costs $6 to $7, arr[0][1].", set()),
    ("## Head\n\nSome *soft* text.\n\n- one\n- two\n\n```python\n# no heading\nx = '<p>'\n```\n", {("markdown", "heading"), ("markdown", "inline"), ("markdown", "list"), ("markdown", "code_block")}),
    ("<h2>Head</h2>\n<p>Text &amp; <b>more</b></p>\n<ul><li>x</li></ul>\n<pre># literal ''x''</pre>", {("html", "heading"), ("html", "inline"), ("html", "list"), ("html", "code_block")}),
    ("== Head ==\n\nA '''bold''' [[link|word]].\n\n* one\n* two\n\n<syntaxhighlight lang=\"go\">\n## x\n</syntaxhighlight>", {("wiki", "heading"), ("wiki", "inline"), ("wiki", "list"), ("wiki", "code_block")}),
    ("h2. Head\n\nText with {{mono}} and [word|https://x.example/].\n\n# one\n# two\n\n{code:go}\nx := 1\n{code}", {("wiki", "heading"), ("wiki", "inline"), ("wiki", "list"), ("wiki", "code_block")}),
    ("\\section{Head}\n\nAn \\emph{odd} word, $a^2 \\le b$.\n\n\\begin{itemize}\n  \\item one\n\\end{itemize}\n\n\\begin{verbatim}\n- x\n\\end{verbatim}", {("latex", "heading"), ("latex", "inline"), ("latex", "list"), ("latex", "code_block"), ("latex", "formula")}),
    ("* one\n* two", {("markdown", "list")}),
    ("Here <math>\\alpha</math> stands.", {("latex", "formula")}),
    ("Title here\n==========\n\nText.", {("markdown", "heading")}),
    ("", set()),
    ("\n\n", set()),
]


def test_markup_cases():
    net = markup.network()
    docs = [markup.leaves(t) for t, _ in CASES]
    for (text, want), got in zip(CASES, markup.label(net, docs)):
        assert (set().union(*got) if got else set()) == want, text


def test_markup_held_out():
    """Documents put together from parts the network has not seen, in random order."""
    rng = random.Random(5)
    parts = {
        "markdown": [lambda: f"### {prose(rng, 3)}", lambda: f"- {prose(rng, 4)}\n- **{prose(rng, 1)}** x", lambda: f"{prose(rng, 6)} [a](http://b.example/c) {prose(rng, 3)}", lambda: f"```\n{prose(rng, 9)}\n```"],
        "html": [lambda: f"<h3>{prose(rng, 3)}</h3>", lambda: f"<ol><li>{prose(rng, 4)}</li></ol>", lambda: f"<p>{prose(rng, 6)} <em>{prose(rng, 1)}</em></p>", lambda: f"<pre>{prose(rng, 9)}</pre>"],
        "wiki": [lambda: f"=== {prose(rng, 3)} ===", lambda: f"* {prose(rng, 4)}\n* [[{prose(rng, 1)}]]", lambda: f"{prose(rng, 6)} '''{prose(rng, 1)}''' {prose(rng, 3)}", lambda: f"<syntaxhighlight>\n{prose(rng, 9)}\n</syntaxhighlight>"],
        "latex": [lambda: f"\\subsection{{{prose(rng, 3)}}}", lambda: f"\\begin{{itemize}}\n\\item {prose(rng, 4)}\n\\end{{itemize}}", lambda: f"{prose(rng, 6)} \\textbf{{{prose(rng, 1)}}}", lambda: f"\\begin{{verbatim}}\n{prose(rng, 9)}\n\\end{{verbatim}}"],
    }
    names = ["heading", "list", "inline", "code_block"]
    docs, want = [], []
    for _ in range(200):
        lang = rng.choice(list(parts))
        use = sorted(rng.sample(range(4), rng.randrange(1, 5)), key=lambda _: rng.random())
        blocks = [parts[lang][i]() for i in use] + [prose(rng, 12) for _ in range(2)]
        rng.shuffle(blocks)
        docs.append(markup.leaves("\n\n".join(blocks)))
        want.append({(lang, names[i]) for i in use})
    got = [set().union(*x) for x in markup.label(markup.network(), docs)]
    # lists of wikis and Markdown look alike where nothing else tells them apart; inline parts of list items count, too
    alike = np.mean([a >= {x for x in b if x[1] in ("heading", "code_block")} for a, b in zip(got, want)])
    assert alike > 0.97


def test_markup_features_see_whole_leaves_and_counts():
    w0 = markup.N_FEATURES - markup.N_WORDS
    start = "word " * 60
    a, b = (markup.features(markup.leaves(start + end))[0] for end in ("begin apply route", "alpha quota zebra"))
    assert (a[w0:] != b[w0:]).any() and abs(a[w0:].sum() - 4) < 1e-3 and abs(b[w0:].sum() - 4) < 1e-3
    a, b = (markup.features(markup.leaves(MD_LINE * n + WIKI_LINE * (16 - n)))[-1] for n in (5, 11))
    here = slice(len(markup.KINDS) + markup.N_CUES + markup.N_SIGNS, w0 - 5)
    assert (a[here] != b[here]).any()


MD_LINE = "See [a](http://b.example/c) and **b** here.\n\n"
WIKI_LINE = "See '''a''' and [[b|c]] here.\n\n"


@pytest.mark.parametrize("n_md", [5, 7, 9, 11])
def test_markup_shared_notation_goes_to_the_greater_part(n_md):
    for text in (MD_LINE * n_md + WIKI_LINE * (16 - n_md), WIKI_LINE * (16 - n_md) + MD_LINE * n_md):
        doc = markup.leaves(text + "* one\n* two")
        (got,) = markup.label(markup.network(), [doc])
        assert {x for x in set().union(*got) if x[1] == "list"} == {("markdown" if n_md > 8 else "wiki", "list")}


def test_markup_clean_and_operator(spark):
    text = "## Head\r\n\r\nA **bold** word and `code`.\r\n\r\n- one\r\n- two\r\n\r\n```\r\nx = 1\r\n```"
    df = spark.createDataFrame([(1, text, "a"), (2, None, "b"), (3, "", "c"), (4, text, "d"), (5, "x " * 200_000, "e")], "id bigint, body string, found string")
    got = {r.id: r for r in markup.read_markup(df, "id", "body", True).collect()}
    assert len(got) == 5 and got[2].found == [] and got[2].clean is None and got[3].clean == "" and got[5].found == []
    assert got[1].clean == "## Head\n\nA bold word and code.\n\n- one\n- two\n\n```\nx = 1\n```"
    assert got[1].found == got[4].found
    assert markup.read_markup(df.limit(0), "id", "body").count() == 0


def test_markup_long_documents():
    text = "\n".join(["## Head " + str(i) if i % 50 == 0 else "some words here" for i in range(9000)])
    (labels,) = markup.label(markup.network(), [markup.leaves(text)])
    assert len(labels) == 9000 and sum(("markdown", "heading") in x for x in labels) == 180


def test_labeller_learns():
    docs = [(d, markup_train.weak_labels(d)) for d in (markup.leaves(t) for t, _ in CASES if t.strip())] * 6
    p = markup_train.fit(markup_train.rows_of(docs), rounds=12, log=lambda _: None)
    assert markup_train.agreement(markup.Network(p), docs)[2] > 0.9


def test_labeller_on_injected_markup():
    """Held-out accuracy: labels known since the markup was put in; every leaf's label comes from its
    probabilities alone."""
    rng = random.Random(4)
    texts = ["\n".join(" ".join(rng.choice(["quorum", "lantern", "drizzle", "pebble", "saddle", "walnut", "thicket"]) for _ in range(rng.randrange(3, 12))) for _ in range(20)) for _ in range(20)]
    docs = markup_train.injected(texts, 400, np.random.default_rng(9))
    alike, doc_precision, doc_recall, precision, recall = markup_train.agreement(markup.network(), docs)
    assert alike > 0.95 and min(doc_precision, doc_recall, precision, recall) > 0.98
    rules = [set().union(*markup_train.weak_labels(d)) == set().union(*y) for d, y in docs]
    assert alike >= np.mean(rules)


# ---------------------------------------------------------------- 4


def brute_pairs(texts, width=3, threshold=0.6, least=20):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\W_]+", t.lower()) if t else []
        if len(w) >= least:
            sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)}
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def edited_family(rng, n, size, edits):
    base = prose(rng, size).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], ["new" + str(rng.randrange(99))], [w[k], "more"]])
        out.append(" ".join(w))
    return out


def near_duplicate_table():
    rng = random.Random(1)
    texts = [prose(rng, rng.randrange(5, 60)) for _ in range(300)]
    for _ in range(25):
        texts += edited_family(rng, 6, 60, 8)
    texts += ["same text again " * 10] * 30 + [prose(rng, 40)] * 5 + ["", None, "too short"]
    rng.shuffle(texts)
    return {i * 7 + 1: t for i, t in enumerate(texts)}


def test_near_duplicates(spark):
    texts = near_duplicate_table()
    df = spark.createDataFrame([(i, t, 1, "b") for i, t in texts.items()], "id bigint, body string, a int, b string")
    want = brute_pairs(texts)
    nd = neardup.NearDuplicates(df, "id", "body")
    got = [(r.id_a, r.id_b) for r in nd.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(set(got)) >= 0.99 * len(want)
    degree = {}
    for a, b in got:
        degree[a] = degree.get(a, 0) + 1
        degree[b] = degree.get(b, 0) + 1
    classes = {r.id: (r.class_id, r.n_links) for r in nd.classes().collect()}
    assert {i: n for i, (_, n) in classes.items()} == degree
    assert all(classes[a][0] == classes[b][0] for a, b in got)


def test_near_duplicates_dense_family(spark):
    """A family larger than the dense limit goes through the second forest and the blocks."""
    rng = random.Random(3)
    texts = dict(enumerate(edited_family(rng, 150, 80, 4) + [prose(rng, 50) for _ in range(60)]))
    df = spark.createDataFrame(list(texts.items()), "id bigint, body string")
    got = {(r.id_a, r.id_b) for r in neardup.NearDuplicates(df, "id", "body", dense=20).pairs().collect()}
    assert got == brute_pairs(texts)


@pytest.mark.parametrize("second", [False, True])
@pytest.mark.parametrize("sizes", [(40, 500, 5), (40, 130, 1), (200,), (1,) * 160 + (3,), (150, 1)])
def test_near_duplicates_key_beyond_held(spark, monkeypatch, second, sizes):
    """Every row of a key that does not fit in memory is dense, wherever the flushes fall."""
    monkeypatch.setattr(neardup, "HELD", 100)
    depth, length = (neardup.DEPTH2, neardup.LABEL2) if second else (3, neardup.LABEL)
    cols = neardup._label_columns(0, length, second)
    rows = []
    for label, n in enumerate(sizes):
        for _ in range(n):
            sig = np.zeros(neardup.N_PERM, np.uint16)
            sig[cols[depth:]] = label
            rows.append((len(rows), 10, sig.tobytes()))
    few = len(rows)
    for other in range(1, 40):  # keys of two rows
        sig = np.full(neardup.N_PERM, other, np.uint16)
        rows += [(len(rows), 10, sig.tobytes()), (len(rows) + 1, 10, sig.tobytes())]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "60")
    try:
        got = neardup._forest(spark.createDataFrame(rows, "id bigint, n int, sig binary").coalesce(1), 0.6, depth, 1, length, 10, second).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    assert {r.a for r in got if r.dense} == set(range(few))
    assert {(r.a, r.b) for r in got if not r.dense and r.a >= few} == {(i, i + 1) for i in range(few, len(rows), 2)}


def test_forest_recall():
    """The depth and the tries that the recall asks for, against drawn pairs at the threshold."""
    assert neardup.depth_for(0.6, neardup.TREES, neardup.LABEL, 0.9975) == 3 and neardup.depth_for(0.6, 1, 5, 0.99) == 1
    rng, t = np.random.default_rng(5), 0.6
    trees = neardup.trees_for(t, neardup.DEPTH2, 0.99)
    cols = np.array([neardup._label_columns(k, neardup.LABEL2, True)[: neardup.DEPTH2] for k in range(trees)])
    agree = rng.random((4000, neardup.N_PERM)) < t
    assert abs(agree[:, cols].all(axis=2).any(axis=1).mean() - 0.99) < 0.006


def test_near_duplicates_empty(spark):
    df = spark.createDataFrame([], "id bigint, body string")
    nd = neardup.NearDuplicates(df, "id", "body")
    assert nd.pairs().count() == 0 and nd.classes().count() == 0


# ---------------------------------------------------------------- 5


def check_pieces(text, s):
    body = re.sub(r"(?:\r?\n)+\Z", "", text)
    p = s.pieces(text)
    if not body:
        assert p == []
        return p
    assert p[0][0] == 0 and p[-1][1] == len(body)
    for (a, b), (c, d) in zip(p, p[1:]):
        assert a <= c <= b < d, (a, b, c, d)
        if c != b and body[b - 1] == "\n" and c and body[c - 1] == "\n":
            assert body[c:b].count("\n") <= s.overlap_lines
        else:
            assert b - c <= s.overlap_chars
    for a, b in p:
        assert b - a <= s.max_chars and body[a:b].rstrip("\n").count("\n") < s.max_lines
    return p


def test_splitting_round_trip():
    rng = random.Random(8)
    s = Splitter()
    for _ in range(150):
        lines = [rng.choice(["", "# Head", "def f():", "    x = 1", prose(rng, rng.randrange(1, 30)), prose(rng, 400), "x" * rng.randrange(3000), "é漢" * 600]) for _ in range(rng.randrange(1, 160))]
        check_pieces(rng.choice(["\n", "\r\n"]).join(lines) + "\n" * rng.randrange(4), s)
    assert s.pieces("") == [] and s.pieces("\n\n") == [] and s.pieces("x") == [(0, 1)]
    with pytest.raises(ValueError):
        Splitter(overlap_lines=50)


def merged_one_by_one(s, text):
    """The pieces by scanning all boundaries for the weakest each time, without a heap."""
    text = text.rstrip("\n")
    atoms = s.atoms(text)
    start = [a[0] for a in atoms] + [len(text)]
    lines = np.cumsum([a[2] for a in atoms]) - 1
    line_start = [a[0] for a in atoms if a[2]]

    def lead(i):
        back = line_start[max(0, lines[i] - s.overlap_lines)]
        return back if atoms[i][2] and start[i] - back <= s.most else max(0, start[i] - s.overlap_chars)

    def fits(lo, hi):
        first = max(k for k in range(lo + 1) if start[k] <= lead(lo))
        return start[hi] - lead(lo) <= s.max_chars and lines[hi - 1] - lines[first] + 1 <= s.max_lines

    cuts = list(range(len(atoms) + 1))
    while True:
        open_ = [(atoms[cuts[k]][1], start[cuts[k + 1]] - start[cuts[k - 1]], cuts[k]) for k in range(1, len(cuts) - 1) if fits(cuts[k - 1], cuts[k + 1])]
        if not open_:
            return [(lead(a), start[b]) for a, b in zip(cuts[:-1], cuts[1:])]
        cuts.remove(min(open_)[2])


def test_splitting_against_merging_one_by_one():
    rng = random.Random(31)
    s = Splitter(max_chars=300, max_lines=8, overlap_lines=2, overlap_chars=40)
    for _ in range(40):
        lines = [rng.choice(["", "## Head", "def f():", "    x = 1", "```", prose(rng, 4), prose(rng, 9), prose(rng, 60), "a" * rng.randrange(1, 400)]) for _ in range(rng.randrange(9, 40))]
        text = "\n".join([*lines, "end"])
        assert s.pieces(text) == merged_one_by_one(s, text)


def test_splitting_prefers_headings():
    text = "\n".join(["## One"] + ["words words words"] * 30 + ["## Two"] + ["words words words"] * 30)
    pieces = [text[a:b] for a, b in Splitter().pieces(text)]
    assert len(pieces) == 2 and "## Two" in pieces[1][:60]


def test_splitting_operator(spark):
    rows = [(1, "a\n" * 60, 5, "x"), (2, "y" * 2001, None, "x"), (3, "b\r\n" * 49 + "b", 0, "x"), (4, None, 1, "x"), (5, "z" * 1990 + "\n" * 30, 1, "x"), (6, "", 1, "x"), (1, "a\n" * 60, 5, "x"), (7, "\n" * 3000, 2, "x")]
    df = spark.createDataFrame(rows, "id bigint, content string, start_line int, text string")
    got = split_oversized(df, "id", "content", "start_line").collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    assert set(by) == {1, 2, 5, 7} and {r.piece for r in by[1]} == {1, 2} and len(by[1]) == 4
    first, second = sorted(by[1][:2], key=lambda r: r.piece)
    assert (first.start_line, second.end_line) == (5, 64) and second.start_line == first.end_line - 1
    assert by[2][0].too_long and not by[2][0].too_many_lines and all(r.start_line == r.end_line == 1 for r in by[2])
    assert len(by[5]) == 1 and len(by[5][0].text) == 1990
    assert split_oversized(df.limit(0), "id", "content", "start_line").count() == 0


# ---------------------------------------------------------------- 8


def test_leaks(spark, monkeypatch):
    rng = random.Random(6)
    items = [(i, prose(rng, 30)) for i in range(20)] + [(50, "a b c d e f g h i j k l m"), (51, "too short"), (52, None), (53, ""), (None, prose(rng, 30))]
    docs = []
    for i in range(200):
        t = prose(rng, rng.randrange(1, 80)).split()
        if i % 3 == 0:
            words = items[rng.randrange(20)][1].split()
            n = rng.choice([11, 12, 14, 30])
            at = rng.randrange(len(words) - n + 1)
            part = words[at : at + n]
            if i % 2:
                part = [w.upper().replace("E", "é") + rng.choice([",", " -", "."]) for w in part]
            t[rng.randrange(len(t) + 1) :] = part
        docs.append((i, rng.choice(["", " "]) + " ".join(t)))
    docs += [(900, None), (901, ""), (902, "…!"), (903, "A-b.c.d e f-g h i j/k l"), (904, docs[0][1]), (905, "ﬁ" * 10_000)]
    want = set()
    for d, t in docs:
        for i, x in items:
            if i is not None and x and t and any(w in leaks.squeeze(t) for w in leaks.item_windows(x, 12)):
                want.add((d, i))
    assert (903, 50) in want and len(want) > 20
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(1))
    it = spark.createDataFrame(items, "item_id bigint, item_text string").withColumn("text", F.lit("x"))
    run = lambda **k: [tuple(r) for r in leaks.find_leaks(df, "doc_id", "text", it, "item_id", "item_text", **k).collect()]
    got = run()
    assert len(got) == len(set(got)) and set(got) == want
    monkeypatch.setattr(leaks, "BROADCAST_CHARS", 0)
    assert set(run()) == want
    assert leaks.find_leaks(df.limit(0), "doc_id", "text", it, "item_id", "item_text").count() == 0
    assert leaks.find_leaks(df, "doc_id", "text", it.limit(0), "item_id", "item_text").count() == 0


def test_leaks_with_edits(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, 20)) for i in range(8)]
    docs = []
    for i, t in items * 4:
        s = list(t)
        s[rng.randrange(10, len(s) - 10)] = "q"
        docs.append((len(docs), prose(rng, 20) + " " + "".join(s) + " " + prose(rng, 20), i))
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string, planted int"), spark.createDataFrame(items, "item_id bigint, item_text string")
    got = {(r.doc_id, r.item_id) for r in leaks.find_leaks(df, "doc_id", "text", it, "item_id", "item_text", words=18, max_edits=1).collect()}
    want = {(d, p) for d, _, p in docs}
    assert got <= want and len(got) >= 0.9 * len(want)


def distance(run, text):
    """Fewest edits between ``run`` and a part of ``text``, by the whole table."""
    col, best = list(range(len(run) + 1)), len(run)
    for c in text:
        new = [0]
        for i, r in enumerate(run, 1):
            new.append(min(col[i - 1] + (r != c), col[i] + 1, new[-1] + 1))
        col, best = new, min(best, new[-1])
    return best


def edited(rng, s, n, letters="qxz7"):
    for _ in range(n):
        i, how = rng.randrange(len(s)), rng.randrange(3)
        s = s[:i] + ("" if how == 2 else rng.choice(letters)) + s[i + (how > 0) :]
    return s


def test_edits_within():
    rng = random.Random(3)
    for _ in range(3000):
        run, text = ("".join(rng.choice("abc") for _ in range(rng.randrange(low, 15))) for low in (1, 0))
        for most in range(4):
            want = distance(run, text)
            assert leaks.edits_within(run, text, most) == (want if want <= most else None)


@pytest.mark.parametrize("shortest, edits", [(1, 2), (5, 1), (12, 0), (12, 2), (40, 1), (40, 3)])
def test_sieve_loses_nothing(shortest, edits):
    rng = random.Random(shortest)
    text = lambda n: "".join(rng.choice("abcdefghijkl") for _ in range(n))
    items = [text(120) for _ in range(100)]
    sieve = leaks.Sieve(shortest, edits, 12_000)
    marks = sieve.marks(items)
    runs, streams = [], []
    for _ in range(300):
        item, n = rng.choice(items), rng.randrange(shortest, min(120, 2 * shortest) + 1)
        at = rng.randrange(120 - n + 1)
        runs.append((item, item[at : at + n]))
        streams.append(text(rng.choice([0, 2, 150])) + edited(rng, item[at : at + n], min(edits, n - 1)) + text(rng.choice([0, 2, 150])))
    for (item, run), stream, parts in zip(runs, streams, sieve.stretches(streams, marks)):
        best = distance(run, stream)
        assert best > edits or any(distance(run, p) == best and bits >> leaks.group_of(item) & 1 for p, bits in parts)
    assert not any(sieve.stretches(["", ""], marks)) and sieve.stretches([], marks) == []


@pytest.mark.parametrize("edits", [1, 2])
def test_count_edits(spark, monkeypatch, edits):
    """Items with runs too short for the walk beside longer ones, sent to all tasks or shuffled."""
    rng = random.Random(8)
    items = [(i, prose(rng, 22)) for i in range(12)] + [(50, "a b c d e f g h i j k l m"), (51, "too short"), (52, None)]
    docs = [(900, None), (901, ""), (902, "xx ABC-dEf gHi jzl"), (903, "abcdef"), (904, "…")]
    for i in range(90):
        words = items[i % 12][1].split()
        at = rng.randrange(len(words) - 12)
        docs.append((i, prose(rng, rng.choice([0, 15])) + " " + edited(rng, " ".join(words[at : at + 12]), rng.randrange(4)) + " " + prose(rng, rng.choice([0, 15]))))
    want = {}
    for d, t in docs:
        for i, x in items:
            if t and x and leaks.squeeze(t) and (n := min((distance(w, leaks.squeeze(t)) for w in leaks.item_windows(x, 12)), default=99)) <= edits:
                want[d, i] = n
    assert set(want.values()) == set(range(edits + 1)) and want[902, 50] == 1
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, item_text string")
    run = lambda: sorted(tuple(r) for r in leaks.count_edits(df, "doc_id", "text", it, "item_id", "item_text", max_edits=edits).collect())
    assert run() == sorted((d, i, n) for (d, i), n in want.items())
    monkeypatch.setattr(leaks, "BROADCAST_CHARS", 0)
    assert run() == sorted((d, i, n) for (d, i), n in want.items())


def test_short_items_apart(spark, monkeypatch):
    """An item of short words has windows of its own and leaves those of the others as they are."""
    rng = random.Random(2)
    long, short = (0, prose(rng, 20)), (1, "a1 b2 c3 d4 e5 f6 g7 h8 i9 j0 k1 l2 m3")
    shortest, init = [], leaks.Embedder.__init__
    monkeypatch.setattr(leaks.Embedder, "__init__", lambda self, n, *a, **k: (init(self, n, *a, **k), shortest.append(n))[0])
    df = spark.createDataFrame([(7, long[1]), (8, short[1])], "doc_id bigint, text string")
    run = lambda items: sorted(tuple(r) for r in leaks.count_edits(df, "doc_id", "text", spark.createDataFrame(items, "item_id bigint, item_text string"), "item_id", "item_text", max_edits=1).collect())
    assert run([long]) == [(7, 0, 0)] and run([long, short]) == [(7, 0, 0), (8, 1, 0)]
    assert shortest[0] > 48 and shortest[1:] == [24, shortest[0]]


def test_p8_queries(spark, tmp_path, monkeypatch):
    """p8_found comes from the search with edits, in many tables, and has only the rows without one."""
    rng = random.Random(12)
    items = [(i, prose(rng, 14)) for i in range(30)]
    docs = [(10 * i + n, prose(rng, 20) + " " + (x if n == 0 else x.replace(x[45:55], x[45:49] + "#q" * n + x[49:55], 1)) + " " + prose(rng, 20)) for i, x in items for n in range(3)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, item_text string").write.parquet(str(tmp_path / "eval_items.parquet"))
    made, init = [], leaks.Embedder.__init__
    monkeypatch.setattr(leaks.Embedder, "__init__", lambda self, *a, **k: (init(self, *a, **k), made.append(self.tables))[0])
    exact = {(10 * i, i) for i, _ in items}
    assert {tuple(r) for r in queries.p8_found(spark, str(tmp_path)).collect()} == exact and min(made) > 1
    assert {tuple(r) for r in queries.p8_edits(spark, str(tmp_path)).collect()} == {(d, i, 0) for d, i in exact} | {(d + 1, i, 1) for d, i in exact}


# ---------------------------------------------------------------- 9


def greedy(leaves, levels, total):
    """Budgets by handing out what lacks in rounds."""
    got = [min(w * total, t * r) for *_, w, t, r in leaves]
    for depth in range(len(levels), -1, -1):
        for g in {tuple(x[:depth]) for x in leaves}:
            ix = [i for i, x in enumerate(leaves) if tuple(x[:depth]) == g]
            for _ in range(len(ix) + 1):
                lack = sum(leaves[i][-3] * total - got[i] for i in ix)
                room = {i: leaves[i][-2] * leaves[i][-1] - got[i] for i in ix}
                open_ = [i for i in ix if room[i] > 1e-9 and leaves[i][-3] > 0]
                if lack <= 1e-9 or not open_:
                    break
                share = lack / sum(leaves[i][-3] for i in open_)
                for i in open_:
                    got[i] += min(room[i], share * leaves[i][-3])
    return got


def test_budgets_go_to_siblings_first(spark):
    schema = "domain string, lang string, target_share double, tokens bigint, max_repeats int, source string"
    rows = [("a", "x", 0.4, 10, 1), ("a", "x", 0.2, 1000, 1), ("b", "y", 0.4, 1000, 1)]
    run = lambda rows, total: [r.budget for r in mixing.budgets(spark.createDataFrame([(*r, str(i)) for i, r in enumerate(rows)], schema).coalesce(1), ["domain", "lang"], total).orderBy(F.col("source").cast("int")).collect()]
    assert np.allclose(run(rows, 100), [10, 50, 40])
    rows[1] = ("a", "x", 0.2, 30, 1)
    assert np.allclose(run(rows, 100), [10, 30, 60])
    assert np.allclose(run([(*r[:3], 1, 1) for r in rows], 100), 1)
    rng = random.Random(8)
    for total in (50, 400, 5000):
        rows = [(rng.choice("ab"), rng.choice("xyz"), rng.choice([0.0, 0.01, 0.05, 0.1]), rng.choice([0, 3, 20, 200]), rng.randrange(1, 4)) for _ in range(24)]
        assert np.allclose(run(rows, total), greedy(rows, ["domain", "lang"], total))


def mixture(df, targets):
    docs = mixing.sized(df, "id", "src", "kind", "lang", mixing.plain_tokens("text"))
    return mixing.mix(docs, mixing.budgets(mixing.leaves(docs, targets), ["domain", "lang"]))


def test_mix(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice(["A ", "a", "b", "c", None, "other"]), prose(rng, rng.randrange(1, 30)), "guide", "en-US") for i in range(600)] + [(700, "a", None, None, None), (None, "a", "x y", "guide", "en"), (1, "b", "x y z", "guide", "en")]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "id bigint, src string, text string, kind string, lang string, source string")
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.7, 2), ("c", 0.05, 3), ("d", 0.05, 2)], "source string, target_share double, max_repeats int")
    selected, shares = mixture(df, targets)
    rows = {r.source: r for r in shares.collect()}
    size = {}
    for i, s, t, *_ in docs:
        if i is not None and s and t and s.strip().lower() in "abc":
            size[s.strip().lower()] = size.get(s.strip().lower(), 0) + len(t.split())
    for s, most in (("a", 1), ("b", 2), ("c", 3)):
        r = rows[s]
        assert r.tokens <= r.budget + 1e-6 and r.budget - r.tokens < 30 and r.budget <= most * size[s] + 1e-6
    assert rows["d"].tokens == 0 and abs(sum(r.share for r in rows.values()) - 1) < 1e-9
    limit = {"a": 1, "b": 2, "c": 3}
    assert all(1 <= r.copies <= limit[r.source] for r in selected.collect())
    assert sorted(map(tuple, selected.collect())) == sorted(map(tuple, mixture(df, targets)[0].collect()))


def test_mix_empty(spark):
    df = spark.createDataFrame([], "id bigint, src string, text string, kind string, lang string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    selected, shares = mixture(df, targets)
    assert selected.count() == 0 and shares.first().tokens == 0


def test_tokens(spark):
    texts = ["a_b c.d", "", None, "é1 漢字 x\u00a0y\t!", "\u2028..", "e\u0301"]
    want = [len(re.findall(r"\w+|[^\w\s]", t)) if t else 0 for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(mixing.plain_tokens("t")).collect()] == want
    P = pytest.importorskip("public_tokenizers")
    n = [r[0] for r in df.select(mixing.bpe_tokens("t", str(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)).collect()]
    assert n[1] == n[2] == 0 and n[0] >= 4


# ---------------------------------------------------------------- 10


def test_repeated_share(spark):
    rng = random.Random(7)
    texts = ["", None, "a " * 19, "a " * 20, "one two " * 30, prose(rng, 100), "É é ß " * 10, "x" * 100_000, "a b c d e f g " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, w string").withColumn("text", F.lit(1))
    for r in repetition.repeated_share(df, "id", "w").collect():
        w = re.findall(r"[^\W_]+", texts[r.id].lower()) if texts[r.id] else []
        s = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        assert r.n_words == len(w)
        assert r.n_distinct == (len(set(s)) if len(w) >= 20 else None)
        assert r.repeated_share == (pytest.approx(1 - len(set(s)) / len(s)) if len(w) >= 20 else None)
    assert repetition.repeated_share(df.limit(0), "id", "w").count() == 0


def test_line_frequency(spark):
    rows = [(i, "H ", f"Menu {i}\nown text number {'abcdefgh'[i % 8] * (i + 1)}\nmenu 9!") for i in range(12)] + [(20, "other", "menu 1"), (21, None, "x"), (22, "h", None), (23, "h", "\n\n"), (24, "h", "menu 77\nmenu 78")]
    df = spark.createDataFrame(rows, "id bigint, host string, body string").withColumn("norm", F.lit(1))
    got = {r.id: r for r in repetition.line_frequency(df, "id", "host", "body").collect()}
    assert set(got) == {*range(12), 20, 21, 24}
    assert (got[0].n_lines, got[0].n_removed) == (3, 2) and got[20].n_removed == 0 and got[24].rejected and not got[11].rejected
