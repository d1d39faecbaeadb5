"""Fits the block labeller: ``python -m tidemark.llm.markup_train CHUNKS.parquet``.

Two kinds of documents teach it. Where markup is put into plain sentences of the chunks, each leaf's
labels are known (``injected``): one language throughout, or none, with text that only looks like markup
among it. The chunks themselves have no labels; theirs are made from the notations (``weak_labels``): what
one language alone has names its label, what several share goes to the language with most signs in the
rest of the document, in plain text to Markdown. At most ``MAX_DOCS`` chunks are used; a tenth of them,
and all that is made from it, is held out. ``MIXED`` more documents are put together from several chunks,
since few mix languages at length.
"""

from __future__ import annotations

import sys

import numpy as np

from tidemark.llm.markup import LABEL_NO, LABELS, N_FEATURES, SIGNS, WEIGHTS, Leaf, Network, features, label, leaves, _sigmoid

MAX_DOCS = 12_000
MIXED = 5_000
INJECTED = 12_000
HIDDEN = 24


def signs(found: list[Leaf]) -> dict[str, int]:
    n = dict.fromkeys(("html", "markdown", "wiki", "latex"), 0)
    for leaf in found:
        if leaf.kind == "text":
            for language, p in SIGNS:
                n[language] += bool(p.search(leaf.text))
        elif leaf.kind == "fence":
            n["markdown"] += 1
        elif leaf.kind.startswith(("html:pre", "wiki:", "latex:code")):
            n[leaf.kind.split(":")[0]] += 1
    return n


def weak_labels(found: list[Leaf]) -> list[set]:
    n = signs(found)
    wiki = n["wiki"] > n["markdown"]
    latex = n["latex"] > 0 and n["latex"] >= n["markdown"]
    from tidemark.llm.markup import CUES

    pattern = {(a, b): p for a, b, p in CUES}
    only_wiki = SIGNS[2][1]
    out = []
    for leaf in found:
        y = set(leaf.can)
        if leaf.kind == "text":
            t = leaf.text
            shared_list = ("markdown", "list") in y and ("wiki", "list") in y
            if ("wiki", "list") in y:
                if not wiki:
                    y.discard(("wiki", "list"))
                elif shared_list:
                    y.discard(("markdown", "list"))
            if ("markdown", "heading") in y and wiki and t.startswith("# "):
                y.discard(("markdown", "heading"))
            if ("wiki", "list") in y:
                y.discard(("markdown", "heading"))
            if ("markdown", "inline") in y and ("wiki", "inline") in y:
                strong = only_wiki.search(t)
                if wiki:
                    if not SIGNS[1][1].search(t):
                        y.discard(("markdown", "inline"))
                elif not strong:
                    y.discard(("wiki", "inline"))
            if ("wiki", "inline") in y and not wiki and not only_wiki.search(t) and ("markdown", "inline") in y:
                y.discard(("wiki", "inline"))
            if ("markdown", "inline") in y and latex and not SIGNS[1][1].search(t):
                y.discard(("markdown", "inline"))
            if ("wiki", "inline") in y and latex and not wiki:  # ``quotes'' end in two apostrophes
                y.discard(("wiki", "inline"))
            if ("latex", "inline") in y and n["latex"] == 0 and n["markdown"] > 0 and not pattern[("latex", "inline")].search(t.replace("\\_", "")):
                y.discard(("latex", "inline"))
                y.add(("markdown", "inline"))
            if ("latex", "inline") in y and n["latex"] == 0 and "\\" not in t and "``" not in t:
                y.discard(("latex", "inline"))
        out.append(y)
    return out


def batches(rows, size, rng):
    order = np.argsort([len(x) + rng.random() * 4 for x, _ in rows])
    groups = [order[i : i + size] for i in range(0, len(order), size)]
    rng.shuffle(groups)
    for g in groups:
        t = max(len(rows[i][0]) for i in g)
        x = np.zeros((t, len(g), N_FEATURES), np.float32)
        y = np.zeros((t, len(g), len(LABELS)), np.float32)
        w = np.zeros((t, len(g), len(LABELS)), np.float32)
        m = np.zeros((t, len(g)), bool)
        for k, i in enumerate(g):
            a, b = rows[i]
            x[: len(a), k], y[: len(a), k], w[: len(a), k], m[: len(a), k] = a, b[0], b[1], True
        yield x, y, w, m


def fit(rows, rounds=14, size=48, rate=4e-3, seed=1, log=print):
    """Adam on the cross entropy of the labels whose notation occurs."""
    rng = np.random.default_rng(seed)
    k, n = HIDDEN, len(LABELS)
    p = {}
    for d in "fb":
        p["W" + d] = rng.normal(0, 0.1, (N_FEATURES, 4 * k))
        p["U" + d] = rng.normal(0, 0.1, (k, 4 * k))
        p["b" + d] = np.concatenate([np.zeros(k), np.ones(k), np.zeros(2 * k)])
    p["V"], p["S"], p["c"] = rng.normal(0, 0.1, (2 * k, n)), rng.normal(0, 0.05, (N_FEATURES, n)), np.zeros(n)
    p = {a: v.astype(np.float32) for a, v in p.items()}
    m1 = {a: np.zeros_like(v) for a, v in p.items()}
    m2 = {a: np.zeros_like(v) for a, v in p.items()}
    step = 0
    for r in range(rounds):
        lost = seen = 0.0
        for x, y, w, mask in batches(rows, size, rng):
            t, b, _ = x.shape
            flat = x.reshape(t * b, -1)
            states, kept = {}, {}
            for d in "fb":
                pre = (flat @ p["W" + d] + p["b" + d]).reshape(t, b, -1)
                h = np.zeros((b, k), np.float32)
                c = np.zeros((b, k), np.float32)
                out, memo = np.empty((t, b, k), np.float32), [None] * t
                for s in range(t) if d == "f" else range(t - 1, -1, -1):
                    z = pre[s] + h @ p["U" + d]
                    g, u = _sigmoid(z[:, : 3 * k]), np.tanh(z[:, 3 * k :])
                    new = g[:, k : 2 * k] * c + g[:, :k] * u
                    tn = np.tanh(new)
                    mm = mask[s][:, None]
                    memo[s] = (h, c, g, u, tn, mm)
                    c = np.where(mm, new, c)
                    h = np.where(mm, g[:, 2 * k :] * tn, h)
                    out[s] = h
                states[d], kept[d] = out, memo
            both = np.concatenate([states["f"], states["b"]], axis=2)
            q = _sigmoid(both @ p["V"] + x @ p["S"] + p["c"])
            total = max(1.0, w.sum())
            lost += float(-(w * (y * np.log(q + 1e-7) + (1 - y) * np.log(1 - q + 1e-7))).sum())
            seen += float(w.sum())
            dz = w * (q - y) / total * 20
            g_ = {"V": both.reshape(t * b, -1).T @ dz.reshape(t * b, -1), "S": flat.T @ dz.reshape(t * b, -1), "c": dz.sum((0, 1))}
            dh_all = dz @ p["V"].T
            for d in "fb":
                dh, dc = np.zeros((b, k), np.float32), np.zeros((b, k), np.float32)
                dpre = np.zeros((t, b, 4 * k), np.float32)
                part = dh_all[:, :, :k] if d == "f" else dh_all[:, :, k:]
                du = np.zeros_like(p["U" + d])
                for s in range(t - 1, -1, -1) if d == "f" else range(t):
                    h0, c0, g, u, tn, mm = kept[d][s]
                    dh = dh + part[s]
                    live_h, live_c = np.where(mm, dh, 0), np.where(mm, dc, 0)
                    i, f, o = g[:, :k], g[:, k : 2 * k], g[:, 2 * k :]
                    dnew = live_c + live_h * o * (1 - tn * tn)
                    dzs = np.concatenate([dnew * u * i * (1 - i), dnew * c0 * f * (1 - f), live_h * tn * o * (1 - o), dnew * i * (1 - u * u)], axis=1)
                    dpre[s] = dzs
                    du += h0.T @ dzs
                    dh = np.where(mm, 0, dh) + dzs @ p["U" + d].T
                    dc = np.where(mm, dnew * f, dc)
                g_["W" + d], g_["U" + d], g_["b" + d] = flat.T @ dpre.reshape(t * b, -1), du, dpre.sum((0, 1))
            norm = np.sqrt(sum(float((v * v).sum()) for v in g_.values()))
            scale = min(1.0, 5.0 / (norm + 1e-9))
            step += 1
            lr = rate * (0.5 ** (r / 5))
            for a, v in g_.items():
                v = v * scale
                m1[a] = 0.9 * m1[a] + 0.1 * v
                m2[a] = 0.999 * m2[a] + 0.001 * v * v
                p[a] -= (lr * (m1[a] / (1 - 0.9**step)) / (np.sqrt(m2[a] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        log(f"round {r}: loss {lost / max(seen, 1):.5f}")
    return p


_CODE = ["for i in range(3):", "    print(i)", "# no heading", "x = {'a': [1, 2]}", "if a < b && c > d:", "* pointer = &value;", "return x == y", "[link](x)", "== y ==", "\\\\n", "<b>x</b>", "$ make all"]
#: What looks like markup and is none.
_DECOYS = ["{0} costs $5, then $6 {1}", "{0} < 3 and {1} > 4", "the snake_case_{2} of {0}", "{0} in C# and F# {1}", "a List<{2}> of {0}", "{0}[0][1] {1}", "5 * 3 * 2 {0}", "{0} == {1}", "{0} 100% {1}", "see {0}; {1}: {2}",
           "{0} -- {1}", "2*x {0} and y*3 {1}", "{0} | {1}", "{0}... ({1})", "~40 {0} {1}", "{0} & {1}", "\"{0}\" '{2}'", "file_{2}_name {0}", "A->B {0}", "{0} => {1}", "x_1 {0} y_2"]
_INLINE = {
    "html": ["<p>{0}</p>", "{0} <b>{2}</b> {1}", "<a href=\"https://docs.example/{2}\">{0}</a> {1}", "{0} &amp; {1}", "<div class=\"{2}\">{0}</div>", "{0}<br>{1}", "<em>{0}</em> {1}", "{0} <code>{2}</code> {1}", "<table><tr><td>{0}</td></tr></table>", "{0}&nbsp;{1}"],
    "markdown": ["{0} **{2}** {1}", "{0} [{2}](https://docs.example/{2}) {1}", "{0} `{2}` {1}", "> {0} {1}", "{0} *{2}* {1}", "{0} _{2}_ {1}", "![{0}](img/{2}.png)", "{0} ~~{2}~~ {1}", "{0} [{2}][1] {1}", "| {0} | {1} |", "{0} __{2}__ {1}"],
    "wiki": ["{0} '''{2}''' {1}", "{0} ''{2}'' {1}", "{0} [[{2}]] {1}", "{0} [[{2}|{0}]] {1}", "{{{{cite|{2}}}}} {0}", "{0} [https://docs.example/{2} {1}]", "{0}<ref>{1}</ref>", "{{{{{2}|x=1}}}} {0}"],
    "latex": ["{0} \\emph{{{2}}} {1}", "{0} \\textbf{{{2}}} {1}", "{0} \\cite{{{2}}} {1}", "{0} ``{2}'' {1}", "{0} \\texttt{{{2}}} {1}", "{0}\\footnote{{{1}}}", "{0} \\ref{{{2}}} {1}", "{0} 50\\% {1}"],
}
_PIECE = {"html": " <b>{2}</b>", "markdown": " **{2}**", "wiki": " '''{2}'''", "latex": " \\emph{{{2}}}"}
_HEADS = {"html": ["<h{3}>{0}</h{3}>"], "markdown": ["## {0}", "### {0}", "# {0}", "#### {0} ####"], "wiki": ["== {0} ==", "=== {0} ==="], "latex": ["\\section{{{0}}}", "\\subsection{{{0}}}", "\\section*{{{0}}}", "\\chapter{{{0}}}"]}
_ITEMS = {
    "html": (["<ul>"], ["<li>{0}</li>"], ["</ul>"]), "markdown": ([], ["- {0} {1}", "* {0} {1}", "+ {0}", "{4}. {0}"], []),
    "wiki": ([], ["* {0} {1}", "# {0}", "** {0}", "; {2}"], []), "latex": (["\\begin{{itemize}}"], ["\\item {0} {1}"], ["\\end{{itemize}}"]),
}
_BLOCKS = {"html": ("<pre>", "</pre>"), "markdown": ("```{2}", "```"), "wiki": ("<syntaxhighlight lang=\"{2}\">", "</syntaxhighlight>"), "latex": ("\\begin{{verbatim}}", "\\end{{verbatim}}")}
_FORMULAS = ["{0} $x_{4}^2 + y$ {1}", "{0} \\(a = b\\) {1}", "$$\ne = mc^{4}\n$$", "\\[\nx < {4}\n\\]", "\\begin{{equation}}\na_{4} = b\n\\end{{equation}}"]


def inject(sentences: list[str], rng) -> tuple[list[Leaf], list[set]] | None:
    """A document of one language, two or none, made of plain sentences, and the labels of its leaves;
    None where lines and leaves do not go together."""
    language = [*_INLINE, None][rng.integers(0, 5)]
    pick = lambda x: x[rng.integers(0, len(x))]

    def fill(template):
        return template.format(pick(sentences), pick(sentences), pick(pick(sentences).split()).strip(".,") or "x", rng.integers(1, 5), rng.integers(1, 9))

    heads, items, inlines = (x.get(language) for x in (_HEADS, _ITEMS, _INLINE))
    if language == "markdown" and rng.random() < 0.3:  # nothing but what wikis write alike
        heads, items, inlines = [], ([], ["* {0} {1}", "* {2}"], []), ["{0} *{2}* {1}", "{0} _{2}_ {1}"]
    lines: list[tuple[str, set]] = []
    if rng.random() < 0.15:  # two languages, and a notation of both that belongs to the one with more lines
        n = rng.permutation(14)[:2] + 1
        for k, name in zip(n, ("markdown", "wiki")):
            lines += [(fill(pick([_INLINE[name][0], _INLINE[name][1 if name == "markdown" else 2]])), {(name, "inline")}) for _ in range(k)]
        lines = [x for i in rng.permutation(len(lines)) for x in (lines[i], ("", set()))]
        shared = [(fill("* {0}"), {("markdown" if n[0] > n[1] else "wiki", "list")}) for _ in range(rng.integers(1, 4))]
        at = pick([0, len(lines)])
        lines[at:at] = [*shared, ("", set())]
        return _aligned(lines)
    for _ in range(rng.integers(1, 14)):
        kind = pick(["plain", "plain", "decoy", "heading", "list", "code_block", "inline", "inline", "formula"])
        if language and not heads and kind in ("heading", "code_block"):
            kind = "list"
        own = {(language, kind)}
        if kind == "plain" or (language is None and kind != "formula"):
            block = [(fill("{0} {1}") if kind == "plain" else fill(pick(_DECOYS)), set())]
        elif kind == "decoy":
            block = [(fill(pick(_DECOYS)), set())]
        elif kind == "heading":
            block = [(fill(pick(heads)), own)]
        elif kind == "inline":
            block = [(fill(pick(inlines)), own)]
        elif kind == "list":
            before, item, after = items
            one = pick(item)
            block = [(fill(x), own) for x in [*before, *[one] * rng.integers(1, 5), *after]]
        elif kind == "code_block":
            open_, close = _BLOCKS[language]
            block = [(x, own) for x in [fill(open_), *(pick(_CODE) for _ in range(rng.integers(1, 5))), fill(close)]]
        else:
            block = [(x, {("latex", "formula")}) for x in fill(pick(_FORMULAS)).split("\n")]
        if kind in ("plain", "inline", "list") and rng.random() < 0.3:  # a second element in a line
            at = rng.integers(0, len(block))
            text, had = block[at]
            if rng.random() < 0.5:
                block[at] = (text + fill(" $a_{4} < b^{3}$"), had | {("latex", "formula")})
            elif language and kind != "plain" and not text.startswith(("\\begin", "\\end", "<ul", "</ul")):
                block[at] = (text + fill(_PIECE[language]), had | {(language, "inline")})
        lines += [*block, ("", set())] if rng.random() < 0.8 else block
    return _aligned(lines)


def _aligned(lines: list[tuple[str, set]]) -> tuple[list[Leaf], list[set]] | None:
    """The leaves of lines with known labels, and theirs."""
    found = leaves("\n".join(x for x, _ in lines))
    truth, at = [], 0
    for leaf in found:
        n = leaf.text.count("\n") + 1
        truth.append(set().union(*(y for _, y in lines[at : at + n])))
        at += n
    return (found, truth) if at == len(lines) and len(found) <= 300 else None


def injected(texts: list[str], n: int, rng) -> list[tuple[list[Leaf], list[set]]]:
    """``n`` documents with known labels, from the lines of ``texts`` that are plain words."""
    plain = [x.strip() for t in texts for x in t.split("\n") if 3 <= len(x.split()) <= 25 and not set(x) - _PLAIN and not x[:4].strip() == ""]
    out = []
    while plain and len(out) < n:
        made = inject(plain, rng)
        if made:
            out.append(made)
    return out


_PLAIN = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ ,.äöüßéèàçñóíáúêâ")


def rows_of(docs):
    """Training rows of (leaves, labels): every label of every leaf counts, those that are neither right
    nor suggested by a notation a tenth, and those of blank leaves not at all."""
    out = []
    for found, labels in docs:
        y, w = np.zeros((len(found), len(LABELS)), np.float32), np.zeros((len(found), len(LABELS)), np.float32)
        for i, (leaf, own) in enumerate(zip(found, labels)):
            w[i] = 0.1 * (leaf.kind != "blank")
            for c in leaf.can | own:
                w[i, LABEL_NO[c]] = 1
            for c in own:
                y[i, LABEL_NO[c]] = 1
        out.append((features(found), (y, w)))
    return out


def agreement(net, docs):
    """Of documents of (leaves, labels): the share with exactly the labels, and precision and recall of
    (document, label) and of (leaf, label)."""
    got, want = label(net, [d for d, _ in docs]), [x for _, x in docs]
    whole = lambda rows: [set().union(*x) if x else set() for x in rows]
    figures = [np.mean([a == b for a, b in zip(whole(got), whole(want))])]
    for a, b in ((whole(got), whole(want)), ([x for d in got for x in d], [x for d in want for x in d])):
        hit = sum(len(x & y) for x, y in zip(a, b))
        figures += [hit / max(1, sum(map(len, a))), hit / max(1, sum(map(len, b)))]
    return tuple(map(float, figures))


def mixed(texts, n, rng):
    """Documents of two to five texts, of which one or two stand several times."""
    out = []
    while len(out) < n:
        own = [texts[i] for i in rng.integers(0, len(texts), rng.integers(2, 5))]
        own += [own[0]] * rng.integers(0, 4) + [own[1]] * rng.integers(0, 4)
        found = leaves("\n\n".join(own[i] for i in rng.permutation(len(own))))
        if len(found) <= 300:
            out.append((found, weak_labels(found)))
    return out


def main(path):
    import pyarrow.parquet as pq

    t = pq.read_table(path, columns=["id", "chunk_domain", "content"]).to_pydict()
    texts = [c for d, c in zip(t["chunk_domain"], t["content"]) if d == "content" and c][:MAX_DOCS]
    held, used = texts[::10], [x for i, x in enumerate(texts) if i % 10]
    weak = lambda rows: [(d, weak_labels(d)) for d in map(leaves, rows) if len(d) <= 300]
    short = lambda rows: [x for x in rows if x.count("\n") < 60]
    rng = np.random.default_rng(3)
    net = Network(fit(rows_of(weak(used) + mixed(short(used), MIXED, rng) + injected(used, INJECTED, rng))))
    say = "%s: documents alike %.4f, by document precision %.4f, recall %.4f, by leaf precision %.4f, recall %.4f"
    for name, docs in (("known labels", injected(held, INJECTED // 5, rng)), ("weak labels", weak(held)), ("weak labels, mixed", mixed(short(held), MIXED // 10, rng))):
        print(say % ("held out, " + name, *agreement(net, docs)), flush=True)
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float16) for k, v in net.p.items()})


if __name__ == "__main__":
    main(sys.argv[1])
