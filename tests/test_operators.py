"""Traces, git history, search, graph, chunking, stores, sources and streams on small tables."""

import datetime as dt
import json
import math
import sqlite3
import statistics
import subprocess

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import chunking, gitlog, graph, search, store, trace
from tidemark.sources import config, files, git, html

AS_OF = "2025-06-01 00:00:00"
NOW = dt.datetime(2025, 6, 1)
DAY = dt.timedelta(days=1)


def log(spark, rows):
    return spark.createDataFrame(rows, "chunk_id bigint, project_id string, file_path string, interaction string, timestamp timestamp_ntz")


def test_hot_and_decay(spark):
    rows = [(1, "p", "a.py", "read", NOW - DAY)] * 5 + [(1, "p", "a.py", "edit", NOW - DAY)] * 2 + [(1, "p", "a.py", "search_hit", NOW - DAY)] * 3 + [(2, "p", "b.py", "read", NOW - 30 * DAY)] * 2
    rows += [(3, "p", "c.py", "read", NOW - 45 * DAY)] * 10 + [(3, "p", None, "read", NOW - 31 * DAY)] * 3
    hot = trace.hot_files(log(spark, rows), AS_OF).collect()
    assert [tuple(r) for r in hot] == [("p", "a.py", 5, 2, 3, 10), ("p", "b.py", 2, 0, 0, 2)]
    (d,) = trace.decaying_files(log(spark, rows), AS_OF).collect()
    assert (d.file_path, d.before, d.now, d.ratio) == ("c.py", 10, 0, 10.0)
    assert trace.hot_files(log(spark, rows), AS_OF, limit=-1).count() == 2 and trace.hot_files(log(spark, []), AS_OF).count() == 0


def test_quartile_and_signals(spark):
    for v in ([], [3], [1, 2, 3], [1, 2, 3, 10, 50], [5, 5, 1, 9], list(range(17)), [2.5, 1.0, 7.25, 3.0]):
        (got,) = spark.range(1).select(gitlog.third_quartile(F.array(*map(F.lit, v)) if v else F.array().cast("array<int>"))).first()
        want = 0 if not v else max(v) if len(v) < 4 else statistics.quantiles(v, n=4)[2]
        assert math.isclose(got, want)
    cases = [(10, 0, "BLIND"), (10, 10, "HOT"), (10, 1, "TURBULENT"), (0, 10, "ZOMBIE"), (1, 10, "STABLE"), (1, 1, "COLD")]
    df = spark.createDataFrame(cases, "c int, r int, want string")
    assert all(x.want == x.got for x in df.withColumn("got", gitlog.classify(F.col("c"), F.col("r"), F.lit(5), F.lit(5))).collect())


def test_numstat(spark):
    lines = ["10\t5\tsrc/a.py", "-\t-\timg.png", "1\t2\told.md => new.md", "3\t4\tsrc/{a => b}/c.go", "0\t0\tsrc/{ => x}/d.go", "", "junk", "1\tx\ty"]
    got = [tuple(r) for r in gitlog.parse_numstat(spark.createDataFrame([(x,) for x in lines], "line string")).drop("line").collect()]
    assert got == [("src/a.py", None, 10, 5, "M", False), ("img.png", None, None, None, "M", True), ("new.md", "old.md", 1, 2, "R", False), ("src/b/c.go", "src/a/c.go", 3, 4, "R", False), ("src/x/d.go", "src//d.go", 0, 0, "R", False)]


def test_git_source(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@example.org", *a], check=True, capture_output=True)
    run("init", "-q")
    for k in range(3):
        (tmp_path / "a.txt").write_text("line\n" * (k + 1))
        run("add", ".")
        run("commit", "-q", "-m", f"change {k}")
    spark.dataSource.register(git.GitLogSource)
    raw = spark.read.format("gitlog").option("path", str(tmp_path)).option("project", "p").load()
    commits, changes = gitlog.parse_log(raw)
    assert [r.summary for r in commits.orderBy("summary").collect()] == ["change 0", "change 1", "change 2"]
    assert {(r.file_path, r.insertions, r.deletions) for r in changes.collect()} == {("a.txt", 1, 0)} and changes.count() == 3
    first = commits.where("summary = 'change 0'").first().hash
    since = spark.read.format("gitlog").option("path", str(tmp_path)).option("since", first).load()
    assert gitlog.parse_log(since)[0].count() == 2
    assert spark.range(1).select(gitlog.valid_ref(F.lit(first)), gitlog.valid_ref(F.lit("xyz"))).first()[:] == (True, False)


DOCS = ["JWT token authentication with refresh tokens", "def foo_bar(): pass", "run running runs café", "foo then bar", "token", "Relational conditional hopping hopefulness tokens", None]


def fts(query):
    c = sqlite3.connect(":memory:")
    c.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize='porter unicode61')")
    c.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", list(enumerate(d or "" for d in DOCS)))
    try:
        return {i: round(s, 5) for i, s in c.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (query,))}
    except sqlite3.OperationalError:
        return {}


def test_bm25_against_fts5(spark):
    index = search.TextIndex(spark.createDataFrame(list(enumerate(DOCS)), "id bigint, content string"))
    for q in ("tokens", "foo_bar", "cafe", "running", "token authentication", "foo OR token", "NOT token", "foo AND", "and token", "foo AND then", "relation", "hopeful", "token NOT jwt", "nothing here"):
        got = {r.id: round(r.score, 5) for r in index.search([(1, q)]).collect()}
        assert got == pytest.approx(fts(q), abs=2e-5), q
    assert index.search([(1, "  "), (2, "?!")]).count() == 0
    assert {r.id for r in index.search([(1, "tok")], prefix=True).collect()} == {0, 4, 5}
    assert {r.id for r in index.search([(1, "token")], spark.createDataFrame([(4,)], "id bigint")).collect()} == {4}


def test_porter():
    words = "caresses ponies ties cats feed agreed plastered motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci digitizer radicalli differentli vileli operator feudalism decisiveness hopefulness formaliti sensitiviti triplicate formative electriciti goodness revival allowance inference airliner adjustable replacement adoption activate effective probate rate cease controll roll"
    c = sqlite3.connect(":memory:")
    c.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize='porter unicode61')")
    c.execute("INSERT INTO f(rowid, t) VALUES (1, ?)", (words,))
    c.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, 'instance')")
    want = [t for (t,) in c.execute("SELECT term FROM v ORDER BY offset")]
    assert [tx.porter(w) for w in words.split()] == want


def ranks(spark, ids):
    return spark.createDataFrame([(1, i, k) for k, i in enumerate(ids, 1)], "query_no int, id bigint, rank int")


def test_fusion_and_boost(spark):
    got = [(r.id, r.score) for r in search.rrf([ranks(spark, [1, 2]), ranks(spark, [2, 3])]).orderBy("rank").collect()]
    assert got == [(2, 0.032522), (1, 0.016393), (3, 0.016129)]
    tie = [r.id for r in search.rrf([ranks(spark, [9, 8]), ranks(spark, [7, 6])]).orderBy("rank").collect()]
    assert tie == [9, 7, 8, 6]
    found = spark.createDataFrame([(1, 1, 0.5, 1), (1, 2, 0.5, 2), (1, 3, 0.5, 3)], "query_no int, id bigint, score double, rank int")
    counts = spark.createDataFrame([(2, 5), (3, 40)], "chunk_id bigint, n bigint")
    assert [(r.id, r.score) for r in search.boost(found, counts).orderBy("rank").collect()] == [(3, 0.6), (2, 0.55), (1, 0.5)]
    n = search.normalise(spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 7.0), (3, 2.0), (3, 2.0)], "q int, score double"), ["q"])
    assert sorted((r.q, r.score) for r in n.collect()) == [(1, 0.0), (1, 1.0), (2, 7.0), (3, 1.0), (3, 1.0)]


def test_small_text_functions(spark):
    df = spark.createDataFrame([("a-b_c? É!", "\n".join(map(str, range(12))))], "q string, c string")
    r = df.select(tx.sanitize_query(F.col("q")), tx.snippet(F.col("c")), tx.snippet(F.lit("x\ny"))).first()
    assert r[0] == "a b_c  É" and r[1] == "\n".join(map(str, range(10))) + "\n..." and r[2] == "x\ny"
    p = spark.createDataFrame([("/srv/a/b/x.py",), ("/srv/a",), ("/srv/ab/x",), ("/other",)], "path string")
    pr = spark.createDataFrame([("A", "/srv/a"), ("B", "/srv/a/b/")], "id string, path string")
    assert {(x.path, x.project_id, x.relative) for x in search.prefix_project(p, pr).collect()} == {("/srv/a/b/x.py", "B", "x.py"), ("/srv/a", "A", "")}


CH = "id bigint, project_id string, file_path string, chunk_domain string, content string, metadata string"


def test_edges(spark):
    c = spark.createDataFrame([
        (1, "p", "docs/index.md", "content", "See [g](guide.md), ![i](./guide.md) [w](https://x.org) [s](#a) [u](../up.md)", '{"tags": ["a", "b", "c"], "categories": ["x"]}'),
        (2, "p", "docs/guide.md", "content", "text", None), (3, "p", "docs/index.md", "content", "", '{"tags": ["b", "a", "d"], "categories": ["x", "y"]}'), (4, "p", "docs/index.md", "content", "", '{"tags": ["a"]}'),
        (5, "q", "docs/guide.md", "content", "", "no json"), (6, "p", "src/main.py", "code", "import utils\nfrom pkg.mod import x", None), (7, "p", "src/utils.py", "code", "x", None), (8, "p", "src/pkg/mod.py", "code", "x", None),
        (9, "p", "src/main.ts", "code", "import { a } from './lib'\nconst b = require('./data.json')\nimport c from 'react'", None), (10, "p", "src/lib.tsx", "code", "x", None), (11, "p", "src/data.json", "code", "x", None)], CH)
    pairs = lambda df: {(r.source_id, r.target_id, r.weight) for r in df.collect()}
    assert pairs(graph.link_edges(c)) == {(1, 2, 1.0)}
    assert pairs(graph.tag_edges(c)) == {(1, 3, 0.5)}
    assert pairs(graph.category_edges(c)) == {(1, 3, 1.0)}
    assert pairs(graph.import_edges(c)) == {(6, 7, 1.0), (6, 8, 1.0), (9, 10, 1.0), (9, 11, 1.0)}
    v = spark.createDataFrame([(i, [math.cos(a / 10)] + [math.sin(a / 10)] + [0.0] * 62) for i, a in enumerate([0, 1, 2, 15])] + [(9, [1.0])], "id bigint, embedding array<float>")
    assert {(r.source_id, r.target_id) for r in graph.semantic_edges(v, v.select("id")).collect()} == {(a, b) for a in range(3) for b in range(3) if a != b}


EDGES = "source_id bigint, target_id bigint, edge_type string, weight double"


def test_graph_algorithms(spark):
    e = spark.createDataFrame([(1, 2, "link", 1.0), (2, 3, "link", 1.0), (3, 1, "tag", None), (10, 11, "link", 1.0), (11, 12, "link", 2.0), (12, 10, "tag", 1.0), (3, 10, "link", 0.1)], EDGES)
    c = spark.createDataFrame([(i,) for i in (1, 2, 3, 10, 11)], "id bigint")
    start = spark.createDataFrame([(1,)], "start bigint")
    assert {(r.id, r.depth) for r in graph.neighbours(e, c, start, 2).collect()} == {(2, 1), (3, 1), (10, 2)}
    assert {(r.id, r.depth) for r in graph.neighbours(e, c, start, 9, ["link"]).collect()} == {(2, 1), (3, 2), (10, 3)}
    r = {x.id: x.rank for x in graph.pagerank(e).collect()}
    assert abs(sum(r.values()) - 1) < 1e-4 and min(r.values()) > 0
    more = {x.id: x.rank for x in graph.pagerank(e, c.union(spark.range(99, 100))).collect()}
    assert set(more) == set(r) | {99} and more[99] < min(r.values())
    with pytest.raises(RuntimeError):
        graph.pagerank(e, tol=1e-15, most=3)
    # Of parallel edges the one of the greatest type counts.
    two = spark.createDataFrame([(1, 2, "a", 9.0), (1, 2, "b", 1.0), (1, 3, "a", 1.0)], EDGES)
    ranks = {x.id: x.rank for x in graph.pagerank(two).collect()}
    assert ranks[2] == ranks[3] and {(x.a, x.b, x.w) for x in graph.undirected(two).collect()} == {(1, 2, 1.0), (1, 3, 1.0)}
    g = graph.communities(e, spark.range(99, 100))
    assert {x.id: x.community for x in g.collect()} == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10, 99: 99}
    alone = g.select("id", F.col("id").alias("community"))
    assert graph.modularity(e, g) > graph.modularity(e, alone)
    assert graph.pagerank(e.limit(0)).count() == 0 and graph.communities(e.limit(0)).count() == 0
    ch = spark.createDataFrame([(1, '{"a": [1, "x"], "n": 3, "pagerank": 9}'), (99, None)], "id bigint, metadata string")
    got = {x.id: json.loads(x.metadata) for x in graph.with_graph_metadata(ch, graph.pagerank(e), g).collect()}
    assert got == {1: {"a": [1, "x"], "n": 3, "community_id": 1, "pagerank": r[1]}, 99: {"community_id": 99}}


def test_rebuilt_edges(spark):
    c = spark.createDataFrame([(1, "p", "a.md", "content", "", '{"categories": ["x"]}'), (2, "p", "a.md", "content", "", '{"categories": ["x"]}'), (3, "q", "a.md", "content", "", None)], CH)
    v = spark.createDataFrame([], "id bigint, embedding array<float>")
    e = spark.createDataFrame([(1, 3, "link", 1.0), (3, 3, "link", 1.0), (3, 2, "semantic", 0.9)], EDGES)
    rows = lambda df: {(r.source_id, r.target_id, r.edge_type) for r in df.collect()}
    both = graph.rebuilt_edges(e, c, v, v, ("category",), "p")
    assert rows(both[0]) == {(3, 3, "link"), (1, 2, "category")} and rows(both[1]) == {(1, 2, "category")}
    assert rows(graph.rebuilt_edges(e, c, v, v)[0]) == {(1, 2, "category")}
    assert rows(graph.rebuilt_edges(e, c, v, v, ())[0]) == rows(e)


def test_line_windows(spark):
    df = spark.createDataFrame([(1, "\n".join(f"l{i}" for i in range(12))), (2, ""), (3, None), (4, "\n\n"), (5, "x")], "id int, t string")
    got = [(r.id, r.start_line, r.end_line) for r in chunking.line_windows(df, "id", "t", 5, 2).orderBy("id", "window_no").collect()]
    assert got == [(1, 1, 5), (1, 4, 8), (1, 7, 11), (1, 10, 12), (5, 1, 1)]
    with pytest.raises(ValueError):
        chunking.line_windows(df, "id", "t", 2, 2)


def test_headings():
    text = "---\ntitle: T\ntags: [a, b]\nwhen: 2020-01-01\n---\nintro\n## One\n" + "x" * 250 + "\n## Tiny\nshort\n### Three\n" + "y" * 250
    got = chunking.by_headings(text)
    assert [(s["name"], s["start_line"]) for s in got] == [(None, 6), ("One", 7), ("Three", 11)] and got[0]["metadata"] == {"title": "T", "tags": ["a", "b"]}
    assert "## Tiny" in got[1]["content"] and got[1]["end_line"] == 10
    assert chunking.by_headings("  \n") == [] and chunking.by_headings("plain")[0]["name"] is None
    over = chunking.by_headings(text, overlap=1)
    assert over[2]["start_line"] == 10 and over[2]["content"].startswith("short")


def test_code_chunks():
    py = "import os\n\nclass A:\n    def m(self):\n        return 1\n\n@deco\ndef f():\n    pass\n"
    assert [(c[0], c[1], c[2], c[3]) for c in chunking.code_chunks_of(py, "python")] == [("class", "A", 3, 5), ("method", "m", 4, 5), ("block", "f", 7, 9)]
    ts = "import x from 'y'\nexport function go(a) {\n  if (a) { return '}' }\n}\ninterface B {\n  c: string\n}\nconst z = 1;\n"
    assert [(c[0], c[1], c[2], c[3]) for c in chunking.code_chunks_of(ts, "typescript")] == [("function", "go", 2, 4), ("interface", "B", 5, 7), ("block", "z", 8, 8)]
    astro = "---\nconst a = 1\n---\n<h1>x</h1>\n<script>\nlet b\n</script>\n<p>y</p>\n<style>\na{}\n</style>"
    assert [(c[0], c[1], c[2], c[3]) for c in chunking.code_chunks_of(astro, "astro")] == [("block", "frontmatter", 1, 3), ("block", "template", 4, 4), ("script", "script", 5, 7), ("block", "template-2", 8, 8), ("style", "style", 9, 11)]
    long = "def f():\n" + "    x = 1\n" * 120
    assert [(c[2], c[3]) for c in chunking.code_chunks_of(long, "python")] == [(1, 50), (49, 98), (97, 121)]
    assert chunking.code_chunks_of("def (", "python")[0][0] == "block" and chunking.code_chunks_of(" \n", "go") == []
    assert [chunking.kind_of_node(n) for n in ("function_item", "class_declaration", "trait_item", "enum_item", "impl_item", "mod_item", "type_alias", "decorated_definition")] == ["function", "class", "interface", "enum", "impl", "module", "type", "block"]


def test_store(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, n int")
    assert sorted(map(tuple, store.upsert(old, new, ["id"], "n").collect())) == [(1, "a"), (2, "d"), (3, "e")]
    all_, added = store.insert_or_ignore(old, new, ["id"], "n")
    assert sorted(map(tuple, all_.collect())) == [(1, "a"), (2, "b"), (3, "e")] and added.count() == 1
    j = spark.createDataFrame([('{"a": {"x": 1}, "b": 2}', '{"a": {"y": 2}, "b": null}'), (None, '{"a": 1}'), ("[1]", '{"a": null}'), ('{"a": 1}', None), ("bad", '{"z": [null]}')], "t string, p string")
    assert [json.loads(r[0]) for r in j.select(store.json_patch("t", "p")).collect()] == [{"a": {"x": 1, "y": 2}}, {"a": 1}, {}, {"a": 1}, {"z": [None]}]
    assert [json.loads(r[0]) for r in j.select(store.shallow_update("t", "p")).collect()] == [{"a": {"y": 2}, "b": None}, {"a": 1}, {"a": None}, {"a": 1}, {"z": [None]}]
    e = spark.createDataFrame([(1, 2, "x"), (2, 3, "x"), (3, 1, "y"), (3, 4, "y")], "source_id int, target_id int, edge_type string")
    ids = spark.createDataFrame([(1,), (2,), (1,), (None,)], "id int")
    for kind, left, n in ((None, [(3, 4)], 3), ("x", [(3, 1), (3, 4)], 2)):
        kept, gone = store.delete_edges(e, ids, kind)
        assert sorted((r[0], r[1]) for r in kept.collect()) == left and gone.first().n == n
    assert sorted(map(tuple, store.set_values(spark.createDataFrame([("a", "1")], "key string, value string"), {"a": "2", "b": "3"}).collect())) == [("a", "2"), ("b", "3")]
    named = store.with_ids(spark.createDataFrame([(f"k{i:03d}",) for i in range(300)], "k string").repartition(7), ["k"], 10)
    assert sorted((r.id, r.k) for r in named.collect()) == [(11 + i, f"k{i:03d}") for i in range(300)]
    p = spark.createDataFrame([("a", None, "c0"), ("b", None, None)], "id string, last_indexed timestamp_ntz, last_indexed_commit string")
    assert {(r.id, r.last_indexed is None, r.last_indexed_commit) for r in store.mark_indexed(p, "a", AS_OF).union(store.mark_indexed(p, "b", AS_OF, "c1")).collect()} == {("a", False, "c0"), ("b", True, None), ("a", True, "c0"), ("b", False, "c1")}
    logs = spark.createDataFrame([(1, NOW - 31 * DAY), (2, NOW - 30 * DAY), (3, None)], "id int, timestamp timestamp_ntz")
    assert {r.id for r in store.expire(logs, "timestamp", AS_OF, 30).collect()} == {2, 3}
    with pytest.raises(ValueError):
        store.assert_parity(old, old.limit(1))
    store.assert_parity(old, old)


def test_scan(spark, tmp_path):
    for name, body in {"a.md": "hé", "src/b.py": "x", "src/__init__.py": "", "node_modules/c.js": "x", ".github/w.yml": "x", ".hidden/d.md": "x", "img.PNG": "x", "big.txt": "x" * 3000, "sub/.DS_Store": "x", "skip/keep.md": "x", "skip/drop.md": "x"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    got = {r.file_path: r.text for r in files.scan(spark, str(tmp_path), [*config.DEFAULT_IGNORE, "skip/*", "!skip/keep.md"], 2).collect()}
    assert set(got) == {"a.md", "src/b.py", "src/__init__.py", ".github/w.yml", "skip/keep.md"} and got["a.md"] == "hé"
    df = spark.createDataFrame([("docs/a.md",), ("b.md",), ("src/x.py",), ("y.py",), ("z.c",)], "p string")
    scope = files.in_scope(F.col("p"), ([".md"], ["docs"]), ([".py"], ["./", "src"]))
    assert {r.p for r in df.where(scope).collect()} == {"docs/a.md", "src/x.py", "y.py"} or {r.p for r in df.where(scope).collect()} == {"docs/a.md", "src/x.py"}
    langs = spark.createDataFrame([("a/Dockerfile",), ("x.R",), ("n.unknown",), ("q.tar.py",), (".py",)], "p string")
    assert [r[0] for r in langs.select(files.language(F.col("p"))).collect()] == ["dockerfile", "r", None, "python", None]


def test_config(tmp_path):
    p = tmp_path / "k.toml"
    p.write_text('[project]\nname = "x"\n[code]\npreset = "python"\n[graph]\nenabled = true\n[indexing]\nmax_file_size_kb = 9\n')
    c = config.load_config(p)
    assert (c.name, c.code_suffixes, c.graph_enabled, c.max_file_kb, c.threshold) == ("x", [".py", ".pyi"], True, 9, 0.75)
    assert config.suffixes("mixed") == sorted(set(config.PRESETS["web"] + config.PRESETS["python"])) and config.suffixes(None) == [] and config.suffixes("web", [".b", ".a", ".a"]) == [".a", ".b"]
    with pytest.raises(ValueError):
        config.suffixes("nope")
    p.write_text("= bad")
    with pytest.raises(Exception):
        config.load_config(p)
    assert config.language_of("x/Makefile") == "make" and config.language_of("a.PY") == "python"


def test_html_and_urls(spark):
    page = "<html><head><title>T</title><style>x</style></head><body><nav>menu</nav><p>One &amp; two</p><script>var a</script><li>three</li>  <br>four<footer>f</footer></body></html>"
    more = "a<nav><p>x</p> y</header>b <!-- <p> --> <a title='1 > 0'>c</a>\n  3 &lt; 4<script>if (a<b) '</p>'</script >d<header/>e"
    texts = [r[0] for r in spark.createDataFrame([(page,), ("",), (None,), (more,), ("<script>x",)], "p string").select(html.html_text("p")).collect()]
    assert texts == ["TOne & two\nthree\nfour", "", None, "a\nb  c\n3 < 4d", ""]
    u = spark.createDataFrame([("https://docs.example.org:8080/a/b?q=1",), ("ftp://x/y",), ("http://a.b",)], "u string")
    assert [tuple(r) for r in u.select(html.url_project(F.col("u")), html.url_path(F.col("u"))).collect()] == [("docs-example-org:8080", "/a/b"), (None, "/y"), ("a-b", "/")]


def test_entry_contract(spark):
    import __spark_entry__ as entry

    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and {f"p{n}_found" for n in (2, 6, 7)} <= set(q)


def test_stream_state_over_many_batches(spark, tmp_path):
    """Each batch touches a few keys only; the newest state of every key must come out."""
    from tidemark.streaming import activity as streams

    rows = [("p", "read", 0), ("q", "read", 1), ("p", "edit", 2), ("p", "read", 9), ("q", "edit", 4)]
    for p, k, s in rows:
        one = spark.createDataFrame([(p, k, NOW + dt.timedelta(seconds=s))], "project_id string, interaction string, timestamp timestamp_ntz")
        one.coalesce(1).write.mode("append").parquet(str(tmp_path / "log.parquet"))
    state = streams.first_and_last(streams.read_log(spark, str(tmp_path), "log", 1))
    got = {(r.project_id, r.interaction): ((r.last_us - r.first_us) // 1_000_000, r.n) for r in streams.run_once(state, "update", "state", ["project_id", "interaction"]).collect()}
    assert got == {("p", "read"): (9, 2), ("q", "read"): (0, 1), ("p", "edit"): (0, 1), ("q", "edit"): (0, 1)}
    with pytest.raises(ValueError):
        streams.run_once(state, "update", "state")


def test_index_runs(spark):
    from tidemark.operators import indexing

    def at(*rows):
        return spark.createDataFrame(rows, "project_id string, file_path string, text string").withColumn("file_hash", F.md5("text"))

    index = indexing.Index(
        spark.createDataFrame([(7, "p", "old.md", "content", "heading", "x", "markdown", 1, 1, "x"), (8, "z", "a.md", "content", "heading", "x", "markdown", 1, 1, "x")], "id bigint, project_id string, file_path string, chunk_domain string, chunk_type string, name string, language string, start_line int, end_line int, content string"),
        spark.createDataFrame([(7, [1.0]), (8, [1.0])], "id bigint, embedding array<float>"), spark.createDataFrame([(7, 8, "link", 1.0), (8, 8, "link", 1.0)], EDGES),
        spark.createDataFrame([("p", "old.md", "h", 1, None), ("z", "a.md", "h", 1, None)], "project_id string, file_path string, file_hash string, chunk_count int, last_indexed timestamp_ntz"),
        spark.createDataFrame([("p", None, None), ("z", None, "c9")], "id string, last_indexed timestamp_ntz, last_indexed_commit string"))
    files = at(("p", "a.md", "## One\n" + "text " * 60 + "\n## Two\n" + "text " * 60), ("p", "b.py", "def f():\n    return 1\n"), ("p", "c.bin", "x"), ("p", "d.md", " \n"), ("p", "e.md", None))
    heads = spark.createDataFrame([("p", "abc")], "project_id string, commit string")
    after, result = indexing.index_run(index, files, AS_OF, heads)
    assert tuple(result.first()) == ("p", 5, 5, 1, 3, 2, 1)
    chunks = sorted((r.id, r.project_id, r.file_path, r.chunk_domain, r.name) for r in after.chunks.collect())
    assert chunks == [(8, "z", "a.md", "content", "x"), (9, "p", "a.md", "content", "One"), (10, "p", "a.md", "content", "Two"), (11, "p", "b.py", "code", "f")]
    assert {r.id for r in after.vectors.collect()} == {8, 9, 10, 11} and [tuple(r)[:2] for r in after.edges.collect()] == [(8, 8)]
    assert {(r.project_id, r.file_path, r.chunk_count) for r in after.files.collect()} == {("z", "a.md", 1), ("p", "a.md", 2), ("p", "b.py", 1)}
    assert {(r.id, r.last_indexed is None, r.last_indexed_commit) for r in after.projects.collect()} == {("p", False, "abc"), ("z", True, "c9")}
    again, result = indexing.index_run(after, files, AS_OF)
    assert tuple(result.first()) == ("p", 5, 3, 0, 0, 0, 0) and sorted(again.chunks.collect()) == sorted(after.chunks.collect())
    assert indexing.index_run(after, files.limit(0), AS_OF)[1].count() == 0


def test_cross_search(spark):
    rows = [(1, "p", "alpha beta gamma"), (2, "p", "alpha delta"), (3, "q", "alpha beta"), (4, "r", "alphabet soup"), (5, "s", "beta")]
    chunks = spark.createDataFrame([(i, p, "content", t) for i, p, t in rows], "id bigint, project_id string, chunk_domain string, content string")
    none = spark.createDataFrame([], "id bigint, embedding array<float>")
    counts = spark.createDataFrame([(2, 20)], "chunk_id bigint, n bigint")
    known = spark.createDataFrame([(p,) for p in "pqr"], "id string")
    index = search.TextIndex(chunks)
    got = search.cross(index, none, counts, [(1, "alpha"), (2, "delta"), (3, " ")], chunks, ["q", "p", "s", "r"], known, limit=3)
    # Of r only the prefix search finds something; s is unknown; a list of one keeps its score.
    assert [(r.query_no, r.id, r.project_id, r.score) for r in got.orderBy("query_no", "rank").collect()] == [(1, 3, "q", 0.016393), (1, 2, "p", 0.016393), (1, 4, "r", 0.016393), (2, 2, "p", 0.116393)]
    keep = search.in_filter(chunks.withColumn("language", F.lit("x")).withColumn("file_path", F.lit("Docs/a.md")), project="p", language="x", file_pattern="docs/%.md")
    assert {r.id for r in keep.collect()} == {1, 2} and search.clamped(0) == 1 and search.clamped(99) == 50
