"""The graph of chunks: edges from links, tags, categories and imports, ranks, neighbours, groups."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.operators.search import usable_vectors
from tidemark.operators.skew import lookup
from tidemark.operators.store import delete_edges, json_patch
from tidemark.session import cut, written


def folder_of(path: Column) -> Column:
    """The folder of a path; ``.`` for a bare name."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def joined_path(folder: Column, name: Column) -> Column:
    """A path below a folder; single-dot parts and repeated slashes vanish, double dots stay."""
    raw = F.when(name.startswith("/"), name).when(folder == ".", name).otherwise(F.concat(folder, F.lit("/"), name))
    parts = F.filter(F.split(raw, "/"), lambda p: (p != ".") & (p != ""))
    return F.concat(F.when(raw.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(parts, "/"))


def _to_targets(refs: DataFrame, chunks: DataFrame, edge_type: str) -> DataFrame:
    """Edges from ``source_id, project_id, path`` to all chunks of the file of that path."""
    target = chunks.select(F.col("id").alias("target_id"), "project_id", F.col("file_path").alias("path"))
    return refs.distinct().join(target, ["project_id", "path"]).select("source_id", "target_id", F.lit(edge_type).alias("edge_type"), F.lit(1.0).alias("weight")).distinct()


def link_edges(chunks: DataFrame) -> DataFrame:
    """Edges from Markdown links to the chunks of the file they name; web, mail and fragment links
    are skipped."""
    href = F.explode(F.regexp_extract_all("content", F.lit(r"\[[^\]]+\]\(([^)]+)\)"), F.lit(1)))
    h = chunks.select(F.col("id").alias("source_id"), "project_id", "file_path", href.alias("href")).where(~F.col("href").rlike("^(https?://|#|mailto:)"))
    return _to_targets(h.select("source_id", "project_id", joined_path(folder_of(F.col("file_path")), F.col("href")).alias("path")), chunks, "link")


def _metadata(chunks: DataFrame, key: str) -> DataFrame:
    values = F.array_distinct(F.from_json(F.get_json_object("metadata", f"$.{key}"), "array<string>"))
    return chunks.select("id", "project_id", "file_path", values.alias("v")).where(F.size("v") > 0)


def tag_edges(chunks: DataFrame, least: int = 2) -> DataFrame:
    """Pairs of chunks of one file that share at least ``least`` tags, weighted by the Jaccard index.

    Pairs meet on a shared tag of the file, so chunks without a common tag are never paired.
    """
    m = _metadata(chunks, "tags")
    t = m.select("id", "project_id", "file_path", F.size("v").alias("n"), F.explode("v").alias("tag"))
    a, b = t.alias("a"), t.alias("b")
    same = (F.col("a.project_id") == F.col("b.project_id")) & (F.col("a.file_path") == F.col("b.file_path")) & (F.col("a.tag") == F.col("b.tag")) & (F.col("a.id") < F.col("b.id"))
    both = a.join(b, same).groupBy(F.col("a.id").alias("source_id"), F.col("b.id").alias("target_id"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return both.select("source_id", "target_id", F.lit("tag").alias("edge_type"), F.round(F.col("n") / (F.col("na") + F.col("nb") - F.col("n")), 4).alias("weight"))


def category_edges(chunks: DataFrame) -> DataFrame:
    """Pairs of chunks of one file with a category in common."""
    t = _metadata(chunks, "categories").select("id", "project_id", "file_path", F.explode("v").alias("c"))
    a, b = t.alias("a"), t.alias("b")
    same = (F.col("a.project_id") == F.col("b.project_id")) & (F.col("a.file_path") == F.col("b.file_path")) & (F.col("a.c") == F.col("b.c")) & (F.col("a.id") < F.col("b.id"))
    return a.join(b, same).select(F.col("a.id").alias("source_id"), F.col("b.id").alias("target_id"), F.lit("category").alias("edge_type"), F.lit(1.0).alias("weight")).distinct()


#: The suffixes tried for a script import without one.
JS_SUFFIXES = (".ts", ".tsx", ".js", ".jsx")


def python_modules(text: Column) -> Column:
    """The modules that import statements at the start of a line name, one per statement."""
    words = F.transform(F.split(text, r"\r?\n", -1), lambda line: F.split(line, r"\s+", 4))
    third = lambda w: F.coalesce(F.get(w, F.lit(2)), F.lit(""))
    named = F.filter(words, lambda w: (F.size(w) > 1) & ((w[0] == "import") | ((w[0] == "from") & (third(w) == "import"))))
    return F.filter(F.transform(named, lambda w: F.regexp_extract(w[1], r"^[\p{L}\p{N}_.]+", 0)), lambda m: m != "")


def script_paths(text: Column) -> Column:
    """The relative paths that a script imports or requires."""
    statements = F.filter(F.split(text, r"\r?\n", -1), lambda line: line.rlike(r"\bimport\s.*\sfrom\s|\brequire\s*\("))
    quoted = F.flatten(F.transform(statements, lambda line: F.regexp_extract_all(line, F.lit(r"(?:\sfrom\s+|\brequire\s*\(\s*)[\"'](\.[^\"']*)[\"']"), F.lit(1))))
    return quoted


def import_targets(chunks: DataFrame) -> DataFrame:
    """``source_id, project_id, path``: the files that imports of code chunks may name."""
    code = chunks.where("chunk_domain = 'code'").select(F.col("id").alias("source_id"), "project_id", folder_of(F.col("file_path")).alias("dir"), F.col("content").alias("text"))
    modules = code.select("source_id", "project_id", "dir", F.explode(python_modules(F.col("text"))).alias("m"))
    py = modules.select("source_id", "project_id", joined_path(F.col("dir"), F.concat(F.replace("m", F.lit("."), F.lit("/")), F.lit(".py"))).alias("path"))
    js = code.select("source_id", "project_id", "dir", F.explode(script_paths(F.col("text"))).alias("m")).select("source_id", "project_id", joined_path(F.col("dir"), F.col("m")).alias("path"))
    bare = ~F.col("path").rlike(r"[^/]\.[^./]+$")
    js = js.select("source_id", "project_id", F.explode(F.when(bare, F.array(*(F.concat("path", F.lit(s)) for s in JS_SUFFIXES))).otherwise(F.array("path"))).alias("path"))
    return py.unionByName(js)


def import_edges(chunks: DataFrame) -> DataFrame:
    """Edges from code chunks to the chunks of the files they import."""
    return _to_targets(import_targets(chunks), chunks, "import")


def semantic_edges(vectors: DataFrame, queries: DataFrame, k: int = 20, threshold: float = 0.75, block: int = 1024) -> DataFrame:
    """Edges from each query chunk to its ``k`` nearest vectors (itself among them, but without an
    edge) whose similarity 1 - d²/2 reaches the threshold.

    Exact: the stated queries are cut into blocks, every block meets every batch of vectors once,
    and each batch passes on its best ``k`` per query.
    """
    v = usable_vectors(vectors)
    q = v.join(queries.select("id").distinct(), "id", "left_semi")
    n = max(1, -(-q.count() // block))
    q = q.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # (block, slice) cells: queries go to every slice, vectors to every block.
    left = q.select("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("cell"), "id", "v", F.lit(True).alias("is_query"))
    right = v.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(parts)).cast("int").alias("cell"), "id", "v", F.lit(False).alias("is_query"))

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        isq = pdf["is_query"].to_numpy()
        out = []
        if isq.any() and not isq.all():
            x, xi = np.vstack(pdf["v"][isq]), pdf["id"].to_numpy()[isq]
            y, yi = np.vstack(pdf["v"][~isq]), pdf["id"].to_numpy()[~isq]
            yy = (y**2).sum(1)
            for lo in range(0, len(x), 128):
                d2 = np.maximum(0, (x[lo : lo + 128] ** 2).sum(1)[:, None] + yy[None] - 2 * (x[lo : lo + 128] @ y.T))
                for r in range(len(d2)):
                    order = np.lexsort((yi, np.round(d2[r], 9)))[:k]
                    out.append(pd.DataFrame({"source_id": xi[lo + r], "target_id": yi[order], "d2": d2[r][order]}))
        return pd.concat(out) if out else pd.DataFrame({"source_id": [], "target_id": [], "d2": []}).astype({"source_id": "int64", "target_id": "int64", "d2": "float64"})

    got = left.unionByName(right).groupBy("block", "cell").applyInPandas(near, "source_id bigint, target_id bigint, d2 double")
    got = got.withColumn("place", F.row_number().over(W.partitionBy("source_id").orderBy(F.round("d2", 9), "target_id"))).where((F.col("place") <= k) & (F.col("source_id") != F.col("target_id")))
    got = got.withColumn("sim", 1 - F.col("d2") / 2).where(F.round("sim", 9) >= threshold)
    return got.select("source_id", "target_id", F.lit("semantic").alias("edge_type"), F.round("sim", 4).alias("weight"))


#: Edge types and what derives them from the present chunks; semantic edges come from vectors.
DERIVED = {"link": link_edges, "tag": tag_edges, "category": category_edges, "import": import_edges}


def rebuilt_edges(edges: DataFrame, chunks: DataFrame, vectors: DataFrame, queries: DataFrame, types: tuple[str, ...] = (*DERIVED, "semantic"), project: str | None = None) -> tuple[DataFrame, DataFrame]:
    """All edges after the derived ones of the given types are built anew, and the new ones alone.

    With a project its chunks' edges go, at whatever end, and only its chunks are read; otherwise all
    edges go. Semantic edges are those of ``queries``. No types change nothing."""
    if not types:
        return edges, edges.limit(0).select("source_id", "target_id", "edge_type", "weight")
    own = chunks if project is None else chunks.where(F.col("project_id") == project)
    parts = [f(own) for t, f in DERIVED.items() if t in types]
    if "semantic" in types:
        parts.append(semantic_edges(vectors, queries.join(own.select("id"), "id", "left_semi")))
    new = reduce(DataFrame.unionByName, parts).groupBy("source_id", "target_id", "edge_type").agg(F.max("weight").alias("weight"))
    kept = edges.limit(0) if project is None else delete_edges(edges, own)[0]
    return kept.select("source_id", "target_id", "edge_type", "weight").unionByName(new), new


def project_edges(edges: DataFrame, chunks: DataFrame, project: str) -> DataFrame:
    """Edges whose source is a chunk of the project."""
    return edges.join(chunks.where(F.col("project_id") == project).select(F.col("id").alias("source_id")), "source_id", "left_semi")


def neighbours(edges: DataFrame, chunks: DataFrame, starts: DataFrame, depth: int = 2, types: list[str] | None = None) -> DataFrame:
    """``start, id, depth``: chunks within 1 to 3 steps over edges in either direction, each with its
    smallest depth, and existing chunks only. ``starts``: start."""
    depth = max(1, min(3, depth))
    e = edges if types is None else edges.where(F.col("edge_type").isin(*types))
    two = e.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).union(e.select("target_id", "source_id")).where("a <> b").distinct()
    seen = starts.select("start", F.col("start").alias("id"), F.lit(0).alias("depth")).distinct()
    front = seen
    for k in range(1, depth + 1):
        step = front.join(two, front["id"] == two["a"]).select("start", F.col("b").alias("id")).distinct()
        front = step.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("depth", F.lit(k))
        if k < depth:
            front = written(front, "front")
        seen = seen.unionByName(front)
    return seen.where("depth > 0").join(chunks.select("id"), "id", "left_semi")


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, alpha: float = 0.85, tol: float = 1e-6, most: int = 100) -> DataFrame:
    """``id, rank`` over the weighted, directed graph, rounded to six places. Null weights count as 1;
    of edges with the same ends the one of the greatest type counts. ``nodes`` (id) names what is in the
    graph besides the ends of edges. Nodes without outgoing edges spread their rank evenly.

    Ends when the ranks change by less than ``tol`` times the number of nodes in all; a graph that is not
    there after ``most`` rounds is an error."""
    e = edges.groupBy("source_id", "target_id").agg(F.max_by(F.coalesce("weight", F.lit(1.0)), "edge_type").alias("w"))
    whole = e.groupBy("source_id").agg(F.sum("w").alias("whole"))
    e = written(lookup(e, "source_id", whole).select("source_id", "target_id", (F.col("w") / F.col("whole")).alias("p")), "edges")
    ids = e.select(F.col("source_id").alias("id")).union(e.select("target_id"))
    ids = (ids if nodes is None else ids.union(nodes.select("id"))).distinct()
    own = ids.join(e.select(F.col("source_id").alias("id"), F.lit(True).alias("out")).distinct(), "id", "left")
    state = written(own, "nodes")
    n, loose = state.agg(F.count(F.lit(1)), F.count_if(F.col("out").isNull())).first()
    if not n:
        return edges.sparkSession.createDataFrame([], "id bigint, rank double")
    state, loose = state.withColumn("rank", F.lit(1.0 / n)), loose / n
    for _ in range(most):
        got = state.join(e, state["id"] == e["source_id"]).groupBy(F.col("target_id").alias("id")).agg(F.sum(F.col("rank") * F.col("p")).alias("got"))
        new = state.join(got, "id", "left").select("id", "out", F.col("rank").alias("old"), (alpha * F.coalesce("got", F.lit(0.0)) + alpha * loose / n + (1 - alpha) / n).alias("rank"))
        new = cut(new)
        change, loose = new.agg(F.sum(F.abs(F.col("rank") - F.col("old"))), F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("rank"))), F.lit(0.0))).first()
        state = new.drop("old")
        if change < n * tol:
            return state.select("id", F.round("rank", 6).alias("rank"))
    raise RuntimeError(f"the ranks still change after {most} rounds")


def undirected(edges: DataFrame) -> DataFrame:
    """``a, b, w`` with a < b: of edges between the same two chunks, in whatever direction, the one of the
    greatest type and source counts. Null weights count as 1, edges to oneself are left out."""
    w = F.coalesce("weight", F.lit(1.0))
    ends = edges.where("source_id <> target_id").select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), w.alias("w"), F.struct("edge_type", "source_id").alias("o"))
    return ends.groupBy("a", "b").agg(F.max_by("w", "o").alias("w"))


#: Rounds of local moves after which the modularity must have risen, and by how much at least.
CHECKED, RISE = 3, 2e-3


def _moved(two: DataFrame, deg: DataFrame, m2: float) -> tuple[DataFrame, bool]:
    """Local moves on one level: ``id, c`` and whether anything moved. ``two``: a, b, w in both
    directions; ``deg``: id, k.

    Every round each node compares the modularity gain of joining its neighbours' groups. Half of the
    nodes move at once, the other half in the next round, and every two rounds the halves are drawn anew,
    so that neighbours do not swap for ever. Ends when two rounds in a row moved nothing. Moves at once
    can undo each other: every ``CHECKED`` rounds the modularity must have risen by ``RISE``, or the best
    state seen counts. Modularity is below 1, so there is an end."""
    lab, start = deg.select("id", F.col("id").alias("c"), "k"), None
    best, best_q, still, r = lab, None, 0, 0

    def modularity_of(lab):
        ends = two.join(lab.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(lab.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b")
        inner = ends.agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)) / m2).first()[0] or 0.0
        return inner - lab.groupBy("c").agg(F.sum("k").alias("s")).agg(F.sum(F.pow(F.col("s") / m2, F.lit(2)))).first()[0]

    start = best_q = modularity_of(lab)
    while still < 2:
        size = lab.groupBy("c").agg(F.sum("k").alias("s"))
        near = two.join(lab.select(F.col("id").alias("b"), "c"), "b").groupBy(F.col("a").alias("id"), "c").agg(F.sum("w").alias("kin"))
        own = lab.select("id", F.col("c").alias("mine"), "k")
        gain = near.join(own, "id").join(size, "c").withColumn("gain", F.col("kin") - F.col("k") * (F.col("s") - F.when(F.col("c") == F.col("mine"), F.col("k")).otherwise(0.0)) / m2)
        top = gain.groupBy("id").agg(F.max(F.struct(F.round("gain", 9).alias("g"), (-F.col("c")).alias("c"))).alias("b"), F.max(F.when(F.col("c") == F.col("mine"), F.round("gain", 9))).alias("stay"))
        turn = F.pmod(F.xxhash64(F.lit(r // 2), "id") + r, F.lit(2)) == 0
        state = lab.join(top, "id", "left").join(size, "c").withColumn("stay0", F.coalesce("stay", -F.col("k") * (F.col("s") - F.col("k")) / m2))
        go = F.coalesce(turn & (F.col("b.g") > F.col("stay0") + 1e-9), F.lit(False))
        new = cut(state.select("id", F.when(go, -F.col("b.c")).otherwise(F.col("c")).alias("c"), "k", go.alias("go")))
        lab, r = new.drop("go"), r + 1
        still = still + 1 if new.where("go").isEmpty() else 0
        if still == 2 or r % CHECKED == 0:
            q, least = modularity_of(lab), best_q + RISE
            best, best_q = (lab, q) if q > best_q else (best, best_q)
            if q <= least:
                break
    return best.select("id", "c"), best_q > start + 1e-9


def communities(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``id, community``: groups of the undirected, weighted graph by modularity, level by level: local
    moves to rest, then each group becomes a node whose edges are those of its members, and again until
    nothing moves. A group is named by its smallest member. ``nodes`` (id) names what is in the graph
    besides the ends of edges; nodes without an edge are groups of their own."""
    und = undirected(edges)
    two = written(und.select("a", "b", "w").union(und.select("b", "a", "w")), "edges")
    deg = written(two.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k")), "degrees")
    ids = edges.select(F.col("source_id").alias("id")).union(edges.select("target_id"))
    ids = (ids if nodes is None else ids.union(nodes.select("id"))).where("id IS NOT NULL").distinct()
    m2 = deg.agg(F.sum("k")).first()[0]
    group = deg.select("id", F.col("id").alias("c"))
    moved = bool(m2)
    while moved:
        step, moved = _moved(two, deg, m2)
        if not moved:
            break
        name = step.groupBy("c").agg(F.min("id").alias("name"))
        step = cut(step.join(name, "c").select("id", F.col("name").alias("c")))
        group = cut(group.withColumnRenamed("c", "at").join(step.withColumnRenamed("id", "at"), "at").select("id", "c"))
        ends = two.join(step.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(step.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b")
        two = cut(ends.where("ca <> cb").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")))
        deg = cut(deg.join(step, "id").groupBy(F.col("c").alias("id")).agg(F.sum("k").alias("k")))
    return ids.join(group, "id", "left").select("id", F.coalesce("c", "id").alias("community"))


def modularity(edges: DataFrame, groups: DataFrame) -> float:
    """The modularity of a partition, for tests and reports."""
    und = undirected(edges)
    ga, gb = groups.select(F.col("id").alias("a"), F.col("community").alias("ca")), groups.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    e = und.join(ga, "a").join(gb, "b")
    m, inner = e.agg(F.sum("w"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0))).first()
    ends = e.select(F.col("ca").alias("c"), "w").union(e.select("cb", "w")).groupBy("c").agg(F.sum("w").alias("d"))
    return inner / m - ends.agg(F.sum(F.pow(F.col("d") / (2 * m), F.lit(2)))).first()[0]


def with_graph_metadata(chunks: DataFrame, ranks: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """``id, metadata``: the chunks' JSON metadata with ``pagerank`` and ``community_id`` merged in, other
    values as they are."""
    j = chunks.select("id", "metadata").join(ranks.select("id", F.col("rank").alias("pagerank")), "id", "left")
    names = ["pagerank"]
    if groups is not None:
        j = j.join(groups.select("id", F.col("community").alias("community_id")), "id", "left")
        names.insert(0, "community_id")
    return j.select("id", json_patch("metadata", F.to_json(F.struct(*names))).alias("metadata"))
