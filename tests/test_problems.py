"""References, sessions, incremental runs and skew helpers on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import components as comp, incremental as inc, references as ref, sessions as ses, skew
from tidemark.session import shared_path

T0 = dt.datetime(2025, 5, 1, 12, 0, 0)
MIN = dt.timedelta(minutes=1)


def chunks(spark, rows):
    return spark.createDataFrame(rows, "id bigint, created_at timestamp_ntz, project_id string, extra int")


def logs(spark, inter=(), search=(), edges=()):
    return (
        spark.createDataFrame(list(inter), "id bigint, chunk_id bigint, timestamp timestamp_ntz, chunk string"),
        spark.createDataFrame(list(search), "id bigint, result_chunk_ids string, timestamp timestamp_ntz"),
        spark.createDataFrame(list(edges), "source_id bigint, target_id bigint, edge_type string, metadata string"),
    )


def found(spark, ch, *tables):
    got = ref.orphans(ref.chunk_reference_tables(ch, *tables), ref.CHUNK_KEYS)
    return {(r.ref_table, r.ref_key, r.parent_key, r.reason, r.period) for r in got.collect()}


def test_references(spark):
    ch = chunks(spark, [(1, T0, "a", 0), (2, T0 + 60 * MIN, "a", 0), (3, None, "a", 0)])
    got = found(spark, ch, *logs(
        spark,
        [(10, 1, T0, ""), (11, 2, T0, ""), (12, 9, T0, ""), (13, 9, None, ""), (14, None, T0, ""), (15, 3, T0, ""), (16, 9, dt.datetime(1970, 1, 1), ""), (12, 9, T0, "")],
        [(20, '["9", "1", "9"]', T0), (21, "", T0), (22, None, T0), (23, " 8,1 ", None)],
        [(1, 7, "link", '{"built_at": "2025-06-01T00:00:00Z"}'), (1, 2, "tag", None), (1, 2, "link", '{"built_at": "2025-05-01T11:00:00"}')]))
    assert got == {
        ("chunk_interactions", "11", "2", "late", "2025-05"), ("chunk_interactions", "12", "9", "missing", "2025-05"), ("chunk_interactions", "13", "9", "missing", "unknown"),
        ("chunk_interactions", "16", "9", "missing", "unknown"), ("search_log", "20", "9", "missing", "2025-05"), ("search_log", "23", "8", "missing", "unknown"),
        ("edges", "1|7|link", "7", "missing", "2025-06"), ("edges", "1|2|link", "2", "late", "2025-05")}


def test_references_empty(spark):
    ch = chunks(spark, [])
    assert found(spark, ch, *logs(spark)) == set()
    assert len(found(spark, ch, *logs(spark, [(1, 1, T0, "")]))) == 1


def test_cascade(spark):
    mk = lambda rows, c: spark.createDataFrame(rows, f"key string, {c}").withColumn("time", F.lit(None).cast("timestamp"))
    ents = [
        ref.Entity("a", mk([("a1", "x")], "ak string")),
        ref.Entity("b", mk([("b1", "x", "k1"), ("b2", "gone", "k2")], "ak string, bk string")),
        ref.Entity("c", mk([("c1", "k2", "m1"), ("c2", "k1", "m2")], "bk string, ck string")),
        ref.Entity("d", mk([("d1", "m1"), ("d2", "m2"), ("d3", None), ("d4", "m9")], "ck string")),
    ]
    keys = [ref.ForeignKey("b", "ak", "a", "ak"), ref.ForeignKey("c", "bk", "b", "bk"), ref.ForeignKey("d", "ck", "c", "ck")]
    got = {(r.ref_table, r.ref_key, r.kind, r.depth) for r in ref.orphans(ents, keys).collect()}
    assert got == {("b", "b2", "direct", 0), ("c", "c1", "inherited", 1), ("d", "d1", "inherited", 2), ("d", "d4", "direct", 0)}


def test_cascade_ends_on_cycles(spark):
    rows = spark.createDataFrame([("1", "1", "2"), ("2", "2", "1"), ("3", "3", "9"), ("4", "4", "3")], "key string, id string, parent string").withColumn("time", F.lit(None).cast("timestamp"))
    got = ref.orphans([ref.Entity("t", rows)], [ref.ForeignKey("t", "parent", "t", "id")])
    assert {(r.ref_key, r.kind) for r in got.collect()} == {("3", "direct"), ("4", "inherited")}


def test_lookup_with_hot_keys(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("row")).unionByName(spark.createDataFrame([(None, -1)], "k bigint, row bigint"))
    dim = spark.createDataFrame([(7, "hot"), (1000, "cold")], "k bigint, v string")
    got = {r.row: r.v for r in skew.lookup(df, "k", dim, least=100).collect()}
    assert len(got) == 3001 and got[0] == "hot" and got[1000] == "cold" and got[1] is None and got[-1] is None


EVENTS = "id bigint, project_id string, timestamp timestamp_ntz, interaction string, file string, grp string"


def brute(rows):
    seen = {(p.strip().lower(), t, r) for r in rows for p, t in [(r[1], r[2])] if p is not None and t is not None and t.year >= 2000 and p.strip()}
    seen = {(p, t, r[1:]) for p, t, r in seen}
    out, last = [], {}
    for p, t, _ in sorted(seen, key=lambda x: (x[0], x[1], str(x[2]))):
        if p in last and t - last[p][1] <= 30 * MIN:
            last[p][1] = t
            last[p][2] += 1
        else:
            if p in last:
                out.append((p, *last[p]))
            last[p] = [t, t, 1]
    return sorted(out + [(p, *v) for p, v in last.items()])


def table_of(spark, *batches):
    s = ses.SessionTable(spark, shared_path(spark, "t"), "project_id", "timestamp", "interaction", ["file", "grp"], ["read", "edit"])
    for b in batches:
        s.apply(spark.createDataFrame(list(b), EVENTS))
    return s


def rows_of(df):
    epoch = dt.datetime(1970, 1, 1)
    return sorted((r.grp, epoch + dt.timedelta(microseconds=r.start_us), epoch + dt.timedelta(microseconds=r.end_us), r.n_events) for r in df.collect())


def test_sessions_incremental(spark):
    import random

    rng = random.Random(4)
    rows = []
    for i in range(400):
        t = T0 + dt.timedelta(minutes=rng.choice([0, 1, 5, 29, 30, 31, 700]) * rng.randrange(40), microseconds=rng.choice([0, 1]))
        rows.append((i, rng.choice(["a", " A", "b ", None, ""]), rng.choice([t, t, t, None, dt.datetime(1970, 1, 2)]), rng.choice(["read", "Edit", None]), rng.choice(["f", None]), "g"))
    rows += [(1000 + r[0], *r[1:]) for r in rows[::7]]  # logged twice, in a later batch
    want = brute(rows)
    s = table_of(spark, rows[:150], rows[150:300], [], rows[300:])
    assert rows_of(s.sessions()) == want
    df = spark.createDataFrame(rows, EVENTS)
    assert rows_of(ses.sessionize(df, "project_id", "timestamp", "interaction", ["file", "grp"], ["read"])) == want
    again = spark.createDataFrame(rows[:100], EVENTS)
    s.apply(again)
    assert rows_of(s.sessions()) == want


def test_sessions_bridge_and_border(spark):
    a = (1, "p", T0, "read", "f", "g")
    b = (2, "p", T0 + 60 * MIN, "edit", "f", "g")
    mid = (3, "p", T0 + 30 * MIN, "read", "f", "g")
    s = table_of(spark, [a, b])
    assert len(rows_of(s.sessions())) == 2
    s.apply(spark.createDataFrame([mid], EVENTS))
    (one,) = s.sessions().collect()
    assert (one.n_events, one.n_read, one.n_edit, one.end_us - one.start_us) == (3, 2, 1, 3_600_000_000)


def test_sessions_over_midnight(spark):
    day = dt.datetime(2025, 5, 1, 23, 50)
    s = table_of(spark, [(1, "p", day, "read", "f", "g"), (2, "p", day + 70 * MIN, "read", "f", "g")])
    s.apply(spark.createDataFrame([(3, "p", day + 20 * MIN, "read", "f", "g"), (4, "p", day + 45 * MIN, "read", "f", "g")], EVENTS))
    assert [r[3] for r in rows_of(s.sessions())] == [4]


def test_sessions_empty(spark):
    s = table_of(spark, [], [(1, None, T0, "read", "f", "g")])
    assert s.sessions().count() == 0


def test_manifest_conflict(spark):
    from tidemark.sources.manifest import ConflictError, Manifest

    m = Manifest(spark, shared_path(spark, "m"))
    assert m.current() == (0, {})
    m.commit(0, {"x": 1})
    with pytest.raises(ConflictError):
        m.commit(0, {"x": 2})
    assert m.current() == (1, {"x": 1})


def test_incremental_job_survives(spark):
    job = inc.IncrementalJob(spark, shared_path(spark, "j"))
    src = lambda n: spark.range(1, n + 1).withColumn("seq", F.col("id"))
    keep = lambda due: due.select("id")
    assert job.watermark() is None
    job.run(src(5), "seq", keep)
    with pytest.raises(RuntimeError):
        job.run(src(8), "seq", keep, fail_before_commit=True)
    assert job.watermark() == 5 and job.output("id bigint").count() == 5
    job.run(src(9), "seq", keep)
    job.run(src(9), "seq", keep)
    assert sorted(r.id for r in job.output("id bigint").collect()) == list(range(1, 10))
    job.run(src(0), "seq", keep)
    assert job.watermark() == 9


FILES = "project_id string, file_path string, file_hash string, t timestamp_ntz"


def test_file_changes(spark):
    scan = spark.createDataFrame([
        ("p", "./a.md", "AA", T0), ("p", "a.md", "bb", T0 - MIN), ("p", "b.md", "", T0), ("p", "b.md", "cc", T0 - MIN), ("p", "c.md", None, T0), ("p", "d.md", "dd", None),
        ("p", "e.md", "ee", T0), ("p", "e.md", "ee", T0), ("p", None, "ff", T0)], FILES).withColumnRenamed("t", "scanned_at")
    index = spark.createDataFrame([("p", "a.md", "aa", T0), ("p", "b.md", "xx", T0), ("p", "b.md", "cc", None), ("p", "e.md", "", T0)], FILES).withColumnRenamed("t", "last_indexed")
    got = {(r.item_key, r.change) for r in inc.file_changes(scan, index).collect()}
    assert got == {("b.md", "changed"), ("e.md", "new")}
    assert inc.file_changes(scan.limit(0), index).count() == 0


def test_commit_changes(spark):
    commits = spark.createDataFrame([("p", "abc1", 10), ("p", "abd2", 20), ("p", "ffff", 20), ("p", "eeee", 30), ("q", "1111", 5), ("p", "eeee", 30), ("q", None, 7), ("q", "2222", None), ("r", "77", 1)], "project_id string, hash string, timestamp bigint")
    projects = spark.createDataFrame([("p", "ABD"), ("q", "zz"), ("s", None)], "id string, last_indexed_commit string")
    got = {(r.project_id, r.item_key) for r in inc.commit_changes(commits, projects).collect()}
    assert got == {("p", "eeee"), ("q", "1111"), ("r", "77")}


def test_pending_items_in_runs(spark):
    """Late and equal times, a mark that comes late, a file that is changed back, and a run that breaks
    off: after each run the result is that of one pass over all that has arrived."""
    C = "project_id string, hash string, timestamp bigint"
    S = "project_id string, file_path string, file_hash string, scanned_at timestamp_ntz"
    index = spark.createDataFrame([("p", "a.md", "aa", T0), ("p", "b.md", "bb", T0)], FILES).withColumnRenamed("t", "last_indexed")
    projects = spark.createDataFrame([("p", "abd"), ("q", None)], "id string, last_indexed_commit string")
    commits = [
        [("p", "abc1", 10), ("p", "ffff", 30), ("q", "1111", 500), (None, "9999", 5)],
        [("p", "eeee", 30), ("p", "late", 20), ("q", "2222", 500), ("q", "3333", 1), ("p", "ffff", 30)],
        [("p", "abd2", 15), ("q", "4444", None), (None, "8888", 5)]]
    scans = [
        [("p", "./a.md", "xx", T0), ("p", "b.md", "bb", T0), ("q", "new.md", "11", T0 + 60 * MIN)],
        [("p", "a.md", "AA", T0 + MIN), ("p", "b.md", "cc", T0 - MIN), ("q", "late.md", "22", T0 - 60 * MIN), ("q", "same.md", "33", T0 + 60 * MIN), (None, "n.md", "44", T0)],
        [("p", "b.md", "dd", T0 + MIN), ("p", "c.md", "", T0)]]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    of = lambda df: sorted(map(str, df.select("item_kind", "project_id", "item_key", "change").collect()))
    a_scan = inc.Arrivals(spark, shared_path(spark, "s"), make([], S).schema)
    a_commits = inc.Arrivals(spark, shared_path(spark, "c"), make([], C).schema)
    job = inc.pending_items(spark, shared_path(spark, "p7"), a_scan, a_commits, index, projects)
    job.run()
    assert of(job.result()) == []
    for k in range(3):
        a_scan.add(make(scans[k], S)), a_commits.add(make(commits[k], C))
        if k == 1:
            with pytest.raises(RuntimeError):
                job.run(fail_before_commit=True)
        job.run()
        job.run()
        once = inc.file_changes(make(sum(scans[: k + 1], []), S), index).drop("time_us").unionByName(inc.commit_changes(make(sum(commits[: k + 1], []), C), projects).drop("time_us"))
        assert of(job.result()) == of(once), k


def test_components(spark):
    import random

    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(200, 200), (None, 3), (300, 301), (301, 300)] + [(rng.randrange(400, 460), rng.randrange(400, 460)) for _ in range(40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in comp.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert comp.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
