"""Views, stores and scalars, and traversals of whole graphs against brute force."""

import os
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from plait.functions import scalars
from plait.operators import artifacts, flowviews, review, traverse
from plait.plans import queries, views
from plait.sources import store
from plait.sources.tables import edges, nodes

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
VIEWS = [n for n, f in queries.QUERIES.items() if f.__module__ == views.__name__]


@tables
@pytest.mark.parametrize("name", VIEWS)
def test_views_equal_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{SF}/{file}'")
    text = lambda r: tuple(str(round(x, 6) if isinstance(x, float) else x) for x in r)
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cur = con.execute(queries.SQL[name])
    at = [[c[0] for c in cur.description].index(c) for c in columns]
    got = sorted(text(r[c] for c in columns) for r in df.collect())
    assert got and got == sorted(text(r[i] for i in at) for r in cur.fetchall())


@tables
def test_flows_of_the_whole_graph(spark):
    """Every flow against a queue in Python."""
    out = defaultdict(list)
    for r in edges(spark, SF).collect():
        out[r.source].append((r.edge_ord, r.target, r.type))
    want = set()
    for e in nodes(spark, SF).where("kind = 'endpoint'").select("id").collect():
        seen, queue = {e.id: 0}, deque([e.id])
        while queue:
            at = queue.popleft()
            if seen[at] == 6:
                continue
            for _, target, kind in sorted(out[at]):
                usable = kind in ("handles", "calls") if seen[at] == 0 else kind not in ("contains", "declares")
                if usable and target not in seen and len(seen) < 24:
                    seen[target] = seen[at] + 1
                    queue.append(target)
        want |= {(e.id, i + 1, n, d) for i, (n, d) in enumerate(seen.items())}
    got = {tuple(r) for r in queries.flows(spark, SF).select("flow_id", "step_idx", "node_id", "depth").collect()}
    assert len(want) > 5000 and got == want


def test_flows_by_kind_and_hubs(spark):
    rows = [("e", f"{i:03}", "handles", i) for i in range(200)] + [("c", f"{i:03}", "runs", i) for i in range(3)] + [("c", "no", "handles", 9)] + [("000", f"{i:03}", "calls", i) for i in range(200)]
    e = spark.createDataFrame(rows, "source string, target string, type string, edge_ord long")
    begun = spark.createDataFrame([("e", "endpoint"), ("c", "command"), ("x", "other")], "id string, kind string")
    got = traverse.flows(begun, e, first_types={"endpoint": ("handles",), "command": ("runs",)})
    count = {r.flow_id: r.n for r in got.groupBy("flow_id").agg(F.count("*").alias("n")).collect()}
    assert count == {"e": 24, "c": 24, "x": 1} and got.where("flow_id = 'c' AND node_id = 'no'").count() == 0
    assert [r.node_id for r in got.where("flow_id = 'c'").orderBy("step_idx").collect()] == ["c", *(f"{i:03}" for i in range(23))]


@tables
def test_components_of_the_whole_graph(spark):
    name = {}

    def root(x):
        while name.setdefault(x, x) != x:
            name[x] = x = name[name[x]]
        return x

    for r in edges(spark, SF).collect():
        a, b = root(r.source), root(r.target)
        name[max(a, b)] = min(a, b)
    want = {(x, root(x)) for x in list(name)}
    assert {tuple(r) for r in queries.graph_components(spark, SF).select("id", "component").collect()} == want and len(want) > 1000


def test_lens_and_evidence_by_hand(spark):
    steps = spark.createDataFrame([("f", 1, "a", 0), ("f", 2, "b", 1), ("f", 3, "c", 1), ("f", 4, "d", 2), ("g", 1, "z", 0)], "flow_id string, step_idx int, node_id string, depth int")
    e = spark.createDataFrame([("a", "b", "calls", "exact", 1), ("a", "c", "calls", "likely", 2), ("c", "d", "uses", "exact", 1), ("b", "d", "uses", "likely", 1), ("b", "c", "calls", "exact", 2), ("t", "d", "tests", "exact", 1)], "source string, target string, type string, confidence string, edge_ord long")
    got = {(r.flow_id, r.step_idx): (r.role, r.parent_idx, r.alternatives, r.fan_out, r.truncated) for r in flowviews.lens(steps, e, 12).collect()}
    assert got == {("f", 1): ("entry", None, 0, True, False), ("f", 2): ("step", 1, 0, False, False), ("f", 3): ("end", 1, 0, False, False), ("f", 4): ("end", 2, 1, False, False), ("g", 1): ("entry", None, 0, False, False)}
    assert {r.truncated for r in flowviews.lens(steps, e, 2).where("flow_id = 'f'").collect()} == {True}
    tests = spark.createDataFrame([("t",)], "id string")
    assert {tuple(r) for r in flowviews.evidence(steps, e, tests).collect()} == {("f", 4, 4, 2, 2, 1), ("g", 1, 0, 0, 0, 0)}
    assert flowviews.lens(steps.limit(0), e).count() == 0


def shuffled(spark, df):
    """MB of shuffles that ``df`` writes."""
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite() / 1e6
    before = written()
    df().write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return written() - before


def hub_flows(spark, n):
    """``n`` flows over one hub, and the edges to two steps below it."""
    steps = spark.range(n).select(F.col("id").alias("flow_id"), F.explode(F.array(*[F.struct(F.lit(i).alias("step_idx"), F.lit(x).alias("node_id"), F.lit(d).alias("depth")) for i, x, d in ((1, "hub", 0), (2, "x1", 1), (3, "x2", 1))])).alias("s")).select("flow_id", "s.*")
    out = spark.range(2000).select(F.lit("hub").alias("source"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("target"), F.lit("calls").alias("type"), F.lit("exact").alias("confidence"), F.col("id").alias("edge_ord"))
    return steps, out


def test_flows_list_no_targets_that_cannot_matter(spark):
    """The first of ten nodes fills each flow; the targets of the others are not joined."""
    rows = [(f"m{i}", f"t{i}-{j:02}", "calls", j) for i in range(10) for j in range(30)]
    e = spark.range(3000).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("source"), F.explode(F.array(*[F.struct(F.lit(f"m{i}").alias("target"), F.lit("handles").alias("type"), F.lit(i).cast("long").alias("edge_ord")) for i in range(10)])).alias("x")).select("source", "x.*")
    both = e.union(spark.createDataFrame(rows, e.schema))
    entries = e.select(F.col("source").alias("id")).distinct()
    assert shuffled(spark, lambda: traverse.flows(entries, both)) < 4
    assert traverse.flows(entries, both).where("step_idx > 11 AND node_id NOT LIKE 't0-%'").isEmpty()


def test_lens_of_hubs_lists_no_edges_by_flow(spark):
    steps, e = hub_flows(spark, 1000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as tables of any size are joined
    try:
        assert shuffled(spark, lambda: flowviews.lens(steps, e)) < 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_evidence_of_hubs_lists_no_tests_by_flow(spark):
    steps, e = hub_flows(spark, 1000)
    more = e.select(F.concat(F.lit("t"), "target").alias("source"), F.lit("hub").alias("target"), "type", "confidence", "edge_ord")
    tests = more.select(F.col("source").alias("id"))
    assert shuffled(spark, lambda: flowviews.evidence(steps, more, tests)) < 2
    assert {tuple(r)[1:] for r in flowviews.evidence(steps, more, tests).collect()} == {(3, 0, 0, 0, 2000)}


def test_tests_of_flows_by_brute_force(spark, monkeypatch):
    """Sets of more than one strip, and blocks in pieces."""
    import random

    monkeypatch.setattr(flowviews, "SET_ROWS", 20_000)
    rng = random.Random(5)
    touching = {(f"n{rng.randrange(20)}", f"t{rng.randrange(60_000)}") for _ in range(90_000)}
    on = [(f, i + 1, f"n{rng.randrange(24)}", i) for f in range(60) for i in range(rng.randint(1, 6))]
    e = spark.createDataFrame([(t, n, "tests", "exact", 1) for n, t in touching], "source string, target string, type string, confidence string, edge_ord long")
    steps = spark.createDataFrame(on, "flow_id long, step_idx int, node_id string, depth int")
    of = defaultdict(set)
    for n, t in touching:
        of[n].add(t)
    want = {f: len(set().union(*(of[n] for g, _, n, _ in on if g == f))) for f in range(60)}
    assert {r.flow_id: r.tests for r in flowviews.evidence(steps, e, e.selectExpr("source AS id")).collect()} == want


@tables
def test_evidence_keeps_few_files_of_shuffles(spark):
    """The most that files of shuffles take at once; with all pairs of steps shuffled it is several times as much."""
    import threading
    from pathlib import Path

    dirs = [str(x) for x in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    over, seen = threading.Event(), []

    def size():
        total = 0
        for f in (f for d in dirs for f in Path(d).rglob("shuffle_*.data")):
            try:
                total += f.stat().st_size
            except OSError:  # it went meanwhile
                pass
        return total / 1e6

    def watch():
        while not over.wait(0.05):
            seen.append(size())

    before, thread = size(), threading.Thread(target=watch)
    thread.start()
    try:
        queries.QUERIES["flow_evidence"](spark, SF.replace("0.001", "0.01")).write.format("noop").mode("overwrite").save()
    finally:
        over.set()
        thread.join()
    assert max(seen) - before < 5


@pytest.mark.parametrize("wide", [16, 0])
def test_transitions_of_flows_by_brute_force(spark, monkeypatch, wide):
    """Edges of several types, nodes at two steps of a level, null confidences, and nodes with many edges."""
    import random

    monkeypatch.setattr(flowviews, "WIDE", wide)
    rng = random.Random(3)
    links = [(f"n{rng.randrange(20)}", f"n{rng.randrange(20)}", rng.choice(["exact", "likely", "other", None])) for _ in range(300)] + [("n1", f"m{i}", "exact") for i in range(600)] + [(None, "n1", "exact"), ("n1", None, "exact")]
    on = [(f, i + 1, rng.choice([f"n{rng.randrange(20)}", f"m{rng.randrange(600)}", "n1", None]), min(i // 2, 2)) for f in range(60) for i in range(rng.randint(1, 8))]
    e = spark.createDataFrame([(*x, "calls", 1) for x in links], "source string, target string, confidence string, type string, edge_ord long")
    steps = spark.createDataFrame(on, "flow_id long, step_idx int, node_id string, depth int")
    want = {}
    for f in range(60):
        own = [(n, d) for g, _, n, d in on if g == f]
        kinds = [c for n, d in own for m, k in own if k == d + 1 for a, b, c in links if a is not None and b is not None and (a, b) == (n, m)]
        want[f] = (len(own), len(kinds), kinds.count("exact"), kinds.count("likely"), 0)
    got = {r.flow_id: tuple(r)[1:] for r in flowviews.evidence(steps, e, spark.createDataFrame([], "id string")).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 50


def test_artifacts_by_hand(spark):
    rows = [(1, "t", "k", 1, "x", ["p"], 1, 5), (2, "t", "k", 2, "y", ["*"], 1, 5), (3, "t", "l", 2, "y", ["q", "r"], 1, None)]
    r = spark.createDataFrame(rows, "record_id long, type string, key string, graph_version int, content_hash string, paths array<string>, created int, bytes long").withColumn("content", F.lit("c"))
    assert {(x.type, x.key) for x in artifacts.invalidate(r, spark.createDataFrame([("p",)], "path string")).collect()} == {("t", "k")}
    assert artifacts.invalidate(r, spark.createDataFrame([], "path string"), topology=True).count() == 2
    assert {(x.status, x.n, x.bytes) for x in artifacts.audit(r, 2).collect()} == {("superseded", 1, 5), ("current", 2, 5)}


def test_store_publishes_whole_versions(spark, tmp_path):
    s = store.GraphStore(spark, str(tmp_path / "graphs"))
    n = spark.createDataFrame([("a", "x"), ("b", None)], "id string, label string")
    e = spark.createDataFrame([("a", "b", "calls")], "source string, target string, type string")
    assert s.persist(n, e) == 1 == s.persist(n.orderBy(F.desc("id")), e)
    (tmp_path / "graphs" / "versions" / "2").touch()  # killed between creating and writing
    assert [r["version"] for r in s.versions()] == [1]
    with pytest.raises(Exception, match="(?i)exist"):
        s.persist(n.limit(1), e)
    assert s.read()[0].count() == 2
    (tmp_path / "graphs" / "versions" / "2").unlink()
    (tmp_path / "graphs" / "versions" / ".2.crc").unlink(missing_ok=True)
    assert s.persist(n.where("id = 'a'"), e.limit(0)) == 2
    assert {tuple(r) for r in s.delta(2).collect()} == {("node", "b", "removed"), ("edge", "a|b|calls", "removed")}


def test_scalars(spark):
    df = spark.createDataFrame([("2024-02-03T04:05:06+02:00", "abcdefgh", ["b", "a", None, "b"], "A B", None), ("no time", "ab", [], "x", "y")], "t string, s string, l array<string>, domain string, feature string")
    got = df.select(scalars.iso_time("t"), scalars.truncate(F.col("s"), 4), scalars.bounded_list(F.col("l"), 1), scalars.focus_matches("feature:A%20B:"), scalars.focus_matches("domain:x"), scalars.focus_matches("old:x")).collect()
    assert [tuple(r)[:2] for r in got] == [("2024-02-03T02:05:06.000Z", "abc…"), (None, "ab")]
    assert [tuple(r[2]) for r in got] == [(["a"], 2, True), ([], 0, False)]
    assert [tuple(r)[3:] for r in got] == [(True, False, False), (False, True, False)]
    assert scalars.canonical_json({"b": [{"z": 1, "a": None}], "a": "é"}) == '{"a":"é","b":[{"a":null,"z":1}]}'
    assert scalars.validate_scope({"version": 1, "projectId": "a-1", "exclude": ["dist"], "roots": ["src"]}) == []
    assert len(scalars.validate_scope({"version": 2, "projectId": "", "exclude": "x", "roots": ["/abs", "a/../b", ""], "more": 1})) == 7


def test_review_and_references(spark):
    s = spark.createDataFrame([(1, "t"), (2, None), (3, "u")], "id long, title string")
    p = spark.createDataFrame([(3, 1, "old", True), (3, 2, "new", True), (2, 9, "x", False)], "id long, time int, title string, current boolean")
    d = spark.createDataFrame([(1, 1, "rejected"), (1, 2, "accepted")], "id long, time int, decision string")
    assert [tuple(r) for r in review.queue(s, p, d).collect()] == [(3, "new", "agent-proposed", "agent"), (1, "t", "accepted", "decision"), (2, None, "abstained", "rule")]
