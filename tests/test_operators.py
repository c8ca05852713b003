"""Operators on small graphs written by hand, and all queries against DuckDB at the smallest scale."""

import os

import pytest
from pyspark.sql import functions as F

from plait.operators import filters, joins, journal, order, rank, rollup, traverse, version
from plait.plans import packets, queries
from plait.sources import extract, files, resolve

SF = "/root/testdata/sf0.001"


def edge_frame(spark, pairs, kind="calls"):
    return spark.createDataFrame([(a, b, kind, "exact", i + 1) for i, (a, b) in enumerate(pairs)], "source string, target string, type string, confidence string, edge_ord long")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_cycle_and_reach(spark):
    cycle = edge_frame(spark, [("1", "2"), ("2", "3"), ("3", "1"), ("3", "4"), ("4", "5")])
    seed = spark.createDataFrame([("1",)], "id string")
    assert rows(traverse.reach(seed, cycle, 6), "id", "distance") == [("1", 0), ("2", 1), ("3", 2), ("4", 3), ("5", 4)]
    assert rows(traverse.reach(seed, cycle, 1, reverse=True), "id", "distance") == [("1", 0), ("3", 1)]
    assert rows(traverse.on_cycle(cycle), "id") == [("1",), ("2",), ("3",)]
    assert traverse.on_cycle(edge_frame(spark, [("a", "b"), ("b", "c")])).count() == 0


def test_flow_order_depth_and_caps(spark):
    entry = spark.createDataFrame([("e",)], "id string")
    diamond = edge_frame(spark, [("e", "a"), ("e", "b"), ("a", "d"), ("b", "d"), ("d", "t"), ("t", "u")])
    blocked = spark.createDataFrame([("t",)], "id string")
    got = traverse.flows(entry, diamond, blocked, first_types=("calls",))
    assert rows(got, "step_idx", "node_id", "depth") == [(1, "e", 0), (2, "a", 1), (3, "b", 1), (4, "d", 2)]
    deep = edge_frame(spark, [(str(i), str(i + 1)) for i in range(8)])
    assert traverse.flows(spark.createDataFrame([("0",)], "id string"), deep, first_types=("calls",)).count() == 7
    wide = edge_frame(spark, [("e", f"{i:02}") for i in range(30)])
    got = rows(traverse.flows(entry, wide, first_types=("calls",)), "step_idx", "node_id")
    assert len(got) == 24 and got[-1] == (24, "22")
    assert traverse.flows(entry, wide).count() == 1


def test_components_and_closure(spark):
    e = edge_frame(spark, [("a", "b"), ("b", "c"), ("x", "y")])
    assert rows(traverse.components(spark, e), "id", "component") == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]
    ids = spark.createDataFrame([("b",), ("x",)], "id string")
    assert rows(traverse.closure(ids, e, spark.createDataFrame([("a",)], "id string"), ids), "id") == [("a",), ("b",)]


def test_last_wins(spark):
    df = spark.createDataFrame([("s", "t", 1, "first"), ("u", "v", 2, "x"), ("s", "t", 3, "last")], "source string, target string, ord long, evidence string")
    assert rows(joins.last_wins(df, ["source", "target"], "ord"), "source", "ord", "evidence") == [("s", 1, "last"), ("u", 2, "x")]


def test_versions(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None)], "id string, label string")
    new = spark.createDataFrame([("b", "y"), ("c", None), ("d", "x")], "id string, label string")
    assert rows(joins.compare(old, new, "id", ["label"]), "id", "change") == [("a", "removed"), ("b", "changed"), ("d", "added")]
    one, two = (version.fingerprint(f, ["id", "label"]).first() for f in (old, old.orderBy(F.desc("id")).repartition(3)))
    assert one == two and one != version.fingerprint(new, ["id", "label"]).first()
    assert (version.advance(3, "a", "a"), version.advance(3, "a", "b")) == (3, 4)
    ref = spark.range(1).select(version.context_ref("my project", F.lit("node"), F.lit("src/a b@1.ts"), F.lit(7)).alias("r")).select("r", version.parse_ref(F.col("r")).alias("p")).first()
    assert ref.r == "ref://local/my%20project/node/src%2Fa%20b%401.ts@7" and tuple(ref.p) == ("my project", "node", "src/a b@1.ts", 7)
    assert spark.range(1).select(version.parse_ref(F.lit("nothing")).alias("p")).first().p is None


def test_version_chain_with_a_gap(spark):
    records = spark.createDataFrame([("s", 1), ("s", 4), ("t", 3), ("s", 3), ("s", 9)], "subject string, version int")
    deltas = spark.createDataFrame([(2,), (4,)], "to_version int")
    touching = spark.createDataFrame([("t", 4)], "subject string, to_version int")
    assert rows(version.chain_status(records, deltas, touching, 4), "subject", "version", "status") == [("s", 1, "indeterminate"), ("s", 3, "compatible"), ("s", 4, "current"), ("s", 9, "future"), ("t", 3, "stale")]


def test_journal(spark):
    kinds = {"ok": ["run-started", "step-started", "step-passed", "run-passed"], "fail": ["run-started", "step-started", "step-failed", "run-failed"], "open": ["run-started", "step-started"]}
    events = spark.createDataFrame([(r, i, k, f"s{i}") for r, ks in kinds.items() for i, k in enumerate(ks)], "run_id string, sequence long, event_type string, step string")
    got = {r.run_id: (r.outcome, r.stopped_at) for r in journal.run_summary(events).collect()}
    assert got == {"ok": ("passed", None), "fail": ("failed", "s2"), "open": ("running", None)}
    assert rows(journal.rejections(events).where("reason <> 'accepted'"), "run_id", "sequence", "reason") == [("fail", 3, "after-end")]
    gap = spark.createDataFrame([("g", 0), ("g", 1), ("g", 3)], "run_id string, sequence long")
    assert rows(order.sequence_faults(gap, "run_id", "sequence"), "sequence", "expected") == [(3, 2)]
    ops = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("b", 1, 3), ("b", 2, 4), ("c", 1, 5)], "op string, v int, at int")
    assert rows(journal.append_once(ops, "op", ["v"], "at"), "op", "v", "status") == [("a", 1, "replayed"), ("b", 1, "conflict"), ("c", 1, "saved")]


def test_streaming_equals_batch(spark, tmp_path):
    from plait.streaming import journal as stream

    kinds = {"ok": ["run-started", "step-started", "run-passed"], "late": ["run-started", "run-passed", "step-started"]}
    schema = "run_id string, sequence long, event_type string"
    for k in range(3):
        spark.createDataFrame([(r, k, ks[k]) for r, ks in kinds.items()], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    events = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = {}
    stream.each_batch(stream.follow_runs(events), lambda df, _: seen.update({r.run_id: (r.n_events, r.outcome, r.rejected) for r in df.collect()}), str(tmp_path / "check"))
    assert seen == {"ok": (3, "passed", 0), "late": (2, "passed", 1)}


def test_greedy_walks(spark):
    sizes = spark.createDataFrame([(5, 10), (4, 100), (3, 30), (2, 5), (1, 5)], "v int, bytes long")
    assert rows(order.retain(sizes, [F.desc("v")], "bytes", 3, 50).where("kept"), "v") == [(2,), (3,), (5,)]
    items = spark.createDataFrame([("r", 1, 60), ("r", 2, 50), ("r", 3, 40)], "request string, rank int, size long")
    assert rows(packets.pack(items, "request", "rank", "size", 100).where("included"), "rank") == [(1,), (3,)]


def test_ratios_and_readiness(spark):
    df = spark.createDataFrame([(1, 3), (1, 0)], "a int, b int")
    assert [r[0] for r in df.select(rollup.ratio(F.col("a"), F.col("b"))).collect()] == [0.3333, None]
    none = rollup.readiness(spark.createDataFrame([], "record_id int, depends_on int"), spark.createDataFrame([], "record_id int, state string"), spark.createDataFrame([(1,)], "record_id int"))
    assert none.first().ready_to_start


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(rank.singular(F.lit(w))) for w in ("entries", "status", "class", "users", "user")] == ["entry", "status", "class", "user", "user"]
    assert one(rank.confidence(F.lit(True), F.lit(True), F.lit(1.0), F.lit(True), F.lit(False), F.lit(False))).level == "high"
    assert one(rank.title_case(F.lit("order_list-view"))) == "Order List View"
    assert [one(rank.route_title(F.lit(m), F.lit(r))) for m, r in (("GET", "/api/v2/orders"), ("GET", "/orders/:id"), ("POST", "/users"), ("GET", "/api/v1"))] == ["List Orders", "Get Order", "Create User", None]
    assert [one(rank.route_title(F.lit(m), F.lit(r))) for m, r in (("POST", "/login"), ("POST", "/invites/:id/approve"), ("GET", "/healthz"), ("GET", "/files/*rest"), ("OPTIONS", "/x"))] == ["Sign In", "Approve Invite", "Check Healthz", None, "Handle OPTIONS X"]
    assert one(rank.overlap_score(F.lit("The parser of é files"), F.lit("parser THE é"))) == 12 + 4 + 4
    assert one(rank.shared_depth(F.lit("src/a/b.ts"), F.lit("src/a/c/d.ts"))) == 2
    assert one(rank.occurrences(F.lit("aaaa"), "aa")) == 2
    lcs = rank.longest_ordered_match(spark.createDataFrame([(1, list("abcbdab"), list("bdcaba")), (2, None, ["x"])], "id int, a array<string>, b array<string>"), "id", "a", "b")
    assert rows(lcs, "id", "expected_n", "matched") == [(1, 7, 4), (2, 0, 0)]


def test_paths(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    classes = [one(filters.path_class(F.lit(p), ["gen/**/*.ts"], ["src"])) for p in ("gen/a/b.ts", "src/__tests__/a.ts", "src/fixtures/test/a.ts", "src/dist/a.js", "lib/a.ts", "src/a.ts", "src/a.spec.ts")]
    assert classes == ["excluded", "test", "fixture", "generated", "excluded", "application", "test"]
    assert [one(filters.domain_of(F.lit(p))) for p in ("packages/core/a.ts", "x/src/api/a.ts", "lib/a.ts", "a.ts")] == ["Core", "Api", "Lib", "Project"]
    assert [one(filters.feature_of(F.lit(p))) for p in ("src/app/api/users/route.ts", "src/app/[id]/page.ts", "src/components/x.ts", "src/lib/db/x.ts", "src/a.ts", "src/billing/a.ts")] == ["api/users", "pages/root", "ui/components", "library/db", "project", "billing"]
    assert [one(resolve.fold_path(F.lit(p))) for p in ("a/./b/../c", "../a", "a//b")] == ["a/c", None, "a/b"]
    assert [one(extract.framework_route(F.lit(p))) for p in ("app/(shop)/items/[id]/route.ts", "src/routes/a/[...all]/+server.js", "src/a.ts")] == ["/items/:id", "/a/*all", None]
    assert [one(filters.normalise_path(F.lit(p), "/repo")) for p in ("./a\\b.ts", "/repo/x/y", "a/../b", "")] == ["a/b.ts", "x/y", None, None]
    assert [one(filters.file_type(F.lit(p))) for p in ("a/x.d.ts", "a/x.test.ts", "a/user.service.ts", "a/x.ts")] == ["declaration", "test", "service", "module"]


def test_resolution(spark):
    there = spark.createDataFrame([("src/a.ts",), ("src/lib/index.ts",), ("src/util.js",), ("lib/x.ts",)], "path string")
    imports = spark.createDataFrame([("src/b.ts", "./a"), ("src/b.ts", "./lib"), ("src/b.ts", "../lib/x"), ("src/b.ts", "@/util"), ("src/b.ts", "./none"), ("src/b.ts", "../../out")], "path string, specifier string")
    got = {r.specifier: r.target for r in resolve.relative(imports, there, {"@/": "src/"}).collect()}
    assert got == {"./a": "src/a.ts", "./lib": "src/lib/index.ts", "../lib/x": "lib/x.ts", "@/util": "src/util.js", "./none": None}
    configs = spark.createDataFrame([("",), ("src/deep",)], "folder string")
    paths = spark.createDataFrame([("src/deep/er/a.ts",), ("src/b.ts",)], "path string")
    assert rows(resolve.nearest_config(paths, configs), "path", "config") == [("src/b.ts", ""), ("src/deep/er/a.ts", "src/deep")]
    patterns = spark.createDataFrame([("c", "@app/*", "src/*"), ("c", "@app/core/*", "core/src/*"), ("c", "exact", "src/exact")], "config string, pattern string, target string")
    asked = spark.createDataFrame([("p", "@app/core/x", "c"), ("p", "@app/y", "c"), ("p", "exact", "c"), ("p", "other", "c")], "path string, specifier string, config string")
    assert rows(resolve.by_pattern(asked, patterns), "specifier", "base") == [("@app/core/x", "core/src/x"), ("@app/y", "src/y"), ("exact", "src/exact")]


def test_extraction_from_files(spark, tmp_path):
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    (tmp_path / "src" / "node_modules" / "x.js").write_text("import 'y'")
    (tmp_path / "src" / "app.py").write_text("import os\r\nfrom lib import save as keep\n\n@app.get('/items')\ndef items(request):\n    return keep(os)\n\n\ndef local(keep):\n    return keep()\n")
    (tmp_path / "src" / "bad.py").write_text("def (:\n")
    (tmp_path / "src" / "web.ts").write_text("import { a } from './a'\nexport function run() { fetch('/items', { method: 'POST' }) }\nrouter.get('/x', run)\ncron.schedule('0 5 * * *', run)\ncron.schedule('bad', run)\n")
    scanned = files.scan(spark, str(tmp_path))
    assert rows(scanned, "path", "language") == [("src/app.py", "python"), ("src/bad.py", "python"), ("src/web.ts", "typescript")]
    parsed = extract.extract(scanned)
    assert rows(parsed, "path", "status") == [("src/app.py", "parsed"), ("src/bad.py", "parse-failed"), ("src/web.ts", "parsed")]
    got = set(rows(extract.facts(parsed), "path", "fact", "name"))
    assert {("src/app.py", "import", "os"), ("src/app.py", "endpoint", "GET /items"), ("src/app.py", "call", "keep"), ("src/app.py", "symbol", "local"), ("src/web.ts", "request", "POST /items"), ("src/web.ts", "endpoint", "GET /x"), ("src/web.ts", "schedule", "0 5 * * *"), ("src/web.ts", "unsupported", "bad"), ("src/web.ts", "import", "./a")} <= got
    assert len([g for g in got if g[1] == "call"]) == 1
    assert files.coverage(scanned.join(parsed, "path")).where("language is null").first().failed == 1


def test_package_scripts(spark):
    text = '{"scripts": {"go": "node run.js", "all": "a && b", "opt": "node -v", "out": "node ../x.js", "odd": "make x", "long": "node a b"}}'
    got = {r.script: r.status for r in extract.package_scripts(spark.createDataFrame([("package.json", text)], "path string, text string")).collect()}
    assert got == {"go": "supported", "all": "shell-syntax-or-quoting", "opt": "missing-literal-source-target", "out": "target-outside-repository", "odd": "unsupported-direct-runner", "long": "not-a-direct-runner-and-source-target"}


def test_divergence(spark):
    commits = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "b")], "commit string, parent string")
    assert [packets.divergence(commits, *x) for x in (("c", "c", False), ("c", "c", True), ("a", "c", False), ("c", "a", False), ("c", "d", False))] == ["exact", "working-tree-changed", "ahead", "behind", "diverged"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_queries_equal_duckdb(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    text = lambda r: tuple(str(round(x, 6) if isinstance(x, float) else x) for x in r)
    for name in ("domain_rollup", "group_edges", "hierarchy_rollup", "impact_dependents", "run_summary", "graph_delta", "version_chain", "token_overlap", "relative_imports", "budget_packing"):
        df = queries.QUERIES[name](spark, SF)
        columns = sorted(df.columns)
        cur = con.execute(queries.SQL[name])
        at = [[c[0] for c in cur.description].index(c) for c in columns]
        assert sorted(text(r[c] for c in columns) for r in df.collect()) == sorted(text(r[i] for i in at) for r in cur.fetchall()), name


def test_cooccurrence_counts_all_tokens(spark):
    import random

    rng = random.Random(5)
    held = {k: {"x", *rng.sample("abcdef", rng.randint(1, 3))} for k in range(260)} | {300: {"x"}, 301: {"y", "z"}, 302: {"q"}}
    want = set()
    for a, own in held.items():
        others = sorted((-len(own & x), b) for b, x in held.items() if b != a and len(own & x) >= 2)[:12]
        want |= {(a, b, -n, i + 1) for i, (n, b) in enumerate(others)}
    rows = [(k, t) for k, ts in held.items() for t in ts] * 2 + [(1, None)]
    got = joins.cooccurrence(spark.createDataFrame(rows, "k long, t string"), "k", "t")
    assert got.columns == ["a", "b", "shared", "rank"]
    assert {tuple(r) for r in got.collect()} == want and len(want) > 12 * 250
    # As long as a token is held by more keys than any cut, it still counts.
    wide = spark.range(1500).selectExpr("id as k", "explode(array('v', 'w')) as t")
    assert joins.cooccurrence(wide, "k", "t").count() == 12 * 1500
