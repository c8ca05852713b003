"""Queries of flow views, artifacts, reviews, scalars and the graph store, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import artifacts, filters, flowviews, review, version
from ..session import scratch_path
from ..sources import files, store
from ..sources.tables import GRAPH_SQL, edges, nodes, table
from .queries import INVENTORY_SQL, inventory_files, query

#: Orders as flows: the order, its parts in order of keys, then their suppliers.
STEPS_SQL = """,
parts AS (SELECT l_orderkey AS f, l_partkey AS k, 1 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS i FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)),
sups AS (SELECT l_orderkey AS f, l_suppkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) AS r FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)),
steps AS (SELECT o_orderkey AS flow_id, 1 AS step_idx, 'order:' || o_orderkey AS node_id, 0 AS depth FROM orders UNION ALL SELECT f, i, 'part:' || k, 1 FROM parts
 UNION ALL SELECT f, r + (SELECT max(i) FROM parts p WHERE p.f = sups.f), 'supplier:' || k, 2 FROM sups),
led AS (SELECT b.flow_id, b.step_idx, a.step_idx AS parent_idx, e.type, e.confidence, row_number() OVER (PARTITION BY b.flow_id, b.step_idx ORDER BY a.step_idx, e.edge_ord) AS rank
 FROM steps a JOIN edges e ON e.source = a.node_id JOIN steps b ON b.flow_id = a.flow_id AND b.node_id = e.target AND b.depth = a.depth + 1)
"""


def flow_rows(spark, d):
    """``(flow_id, steps)``: a row a flow, near ones in one partition, from one shuffle of keys; null keys come last, as in the SQL."""
    line, begun = table(spark, d, "lineitem"), table(spark, d, "orders")
    keys = line.select(F.col("l_orderkey").alias("flow_id"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.lit(0).alias("begun"))
    keys = keys.unionByName(begun.select(F.col("o_orderkey").alias("flow_id"), F.lit(1).alias("begun")), allowMissingColumns=True)
    keys = keys.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "flow_id")
    own = lambda k: F.concat(F.array_sort(F.collect_set(k)), F.when(F.count_if(F.col(k).isNull() & (F.col("begun") == 0)) > 0, F.array(F.lit(None).cast(keys.schema[k].dataType))).otherwise(F.array().cast(f"array<{keys.schema[k].dataType.simpleString()}>"))).alias(f"{k}s")
    flows = keys.groupBy("flow_id").agg(F.sum("begun").cast("int").alias("begun"), own("part"), own("supplier"))
    step = lambda i, kind, k, depth: F.struct(i.cast("int").alias("step_idx"), F.concat(F.lit(f"{kind}:"), k.cast("string")).alias("node_id"), F.lit(depth).alias("depth"))
    first = F.array_repeat(step(F.lit(1), "order", F.col("flow_id"), 0), F.col("begun"))
    parts = F.transform("parts", lambda k, i: step(i + 2, "part", k, 1))
    return flows.select("flow_id", F.concat(first, parts, F.transform("suppliers", lambda k, i: step(i + 2 + F.size("parts"), "supplier", k, 2))).alias("steps"))


def steps(spark, d):
    return flow_rows(spark, d).select("flow_id", F.inline("steps"))


@query(GRAPH_SQL + STEPS_SQL + """, shown AS (SELECT * FROM steps WHERE step_idx <= 6), l AS (SELECT * FROM led WHERE step_idx <= 6 AND parent_idx <= 6),
 f AS (SELECT flow_id, step_idx, arg_min(parent_idx, rank) AS parent_idx, arg_min(type, rank) AS type, arg_min(confidence, rank) AS confidence, count(*) - 1 AS alternatives FROM l GROUP BY ALL),
 c AS (SELECT flow_id, parent_idx AS step_idx, count(*) AS children FROM f GROUP BY ALL)
 SELECT s.flow_id, s.step_idx, node_id, CASE WHEN s.step_idx = 1 THEN 'entry' WHEN children IS NULL THEN 'end' ELSE 'step' END AS role, f.parent_idx, f.type, coalesce(f.confidence, 'none') AS confidence, coalesce(alternatives, 0) AS alternatives,
 coalesce(children, 0) > 1 AS fan_out, (max(s.step_idx) OVER (PARTITION BY s.flow_id)) < t.total AS truncated
 FROM shown s LEFT JOIN f USING (flow_id, step_idx) LEFT JOIN c USING (flow_id, step_idx) JOIN (SELECT flow_id, max(step_idx) AS total FROM steps GROUP BY 1) t USING (flow_id)""")
def flow_lens(spark, d):
    return flowviews.lens(steps(spark, d), edges(spark, d), 6)


@query(GRAPH_SQL + STEPS_SQL + """, m AS (SELECT node_id AS id, flow_id, step_idx, count(*) OVER (PARTITION BY node_id) AS total, row_number() OVER (PARTITION BY node_id ORDER BY step_idx, flow_id) AS r FROM steps WHERE node_id LIKE 'part:%')
 SELECT id, flow_id, step_idx, total FROM m WHERE r <= 12""")
def flow_membership(spark, d):
    return flowviews.membership(steps(spark, d), nodes(spark, d).where("type = 'part'"))


@query(GRAPH_SQL + STEPS_SQL + """, t AS (SELECT DISTINCT s.flow_id, e.source FROM steps s JOIN edges e ON e.target = s.node_id WHERE e.source IN (SELECT id FROM nodes WHERE type = 'customer' OR type = 'part')),
 a AS (SELECT flow_id, count(*) AS transitions, count(*) FILTER (confidence = 'exact') AS exact, count(*) FILTER (confidence = 'likely') AS likely FROM led GROUP BY 1)
 SELECT flow_id, n AS steps, coalesce(transitions, 0) AS transitions, coalesce(exact, 0) AS exact, coalesce(likely, 0) AS likely, coalesce(k, 0) AS tests
 FROM (SELECT flow_id, count(*) AS n FROM steps GROUP BY 1) LEFT JOIN a USING (flow_id) LEFT JOIN (SELECT flow_id, count(DISTINCT source) AS k FROM t GROUP BY 1) USING (flow_id)""")
def flow_evidence(spark, d):
    """Parts and customers stand for tests: what has an edge to a step."""
    return flowviews.evidence(flow_rows(spark, d), edges(spark, d), nodes(spark, d).where("type IN ('customer', 'part')"))


@query("""WITH o AS (SELECT o_orderkey AS k FROM orders WHERE NOT (o_orderpriority = '1-URGENT'))
 SELECT (SELECT count(*) FROM orders) AS total, (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') AS returned, (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT k::VARCHAR AS k FROM o ORDER BY o.k LIMIT 100)) AS omitted, true AS truncated, 'limit' AS reason""")
def flow_catalog(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "flow_id")
    return flowviews.catalog(o, o.where("o_orderpriority = '1-URGENT'"))


#: Documents as records of artifacts: a source and language have many, the newest with the greatest id.
RECORDS_SQL = """WITH r AS (SELECT doc_id AS record_id, source AS type, lang || (doc_id % 9) AS key, doc_id % 3 AS graph_version, sha256(CASE WHEN doc_id % 11 = 0 THEN 'other' ELSE coalesce(text, '') END) AS content_hash, coalesce(text, '') AS content,
 CASE WHEN doc_id % 13 = 0 THEN ['*'] ELSE ['p' || doc_id % 40, 'p' || doc_id % 7] END AS paths, doc_id AS created, n_chars AS bytes FROM documents),
 n AS (SELECT *, row_number() OVER (PARTITION BY type, key ORDER BY created DESC, record_id DESC) AS r FROM r)"""


def records(spark, d):
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    p = lambda m: F.concat(F.lit("p"), (i % m).cast("string"))
    return table(spark, d, "documents").select(
        i.alias("record_id"), F.col("source").alias("type"), F.concat("lang", (i % 9).cast("string")).alias("key"), (i % 3).alias("graph_version"), F.sha2(F.when(i % 11 == 0, "other").otherwise(text), 256).alias("content_hash"), text.alias("content"),
        F.when(i % 13 == 0, F.array(F.lit("*"))).otherwise(F.array(p(40), p(7))).alias("paths"), i.alias("created"), F.col("n_chars").alias("bytes"),
    )


@query(RECORDS_SQL + """, a AS (SELECT DISTINCT type, key FROM r UNION SELECT type, 'absent' FROM r)
 SELECT a.type, a.key, CASE WHEN n.key IS NULL THEN 'miss' WHEN graph_version <> 1 THEN 'stale' WHEN content_hash <> sha256(content) THEN 'corrupt' ELSE 'hit' END AS status FROM a LEFT JOIN (SELECT * FROM n WHERE r = 1) n ON n.type = a.type AND n.key = a.key""")
def artifact_reads(spark, d):
    r = records(spark, d)
    return artifacts.hits(r, r.select("type", "key").union(r.select("type", F.lit("absent"))), 1)


@query(RECORDS_SQL + "SELECT record_id, type, key FROM n WHERE r = 1 AND (list_contains(paths, '*') OR list_has_any(paths, ['p3', 'p17']))")
def artifact_invalidation(spark, d):
    return artifacts.invalidate(records(spark, d), spark.createDataFrame([("p3",), ("p17",)], "path string"))


@query(RECORDS_SQL + "SELECT type, CASE WHEN r > 1 THEN 'superseded' WHEN graph_version = 1 THEN 'current' ELSE 'stale' END AS status, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM n GROUP BY ALL")
def artifact_audit(spark, d):
    return artifacts.audit(records(spark, d), 1)


@query(RECORDS_SQL + "SELECT record_id, r <= 4 AS kept FROM n")
def artifact_prune(spark, d):
    return artifacts.prune(records(spark, d)).select("record_id", "kept")


@query("""WITH s AS (SELECT p_partkey AS id, CASE WHEN p_size % 10 > 0 THEN p_name END AS title FROM part), p AS (SELECT l_partkey AS id, max_by(l_shipmode, (t, l_shipmode)) AS title FROM (SELECT l_partkey, l_returnflag AS l_shipmode, l_shipdate AS t FROM lineitem WHERE l_linestatus = 'F') GROUP BY 1),
 d AS (SELECT l_partkey AS id, max(l_linenumber) AS n, max_by(CASE WHEN l_discount > 0.05 THEN 'accepted' ELSE 'rejected' END, (l_orderkey, CASE WHEN l_discount > 0.05 THEN 'accepted' ELSE 'rejected' END)) AS decision FROM lineitem WHERE l_quantity > 49 GROUP BY 1)
 SELECT s.id, coalesce(p.title, s.title) AS title, coalesce(decision, CASE WHEN p.id IS NOT NULL THEN 'agent-proposed' WHEN s.title IS NULL THEN 'abstained' ELSE 'suggested' END) AS status, CASE WHEN decision IS NOT NULL THEN 'decision' WHEN p.id IS NOT NULL THEN 'agent' ELSE 'rule' END AS source
 FROM s LEFT JOIN p USING (id) LEFT JOIN d USING (id)""")
def review_queue(spark, d):
    line = table(spark, d, "lineitem").withColumnRenamed("l_partkey", "id")
    suggestions = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 10 > 0, F.col("p_name")).alias("title"))
    proposals = line.select("id", F.col("l_shipdate").alias("time"), F.col("l_returnflag").alias("title"), (F.col("l_linestatus") == "F").alias("current"))
    decisions = line.where("l_quantity > 49").select("id", F.col("l_orderkey").alias("time"), F.when(F.col("l_discount") > 0.05, "accepted").otherwise("rejected").alias("decision"))
    return review.queue(suggestions, proposals, decisions)


@query("""SELECT o_orderkey AS flow_id, c_name AS title, CASE o_orderstatus WHEN 'F' THEN 'current' WHEN 'O' THEN 'compatible' ELSE 'stale' END AS status, o_orderstatus IN ('F', 'O') AS reusable, o_orderdate AS verified_at
 FROM orders JOIN customer ON c_custkey = o_custkey WHERE contains(lower(c_name || ' ' || c_mktsegment), 'building') ORDER BY reusable DESC, verified_at DESC, flow_id LIMIT 100""")
def verified_memory(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    flows = o.join(c, F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("flow_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("note"))
    status = F.when(F.col("o_orderstatus") == "F", "current").when(F.col("o_orderstatus") == "O", "compatible").otherwise("stale")
    return review.memory(flows, o.select(F.col("o_orderkey").alias("flow_id"), status.alias("status"), F.col("o_orderdate").alias("verified_at")), "Building", stale=True, limit=100)


@query("""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS l, l_suppkey AS r, l_linenumber % 3 AS la, l_linenumber % 2 AS ra FROM lineitem), a AS (SELECT p_partkey AS k, p_size % 3 AS v FROM part WHERE p_size % 5 <> 0), b AS (SELECT s_suppkey AS k, s_suppkey % 2 AS v FROM supplier)
 SELECT id, CASE WHEN a.v IS NULL OR b.v IS NULL THEN 'unavailable' WHEN a.v = la AND b.v = ra THEN 'current' ELSE 'stale' END AS status FROM r LEFT JOIN a ON a.k = l LEFT JOIN b ON b.k = r""")
def contract_references(spark, d):
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    n = F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + n).alias("id"), name("part:", "l_partkey").alias("left"), name("supplier:", "l_suppkey").alias("right"), (n % 3).alias("left_at"), (n % 2).alias("right_at"))
    parts = table(spark, d, "part").where("p_size % 5 <> 0").select(name("part:", "p_partkey").alias("artefact"), (F.col("p_size") % 3).cast("long").alias("version"))
    suppliers = table(spark, d, "supplier").select(name("supplier:", "s_suppkey").alias("artefact"), (F.col("s_suppkey") % 2).cast("long").alias("version"))
    return review.references(rows, parts.union(suppliers))


@query("""WITH c AS (SELECT CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS expected, CASE WHEN o_orderkey % 7 > 0 THEN CASE WHEN o_orderkey % 11 = 0 THEN 'other' ELSE o_orderpriority END END AS suggested FROM orders)
 SELECT count(*) AS cases, count(*) FILTER (expected IS NOT DISTINCT FROM suggested) AS correct, count(*) FILTER (expected IS DISTINCT FROM suggested AND suggested IS NOT NULL) AS incorrect, count(*) FILTER (expected IS DISTINCT FROM suggested AND suggested IS NULL) AS abstained FROM c""")
def suggestion_accuracy(spark, d):
    k = F.col("o_orderkey")
    suggested = F.when(k % 7 > 0, F.when(k % 11 == 0, "other").otherwise(F.col("o_orderpriority")))
    return review.accuracy(table(spark, d, "orders").select(F.when(k % 5 > 0, F.col("o_orderpriority")).alias("expected"), suggested.alias("suggested")))


@query("""WITH s AS (SELECT o_orderpriority AS condition, count(DISTINCT o_custkey) AS cases, count(*) FILTER (o_orderstatus = 'F') AS matched, count(*) AS expected FROM orders GROUP BY 1), r AS (SELECT *, round(matched / expected, 4) AS recall FROM s)
 SELECT *, round(recall - (SELECT max(recall) FROM r), 4) AS delta FROM r""")
def case_scores(spark, d):
    return review.scores(table(spark, d, "orders").select(F.col("o_orderpriority").alias("condition"), F.col("o_custkey").alias("case"), (F.col("o_orderstatus") == "F").alias("matched")))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS time, CASE WHEN length(props) > 8 THEN rtrim(substring(props, 1, 7)) || '…' ELSE props END AS short FROM events""")
def iso_times(spark, d):
    return table(spark, d, "events").select("event_id", scalars.iso_time("ts").alias("time"), scalars.truncate(F.col("props"), 8).alias("short"))


@query("""WITH p AS (SELECT l_orderkey AS k, list_sort(list_distinct(list('src/' || l_partkey))) AS l FROM lineitem GROUP BY 1) SELECT k, array_to_string(l[1:3], ',') AS shown, len(l) AS total, len(l) > 3 AS truncated FROM p""")
def bounded_paths(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(F.concat(F.lit("src/"), F.col("l_partkey").cast("string"))).alias("paths"))
    rows = rows.select("k", scalars.bounded_list(F.col("paths"), 3).alias("b"))
    return rows.select("k", F.array_join("b.shown", ",").alias("shown"), "b.total", "b.truncated")


@query(GRAPH_SQL + "SELECT id FROM nodes WHERE domain = 'MIDDLE EAST' AND feature = 'BUILDING'")
def hierarchy_focus(spark, d):
    return nodes(spark, d).where(scalars.focus_matches("feature:MIDDLE%20EAST:BUILDING")).select("id")


def stored(spark, d):
    """A store with two versions: the second has no part 13, other names of suppliers in nation 3, and a new region."""
    s = store.GraphStore(spark, scratch_path(spark, "graphs"))
    n, e = nodes(spark, d), edges(spark, d)
    s.persist(n, e)
    moved = n.where("id <> 'part:13'").withColumn("label", F.when((F.col("type") == "supplier") & F.col("label").endswith("3"), F.concat("label", F.lit(" new"))).otherwise(F.col("label")))
    new = n.where("id = 'region:1'").withColumn("id", F.lit("region:99"))
    s.persist(moved.unionByName(new), e.where("target <> 'part:13' AND source <> 'part:13'"))
    s.persist(*s.read())  # nothing has changed: no version
    return s


STORED_SQL = """, c AS (SELECT 'node' AS entity, id, CASE WHEN id = 'part:13' THEN 'removed' ELSE 'changed' END AS change FROM nodes WHERE id = 'part:13' OR (type = 'supplier' AND label LIKE '%3') UNION ALL SELECT 'node', 'region:99', 'added'
 UNION ALL SELECT 'edge', source || '|' || target || '|' || type, 'removed' FROM edges WHERE source = 'part:13' OR target = 'part:13')"""


@query(GRAPH_SQL + STORED_SQL + " SELECT 2 AS newest, entity, id, change FROM c")
def stored_delta(spark, d):
    s = stored(spark, d)
    newest = s.versions()[-1]["version"]
    return s.delta(newest).select(F.lit(newest).alias("newest"), "entity", "id", "change")


@query(GRAPH_SQL + STEPS_SQL + STORED_SQL + """ SELECT id, change, CASE change WHEN 'removed' THEN 'historical' ELSE 'current' END AS state, 'node@' || CASE change WHEN 'removed' THEN 1 ELSE 2 END || ':' || id AS ref, (SELECT count(DISTINCT flow_id) FROM steps WHERE node_id = c.id) AS flows FROM c WHERE entity = 'node'""")
def changed_contexts(spark, d):
    s = stored(spark, d)
    return store.changed_contexts(s.delta(2), s.read(2)[0], steps(spark, d), 2)


@query(GRAPH_SQL + """, a AS (SELECT 'node' AS entity, id AS key, CASE WHEN id LIKE 'part:1%' THEN 'removed' ELSE 'changed' END AS change FROM nodes WHERE id LIKE 'part:1%' OR type = 'region'
 UNION ALL SELECT 'edge', source || '|' || target || '|' || type, CASE WHEN source LIKE 'part:1%' OR target LIKE 'part:1%' THEN 'removed' ELSE 'changed' END FROM edges WHERE source LIKE 'part:1%' OR target LIKE 'part:1%' OR type = 'imports') SELECT * FROM a""")
def graph_delta_edges(spark, d):
    """Nodes and edges of a version without some parts, with other labels of regions and less confidence in imports."""
    n, e = nodes(spark, d), edges(spark, d)
    gone = lambda c: F.col(c).like("part:1%")
    later = n.where(~gone("id")).withColumn("label", F.when(F.col("type") == "region", F.concat("label", F.lit("*"))).otherwise(F.col("label")))
    less = e.where(~gone("source") & ~gone("target")).withColumn("confidence", F.when(F.col("type") == "imports", "likely").otherwise(F.col("confidence")))
    return version.graph_delta(n, later, e, less, ["label", "type"])


@query(INVENTORY_SQL + """, n AS (SELECT path, CASE WHEN mtime % 50 = 0 THEN size + 1 ELSE size END AS size FROM f) SELECT (SELECT count(*) FROM (SELECT DISTINCT path, size FROM f)) AS files, (SELECT count(*) FROM f JOIN n USING (path) WHERE f.size <> n.size) = 0 AS same, true AS same_again""")
def inventory_fingerprint(spark, d):
    """Whether the fingerprint tells a changed inventory, and gives the same in another order."""
    f = inventory_files(spark, d).select("path", "size", "mtime")
    now = f.withColumn("size", F.when(F.col("mtime") % 50 == 0, F.col("size") + 1).otherwise(F.col("size")))
    mark = lambda df, name: files.fingerprint(df, ["path", "size"]).select(F.struct("xor", "total", "n").alias(name))
    rows = mark(f, "a").crossJoin(mark(now, "b")).crossJoin(mark(f.orderBy(F.desc("size")), "c"))
    return rows.select(F.col("a.n").alias("files"), (F.col("a") == F.col("b")).alias("same"), (F.col("a") == F.col("c")).alias("same_again"))


@query(GRAPH_SQL + STORED_SQL + " SELECT entity, id, CASE change WHEN 'added' THEN 'removed' WHEN 'removed' THEN 'added' ELSE change END AS change FROM c")
def snapshot_comparison(spark, d):
    """The newer version against the older one, backwards."""
    return stored(spark, d).compare(2, 1)


@query(GRAPH_SQL + """, later AS (SELECT CASE WHEN type = 'customer' AND id LIKE '%7' THEN id || 'x' ELSE id END AS id, type, CASE WHEN type = 'part' AND id LIKE '%3' THEN label || '*' ELSE label END AS label, domain FROM nodes WHERE type <> 'supplier' OR id NOT LIKE '%5'),
 asked AS (SELECT id, type, label, domain FROM nodes UNION ALL SELECT 'no:1', NULL, NULL, NULL), g AS (SELECT type, label, domain, count(*) AS n, min(id) AS other FROM later GROUP BY ALL)
 SELECT a.id, CASE WHEN a.type IS NULL THEN 'unknown' WHEN l.id IS NOT NULL AND l.label = a.label THEN 'unchanged' WHEN l.id IS NOT NULL THEN 'changed' WHEN n = 1 THEN 'moved' WHEN n > 1 THEN 'ambiguous' ELSE 'gone' END AS status, CASE WHEN l.id IS NOT NULL THEN a.id WHEN n = 1 THEN other END AS match
 FROM asked a LEFT JOIN later l ON l.id = a.id LEFT JOIN g ON g.type = a.type AND g.label = a.label AND g.domain = a.domain""")
def context_continuity(spark, d):
    n = nodes(spark, d)
    kind = lambda t, sign: (F.col("type") == t) & F.col("id").like(f"%{sign}")
    later = n.where(~kind("supplier", 5)).withColumn("label", F.when(kind("part", 3), F.concat("label", F.lit("*"))).otherwise(F.col("label"))).withColumn("id", F.when(kind("customer", 7), F.concat("id", F.lit("x"))).otherwise(F.col("id")))
    return store.continuity(n.select("id").union(spark.createDataFrame([("no:1",)], "id string")), n, later)


@query(GRAPH_SQL + """, f AS (SELECT id FROM nodes WHERE kind = 'endpoint' UNION SELECT target FROM edges WHERE type = 'handles' AND source IN (SELECT id FROM nodes WHERE kind = 'endpoint') UNION SELECT source FROM edges WHERE type = 'uses' AND target IN (SELECT id FROM nodes WHERE kind = 'endpoint'))
 SELECT id FROM f UNION SELECT target FROM edges WHERE type IN ('contains', 'calls') AND source IN (SELECT id FROM f)""")
def entry_sources(spark, d):
    return filters.entry_sources(nodes(spark, d), edges(spark, d), asking=("uses",), further=("contains", "calls"))


@query(RECORDS_SQL + """, x AS (SELECT o_orderkey AS f, count(DISTINCT l_suppkey) FILTER (l_quantity > 45) AS tests, count(DISTINCT l_partkey) AS t FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
 SELECT (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM documents WHERE lang IN ('en', 'de')) AS parsed, (SELECT count(*) FROM x) AS flows, (SELECT count(*) FROM x WHERE tests > 0) AS tested, (SELECT sum(t) FROM x)::BIGINT AS transitions,
 (SELECT count(*) FROM n WHERE r = 1) AS artifacts, (SELECT count(*) FROM n WHERE r = 1 AND graph_version = 1) AS current, (SELECT count(*) FROM orders WHERE o_orderstatus IN ('F', 'O')) AS verified, (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')) AS stale, NULL::DOUBLE AS overall""")
def trust_summary(spark, d):
    orders, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    parsed = table(spark, d, "documents").select(F.when(F.col("lang").isin("en", "de"), "parsed").otherwise("inventory").alias("status"))
    of = line.groupBy("l_orderkey").agg(F.count_distinct(F.when(F.col("l_quantity") > 45, F.col("l_suppkey"))).alias("tests"), F.count_distinct("l_partkey").alias("transitions"))
    flows = orders.join(of, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    verified = orders.select(F.when(F.col("o_orderstatus") == "F", "current").when(F.col("o_orderstatus") == "O", "compatible").otherwise("stale").alias("status"))
    return review.trust(parsed, flows, artifacts.latest(records(spark, d)).select((F.col("graph_version") == 1).alias("current")), verified)
