"""Queries of the graph operators over the test tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, joins, journal, order, rank, rollup, traverse, version
from ..sources import extract, files, resolve
from ..sources.tables import GRAPH_SQL, edges, nodes, table

from . import packets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


EVENTS = {"signup": "run-started", "view": "step-started", "click": "step-passed", "error": "step-failed", "purchase": "run-passed"}
JOURNAL_SQL = """
j AS (SELECT event_id, ts, user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sequence, value, props,
  CASE event_type WHEN 'signup' THEN 'run-started' WHEN 'view' THEN 'step-started' WHEN 'click' THEN 'step-passed' WHEN 'error' THEN 'step-failed' WHEN 'purchase' THEN 'run-passed' END AS event_type,
  'step ' || (json_extract_string(props, '$.k')::INTEGER % 7) AS step FROM events)"""


def journal_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as a journal: runs are users, sequences their order in time."""
    from pyspark.sql.window import Window

    e = table(spark, d, "events")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in EVENTS.items() for x in kv]), F.col("event_type"))
    step = F.concat(F.lit("step "), (F.get_json_object("props", "$.k").cast("int") % 7).cast("string"))
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select("event_id", "ts", F.col("user_id").alias("run_id"), seq.cast("long").alias("sequence"), "value", "props", kind.alias("event_type"), step.alias("step"))


# Projections, filters and predicates.


@query(GRAPH_SQL + "SELECT id, layer, domain FROM nodes WHERE layer IN ('application', 'runtime')")
def scope_filter(spark, d):
    return filters.in_scope(nodes(spark, d), "runtime").select("id", "layer", "domain")


@query("""SELECT doc_id, p AS path, CASE WHEN regexp_matches(p, '^src1/[^/]*$') THEN 'excluded' WHEN regexp_matches(p, '(^|/)(fixtures?|__fixtures__)/') THEN 'fixture'
 WHEN regexp_matches(p, '(^|/)tests?/') OR regexp_matches(p, '\\.spec\\.ts$') THEN 'test' WHEN regexp_matches(p, '(^|/)(generated|dist|build|coverage)/') OR regexp_matches(p, '\\.(generated|min)\\.[a-z]+$') THEN 'generated' ELSE 'application' END AS class
 FROM (SELECT doc_id, source || '/' || CASE doc_id % 5 WHEN 0 THEN 'tests/' WHEN 1 THEN 'fixtures/' WHEN 2 THEN 'dist/' ELSE '' END || doc_id || CASE WHEN doc_id % 7 = 0 THEN '.spec.ts' ELSE '.ts' END AS p FROM documents)""".replace("\\\\", "\\"))
def path_classifier(spark, d):
    k = F.col("doc_id")
    folder = F.when(k % 5 == 0, "tests/").when(k % 5 == 1, "fixtures/").when(k % 5 == 2, "dist/").otherwise("")
    path = F.concat("source", F.lit("/"), folder, k.cast("string"), F.when(k % 7 == 0, ".spec.ts").otherwise(".ts"))
    return table(spark, d, "documents").select("doc_id", path.alias("path")).withColumn("class", filters.path_class(F.col("path"), ["src1/*"]))


@query(GRAPH_SQL + "SELECT id, array_to_string(list_transform(string_split(split_part(path, '/', 2), '-'), lambda w: upper(w[1]) || w[2:]), ' ') AS domain_of_path, split_part(path, '/', 2) AS feature_of_path, CASE WHEN regexp_matches(path, '(^|[._-])orders?([._-]|$)') THEN 'order' ELSE 'other' END AS family FROM nodes")
def domain_derivation(spark, d):
    n = nodes(spark, d)
    return n.select("id", filters.domain_of(F.col("path")).alias("domain_of_path"), filters.feature_of(F.col("path")).alias("feature_of_path"), F.when(F.col("path").rlike("(^|[._-])orders?([._-]|$)"), "order").otherwise("other").alias("family"))


@query("""SELECT p_partkey, CASE WHEN n LIKE '%.d.ts' THEN 'declaration' WHEN contains(n, 'service') THEN 'service' WHEN contains(n, 'queue') THEN 'queue' ELSE 'module' END AS file_type
 FROM (SELECT p_partkey, p_partkey || CASE p_size % 4 WHEN 0 THEN '.d.ts' WHEN 1 THEN '.service.ts' WHEN 2 THEN '-queue.ts' ELSE '.ts' END AS n FROM part)""")
def file_classifier(spark, d):
    s = F.col("p_size") % 4
    name = F.concat(F.col("p_partkey").cast("string"), F.when(s == 0, ".d.ts").when(s == 1, ".service.ts").when(s == 2, "-queue.ts").otherwise(".ts"))
    return table(spark, d, "part").select("p_partkey", filters.file_type(F.concat(F.lit("src/"), name)).alias("file_type"))


@query(GRAPH_SQL + """SELECT id, label, CASE type WHEN 'region' THEN 0 WHEN 'nation' THEN 1 WHEN 'supplier' THEN 2 ELSE 3 END AS rank FROM nodes
 WHERE contains(lower(concat_ws(' ', label, path, feature, domain, type)), 'asia') ORDER BY rank, label, id LIMIT 12""")
def node_search(spark, d):
    return filters.search(nodes(spark, d), "asia", {"region": 0, "nation": 1, "supplier": 2}).select("id", "label", "rank")


@query(GRAPH_SQL + "SELECT source, target, type, CASE WHEN source = 'nation:3' THEN 'outgoing' ELSE 'incoming' END AS direction FROM edges WHERE source = 'nation:3' OR target = 'nation:3'")
def neighborhood(spark, d):
    return filters.neighbourhood(nodes(spark, d), edges(spark, d), "nation:3")


@query(GRAPH_SQL + """, rel AS (SELECT 'outgoing' AS direction, type AS edge_type, target AS other FROM edges WHERE source = 'customer:7' UNION ALL SELECT 'incoming', type, source FROM edges WHERE target = 'customer:7')
 SELECT direction, edge_type, other, label, type AS other_type FROM rel JOIN nodes ON id = other""")
def node_detail(spark, d):
    return filters.node_detail(nodes(spark, d), edges(spark, d), "customer:7")


@query("SELECT p_partkey, CASE WHEN contains(lower(p_type), 'brass') THEN 'framework' WHEN contains(lower(p_type), 'steel') OR contains(lower(p_type), 'tin') THEN 'runtime' WHEN contains(lower(p_type), 'copper') THEN 'devtool' ELSE 'package' END AS layer FROM part")
def dependency_class(spark, d):
    return table(spark, d, "part").select("p_partkey", filters.dependency_class(F.col("p_type"), ["steel", "tin"], ["brass"], ["copper"]).alias("layer"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '[\\r\\n]') THEN 'multiline' WHEN regexp_matches(text, '(?i)(password|secret|token|api[_-]?key)[ \\t]*[:=]') THEN 'credential' ELSE 'safe' END AS verdict FROM documents""".replace("\\\\", "\\"))
def safe_text(spark, d):
    found = filters.unsafe_text(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.when(found.isin("multiline", "credential"), found), F.lit("safe")).alias("verdict"))


@query("SELECT page_id, regexp_replace(url, '^https?://[^/]+/', '') AS path FROM pages WHERE regexp_replace(url, '^https?://[^/]+/', '') <> ''")
def changed_paths(spark, d):
    bare = F.regexp_replace("url", "^https?://[^/]+/", "")
    return table(spark, d, "pages").select("page_id", filters.normalise_path(F.concat(F.lit("./"), bare)).alias("path")).where("path is not null")


@query(GRAPH_SQL + "SELECT feature, count(*) AS n FROM nodes WHERE kind = 'endpoint' AND contains(lower(label), '1') GROUP BY feature")
def entry_flow_search(spark, d):
    return filters.entry_nodes(nodes(spark, d)).where(F.lower("label").contains("1")).groupBy("feature").agg(F.count("*").alias("n"))


# Joins and set operations.


@query(GRAPH_SQL + "SELECT source, target, e.type, s.label AS source_label, t.label AS target_label FROM edges e JOIN nodes s ON s.id = source JOIN nodes t ON t.id = target")
def edge_join(spark, d):
    return joins.with_ends(edges(spark, d), nodes(spark, d)).select("source", "target", "type", "source_label", "target_label")


@query("SELECT o_orderkey, coalesce(c_name, 'file:' || o_custkey) AS handler, CASE WHEN c_name IS NULL THEN 'fallback' ELSE 'exact' END AS binding FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def handler_fallback(spark, d):
    right = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("handler"))
    out = joins.lookup_or(table(spark, d, "orders").select("o_orderkey", "o_custkey"), right, ["o_custkey"], "handler", F.concat(F.lit("file:"), F.col("o_custkey").cast("string")))
    return out.select("o_orderkey", "handler", "binding")


@query("SELECT n_nationkey, s_suppkey FROM nation JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1 HAVING count(*) = 1) ON n_nationkey = s_nationkey")
def unique_match(spark, d):
    right = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    return joins.unique_match(table(spark, d, "nation").select("n_nationkey"), right, ["n_nationkey"], "s_suppkey")


@query("SELECT c_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def first_match(spark, d):
    right = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("first_order"), "o_orderdate")
    return joins.first_match(table(spark, d, "customer").select("c_custkey"), right, ["c_custkey"], "first_order", "o_orderdate")


@query(GRAPH_SQL + ", k AS (SELECT id FROM nodes WHERE type IN ('customer', 'nation')) SELECT source, target, type FROM edges WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k)")
def semi_edges(spark, d):
    return joins.retained_edges(edges(spark, d), nodes(spark, d).where(F.col("type").isin("customer", "nation"))).select("source", "target", "type")


@query(GRAPH_SQL + "SELECT id FROM nodes WHERE type = 'supplier' AND id NOT IN (SELECT target FROM edges WHERE type = 'uses' AND source LIKE 'part:11_')")
def anti_catalog(spark, d):
    """Suppliers that none of a few parts uses."""
    used = edges(spark, d).where("type = 'uses' AND source LIKE 'part:11_'").select(F.col("target").alias("id"))
    return joins.unmatched(nodes(spark, d).where("type = 'supplier'").select("id"), used, "id")


@query("""WITH t AS (SELECT DISTINCT page_id AS a, unnest(regexp_extract_all(html, '(?:class|id|href)="([^"]{3,120})"', 1)) AS t FROM pages), n AS (SELECT t FROM t GROUP BY t HAVING count(*) >= 2), u AS (SELECT * FROM t WHERE t IN (SELECT t FROM n)),
 p AS (SELECT x.a, y.a AS b, count(*) AS shared FROM u x JOIN u y USING (t) WHERE x.a <> y.a GROUP BY ALL HAVING count(*) >= 2)
 SELECT * FROM (SELECT a, b, shared, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS rank FROM p) WHERE rank <= 12""")
def cooccurrence(spark, d):
    tokens = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('(?:class|id|href)="([^"]{3,120})"'), 1)).alias("token"))
    return joins.cooccurrence(tokens, "page_id", "token")


@query("""WITH e AS (SELECT user_id, event_type, event_id, value FROM events) SELECT user_id, event_type, min(event_id) AS event_id, arg_max(value, event_id) AS value FROM e GROUP BY ALL""")
def edge_dedupe(spark, d):
    return joins.last_wins(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("""WITH c AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 5000), s AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000)
 SELECT 'union' AS op, k FROM (SELECT k FROM c UNION SELECT k FROM s) UNION ALL SELECT 'intersect', k FROM (SELECT k FROM c INTERSECT SELECT k FROM s) UNION ALL SELECT 'except', k FROM (SELECT k FROM c EXCEPT SELECT k FROM s)""")
def set_ops(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k"))
    s = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    tag = lambda name, df: df.select(F.lit(name).alias("op"), "k")
    return tag("union", joins.union_distinct(c, s)).union(tag("intersect", c.intersect(s))).union(tag("except", c.subtract(s)))


# Roll-ups and counts.


@query(GRAPH_SQL + "SELECT 'domain:' || replace(domain, ' ', '%20') AS group_id, count(*) AS members FROM nodes GROUP BY domain")
def domain_rollup(spark, d):
    return rollup.group_nodes(nodes(spark, d), "domain").select("group_id", "members")


@query(GRAPH_SQL + """SELECT 'feature:' || replace(domain, ' ', '%20') || ':' || replace(replace(feature, ' ', '%20'), '#', '%23') AS group_id, count(*) AS members, array_to_string((list(id ORDER BY id))[1:12], ',') AS sample FROM nodes GROUP BY domain, feature""")
def feature_rollup(spark, d):
    return rollup.group_nodes(nodes(spark, d), "feature").select("group_id", "members", F.array_join("first_members", ",").alias("sample"))


@query(GRAPH_SQL + "SELECT domain, feature, type, count(*) AS members, CASE GROUPING(domain, feature, type) WHEN 0 THEN 'component' WHEN 1 THEN 'feature' WHEN 3 THEN 'domain' ELSE 'all' END AS level FROM nodes GROUP BY ROLLUP (domain, feature, type)")
def hierarchy_rollup(spark, d):
    return rollup.hierarchy(nodes(spark, d))


@query(GRAPH_SQL + """, k AS (SELECT id, 'domain:' || replace(domain, ' ', '%20') AS g FROM nodes)
 SELECT a.g AS source, b.g AS target, count(*) AS n_edges, CASE WHEN min(type) = max(type) THEN min(type) ELSE 'mixed' END AS type FROM edges JOIN k a ON a.id = source JOIN k b ON b.id = target WHERE a.g <> b.g GROUP BY ALL""")
def group_edges(spark, d):
    return rollup.group_edges(nodes(spark, d), edges(spark, d), "domain")


@query(GRAPH_SQL + """SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM nodes WHERE kind = 'endpoint') AS endpoints, (SELECT count(*) FROM nodes WHERE layer = 'application') AS application_nodes,
 (SELECT count(*) FROM nodes WHERE kind = 'external') AS externals, (SELECT count(DISTINCT domain) FROM nodes) AS domains, (SELECT count(DISTINCT feature) FROM nodes) AS features,
 (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM edges WHERE type = 'calls') AS calls, (SELECT count(*) FROM edges WHERE type = 'handles') AS handles, (SELECT count(*) FROM edges WHERE confidence = 'likely') AS likely""")
def graph_stats(spark, d):
    return rollup.graph_stats(nodes(spark, d), edges(spark, d))


@query("SELECT lang, count(*) AS files, count(*) FILTER (n_chars <= 1000) AS small, count(*) FILTER (n_chars > 10000) AS large, count(DISTINCT source) AS sources FROM documents GROUP BY GROUPING SETS ((lang), ())")
def coverage_by_language(spark, d):
    docs = table(spark, d, "documents")
    aggs = [F.count("*").alias("files"), F.count_if(F.col("n_chars") <= 1000).alias("small"), F.count_if(F.col("n_chars") > 10000).alias("large"), F.count_distinct("source").alias("sources")]
    return docs.groupingSets([["lang"], []], "lang").agg(*aggs)


@query("SELECT coalesce(nullif(event_type, ''), 'unknown') AS value, count(*) AS n FROM events GROUP BY 1")
def count_by(spark, d):
    return rollup.count_by(table(spark, d, "events"), "event_type")


@query("SELECT source, count(*) AS n, CASE WHEN sum(toxic) > 0 THEN round(sum(quality * toxic) / sum(toxic), 4) END AS toxic_quality FROM documents JOIN labels USING (doc_id) GROUP BY source")
def safe_ratio(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    out = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("quality") * F.col("toxic")).alias("a"), F.sum("toxic").alias("b"))
    return out.select("source", "n", rollup.ratio(F.col("a"), F.col("b")).alias("toxic_quality"))


@query("SELECT CASE WHEN quality IS NULL THEN 'unavailable' WHEN quality = 1 THEN 'verified' ELSE 'stale' END AS status, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def status_histogram(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    status = F.when(F.col("quality").isNull(), "unavailable").when(F.col("quality") == 1, "verified").otherwise("stale")
    return rollup.count_by(rows.select(status.alias("status")), "status").withColumnRenamed("value", "status")


@query("SELECT count(*) AS total, sum(quality)::BIGINT AS accepted, round(sum(quality) / greatest(count(*), 1), 4) AS accept_rate, round(sum(toxic) / greatest(count(*), 1), 4) AS flag_rate FROM labels")
def feedback_metrics(spark, d):
    n = F.greatest(F.count("*"), F.lit(1))
    return table(spark, d, "labels").agg(F.count("*").alias("total"), F.sum("quality").alias("accepted"), F.round(F.sum("quality") / n, 4).alias("accept_rate"), F.round(F.sum("toxic") / n, 4).alias("flag_rate"))


@query("""WITH m AS (SELECT count(*) AS n, avg(quality) AS q, avg(1 - toxic) AS clean FROM labels)
 SELECT 'enough' AS "check", n::DOUBLE AS actual, 100.0::DOUBLE AS required, n >= 100 AS passed FROM m UNION ALL SELECT 'quality', round(q, 6), 0.8, round(q, 6) >= 0.8 FROM m UNION ALL SELECT 'clean', round(clean, 6), 0.9, round(clean, 6) >= 0.9 FROM m""")
def gate_eval(spark, d):
    m = table(spark, d, "labels").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("q"), F.round(F.avg(1 - F.col("toxic")), 6).alias("clean"))
    return rollup.gate(m, {"enough": ("n", 100), "quality": ("q", 0.8), "clean": ("clean", 0.9)})


@query("""WITH e AS (SELECT DISTINCT o_custkey AS k, l_partkey AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 10), a AS (SELECT DISTINCT o_custkey AS k, l_partkey AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_discount > 0.03),
 b AS (SELECT coalesce(e.k, a.k) AS k, e.k IS NOT NULL AS x, a.k IS NOT NULL AS y FROM e FULL JOIN a ON e.k = a.k AND e.v = a.v), c AS (SELECT k, count(*) FILTER (x AND y) AS tp, count(*) FILTER (NOT x) AS fp, count(*) FILTER (NOT y) AS fn FROM b GROUP BY k)
 SELECT k, tp, fp, fn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) END AS recall FROM c""")
def precision_recall(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k")).join(table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey").withColumnRenamed("l_partkey", "v")
    return rollup.precision_recall(rows.where("l_quantity > 10"), rows.where("l_discount > 0.03"), ["k"], "v")


@query("SELECT event_type, median(value) AS median, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, count(value) AS n FROM events GROUP BY event_type")
def median_stats(spark, d):
    return order.median_stats(table(spark, d, "events"), "value", ["event_type"]).withColumn("mean", F.round("mean", 6))


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderdate) AS days FROM orders GROUP BY 1")
def distinct_counts(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderdate").alias("days"))


@query("""WITH s AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'blocked' ELSE 'open' END AS state FROM orders), dep AS (SELECT o_orderkey AS r, o_orderkey - 3 AS t FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_orderkey - 7 FROM orders WHERE o_orderkey % 3 = 0),
 c AS (SELECT r, count(*) FILTER (state = 'done') AS ready, count(*) FILTER (state = 'blocked') AS blocking, count(*) FILTER (state IS NULL) AS unknown, count(*) AS total FROM dep LEFT JOIN s ON s.k = t GROUP BY r)
 SELECT k AS record_id, coalesce(ready, 0) AS ready, coalesce(blocking, 0) AS blocking, coalesce(unknown, 0) AS unknown, coalesce(total, 0) AS total, coalesce(total - ready - blocking - unknown, 0) AS unresolved, coalesce(ready, 0) = coalesce(total, 0) AS ready_to_start FROM s LEFT JOIN c ON r = k""")
def readiness(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), "o_orderstatus")
    states = o.select("record_id", F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "blocked").otherwise("open").alias("state"))
    k = F.col("record_id")
    deps = o.where(k % 2 == 0).select("record_id", (k - 3).alias("depends_on")).union(o.where(k % 3 == 0).select("record_id", (k - 7).alias("depends_on")))
    return rollup.readiness(deps, states, o)


@query("SELECT lang AS adapter, count(*) AS files, sum(n_chars)::BIGINT AS bytes, count(*) FILTER (n_chars > 5000) AS oversized, sum(n_chars) > 1000000 AS over_budget FROM documents GROUP BY lang")
def inventory(spark, d):
    return table(spark, d, "documents").groupBy(F.col("lang").alias("adapter")).agg(F.count("*").alias("files"), F.sum("n_chars").alias("bytes"), F.count_if(F.col("n_chars") > 5000).alias("oversized"), (F.sum("n_chars") > 1_000_000).alias("over_budget"))


@query("SELECT source, count(*) AS files, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY source")
def cache_totals(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("bytes"))


@query("SELECT r_name AS feature, count(*) FILTER (type = 'order') AS endpoints, count(*) AS n FROM (SELECT r_name, 'order' AS type FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'customer' FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY 1")
def feature_map(spark, d):
    n = nodes(spark, d).where(F.col("type").isin("order", "customer"))
    return n.groupBy(F.col("domain").alias("feature")).agg(F.count_if(F.col("type") == "order").alias("endpoints"), F.count("*").alias("n"))


# Windows, limits and pages.


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def latest_state(spark, d):
    return order.latest(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


def superseding(spark, d):
    """Orders as records: every third replaces the order before it."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("id"), "o_custkey", "o_orderdate", F.when(k % 3 == 0, k - 1).alias("supersedes"))


@query("""WITH r AS (SELECT o_orderkey AS id, o_custkey, o_orderdate, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey - 1 END AS supersedes FROM orders), a AS (SELECT * FROM r WHERE id NOT IN (SELECT supersedes FROM r WHERE supersedes IS NOT NULL))
 SELECT o_custkey, arg_max(id, (o_orderdate, id)) AS id FROM a GROUP BY o_custkey""")
def latest_active(spark, d):
    return order.latest(order.active(superseding(spark, d)).select("o_custkey", "o_orderdate", "id"), ["o_custkey"], "o_orderdate", "id").select("o_custkey", "id")


@query("""WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey - 1 END AS supersedes FROM orders) SELECT id, CASE WHEN id IN (SELECT supersedes FROM r WHERE supersedes IS NOT NULL) THEN 'superseded' ELSE 'active' END AS lifecycle FROM r""")
def lifecycle(spark, d):
    return order.lifecycle(superseding(spark, d)).select("id", "lifecycle")


@query("SELECT * FROM (SELECT l_orderkey, l_linenumber, coalesce(lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), -1) + 1 AS expected FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) WHERE l_linenumber <> expected")
def sequence_check(spark, d):
    return order.sequence_faults(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct(), "l_orderkey", "l_linenumber")


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def topk_per_key(spark, d):
    return order.top_k(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


@query(GRAPH_SQL + """, k AS (SELECT id FROM nodes ORDER BY CASE WHEN id = 'nation:3' THEN 0 ELSE 1 END, id LIMIT 40), s AS (SELECT * FROM edges WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k) ORDER BY source, target, type LIMIT 80)
 SELECT (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(*) FROM edges) AS total_edges, (SELECT count(*) FROM k) AS kept_nodes, (SELECT count(*) FROM s) AS kept_edges, (SELECT count(*) FROM nodes) - (SELECT count(*) FROM k) AS omitted_nodes, (SELECT count(*) FROM edges) - (SELECT count(*) FROM s) AS omitted_edges""")
def bounded_view(spark, d):
    return order.bounded(nodes(spark, d), edges(spark, d), "nation:3")[2]


@query("SELECT event_id, ts, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_listing(spark, d):
    return order.listing(table(spark, d, "events"), "ts", "event_id", 50, True, event_type="error", user_id=None).select("event_id", "ts", "user_id")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 50 OFFSET 100")
def offset_page(spark, d):
    return order.page(table(spark, d, "customer").select("c_custkey", "c_name"), ["c_name", "c_custkey"], 100, 50)


@query("""WITH RECURSIVE f AS (SELECT source, sum(n_chars)::BIGINT AS bytes, row_number() OVER (ORDER BY source) AS r FROM documents GROUP BY source),
 w AS (SELECT 1 AS r, (SELECT bytes FROM f WHERE r = 1)::HUGEINT AS used, 1 AS n, true AS kept
       UNION ALL SELECT w.r + 1, CASE WHEN n < 8 AND used + bytes <= 700000 THEN used + bytes ELSE used END, CASE WHEN n < 8 AND used + bytes <= 700000 THEN n + 1 ELSE n END, n < 8 AND used + bytes <= 700000 FROM w JOIN f ON f.r = w.r + 1)
 SELECT source, bytes, kept FROM f JOIN w USING (r)""")
def retention_greedy(spark, d):
    files = table(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("bytes"))
    return order.retain(files, [F.asc("source")], "bytes", 8, 700_000)


# Traversals.


@query()
def flows(spark, d):
    entries = filters.entry_nodes(nodes(spark, d))
    return traverse.flows(entries, edges(spark, d), first_types={"endpoint": ("handles", "calls")})


REACH = """, r AS (SELECT id, 0 AS distance FROM nodes WHERE {seed} UNION SELECT {to}, distance + 1 FROM r JOIN edges ON {at} = r.id WHERE distance < {depth})
 SELECT id, min(distance) AS distance FROM r GROUP BY id"""


@query(GRAPH_SQL.replace("WITH", "WITH RECURSIVE", 1) + REACH.format(seed="id = 'supplier:7'", to="source", at="target", depth=3))
def impact_dependents(spark, d):
    return traverse.reach(nodes(spark, d).where("id = 'supplier:7'"), edges(spark, d), 3, reverse=True)


@query(GRAPH_SQL.replace("WITH", "WITH RECURSIVE", 1) + REACH.format(seed="id IN ('order:1', 'order:2', 'order:3')", to="target", at="source", depth=6))
def impact_dependencies(spark, d):
    return traverse.reach(nodes(spark, d).where(F.col("id").isin("order:1", "order:2", "order:3")), edges(spark, d), 6)


@query(GRAPH_SQL.replace("WITH", "WITH RECURSIVE", 1) + """, gone AS (SELECT id FROM nodes WHERE type = 'part' AND id LIKE 'part:1%7'), r AS (SELECT id, 0 AS distance FROM gone UNION SELECT source, distance + 1 FROM r JOIN edges ON target = r.id WHERE distance < 2)
 SELECT id, min(distance) AS distance FROM r WHERE id NOT IN (SELECT id FROM gone) GROUP BY id""")
def deleted_dependents(spark, d):
    """Nodes that are left of those which depended on deleted ones in the version before."""
    old, e = nodes(spark, d), edges(spark, d)
    gone = old.where("type = 'part' AND id LIKE 'part:1%7'")
    left = old.join(gone.select("id"), "id", "left_anti").select("id")
    return traverse.reach(gone, e, 2, reverse=True).join(left, "id", "left_semi")


def cyclic(spark, d):
    ring = table(spark, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("source"), F.concat(F.lit("nation:"), ((F.col("n_nationkey") + 1) % 25).cast("string")).alias("target"))
    return edges(spark, d).select("source", "target").union(ring)


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey + 1) % 25 AS b FROM nation), r AS (SELECT a AS begun, b AS reached FROM e UNION SELECT begun, b FROM r JOIN e ON a = reached) SELECT DISTINCT 'nation:' || begun AS id FROM r WHERE begun = reached""")
def cycle_check(spark, d):
    return traverse.on_cycle(cyclic(spark, d))


@query(GRAPH_SQL.replace("WITH", "WITH RECURSIVE", 1) + """, linked_both AS (SELECT source AS a, target AS b FROM edges WHERE type IN ('contains', 'imports') UNION SELECT target, source FROM edges WHERE type IN ('contains', 'imports')),
 r AS (SELECT 'region:1' AS id UNION SELECT b FROM r JOIN linked_both ON a = r.id JOIN nodes n ON n.id = b WHERE n.type IN ('nation', 'supplier')) SELECT id FROM r""")
def closure(spark, d):
    n, e = nodes(spark, d), edges(spark, d).where(F.col("type").isin("contains", "imports"))
    return traverse.closure(n, e, n.where("id = 'region:1'"), n.where(F.col("type").isin("nation", "supplier")))


@query(GRAPH_SQL + """, s AS (SELECT source AS flow_id, target AS node_id FROM edges WHERE type = 'handles') SELECT flow_id, count(DISTINCT target) AS related FROM s JOIN edges ON edges.source = node_id GROUP BY flow_id""")
def flow_tests(spark, d):
    e = edges(spark, d)
    steps = e.where("type = 'handles'").select(F.col("source").alias("flow_id"), F.col("target").alias("node_id"))
    return steps.join(e.select(F.col("source").alias("node_id"), "target"), "node_id").groupBy("flow_id").agg(F.count_distinct("target").alias("related"))


@query()
def lcs(spark, d):
    """Turn roles of a conversation against the expected change of user and assistant."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("actual"))
    expected = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i % 2 == 0, "user").otherwise("assistant"))
    return rank.longest_ordered_match(turns.withColumn("expected", expected), "conv_id", "expected", "actual")


@query()
def graph_components(spark, d):
    """Components of the whole graph; recursive SQL doesn't end in reasonable time, so the test is brute force."""
    e = edges(spark, d)
    return traverse.components(spark, e)


# Versions.


def two_versions(spark, d):
    """Orders before a cut are version 1; version 2 has all, but with some states changed and a class of keys gone."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    shape = lambda df, status: df.select(F.concat(F.lit("order:"), k.cast("string")).alias("id"), F.col("o_custkey").alias("label"), status.alias("type"), F.concat(F.lit("src/"), F.col("o_orderpriority")).alias("path"))
    return shape(o.where("o_orderdate < '1998-01-01'"), F.col("o_orderstatus")), shape(o.where(k % 89 != 0), F.when(k % 97 == 0, "X").otherwise(F.col("o_orderstatus")))


VERSIONS_SQL = """WITH a AS (SELECT 'order:' || o_orderkey AS id, o_custkey AS label, o_orderstatus AS type, 'src/' || o_orderpriority AS path FROM orders WHERE o_orderdate < '1998-01-01'),
 b AS (SELECT 'order:' || o_orderkey AS id, o_custkey AS label, CASE WHEN o_orderkey % 97 = 0 THEN 'X' ELSE o_orderstatus END AS type, 'src/' || o_orderpriority AS path FROM orders WHERE o_orderkey % 89 <> 0),
 delta AS (SELECT * FROM (SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.label <> b.label OR a.type <> b.type THEN 'changed' END AS change FROM a FULL JOIN b ON a.id = b.id) WHERE change IS NOT NULL)
"""


@query(VERSIONS_SQL + "SELECT 'node' AS entity, id AS key, change FROM delta")
def graph_delta(spark, d):
    old, new = two_versions(spark, d)
    return joins.compare(old.withColumnRenamed("id", "key"), new.withColumnRenamed("id", "key"), "key", ["label", "type"]).select(F.lit("node").alias("entity"), "key", "change")


@query(VERSIONS_SQL + """, p AS (SELECT id, change AS reason, CASE change WHEN 'removed' THEN 3 WHEN 'changed' THEN 2 ELSE 1 END AS k FROM delta UNION ALL SELECT id, 'source-changed', 0 FROM b WHERE path = 'src/1-URGENT') SELECT id, arg_max(reason, k) AS reason FROM p GROUP BY id""")
def affected_contexts(spark, d):
    old, new = two_versions(spark, d)
    paths = spark.createDataFrame([("src/1-URGENT",)], "path string")
    return version.affected(graph_delta(spark, d), new, paths)


@query(VERSIONS_SQL + "SELECT 'order' AS kind, (SELECT count(*) FROM a) AS n_old, (SELECT count(*) FROM b) AS n_new, (SELECT count(*) FROM delta) > 0 AS advanced")
def fingerprint(spark, d):
    old, new = two_versions(spark, d)
    a, b = (version.fingerprint(v, ["id", "label", "type"]) for v in (old, new))
    b = b.select(F.col("xor").alias("x2"), F.col("total").alias("t2"), F.col("n").alias("n_new"))
    return a.join(b).select(F.lit("order").alias("kind"), F.col("n").alias("n_old"), "n_new", ((F.col("xor") != F.col("x2")) | (F.col("total") != F.col("t2"))).alias("advanced"))


STEPS_SQL = """WITH a AS (SELECT l_orderkey AS flow_id, 'part:' || l_partkey AS node_id, min(l_linenumber) AS s FROM lineitem GROUP BY ALL), b AS (SELECT l_orderkey AS flow_id, 'part:' || l_partkey AS node_id, min(CASE WHEN l_orderkey % 5 = 0 THEN l_linenumber + 1 ELSE l_linenumber END) AS s FROM lineitem WHERE l_linenumber <> 3 GROUP BY ALL)
 SELECT coalesce(a.flow_id, b.flow_id) AS flow_id, coalesce(a.node_id, b.node_id) AS node_id, CASE WHEN a.s IS NULL THEN 'added' WHEN b.s IS NULL THEN 'removed' WHEN a.s <> b.s THEN 'moved' ELSE 'unchanged' END AS change FROM a FULL JOIN b ON a.flow_id = b.flow_id AND a.node_id = b.node_id"""


@query(STEPS_SQL)
def flow_comparison(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("flow_id"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("node_id"), F.col("l_linenumber").alias("n"))
    steps = lambda df, s: df.groupBy("flow_id", "node_id").agg(F.min(s).alias("step_idx"))
    return version.compare_steps(steps(line, F.col("n")), steps(line.where("n <> 3"), F.when(F.col("flow_id") % 5 == 0, F.col("n") + 1).otherwise(F.col("n"))))


@query("SELECT p_partkey, 'ref://local/shop%20one/part/' || replace(p_name, ' ', '%20') || '@' || p_size AS ref, p_name AS id, p_size::BIGINT AS version FROM part")
def ref_codec(spark, d):
    ref = version.context_ref("shop one", F.lit("part"), F.col("p_name"), F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", ref.alias("ref")).withColumn("p", version.parse_ref(F.col("ref"))).select("p_partkey", "ref", "p.id", "p.version")


@query("""WITH r AS (SELECT o_orderkey AS id, o_custkey AS path, (o_orderkey % 5)::INTEGER AS version FROM orders), cur AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 4 ELSE 1 END AS changed_at FROM orders WHERE o_orderkey % 3 <> 0), h AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 2 = 0), s AS (SELECT DISTINCT o_custkey AS path FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 3 <> 0)
 SELECT r.id, version, CASE WHEN version > 4 THEN 'unresolved' WHEN changed_at <= version THEN 'current' WHEN changed_at IS NOT NULL THEN 'stale' WHEN s.path IS NOT NULL THEN 'successor-candidate' WHEN version < 2 THEN 'expired' WHEN h.id IS NOT NULL THEN 'historical' ELSE 'unresolved' END AS status FROM r LEFT JOIN cur ON cur.id = r.id LEFT JOIN h ON h.id = r.id LEFT JOIN s ON s.path = r.path""")
def ref_resolution(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    refs = o.select(k.alias("id"), F.col("o_custkey").alias("path"), (k % 5).cast("int").alias("version"))
    now = o.where(k % 3 != 0)
    return version.resolve_refs(refs, now.select(k.alias("id"), F.when(k % 7 == 0, 4).otherwise(1).alias("changed_at")), o.where(k % 2 == 0).select(k.alias("id")), now.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("path")), 4, 2)


@query("""WITH r AS (SELECT c_custkey AS subject, (c_custkey % 6)::INTEGER AS version FROM customer), st(v) AS (VALUES (1), (2), (4), (5)), t AS (SELECT DISTINCT o_custkey AS subject, (o_orderkey % 5 + 1)::INTEGER AS v FROM orders WHERE o_orderkey % 11 = 0),
 x AS (SELECT r.*, (SELECT count(*) FROM st WHERE v > version AND v <= 5) AS present, (SELECT count(*) FROM t WHERE t.subject = r.subject AND v > version AND v <= 5) AS hits FROM r)
 SELECT subject, version, CASE WHEN version = 5 THEN 'current' WHEN version > 5 THEN 'future' WHEN hits > 0 THEN 'stale' WHEN present < 5 - version THEN 'indeterminate' ELSE 'compatible' END AS status FROM x""")
def version_chain(spark, d):
    records = table(spark, d, "customer").select(F.col("c_custkey").alias("subject"), (F.col("c_custkey") % 6).cast("int").alias("version"))
    steps = spark.createDataFrame([(v,) for v in (1, 2, 4, 5)], "to_version int")
    touching = table(spark, d, "orders").where("o_orderkey % 11 = 0").select(F.col("o_custkey").alias("subject"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("to_version"))
    return version.chain_status(records, steps, touching, 5)


@query("SELECT event_id, CASE WHEN v IS NULL THEN 'unavailable' WHEN v > 60 THEN 'future' WHEN v = 60 AND event_type = 'view' THEN 'current' ELSE 'stale' END AS freshness FROM (SELECT event_id, event_type, json_extract_string(props, '$.k')::INTEGER AS v FROM events)")
def freshness(spark, d):
    v = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select("event_id", version.freshness(v, F.col("event_type"), 60, "view").alias("freshness"))


# Ranking and text.

TERMS = "the and erre ction password license"


@query("""WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM documents) SELECT doc_id, coalesce(list_sum(list_transform(list_filter(w, lambda x: x IN ('the', 'and', 'erre', 'ction', 'password', 'license')), lambda x: CASE WHEN length(x) > 3 THEN 12 ELSE 4 END)), 0)::INTEGER AS score FROM w""".replace("\\\\", "\\"))
def token_overlap(spark, d):
    return table(spark, d, "documents").select("doc_id", rank.overlap_score(F.col("text"), F.lit(TERMS)).alias("score"))


@query("""WITH w AS (SELECT p_partkey, p_name, p_brand, p_size, list_distinct(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+')) AS w FROM part), s AS (SELECT p_partkey, coalesce(list_sum(list_transform(list_filter(w, lambda x: x IN ('part', '7', '12')), lambda x: CASE WHEN length(x) > 3 THEN 12 ELSE 4 END)), 0) + CASE WHEN p_brand = 'Brand#11' THEN 10000 ELSE 0 END + CASE WHEN p_size > 40 THEN 5000 + p_size ELSE 0 END AS score FROM w)
 SELECT p_partkey, score::INTEGER AS score FROM s WHERE score > 0""".replace("\\\\", "\\"))
def candidate_rank(spark, d):
    rows = rank.rank_candidates(table(spark, d, "part"), "Part 7 12", "p_partkey", "p_name", F.col("p_brand") == "Brand#11", F.when(F.col("p_size") > 40, F.col("p_size")).otherwise(0))
    return rows.select("p_partkey", F.col("score").cast("int").alias("score"))


@query("""SELECT doc_id, source AS path, score FROM (SELECT doc_id, source, (CASE WHEN contains(lower(source), 'src1') THEN 20 ELSE 0 END + least((length(lower(text)) - length(replace(lower(text), 'src1', ''))) // 4, 10) + CASE WHEN contains(lower(source), 'license') THEN 20 ELSE 0 END + least((length(lower(text)) - length(replace(lower(text), 'license', ''))) // 7, 10))::INTEGER AS score FROM documents) WHERE score > 0 ORDER BY score DESC, source, doc_id LIMIT 100""")
def literal_retrieval(spark, d):
    return rank.literal_retrieval(table(spark, d, "documents"), ["src1", "license"], "doc_id", "source", "text", 100).select("doc_id", F.col("source").alias("path"), "score")


@query("""WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents), c(term, concept) AS (VALUES ('license', 'legal'), ('rights', 'legal'), ('password', 'secret'), ('token', 'secret'), ('apache', 'legal')) SELECT concept, doc_id, count(DISTINCT term) AS reasons FROM t JOIN c USING (term) GROUP BY ALL""".replace("\\\\", "\\"))
def concept_index(spark, d):
    concepts = spark.createDataFrame([("license", "legal"), ("rights", "legal"), ("password", "secret"), ("token", "secret"), ("apache", "legal"), ("the", "legal"), ("the", "secret")], "term string, concept string")
    return rank.concept_index(table(spark, d, "documents"), concepts, "doc_id", ["text"])


@query("SELECT c_custkey, ceil(length('{\"c_custkey\":' || c_custkey || ',\"c_mktsegment\":\"' || c_mktsegment || '\"}') / 4)::BIGINT AS tokens FROM customer")
def token_estimate(spark, d):
    return table(spark, d, "customer").select("c_custkey", rank.token_estimate(["c_custkey", "c_mktsegment"]).alias("tokens"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Get Order' WHEN 1 THEN 'List Orders' WHEN 2 THEN 'Create Order' ELSE 'Delete Order' END AS title FROM orders""")
def route_semantics(spark, d):
    k = F.col("o_orderkey") % 4
    method = F.when(k < 2, "GET").when(k == 2, "POST").otherwise("DELETE")
    route = F.when(k.isin(1, 2), "/api/v1/orders").otherwise("/api/v1/orders/:id")
    return table(spark, d, "orders").select("o_orderkey", rank.route_title(method, route).alias("title"))


@query(GRAPH_SQL + """SELECT a.id, (CASE WHEN split_part(a.path, '/', 1) = split_part(b.path, '/', 1) THEN 1 ELSE 0 END + CASE WHEN split_part(a.path, '/', 2) = split_part(b.path, '/', 2) THEN 1 ELSE 0 END + CASE WHEN split_part(a.path, '/', 2) = split_part(b.path, '/', 2) AND split_part(a.path, '/', 3) = split_part(b.path, '/', 3) THEN 1 ELSE 0 END)::INTEGER AS depth FROM nodes a, (SELECT path FROM nodes WHERE id = 'customer:1') b""")
def shared_depth(spark, d):
    n = nodes(spark, d)
    one = n.where("id = 'customer:1'").select(F.col("path").alias("p"))
    return n.join(F.broadcast(one)).select("id", rank.shared_depth(F.col("path"), F.col("p")).alias("depth"))


# Journals.


@query(f"""WITH {JOURNAL_SQL}, s AS (SELECT run_id, count(*) AS n_events, count(*) FILTER (event_type = 'step-passed') AS passed_steps, count(*) FILTER (event_type = 'step-failed') AS failed_steps, arg_max(step, sequence) FILTER (event_type = 'step-started') AS current_step,
 arg_min(event_type, sequence) FILTER (event_type IN ('run-passed', 'step-failed')) AS e, arg_min(step, sequence) FILTER (event_type IN ('run-passed', 'step-failed')) AS stop FROM j GROUP BY run_id)
 SELECT run_id, n_events, passed_steps, failed_steps, current_step, CASE WHEN e = 'run-passed' THEN 'passed' WHEN e IS NOT NULL THEN 'failed' ELSE 'running' END AS outcome, CASE WHEN e = 'step-failed' THEN stop END AS stopped_at FROM s""")
def run_summary(spark, d):
    return journal.run_summary(journal_events(spark, d))


@query(f"""WITH {JOURNAL_SQL}, e AS (SELECT *, coalesce(bool_or(event_type IN ('run-passed', 'step-failed')) OVER (PARTITION BY run_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM j)
 SELECT CASE WHEN sequence = 0 AND event_type <> 'run-started' THEN 'not-started' WHEN sequence > 0 AND event_type = 'run-started' THEN 'started-again' WHEN over THEN 'after-end' ELSE 'accepted' END AS reason, count(*) AS n FROM e GROUP BY 1""")
def rejected_events(spark, d):
    return journal.rejections(journal_events(spark, d)).groupBy("reason").agg(F.count("*").alias("n"))


@query("""SELECT user_id || '-' || event_type AS operation, arg_min(value, event_id) AS value, CASE WHEN count(DISTINCT value) > 1 THEN 'conflict' WHEN count(*) > 1 THEN 'replayed' ELSE 'saved' END AS status FROM events GROUP BY 1""")
def idempotent_append(spark, d):
    e = table(spark, d, "events").select(F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("operation"), "value", "event_id")
    return journal.append_once(e, "operation", ["value"], "event_id")


@query("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10 AS kept, sha256(event_type || '|' || props) AS content_hash FROM events""")
def retention_manifest(spark, d):
    return journal.retention(table(spark, d, "events"), ["user_id"], "ts", "event_id", 10, ["event_type", "props"])


@query("""WITH m AS (SELECT event_id, user_id, event_type, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'new') AS from_state FROM events) SELECT from_state, event_type, count(*) AS n, (from_state, event_type) IN (('new', 'signup'), ('signup', 'view'), ('view', 'click'), ('click', 'purchase')) AS allowed FROM m GROUP BY ALL""")
def workflow_replay(spark, d):
    allowed = spark.createDataFrame([("new", "signup"), ("signup", "view"), ("view", "click"), ("click", "purchase")], "from_state string, to_state string")
    out = journal.replay(table(spark, d, "events").select("event_id", "user_id", "ts", "event_type"), allowed, "user_id", "ts", "event_id", "event_type", "new")
    return out.groupBy("from_state", "event_type", "allowed").agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events")
def timeline(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    return journal.timeline(e.select("user_id").distinct(), e, "user_id", "ts", "event_id").select("event_id", "user_id", "position")


@query("SELECT user_id, event_type, count(*) AS n, max(value) AS most FROM events GROUP BY ALL")
def stream_counts(spark, d):
    """Counts kept by a stream over the files of events; the state is written after each micro-batch."""
    from ..session import scratch_path
    from ..streaming.journal import each_batch

    rows = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")
    counts = rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("value").alias("most"))
    out = scratch_path(spark, "stream-counts")
    each_batch(counts, lambda df, _: df.write.mode("overwrite").parquet(out), scratch_path(spark, "stream-checkpoint"), "complete")
    return spark.read.schema(counts.schema).parquet(out)


# Sources, extraction and resolution.


def inventory_files(spark, d):
    """Documents as files: path, size and time of change."""
    docs = table(spark, d, "documents")
    path = F.concat(F.lit("src/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("lang") == "en", ".ts").when(F.col("lang") == "de", ".py").otherwise(".txt"))
    return docs.select(path.alias("path"), F.col("n_chars").alias("size"), (F.col("doc_id") % 1000).alias("mtime"), "text")


INVENTORY_SQL = "WITH f AS (SELECT 'src/' || source || '/' || doc_id || CASE lang WHEN 'en' THEN '.ts' WHEN 'de' THEN '.py' ELSE '.txt' END AS path, n_chars AS size, doc_id % 1000 AS mtime, text FROM documents)"


@query(INVENTORY_SQL + "SELECT path, CASE WHEN path LIKE '%.ts' THEN 'typescript' ELSE 'python' END AS language, sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS source_hash FROM f WHERE size <= 1000000 AND path NOT LIKE '%.txt'")
def file_scan(spark, d):
    f = inventory_files(spark, d).where(files.listed(F.col("path"), F.col("size")))
    return f.select("path", files.language(F.col("path")).alias("language"), F.sha2(F.regexp_replace("text", "\r\n?", "\n"), 256).alias("source_hash"))


@query(INVENTORY_SQL + """, l AS (SELECT CASE WHEN path LIKE '%.ts' THEN 'typescript' WHEN path LIKE '%.py' THEN 'python' END AS language, size FROM f)
 SELECT language, count(*) AS files, coalesce(sum(size), 0)::BIGINT AS bytes, CASE WHEN grouping(language) = 1 THEN CASE WHEN count(*) > 500 THEN 'file-limit-exceeded' WHEN sum(size) > 1000000 THEN 'byte-limit-exceeded' ELSE 'within-bounds' END END AS decision FROM l GROUP BY GROUPING SETS ((language), ())""")
def preflight(spark, d):
    f = inventory_files(spark, d)
    return files.discover(f.select(files.language(F.col("path")).alias("language"), "size"), 500, 1_000_000)


@query(INVENTORY_SQL + """, n AS (SELECT path, CASE WHEN mtime % 50 = 0 THEN size + 1 ELSE size END AS size, mtime FROM f WHERE mtime % 97 <> 3), p AS (SELECT path, size, mtime FROM f WHERE mtime % 89 <> 5)
 SELECT coalesce(p.path, n.path) AS path, CASE WHEN p.path IS NULL THEN 'source-added' WHEN n.path IS NULL THEN 'source-removed' ELSE 'source-changed' END AS reason FROM p FULL JOIN n ON p.path = n.path WHERE p.path IS NULL OR n.path IS NULL OR p.size <> n.size""")
def plan_verification(spark, d):
    f = inventory_files(spark, d).select("path", "size", "mtime")
    now = f.where("mtime % 97 <> 3").withColumn("size", F.when(F.col("mtime") % 50 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return files.verify_plan(f.where("mtime % 89 <> 5"), now)


@query(INVENTORY_SQL + """SELECT n.path, n.mtime % 50 = 0 OR p.path IS NULL AS reparsed FROM f n LEFT JOIN (SELECT path FROM f WHERE mtime % 89 <> 5) p ON p.path = n.path""")
def incremental_scan(spark, d):
    f = inventory_files(spark, d).select("path", "size", "mtime")
    now = f.withColumn("size", F.when(F.col("mtime") % 50 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return files.incremental(f.where("mtime % 89 <> 5"), now).select("path", "reparsed")


@query(INVENTORY_SQL + "SELECT path, size FROM f WHERE path LIKE 'src/src1/%'")
def subtree_scan(spark, d):
    return files.subtree(inventory_files(spark, d), "src/src1").select("path", "size")


@query("""SELECT * FROM (SELECT event_type AS path, event_id AS commit, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS rank, count(*) OVER (PARTITION BY event_type) > 20 AS truncated FROM events) WHERE rank <= 20""")
def path_history(spark, d):
    commits = table(spark, d, "events").select(F.col("event_type").alias("path"), F.col("event_id").alias("commit"), F.col("ts").alias("time"))
    return files.history(commits, commits.select("path"), 20).select("path", "commit", "rank", "truncated")


@query("""WITH v AS (SELECT page_id, kind, unnest(regexp_extract_all(html, '(?i)\\b(?:' || kind || CASE kind WHEN 'data' THEN '-[a-z0-9_-]+' ELSE '' END || ')[ ]*=[ ]*["'']([^"'']*)["'']', 1)) AS v FROM pages, (VALUES ('class'), ('id'), ('data')) k(kind)), w AS (SELECT DISTINCT page_id, kind, unnest(regexp_split_to_array(v, '[ \\t\\n\\r\\f]+')) AS w FROM v),
 k AS (SELECT page_id, list(kind || ':' || w ORDER BY kind || ':' || w) AS l FROM w WHERE length(w) BETWEEN 3 AND 120 AND lower(w) NOT IN ('active', 'btn', 'button', 'container', 'disabled', 'error', 'form', 'form-control', 'hidden', 'input', 'label', 'modal', 'row', 'selected', 'show', 'table', 'text', 'title', 'value', 'wrapper') GROUP BY page_id)
 SELECT page_id, coalesce(array_to_string(l[1:80], ' '), '') AS tokens FROM pages LEFT JOIN k USING (page_id)""")
def convention_tokens(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(extract.convention_tokens(F.col("html")), " ").alias("tokens"))


@query("""WITH t AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'src/app/shop/[id]/route.ts' WHEN 1 THEN 'src/routes/(main)/cart/[...rest]/+server.ts' ELSE 'pages/api/items/[key].ts' END AS path FROM part)
 SELECT p_partkey, CASE WHEN path LIKE '%route.ts' THEN '/shop/:id' WHEN path LIKE '%server.ts' THEN '/cart/*rest' ELSE '/api/items/:key' END AS route FROM t""")
def framework_routes(spark, d):
    s = F.col("p_size") % 3
    path = F.when(s == 0, "src/app/shop/[id]/route.ts").when(s == 1, "src/routes/(main)/cart/[...rest]/+server.ts").otherwise("pages/api/items/[key].ts")
    return table(spark, d, "part").select("p_partkey", extract.framework_route(path).alias("route"))


@query("""WITH u AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS s FROM pages) SELECT page_id, split_part(s, '/', 1) AS module, CASE WHEN contains(s, '/') THEN substring(s, length(split_part(s, '/', 1)) + 2) ELSE '' END AS rest FROM u""")
def module_prefix(spark, d):
    urls = table(spark, d, "pages").select(F.col("page_id").alias("path"), F.regexp_replace("url", "^https?://", "").alias("specifier"))
    modules = urls.select(F.substring_index("specifier", "/", 1).alias("module")).distinct()
    return resolve.longest_prefix(urls, modules).select(F.col("path").alias("page_id"), "module", "rest")


@query("""WITH i AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p FROM lineitem), f AS (SELECT p_partkey AS p, CASE WHEN p_size % 2 = 0 THEN '.ts' ELSE '/index.js' END AS e FROM part WHERE p_size % 5 <> 0)
 SELECT DISTINCT 'src/orders/' || (o % 100) || '.ts' AS path, '../parts/' || i.p AS specifier, CASE WHEN e IS NOT NULL THEN 'src/parts/' || i.p || e END AS target FROM i LEFT JOIN f ON f.p = i.p""")
def relative_imports(spark, d):
    key = F.col("l_partkey").cast("string")
    imports = table(spark, d, "lineitem").select(F.concat(F.lit("src/orders/"), (F.col("l_orderkey") % 100).cast("string"), F.lit(".ts")).alias("path"), F.concat(F.lit("../parts/"), key).alias("specifier"))
    there = table(spark, d, "part").where("p_size % 5 <> 0").select(F.concat(F.lit("src/parts/"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 2 == 0, ".ts").otherwise("/index.js")).alias("path"))
    return resolve.relative(imports, there)


# Packets.


@query(GRAPH_SQL + """, k AS (SELECT id, label, type FROM nodes WHERE type = 'nation'), o AS (SELECT source AS id, count(*) AS n FROM edges GROUP BY 1), i AS (SELECT target AS id, count(*) AS n FROM edges GROUP BY 1)
 SELECT k.id, label, coalesce(o.n, 0) AS outgoing_total, coalesce(i.n, 0) AS incoming_total, coalesce(i.n, 0) > 24 AS incoming_truncated FROM k LEFT JOIN o USING (id) LEFT JOIN i USING (id)""")
def node_cards(spark, d):
    n = nodes(spark, d)
    cards = packets.node_cards(n, edges(spark, d), n.where("type = 'nation'"))
    return cards.select("id", "label", "outgoing_total", "incoming_total", "incoming_truncated")


@query("""WITH RECURSIVE c AS (SELECT source, doc_id, n_chars AS size, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents), t AS (SELECT * FROM c WHERE r <= 20),
 w AS (SELECT source, 0::BIGINT AS r, 0::HUGEINT AS used, false AS included FROM (SELECT DISTINCT source FROM t) UNION ALL SELECT t.source, t.r, CASE WHEN used + size <= 20000 THEN used + size ELSE used END, used + size <= 20000 FROM w JOIN t ON t.source = w.source AND t.r = w.r + 1)
 SELECT source, doc_id, included FROM t JOIN w USING (source, r)""")
def budget_packing(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", F.col("n_chars").alias("size"))
    ranked = order.top_k(docs, ["source"], [F.desc("size"), F.asc("doc_id")], 20)
    return packets.pack(ranked, "source", "rank", "size", 20_000).select("source", "doc_id", "included")


@query("""WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey - 1 END AS supersedes, o_custkey AS plan_id, o_orderdate AS time, CASE o_orderstatus WHEN 'F' THEN 'implemented' WHEN 'O' THEN 'partial' ELSE 'unresolved' END AS verdict FROM orders),
 a AS (SELECT plan_id, arg_max(verdict, (time, id)) AS verdict FROM r WHERE id NOT IN (SELECT supersedes FROM r WHERE supersedes IS NOT NULL) GROUP BY plan_id)
 SELECT c_custkey AS plan_id, CASE WHEN verdict = 'implemented' THEN 'reconciled' WHEN verdict IS NOT NULL THEN verdict WHEN NOT c_acctbal > 0 THEN 'anchor-stale' ELSE 'planned-only' END AS status FROM customer LEFT JOIN a ON plan_id = c_custkey""")
def plan_status(spark, d):
    k = F.col("o_orderkey")
    verdict = F.when(F.col("o_orderstatus") == "F", "implemented").when(F.col("o_orderstatus") == "O", "partial").otherwise("unresolved")
    r = table(spark, d, "orders").select(k.alias("id"), F.when(k % 3 == 0, k - 1).alias("supersedes"), F.col("o_custkey").alias("plan_id"), F.col("o_orderdate").alias("time"), verdict.alias("verdict"))
    return packets.plan_status(table(spark, d, "customer").select(F.col("c_custkey").alias("plan_id"), (F.col("c_acctbal") > 0).alias("anchor_current")), r)


@query(GRAPH_SQL + """, g AS (SELECT feature, count(*) FILTER (kind = 'endpoint') AS e, count(*) AS n FROM nodes GROUP BY feature) SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT arg_max(feature, (e, n, feature)) FROM g) AS largest_feature""")
def project_home(spark, d):
    return packets.home(nodes(spark, d), edges(spark, d)).select("nodes", "edges", "largest_feature")


@query()
def mermaid(spark, d):
    """A drawing of regions and nations."""
    n = nodes(spark, d).where(F.col("type").isin("region", "nation"))
    return packets.mermaid(n, joins.retained_edges(edges(spark, d), n))
