"""Graphs bound to relational tables.

``nodes`` and ``edges`` turn the star schema of the test data into a property
graph: every row of region, nation, customer, supplier, part and orders is a
node, every foreign key an edge.  The SQL texts bind the same graph in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def node_id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, kind, type, label, domain, feature, layer, path)``."""
    region, nation, customer, supplier, part, orders = (table(spark, folder, t) for t in ("region", "nation", "customer", "supplier", "part", "orders"))
    placed = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))

    def shape(df, kind, key, label, domain, feature, layer):
        return df.select(node_id(kind, key).alias("id"), F.lit("endpoint" if kind == "order" else "symbol" if kind == "customer" else "external").alias("kind"), F.lit(kind).alias("type"), label.alias("label"), domain.alias("domain"), feature.alias("feature"), F.lit(layer).alias("layer"))

    where = customer.join(placed, F.col("c_nationkey") == F.col("n_nationkey"))
    out = [
        shape(region, "region", "r_regionkey", F.col("r_name"), F.col("r_name"), F.col("r_name"), "framework"),
        shape(placed, "nation", "n_nationkey", F.col("n_name"), F.col("r_name"), F.col("n_name"), "framework"),
        shape(where, "customer", "c_custkey", F.col("c_name"), F.col("r_name"), F.col("c_mktsegment"), "application"),
        shape(supplier.join(placed, F.col("s_nationkey") == F.col("n_nationkey")), "supplier", "s_suppkey", F.col("s_name"), F.col("r_name"), F.col("n_name"), "runtime"),
        shape(part, "part", "p_partkey", F.col("p_name"), F.col("p_type"), F.col("p_brand"), "package"),
        shape(orders.join(where, F.col("o_custkey") == F.col("c_custkey")), "order", "o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), F.col("r_name"), F.col("o_orderpriority"), "application"),
    ]
    union = out[0]
    for df in out[1:]:
        union = union.unionByName(df)
    slug = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    return union.withColumn("path", F.concat_ws("/", F.lit("src"), slug("domain"), slug("feature"), F.concat(F.replace("id", F.lit(":"), F.lit("-")), F.lit(".ts"))))


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """``(source, target, type, confidence, edge_ord)``; edge_ord numbers a source's edges by type and target."""
    nation, customer, supplier, orders, line = (table(spark, folder, t) for t in ("nation", "customer", "supplier", "orders", "lineitem"))

    def shape(df, a, ak, b, bk, kind):
        return df.select(node_id(a, ak).alias("source"), node_id(b, bk).alias("target"), F.lit(kind).alias("type"))

    out = [
        shape(customer, "customer", "c_custkey", "nation", "c_nationkey", "contains"),
        shape(nation, "nation", "n_nationkey", "region", "n_regionkey", "contains"),
        shape(orders, "order", "o_orderkey", "customer", "o_custkey", "handles"),
        shape(line.select("l_orderkey", "l_partkey").distinct(), "order", "l_orderkey", "part", "l_partkey", "calls"),
        shape(line.select("l_partkey", "l_suppkey").distinct(), "part", "l_partkey", "supplier", "l_suppkey", "uses"),
        shape(supplier, "supplier", "s_suppkey", "nation", "s_nationkey", "imports"),
    ]
    union = out[0]
    for df in out[1:]:
        union = union.unionByName(df)
    own = Window.partitionBy("source").orderBy("type", "target")
    return union.withColumn("confidence", F.when(F.col("type").isin("calls", "uses"), "likely").otherwise("exact")).withColumn("edge_ord", F.row_number().over(own).cast("long"))


NODES_SQL = """
placed AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
located AS (SELECT c_custkey, c_name, c_mktsegment, r_name FROM customer JOIN placed ON c_nationkey = n_nationkey),
bare AS (
  SELECT 'region:' || r_regionkey AS id, 'external' AS kind, 'region' AS type, r_name AS label, r_name AS domain, r_name AS feature, 'framework' AS layer FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'external', 'nation', n_name, r_name, n_name, 'framework' FROM placed
  UNION ALL SELECT 'customer:' || c_custkey, 'symbol', 'customer', c_name, r_name, c_mktsegment, 'application' FROM located
  UNION ALL SELECT 'supplier:' || s_suppkey, 'external', 'supplier', s_name, r_name, n_name, 'runtime' FROM supplier JOIN placed ON s_nationkey = n_nationkey
  UNION ALL SELECT 'part:' || p_partkey, 'external', 'part', p_name, p_type, p_brand, 'package' FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'endpoint', 'order', 'order ' || o_orderkey, r_name, o_orderpriority, 'application' FROM orders JOIN located ON o_custkey = c_custkey),
nodes AS (SELECT *, 'src/' || regexp_replace(lower(domain), '[^a-z0-9]+', '-', 'g') || '/' || regexp_replace(lower(feature), '[^a-z0-9]+', '-', 'g') || '/' || replace(id, ':', '-') || '.ts' AS path FROM bare)"""

EDGES_SQL = """
linked AS (
  SELECT 'customer:' || c_custkey AS source, 'nation:' || c_nationkey AS target, 'contains' AS type FROM customer
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'contains' FROM nation
  UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'handles' FROM orders
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, 'calls' FROM lineitem
  UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'uses' FROM lineitem
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'imports' FROM supplier),
edges AS (SELECT *, CASE WHEN type IN ('calls', 'uses') THEN 'likely' ELSE 'exact' END AS confidence, row_number() OVER (PARTITION BY source ORDER BY type, target) AS edge_ord FROM linked)"""

GRAPH_SQL = f"WITH {NODES_SQL}, {EDGES_SQL}\n"
