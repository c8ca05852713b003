"""Roll-ups, counts and ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEVELS = {"domain": ["domain"], "feature": ["domain", "feature"], "component": ["domain", "feature", "type"]}


def group_id(level: str) -> Column:
    """``level:part:part``, each part percent-encoded."""
    return F.concat_ws(":", F.lit(level), *[F.replace(F.url_encode(F.coalesce(F.col(c), F.lit(""))), F.lit("+"), F.lit("%20")) for c in LEVELS[level]])


def group_nodes(nodes: DataFrame, level: str, sample: int = 12) -> DataFrame:
    """``(group_id, members, first_members)``: nodes by hierarchy level.

    Samples are the smallest ids, the first ``sample`` of each group by rank,
    which tasks cut before rows are shuffled, so that no group is gathered.
    """
    keyed = nodes.select("id", group_id(level).alias("group_id"))
    rank = F.row_number().over(Window.partitionBy("group_id").orderBy("id"))
    first = keyed.withColumn("_r", rank).where(F.col("_r") <= sample).groupBy("group_id").agg(F.array_sort(F.collect_list("id")).alias("first_members"))
    return keyed.groupBy("group_id").agg(F.count("*").alias("members")).join(first, "group_id")


def type_counts(nodes: DataFrame, level: str) -> DataFrame:
    return nodes.groupBy(group_id(level).alias("group_id"), "type").agg(F.count("*").alias("members"))


def hierarchy(nodes: DataFrame) -> DataFrame:
    """All levels at once, by ROLLUP over domain, feature and component."""
    out = nodes.rollup("domain", "feature", "type").agg(F.count("*").alias("members"), F.grouping_id().alias("g"))
    return out.withColumn("level", F.when(F.col("g") == 0, "component").when(F.col("g") == 1, "feature").when(F.col("g") == 3, "domain").otherwise("all")).drop("g")


def group_edges(nodes: DataFrame, edges: DataFrame, level: str) -> DataFrame:
    """``(source, target, n_edges, type)`` between groups: edges inside a group go, several types become mixed."""
    keyed = nodes.select("id", group_id(level).alias("g"))
    out = edges.join(keyed.select(F.col("id").alias("source"), F.col("g").alias("s")), "source").join(keyed.select(F.col("id").alias("target"), F.col("g").alias("t")), "target")
    out = out.where("s <> t").groupBy(F.col("s").alias("source"), F.col("t").alias("target")).agg(F.count("*").alias("n_edges"), F.min("type").alias("least"), F.max("type").alias("most"))
    return out.select("source", "target", "n_edges", F.when(F.col("least") == F.col("most"), F.col("least")).otherwise("mixed").alias("type"))


def count_by(rows: DataFrame, column: str) -> DataFrame:
    """Counts by value; null and empty are ``unknown``."""
    key = F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit("unknown"))
    return rows.groupBy(key.alias("value")).agg(F.count("*").alias("n"))


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """Rounded ratio; null where the whole is not positive."""
    return F.when(whole > 0, F.round(part / whole, digits))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts; both sides are single rows before they meet."""
    of_nodes = nodes.agg(
        F.count("*").alias("nodes"), F.count_if(F.col("kind") == "endpoint").alias("endpoints"), F.count_if(F.col("layer") == "application").alias("application_nodes"),
        F.count_if(F.col("kind") == "external").alias("externals"), F.count_distinct("domain").alias("domains"), F.count_distinct("feature").alias("features"))
    of_edges = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("type") == "calls").alias("calls"), F.count_if(F.col("type") == "handles").alias("handles"), F.count_if(F.col("confidence") == "likely").alias("likely"))
    return of_nodes.join(of_edges)


def precision_recall(expected: DataFrame, actual: DataFrame, key: list[str], value: str) -> DataFrame:
    """For each key true and false positives, false negatives, precision and recall of distinct values."""
    e = expected.select(*key, value).distinct().withColumn("e", F.lit(1))
    a = actual.select(*key, value).distinct().withColumn("a", F.lit(1))
    both = e.join(a, [*key, value], "full").groupBy(*key).agg(F.count_if(F.col("e").isNotNull() & F.col("a").isNotNull()).alias("tp"), F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("a").isNull()).alias("fn"))
    return both.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"), 6)).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"), 6))


def readiness(dependencies: DataFrame, states: DataFrame, records: DataFrame) -> DataFrame:
    """For each record the counts of its dependencies' states, and whether it may start: all ready, or none there."""
    state = states.select(F.col("record_id").alias("depends_on"), "state")
    joined = dependencies.join(state, "depends_on", "left")
    counts = joined.groupBy("record_id").agg(
        F.count_if(F.col("state") == "done").alias("ready"), F.count_if(F.col("state") == "blocked").alias("blocking"), F.count_if(F.col("state").isNull()).alias("unknown"), F.count("*").alias("total"))
    out = records.select("record_id").join(counts, "record_id", "left").na.fill(0, ["ready", "blocking", "unknown", "total"])
    return out.withColumn("unresolved", F.col("total") - F.col("ready") - F.col("blocking") - F.col("unknown")).withColumn("ready_to_start", F.col("ready") == F.col("total"))


def gate(metrics: DataFrame, checks: dict[str, tuple[str, float]]) -> DataFrame:
    """``(check, actual, required, passed)`` for each threshold over a one-row frame; eligible is the conjunction."""
    rows = [F.struct(F.lit(name).alias("check"), F.col(column).cast("double").alias("actual"), F.lit(float(least)).alias("required"), F.coalesce(F.col(column).cast("double") >= least, F.lit(False)).alias("passed")) for name, (column, least) in checks.items()]
    return metrics.select(F.explode(F.array(*rows)).alias("c")).select("c.*")
