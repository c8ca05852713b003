"""Composite views: cards, briefs, packets within a budget, comparisons of plans, dashboards and renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import filters, joins, order, rollup


def first(items: Column, order_by: Column, n: int) -> Column:
    """Aggregate: the first ``n`` items by an order.  Callers limit rows to ``n`` a group before, by rank."""
    return F.slice(F.transform(F.array_sort(F.collect_list(F.struct(order_by.alias("o"), items.alias("i")))), lambda s: s["i"]), 1, n)


def node_cards(nodes: DataFrame, edges: DataFrame, ids: DataFrame, most: int = 24) -> DataFrame:
    """A card for each id: label, type, counts of relations and the first ``most`` of both directions, with truncation."""
    out = ids.select("id").join(nodes.select("id", "label", "type", "domain", "feature"), "id")
    for end, other, name in (("source", "target", "outgoing"), ("target", "source", "incoming")):
        at = edges.join(ids.select(F.col("id").alias(end)), end, "left_semi")
        counts = at.groupBy(F.col(end).alias("id")).agg(F.count("*").alias(f"{name}_total"))
        rank = F.row_number().over(Window.partitionBy(end).orderBy("type", other))
        some = at.withColumn("_r", rank).where(F.col("_r") <= most).groupBy(F.col(end).alias("id")).agg(first(F.concat_ws(" ", "type", other), F.col("_r"), most).alias(name))
        out = out.join(counts, "id", "left").join(some, "id", "left").na.fill(0, [f"{name}_total"]).withColumn(f"{name}_truncated", F.col(f"{name}_total") > most)
    return out


def card_json(cards: DataFrame) -> DataFrame:
    """``(id, card, content_hash)``: a card as JSON and its hash."""
    body = F.to_json(F.struct(*[c for c in cards.columns]))
    return cards.select("id", body.alias("card"), F.sha2(body, 256).alias("content_hash"))


def view(nodes: DataFrame, edges: DataFrame, scope: str = "application", level: str | None = None, focus: str | None = None, max_nodes: int = 40, max_edges: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A bounded view: nodes of the scope, grouped by level if one is given; nodes, edges, and totals with omissions."""
    shown = filters.in_scope(nodes, scope)
    if level is None:
        return order.bounded(shown.select("id", "label", "type"), joins.retained_edges(edges, shown).select("source", "target", "type"), focus, max_nodes, max_edges)
    groups = rollup.group_nodes(shown, level).withColumnRenamed("group_id", "id")
    return order.bounded(groups, rollup.group_edges(shown, edges, level), focus, max_nodes, max_edges)


def mermaid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of text that draws a bounded view: at most 100 nodes and 200 edges, in order."""
    n, e, _ = order.bounded(nodes, edges, None, 100, 200)
    name = lambda c: F.concat(F.lit("n"), F.substring(F.sha2(c, 256), 1, 8))
    boxes = n.select(F.lit(1).alias("k"), F.col("id").alias("a"), F.lit("").alias("b"), F.concat(name(F.col("id")), F.lit('["'), F.replace("label", F.lit('"'), F.lit("'")), F.lit('"]')).alias("line"))
    arrows = e.select(F.lit(2).alias("k"), F.col("source").alias("a"), F.col("target").alias("b"), F.concat(name(F.col("source")), F.lit(" -->|"), F.col("type"), F.lit("| "), name(F.col("target"))).alias("line"))
    lines = boxes.union(arrows).agg(F.array_sort(F.collect_list(F.struct("k", "a", "b", "line"))).alias("l"))
    return lines.select(F.concat(F.lit("graph LR\n"), F.array_join(F.transform("l", lambda x: F.concat(F.lit("  "), x["line"])), "\n")).alias("text"))


def pack(items: DataFrame, request: str, rank: str, size: str, budget: int) -> DataFrame:
    """Items with ``included``: walking by rank, each item that still fits is taken and others are passed over.

    The walk is a fold over the ranked sizes of a request's candidates, which a
    ranking has limited before.
    """
    listed = items.groupBy(request).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(size).cast("long").alias("s")))).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{items.schema[rank].dataType.simpleString()}>").alias("in"))
    fold = F.aggregate("all", start, lambda s, x: F.when(s["used"] + x["s"] <= budget, F.struct((s["used"] + x["s"]).alias("used"), F.array_append(s["in"], x["r"]).alias("in"))).otherwise(s))
    taken = listed.select(request, fold.alias("f"))
    return items.join(taken, request).withColumn("included", F.array_contains("f.in", F.col(rank))).drop("f")


def plan_status(plans: DataFrame, reconciliations: DataFrame) -> DataFrame:
    """``(plan_id, status)`` of planned nodes ``(plan_id, anchor_current)`` and their latest active reconciliation ``(id, supersedes, plan_id, time, verdict)``."""
    latest = order.latest(order.active(reconciliations).select("plan_id", "time", "id", "verdict"), ["plan_id"], "time", "id").select("plan_id", "verdict")
    out = plans.join(latest, "plan_id", "left")
    status = (
        F.when(F.col("verdict") == "implemented", "reconciled")
        .when(F.col("verdict").isin("partial", "implemented-differently", "superseded", "unresolved"), F.col("verdict"))
        .when(~F.col("anchor_current"), "anchor-stale")
        .otherwise("planned-only")
    )
    return out.select("plan_id", status.alias("status"))


def divergence(commits: DataFrame, recorded: str, head: str, dirty: bool) -> str:
    """Relation of two commits ``(commit, parent)``: exact, working-tree-changed, ahead, behind or diverged, by ancestry."""
    from ..operators import traverse

    if recorded == head:
        return "working-tree-changed" if dirty else "exact"
    steps = commits.where("parent is not null").select(F.col("commit").alias("source"), F.col("parent").alias("target"))
    above = lambda c: traverse.reach(commits.sparkSession.createDataFrame([(c,)], "id string"), steps, 1_000_000)
    if not above(head).where(F.col("id") == recorded).isEmpty():
        return "ahead"
    return "diverged" if above(recorded).where(F.col("id") == head).isEmpty() else "behind"


def home(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of a dashboard: graph counts, and the feature with most endpoints."""
    features = nodes.groupBy("feature").agg(F.count_if(F.col("kind") == "endpoint").alias("endpoints"), F.count("*").alias("n"))
    return rollup.graph_stats(nodes, edges).join(features.agg(F.max_by("feature", F.struct("endpoints", "n", "feature")).alias("largest_feature")))
