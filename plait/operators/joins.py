"""Joins of graphs: lookups with fallbacks, at-most-one and first matches, comparisons, co-occurrence; and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_ends(edges: DataFrame, nodes: DataFrame, columns: tuple[str, ...] = ("label", "type", "domain", "feature")) -> DataFrame:
    """Edges with columns of both ends; edges with a missing end go."""
    out = edges
    for end in ("source", "target"):
        out = out.join(nodes.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns]), end)
    return out


def lookup_or(left: DataFrame, right: DataFrame, keys: list[str], found: str, fallback: Column, binding: str = "binding") -> DataFrame:
    """Left rows with ``found`` of the matching right row, or a fallback; ``binding`` says which.  Right keys must be unique."""
    joined = left.join(right.select(*keys, F.col(found).alias("_found")), keys, "left")
    return joined.withColumn(binding, F.when(F.col("_found").isNotNull(), "exact").otherwise("fallback")).withColumn(found, F.coalesce("_found", fallback)).drop("_found")


def unique_match(left: DataFrame, right: DataFrame, keys: list[str], found: str) -> DataFrame:
    """Left rows with exactly one matching right row.  Right is counted by key before the join, so that no candidates are listed."""
    one = right.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(found).alias(found)).where("_n = 1").drop("_n")
    return left.join(one, keys)


def first_match(left: DataFrame, right: DataFrame, keys: list[str], found: str, order: str) -> DataFrame:
    """Left rows with the right row of least ``order`` for their key."""
    return left.join(right.groupBy(*keys).agg(F.min_by(found, F.struct(order, found)).alias(found)), keys)


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the position of its first occurrence, the values of its last."""
    others = [c for c in rows.columns if c not in keys and c != order]
    return rows.groupBy(*keys).agg(F.min(order).alias(order), *[F.max_by(c, order).alias(c) for c in others])


def unmatched(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows whose key the others don't have; rows without a key stay, as nothing matches them."""
    return rows.join(others.select(key), key, "left_anti")


def compare(before: DataFrame, after: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """``(key, change)`` of added, removed and changed keys, by a full outer join; unchanged ones are left out."""
    body = F.to_json(F.struct(*compared), {"ignoreNullFields": "false"})
    old = before.select(key, body.alias("_old"))
    new = after.select(key, body.alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return old.join(new, key, "full").select(key, change.alias("change")).where("change is not null")


def retained_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose two ends are both kept."""
    keep = ids.select("id")
    return edges.join(keep.withColumnRenamed("id", "source"), "source", "left_semi").join(keep.withColumnRenamed("id", "target"), "target", "left_semi")


def cooccurrence(tokens: DataFrame, key: str, token: str, least: int = 2, top: int = 12) -> DataFrame:
    """For each key its ``top`` others by shared distinct tokens, at least ``least`` of them.

    All tokens count, however frequent.  Keys of equal token sets are one group
    and groups are paired, so that copies do not multiply; a group's list is
    longer by one than ``top``, for the key itself is in its own group.
    """
    rows = tokens.select(F.col(key).alias("a"), F.col(token).alias("t")).where("t is not null").distinct()
    sets = rows.groupBy("a").agg(F.sort_array(F.collect_set("t")).alias("ts"))
    within = Window.partitionBy("ts").orderBy("a")
    members = sets.select("a", F.first("a").over(within).alias("g"), F.row_number().over(within).alias("n"), "ts")
    each = members.where("n = 1").select("g", F.explode("ts").alias("t"))
    pairs = each.join(each.withColumnRenamed("g", "h"), "t").groupBy("g", "h").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    # A group is named by its least key, so the best groups hold the best keys.
    best = pairs.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("shared"), "h"))).where(F.col("r") <= top + 1).drop("r")
    others = members.where(F.col("n") <= top + 1).select(F.col("g").alias("h"), F.col("a").alias("b"))
    listed = best.join(others, "h").withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("shared"), "b"))).where(F.col("r") <= top + 1).select("g", "b", "shared")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("shared"), "b"))
    found = members.select("a", "g").join(listed, "g").where("a <> b").select("a", "b", "shared")
    return found.withColumn("rank", rank).where(F.col("rank") <= top)


def union_distinct(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()


def kept_in(expected: Column, actual: Column) -> Column:
    """Elements of the first array that the second holds, repeats and order kept."""
    return F.filter(expected, lambda x: F.array_contains(actual, x))
