"""Derived artifacts as a journal of records: reads, invalidation, audit and pruning.

A record is ``(record_id, type, key, graph_version, content_hash, paths,
created)``; ``paths`` are what it was derived from, ``*`` being everything.
Records are only ever appended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _newest(*more):
    return Window.partitionBy("type", "key").orderBy(F.desc("created"), F.desc("record_id"), *more)


def latest(records: DataFrame) -> DataFrame:
    """The newest record of each key."""
    return records.withColumn("_r", F.row_number().over(_newest())).where("_r = 1").drop("_r")


def hits(records: DataFrame, asked: DataFrame, graph_version: int) -> DataFrame:
    """``(type, key, status)`` of each key asked for: hit, stale (another version), corrupt (the content's hash differs) or miss."""
    found = latest(records).select("type", "key", "graph_version", "content_hash", F.sha2("content", 256).alias("_now"))
    status = F.when(F.col("graph_version").isNull(), "miss").when(F.col("graph_version") != graph_version, "stale").when(F.col("content_hash") != F.col("_now"), "corrupt").otherwise("hit")
    return asked.select("type", "key").distinct().join(found, ["type", "key"], "left").select("type", "key", status.alias("status"))


def invalidate(records: DataFrame, changed: DataFrame, topology: bool = False) -> DataFrame:
    """The newest records that a change affects: all if the topology changed, those derived from everything, and those from a changed path."""
    newest = latest(records)
    if topology:
        return newest.select("record_id", "type", "key")
    listed = newest.select("record_id", "type", "key", F.explode("paths").alias("path"))
    touched = listed.join(changed.select("path").distinct(), "path", "left_semi").unionByName(listed.where("path = '*'"))
    return touched.select("record_id", "type", "key").distinct()


def audit(records: DataFrame, graph_version: int) -> DataFrame:
    """``(type, status, n, bytes)``: newest records by currency, and older ones as superseded."""
    ranked = records.withColumn("_r", F.row_number().over(_newest()))
    status = F.when(F.col("_r") > 1, "superseded").when(F.col("graph_version") == graph_version, "current").otherwise("stale")
    return ranked.groupBy("type", status.alias("status")).agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))


def prune(records: DataFrame, keep: int = 4) -> DataFrame:
    """All records with ``kept``: the newest ``keep`` of each key."""
    return records.withColumn("kept", F.row_number().over(_newest()) <= keep)
