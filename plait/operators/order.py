"""Windows, limits and pages; every order ends with an id, so that results are the same each time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(rows: DataFrame, keys: list[str], time: str, id: str) -> DataFrame:
    """The newest row of each key; among equal times, the greatest id.  An aggregate, not a sort."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(time, id)).alias("r")).select(*keys, "r.*")


def active(records: DataFrame, id: str = "id", supersedes: str = "supersedes") -> DataFrame:
    """Records that no other record supersedes."""
    gone = records.where(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias(id)).distinct()
    return records.join(gone, id, "left_anti")


def lifecycle(records: DataFrame, id: str = "id", supersedes: str = "supersedes") -> DataFrame:
    """Records with ``lifecycle``: active or superseded."""
    gone = records.where(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias(id)).distinct().withColumn("_gone", F.lit(True))
    return records.join(gone, id, "left").withColumn("lifecycle", F.when(F.col("_gone"), "superseded").otherwise("active")).drop("_gone")


def sequence_faults(events: DataFrame, key: str, sequence: str) -> DataFrame:
    """Events whose sequence is not the one before plus 1, the first being 0."""
    own = Window.partitionBy(key).orderBy(sequence)
    return events.withColumn("expected", F.coalesce(F.lag(sequence).over(own), F.lit(-1)) + 1).where(F.col(sequence) != F.col("expected"))


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key, with ``rank``.  Spark limits each task's groups before it shuffles."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def bounded(nodes: DataFrame, edges: DataFrame, focus: str | None = None, max_nodes: int = 40, max_edges: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A view of at most so many nodes and edges: the focus first, then by id; edges with both ends kept, by source, target and type.

    Returns nodes, edges and one row of totals and omissions.
    """
    order = [F.when(F.col("id") == F.lit(focus), 0).otherwise(1), F.col("id")]
    kept = nodes.orderBy(*order).limit(max_nodes)
    ids = F.broadcast(kept.select("id"))
    inside = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    shown = inside.orderBy("source", "target", "type").limit(max_edges)
    totals = nodes.agg(F.count("*").alias("total_nodes")).join(edges.agg(F.count("*").alias("total_edges"))).join(kept.agg(F.count("*").alias("kept_nodes"))).join(shown.agg(F.count("*").alias("kept_edges")))
    totals = totals.withColumn("omitted_nodes", F.col("total_nodes") - F.col("kept_nodes")).withColumn("omitted_edges", F.col("total_edges") - F.col("kept_edges"))
    return kept, shown, totals


def listing(rows: DataFrame, time: str, id: str, limit: int, descending_id: bool = False, **filters) -> DataFrame:
    """The newest rows that meet all filters given (None: not given)."""
    for name, value in filters.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows.orderBy(F.desc(time), F.desc(id) if descending_id else F.asc(id)).limit(limit)


def page(rows: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """A page of rows in a total order; ``limit`` is held between 1 and 200."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(200, max(1, limit)))


def median_stats(rows: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """Exact median, mean, least and most."""
    return rows.groupBy(*keys).agg(F.median(value).alias("median"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.count(value).alias("n"))


def retain(files: DataFrame, order: list[Column], size: str, most_files: int, most_bytes: int) -> DataFrame:
    """Entries kept when walking in order: the first always; later ones that fit both bounds.  A misfit is skipped and the walk goes on.

    The walk is a fold over one array: lists of versions are short.
    """
    rows = files.withColumn("_rank", F.row_number().over(Window.orderBy(*order)))
    listed = rows.agg(F.array_sort(F.collect_list(F.struct("_rank", F.col(size).cast("long").alias("size")))).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("bytes"), F.array().cast("array<int>").alias("kept"))
    fits = lambda s, x: (F.size(s["kept"]) == 0) | ((F.size(s["kept"]) < most_files) & (s["bytes"] + x["size"] <= most_bytes))
    fold = F.aggregate("all", start, lambda s, x: F.when(fits(s, x), F.struct((s["bytes"] + x["size"]).alias("bytes"), F.array_append(s["kept"], x["_rank"]).alias("kept"))).otherwise(s))
    kept = listed.select(F.explode(fold["kept"]).alias("_rank")).withColumn("kept", F.lit(True))
    return rows.join(kept, "_rank", "left").withColumn("kept", F.coalesce("kept", F.lit(False))).drop("_rank")
