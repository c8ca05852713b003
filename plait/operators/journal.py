"""Append-only journals and the state machines folded over them, in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TERMINAL = ("run-passed", "run-failed", "step-failed", "run-cancelled")


def run_summary(events: DataFrame, run: str = "run_id", sequence: str = "sequence", kind: str = "event_type", step: str = "step") -> DataFrame:
    """One row for each run: events, last step started, first terminal event and where it stopped.

    Every column is an aggregate by extreme, so that runs are never gathered.
    """
    started = F.when(F.col(kind) == "step-started", F.struct(sequence, step))
    ended = F.when(F.col(kind).isin(*TERMINAL), F.struct(sequence, kind, step))
    out = events.groupBy(run).agg(F.count("*").alias("n_events"), F.max(started).alias("s"), F.min(ended).alias("e"), F.count_if(F.col(kind) == "step-passed").alias("passed_steps"), F.count_if(F.col(kind) == "step-failed").alias("failed_steps"))
    outcome = F.when(F.col(f"e.{kind}") == "run-passed", "passed").when(F.col(f"e.{kind}") == "run-cancelled", "cancelled").when(F.col("e").isNotNull(), "failed").otherwise("running")
    return out.select(run, "n_events", "passed_steps", "failed_steps", F.col(f"s.{step}").alias("current_step"), outcome.alias("outcome"), F.when(outcome == "failed", F.col(f"e.{step}")).alias("stopped_at"))


def rejections(events: DataFrame, run: str = "run_id", sequence: str = "sequence", kind: str = "event_type") -> DataFrame:
    """Events with why a strict journal rejects them: not started first, started again, after the end, or accepted."""
    own = Window.partitionBy(run).orderBy(sequence)
    ended = F.max(F.col(kind).isin(*TERMINAL)).over(own.rowsBetween(Window.unboundedPreceding, -1))
    reason = F.when((F.col(sequence) == 0) & (F.col(kind) != "run-started"), "not-started").when((F.col(sequence) > 0) & (F.col(kind) == "run-started"), "started-again").when(F.coalesce(ended, F.lit(False)), "after-end").otherwise("accepted")
    return events.withColumn("reason", reason)


def append_once(rows: DataFrame, operation: str, content: list[str], order: str) -> DataFrame:
    """One row for each operation: the first; ``status`` is conflict where a repeat has other content, replayed where it has the same."""
    body = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    return rows.withColumn("_h", body).groupBy(operation).agg(F.min_by(F.struct(*content), order).alias("r"), F.count("*").alias("n"), F.count_distinct("_h").alias("kinds")).select(
        operation, "r.*", F.when(F.col("kinds") > 1, "conflict").when(F.col("n") > 1, "replayed").otherwise("saved").alias("status"))


def retention(rows: DataFrame, keys: list[str], time: str, id: str, keep: int, content: list[str]) -> DataFrame:
    """All rows with ``kept``: the newest ``keep`` of each key; of the others only a hash of the content is left."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(time), F.desc(id)))
    kept = rank <= keep
    return rows.select(*keys, id, kept.alias("kept"), F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in content]), 256).alias("content_hash"))


def replay(events: DataFrame, transitions: DataFrame, record: str, time: str, id: str, to_state: str, initial: str) -> DataFrame:
    """Events with their former state and whether the workflow's transition table allows them."""
    own = Window.partitionBy(record).orderBy(time, id)
    moved = events.withColumn("from_state", F.coalesce(F.lag(to_state).over(own), F.lit(initial)))
    allowed = transitions.select("from_state", F.col("to_state").alias(to_state), F.lit(True).alias("_ok")).distinct()
    return moved.join(allowed, ["from_state", to_state], "left").withColumn("allowed", F.coalesce("_ok", F.lit(False))).drop("_ok")


def timeline(records: DataFrame, events: DataFrame, record: str, time: str, id: str) -> DataFrame:
    """Events of the records with their position, in order of time and id."""
    rank = F.row_number().over(Window.partitionBy(record).orderBy(time, id))
    return events.join(records.select(record), record, "left_semi").withColumn("position", rank)
