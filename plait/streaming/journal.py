"""Journals as streams: micro-batches of files, deduplication by operation, and runs as keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.journal import TERMINAL

SUMMARY = StructType([StructField("run_id", StringType()), StructField("n_events", LongType()), StructField("outcome", StringType()), StructField("expected", LongType()), StructField("rejected", LongType())])


def event_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 16) -> DataFrame:
    """New Parquet files of a folder, a bounded number each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def once(events: DataFrame, operation: str, time: str, lateness: str = "1 hour") -> DataFrame:
    """Each operation once; its state is dropped after ``lateness``."""
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark([operation])


def follow_runs(events: DataFrame) -> DataFrame:
    """Summaries of runs ``(run_id, sequence, event_type)``, updated by each micro-batch.

    An event out of sequence, or after the end, is counted as rejected and
    changes nothing; events of one micro-batch are put in order first.
    """

    def step(key: tuple, parts: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        n, outcome, expected, rejected = state.get if state.exists else (0, "running", 0, 0)
        rows = pd.concat(list(parts)).sort_values("sequence")
        for sequence, kind in zip(rows["sequence"], rows["event_type"], strict=True):
            if outcome != "running" or sequence != expected:
                rejected += 1
                continue
            n, expected = n + 1, expected + 1
            if kind in TERMINAL:
                outcome = {"run-passed": "passed", "run-cancelled": "cancelled"}.get(kind, "failed")
        state.update((n, outcome, expected, rejected))
        yield pd.DataFrame({"run_id": [key[0]], "n_events": [n], "outcome": [outcome], "expected": [expected], "rejected": [rejected]})

    kept = StructType(SUMMARY.fields[1:])
    return events.groupBy("run_id").applyInPandasWithState(step, SUMMARY, kept, "update", GroupStateTimeout.NoTimeout)


def each_batch(stream: DataFrame, apply: Callable[[DataFrame, int], Any], checkpoint: str, mode: str = "update"):
    """Run all that is there in micro-batches, each given once to ``apply``; returns the finished query."""
    query = stream.writeStream.outputMode(mode).foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
