"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``[^\x20\x09-\x0D]+`` for Python bytes and for Java regular expressions.
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Whether a query's files of shuffles are deleted when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Seconds without use after which a worker lets go of a model.
IDLE_SECONDS = 5.0


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Read from ``spark.checkpoint.dir``; only where that is unset and the
    session is local a temporary folder of this machine is used, on a cluster
    that raises.  Also sets the checkpoint directory of the context, which
    ``checkpoint()`` needs.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not path:
        path = worker_cache().setdefault("shared_dir", None) or tempfile.mkdtemp(prefix="plait-")
        worker_cache()["shared_dir"] = path
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared folder."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables; they serve the results that read them, and :func:`release` drops them."""
    return f"{shared_dir(spark)}/plait/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once its results are written."""
    drop_path(spark, run_dir(spark))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, and survives lost executors."""
    return written(df, name)[0]


def written(df: DataFrame, name: str, free: bool = False) -> tuple[DataFrame, str]:
    """The same, with the path, for :func:`drop_path` when nothing reads it any more.

    With ``free``, Spark deletes the files of the shuffles that led to it as
    soon as it is written, without waiting for the driver's garbage collection.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(FREE_SHUFFLES, None)
    if free:
        spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if free and before is None:
            spark.conf.unset(FREE_SHUFFLES)
        elif free:
            spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def worker_cache() -> dict:
    """A dict that lives as long as the Python process; functions shipped by value find it again."""
    return sys.__dict__.setdefault("_plait_cache", {})


def worker_model(kind: str, digest: str, make: Callable):
    """The worker's model of a kind, made if it has none or one of another digest; to be called for each batch."""
    release_idle(kind)
    models = worker_cache().setdefault("models", {})
    if models.get(kind, ("",))[0] != digest:
        models.pop(kind, None)
        models[kind] = digest, make(), 0.0
    models[kind] = *models[kind][:2], time.monotonic()
    return models[kind][1]


def release_idle(kind: str = "") -> None:
    """Let go of models other than ``kind`` that have been idle, and give their memory back to the system.

    Workers outlive stages: what an earlier operator keeps, such as 400,000
    words with their tokens, would stay beside what the present one needs.
    """
    models, now = worker_cache().get("models", {}), time.monotonic()
    gone = [k for k, (_, _, used) in models.items() if k != kind and now - used > IDLE_SECONDS]
    for k in gone:
        del models[k]
    if gone:
        import pyarrow as pa

        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(key: str, modulus: int):
    """crc32 of the decimal form of an id, modulo ``modulus`` (null ids: the empty string's, 0)."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def fold_of(key: object, modulus: int) -> int:
    """The same on the Python side."""
    import zlib

    return zlib.crc32(b"" if key is None else str(key).encode()) % modulus


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected ``links``: one row ``(id, component)`` per linked id, component being the smallest id reachable.

    Alternating large-star and small-star steps on a distributed edge table
    (Kiveris et al., 2014).  Each round is two group-bys and two joins keyed by
    vertex; no group is collected, so a vertex with very many neighbours is
    only a skewed join key, which adaptive execution splits.  Rounds write
    reliable checkpoints.  The number of rounds is logarithmic in practice.
    Null ids are dropped; self-links keep their id with itself as component.
    """
    spark = links.sparkSession
    shared_dir(spark)
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    edges = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    before = None
    while True:
        # Large star: every larger neighbour of u is linked to the smallest of u's neighbourhood.
        both = edges.where("u <> v").select("u", "v").union(edges.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: all not larger neighbours of u, and u, are linked to the smallest of them.
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = small.where("u <> v").distinct().checkpoint()
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    return ids.join(edges.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))
