"""Size-tiered compaction of append-only shards with versioned manifests.

A store is a folder.  Arrivals are appended as small immutable shards; nothing
is ever changed in place.  Compaction takes runs (shards) of similar size, at
least a few of one size tier, merges them into files of a target size, and
commits a manifest that names the shards of the new version: the merged files,
and by name, without reading them, all shards that were not merged.

``data/folder=F/shard=S`` holds a shard; every writer has a folder of its own,
so that what a killed writer leaves behind is in nobody's way.  A manifest is a
table, one row a shard with size and rows, and a version is a small file
``versions/N`` that names one.  It is created where no such file exists, so of
two writers one wins, and readers see whole versions.

The rows go through DataFrame operations only.  Which shard goes where is
planned on the manifest; appending needs no shuffle of rows, merging one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .common import drop_path, materialise

SHARD_ROWS = 4096
TARGET_BYTES = 64_000_000
FAN_IN = 4
#: Rows of a plan up to which it is broadcast, some 100 bytes each.
BROADCAST_ROWS = 200_000
#: A manifest's columns: where a shard is, its place in the order of arrivals, its size, the tier of its runs, how often its rows were merged.
MANIFEST = "folder string, shard string, seq long, arrival long, split long, bytes long, rows long, tier int, generation int"
OWN = ("folder", "shard", "tier")


class ManifestStore:
    """Versions of a store; each is a table of its shards."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[int]:
        folder = self._path(f"{self.path}/versions")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit()) if self._fs.exists(folder) else []

    def read(self, version: int | None = None) -> dict:
        """A version's record, by default the newest; ``version`` 0 is the empty store."""
        for v in reversed(self._names()) if version is None else [version]:
            if v:
                stream = self._fs.open(self._path(f"{self.path}/versions/{v}"))
                try:
                    text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                finally:
                    stream.close()
                # A writer that was killed between creating and writing leaves an empty file: no version.
                if text.endswith("}"):
                    return json.loads(text)
        return {"version": 0, "manifest": None, "schema": None}

    def versions(self) -> list[int]:
        return [v for v in self._names() if self.read(v)["version"] == v]

    def shards(self, version: int | None = None) -> DataFrame:
        """A version's manifest: one row a shard."""
        record = self.read(version)
        return self.spark.read.schema(MANIFEST).parquet(record["manifest"]) if record["manifest"] else self.spark.createDataFrame([], MANIFEST)

    def commit(self, shards: DataFrame, schema: StructType, base: int) -> int:
        """Publish a manifest as the version after ``base``; raises if another writer has published since."""
        if (newest := self.read()["version"]) != base:
            raise RuntimeError(f"version {newest} was committed by another writer")
        version = max(self._names(), default=0) + 1
        manifest = f"{self.path}/manifests/{uuid.uuid4().hex}"
        shards.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in MANIFEST.split(", ")]).write.parquet(manifest)
        try:
            out = self._fs.create(self._path(f"{self.path}/versions/{version}"), False)
        except Exception as e:
            drop_path(self.spark, manifest)
            raise RuntimeError(f"version {version} was committed by another writer") from e
        out.write(bytearray(json.dumps({"version": version, "manifest": manifest, "schema": schema.jsonValue()}).encode()))
        out.close()
        return version

    def data(self, schema: StructType, shards: DataFrame) -> DataFrame:
        """The rows of some shards, with the manifest's ``folder`` and ``shard``.

        Both are partition columns, so that the join prunes the folders that
        are read; shards are broadcast up to ``BROADCAST_ROWS``.
        """
        named = shards if shards.count() > BROADCAST_ROWS else F.broadcast(shards)
        whole = StructType([*schema.fields]).add("folder", "string").add("shard", "string")
        if not self._fs.exists(self._path(f"{self.path}/data")):
            return self.spark.createDataFrame([], whole).join(named, ["folder", "shard"])
        return self.spark.read.schema(whole).parquet(f"{self.path}/data").join(named, ["folder", "shard"])

    def frame(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with ``folder``, ``shard``, ``tier`` and ``arrival`` (the number it arrived under)."""
        record = self.read(version)
        if not record["manifest"]:
            raise ValueError("the store is empty")
        return self.data(StructType.fromJson(record["schema"]), self.shards(record["version"]).select("folder", "shard", "tier"))


def row_bytes(text: str = "text"):
    """The size a row counts for: its text's bytes and 16 for its other columns; null: 16."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def tier_of(size):
    """The whole part of a size's logarithm to base 4."""
    return F.floor((F.length(F.bin(size)) - 1) / 2).cast("int")


def place(key: str):
    """The order of rows within a shard: keys that are whole numbers by value, others and null keys by hash, before them."""
    return F.coalesce(F.expr(f"try_cast(`{key}` AS BIGINT)"), F.lit(-(2**62)) + F.pmod(F.xxhash64(F.col(key)), F.lit(2**40)))


def small(df: DataFrame) -> DataFrame:
    """``df`` for a join: broadcast up to ``BROADCAST_ROWS`` rows, else joined by shuffling."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def plan(shards: DataFrame, target: int = TARGET_BYTES, fan_in: int = FAN_IN) -> DataFrame:
    """The shards of a manifest with ``size_tier``, ``merged`` and ``ahead``.

    A tier with fewer than ``fan_in`` runs below ``target`` bytes, and runs of
    ``target`` bytes or more, stay as they are.  ``ahead`` is the number of
    bytes of the tier before the run, in order of arrival: the run's rows go
    to the files ``floor((ahead + bytes before the row) / target)``.
    """
    tiered = shards.withColumn("size_tier", tier_of(F.col("bytes")))
    runs = F.count_if(F.col("bytes") < target).over(Window.partitionBy("size_tier"))
    tiered = tiered.withColumn("merged", (runs >= fan_in) & (F.col("bytes") < target))
    order = Window.partitionBy("size_tier", "merged").orderBy("seq", "arrival", "split", "folder", "shard").rowsBetween(Window.unboundedPreceding, -1)
    return tiered.withColumn("ahead", F.coalesce(F.sum("bytes").over(order), F.lit(0)))


def append(store: ManifestStore, docs: DataFrame, key: str = "doc_id", text: str = "text", rows: int = SHARD_ROWS) -> int:
    """Write ``docs`` as small shards, without a shuffle of rows, and commit the version that has them.

    ``rows`` consecutive keys make an arrival.  An arrival of more rows than
    that, which only repeated keys, null keys and keys that aren't numbers can
    make, is dealt to as many shards as it needs, by hash and row, so no shard
    grows with a hot key.  Columns named folder, shard, tier or arrival are
    the store's and are replaced.  An empty arrival makes a version with no
    more rows than before.  Repeated rows stay repeated.
    """
    base = store.read()
    folder = uuid.uuid4().hex
    docs = docs.drop(*OWN, "arrival")
    number = F.coalesce(F.floor(F.expr(f"try_cast(`{key}` AS BIGINT)") / rows), F.lit(-1)).cast("long")
    numbered = docs.withColumn("arrival", number)
    full = numbered.groupBy("arrival").count().where(F.col("count") > rows).select("arrival", F.ceil(F.col("count") / rows).cast("long").alias("_splits"))
    full = materialise(full, "full")
    split = F.lit(0).cast("long")
    if full.count():
        numbered = numbered.join(small(full), "arrival", "left")
        split = F.coalesce(F.pmod(F.xxhash64(F.col(text), F.monotonically_increasing_id()), F.col("_splits")), split)
    placed = numbered.withColumn("shard", F.concat(F.lit("s"), F.col("arrival"), F.when(split > 0, F.concat(F.lit("."), split)).otherwise(""))).select(*docs.columns, "arrival", "shard")
    path = f"{store.path}/data/folder={folder}"
    placed.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    schema = placed.drop("shard").schema
    held = store.spark.read.schema(placed.schema).parquet(path)
    sizes = held.groupBy("shard", "arrival").agg(F.sum(row_bytes(text)).alias("bytes"), F.count("*").alias("rows"))
    version = base["version"] + 1
    number_of_split = F.coalesce(F.expr("try_element_at(split(shard, '[.]'), 2)").cast("long"), F.lit(0))
    new = sizes.select(F.lit(folder).alias("folder"), "shard", F.lit(version).cast("long").alias("seq"), "arrival", number_of_split.alias("split"), "bytes", "rows", tier_of(F.col("bytes")).alias("tier"), F.lit(0).alias("generation"))
    known = StructType.fromJson(base["schema"]) if base["schema"] else StructType()
    for f in known.fields:
        if f.name in schema.names and schema[f.name].dataType != f.dataType:
            raise TypeError(f"column {f.name} has another type in the store")
    merged = StructType([*known.fields, *(f for f in schema.fields if f.name not in known.names)])
    return store.commit(store.shards(base["version"]).unionByName(new), merged, base["version"])


def compact(store: ManifestStore, key: str = "doc_id", text: str = "text", target: int = TARGET_BYTES, fan_in: int = FAN_IN) -> int:
    """Merge runs of similar size into target-sized files and commit the version; returns its number.

    Only the rows of merged runs are read and written.  A run's rows are
    walked in order of keys and, for equal keys, of their texts' hashes; the
    walk sees those and sizes only.  What comes of it is the first key of each
    file that a run's rows go to, a few rows a run, with which the rows find
    their file.  A file exceeds ``target`` by one row's size, or that of equal
    rows of a run.  Where nothing is to be merged the newest version stays.
    Old shards stay readable through older versions until :func:`vacuum`.
    """
    base = store.read()
    if not base["manifest"]:
        raise ValueError("the store is empty")
    planned = materialise(plan(store.shards(base["version"]), target, fan_in), "plan")
    chosen = planned.where("merged").select("folder", "shard", "size_tier", "ahead", "generation")
    if chosen.isEmpty():
        return base["version"]
    schema = StructType.fromJson(base["schema"])
    rows = store.data(schema, chosen)
    order = F.struct(place(key).alias("k"), F.xxhash64(F.col(text)).alias("h"))
    sizes = rows.groupBy("folder", "shard", "size_tier", "ahead", order.alias("at")).agg(F.sum(row_bytes(text)).alias("bytes"), F.count("*").alias("rows"))
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy("folder", "shard").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    walked = materialise(sizes.withColumn("number", F.floor((F.col("ahead") + before) / target).cast("long")).groupBy("folder", "shard", "size_tier", "number").agg(F.min("at").alias("first"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")), "bounds")
    bounds = walked.groupBy("folder", "shard", "size_tier").agg(F.array_sort(F.collect_list(F.struct("first", "number"))).alias("_bounds"))
    found = F.element_at(F.filter("_bounds", lambda b: b["first"] <= order), -1)["number"]
    placed = store.data(schema, chosen.select("folder", "shard")).join(small(bounds), ["folder", "shard"])
    placed = placed.withColumn("_file", F.concat(F.lit("t"), F.col("size_tier"), F.lit("-"), found)).select(*schema.names, F.col("_file").alias("shard"))
    folder = uuid.uuid4().hex
    placed.repartition("shard").write.option("compression", "zstd").partitionBy("shard").parquet(f"{store.path}/data/folder={folder}")
    generation = planned.where("merged").agg(F.max("generation")).first()[0] + 1
    files = walked.groupBy("size_tier", "number").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    new = files.select(F.lit(folder).alias("folder"), F.concat(F.lit("t"), F.col("size_tier"), F.lit("-"), F.col("number")).alias("shard"), F.lit(base["version"] + 1).cast("long").alias("seq"), F.col("number").alias("arrival"), F.lit(0).cast("long").alias("split"), "bytes", "rows", F.col("size_tier").alias("tier"), F.lit(generation).alias("generation"))
    return store.commit(planned.where("not merged").select(*new.columns).unionByName(new), schema, base["version"])


def vacuum(store: ManifestStore, keep: int = 1) -> None:
    """Delete versions but the newest ``keep``, and folders of data that those don't name.

    Folders of writers that have not committed yet are younger than the newest
    version or unknown to any; only folders that an older version names go.
    """
    versions = store.versions()
    named = {r["folder"] for v in versions[-keep:] for r in store.shards(v).select("folder").distinct().collect()}
    for v in versions[:-keep]:
        record = store.read(v)
        for r in store.shards(v).select("folder").distinct().collect():  # one row for each commit
            if r["folder"] not in named:
                drop_path(store.spark, f"{store.path}/data/folder={r['folder']}")
        drop_path(store.spark, f"{store.path}/versions/{v}")
        drop_path(store.spark, record["manifest"])
