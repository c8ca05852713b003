"""Delta-maintained token rollups.

Totals of tokens and documents by source, language and tokenizer version are
kept as a table of signed deltas.  A batch of changes (inserts, deletes, and
revised counts, which are a minus of the old and a plus of the new) becomes one
row for each group and is committed under its batch id; a batch that was
committed before changes nothing, so that retries are harmless.  Totals are
sums over committed deltas, never recounts.

Every writer writes its deltas to a folder of its own, then creates the commit
record ``commits/<digest of the batch id>``, which names that folder, where no
such record exists.  Of two writers of one batch one wins; only folders that
records name are ever read, so what others leave behind doesn't count.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path

GROUP = ("source", "lang", "tokenizer")
SCHEMA = ", ".join(f"{c} string" for c in GROUP) + ", tokens long, docs long"
#: Tokenizer versions by regular expression, alike in Java and RE2.
TOKENIZERS = {"words-1": r"[^\x09-\x0D\x20]+", "pieces-2": r"[A-Za-z]+|[0-9]|[^A-Za-z0-9\x00-\x20]"}


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text"):
    """Column: tokens of a text by a tokenizer version; null texts have none."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(TOKENIZERS[tokenizer])).cast("long")


def changes(before: DataFrame | None, after: DataFrame | None) -> DataFrame:
    """Signed rows ``(source, lang, tokenizer, tokens, docs)`` of counted documents that go (minus) and come (plus).

    Other columns are not read.  Repeated documents count as often as they are there.
    """
    rows = [df.select(*GROUP, (sign * F.col("tokens")).cast("long").alias("tokens"), F.lit(sign).cast("long").alias("docs")) for sign, df in ((-1, before), (1, after)) if df is not None]
    return rows[0] if len(rows) == 1 else rows[0].union(rows[1])


def deltas(signed: DataFrame) -> DataFrame:
    """One row for each group of a batch; groups are summed on the map side, so a hot source is a row for each task.  Nulls form groups of their own."""
    return signed.groupBy(*GROUP).agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs"))


class Rollup:
    """A rollup in a folder: ``deltas/<folder>`` counts if a record in ``commits`` names it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _record(self, batch_id: str):
        """A batch id of any signs names a file by its digest."""
        return self._path(f"{self.path}/commits/{hashlib.sha256(batch_id.encode()).hexdigest()}")

    def _read(self, record) -> dict:
        stream = self._fs.open(record)
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) if text.endswith("}") else {}

    def committed(self, batch_id: str) -> bool:
        record = self._record(batch_id)
        return self._fs.exists(record) and bool(self._read(record))

    def commit(self, signed: DataFrame, batch_id: str) -> bool:
        """Apply a batch once.  False if the batch was committed before, or meanwhile by another writer."""
        if self.committed(batch_id):
            return False
        folder = f"{self.path}/deltas/{uuid.uuid4().hex}"
        deltas(signed).write.parquet(folder)
        record = self._record(batch_id)
        if self._fs.exists(record) and not self._read(record):
            self._fs.delete(record, False)  # left empty by a writer that was killed
        try:
            out = self._fs.create(record, False)
        except Exception:
            if not self._fs.exists(record):
                raise
            drop_path(self.spark, folder)
            return False
        out.write(bytearray(json.dumps({"batch": batch_id, "folder": folder}).encode()))
        out.close()
        return True

    def batches(self) -> dict[str, str]:
        """Committed batch ids with the folders of their deltas."""
        folder = self._path(f"{self.path}/commits")
        found = [self._read(s.getPath()) for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return {r["batch"]: r["folder"] for r in found if r}

    def totals(self) -> DataFrame:
        """``(source, lang, tokenizer, tokens, docs)``; groups whose documents are all gone are left out."""
        folders = sorted(set(self.batches().values()))
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*folders)
        return rows.groupBy(*GROUP).agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs")).where("docs <> 0 or tokens <> 0")
