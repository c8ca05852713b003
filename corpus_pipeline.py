"""A corpus pipeline of five stages over the table ``documents``.

Language identification drops documents whose language is rejected, SimHash
keeps one document of each group of near copies, decontamination drops
documents that hold benchmark passages, the secret scan blanks secrets, and
byte-pair encoding returns the ids of what is left.  Each stage but the last
returns the columns of documents, others that the table has as they are, and
judges each row by its own text: keys may repeat and be null.  Null and empty
texts have no language and go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plait.llm import bpe, decontaminate, language_id, secret_scan, simhash_dedup
from plait.llm.common import drop_path, shared_path


def free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; the others go.  Dictionaries come from the rows that carry one."""
    model = language_id.train(language_id.training_rows(docs))
    names = [free(docs, n) for n in ("lang_pred", "score", "rejected")]
    out = language_id.identify(docs, model, **dict(zip(("lang_pred", "score", "rejected"), names, strict=True)))
    return out.where(~F.col(names[2])).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one document of each group of near copies, the one with the smallest id."""
    return simhash_dedup.one_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by passages of ``benchmark``."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and their digests, and a digest of the text they decode to."""
    return bpe.bpe_encode(docs, digests=True).select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("language_id", identify_language), ("simhash_dedup", drop_near_copies), ("decontamination", drop_contaminated), ("secret_scan", blank_secrets), ("bpe", encode)]

#: SQL can express neither compression sizes nor XXH64 nor byte-pair encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents; each is written and read again in between."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
