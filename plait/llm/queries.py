"""Queries of the training-data operators over the tables of the test data, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, embed_dedup, language_id, lm_score, secret_scan, sharding, simhash_dedup, token_counts, toxicity
from .common import fold, shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in shards, are compacted, and are read from the version committed last."""
    store = sharding.ManifestStore(spark, shared_path(spark, "store"))
    sharding.append(store, table(spark, sf_dir, "documents"))
    sharding.compact(store)
    sharding.vacuum(store)
    return store.frame().select("doc_id", "arrival", "tier", F.col("shard").alias("target_file"), F.sha2("text", 256).alias("text_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come; source src1 is taken down; German ones are counted anew by a newer tokenizer; the first batch is sent again."""
    docs = table(spark, sf_dir, "documents")
    counted = lambda rows, tokenizer: rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), token_counts.count_tokens(rows, tokenizer).alias("tokens"))
    rollup = token_counts.Rollup(spark, shared_path(spark, "rollup"))
    german = docs.where("lang = 'de' AND source <> 'src1'")
    arrivals = token_counts.changes(None, counted(docs, "words-1"))
    rollup.commit(arrivals, "1-arrivals")
    rollup.commit(token_counts.changes(counted(docs.where("source = 'src1'"), "words-1"), None), "2-takedown")
    rollup.commit(token_counts.changes(counted(german, "words-1"), counted(german, "pieces-2")), "3-recount")
    rollup.commit(arrivals, "1-arrivals")
    return rollup.totals()


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(language_id.training_rows(docs))
    out = language_id.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "word_pos", "nth", F.sha2("secret", 256).alias("secret_sha256"), F.length("secret").alias("secret_length"), "probability")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_groups(table(spark, sf_dir, "documents"))


def op8_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.bpe_encode(docs, ids=None, digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    taught = fold("doc_id", 4) != 2  # neither texts nor labels of the others are read
    model = toxicity.train(docs.where(taught), table(spark, sf_dir, "labels").where(taught))
    out = toxicity.score_toxicity(docs, model)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


#: DuckDB SQL for documents' words by the rule of decontamination.
OP9_SQL = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT item_id, least(len(w), 13) AS n, array_to_string(w[s:s + 12], ' ') AS p
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM item WHERE len(w) > 0)),
size AS (SELECT DISTINCT n FROM win),
place AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS p
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM doc, size WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, s, win.n FROM place JOIN win ON win.p = place.p AND win.n = place.n),
word AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN found USING (doc_id)
"""


OP1_SQL = f"""
WITH d AS (SELECT *, coalesce(floor(doc_id / {sharding.SHARD_ROWS}), -1)::BIGINT AS shard, coalesce(strlen(text), 0) + 16 AS size FROM documents),
s AS (SELECT shard, sum(size) AS bytes FROM d GROUP BY shard),
t AS (SELECT *, ((length(bin(bytes::BIGINT)) - 1) // 2)::INTEGER AS tier FROM s),
m AS (SELECT *, count(*) OVER (PARTITION BY tier) >= {sharding.FAN_IN} AND bytes < {sharding.TARGET_BYTES} AS merged FROM t),
p AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY tier, merged ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM m),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY shard ORDER BY doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS own FROM d)
SELECT doc_id, o.shard AS arrival, tier, CASE WHEN merged THEN 't' || tier || '-' || floor((ahead + own) / {sharding.TARGET_BYTES})::BIGINT ELSE 's' || o.shard END AS target_file, sha256(text) AS text_sha256
FROM o JOIN p USING (shard)
"""

OP2_SQL = f"""
WITH c AS (SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '{token_counts.TOKENIZERS["words-1"]}')) AS w, len(regexp_extract_all(coalesce(text, ''), '{token_counts.TOKENIZERS["pieces-2"]}')) AS p FROM documents WHERE source <> 'src1')
SELECT source, lang, CASE WHEN lang = 'de' THEN 'pieces-2' ELSE 'words-1' END AS tokenizer, sum(CASE WHEN lang = 'de' THEN p ELSE w END)::BIGINT AS tokens, count(*)::BIGINT AS docs FROM c GROUP BY ALL
"""


def queries() -> dict:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": OP1_SQL, "op2_token_counts": OP2_SQL, "op6_secret_scan": secret_scan.oracle(), "op9_benchmark_decontamination": OP9_SQL}
