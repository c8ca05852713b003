"""The queries of the training-data operators on the smallest tables: columns, folds and whole results."""

import zlib

import pytest
from pyspark.sql import functions as F

from plait.llm import queries

FOLDER = "/root/testdata/sf0.001"
TYPES = {
    "op1_sharding": {"doc_id": "bigint", "arrival": "bigint", "tier": "int", "target_file": "string", "text_sha256": "string"},
    "op2_token_counts": {"source": "string", "lang": "string", "tokenizer": "string", "tokens": "bigint", "docs": "bigint"},
    "op3_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op4_lm_score": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op5_embedding_near_dedup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op6_secret_scan": {"doc_id": "bigint", "secret_sha256": "string", "probability": "double"},
    "op7_simhash_near_dedup": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op8_bpe_encode_decode": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op9_benchmark_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op10_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
}
FOLDS = {"op3_language_id": (3, 1), "op4_lm_score": (7, 2), "op10_toxicity": (4, 2)}


@pytest.mark.parametrize("name", TYPES)
def test_contract(spark, name):
    out = queries.queries()[name](spark, FOLDER)
    types = dict(out.dtypes)
    assert {c: types[c] for c in TYPES[name]} == TYPES[name]
    rows = out.collect()
    if "doc_id" in types and name != "op6_secret_scan":
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in queries.table(spark, FOLDER, "documents").select("doc_id").collect())
    if name in FOLDS:
        modulus, left = FOLDS[name]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == left) for r in rows)


def test_toxicity_never_reads_held_out_labels(spark, tmp_path):
    """Labels of the held-out rows are flipped, and no score changes."""
    docs, labels = (queries.table(spark, FOLDER, t) for t in ("documents", "labels"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))).write.parquet(f"{tmp_path}/labels.parquet")
    scores = lambda folder: {r.doc_id: r.score for r in queries.op10_toxicity(spark, str(folder)).collect()}
    assert scores(FOLDER) == scores(tmp_path)


def test_pipeline_on_clashing_columns_and_null_keys(spark, tmp_path):
    """Stages keep foreign columns as they are, whatever they are called, and null and repeated keys."""
    import corpus_pipeline

    docs = queries.table(spark, FOLDER, "documents").limit(60)
    docs = docs.union(docs.limit(5).withColumn("doc_id", F.lit(None).cast("long")))
    for name in ("_lang", "_score", "_rejected", "lang_pred", "score", "rejected", "_row", "plait_a", "found", "id", "id2", "_id", "contaminated", "n_words", "secret"):
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("source")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    queries.table(spark, FOLDER, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    had = {(r.doc_id, r.text): r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        if name != "secret_scan":
            assert {(r.doc_id, r.text): r for r in out.collect()}.items() <= had.items(), name
        docs = out
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count() > 0


def test_pipeline_by_its_operators(spark):
    """The result of run() is that of brute force on the documents: language by the classifier, one row of each group, no contaminated row, secrets blanked, ids of the library."""
    import corpus_pipeline
    import tokenizers

    from plait.llm import bpe, language_id

    docs = queries.table(spark, FOLDER, "documents")
    rows = docs.collect()
    classify = language_id.Classifier(language_id.train(language_id.training_rows(docs))).classify
    kept = [r for r in rows if classify(r.text)[1] >= language_id.LEAST_SCORE]
    groups = {r.doc_id: r.component_id for r in queries.simhash_dedup.simhash_groups(spark.createDataFrame(kept, docs.schema)).collect()}
    kept = [r for r in kept if groups[r.doc_id] == r.doc_id]
    bad = {r.doc_id for r in queries.op9_benchmark_decontamination(spark, FOLDER).where("contaminated").collect()}
    kept = [r for r in kept if r.doc_id not in bad]
    found = queries.secret_scan.find_secrets(spark.createDataFrame(kept, docs.schema)).collect()
    own = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    want = {}
    for r in kept:
        text = r.text or ""
        for s in sorted({f.secret for f in found if f.doc_id == r.doc_id}, key=lambda x: -len(x)):
            text = text.replace(s, "[SECRET]")
        want[r.doc_id] = own.encode(text, add_special_tokens=False).ids
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == want and 0 < len(got) < len(rows)
