"""Language identification by compression with per-language dictionaries.

Each language has a zstandard raw-content dictionary, made from a sample of
its labelled texts.  A text is compressed with every dictionary; the language
whose dictionary gives the smallest size wins.  Texts and dictionaries
are lower-cased and reduced to words of letters, since signs, digits and capital
letters say little of the language.  All words of a text are compressed, with
their repeats, in pieces of a few thousand bytes, so that the dictionary counts
for all of the text and not for its beginning only; the sizes are added up.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialise, worker_model

#: Bounds of the sample: texts for each language, and languages (the most frequent labels).
SAMPLE_TEXTS = 512
LANGUAGES = 256
#: Bytes of a dictionary, and of a piece of text.
DICTIONARY_BYTES = 131_072
PIECE_BYTES = 4096
#: Nats of score for each byte of difference for a byte of text, and the least score that isn't rejected.
SHARPNESS = 60.0
LEAST_SCORE = 0.5


def words_of(text: str) -> list[str]:
    """Lower-case words: runs of letters."""
    return re.findall(r"[^\W\d_]+", text.lower())


def dictionary(texts: list[str]) -> bytes:
    """An equal share of each text's words, from its middle; texts shorter than that as a whole, their rest going to longer ones."""
    contents = sorted((" ".join(words_of(t)).encode() for t in texts), key=lambda c: (len(c), c))
    taken, left = [], DICTIONARY_BYTES
    for i, c in enumerate(contents):
        share = min(len(c), left // (len(contents) - i))
        left -= share
        at = (len(c) - share) // 2
        taken.append(c[at : at + share])
    return b" ".join(taken) or b" "


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_texts: int = SAMPLE_TEXTS, languages: int = LANGUAGES) -> dict[str, bytes]:
    """Dictionaries for each language, from a bounded sample of labelled texts, whole ones.

    Rows without text or language are passed over, and labels beyond the
    ``languages`` most frequent ones.  The texts of a language are dealt to
    ``sample_texts`` cells by a hash of the key; each cell gives the text with
    the smallest second hash, so that the sample depends neither on order nor
    on partitions.  Keys are chosen first, so that only the sample's texts are
    gathered; rows that repeat a key and text are one.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).cast("string").alias("lang"), F.col(key).alias("key"), F.col(text).alias("text"))
    cell = F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(sample_texts))
    chosen = rows.groupBy("lang", cell.alias("cell")).agg(F.min(F.struct(F.xxhash64(F.lit(2), "key"), F.xxhash64("text").alias("text"))).alias("first"), F.count("*").alias("n"))
    chosen = materialise(chosen.select("lang", "cell", F.col("first.text").alias("hash"), "n"), "languages")
    kept = [r["lang"] for r in chosen.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()]
    by: dict[str, list[str]] = {}
    if kept:
        # At most languages times sample_texts rows of some 30 bytes.
        wanted = F.broadcast(chosen.where(F.col("lang").isin(kept)).select("lang", "cell", "hash"))
        picked = rows.withColumn("cell", cell).withColumn("hash", F.xxhash64("text")).join(wanted, ["lang", "cell", "hash"]).groupBy("lang", "cell").agg(F.min("text").alias("text"))
        for row in sorted(picked.collect(), key=lambda r: (r["lang"], r["cell"])):
            by.setdefault(row["lang"], []).append(row["text"])
    return {name: dictionary(texts) for name, texts in by.items()}


def compressor(content: bytes):
    """The function that compresses bytes with a raw-content dictionary."""
    import zstandard

    how = zstandard.ZstdCompressionParameters(window_log=18, chain_log=16, hash_log=16, search_log=4, min_match=4, target_length=16, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(compression_params=how, dict_data=d).compress


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = sorted(dictionaries)
        self.compress = [compressor(dictionaries[name]) for name in self.langs]

    def sizes(self, text: str) -> tuple[np.ndarray, int]:
        """Compressed bytes for each language, and the bytes of the text's words."""
        content = " ".join(words_of(text)).encode()
        pieces = [content[i : i + PIECE_BYTES] for i in range(0, len(content), PIECE_BYTES)]
        return np.array([sum(len(compress(p)) for p in pieces) for compress in self.compress], float), len(content)

    def classify(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return "und", 0.0
        sizes, total = self.sizes(text)
        if not total:  # letters that are no words, such as ones within numbers
            return "und", 0.0
        best = int(sizes.argmin())
        if (sizes == sizes[best]).sum() > 1:  # sizes are whole bytes; the same words in other orders have others
            words = words_of(text)
            finer = sum(self.sizes(" ".join(order))[0] for order in (words[::-1], sorted(words), words[::2] + words[1::2], sorted(words, reverse=True)))
            best = int(np.where(sizes == sizes[best], finer, np.inf).argmin())
        # The difference for a byte of text varies less the longer the text is.
        weight = np.exp(-(sizes - sizes[best]) / total * SHARPNESS * math.sqrt(total / 20))
        return self.langs[best], float(1 / weight.sum())


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", lang_pred: str = "lang_pred", score: str = "score", rejected: str = "rejected", least_score: float = LEAST_SCORE) -> DataFrame:
    """``docs`` with the predicted language of whole texts, its score (0 to 1) and whether it is rejected.

    Null texts, and those without any letter, are ``und`` with score 0 and
    rejected; so are all texts if there are no dictionaries.  Other texts are
    rejected if the margin of sizes is so narrow that the score stays below
    ``least_score``; ties are broken by the sizes of the same words in other
    orders, then go to the first language in order of names.
    Every row is judged by its own text: repeated rows, null and repeated keys
    stay, an empty table gives an empty one.  Columns of the added names are
    replaced, others stay.
    """
    from pyspark.sql import types as T

    spark = docs.sparkSession
    digest = hashlib.md5(repr(sorted(dictionaries.items())).encode()).hexdigest()
    model = spark.sparkContext.broadcast(dictionaries)
    added = [T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField(rejected, T.BooleanType())]
    keep = [c for c in docs.columns if c not in {f.name for f in added}]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            classify = worker_model("languages", digest, lambda: Classifier(model.value)).classify
            found = [classify(x) for x in batch.column(text).to_pylist()]
            langs, scores = [x for x, _ in found], np.array([y for _, y in found], float)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(langs, pa.string()), pa.array(scores), pa.array(scores < least_score)], names=[*keep, *(f.name for f in added)])

    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, T.StructType([docs.schema[c] for c in keep] + added))


def training_rows(docs: DataFrame, key: str = "doc_id", modulus: int = 3, left_out: int = 1) -> DataFrame:
    return docs.where(fold(key, modulus) != left_out)
