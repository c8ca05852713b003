"""Benchmark decontamination with a distributed positional inverted index.

The index holds a posting ``(term_id, text, pos)`` for each training token
whose term occurs in the benchmark, and for each text one of term 0 whose
position is the number of its words, written to the shared folder by one pass
over the texts.  For each benchmark phrase the rarest terms are chosen by their
counts in the index; their posting lists, each moved back by the term's offset
in the phrase, are intersected, and what is left are candidate places of the
phrase.  Candidates are verified word by word against the text, or, for
proximity, term by term within the slop.  All of it is DataFrame operations.

A text is named by 128 bits of its hash, ``id`` and ``id2``, so that repeated
and null keys don't matter: rows share what is found if their texts are equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, UPPER, drop_path, materialise, shared_path

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` as Java reads it.
TERM = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
PHRASE = 13
#: Lists that are intersected for each phrase before it is verified.
RAREST = 3
TEXT = ("id", "id2")


def terms_of(text: str):
    """Array of a text's terms; null: empty."""
    return F.expr(f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{TERM}', 0)".replace("\\", "\\\\"))


def named(docs: DataFrame, text: str = "text") -> tuple:
    """The columns ``id`` and ``id2`` of a row's text."""
    return F.xxhash64(F.col(text)).alias("id"), F.xxhash64(F.lit(1), F.col(text)).alias("id2")


def phrases(benchmark: DataFrame, item: str = "item_id", text: str = "text", length: int = PHRASE) -> DataFrame:
    """``(item, start, words)``: every ``length`` consecutive words of an item; an item of fewer, but not none, is one phrase."""
    words = benchmark.select(F.col(item).alias("item"), terms_of(f"`{text}`").alias("w")).where("size(w) > 0")
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - length, F.lit(0))))
    return words.select("item", "w", starts.alias("start")).select("item", "start", F.slice("w", F.col("start") + 1, length).alias("words"))


def lookup(benchmark: DataFrame, item: str, text: str, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct phrases ``(phrase, words)``, which items hold them ``(phrase, item)``, and their terms ``(term, term_id)``; term 0 is the empty one, which marks ends of texts."""
    found = phrases(benchmark, item, text, length)
    lots = materialise(found.select("words").distinct().withColumn("phrase", F.monotonically_increasing_id()), "phrases")
    held = materialise(found.select("words", "item").distinct().join(lots, "words").select("phrase", "item"), "items")
    terms = lots.select(F.explode("words").alias("term")).distinct().withColumn("term_id", F.monotonically_increasing_id() + 1)
    # A table made from Python's rows would start a second family of workers on each executor.
    empty = terms.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(0).cast("long").alias("term_id"))
    terms = materialise(terms.union(empty), "terms")
    return lots, held, terms


def build_index(docs: DataFrame, terms: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """Write and read the postings ``(term_id, id, id2, pos)`` of the tokens among ``terms``.

    The vocabulary of a benchmark is small against the corpus; Catalyst
    broadcasts it while it is below the session's threshold, and otherwise
    joins by shuffling.
    """
    spark = docs.sparkSession
    tokens = docs.select(*named(docs, text), F.posexplode(F.concat(terms_of(f"`{text}`"), F.array(F.lit("")))).alias("pos", "term"))
    path = shared_path(spark, "postings")
    tokens.join(terms, "term").select("term_id", "id", "id2", "pos").write.parquet(path)
    return spark.read.schema("term_id long, id long, id2 long, pos int").parquet(path), path


def rarest_terms(lots: DataFrame, terms: DataFrame, index: DataFrame, rarest: int = RAREST) -> DataFrame:
    """``(phrase, term_id, offset, rank, lists)``: the rarest terms of each phrase, ranked from 1, ties by term and offset; phrases with a term of no posting are gone, as they occur nowhere."""
    counts = index.groupBy("term_id").count().withColumnRenamed("count", "n")
    known = terms.join(counts, "term_id", "left").select("term", "term_id", F.coalesce("n", F.lit(0)).alias("n"))
    each = lots.select("phrase", F.posexplode("words").alias("offset", "term")).join(known, "term")
    own = Window.partitionBy("phrase")
    ranked = each.withColumn("least", F.min("n").over(own)).where("least > 0").withColumn("rank", F.row_number().over(own.orderBy("n", "term", "offset")))
    return ranked.where(F.col("rank") <= rarest).withColumn("lists", F.count("*").over(own)).select("phrase", "term_id", "offset", "rank", "lists")


def texts_of(docs: DataFrame, candidates: DataFrame, text: str = "text") -> DataFrame:
    """``(id, id2, w)``: words of the texts that have candidates, each text once."""
    wanted = candidates.select(*TEXT).distinct()
    return docs.select(*named(docs, text), F.col(text).alias("t")).join(wanted, [*TEXT], "left_semi").groupBy(*TEXT).agg(F.first("t").alias("t")).select(*TEXT, terms_of("t").alias("w"))


def exact_places(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", length: int = PHRASE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words of each text ``(id, id2, n_words)``, exact places of phrases ``(id, id2, phrase, start, size)``, and ``(phrase, item)``.

    Null texts have no words.  A phrase that a text holds often has as many
    places; nothing is gathered by text, however many there are.
    """
    lots, held, terms = lookup(benchmark, item, item_text, length)
    index, path = build_index(docs, terms, text)
    chosen = materialise(rarest_terms(lots, terms, index), "rarest")
    moved = index.join(chosen, "term_id").select("phrase", "rank", "lists", *TEXT, (F.col("pos") - F.col("offset")).alias("start")).where("start >= 0")
    # Rows of equal text repeat their postings: lists are told apart by a bit each, not counted.
    met = moved.groupBy("phrase", *TEXT, "start").agg(F.bit_or(F.expr("shiftleft(1L, rank - 1)")).alias("met"), F.first("lists").alias("lists")).where("bit_count(met) = lists")
    candidates = materialise(met.select("phrase", *TEXT, "start"), "candidates")
    n_words = materialise(index.where("term_id = 0").groupBy(*TEXT).agg(F.first("pos").cast("long").alias("n_words")), "words")
    drop_path(docs.sparkSession, path)
    places = candidates.join(lots, "phrase").join(texts_of(docs, candidates, text), [*TEXT]).where("slice(w, start + 1, size(words)) = words")
    return n_words, materialise(places.select(*TEXT, "phrase", "start", F.size("words").alias("size")), "places"), held


def proximity_places(docs: DataFrame, benchmark: DataFrame, slop: int = 5, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", length: int = PHRASE) -> DataFrame:
    """``(id, item, start)``: places where every term of a phrase stands within ``slop`` words of its offset.

    ``start`` is where the phrase would start by its rarest term, and may be
    negative down to ``-slop``.  One word may stand for two equal terms.
    Rows that repeat key and text give their places once; null texts have none.
    """
    lots, held, terms = lookup(benchmark, item, item_text, length)
    index, path = build_index(docs, terms, text)
    chosen = materialise(rarest_terms(lots, terms, index), "rarest")
    moved = index.join(chosen, "term_id").select("phrase", "lists", "rank", *TEXT, (F.col("pos") - F.col("offset")).alias("start")).distinct()
    # A place joins its neighbours through cells as wide as the slop: its own and the next ones.
    width = max(1, slop)
    first = moved.where(F.col("rank") == 1).where(F.col("start") >= -slop).select("phrase", "lists", *TEXT, "start", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("start") / width) + d)).alias("cell"))
    other = moved.where(F.col("rank") > 1).select(F.col("phrase").alias("p"), F.col("id").alias("i"), F.col("id2").alias("j"), "rank", F.col("start").alias("s"), F.floor(F.col("start") / width).alias("c"))
    near = first.join(other, (F.col("phrase") == F.col("p")) & (F.col("id") == F.col("i")) & (F.col("id2") == F.col("j")) & (F.col("cell") == F.col("c")) & (F.abs(F.col("start") - F.col("s")) <= slop), "left")
    met = near.groupBy("phrase", *TEXT, "start", "lists").agg(F.count_distinct("rank").alias("others")).where("others = lists - 1")
    candidates = materialise(met.select("phrase", *TEXT, "start"), "candidates")
    drop_path(docs.sparkSession, path)
    # The other terms are looked up in the text.
    every = f"forall(sequence(0, size(words) - 1), o -> array_contains(slice(w, greatest(start + o - {slop}, 0) + 1, greatest(start + o + {slop} + 1, 0) - greatest(start + o - {slop}, 0)), words[o]))"
    places = candidates.join(lots, "phrase").join(texts_of(docs, candidates, text), [*TEXT]).where(every).join(held, "phrase")
    return docs.select(F.col(key).alias("_key"), *named(docs, text)).join(places, [*TEXT]).select(F.col("_key").alias("id"), "item", "start").distinct()


def hits(n_words: DataFrame, places: DataFrame, held: DataFrame, share: int = 20) -> DataFrame:
    """``(id, id2, n_words, n_hit, n_items, items, contaminated)`` of each text with places."""
    n_hit = places.select(*TEXT, F.explode(F.expr("sequence(start, start + size - 1)")).alias("at")).distinct().groupBy(*TEXT).agg(F.count("*").alias("n_hit"))
    items = places.select(*TEXT, "phrase").distinct().join(held, "phrase").select(*TEXT, F.col("item").cast("string").alias("item")).distinct().groupBy(*TEXT).agg(F.array_sort(F.collect_list("item")).alias("items"))
    return n_words.join(n_hit, [*TEXT]).join(items, [*TEXT]).select(*TEXT, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (share * F.col("n_hit") >= F.col("n_words")).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", share: int = 20) -> DataFrame:
    """The documents that aren't contaminated, each judged by its own text: keys are not read, all columns stay, repeated rows stay or go together."""
    gone = materialise(hits(*exact_places(docs, benchmark, text), share).where("contaminated").select(F.col("id").alias("plait_id"), F.col("id2").alias("plait_id2")), "contaminated")
    one, two = (F.xxhash64(docs[text]), F.xxhash64(F.lit(1), docs[text]))
    return docs.join(gone, (one == gone["plait_id"]) & (two == gone["plait_id2"]), "left_anti")


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", length: int = PHRASE, share: int = 20) -> DataFrame:
    """One row per document: key, ``n_words``, ``n_hit``, ``n_items``, ``items``, ``contaminated``.

    A word inside any place of a phrase is hit.  A document is contaminated if
    some word is hit and hit words are at least one in ``share``.  ``items``
    are the items with places, in order of their strings.  Empty benchmarks
    and texts give no hits; null texts have no words; texts of any length are
    read whole.  Keys may repeat and be null; other columns are not read.
    """
    n_words, places, held = exact_places(docs, benchmark, text, item, item_text, length)
    found = hits(n_words, places, held, share).drop("n_words")
    none = F.array().cast("array<string>")
    rows = docs.select(F.col(key).alias("_key"), *named(docs, text)).join(n_words, [*TEXT]).join(found, [*TEXT], "left")
    return rows.select(F.col("_key").alias(key), "n_words", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("n_hit", "n_items")], F.coalesce("items", none).alias("items"), F.coalesce("contaminated", F.lit(False)).alias("contaminated"))
