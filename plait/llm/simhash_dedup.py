"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits are compared at a Hamming threshold of 2.  The anchors
are the words of a covering code: bits 0-22 and bits 23-45 are each covered by
the perfect binary Golay code of length 23 (covering radius 3), the last 18
bits are left free, so there are 2^24 anchors.  A fingerprint's home is the
one anchor within the covering radius.  Each fingerprint is replicated to
every anchor within covering radius plus threshold (counted in each of the two
blocks, the excesses adding up to at most 2: about 61 anchors); whatever lies
within distance 2 of it has its home among them, so joining homes with
replicas by anchor finds every link, and finds each pair once for each order.

Work is done on distinct fingerprints.  Copies never meet, and a fingerprint
has at most 2,080 others within two bits, so links stay linear in the number
of distinct fingerprints however large a group of near copies is.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, components, materialise, partitions, release_idle, worker_cache

THRESHOLD = 2
RADIUS = 3
LENGTH = 23
#: Fingerprints whose anchors are worked out at once, through some 480 candidates each.
PIECE = 512
#: Generator polynomial of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of single bits, and for each syndrome its error patterns of weight up to radius plus threshold.

    Returns ``(bits, start, patterns, excess)``: patterns of syndrome s are
    ``patterns[start[s]:start[s + 1]]``, those with the least weight first;
    excess is the weight above the covering radius, at least 0.
    """
    bits = np.zeros(LENGTH, np.int64)
    for i in range(LENGTH):
        rest = 1 << i
        for top in range(LENGTH - 1, 10, -1):
            if rest >> top & 1:
                rest ^= GENERATOR << (top - 11)
        bits[i] = rest
    rows = []
    for weight in range(RADIUS + THRESHOLD + 1):
        for at in itertools.combinations(range(LENGTH), weight):
            syndrome = 0
            for i in at:
                syndrome ^= int(bits[i])
            rows.append((syndrome, weight, sum(1 << i for i in at)))
    table = np.array(sorted(rows), np.int64)
    start = np.searchsorted(table[:, 0], np.arange(2**11 + 1))
    return bits, start, table[:, 2], np.maximum(table[:, 1] - RADIUS, 0)


def syndrome(words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), np.int64)
    for i, b in enumerate(bits):
        out ^= np.where(words >> i & 1, b, 0)
    return out


def anchors(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, anchor, is_home)``: every anchor within covering radius plus threshold of each fingerprint."""
    parts = [(at, piece_anchors(fingerprints[at : at + PIECE])) for at in range(0, max(len(fingerprints), 1), PIECE)]
    return np.concatenate([at + p[0] for at, p in parts]), np.concatenate([p[1] for _, p in parts]), np.concatenate([p[2] for _, p in parts])


def piece_anchors(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for few fingerprints."""
    cache = worker_cache()
    if "golay" not in cache:
        cache["golay"] = golay_tables()
    bits, start, patterns, excess = cache["golay"]
    fp = fingerprints.astype(np.uint64)
    mask = np.uint64(2**LENGTH - 1)
    blocks = [(fp >> np.uint64(at) & mask).astype(np.int64) for at in (0, LENGTH)]
    rows, found, over = np.arange(len(fp)), np.zeros(len(fp), np.int64), np.zeros(len(fp), np.int64)
    for k, block in enumerate(blocks):
        own = block[rows]
        first = start[syndrome(own, bits)]
        count = start[syndrome(own, bits) + 1] - first
        at = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        words = np.repeat(own, count) ^ patterns[at]
        rows, found, over = np.repeat(rows, count), np.repeat(found, count) | words << (k * LENGTH), np.repeat(over, count) + excess[at]
        keep = over <= THRESHOLD
        rows, found, over = rows[keep], found[keep], over[keep]
    return rows, found, over == 0


def home(fingerprints: np.ndarray) -> np.ndarray:
    """The anchor within the covering radius of each fingerprint: the code is perfect, so there is one."""
    cache = worker_cache()
    if "golay" not in cache:
        cache["golay"] = golay_tables()
    bits, start, patterns, _ = cache["golay"]
    fp, found = fingerprints.astype(np.uint64), np.zeros(len(fingerprints), np.int64)
    for k in range(2):
        block = (fp >> np.uint64(k * LENGTH) & np.uint64(2**LENGTH - 1)).astype(np.int64)
        found |= (block ^ patterns[start[syndrome(block, bits)]]) << (k * LENGTH)  # the pattern of least weight comes first
    return found


def fingerprint_of(text: bytes | None) -> int:
    """The 64-bit fingerprint of a whole text; 0 if it has no words."""
    import re

    import xxhash

    words = re.findall(WORD.encode(), (text or b"").translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < 3 else map(b" ".join, zip(words, words[1:], words[2:], strict=False))
    h = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):  # whole texts, in pieces of 4 MB of bits
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, fp)`` for every document; fp is the fingerprint's 64 bits as a signed long.

    Null and empty texts, and texts of white space only, have fingerprint 0.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        release_idle()
        for batch in batches:
            fp = [fingerprint_of(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.array(fp, np.uint64).view(np.int64), pa.int64())], names=["id", "fp"])

    return rows.mapInArrow(run, f"id {kind}, fp long").withColumnRenamed("id", key)


def near_pairs(fps: DataFrame, fp: str = "fp") -> DataFrame:
    """``(a, b)``: all pairs of different fingerprints at 2 or fewer differing bits, a < b, each once."""
    # Few bytes make many replicas: dealt out by number, so that adaptive execution doesn't put them into few tasks.
    distinct = fps.select(F.col(fp).alias("fp")).distinct().repartition(partitions(fps.sparkSession), "fp")

    def spread(batches):
        import pyarrow as pa

        release_idle()
        for batch in batches:
            values = batch.column("fp").to_numpy()
            for i in range(0, len(values), 4096):
                part = values[i : i + 4096]
                rows, found, _ = anchors(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(part[rows])], names=["anchor", "a"])

    def settle(batches):
        import pyarrow as pa

        release_idle()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(home(batch.column("fp").to_numpy().view(np.uint64))), batch.column("fp")], names=["anchor", "b"])

    # Spark takes what a function in Arrow gives to be as many rows as it got, and would broadcast replicas by the size of the fingerprints.
    replicas = distinct.mapInArrow(spread, "anchor long, a long").hint("merge")
    near = distinct.mapInArrow(settle, "anchor long, b long").join(replicas, "anchor")
    return near.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= THRESHOLD)).select("a", "b")


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, ``fingerprint`` (16 hex digits), ``component_id`` (smallest key reachable by links, itself included), ``kept``.

    Repeated rows stay rows.  A null key takes part in linking but is never a
    component's name unless all its members have none.  An empty table gives
    an empty result.  Columns other than key and text are not read.
    """
    fps = materialise(fingerprints(docs, key, text), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min(key).alias("least"))
    linked = components(materialise(near_pairs(fps), "links"))  # read twice: for the links and for the ids they name
    named = classes.join(linked.withColumnRenamed("id", "fp"), "fp", "left").withColumn("group", F.coalesce("component", "fp"))
    least = named.groupBy("group").agg(F.min("least").alias("component_id"))
    member = named.select("fp", "group").join(least, "group").select("fp", "component_id")
    out = fps.join(member, "fp")
    return out.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)).alias("kept"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay: of each group of near copies the one with the smallest key.

    Rows without a key stay, as nothing names them; rows that repeat a key stay
    or go together.
    """
    gone = simhash_groups(docs, key, text).where("not kept").select(key)
    return docs.join(gone, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def one_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Exactly one document of each group of near copies: the one with the smallest key, a null key coming last.

    Rows are told apart by a number written with them, so repeated and null
    keys leave one row too; among rows of one key the text's hash decides.
    """
    row = "_row"
    while row in docs.columns:
        row += "_"
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = simhash_groups(rows, row, text).select(row, "component_id")
    keys = rows.select(row, F.struct(F.col(key).isNull().alias("keyless"), F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("hash"), row).alias("order"))
    first = groups.join(keys, row).groupBy("component_id").agg(F.min("order").alias("first")).select(f"first.{row}")
    return rows.join(first, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
