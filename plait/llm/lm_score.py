"""Scoring by a hierarchical Pitman-Yor language model.

Restaurants.  A token is drawn in the restaurant of its context, the word
before it (the end of a text stands before its first word); every word of the
corpus has a restaurant, and all share one parent, the restaurant of single
words.  The parent's base has no atoms, so that each known word has one table
there, and what is left is the chance of a word never seen: known words and the
one class of unknown words make up 1.

Sampling.  Chinese-restaurant seating is sampled by Gibbs sweeps over the
numbers of tables ``t`` of each pair of context and word with ``c`` customers.
Two steps alternate.  Given the seating, the parent's probabilities ``p`` are
drawn (Dirichlet: a Gamma draw a word, divided by their sum), and each context
draws an auxiliary ``x`` from Gamma(strength / discount + its tables).  Given those, all pairs are independent of each other, and ``t``
has weight ``(discount * x * p) ** t * S(c, t)``, with the generalised Stirling
numbers S.  Up to ``EXACT`` customers ``t`` is drawn from these weights, beyond
that from the limit that they approach.  Pairs of one customer have one table
always.  Draws are functions of the words, so the same documents have the same
scores however they are partitioned.  Predictive probabilities are averaged
over the samples that are kept.

Data flow.  Documents are cut into blocks of a few MB.  A block asks each
bucket of words for its distinct pairs (with training counts).  Buckets merge
these; what leaves a bucket are tables by context and, for pairs of two
customers or more, what sweeps need.  Sweeps exchange, by context, the tables
beyond one for each pair.  At the end blocks ask again, a slice of them at a
time so that not all questions and answers lie on disk at once, and buckets
answer with customers and tables, from which each block computes its documents'
scores.  Files of shuffles are deleted as soon as what they led to is written.
A word's pairs are in one bucket; its size is that of the word's distinct
contexts, not of its tokens.
Nothing is gathered on the driver but totals.
"""

from __future__ import annotations

import pickle
import re
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, drop_path, fold_of, partitions, worker_cache, written

BLOCK_BYTES = 8_000_000
#: Parts of the blocks that are scored one after the other.
SLICES = 3
DISCOUNT, STRENGTH = 0.7, 3.0
ROOT_DISCOUNT, ROOT_STRENGTH = 0.6, 10.0
BURN_IN, SAMPLES = 2, 2
EXACT = 512
#: Bits of a word's hash that name it.
HASH_BITS = 48


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, bytes of equal weight together."""
    import zstandard

    lots = [(a.dtype.str, a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()) for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(lots))


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    return [np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1) for kind, raw in pickle.loads(zstandard.ZstdDecompressor().decompress(blob))]


def narrow(a: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest unsigned type."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


class Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self)
        return i


def pairs_of(tokens: np.ndarray, size: np.ndarray, which: bool = False):
    """Distinct pairs ``word << 32 | context`` of texts given as ranks of their tokens; with ``which``, also each token's pair.  Before a text's first token stands the end, which is every text's last."""
    before = np.concatenate([[0], tokens[:-1]])
    before[np.cumsum(size) - size] = tokens[-1] if len(tokens) else 0
    return np.unique(tokens << 32 | before, return_inverse=which)


def read_block(ids: list, texts: list[bytes | None], trains: list[bool]) -> bytes:
    """The block's documents: hashes of its words in order, and ranks of the documents' tokens among them."""
    import xxhash

    upper = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    find = re.compile(WORD.encode()).findall
    known = Ids({b"": 0})  # the end of a text; no word is empty
    lots = [np.fromiter(map(known.__getitem__, words), np.int64, len(words)) for words in (find((t or b"").translate(upper)) for t in texts)]
    size = np.array([len(x) + 1 for x in lots])
    end = np.cumsum(size)
    token = np.zeros(int(end[-1]), np.int64)
    inner = np.ones(len(token), bool)
    inner[end - 1] = False
    token[inner] = np.concatenate(lots)
    h = np.fromiter((xxhash.xxh64_intdigest(w) >> (64 - HASH_BITS) for w in known), np.int64, len(known))
    order = np.argsort(h, kind="stable")
    rank = np.empty(len(h), np.int64)
    rank[order] = np.arange(len(h))
    return pickle.dumps((ids, pack(np.diff(h[order], prepend=0)), pack(narrow(rank[token])), size, [int(t) for t in trains]))


def open_block(blob: bytes, buckets: int) -> tuple:
    """Documents, ranks of their tokens by bucket and hash, hashes in that order, and how many of a document's tokens and whether it teaches."""
    ids, steps, packed, size, trains = pickle.loads(blob)
    h = np.cumsum(unpack(steps)[0])
    order = np.lexsort((h, h % buckets))
    rank = np.empty(len(h), np.int64)
    rank[order] = np.arange(len(h))
    return ids, rank[unpack(packed)[0]], h[order], size, np.array(trains, bool)


def questions(blob: bytes, buckets: int) -> list[tuple[int, bytes]]:
    """A block's question to each bucket: words, how many pairs each has, their contexts and training counts."""
    _, tokens, h, size, trains = open_block(blob, buckets)
    pairs, which = pairs_of(tokens, size, True)
    count = np.bincount(which, np.repeat(trains.astype(float), size), len(pairs)).astype(np.int64)
    bucket = h % buckets
    word, context = pairs >> 32, h[pairs & (2**32 - 1)]
    cuts, word_cuts = np.searchsorted(bucket[word], np.arange(buckets + 1)), np.searchsorted(bucket, np.arange(buckets + 1))
    asked = []
    for b in range(buckets):
        s, e, ws, we = cuts[b], cuts[b + 1], word_cuts[b], word_cuts[b + 1]
        if s < e:
            asked.append((b, pack(np.diff(h[ws:we], prepend=0), narrow(np.bincount(word[s:e] - ws, minlength=we - ws)), context[s:e], narrow(count[s:e]))))
    return asked


def keys_of(hashes: np.ndarray, question: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of an unpacked question to a bucket with these words: places of its words; word, context and training count of its pairs."""
    steps, sizes, context, count = question
    words = np.searchsorted(hashes, np.cumsum(steps))
    return words, np.repeat(words, sizes.astype(np.int64)), context, count


def merge_questions(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, and for each distinct pair its word's place, context, training count and whether a block asked that has none of it in training.

    Pairs are told apart, and put in order, by 64 mixed bits of both hashes.
    """
    asked = [unpack(b) for b in blobs]
    hashes = np.unique(np.concatenate([np.cumsum(q[0]) for q in asked]))
    cuts = np.cumsum([0, *(len(q[2]) for q in asked)])
    key, word = np.empty(cuts[-1], np.uint64), np.empty(cuts[-1], np.int32)
    for q, a, b in zip(asked, cuts, cuts[1:], strict=False):  # one by one, so that what mixing needs in between stays small
        word[a:b] = keys_of(hashes, q)[1]
        key[a:b] = mix(hashes[word[a:b]], q[2])
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    del key
    first = order[starts]
    own = np.concatenate([q[3] for q in asked])[order]
    del order
    count = np.add.reduceat(own, starts, dtype=np.int64)
    without = np.logical_or.reduceat(own == 0, starts)
    return hashes, word[first], np.concatenate([q[2] for q in asked])[first], count, without


def found_in(ordered: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``wanted`` is in ``ordered``, and whether it is there at all."""
    if not len(ordered):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(ordered, wanted), len(ordered) - 1)
    return at, ordered[at] == wanted


def known_pairs(keys: np.ndarray, count: np.ndarray, tables: list[np.ndarray], singles: np.ndarray, wanted: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
    """Customers, and tables by sample, of the ``wanted`` keys of a block that has ``own`` customers of them.

    ``keys`` are all pairs of two customers or more.  Others have one if it is
    the block's own or the key is in ``singles``, and none otherwise.
    """
    at, more = found_in(keys, wanted)
    customers = np.minimum(own, 1).astype(np.int64)
    doubt = np.flatnonzero(~more & (own == 0))
    customers[doubt[found_in(singles, wanted[doubt])[1]]] = 1
    out = []
    for values in (count, *tables):
        out.append(customers.copy())
        out[-1][more] = values[at[more]]
    return out


def mix(*keys) -> np.ndarray:
    """64 mixed bits for each row of the keys (the finaliser of splitmix64, key by key)."""
    out = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for k in keys:
            out = (out ^ np.asarray(k).astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
            out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out = out ^ (out >> np.uint64(31))
    return out


def uniform(*keys) -> np.ndarray:
    """A number between 0 and 1 for each row of the keys."""
    return ((mix(*keys) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def gamma(shape: np.ndarray, *keys) -> np.ndarray:
    """A Gamma draw for each row, by Marsaglia and Tsang (2000); shapes are above 1."""
    d = shape - 1 / 3
    c = 1 / np.sqrt(9 * d)
    out, left, turn = np.zeros(len(shape)), np.arange(len(shape)), 0
    while len(left):
        own = [np.asarray(k)[left] if np.ndim(k) else k for k in keys]
        u, v, w = (uniform(turn, j, *own) for j in range(3))
        x = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
        cube = (1 + c[left] * x) ** 3
        fine = cube > 0
        fine[fine] = np.log(w[fine]) < x[fine] ** 2 / 2 + d[left][fine] * (1 - cube[fine] + np.log(cube[fine]))
        out[left[fine]] = d[left[fine]] * cube[fine]
        left, turn = left[~fine], turn + 1
    return out


def parent_draw(customers: np.ndarray, *keys) -> np.ndarray:
    """Gamma draws whose shares are the parent's probabilities, given its customers."""
    shape = customers - ROOT_DISCOUNT
    return gamma(shape + 1, 0, *keys) * uniform(1, *keys) ** (1 / shape)


def rest_draw(known_words: int, *keys) -> float:
    """The same for all words never seen."""
    return float(gamma(np.array([1 + ROOT_STRENGTH + ROOT_DISCOUNT * known_words]), 2, *keys, np.zeros(1))[0] * uniform(3, *keys) ** (1 / (ROOT_STRENGTH + ROOT_DISCOUNT * known_words)))


def stirling(discount: float = DISCOUNT, limit: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t) up to ``limit``: ways to seat c customers at t tables, by weight."""
    cache = worker_cache()
    if ("stirling", discount, limit) not in cache:
        log = np.full((limit + 1, limit + 2), -np.inf)
        log[1, 1] = 0.0
        t = np.arange(limit + 2)
        for n in range(1, limit):
            stay = np.log(np.maximum(n - discount * t, 1e-300)) + log[n]
            log[n + 1, 1:] = np.logaddexp(stay[1:], log[n, :-1])
        cache["stirling", discount, limit] = log
    return cache["stirling", discount, limit]


def draw_tables(count: np.ndarray, z: np.ndarray, u: np.ndarray, discount: float = DISCOUNT, limit: int = EXACT) -> np.ndarray:
    """Tables of each pair: weight ``z ** t * S(count, t)``, drawn with the uniform numbers ``u``.

    Beyond ``limit`` customers: tables make a Poisson process of weight z whose
    sizes add up to the count.  At the saddle point, where their mean is the
    count, tables beyond the first have the mean ``z * (1 - y ** discount) /
    discount``, y solving ``z * (1 - y) * y ** (discount - 1) = count``, and a
    variance that is less by what the count tells of them.
    """
    tables = np.minimum(count, 1)
    order = np.argsort(count, kind="stable")
    order = order[count[order] > 1]
    log = stirling(discount, limit)
    sizes, starts = np.unique(count[order], return_index=True)
    for c, a, b in zip(sizes.tolist(), starts, [*starts[1:], len(order)], strict=True):
        if c > limit:
            rows = order[a:]
            n, own = count[rows].astype(float), np.maximum(z[rows], 1e-300)
            low, high = np.full(len(rows), -200.0), np.zeros(len(rows))
            for _ in range(60):  # bisection on log y
                y = (low + high) / 2
                more = np.log(own) + np.log(-np.expm1(y)) + (discount - 1) * y > np.log(n)
                low, high = np.where(more, y, low), np.where(more, high, y)
            y = np.exp(high)
            mean = own * (1 - y**discount) / discount
            spread = own * ((1 - y) * y ** (discount - 1) + (1 - y) ** 2 * (1 - discount) * y ** (discount - 2))
            rest = np.clip(n * n / np.maximum(spread, 1e-300) / np.maximum(mean, 1e-300), 1e-9, 1 - 1e-9)
            for i, r in enumerate(rows):
                rng = np.random.default_rng(int(u[r] * 2**53))
                tables[r] = 1 + min(int(rng.binomial(max(1, round(mean[i] / rest[i])), rest[i]) if mean[i] / rest[i] < 2e9 else rng.poisson(mean[i])), count[r] - 1)
            break
        step = max(1, 2_000_000 // c)
        for s in range(a, b, step):
            rows = order[s : min(b, s + step)]
            logits = np.log(np.maximum(z[rows], 1e-300))[:, None] * np.arange(1, c + 1) + log[c, 1 : c + 1]
            weight = np.cumsum(np.exp(logits - logits.max(1, keepdims=True)), 1)
            tables[rows] = 1 + np.minimum((weight < u[rows][:, None] * weight[:, -1:]).sum(1), c - 1)
    return tables


def predictive(count, tables, context_count, context_tables, parent):
    """Probability of a word after a context: of one sample, or of arrays of them."""
    return (np.maximum(count - DISCOUNT * tables, 0) + (STRENGTH + DISCOUNT * context_tables) * parent) / (STRENGTH + context_count)


def parent_of(customers, total: int, known_words: int):
    """The parent's probability of words with so many customers of ``total``; none: of the class of unknown words."""
    return np.where(customers > 0, customers - ROOT_DISCOUNT, ROOT_STRENGTH + ROOT_DISCOUNT * known_words) / (ROOT_STRENGTH + total)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 7, left_out: int = 2, seed: int = 3) -> DataFrame:
    """One row per document: key, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Documents whose key's crc32 modulo ``modulus`` is ``left_out`` are held
    out, the others teach the model.  Texts are lower-cased (A-Z) and cut at
    white space; an end token follows.  ``base_score`` is the log10 probability
    under add-one unigram counts, ``score`` that of the model, both in double
    precision.  Null texts are empty: one token, the end.  Keys may repeat and
    be null; repeated rows are documents of their own.  Other columns are not
    read.  An empty table gives an empty one.  With no training documents both
    scores are 0, as the unknown class is then certain.
    """
    spark = docs.sparkSession
    buckets = partitions(spark)  # the scores don't depend on it
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("text"))
    kind_of_id = rows.schema["id"].dataType
    names = [f"t{k}" for k in range(SAMPLES)]
    schema = "kind int, bucket int, block string, u long, n long, " + ", ".join(f"{t} long" for t in names) + ", mass double, blob binary"
    #: Kinds of rows: tables by context, a bucket's pairs, questions or answers, documents, contexts that a bucket needs, totals.
    CONTEXT, PAIRS, ASKED, DOCS, NEED, TOTAL = range(6)

    def emit(kind, size, bucket=None, block=None, u=None, n=None, t=None, mass=None, blob=None):
        import pyarrow as pa

        none = lambda x, of: pa.nulls(size, of) if x is None else pa.array(x, of)
        own = [pa.array(np.full(size, kind, np.int32)), none(bucket, pa.int32()), none(block, pa.string()), none(u, pa.int64()), none(n, pa.int64())]
        own += [none(None if t is None else t[k], pa.int64()) for k in range(SAMPLES)]
        return pa.RecordBatch.from_arrays([*own, none(mass, pa.float64()), none(blob, pa.binary())], names=["kind", "bucket", "block", "u", "n", *names, "mass", "blob"])

    def read(batches):
        """Documents as blocks, one row each; the bucket of a block is its slice."""
        from pyspark import TaskContext

        part, blocks = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def flush():
            nonlocal ids, texts, size, blocks
            blob = read_block(ids, texts, [fold_of(i, modulus) != left_out for i in ids])
            ids, texts, size, blocks = [], [], 0, blocks + 1
            return emit(DOCS, 1, [(part + blocks) % SLICES], [f"{part}-{blocks}"], blob=[blob])

        for batch in batches:
            for i in range(len(batch)):
                ids.append(batch.column("id")[i].as_py())
                texts.append(batch.column("text")[i].as_py())
                size += len(texts[-1] or b"") + 64
                if size > BLOCK_BYTES:
                    yield flush()
        if ids:
            yield flush()

    def ask(batches):
        """The questions of each block."""
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                asked = questions(blob, buckets)
                yield emit(ASKED, len(asked), [b for b, _ in asked], [block] * len(asked), blob=[x for _, x in asked])

    def grouped(column: str, answer):
        """A function over batches that come sorted by ``column``: ``answer(value, rows by kind)`` for each whole group."""

        def run(batches):
            import pyarrow as pa

            held, parts = None, []

            def finish():
                table = pa.Table.from_batches(parts)
                kinds = table.column("kind").to_numpy()
                return answer(held, {int(k): table.filter(pa.array(kinds == k)) for k in np.unique(kinds)})

            for batch in batches:
                values = batch.column(column).to_pylist()
                cuts = [0, *(i for i in range(1, len(values)) if values[i] != values[i - 1]), len(values)]
                for s, e in zip(cuts, cuts[1:], strict=False):
                    if s == e:
                        continue
                    if parts and values[s] != held:
                        yield from finish()
                        parts = []
                    held = values[s]
                    parts.append(batch.slice(s, e - s))
            if parts:
                yield from finish()

        return run

    def dealt(df):
        return df.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind", "block", "u")

    def blobs_of(table):
        return [x.as_py() for x in table.column("blob")]

    def merge(bucket, kinds):
        """Tables by context (one for each pair), pairs of two customers or more, keys of pairs of one customer that blocks without it ask for, the contexts that pairs need, and totals."""
        hashes, word, context, count, without = merge_questions(blobs_of(kinds[ASKED]))
        seen = count > 0
        u, types = np.unique(context[seen], return_counts=True)
        yield emit(CONTEXT, len(u), u=u, n=types)
        more = count > 1
        needed = np.unique(context[more])
        yield emit(NEED, len(needed), np.full(len(needed), bucket), u=needed)
        ones = np.bincount(word[count == 1], minlength=len(hashes))
        single = (count == 1) & without
        yield emit(PAIRS, 1, [bucket], blob=[pickle.dumps((hashes, ones, word[more], context[more], count[more], mix(hashes[word[single]], context[single]), []))])
        customers = np.bincount(word[seen], minlength=len(hashes))
        known = customers > 0
        yield emit(TOTAL, 1, u=[int(known.sum())], n=[int(count.sum())], mass=[float(parent_draw(customers[known], seed, 0, hashes[known]).sum())])

    def store(df, name):
        return written(df, name, free=True)

    blocks, blocks_at = store(rows.mapInArrow(read, schema), "blocks")
    merged, merged_at = store(dealt(blocks.mapInArrow(ask, schema)).mapInArrow(grouped("bucket", merge), schema), "merged")
    first = merged.where(F.col("kind") == TOTAL).agg(F.sum("u"), F.sum("n"), F.sum("mass")).first()
    known_words, train_tokens, mass = int(first[0] or 0), int(first[1] or 0), float(first[2] or 0)
    contexts, contexts_at = store(merged.where(F.col("kind") == CONTEXT).groupBy("u").agg(F.sum("n").alias("n")), "contexts")
    spent = [contexts_at]
    types = int(contexts.agg(F.sum("n")).first()[0] or 0)
    need, need_at = store(merged.where(F.col("kind") == NEED).select("bucket", "u").join(contexts, "u").select("bucket", "u", "n"), "need")
    pairs, pairs_at, beyond, totals = merged.where(F.col("kind") == PAIRS), merged_at, None, []
    empty = [F.lit(None).cast("long").alias(t) for t in names]

    def sweep_of(number: int, mass: float):
        def sweep(bucket, kinds):
            """New tables of the bucket's pairs; by context, the tables beyond one for each pair."""
            hashes, ones, word, context, count, singles, kept = pickle.loads(blobs_of(kinds[PAIRS])[0])
            tables = kept[-1] if kept else np.ones(len(word), np.int64)
            customers = ones + np.bincount(word, tables, len(hashes)).astype(np.int64)
            known = customers > 0
            if len(word):
                u, t = (kinds[NEED].column(c).to_numpy() for c in ("u", "n"))
                parent = np.zeros(len(hashes))
                parent[known] = parent_draw(customers[known], seed, number, hashes[known]) / mass
                x = gamma(STRENGTH / DISCOUNT + t.astype(float), seed, number, u)
                z = DISCOUNT * x[np.searchsorted(u, context)] * parent[word]
                tables = draw_tables(count, z, uniform(seed, number, hashes[word], context))
                kept = [*(kept if number > BURN_IN else []), tables]
                extra = np.bincount(np.searchsorted(u, context), tables - 1, len(u)).astype(np.int64)
                some = extra > 0
                yield emit(CONTEXT, int(some.sum()), u=u[some], n=extra[some])
            customers = ones + np.bincount(word, tables, len(hashes)).astype(np.int64)
            yield emit(TOTAL, 1, mass=[float(parent_draw(customers[known], seed, number + 1, hashes[known]).sum())])
            yield emit(PAIRS, 1, [bucket], blob=[pickle.dumps((hashes, ones, word, context, count, singles, kept))])

        return sweep

    for number in range(BURN_IN + SAMPLES):
        now = need if beyond is None else need.join(beyond, "u", "left").select("bucket", "u", (F.col("n") + F.coalesce("extra", F.lit(0))).alias("n"))
        needed = now.select(F.lit(NEED).alias("kind"), "bucket", F.lit(None).cast("string").alias("block"), "u", "n", *empty, F.lit(None).cast("double").alias("mass"), F.lit(None).cast("binary").alias("blob"))
        done, done_at = store(dealt(pairs.union(needed)).mapInArrow(grouped("bucket", sweep_of(number, mass + rest_draw(known_words, seed, number))), schema), "sweep")
        mass = float(done.where(F.col("kind") == TOTAL).agg(F.sum("mass")).first()[0] or 0)
        pairs = done.where(F.col("kind") == PAIRS)
        drop_path(spark, pairs_at)
        pairs_at = done_at
        beyond, beyond_at = store(done.where(F.col("kind") == CONTEXT).groupBy("u").agg(F.sum("n").alias("extra")), "beyond")
        spent.append(beyond_at)
        if number >= BURN_IN:
            totals.append((types + int(beyond.agg(F.sum("extra")).first()[0] or 0), beyond))
    drop_path(spark, need_at)
    home = contexts
    for t, (_, extra) in zip(names, totals, strict=True):
        home = home.join(extra.withColumnRenamed("extra", t), "u", "left")
    home = home.select(F.lit(CONTEXT).alias("kind"), (F.col("u") % buckets).cast("int").alias("bucket"), F.lit(None).cast("string").alias("block"), "u", "n", *[(F.col("n") + F.coalesce(t, F.lit(0))).alias(t) for t in names], F.lit(None).cast("double").alias("mass"), F.lit(None).cast("binary").alias("blob"))
    home, home_at = store(home, "home")
    for path in spent:
        drop_path(spark, path)
    sums = [t for t, _ in totals]

    def answer(bucket, kinds):
        """To each block that asked: of its words, customers, the parent's customers and tables as contexts; of its pairs, customers and tables."""
        if ASKED not in kinds:
            return
        hashes, ones, word, context, count, singles, kept = pickle.loads(blobs_of(kinds[PAIRS])[0])
        tables = kept or [np.zeros(0, np.int64)] * SAMPLES
        keys = mix(hashes[word], context)  # in order, as questions were merged
        of_word, *parents = (ones + np.bincount(word, x, len(hashes)).astype(np.int64) for x in (count, *tables))
        as_context = np.zeros((SAMPLES, len(hashes)), np.int64)
        if CONTEXT in kinds:
            u = kinds[CONTEXT].column("u").to_numpy()
            at = np.minimum(np.searchsorted(u, hashes), len(u) - 1)
            for k, t in enumerate(names):
                as_context[k] = np.where(u[at] == hashes, kinds[CONTEXT].column(t).to_numpy()[at], 0)
        for block, blob in zip(kinds[ASKED].column("block").to_pylist(), blobs_of(kinds[ASKED]), strict=True):
            words, which, contexts_asked, own = keys_of(hashes, unpack(blob))
            pairs_asked = known_pairs(keys, count, tables, singles, mix(hashes[which], contexts_asked), own)
            yield emit(ASKED, 1, [bucket], [block], blob=[pack(*(narrow(a[words]) for a in (of_word, *parents, *as_context)), *map(narrow, pairs_asked))])

    def add_up(block, kinds):
        import pyarrow as pa

        ids, tokens, h, size, trains = open_block(blobs_of(kinds[DOCS])[0], buckets)
        parts = [unpack(b) for b in blobs_of(kinds[ASKED])]
        columns = [np.concatenate([p[k] for p in parts]).astype(np.int64) for k in range(2 + 3 * SAMPLES)]
        of_word, parents, as_context = columns[0], columns[1 : 1 + SAMPLES], columns[1 + SAMPLES : 1 + 2 * SAMPLES]
        count, tables = columns[1 + 2 * SAMPLES], columns[2 + 2 * SAMPLES :]
        pair, which = pairs_of(tokens, size, True)
        if len(of_word) != len(h) or len(count) != len(pair):
            raise ValueError("a block's answers are not complete")
        word, context = pair >> 32, pair & (2**32 - 1)
        p = sum(predictive(count, tables[k], of_word[context], as_context[k][context], parent_of(parents[k], sums[k], known_words)[word]) for k in range(SAMPLES)) / SAMPLES
        doc = np.repeat(np.arange(len(ids)), size)
        add = lambda x: np.bincount(doc, x, len(ids))
        known = of_word[tokens]
        base = add(np.log10((known + 1) / (train_tokens + known_words + 1)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, arrow_kind), pa.array(~trains), pa.array(size.astype(np.int64)), pa.array(add((known > 0).astype(float)).astype(np.int64)), pa.array(base), pa.array(add(np.log10(p)[which]) if train_tokens else np.zeros(len(ids)))],
            names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"],
        )

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_kind = to_arrow_type(kind_of_id)
    result = f"id {kind_of_id.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    parts = [spark.createDataFrame([], result)]
    for part in sorted(r.bucket for r in blocks.select("bucket").distinct().collect()):
        own = blocks.where(F.col("bucket") == part)
        answers = dealt(own.mapInArrow(ask, schema).union(pairs).union(home)).mapInArrow(grouped("bucket", answer), schema)
        out = answers.union(own).repartition(buckets, "block").sortWithinPartitions("block", "kind", "bucket")
        parts.append(store(out.mapInArrow(grouped("block", add_up), result), "scores")[0])
    for path in (blocks_at, pairs_at, home_at):
        drop_path(spark, path)
    out = reduce(DataFrame.union, parts)
    return out.select(F.col("id").alias(key), "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
