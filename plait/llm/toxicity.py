"""Toxicity by two class-conditional Kneser-Ney bigram models.

Tokens are pieces of words, four letters each from a word's start, so that
expressions never seen as a whole still share pieces with those that were.
Both classes have an interpolated Kneser-Ney model of a piece after the one
before it in its word; a word's first piece follows the word's start.  Its
lower order, the continuation distribution of pieces, backs off to one that is
shared: pooled continuation counts of both classes, so that rare expressions
are smoothed alike in both and don't speak for either.

A text's evidence compares length-normalised log-likelihoods: the toxic
model's minus the ordinary model's, over a stretch of the text, divided by the
stretch's length and ``NEUTRAL`` tokens more, for which neither model speaks.
Stretches have ``LENGTHS`` pieces, or are the whole text, and run over words;
the stretch that speaks most for toxicity decides, since a few toxic
expressions make a long text toxic.  A logistic curve of this one number,
fitted on a part of the sample that the models have not seen, turns it into a
score.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, worker_cache

#: Bound of the sample: labelled texts of each class.
SAMPLE_TEXTS = 3000
LENGTHS = (1, 2, 3, 4, 6, 8, 12, 16, 32, 64, 128, 256)
NEUTRAL = 1
DISCOUNT = 0.75
START = 0


def pieces(text: str) -> list[str]:
    """Pieces of up to four letters or digits; a word's first comes with the sign before it."""
    return re.findall(r"\W?\w{1,4}", " " + text.lower())


def canonical(piece: str) -> str:
    """First pieces of words start with ^ whatever sign stood there."""
    return piece if piece[0].isalnum() or piece[0] == "_" else "^" + piece[1:]


class Ids(dict):
    """Ids of pieces as they stand in texts; the unknown get the last id and are kept, up to a bound."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> int:
        known = canonical(piece)
        i = self.vocabulary.get(known, len(self.vocabulary) + (known[0] == "^"))
        if len(self) > 300_000:
            self.clear()
        self[piece] = i
        return i


def discounted(count: np.ndarray) -> np.ndarray:
    """What each count gives to the lower order."""
    return np.minimum(count, DISCOUNT)


@dataclass
class Model:
    """Vocabulary, sorted bigram keys, and for both classes log probabilities in parts."""

    vocabulary: dict[str, int]
    keys: np.ndarray
    ratio: np.ndarray  # of each seen pair: log p(toxic) - log p(ordinary)
    single: np.ndarray  # log continuation probability by class and piece; the last two are for unknown pieces
    weight: np.ndarray  # log backoff weight by class and context; the last two are for unknown contexts
    first: np.ndarray  # whether a piece starts a word
    curve: np.ndarray

    def differences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood differences, toxic minus ordinary, of all pieces of all texts, and pieces of each text."""
        if "ids" not in self.__dict__:
            self.__dict__["ids"] = Ids(self.vocabulary)
        get = self.__dict__["ids"].__getitem__
        lots = [np.fromiter(map(get, x), np.int64, len(x)) for x in map(pieces, texts)]
        words = np.concatenate([*lots, np.zeros(0, np.int64)])
        # A text's first piece always starts a word.
        before = np.concatenate([[START], words[:-1]])[: len(words)]
        before[self.first[words]] = START
        key = before * len(self.first) + words
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        far = self.weight[0, before] - self.weight[1, before] + self.single[0, words] - self.single[1, words]
        return np.where(self.keys[at] == key, self.ratio[at], far), np.array([len(x) for x in lots], int)

    def evidence(self, texts: list[str]) -> np.ndarray:
        """The greatest length-normalised difference of a stretch of each text; 0 for texts without pieces."""
        each, count = self.differences(texts)
        out, sums, end = np.zeros(len(count)), np.concatenate([[0.0], np.cumsum(each)]), np.cumsum(count)
        for i, (a, b) in enumerate(zip(end - count, end, strict=True)):
            if a < b:
                own = sums[a : b + 1]
                out[i] = max((own[k:] - own[:-k]).max() / (k + NEUTRAL) for k in (*(k for k in LENGTHS if k < b - a), int(b - a)))
        return np.stack([out, np.ones(len(out))], 1)

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.evidence(texts) @ self.curve, -500, 500)))


def fit(texts: list[str], labels: list[int], share: float | None = None) -> Model:
    """Models from four fifths of the texts, the curve from the rest; with one class only, or none, every score is the share of toxic ones (none: 0.001).  ``share``: of toxic texts among all, if the sample has another."""
    part = np.array([int(hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % 5 for t in texts], int)
    y = np.array(labels, int)
    if len(texts) and not ((part > 0) & (y == 1)).any() or not ((part > 0) & (y == 0)).any():
        part[:] = 1
    lots = [[canonical(p) for p in pieces(t)] for t in texts]
    vocabulary: dict[str, int] = {"": START}
    for x, p in zip(lots, part, strict=True):
        if p:
            for w in x:
                vocabulary.setdefault(w, len(vocabulary))
    size = len(vocabulary) + 2
    first = np.array([w[:1] == "^" for w in vocabulary] + [False, True])
    tables = []
    for k in (1, 0):
        held_pairs = [np.zeros(0, np.int64)]
        for x, p, c in zip(lots, part, y, strict=True):
            if p and c == k:
                ids = np.array([vocabulary[w] for w in x], np.int64)
                before = np.concatenate([[START], ids[:-1]])[: len(ids)].astype(np.int64)
                before[first[ids]] = START
                held_pairs.append(before * size + ids)
        tables.append(np.unique(np.concatenate(held_pairs), return_counts=True))
    both = np.unique(np.concatenate([k for k, _ in tables]))
    # Continuation counts: the kinds of pieces that follow a piece or come before it.
    kinds_of = lambda keys: np.bincount(keys % size, minlength=size) + np.bincount(keys // size, minlength=size) * (np.arange(size) != START)
    # Every piece, and the unknown one, has one more in the shared counts.
    shared = (kinds_of(both) + 1) / (kinds_of(both).sum() + size)
    single, weight, log_seen = np.zeros((2, size)), np.zeros((2, size)), []
    for i, (keys, count) in enumerate(tables):
        kinds = kinds_of(keys)
        p = np.maximum(kinds - discounted(kinds), 0) / max(1, kinds.sum())
        p += (1 - p.sum()) * shared
        single[i] = np.log(p)
        context, word = keys // size, keys % size
        n = np.bincount(context, count, size)
        off = discounted(count)
        weight[i] = np.log(np.where(n > 0, np.bincount(context, off, size) / np.maximum(n, 1), 1.0))
        full = np.exp(weight[i][both // size] + single[i][both % size])
        full[np.searchsorted(both, keys)] += (count - off) / n[context]
        log_seen.append(np.log(full))
    model = Model(vocabulary, both if len(both) else np.array([-1]), log_seen[0] - log_seen[1] if len(both) else np.zeros(1), single, weight, first, np.zeros(2))
    held = part == 0
    if not held.any() or len(set(y[held])) < 2:
        held[:] = True
    if len(texts) and len(set(y)) == 2:
        x = model.evidence([t for t, h in zip(texts, held, strict=True) if h])
        model.curve = logistic(x, y[held], y[held].mean() if share is None else share)
    else:
        share = min(0.999, max(0.001, y.mean() if len(y) else 0))
        model.curve = np.array([0, np.log(share / (1 - share))])
    return model


def logistic(x: np.ndarray, y: np.ndarray, share: float, ridge: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; ``share`` is the weight of class 1."""
    w = np.zeros(x.shape[1])
    c = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum()))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (c * p * (1 - p))[:, None]).T @ x + ridge * np.diag([1.0] * (len(w) - 1) + [0])
        step = np.linalg.solve(h + 1e-9 * np.eye(len(w)), x.T @ (c * (y - p)) - ridge * np.append(w[:-1], 0))
        w += np.clip(step, -50, 50)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_texts: int = SAMPLE_TEXTS) -> Model:
    """A model from at most ``sample_texts`` labelled texts of each class, whole ones.

    ``labels`` has key and label (1 or 0; other values and nulls are passed
    over, contradicting rows of a key count each).  The texts are those with
    the smallest hash of their key in each of ``sample_texts`` cells, among
    keys that ``docs`` has; the share of toxic keys is taken of those too.
    Labels and documents that must not teach are the caller's to leave out.
    Null texts count as empty; of rows that share a key the least text is
    taken, so that a repeated key is one text.
    """
    marked = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"))
    marked = marked.join(docs.select(F.col(key).alias("_key")), "_key", "left_semi")
    cell = F.pmod(F.xxhash64(F.lit(1), "_key"), F.lit(sample_texts))
    # The keys are chosen first, so that only the sample's texts are gathered.
    picked = marked.groupBy("_label", cell.alias("cell")).agg(F.min(F.struct(F.xxhash64(F.lit(2), "_key"), "_key")).alias("m"), F.count("*").alias("n"))
    picked = materialise(picked.select("_label", F.col("m._key").alias("_key"), "n"), "labelled")
    total = {r["_label"]: r["n"] for r in picked.groupBy("_label").agg(F.sum("n").alias("n")).collect()}
    own = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    # At most two rows of 16 bytes a cell.
    rows = own.join(F.broadcast(picked), "_key").groupBy("_key", "_label").agg(F.min("_text").alias("t"))
    taken = sorted((r["t"], r["_label"]) for r in rows.collect())
    return fit([t for t, _ in taken], [c for _, c in taken], total.get(1, 0) / sum(total.values()) if total else None)


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", score: str = "score", predicted: str = "predicted", threshold: float = 0.3) -> DataFrame:
    """``docs`` with the score of whole texts (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Null texts count as empty, and empty ones have no evidence for either
    class.  Every row is scored by its text alone: repeated rows score alike,
    null and repeated keys stay, an empty table gives an empty one.  Columns of
    the added names are replaced.
    """
    import pickle

    from pyspark.sql import types as T

    blob = pickle.dumps({k: v for k, v in model.__dict__.items() if k != "ids"})
    digest = hashlib.md5(blob).hexdigest()
    shipped = docs.sparkSession.sparkContext.broadcast(blob)
    added = [T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())]
    keep = [c for c in docs.columns if c not in (score, predicted)]

    def run(batches):
        import pyarrow as pa

        cache = worker_cache()
        if cache.get("toxicity", ("",))[0] != digest:
            cache["toxicity"] = digest, Model(**pickle.loads(shipped.value))
        own = cache["toxicity"][1]
        for batch in batches:
            texts = [x or "" for x in batch.column(text).to_pylist()]
            lot = np.cumsum([len(x) for x in texts]) // 2_000_000
            scores = np.concatenate([own.score([texts[i] for i in np.flatnonzero(lot == k)]) for k in np.unique(lot)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=[*keep, score, predicted])

    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, T.StructType([docs.schema[c] for c in keep] + added))
