"""Byte-level BPE encoding and decoding by speculation and verification.

Words of a batch that are not cached are split by greedy longest match over
the vocabulary.  A proposal is the exact encoding if each of its tokens
encodes to itself and no merge of lower rank would cross a border between two
adjacent tokens.  The second condition depends on the two tokens alone, and is
tested for all pairs of the batch at once; only words with a failing pair are
merged pair by pair.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_model

#: The public pattern by which byte-level BPE cuts text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and digits of the newest Unicode version, which the encoding to match counts as neither.
RECENT = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 "
    "10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF "
    "18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 "
    "1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD"
)
#: Words a worker keeps with their tokens before it starts anew.
CACHED_WORDS = 400_000
ENDLESS = np.iinfo(np.int64).max
#: Words of more bytes are merged one by one.
SHORT_WORD = 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, ranks of merges, and for each merged token its two parts."""

    def __init__(self, spec: str):
        import regex

        data = json.loads(spec)
        letters = byte_letters()
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        size = 1 + max([*data["model"]["vocab"].values(), *self.special.values()])
        self.piece = [b""] * size
        for token, i in data["model"]["vocab"].items():
            self.piece[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, i in self.special.items():
            self.piece[i] = token.encode()
        self.size = size
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        vocab = data["model"]["vocab"]
        for r, pair in enumerate(data["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merges[x, y] = r, z
            self.rank[z], self.left[z], self.right[z] = r, x, y
        keys = np.array([x * size + y for x, y in self.merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self.of_bytes = {p: i for i, p in enumerate(self.piece) if i not in set(self.special.values())}
        self.single = [self.of_bytes.get(bytes([b]), -1) for b in range(256)]
        self.longest: dict[bytes, int] = {}
        for p in self.of_bytes:
            self.longest[p[:2]] = max(self.longest.get(p[:2], 0), len(p))
        self.made = np.array([z for _, z in sorted(self.merges.values())], np.int64)
        self.bytes_id = np.array(self.single, np.int64)
        self.proper = np.array([not p or self.merge(p) == [i] for i, p in enumerate(self.piece)])
        recent = "[" + "".join("-".join(rf"\U{x:>08}" for x in r.split("-")) for r in RECENT.split()) + "]"
        self.has_recent = regex.compile(recent).search
        self.split = regex.compile(PATTERN).findall
        self.split_recent = regex.compile("(?V1)" + PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|{recent})").replace(r"\p{L}+", rf"[\p{{L}}--{recent}]+").replace(r"\p{N}+", rf"[\p{{N}}--{recent}]+")).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda text: [text]
        self.words: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.words.clear()
        self.start, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the pair of lowest rank first, the leftmost of equals; a heap over a linked list."""
        ids = [self.single[b] for b in word]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= len(ids) or ids[j] != y:
                continue
            ids[i], ids[j] = self.merges[x, y][1], -1
            after[i] = k = after[j]
            if k < len(ids):
                before[k] = i
                if m := self.merges.get((ids[i], ids[k])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (m := self.merges.get((ids[h], ids[i]))):
                heapq.heappush(heap, (m[0], h, ids[h], ids[i]))
        return [i for i in ids if i >= 0]

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of many words at once: a step merges the best pair of each word."""
        out: list = [None] * len(words)
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        cut = next((i for i, k in enumerate(order) if len(words[k]) > SHORT_WORD), len(order))
        for k in order[cut:]:
            out[k] = self.merge(words[k])
        for at in range(0, cut, 4096):
            part = order[at : at + 4096]
            size = np.array([len(words[k]) for k in part])
            width = int(size[-1]) + 1
            ids = np.full((len(part), width), -1, np.int64)
            ids[np.arange(width) < size[:, None]] = self.bytes_id[np.frombuffer(b"".join(words[k] for k in part), np.uint8)]
            rank = np.full((len(part), width), ENDLESS)
            both = ids[:, 1:] >= 0
            rank[:, :-1][both] = self.pair_rank(ids[:, :-1][both], ids[:, 1:][both])
            live = np.arange(len(part))
            while len(live):
                best = rank[live].argmin(1)
                low = rank[live, best]
                live, best, low = live[low < ENDLESS], best[low < ENDLESS], low[low < ENDLESS]
                if not len(live):
                    break
                ids[live, best] = self.made[low]
                # Close the gap: what follows the merged pair moves one place to the left.
                column = np.arange(width - 1)
                row = ids[live]
                shifted = np.where(column > best[:, None], row[:, 1:], row[:, :-1])
                ids[live, :-1], ids[live, -1] = shifted, -1
                row = rank[live]
                ranks = np.where(column > best[:, None], row[:, 1:], row[:, :-1])
                rank[live, :-1], rank[live, -1] = ranks, ENDLESS
                for x in (best - 1, best):
                    ok = x >= 0
                    r, c = live[ok], x[ok]
                    known = ids[r, c + 1] >= 0
                    rank[r, c] = ENDLESS
                    rank[r[known], c[known]] = self.pair_rank(ids[r[known], c[known]], ids[r[known], c[known] + 1])
            for k, row in zip(part, ids.tolist(), strict=True):
                out[k] = row[: row.index(-1)]
        return out

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, ENDLESS if there is none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], ENDLESS)

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, end = [], 0, len(word)
        get, longest = self.of_bytes.get, self.longest
        while at < end:
            for n in range(min(longest.get(word[at : at + 2], 1), end - at), 0, -1):
                if (i := get(word[at : at + n])) is not None:
                    break
            out.append(i)
            at += n
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of adjacent tokens: whether no merge crosses their border.

        The parts next to the border are followed back in time, the later made
        first; a crossing merge counts if it would come before both parts went
        into larger ones.  At equal rank, the one further left comes first.
        """
        a, b = a.copy(), b.copy()
        good, live = np.ones(len(a), bool), np.arange(len(a))
        until_a, until_b = np.full(len(a), ENDLESS), np.full(len(a), ENDLESS)
        while len(live):
            x, y = a[live], b[live]
            crossing = self.pair_rank(x, y)
            bad = (crossing < until_a[live]) & (crossing <= until_b[live])
            good[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & (np.maximum(rx, ry) >= 0)
            first = go & (rx > ry)
            then = go & ~first
            i, j = live[first], live[then]
            until_a[i], a[i] = rx[first], self.right[x[first]]
            until_b[j], b[j] = ry[then], self.left[y[then]]
            live = live[go]
        return good

    def learn(self, words: list[str]) -> None:
        """Encode words that are not cached, and cache them."""
        if not words:
            return
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        ids = [self.propose(w) for w in raw]
        flat = np.fromiter((i for x in ids for i in x), np.int64)
        owner = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        failing = set(owner[~self.proper[flat]].tolist())
        inner = owner[1:] == owner[:-1]
        pairs = flat[:-1][inner] * self.size + flat[1:][inner]
        each, back = np.unique(pairs, return_inverse=True)
        failing.update(owner[1:][inner][~self.compatible(each // self.size, each % self.size)[back]].tolist())
        failed = sorted(failing)
        for k, exact in zip(failed, self.merge_all([raw[k] for k in failed]), strict=True):
            ids[k] = exact
        n = len(self.words)
        self.words.update(zip(words, range(n, n + len(words)), strict=True))
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum([len(x) for x in ids])])
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.uint32)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; special tokens' strings are those tokens."""
        if len(self.words) > CACHED_WORDS:
            self.clear()
        parts = []
        for text in texts:
            words = []
            for i, piece in enumerate(self.cut(text)):
                if i % 2:
                    words.append(piece)
                elif piece:
                    words += (self.split_recent if not piece.isascii() and self.has_recent(piece) else self.split)(piece)
            parts.append(words)
        new = list({w for words in parts for w in words if w not in self.words})
        special = [w for w in new if w in self.special]
        self.learn([w for w in new if w not in self.special])
        if special:
            n = len(self.words)
            self.words.update(zip(special, range(n, n + len(special)), strict=True))
            self.start = np.concatenate([self.start, self.start[-1] + np.arange(1, len(special) + 1)])
            self.flat = np.concatenate([self.flat, np.array([self.special[w] for w in special], np.uint32)])
        out = []
        for words in parts:
            at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
            first = self.start[at]
            count = self.start[at + 1] - first
            ends = np.cumsum(count)
            total = int(ends[-1]) if len(ends) else 0
            out.append(self.flat[np.repeat(first - ends + count, count) + np.arange(total)])
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.piece.__getitem__, ids.tolist())).decode("utf-8", "replace")


def load(spec: str) -> Vocabulary:
    """The vocabulary, once for each Python process."""
    digest = hashlib.md5(spec.encode()).hexdigest()
    return worker_model(f"bpe-{digest}", digest, lambda: Vocabulary(spec))


def bpe_encode(docs: DataFrame, text: str = "text", vocabulary: str | None = None, ids: str | None = "ids", tokens: str = "n_tokens", decoded: str | None = None, digests: bool = False) -> DataFrame:
    """``docs`` with the ids of its whole texts.

    Adds ``ids`` (array of int, unless None), ``tokens`` (long), ``decoded``
    (the text from the ids, if named) and, with ``digests``, ``ids_sha256`` and
    ``decoded_sha256``.  Null texts count as empty; other columns stay, but for
    those of the names added, which are replaced.  Every row is encoded by
    itself: repeated rows, null and repeated keys stay, an empty table gives an
    empty one.  Texts are encoded in pieces of a batch of about 4 MB, a longer
    text by itself, as a whole.
    """
    from pyspark.sql import types as T

    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    added = [x for x in ((ids, T.ArrayType(T.IntegerType())), (tokens, T.LongType()), (decoded, T.StringType()), *((("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())) if digests else ())) if x[0]]
    keep = [c for c in docs.columns if c not in {n for n, _ in added}]
    if text not in keep:
        raise ValueError(f"the text column {text} can't be one that is added")
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, k) for n, k in added])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            v = load(spec.value)
            texts = batch.column(text).to_pylist()
            weight = np.cumsum([len(x or "") for x in texts]) // 2_000_000
            for lot in np.unique(weight):
                at = np.flatnonzero(weight == lot)
                part = batch.slice(at[0], len(at))
                found = v.encode([texts[i] or "" for i in at])
                more: dict = {tokens: pa.array([len(x) for x in found], pa.int64())}
                if ids:
                    more[ids] = pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)]).astype(np.int32), pa.array(np.concatenate([*found, np.zeros(0, np.uint32)]).astype(np.int32)))
                if decoded or digests:
                    back = list(map(v.decode, found))
                    more[decoded] = pa.array(back, pa.string())
                if digests:
                    more["ids_sha256"] = pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found])
                    more["decoded_sha256"] = pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in back])
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [more[n] for n, _ in added], names=[*keep, *(n for n, _ in added)])

    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def bpe_decode(rows: DataFrame, ids: str = "ids", decoded: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """``rows`` with ``decoded``: the text of an array of ids (null: null)."""
    from pyspark.sql import types as T

    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        spec = rows.sparkSession.sparkContext.broadcast(f.read())
    keep = [c for c in rows.columns if c != decoded]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            v = load(spec.value)
            texts = [None if x is None else v.decode(np.array(x, np.int64)) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(texts, pa.string())], names=[*keep, decoded])

    return rows.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, T.StructType([rows.schema[c] for c in keep] + [T.StructField(decoded, T.StringType())]))
