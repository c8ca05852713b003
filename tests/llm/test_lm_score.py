import itertools
import math
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np

from plait.llm import lm_score
from plait.llm.common import FREE_SHUFFLES

TEXTS = ["the cat sat on the mat", "the dog sat on the cat", None, "", "  ", "a b c a b c a b", "The THE the", "é ü é zebra", "the cat", "new words only here"] * 6


def base(rows):
    """Scores of add-one unigrams by brute force."""
    split = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))) + [b""]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in split(t))
    n, v = sum(c.values()), len(c)
    return {i: (held(i), len(split(t)), sum(c[w] > 0 for w in split(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in split(t))) for i, t in rows}


def test_base_score_by_brute_force(spark):
    rows = list(enumerate(TEXTS))
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, score string, n_tokens double")
    got = {r.doc_id: r for r in lm_score.score(docs).collect()}
    want = base(rows)
    assert got.keys() == want.keys()
    for i, (held, n, known, total, score) in want.items():
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held, n, known, total)
        assert abs(got[i].base_score - score) < 1e-9
        assert got[i].score < 0


def test_empty_table_and_no_training_rows(spark):
    schema = "doc_id long, text string"
    assert lm_score.score(spark.createDataFrame([], schema)).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = lm_score.score(spark.createDataFrame([(only, "a b")], schema)).first()
    assert (row.train_tokens, row.n_known, row.base_score, row.score) == (0, 0, 0.0, 0.0)


def exact(counts):
    """Mean predictive probabilities under the posterior of the tables, summed up over every number of tables of every pair."""
    d, strength, d0, strength0 = lm_score.DISCOUNT, lm_score.STRENGTH, lm_score.ROOT_DISCOUNT, lm_score.ROOT_STRENGTH
    log, keys = lm_score.stirling(), sorted(counts)
    words, contexts = sorted({w for _, w in counts}), sorted({u for u, _ in counts})
    rising = lambda x, n, step: sum(math.log(x + k * step) for k in range(n))
    sums, total = Counter(), 0.0
    for tables in itertools.product(*(range(1, counts[k] + 1) for k in keys)):
        own = dict(zip(keys, tables, strict=True))
        of_context = {u: sum(t for (v, _), t in own.items() if v == u) for u in contexts}
        of_word = {w: sum(t for (_, v), t in own.items() if v == w) for w in words}
        weight = sum(log[counts[k], own[k]] for k in keys) + sum(rising(strength, t, d) for t in of_context.values())
        weight += sum(math.lgamma(t - d0) for t in of_word.values()) - rising(strength0, sum(tables), 1)
        weight = math.exp(weight)
        total += weight
        for u in contexts:
            cu = sum(c for (v, _), c in counts.items() if v == u)
            for w in words:
                p = lm_score.parent_of(np.array(of_word[w]), sum(tables), len(words))
                sums[u, w] += weight * float(lm_score.predictive(counts.get((u, w), 0), own.get((u, w), 0), cu, of_context[u], p))
    return {k: v / total for k, v in sums.items()}


def test_sampler_against_the_exact_posterior():
    """Mean probabilities over many sweeps agree with those of the posterior, enumerated, within 3 %."""
    counts = {(0, 1): 6, (0, 2): 3, (0, 3): 1, (1, 1): 2, (1, 2): 4, (2, 3): 4, (2, 1): 1, (3, 4): 5}
    want = exact(counts)
    keys = sorted(counts)
    context, word, count = np.array([k[0] for k in keys]), np.array([k[1] for k in keys]), np.array([counts[k] for k in keys])
    tables, sums, n = np.ones(len(keys), np.int64), Counter(), 0
    known = len(set(word))
    for sweep in range(12000):
        mass = lm_score.parent_draw(np.bincount(word, tables)[1:], 5, sweep, np.arange(1, known + 1))
        parent = np.append(0, mass) / (mass.sum() + lm_score.rest_draw(known, 5, sweep))
        x = lm_score.gamma(lm_score.STRENGTH / lm_score.DISCOUNT + np.bincount(context, tables), 5, sweep, np.arange(4))
        tables = lm_score.draw_tables(count, lm_score.DISCOUNT * x[context] * parent[word], lm_score.uniform(7, sweep, context, word))
        if sweep >= 200:
            n += 1
            parent = lm_score.parent_of(np.bincount(word, tables), tables.sum(), known)
            for u in range(4):
                own = context == u
                for w in set(word):
                    at = own & (word == w)
                    sums[u, w] += float(lm_score.predictive(count[at].sum(), tables[at].sum(), count[own].sum(), tables[own].sum(), parent[w]))
    assert max(abs(sums[k] / n / want[k] - 1) for k in want) < 0.03


def test_tables_follow_their_weights():
    """Draws have the weights z ** t * S(c, t), S summed up over set partitions; the limit for many customers has nearly the same means."""
    d = lm_score.DISCOUNT
    rising = lambda m: math.prod(k - d for k in range(1, m))

    def ways(c):
        """Weights by tables, the last customer's table and its company chosen in turn."""
        if c == 0:
            return {0: 1.0}
        out = Counter()
        for m in range(1, c + 1):
            for t, x in ways(c - m).items():
                out[t + 1] += math.comb(c - 1, m - 1) * rising(m) * x
        return out

    log = lm_score.stirling()
    for c in (1, 2, 3, 5, 8):
        for t, x in ways(c).items():
            assert abs(log[c, t] - math.log(x)) < 1e-9
    n = 20000
    for c, z in ((2, 0.5), (7, 3.0), (60, 0.2)):
        got = lm_score.draw_tables(np.full(n, c), np.full(n, z), lm_score.uniform(c, np.arange(n)))
        weight = np.exp(np.log(z) * np.arange(1, c + 1) + log[c, 1 : c + 1] - log[c, 1])
        assert abs(got.mean() - (weight * np.arange(1, c + 1)).sum() / weight.sum()) < 0.05
    for c, z in ((400, 0.05), (400, 2.0), (500, 30.0), (500, 300.0), (450, 5000.0)):
        exact = lm_score.draw_tables(np.full(2000, c), np.full(2000, z), lm_score.uniform(c, np.arange(2000))).mean()
        limit = lm_score.draw_tables(np.full(2000, c), np.full(2000, z), lm_score.uniform(c, np.arange(2000)), limit=300).mean()
        assert abs(limit / exact - 1) < 0.06, (c, z, exact, limit)


def test_scores_do_not_depend_on_partitions(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)]
    found = []
    for parts in ("4", "8", "211"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(int(parts) % 5 + 1)
        found.append({r.doc_id: r.score for r in lm_score.score(docs).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0].keys() == dict(rows).keys()
    assert all(abs(found[0][i] - x[i]) < 1e-9 for x in found[1:] for i in x)


def test_null_and_repeated_keys(spark):
    rows = [(None, "the cat sat"), (None, "the cat sat"), (3, "the dog"), (3, "the dog"), (3, None)]
    got = sorted(((str(r.doc_id), r.n_tokens, round(r.score, 9)) for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert [g[:2] for g in got] == [("3", 1), ("3", 3), ("3", 3), ("None", 4), ("None", 4)] and got[1] == got[2] and got[3] == got[4]


def test_probabilities_add_up_to_one():
    """Known words and the class of the unknown ones, after a context with customers and one without."""
    rng = np.random.default_rng(0)
    count = rng.integers(0, 30, (3, 50))
    count[:, 0] = 5
    tables = np.minimum(count, rng.integers(1, 9, count.shape))
    customers, known = tables.sum(0), int((tables.sum(0) > 0).sum())
    parent = lm_score.parent_of(np.append(customers[customers > 0], 0), tables.sum(), known)
    assert abs(parent.sum() - 1) < 1e-12
    for c, t in [*zip(count, tables, strict=True), (np.zeros(50, int), np.zeros(50, int))]:
        c, t = (np.append(x[customers > 0], 0) for x in (c, t))
        assert abs(lm_score.predictive(c, t, c.sum(), t.sum(), parent).sum() - 1) < 1e-12


def test_scores_by_brute_force(spark):
    """With texts whose pairs occur once, nothing is sampled, and scores are sums of the formula's logarithms."""
    rows = [(0, "a b"), (1, "c d e"), (3, None), (4, "b x"), (5, "x a c")]
    split = lambda t: [*(t or "").split(), ""]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    rows += [(i, "a b x zebra") for i in range(6, 100) if held(i)][:2]
    pairs = Counter((u, w) for i, t in rows if not held(i) for u, w in zip(["", *split(t)], split(t), strict=False))
    assert max(pairs.values()) == 1 and any(held(i) for i, _ in rows)
    words, contexts = Counter(w for _, w in pairs), Counter(u for u, _ in pairs)
    p = lambda u, w: float(lm_score.predictive(pairs[u, w], pairs[u, w], contexts[u], contexts[u], lm_score.parent_of(words[w], len(pairs), len(words))))
    got = {r.doc_id: r.score for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert abs(got[i] - sum(math.log10(p(u, w)) for u, w in zip(["", *split(t)], split(t), strict=False))) < 1e-9


def shuffle_bytes(spark):
    """Bytes of all files of shuffles on this machine's disk."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(f.stat().st_size for d in folders for f in Path(str(d)).rglob("shuffle_*") if f.exists())


def test_shuffles_do_not_stay_on_disk(spark):
    """When a table has been written, the shuffles that led to it are gone, without help of the garbage collector."""
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in rng.integers(0, 3000, 400))) for i in range(300)], "doc_id long, text string")
    before = shuffle_bytes(spark)
    lm_score.score(docs).write.format("noop").mode("overwrite").save()
    for _ in range(20):
        if (left := shuffle_bytes(spark) - before) < 50_000:
            break
        time.sleep(0.5)
    assert left < 50_000
    assert spark.conf.get(FREE_SHUFFLES) == "false"


def test_scores_do_not_depend_on_blocks_and_slices(spark, monkeypatch):
    """Texts in one block, which knows all counts itself, and a block a text in three slices, which learn them from each other."""
    texts = TEXTS + ["once only", "once only again", "one more pair", "seen by held-out texts", "seen by"] * 4
    found, slices = [], []
    real = lm_score.written
    for size in (8_000_000, 1):
        names = []
        monkeypatch.setattr(lm_score, "BLOCK_BYTES", size)
        monkeypatch.setattr(lm_score, "written", lambda df, name, names=names, **more: names.append(name) or real(df, name, **more))
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(i, f"rare{i % 97} pair{i % 97}") for i in range(500, 700)], "doc_id long, text string").coalesce(1)
        found.append({r.doc_id: (r.n_known, r.base_score, r.score) for r in lm_score.score(docs).collect()})
        slices.append(names.count("scores"))
    assert slices == [1, lm_score.SLICES]
    assert found[0].keys() == found[1].keys()
    assert all(np.allclose(found[0][i], found[1][i], rtol=0, atol=1e-9) for i in found[0])


def test_customers_of_pairs_that_blocks_ask_for():
    """Counts of a block's pairs, from pairs of two and more and from single ones that it does not have itself, equal those by brute force."""
    rng = np.random.default_rng(2)
    asked = []
    for _ in range(6):
        each = np.unique(rng.integers(0, 40, 60) << 32 | rng.integers(0, 15, 60))
        asked.append((each >> 32, each & (2**32 - 1), rng.integers(0, 2, len(each)) * rng.integers(0, 3, len(each))))
    total = Counter()
    for word, context, own in asked:
        total.update({k: int(c) for *k_, c in zip(word, context, own, strict=True) for k in [tuple(map(int, k_))]})
    blobs = []
    for word, context, own in asked:
        words, sizes = np.unique(word, return_counts=True)
        blobs.append(lm_score.pack(np.diff(words, prepend=0), lm_score.narrow(sizes), context, lm_score.narrow(own)))
    hashes, word, context, count, without = lm_score.merge_questions(blobs)
    keys = lm_score.mix(hashes[word], context)
    more, single = count > 1, (count == 1) & without
    assert more.any() and single.any() and (count == 0).any()
    for (w, u, own), blob in zip(asked, blobs, strict=True):
        _, which, contexts, customers = lm_score.keys_of(hashes, lm_score.unpack(blob))
        got, tables = lm_score.known_pairs(keys[more], count[more], [count[more] - 1], keys[single], lm_score.mix(hashes[which], contexts), customers)
        want = [total[int(a), int(b)] for a, b in zip(w, u, strict=True)]
        assert got.tolist() == want
        assert tables.tolist() == [c - (c > 1) for c in want]
