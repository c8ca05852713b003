"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

Iterative quantisation (Gong and Lazebnik, 2011) learns, on a bounded sample,
a rotation of the principal components whose signs make balanced binary codes.
Codes are cut into parts, one Hamming table each; a table holds every vector
under its part's value, and every vector asks each table for the values within
one bit.  Vectors that meet with whole codes not too far apart are compared by
cosine in double precision; the others of a cell are dropped by a semi-join on
codes alone, before vectors are fetched.

A pair counts in the first table in which it meets, so that it is counted once
without gathering pairs.  A crowded cell is cut into blocks, and each pair of
blocks is a task of its own: no cell is capped, and no task holds a whole cell.
Within a task, links are not listed pair by pair: a task gives each vector's
number of links, and a spanning forest of the links.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialise

#: Bound of the sample on which the rotation is learned.
SAMPLE_VECTORS = 5000
ROUNDS = 40
BITS = 64
PART_BITS = 16
BLOCK = 512
#: Codes of vectors that are compared differ in at most so many of 64 bits; at a cosine of 0.9, 9 are expected.
WHOLE_BITS = 17


def learn_rotation(sample: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """``(mean, projection)``: signs of ``(x - mean) @ projection`` are the code bits.

    Where the vectors have fewer dimensions than there are bits, the rest of
    the bits come from a second rotation of the same components.
    """
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    mean = sample.mean(0) if len(sample) else np.zeros(d)
    x = sample - mean
    directions = np.linalg.svd(x, full_matrices=True)[2].T if len(x) else np.eye(d)
    blocks, left = [], bits
    while left > 0:
        k = min(d, left)
        v = x @ directions[:, :k]
        r = np.linalg.qr(rng.standard_normal((k, k)))[0]
        for _ in range(rounds if len(x) else 0):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        blocks.append(directions[:, :k] @ r)
        left -= k
    return mean, np.concatenate(blocks, 1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codes_of(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Parts of each vector's code: one integer for each table."""
    signs = (x - mean) @ projection >= 0
    tables = projection.shape[1] // PART_BITS
    return (signs.reshape(len(x), tables, PART_BITS) * (1 << np.arange(PART_BITS))).sum(2).astype(np.int64)


def rotation(models: dict, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """The rotation of a dimension; one that the sample doesn't have gets a rotation that isn't learned."""
    if dimension not in models:
        models[dimension] = learn_rotation(np.zeros((0, dimension)))
    return models[dimension]


def near_duplicates(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", threshold: float = 0.9, sample_vectors: int = SAMPLE_VECTORS, whole_bits: int = WHOLE_BITS, exact: bool = False) -> DataFrame:
    """One row per vector: key, ``n_links`` (other rows linked directly), ``component_id`` (smallest key reachable), ``kept``.

    Rows link if their cosine, in double precision, is ``threshold`` or more.
    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing; vectors of different lengths don't link with each
    other.  Equal vectors are compared once, as a class, and link with each
    other; keys may repeat and be null (a null key never names a component
    that has others).  An empty table gives an empty one.  Other columns are
    not read.

    Pairs whose codes differ by more than one bit in every table, or by more
    than ``whole_bits`` in all, are missed; recall is measured against brute
    force in the tests.  With ``exact`` no pair is missed: every block of
    vectors is compared with every block of its dimension, which takes time by
    the square of their number.
    """
    spark = vectors.sparkSession
    x = F.col(embedding).cast("array<double>")
    fine = F.col(embedding).isNotNull() & (F.size(embedding) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(key).alias("id"), F.when(fine, x).alias("x"))
    # A class is named by 128 bits of its vector, so that vectors themselves are no join keys.
    hashes = [F.xxhash64("x").alias("h"), F.xxhash64(F.reverse("x"), F.lit(1)).alias("g")]
    classes = materialise(rows.where("x is not null").groupBy("x").agg(F.min("id").alias("least"), F.count("*").alias("copies")).select("*", *hashes).withColumn("c", F.monotonically_increasing_id()), "vectors")
    picked = classes.orderBy("h").limit(sample_vectors).select("x").collect()
    by_length: dict[int, list] = {}
    for r in picked:
        by_length.setdefault(len(r["x"]), []).append(r["x"])
    model = spark.sparkContext.broadcast({d: learn_rotation(unit(np.array(lot))) for d, lot in by_length.items()})
    tables = BITS // PART_BITS

    def lists(batch):
        """Offsets and values of a batch's vectors."""
        column = batch.column("x")
        return column.offsets.to_numpy(), column.values.to_numpy()

    def cells(batches):
        """Each vector once in every table, and once for every value within one bit of its part.  Cells of different dimensions differ."""
        import pyarrow as pa

        flips = np.array([0, *(1 << np.arange(PART_BITS))])
        for batch in batches:
            offsets, values = lists(batch)
            c, length = batch.column("c").to_numpy(), np.diff(offsets)
            for dimension in np.unique(length):
                at = np.flatnonzero(length == dimension)
                raw = values[offsets[at][:, None] + np.arange(dimension)]
                parts = codes_of(unit(raw), *rotation(model.value, int(dimension)))
                n = len(raw)
                code = (parts << (np.arange(tables) * PART_BITS)).sum(1)
                cell = (parts[:, :, None] ^ flips[None, None, :]) + (int(dimension) * tables + np.arange(tables) << PART_BITS)[None, :, None]
                own = np.repeat(np.arange(n), tables * len(flips))
                yield pa.RecordBatch.from_arrays([pa.array(cell.reshape(-1)), pa.array(c[at][own]), pa.array(code[own]), pa.array(np.tile(np.arange(len(flips)) == 0, n * tables))], names=["cell", "c", "code", "home"])

    if exact:
        left = classes.select(F.shiftleft(F.size("x").cast("long") * tables, PART_BITS).alias("cell"), "c", F.explode(F.array(F.lit(True), F.lit(False))).alias("home"))
    else:
        met = classes.select("c", "x").mapInArrow(cells, "cell long, c long, code long, home boolean")
        asks, homes = met.select("cell", "c", "code"), met.where("home").select("cell", F.col("c").alias("hc"), F.col("code").alias("hcode"))
        near = (F.bit_count(F.col("code").bitwiseXOR(F.col("hcode"))) <= whole_bits) & (F.col("c") != F.col("hc"))
        asks_left = asks.join(homes.withColumnRenamed("cell", "hcell"), (F.col("cell") == F.col("hcell")) & near, "left_semi").select("cell", "c", F.lit(False).alias("home"))
        homes_left = homes.join(asks.withColumnRenamed("cell", "acell"), (F.col("cell") == F.col("acell")) & near, "left_semi").select("cell", F.col("hc").alias("c"), F.lit(True).alias("home"))
        left = materialise(asks_left.union(homes_left), "cells")
    # Crowded cells are cut into blocks by the vector's number.
    sizes = left.groupBy("cell").agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("q"))
    placed = left.join(sizes.select("cell", *[F.ceil(F.col(n) / BLOCK).cast("int").alias(n) for n in "hq"]), "cell")
    block = lambda n: F.pmod(F.xxhash64("c"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    placed = placed.where("home").select("cell", "c", "home", block("h").alias("i"), every("q").alias("j")).union(placed.where("not home").select("cell", "c", "home", every("h").alias("i"), block("q").alias("j")))
    tasks = placed.join(classes.select("c", "x", "copies"), "c").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")

    def compare(batches):
        """Links of each pair of blocks of a cell: counts for each asking vector, and a forest.  Rows come sorted by cell and blocks."""
        import pyarrow as pa

        def group(cell, values, c, home, copies):
            x = unit(values.reshape(len(c), -1))
            a, b = x[home], x[~home]
            hc, ac = c[home], c[~home]
            link = (b @ a.T >= threshold) & (ac[:, None] != hc[None, :])
            if not link.any():
                return
            if not exact:
                # A pair counts in the first table in which it meets.
                own = rotation(model.value, x.shape[1])
                parts_a, parts_b = codes_of(a, *own), codes_of(b, *own)
                for t in range((int(cell) >> PART_BITS) % tables):
                    link &= np.bitwise_count(parts_b[:, t][:, None] ^ parts_a[:, t][None, :]) > 1
            n = link @ copies[home]
            out.extend((v, v, k) for v, k in zip(ac.tolist(), n.tolist(), strict=True) if k)
            parent: dict[int, int] = {}

            def root(v):
                while parent.setdefault(v, v) != v:
                    parent[v] = v = parent[parent[v]]
                return v

            for r, s in zip(*(at.tolist() for at in np.nonzero(link)), strict=True):
                u, v = root(int(ac[r])), root(int(hc[s]))
                if u != v:
                    parent[max(u, v)] = min(u, v)
            out.extend((v, root(v), 0) for v in list(parent) if root(v) != v)

        def flush():
            got = np.array(out, np.int64).reshape(-1, 3)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(got[:, k]) for k in range(3)], names=["c", "other", "links"])

        out: list[tuple[int, int, int]] = []
        rest: list = []  # parts of the group that isn't complete yet
        held = None
        for batch in batches:
            offsets, values = lists(batch)
            keys = np.stack([batch.column(n).to_numpy() for n in ("cell", "i", "j")], 1)
            others = [batch.column("c").to_numpy(), batch.column("home").to_numpy(zero_copy_only=False), batch.column("copies").to_numpy()]
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s == e:
                    continue
                if held is not None and tuple(keys[s]) != held:
                    group(held[0], *(np.concatenate(z) for z in zip(*rest, strict=True)))
                    rest = []
                held = tuple(keys[s])
                rest.append((values[offsets[s] : offsets[e]], *(z[s:e] for z in others)))
            if out:
                yield flush()
        if rest:
            group(held[0], *(np.concatenate(z) for z in zip(*rest, strict=True)))
            yield flush()

    found = materialise(tasks.mapInArrow(compare, "c long, other long, links long"), "links")
    linked = components(found.where("c <> other"), "c", "other").withColumnRenamed("id", "c")
    counts = found.groupBy("c").agg(F.sum("links").alias("links"))
    named = classes.select("c", "least", "copies", "h", "g").join(linked, "c", "left").withColumn("component", F.coalesce("component", "c"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    info = named.join(least, "component").join(counts, "c", "left")
    info = info.select("h", "g", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"))
    out = rows.where("x is not null").select("id", *hashes).join(info, ["h", "g"]).select("id", "component_id", "n")
    # Vectors that link with nothing aren't joined.
    out = out.unionByName(rows.where("x is null").select("id", F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n")))
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
