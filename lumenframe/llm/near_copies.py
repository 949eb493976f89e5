"""Near copies for ``simhash.keep_one``: word shingle sets of a Jaccard similarity of 0.8 or more.

First SimHash: fingerprints of the texts that link by multi-index hashing are candidates, and
each candidate pair is checked on the complete shingle sets, so texts below the similarity
are never linked.  The 64-bit fingerprints of two texts of similarity 0.8 differ in about ten
bits, though, and segments with radii that cover so many are too short to leave anything out
(four of 16 bits with radius 3: 2800 probes, each met by a 65 536th of all rows).  So the
index has further keys for what lies beyond: each set has 32 bands of four minima, and sets
of different parts that share a band are compared too (two sets of similarity 0.8 share none
with a chance of 5e-8).

A first pass over the bands compares each set with the smallest one of its band, so a group of
n near copies costs about n comparisons.  Sets whose bands still hold several parts follow in
blocks, without a row a pair.  First go the sets with more than a fifth of shingles that no
open set of another part holds: they can't have a link left.  The others are clustered by
their bands, and a cluster is dealt into at most ``BLOCKS`` blocks; each two blocks are
compared at once, all sets with all, by a matrix product over the shingles that both hold.  So
rows grow with the number of sets; the products still take time with the square of a cluster.
Everything works on *distinct* shingle sets, so exact copies are one node.

Rows
    null text or a text without words: the empty set, a group of its own.
    fewer words than a shingle: the whole word sequence is the only shingle.
    very long texts: whole.  Ties, null ids, repeated rows and ids, other columns: as in
    ``simhash.keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, discard, in_arrow, materialise, numbered_rows, one_of_each_part
from .simhash import fingerprint_of, links_of, shingle_hashes

SIMILARITY, SHINGLE = 0.8, 5
BANDS, MINIMA = 32, 4
#: So many partners of one text are compared in one task.
PARTNERS = 500
#: A cluster's blocks at most, and the sets from which it has a further one.
BLOCKS, BLOCK_ROWS = 32, 64
#: Sets of one product's left side, and values of a matrix.
STRIP, MOST_VALUES = 1024, 1 << 23


@lru_cache(1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(13)
    shape = (BANDS * MINIMA, 1)
    return r.integers(0, 1 << 64, shape, np.uint64, endpoint=False), r.integers(0, 1 << 63, shape, np.uint64) * np.uint64(2) + np.uint64(1)


def bands(shingles: np.ndarray) -> list[int]:
    """One signed key a band of a set of shingle hashes.  A set of less than four has none:
    no other set can have four fifths in common with it."""
    if len(shingles) < 4:
        return []
    flip, odd = _permutations()
    least = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        least = np.minimum(least, ((shingles[i : i + 4096] ^ flip) * odd).min(axis=1))
    keys = [xxhash.xxh64_intdigest(m.tobytes(), i) for i, m in enumerate(least.reshape(BANDS, MINIMA))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _signed(shingles: np.ndarray) -> int:
    n = xxhash.xxh64_intdigest(shingles.tobytes())
    return n - (1 << 64) if n >> 63 else n


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of shingle hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _similar(pairs: DataFrame, texts: DataFrame, least: float, shingle: int) -> DataFrame:
    """The pairs (a, b) of at least that similarity.  A text with many partners is handed
    to several tasks."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("shares"))
    left = texts.join(many, texts["fp"] == many["a"]).select("a", F.col("text").alias("text_a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
    asked = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("shares")).alias("share"))
    right = texts.select(F.col("fp").alias("b"), F.col("text").alias("text_b"))
    rows = asked.join(right, "b").join(left, ["a", "share"]).select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            told = []
            for a, b, x, y in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if a not in known:
                    known.clear()
                    known[a] = np.unique(shingle_hashes(x, shingle))
                told.append(similarity(known[a], np.unique(shingle_hashes(y, shingle))) >= least)
            yield batch.select([0, 1]).filter(pa.array(told, pa.bool_()))

    return in_arrow(rows, run, "a long, b long")


def _spanning(a: np.ndarray, b: np.ndarray) -> list[int]:
    """The places of pairs (a, b) that connect the same parts as all do: a forest."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    out = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        if (x := root(x)) != (y := root(y)):
            up[max(x, y)] = min(x, y)
            out.append(i)
    return out


def block_links(fp: np.ndarray, part: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, n: np.ndarray, flat: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) between the sets at the places ``left`` and ``right`` that connect the same
    parts as all pairs of at least that similarity do.  Set i has ``size[i]`` shingles, and of
    those the next ``n[i]`` in ``flat`` may be in sets of other parts."""
    row = np.repeat(np.arange(len(n)), n)
    _, column = np.unique(flat, return_inverse=True)
    width = int(column.max(initial=-1)) + 1
    at = np.full(len(n), -1)
    sides = []
    for side in (left, right):
        at[:] = -1
        at[side] = np.arange(len(side))
        mine = at[row] >= 0
        sides.append((at[row[mine]], column[mine]))
    both = np.ones(width, bool)
    for _, c in sides:
        both &= np.bincount(c, minlength=width) > 0
    place = np.cumsum(both) - 1
    sides = [(r[both[c]], place[c[both[c]]]) for r, c in sides]
    width, step = int(both.sum()), max(64, MOST_VALUES // max(STRIP, len(right)))
    found = []
    for top in range(0, len(left), STRIP):
        rows = left[top : top + STRIP]
        common = np.zeros((len(rows), len(right)), np.float32)
        for low in range(0, width, step):
            x, y = (np.zeros((k, min(step, width - low)), np.float32) for k in (len(rows), len(right)))
            for m, (r, c), start in ((x, sides[0], top), (y, sides[1], 0)):
                here = (r >= start) & (r < start + len(m)) & (c >= low) & (c < low + step)
                m[r[here] - start, c[here] - low] = 1
            common += x @ y.T
        union = np.maximum(1, size[rows][:, None] + size[right][None, :] - common.astype(np.float64))
        i, j = np.nonzero((common / union >= least) & (part[rows][:, None] != part[right][None, :]))
        kept = _spanning(part[rows[i]], part[right[j]])
        found.append((rows[i[kept]], right[j[kept]]))
    i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    kept = _spanning(part[i], part[j])
    return fp[i[kept]], fp[j[kept]]


def _links_in_clusters(sets: DataFrame, clusters: DataFrame, least: float) -> DataFrame:
    """Links (a, b) of parts within each cluster.  ``sets``: (fp, part, size, tokens), the
    tokens as bytes; ``clusters``: (node, part) of their fingerprints."""
    of = clusters.select(F.col("node").alias("fp"), F.col("part").alias("cluster"))
    large = of.groupBy("cluster").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK_ROWS)
    blocks = F.coalesce(F.least(F.lit(BLOCKS), F.ceil(F.col("m") / BLOCK_ROWS)), F.lit(1)).cast("int")
    dealt = of.join(F.broadcast(large), "cluster", "left").select("fp", "cluster", blocks.alias("blocks"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    rows = sets.join(dealt, "fp").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cluster", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "fp", "part", "size", "tokens")

    def run(t: pa.Table) -> pa.Table:
        block, fp, part, size = (t.column(c).to_numpy() for c in ("block", "fp", "part", "size"))
        tokens = t.column("tokens").to_pylist()
        n, flat = np.array([len(x) // 8 for x in tokens]), np.frombuffer(b"".join(tokens), np.int64)
        left, right = (np.flatnonzero(block == t.column(c)[0].as_py()) for c in ("low", "high"))
        a, b = block_links(fp, part, size, left, right, n, flat, least)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("cluster", "low", "high").applyInArrow(run, "a long, b long")


def keep_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, shingle: int = SHINGLE, max_distance: int = 4) -> DataFrame:
    """One row of each group of near copies: that of the group's smallest id.  Groups are
    connected over pairs of at least the similarity ``least`` (0.8 or more)."""
    if least < SIMILARITY:
        raise ValueError(f"the bands are laid out for a similarity of {SIMILARITY} or more")
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_ = [shingle_hashes(t, shingle) for t in b.column(2).to_pylist()]
            sets = [np.unique(h) for h in all_]
            sims = np.array([fingerprint_of(h) for h in all_], np.uint64).view(np.int64)
            cols = [pa.array([_signed(s) for s in sets], pa.int64()), pa.array(sims, pa.int64()), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], ["row", "id", "text", "fp", "sim", "bands"])

    rows = materialise(numbered_rows(docs, id_col, text_col, run, "fp long, sim long, bands array<long>"), "shingled_rows")
    firsts = materialise(rows.groupBy("fp").agg(F.min(F.struct("n", "sim")).alias("x")).select("fp", "x.n", "x.sim"), "distinct_sets")

    def similar(pairs: DataFrame, name: str) -> DataFrame:
        pairs = materialise(pairs, f"{name}_pairs")
        if pairs.isEmpty():
            return pairs
        asked = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct().join(firsts, "fp").select("n")
        texts = materialise(rows.join(asked, "n", "left_semi").select("fp", F.col("row")[text_col].cast("string").alias("text")), f"{name}_texts")
        out = materialise(_similar(pairs, texts, least, shingle), f"{name}_links")
        discard(pairs)
        discard(texts)
        return out

    def open_links(held: DataFrame) -> DataFrame:
        asked = held.select("fp", "part").distinct().join(firsts, "fp").select("n", "part")
        texts = rows.join(asked, "n").select("fp", "part", F.col("row")[text_col].cast("string").alias("text"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sets = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in b.column(2).to_pylist()]
                cols = [pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*b.columns[:2], *cols], ["fp", "part", "size", "tokens"])

        sets = materialise(in_arrow(texts, run, "fp long, part long, size long, tokens array<long>"), "open_sets")
        of_token = Window.partitionBy("token")
        told = sets.select("fp", "part", "size", F.explode("tokens").alias("token"))
        told = told.select("*", F.min("part").over(of_token).alias("low"), F.max("part").over(of_token).alias("high")).where("low <> high")
        told = told.groupBy("fp", "part", "size").agg(F.collect_list("token").alias("tokens")).where(F.size("tokens") / F.col("size") >= least)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                packed = pa.array([x.values.to_numpy().tobytes() for x in b.column(3)], pa.binary())
                yield pa.RecordBatch.from_arrays([*b.columns[:3], packed], ["fp", "part", "size", "tokens"])

        left = materialise(in_arrow(told, pack, "fp long, part long, size long, tokens binary"), "linkable_sets")
        discard(sets)
        keyed = held.select("key", "fp", "part").join(left.select("fp"), "fp", "left_semi")
        heads = keyed.groupBy("key").agg(F.min("fp").alias("a"), F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key", "a")
        met = keyed.join(heads, "key").where("a <> fp").select("a", F.col("fp").alias("b"))
        out = materialise(_links_in_clusters(left, connected_components(spark, met), least), "other_links")
        discard(left)
        return out

    def with_part(sets: DataFrame, parts: DataFrame) -> DataFrame:
        return sets.join(parts, F.col("fp") == F.col("node"), "left").drop("node").withColumn("part", F.coalesce("part", "fp"))

    # fingerprints: sets of one fingerprint with the smallest of them, and these over the links
    sims = materialise(firsts.groupBy("sim").agg(F.min("fp").alias("head")), "distinct_fingerprints")
    near = links_of(sims.select(F.col("sim").alias("fp")), max_distance)
    of = lambda x, y: sims.select(F.col("sim").alias(x), F.col("head").alias(y))
    pairs = firsts.join(sims, "sim").where("head <> fp").select(F.col("head").alias("a"), F.col("fp").alias("b"))
    pairs = pairs.unionByName(near.withColumnsRenamed({"a": "x", "b": "y"}).join(of("x", "a"), "x").join(of("y", "b"), "y").select("a", "b"))
    links = similar(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "fingerprint")
    discard(near)
    discard(sims)

    # bands: the smallest set of each with those that aren't in its part yet
    keyed = rows.select("n", "fp", "bands").join(firsts.select("n"), "n", "left_semi").select("fp", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").select("key", "a")
    shared = materialise(keyed.join(shared, "key"), "shared_bands")
    parts = connected_components(spark, links)
    heads = parts.select(F.col("node").alias("a"), F.col("part").alias("part_a"))
    apart = with_part(shared, parts).join(heads, "a", "left").where(F.col("part") != F.coalesce("part_a", "a"))
    links = links.unionByName(similar(apart.select("a", F.col("fp").alias("b")).distinct(), "star"))

    # bands whose sets are still in several parts: blocks of what can have a link to another
    held = with_part(shared.select("key", "fp"), connected_components(spark, links))
    apart = held.groupBy("key").agg(F.min("part").alias("a"), F.max("part").alias("z")).where("a <> z").select("key")
    held = materialise(held.join(apart, "key", "left_semi"), "open_bands")
    if not held.isEmpty():
        links = links.unionByName(open_links(held))
    discard(shared)
    discard(held)
    discard(firsts)
    return one_of_each_part(rows, connected_components(spark, links))
