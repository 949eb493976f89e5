"""SimHash near-duplicate detection by multi-index hashing.

Every text gets a 64-bit fingerprint of its word shingles.  Two fingerprints link
when at most ``max_distance`` bits differ.  The links are found without comparing
all pairs: the 64 bits are cut into segments, each segment gets a radius so that
``sum(radius + 1) > max_distance``, hence two linked fingerprints agree in at least
one segment up to its radius.  The table side stores each fingerprint once per
segment; the probing side enumerates the small Hamming ball of each of its segments,
fetches the table rows with such a key and verifies the complete distance.

A first pass links each fingerprint to the smallest one with the same segment value, and
the probes then fetch only rows of other parts, so a group of n near copies costs about n
rows and not n * n.  A segment value that many fingerprints hold (``HOT``) is split: two
linked fingerprints differ in at most four bits, so of six pieces of the other bits at
least two agree, and the rows are fetched by the segment value and a pair of pieces.

Everything after the fingerprints works on *distinct* fingerprints, so a group of
exact copies is one node however large it is, and the class label travels back to
the documents by a join on the fingerprint.

Rows
    null text or a text without words: fingerprint zero, linked like any other.
    fewer words than a shingle: the whole word sequence is the only shingle.
    repeated rows and repeated ids: each row is labelled; equal texts share a class.
    null id: the row keeps its fingerprint and class, but never names a class unless
    every member lacks an id (then the class id is null).
    empty table: an empty result with the same columns.
    other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, in_arrow, materialise, numbered_rows, one_of_each_part

SEED = 42
BITS = 64
#: Segment (offset, width, radius) lists for four differing bits.  The first serves
#: tables of up to ``SMALL_TABLE`` distinct fingerprints: 45 probes a fingerprint over
#: 21-bit keys.  The second, for larger tables, trades 562 probes for 32-bit keys.
THREE_SEGMENTS = ((0, 22, 1), (22, 21, 1), (43, 21, 0))
TWO_SEGMENTS = ((0, 32, 2), (32, 32, 1))
SMALL_TABLE = 1 << 25
#: Rows of one segment value from which it is split, and the number of pieces of that.
HOT, PIECES = 256, 6
#: Hot segment values that are broadcast at most.
MOST_HOT = 200_000

_UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, shingle: int = 4) -> np.ndarray:
    """XXH64 of every word shingle of a text, repeats included (empty: no words)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_UPPER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([h(b" ".join(words), SEED)], np.uint64)
    flat = b" ".join(words)
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    starts.append(at)
    ends = starts[shingle:]
    return np.fromiter((h(flat[a : b - 1], SEED) for a, b in zip(starts, ends, strict=False)), np.uint64, len(ends))


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Bit i is one if it is one in over half of the shingle hashes."""
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprint_of(h: np.ndarray) -> int:
    if not h.size:
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, h.size, 65536):
        part = h[i : i + 65536].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > h.size).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): one row per document; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return in_arrow(rows, run, "id long, fp long")


def _key(offset: int, width: int) -> Column:
    return F.shiftrightunsigned("fp", offset).bitwiseAND(F.lit((1 << width) - 1))


def _ball(width: int, radius: int) -> list[int]:
    """Masks of up to ``radius`` of ``width`` bits."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def _keys(segments: tuple) -> Column:
    """One (seg, key) per segment of ``fp``."""
    return F.array(*[F.struct(F.lit(i).alias("seg"), _key(o, w).alias("key")) for i, (o, w, _) in enumerate(segments)])


def _probe(seg: int, offset: int, width: int) -> Callable[[Column], Column]:
    return lambda mask: F.struct(F.lit(seg).alias("seg"), _key(offset, width).bitwiseXOR(mask).alias("key"))


def _near(max_distance: int) -> Column:
    return F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance


def star_links(nodes: DataFrame, max_distance: int = 4, segments: tuple = THREE_SEGMENTS) -> DataFrame:
    """(a, b): fingerprints that lie near the smallest one with the same segment value.

    One row per fingerprint and segment at most, also in a group of many near copies.
    """
    keyed = nodes.select("fp", F.explode(_keys(segments)).alias("t")).select(F.col("fp").alias("b"), "t.seg", "t.key")
    least = keyed.groupBy("seg", "key").agg(F.min("b").alias("a"))
    return keyed.join(least, ["seg", "key"]).where((F.col("a") < F.col("b")) & _near(max_distance)).select("a", "b").distinct()


def _pairs_of_pieces(offset: int, width: int) -> Column:
    """A key for each pair of the PIECES of the bits outside a segment, with the pair's number."""
    low, rest = (1 << offset) - 1, BITS - width
    outside = F.col("fp").bitwiseAND(F.lit(low)).bitwiseOR(F.call_function("shiftleft", F.shiftrightunsigned("fp", offset + width), F.lit(offset)) if offset + width < BITS else F.lit(0).cast("long"))
    cuts = [rest * i // PIECES for i in range(PIECES + 1)]
    bits = [F.shiftrightunsigned(outside, i).bitwiseAND(F.lit((1 << (j - i)) - 1)) for i, j in zip(cuts, cuts[1:], strict=False)]
    return F.array(*[F.xxhash64(F.lit(n), bits[i], bits[j]) for n, (i, j) in enumerate(combinations(range(PIECES), 2))])


def hamming_links(nodes: DataFrame, max_distance: int = 4, segments: tuple = THREE_SEGMENTS) -> DataFrame:
    """(a, b) with a < b: the pairs of distinct fingerprints that differ in at most
    ``max_distance`` bits.  ``nodes`` has one row per fingerprint ``fp``; with a column
    ``part``, only pairs of different parts are returned."""
    if sum(r + 1 for _, _, r in segments) <= max_distance or sum(w for _, w, _ in segments) != BITS:
        raise ValueError("the segments' radii don't cover the distance")
    if max_distance > PIECES - 2:
        raise ValueError("the pieces don't cover the distance")
    probes = []
    for i, (offset, width, radius) in enumerate(segments):
        masks = F.array(*[F.lit(m).cast("long") for m in _ball(width, radius)])
        probes.append(F.transform(masks, _probe(i, offset, width)))
    part = F.col("part") if "part" in nodes.columns else F.col("fp")
    held = nodes.select("fp", part.alias("part"), F.explode(_keys(segments)).alias("t")).select("fp", "part", "t.seg", "t.key")
    asked = nodes.select("fp", part.alias("part"), F.explode(F.concat(*probes)).alias("t")).select("fp", "part", "t.seg", "t.key")

    hot = held.groupBy("seg", "key").agg(F.count("*").alias("n"), F.min("part").alias("low"), F.max("part").alias("high"))
    hot = materialise(hot.where(F.col("n") > HOT).drop("n"), "hot_keys")
    n_hot = hot.count()
    known = F.broadcast(hot.select("seg", "key")) if n_hot <= MOST_HOT else hot.select("seg", "key")
    cold_held, cold_asked = (x.join(known, ["seg", "key"], "left_anti") if n_hot else x for x in (held, asked))
    b = cold_held.select("seg", "key", F.col("fp").alias("b"), F.col("part").alias("part_b"))
    a = cold_asked.select("seg", "key", F.col("fp").alias("a"), F.col("part").alias("part_a"))
    near = (F.col("a") < F.col("b")) & _near(max_distance) & (F.col("part_a") != F.col("part_b"))
    out = a.join(b, ["seg", "key"]).where(near).select("a", "b")
    if n_hot:
        told = F.broadcast(hot) if n_hot <= MOST_HOT else hot
        # rows of a value that only the prober's own part holds have nothing to tell
        open_ = asked.join(told, ["seg", "key"]).where((F.col("low") != F.col("high")) | (F.col("part") != F.col("low")))
        subs = F.element_at(F.array(*[_pairs_of_pieces(o, w) for o, w, _ in segments]), F.col("seg") + 1)
        split = lambda d: d.withColumn("sub", F.explode(subs))
        b = split(held.join(known, ["seg", "key"], "left_semi")).select("seg", "key", "sub", F.col("fp").alias("b"), F.col("part").alias("part_b"))
        a = split(open_).select("seg", "key", "sub", F.col("fp").alias("a"), F.col("part").alias("part_a"))
        parts = b.select("seg", "key", "sub", "part_b").distinct()
        a = a.join(parts, ["seg", "key", "sub"]).where("part_a <> part_b")
        out = out.unionByName(a.join(b, ["seg", "key", "sub", "part_b"]).where(near).select("a", "b"))
    return out.distinct()


def links_of(nodes: DataFrame, max_distance: int = 4) -> DataFrame:
    """(a, b): links that connect the same fingerprints as all pairs of ``nodes`` (one row per
    fingerprint ``fp``) that differ in at most ``max_distance`` bits; written, to be discarded."""
    segments = THREE_SEGMENTS if max_distance == 4 and nodes.count() <= SMALL_TABLE else TWO_SEGMENTS
    stars = materialise(star_links(nodes, max_distance, segments), "star_links")
    parts = connected_components(nodes.sparkSession, stars)
    known = nodes.select("fp").join(parts, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("part", "fp").alias("part"))
    known = materialise(known, "known_parts")
    out = materialise(hamming_links(known, max_distance, segments).unionByName(stars), "links")
    discard(stars)
    discard(known)
    return out


def parts_of(nodes: DataFrame, max_distance: int = 4) -> DataFrame:
    """(node, part) of each linked fingerprint of ``nodes`` (one row per fingerprint ``fp``);
    part is the smallest fingerprint reachable over links."""
    links = links_of(nodes, max_distance)
    out = materialise(connected_components(nodes.sparkSession, links), "parts")
    discard(links)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_distance: int = 4) -> DataFrame:
    """One row per document: ``id_col``, ``fingerprint`` (16 hex digits), ``component_id``
    (smallest id reachable over links, its own included)."""
    fps = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = materialise(fps.groupBy("fp").agg(F.min("id").alias("least")), "distinct_fingerprints")
    label = nodes.join(parts_of(nodes, max_distance), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("part", "fp").alias("part"))
    label = materialise(label, "labels")
    least = label.groupBy("part").agg(F.min("least").alias("component_id"))
    of = label.join(least, "part").select("fp", "component_id")
    return fps.join(of, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_distance: int = 4, similarity: float | None = None) -> DataFrame:
    """One row of each group of near copies: that of the group's smallest id.

    Without ``similarity`` groups are connected over fingerprints that link.  With it (0.8 or
    more) they are connected over texts whose shingle sets have that Jaccard similarity: links
    of fingerprints are candidates, and so is what ``near_copies`` finds beyond their reach.

    Groups are told apart by their fingerprints, so an id that stands in several groups is
    kept once in each where it is the smallest.  Rows of a group that share this id are told
    apart by their content; a group whose rows all lack an id keeps one of them in that way.
    """
    if similarity is not None:
        from .near_copies import keep_similar

        return keep_similar(docs, id_col, text_col, similarity, shingle, max_distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps, pa.int64())], ["row", "id", "text", "fp"])

    rows = materialise(numbered_rows(docs, id_col, text_col, run, "fp long"), "fingerprinted_rows")
    nodes = materialise(rows.select("fp").distinct(), "distinct_fingerprints")
    parts = parts_of(nodes, max_distance)
    discard(nodes)
    return one_of_each_part(rows, parts)
