"""Exact top-k inner products with an impact-ordered index, score at a time.

Vectors are turned into integers and indexed in blocks.  A block's postings stand by
component, ordered by a quantised value of eight bits; the postings of one component and one
value are a segment.  A query's impact on a segment is its own component times the greatest
value there, above the least impact of that component.  The query takes the segments of all
components in descending order of that impact, cut into levels (``SHARES``); the postings of a
level are added to accumulators.  After each level, what a vector can still reach is known:
its accumulated impacts, and for each component not seen yet at most the impact of the next
level.  The k-th best exact score met so far is the floor.  The query stops as soon as it is
proven that all but a few vectors (``REMAIN`` of the block) stay below the floor, and those
few are scored exactly.

Blocks are indexed once and written.  Queries are read in chunks of bounded size; each chunk
is broadcast to one pass over the blocks and its results are written before the next is read.
A task keeps k results for each query of the chunk, so memory is bounded on every side.

Rows
    null vectors and vectors with null or non-finite components take no part, neither as
    query nor as candidate; so do null ids.  A vector without components scores zero.
    vectors of unequal length are compared as if padded with zeros.
    components beyond ``WIDE`` in size are scored one by one in unbounded integers; a score
    beyond a long is the nearest long.
    repeated ids: every row is a candidate; a query skips rows of its own id; queries with
    one id are one query for each different vector, merged by (score, vec_id).
    ties go to the smaller vec_id.  Fewer rows than k: all.  Empty table: empty result.
    other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialise

#: Queries broadcast at once; vectors and components of a block; the least rows of one.
CHUNK, BLOCK, CELLS, LEAST_BLOCK = 16_384, 8192, 1 << 19, 1024
#: Components up to this are indexed: sums of a block's components stay exact as doubles.
WIDE = 1 << 16
#: Levels of impact as shares of the greatest one, and the share of a block that may remain
#: for exact scoring.
SHARES, REMAIN = np.append(np.linspace(1, 0, 14, endpoint=False)[1:], 0.0), 1 / 16
_LONG = (1 << 63) - 1


def to_integers(v: list[float], scale: float = 256.0) -> list[int] | None:
    """floor(scale * x) of each component; None for a vector that takes no part."""
    if any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(y) if math.isfinite(y := scale * x) else int(x) * int(scale) for x in v]


def exact_scores(rows: list[list[int]], q: list[int]) -> list[int]:
    """Inner products in unbounded integers, cut to the range of a long."""
    return [max(-_LONG - 1, min(_LONG, sum(a * b for a, b in zip(r, q, strict=False)))) for r in rows]


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.lexsort((ids, -scores.astype(object) if scores.dtype == object else -scores))[:k]
    return ids[at], scores[at]


class ImpactIndex:
    """Postings of one block of integer vectors, ordered by quantised value."""

    def __init__(self, ids: np.ndarray, m: np.ndarray):
        self.ids, self.m = ids, m.astype(np.float64)
        n, dims = m.shape
        self.low = self.m.min(axis=0)
        self.width = np.maximum(self.m.max(axis=0) - self.low, 1.0) / 255  # of one quantised value
        value = np.ceil((self.m - self.low) / self.width).clip(0, 255).astype(np.uint8)  # rounded up
        order = np.argsort(value, axis=0, kind="stable")
        self.order = np.ascontiguousarray(order.T)  # dims x n, ascending
        self.counts = np.array([np.bincount(v, minlength=257) for v in value.T]).reshape(dims, 257)  # of the segments
        self.starts = np.cumsum(self.counts, axis=1) - self.counts
        self.scored = self.seen = 0  # figures of the search

    def top(self, q: np.ndarray, k: int, own: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of at least the k best of the block that reach ``floor``."""
        n = len(self.ids)
        used = np.flatnonzero(q)
        left = np.ones(n, bool)
        if n > 4 * k and used.size:
            left, floor = self._possible(q, used, k, own, floor)
        left &= self.ids != own
        at = np.flatnonzero(left)
        self.scored += len(at)
        self.seen += n
        scores = self.m[at] @ q  # exact: integers below 2 ** 53
        reach = scores >= floor
        return best_of(self.ids[at[reach]], scores[reach], k)

    def _possible(self, q: np.ndarray, used: np.ndarray, k: int, own: int, floor: float) -> tuple[np.ndarray, float]:
        """The vectors that may reach the k-th best score, and the best floor known for it."""
        n = len(self.ids)
        unit, up = np.abs(q)[used] * self.width[used], q[used] > 0  # impact of one quantised value
        # value v counts v steps from below, or 256 - v from above (rounded up there too)
        base = float(np.where(up, q[used] * self.low[used], q[used] * (self.low[used] + 255 * self.width[used])).sum())
        most = unit * np.where(up, 255, 256)
        grain = most.max() / 4096  # impacts are integers in this unit, rounded up
        many = 1 << len(used).bit_length()  # a sum holds its number of terms below this
        slack = 1e-9 * (float(np.abs(q) @ (np.abs(self.low) + 256 * self.width)) + 1)
        # the first step of each level by component, and the range of postings it begins at
        at_component = np.arange(len(used)) * n
        cuts = np.ceil(most.max() * SHARES[:, None] / unit).clip(1, 257).astype(int)
        x = np.where(up, self.starts[used, np.minimum(cuts, 256)], self.starts[used, np.maximum(257 - cuts, 0)]) + at_component
        last = np.where(up, n, 0) + at_component
        steps = np.arange(257.0)
        table = np.ceil(np.where(up[:, None], steps, 256 - steps) * (unit / grain)[:, None]) * many + 1
        weight = np.repeat(table.ravel(), self.counts[used].ravel())
        order = self.order[used].ravel() if len(used) < len(q) else self.order.ravel()
        acc = np.zeros(n)
        possible = np.ones(n, bool)
        for level, share in enumerate(SHARES):
            here = x[level]
            a, b = np.where(up, here, last), np.where(up, last, here)
            last = here
            if (parts := [(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True) if i < j]):
                at = np.concatenate([order[i:j] for i, j in parts])
                acc += np.bincount(at, np.concatenate([weight[i:j] for i, j in parts]), n)
            # a component not seen yet adds less than tau, and no more than its own most
            tau = most.max() * share
            whole = np.floor(acc / many)  # the rest is the number of terms
            reach = whole * (grain + tau * many) - tau * acc + (base + np.minimum(tau, most).sum())
            if share <= 0.5:  # enough is known to guess good ones
                best = np.argpartition(reach, n - 2 * k)[n - 2 * k :]
                scores = np.sort((self.m[best] @ q)[self.ids[best] != own])
                floor = max(floor, scores[-k]) if scores.size >= k else floor
            possible = reach >= floor - slack
            if possible.sum() <= REMAIN * n:
                break
        return possible, floor


def _blocks(rows: DataFrame, scale: float) -> DataFrame:
    """One row a block: ids and components of its vectors, packed, and the vectors with a
    component beyond WIDE as JSON.  Filled over batches, so batch sizes make no difference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, list[int]]] = []
        wide: list[tuple[int, list[int]]] = []
        widest = 0

        def told() -> pa.RecordBatch:
            m = np.zeros((len(held), max(widest, 1)), np.int32)
            for i, (_, v) in enumerate(held):
                m[i, : len(v)] = v
            ids = np.array([i for i, _ in held], np.int64)
            cols = [[ids.tobytes()], [m.tobytes()], [m.shape[1]], [json.dumps(wide)]]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.int32(), pa.string()), strict=True)], ["ids", "m", "dims", "wide"])
            held.clear()
            wide.clear()
            return out

        for b in batches:
            for key, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if (x := to_integers(v, scale)) is None:
                    continue
                (wide if any(abs(c) > WIDE for c in x) else held).append((key, x))
                widest = max(widest, len(x))
                if len(held) + len(wide) >= BLOCK or (len(held) + len(wide)) * widest >= CELLS:
                    yield told()
                    widest = 0
        if held or wide:
            yield told()

    return rows.mapInArrow(run, "ids binary, m binary, dims int, wide string")


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """Partitions of about a block at least, and not more than eight blocks."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    most, least = max(1, n // LEAST_BLOCK), -(-n // (8 * BLOCK))
    has = rows.rdd.getNumPartitions()
    if has > most:
        return rows.coalesce(max(least, min(most, max(cores, -(-n // BLOCK)))))
    return rows.repartition(max(least, min(most, cores))) if has < max(least, min(most, cores)) else rows


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each query row."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    told = lambda d: d.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    asked = materialise(told(rows.where(is_query)).distinct(), "queries")
    rows = told(rows)
    blocks = materialise(_blocks(_dealt(rows, rows.count()), scale), "blocks")
    chunks = max(1, -(-asked.count() // CHUNK))
    found = []
    for c in range(chunks):
        mine = asked.where(F.pmod(F.xxhash64("id", F.col("v").cast("string")), F.lit(chunks)) == c) if chunks > 1 else asked
        queries = [(r["id"], x) for r in mine.collect() if (x := to_integers(r["v"], scale)) is not None]  # about CHUNK rows
        best = _scored(blocks, sorted(queries), k)
        found.append(materialise(best, "chunk") if chunks > 1 else best)
    discard(asked)
    out = spark.read.schema("query_id long, vec_id long, score long").parquet(*[d.written_to for d in found]) if chunks > 1 else found[0]
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scored(blocks: DataFrame, queries: list[tuple[int, list[int]]], k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each task for each query."""
    sent = blocks.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        big = [any(abs(c) > WIDE for c in q) for _, q in asked]
        none = np.zeros(0, np.int64), np.zeros(0)
        found = [none] * len(asked)

        def add(i: int, ids: np.ndarray, scores: np.ndarray) -> None:
            had, s = found[i]
            if len(ids):
                mixed = object if scores.dtype == object or s.dtype == object else np.float64
                found[i] = best_of(np.append(had, ids), np.append(s.astype(mixed), scores.astype(mixed)), k)

        for b in batches:
            for raw_ids, raw, dims, wide in zip(*[c.to_pylist() for c in b.columns], strict=True):
                ids = np.frombuffer(raw_ids, np.int64)
                m = np.frombuffer(raw, np.int32).reshape(len(ids), dims)
                index = ImpactIndex(ids, m) if len(ids) else None
                apart = json.loads(wide)
                exact = m.tolist() if any(big) else []
                for i, (own, q) in enumerate(asked):
                    if index is not None and not big[i]:
                        floor = found[i][1][-1] if len(found[i][1]) == k else -np.inf
                        x = np.zeros(dims)
                        x[: len(q)] = q[:dims]
                        add(i, *index.top(x, k, own, floor))
                    elif index is not None:
                        keep = [j for j, key in enumerate(ids.tolist()) if key != own]
                        add(i, ids[keep], np.array(exact_scores([exact[j] for j in keep], q), object))
                    rest = [(key, v) for key, v in apart if key != own]
                    if rest:
                        add(i, np.array([key for key, _ in rest], np.int64), np.array(exact_scores([v for _, v in rest], q), object))
        n = [len(x) for x, _ in found]
        if sum(n):
            cols = np.repeat(np.array([i for i, _ in asked], np.int64), n).tolist(), np.concatenate([x for x, _ in found]).tolist(), [int(s) for _, scores in found for s in scores]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["query_id", "vec_id", "score"])

    return blocks.mapInArrow(run, "query_id long, vec_id long, score long")
