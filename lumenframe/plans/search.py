"""The search plan: a structured query becomes one DataFrame.

Exact predicates are filters and anti joins, similarity is a column, and rankings are
fused by rank.  Python builds plans; the only values read on the driver are counts that
decide on falling back, and the feedback vectors of marked frames.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vector
from ..operators import facets, predicates, ranking
from ..operators.lexical import LEXICAL_DEPTH, merge_lexical, sparse_search
from .plugins import Detector, Embedder, NoTranslator, Translator, phrase_vector
from .query import StructuredQuery, opposites, parse, phrases

#: Results below which the strict pass falls back, the agreement that a
#: translation needs, the weight of on-the-fly attributes, frames refined by detection.
MIN_STRICT, MIN_AGREEMENT, FLY_WEIGHT, REFINED, GROUNDED = 5, 0.70, 1.0, 10, 0.01
BACKGROUND = ("a photo", "an image", "a picture of something", "a random photo", "a photo of an object")


@dataclass
class Response:
    query: str
    parsed: StructuredQuery
    results: DataFrame
    degraded: bool = False
    notices: list[str] = field(default_factory=list)
    total: DataFrame | None = None

    def asset_ids(self) -> DataFrame:
        """Assets in order of their first result."""
        return self.results.groupBy("asset_id").agg(F.min("place").alias("place")).orderBy("place")


@dataclass
class Searcher:
    """``frames`` and ``regions``: point_id, frame_id, asset_id, vector, facet columns;
    frames may have shot_id and ocr_text, regions region_type and bbox."""

    frames: DataFrame
    regions: DataFrame
    embedder: Embedder
    translator: Translator = field(default_factory=NoTranslator)
    vector_col: str = "vector"

    def known_facets(self) -> set[str]:
        """Facet columns by the schema: exact, and free."""
        both = {*self.frames.columns, *self.regions.columns}
        return {c for c in both if c.startswith(("cat_", "attr_")) and not c.endswith(("_score", "_confidence"))}

    def _raw(self, key: str, value: object) -> Column:
        """The contrast of an attribute that has no column."""
        pos = phrase_vector(self.embedder, phrases(key, value))
        neg = phrase_vector(self.embedder, opposites(key) or BACKGROUND)
        v = F.col(self.vector_col)
        return vector.dot(v, vector.literal(pos)) - vector.dot(v, vector.literal(neg))

    def _channels(self, rows: DataFrame, vectors: np.ndarray, depth: int | None) -> DataFrame:
        """(point_id, frame_id, score, channel) of every query vector, one scan each."""
        out = None
        for i, q in enumerate(vectors):
            run = rows.select("point_id", "frame_id", F.round(vector.dot(F.col(self.vector_col), vector.literal(q)), 6).alias("score"), F.lit(i).alias("channel"))
            run = run if depth is None else run.orderBy(F.desc("score"), "point_id").limit(depth)
            out = run if out is None else out.unionByName(run)
        return out

    def banned(self, exclusions: Sequence[dict], known: set[str], within: DataFrame | None = None) -> DataFrame:
        """Frames with a region that fulfils any exclusion in full; of an exclusion with
        unknown facets the quarter of frames that show it most."""
        exact = [c for c in exclusions if c and set(c) <= known]
        out = predicates.matching(self.regions, predicates.any_of(exact), "frame_id") if exact else self.regions.select("frame_id").limit(0)
        for c in exclusions:
            if not c or set(c) <= known:
                continue
            fly = sum((self._raw(k, v) for k, v in c.items() if k not in known), F.lit(0.0))
            rows = self.regions.where(predicates.all_of({k: v for k, v in c.items() if k in known}))
            rows = rows if within is None else rows.join(within.select("frame_id").distinct(), "frame_id", "left_semi")
            best = rows.groupBy("frame_id").agg(F.max(F.round(fly, 6)).alias("s"))
            n = best.agg(F.count("*").alias("n"))
            placed = ranking.rank_in_channel(best.withColumn("channel", F.lit(0)), "frame_id", score="s", pool=False)
            worst = placed.join(F.broadcast(n), how="cross").where(F.col("_rank") < F.greatest(F.lit(1), F.floor(F.col("n") / 4)))  # one row
            out = out.unionByName(worst.select("frame_id"))
        return out.distinct()

    def strict(self, parsed: StructuredQuery, vectors: np.ndarray, canonical: int, extra: Column | None, exclusions: Sequence[dict]) -> tuple[DataFrame, list[str]]:
        """(frame_id, score, entity_confidence) of frames on which every entity has its own
        region; the confidence is that of the least certain entity's nearest region."""
        known = self.known_facets()
        unknown = sorted({k for e in parsed.must for k in e.conditions() if k not in known})
        rows = self.regions if extra is None else self.regions.where(extra)
        hits = None
        for e in parsed.must:
            conditions = e.conditions()
            if not conditions:
                continue
            mine = rows.where(predicates.all_of({k: v for k, v in conditions.items() if k in known}))
            fly = [self._raw(k, v) for k, v in conditions.items() if k not in known]
            runs = self._channels(mine, vectors, None)
            if fly:
                boost = mine.select("point_id", F.round(FLY_WEIGHT * sum(fly, F.lit(0.0)), 6).alias("boost"))
                runs = runs.join(boost, "point_id").withColumn("score", F.col("score") + F.col("boost")).drop("boost")
            fused = ranking.fuse_by_frame(runs, "frame_id", canonical, pool=False).withColumnRenamed("fused", "score")
            near = F.round(vector.dot(F.col(self.vector_col), vector.literal(vectors[canonical])), 6)
            sure = facets.confidence({k: v for k, v in conditions.items() if k in known}, mine.columns)
            shown = mine.select("frame_id", F.struct(near.alias("s"), "point_id", sure.alias("c")).alias("x")).groupBy("frame_id").agg(F.max("x").alias("x"))
            fused = fused.join(shown.select("frame_id", F.col("x.c").alias("entity_confidence")), "frame_id")
            if hits is None:
                hits = fused
                continue
            other = fused.select("frame_id", F.col("score").alias("_s"), F.col("entity_confidence").alias("_c"))
            hits = hits.join(other, "frame_id").select("frame_id", F.least("score", "_s").alias("score"), F.least("entity_confidence", "_c").alias("entity_confidence"))
        no = [e.conditions() for e in parsed.must_not] + list(exclusions)
        if hits is None:
            runs = self._channels(rows, vectors, None)
            hits = ranking.fuse_by_frame(runs, "frame_id", canonical, pool=False).withColumnRenamed("fused", "score").withColumn("entity_confidence", F.lit(None).cast("double"))
        return predicates.without(hits, self.banned(no, known, hits), "frame_id"), unknown

    def dense(self, vectors: np.ndarray, canonical: int, depth: int, scope: str, extra: Column | None) -> DataFrame:
        """(frame_id, score): channels rolled up to frames and fused by rank."""
        cut = lambda d: d if extra is None else d.where(extra)
        out = None
        for i, q in enumerate(vectors):
            one = np.array([q])
            r = self._channels(cut(self.regions), one, ranking.depth(depth, True)) if scope != "frames" else None
            f = self._channels(cut(self.frames), one, ranking.depth(depth, False)) if scope != "regions" else None
            rows = ranking.roll_up(r if r is not None else f.limit(0), f if f is not None else r.limit(0), scope)
            rows = rows.select("frame_id", "score", F.lit(i).alias("channel"))
            out = rows if out is None else out.unionByName(rows)
        return ranking.fuse_by_key(out, "frame_id", canonical, depth)

    def search(self, query: str, limit: int = 24, *, scope: str = "auto", category: str | None = None, where: Column | None = None, parsed: StructuredQuery | None = None,
               positive: Sequence[str] = (), negative: Sequence[str] = (), exclusions: Sequence[dict] = (), lexical: bool = True, min_strict: int = MIN_STRICT, hide_weak: bool = True) -> Response:
        """Ranked frames: frame_id, asset_id, score (canonical inner product), probability,
        place.  The limit is the last step, so a smaller one gives a prefix."""
        if category is not None and where is not None:
            raise ValueError("give either a category or a filter")
        parsed = (parse(query) if parsed is None else parsed).repaired(query)
        notices: list[str] = []
        texts = [query]
        for t in (parsed.query_en, self.translator.translate(query)):
            if t and t.lower() not in [x.lower() for x in texts]:
                texts.append(t)
        vectors = self.embedder.embed_texts(texts)
        canonical = 0 if parsed.language == "en" else min(1, len(texts) - 1)
        if canonical and float(vectors[0] @ vectors[canonical]) < MIN_AGREEMENT:
            notices.append("the translation disagrees with the query and was dropped")
            vectors, canonical, parsed = vectors[:1], 0, replace(parsed, must=(), must_not=(), relations=(), categories=())
        plain = vectors[canonical]
        vectors, missing = self._feedback(vectors, positive, negative)
        if missing:
            notices.append("marked frames that aren't indexed: " + ", ".join(missing))
        if category is not None:
            key = category if category.startswith(("cat_", "attr_")) else f"cat_{category}"
            if key in self.known_facets():
                where = F.col(key)
            else:
                notices.append(f"no facet {key}: not applied")
        depth = max(limit, ranking.MIN_DEPTH)
        hits, degraded, total = None, False, None
        if parsed.must or parsed.must_not or exclusions:
            hits, unknown = self.strict(parsed, vectors, canonical, where, exclusions)
            total = hits.agg(F.count("*").alias("total"))
            # the pool is bounded by the depth: it is read once and stands in the further plan
            pool = hits.orderBy(F.desc("score"), "frame_id").limit(depth)
            held = pool.collect()
            hits = pool.sparkSession.createDataFrame(held, pool.schema)
            if scope != "auto":
                notices.append("a query with objects is answered by regions; the scope was not applied")
            if unknown:
                notices.append("facets that aren't indexed, judged on the fly: " + ", ".join(unknown))
            if len(held) < min(min_strict, depth):
                degraded, hits = True, None
                notices.append("too few exact results: answered by similarity alone")
        if hits is None:
            hits = self.dense(vectors, canonical, depth, scope, where).withColumn("entity_confidence", F.lit(None).cast("double"))
        best = self._canonical(hits, plain)
        out = best.withColumn("probability", F.round(vector.probability(F.col("score"), *self.embedder.calibration), 6))
        out = out.withColumn("position", F.row_number().over(W.orderBy(F.desc("score"), "frame_id")))
        out = out.withColumn("detection_confidence", F.lit(None).cast("double"))
        out = ranking.fuse_evidence(out).drop("position").withColumnRenamed("place", "position")
        if lexical and "ocr_text" in self.frames.columns:
            rows = self.frames if where is None else self.frames.where(where)
            found = sparse_search(rows, "frame_id", "ocr_text", query, LEXICAL_DEPTH)
            found = rows.join(F.broadcast(found), "frame_id").select("frame_id", "ocr_text")
            out = merge_lexical(out, found, "frame_id", query).drop("position").withColumnRenamed("place", "position")
        info = self.frames.select("frame_id", "asset_id", *[c for c in ("shot_id", "path", "ts_ms") if c in self.frames.columns])
        out = info.join(F.broadcast(out), "frame_id")
        if "shot_id" in info.columns:
            out = ranking.collapse_shots(out)
        if hide_weak:
            out = predicates.stand_out(out, "score", "probability")
        out = out.withColumn("place", F.row_number().over(W.orderBy("position"))).where(F.col("place") <= limit).drop("position")
        return Response(query, parsed, out, degraded, notices, total)

    def _canonical(self, hits: DataFrame, q: np.ndarray) -> DataFrame:
        """Each frame's best inner product with the canonical text, one scale for all."""
        few = F.broadcast(hits.select("frame_id", "entity_confidence"))
        v = F.round(vector.dot(F.col(self.vector_col), vector.literal(q)), 6)
        both = self.regions.select("frame_id", self.vector_col).unionByName(self.frames.select("frame_id", self.vector_col))
        return both.join(few, "frame_id").groupBy("frame_id").agg(F.max(v).alias("score"), F.first("entity_confidence").alias("entity_confidence"))

    def _feedback(self, vectors: np.ndarray, positive: Sequence[str], negative: Sequence[str]) -> tuple[np.ndarray, list[str]]:
        """Query vectors moved towards marked frames; marks that aren't indexed."""
        asked = [*positive, *negative]
        if not asked:
            return vectors, []
        rows = self.frames.where(F.col("frame_id").cast("string").isin(*map(str, asked))).select(F.col("frame_id").cast("string").alias("f"), self.vector_col).collect()
        found = {r["f"]: np.array(r[self.vector_col], float) for r in rows}
        mean = lambda ids: np.mean([found[i] for i in map(str, ids) if i in found] or [np.zeros(vectors.shape[1])], axis=0)
        moved = vectors + 0.75 * mean(positive) - 0.25 * mean(negative)
        size = np.linalg.norm(moved, axis=1, keepdims=True)
        return np.where(size > 1e-12, moved / np.maximum(size, 1e-12), vectors), [str(i) for i in asked if str(i) not in found]

    def refine(self, response: Response, detector: Detector, top: int = REFINED) -> Iterator[DataFrame]:
        """Partial results: after each of the first ``top`` frames, all rows with what the
        detector says so far.  The order never changes."""
        spark = self.frames.sparkSession
        terms = [e.describe() for e in response.parsed.must] or [response.query]
        shown = [r["frame_id"] for r in response.results.where(F.col("place") <= top).orderBy("place").select("frame_id").collect()]
        told: list[tuple] = []
        kind = dict(response.results.dtypes)["frame_id"]
        for f in shown:
            boxes = [detector.detect(f, t) for t in terms]
            scores = [b[1] for b in boxes if b is not None]
            told.append((f, min(scores) if scores else None, [t for t, b in zip(terms, boxes, strict=True) if b is None or b[1] < GROUNDED]))
            found = spark.createDataFrame(told, f"frame_id {kind}, detected double, not_grounded array<string>")
            yield response.results.drop("detection_confidence").join(F.broadcast(found), "frame_id", "left").withColumnRenamed("detected", "detection_confidence")


def search(searcher: Searcher, query: str, limit: int = 24, **how) -> Response:
    """One-call façade."""
    return searcher.search(query, limit, **how)
