"""Language identification by word-first backoff.

A known word is scored by its log frequency in each language.  An unseen word is scored
by the character n-grams (word borders marked) of the greatest length of which the model
knows at least one, from ``LONGEST`` down to single characters.  A text's language has the
highest sum over all its words plus the log share of the language.

The model is fitted on a bounded sample of labelled rows outside the held-out fold.  Words
that make up less than ``RAREST`` of a language's words there are left to the n-grams (what
is lost is at most their own log frequency); so a language has at most 1 / RAREST words.

Rows
    null text or a text without a letter: ``und``, score zero.
    null languages are no training rows; null ids are never held out.
    without any labelled row every prediction is ``und``.
    letters are characters of the Unicode letter classes; digits, ½, ² and ① are none.
    repeated rows: each is predicted; equal labelled rows count once.  Ties go to the language first by name.
    empty table: empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_texts, discard, held_out, in_arrow, materialise

#: Documents in the sample, and the least share of a language's words that a known word has.
MOST_DOCUMENTS, RAREST = 16_000, 2e-6
LONGEST = 4
#: Words whose scores a worker keeps.
MOST_CACHED = 150_000
_RUN = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def letter_runs(run: str) -> list[str]:
    """Words of a run of ``_RUN``, which may hold number signs that are no letters."""
    return [run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split()


@dataclass
class LanguageModel:
    languages: list[str]
    prior: np.ndarray
    words: dict[str, np.ndarray]
    grams: list[dict[str, np.ndarray]]  # by length less one
    _row: dict[str, int] = field(default_factory=dict, repr=False)
    _table: np.ndarray | None = field(default=None, repr=False)

    def word_score(self, word: str) -> np.ndarray:
        """Log score of one lower-case word in each language."""
        known = self.words.get(word)
        if known is not None:
            return known
        marked = f" {word} "
        for n in range(LONGEST, 0, -1):
            grams = self.grams[n - 1]
            found = [v for i in range(len(marked) - n + 1) if (v := grams.get(marked[i : i + n])) is not None]
            if found:
                return sum(found) / len(found)
        return np.zeros(len(self.languages), np.float32)

    def _row_of(self, word: str) -> int:
        at = self._row.get(word)
        if at is None:
            at = self._row[word] = len(self._row)
            if at >= len(self._table):
                self._table = np.vstack([self._table, np.zeros_like(self._table)])
            self._table[at] = sum(map(self.word_score, letter_runs(word)), np.zeros(len(self.languages), np.float32))
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        words = _RUN.findall((text or "").lower())
        if not self.languages or not any(map(letter_runs, words)):
            return UNKNOWN, 0.0
        if self._table is None or len(self._row) > MOST_CACHED:
            self._row, self._table = {}, np.zeros((4096, len(self.languages)), np.float32)
        row = self._row
        total = self.prior.astype(np.float64)
        for i in range(0, len(words), 65536):
            part = words[i : i + 65536]
            try:
                at = [row[w] for w in part]
            except KeyError:
                at = [row[w] if w in row else self._row_of(w) for w in part]
            total = total + self._table[np.array(at)].sum(axis=0, dtype=np.float64)
        best = int(total.argmax())
        # the posterior, tempered so that long texts don't all say exactly one
        p = np.exp((total - total[best]) / max(1.0, len(words) / 8))
        return self.languages[best], float(1 / p.sum())


def build_model(shares: dict[str, int], counts: dict[str, dict[str, int]]) -> LanguageModel:
    """A model from documents by language and word counts by language."""
    languages = sorted(shares)
    k = len(languages)
    prior = np.log(np.array([shares[x] for x in languages], float) / max(1, sum(shares.values())))
    tables: list[dict[str, list[int]]] = [{} for _ in range(LONGEST + 1)]  # words, then n-grams by length

    def add(table: dict[str, list[int]], key: str, j: int, n: int) -> None:
        row = table.get(key)
        if row is None:
            row = table[key] = [0] * k
        row[j] += n

    for j, x in enumerate(languages):
        for w, n in counts.get(x, {}).items():
            add(tables[0], w, j, n)
            marked = f" {w} "
            for m in range(1, LONGEST + 1):
                for i in range(len(marked) - m + 1):
                    add(tables[m], marked[i : i + m], j, n)

    def logs(table: dict[str, list[int]]) -> dict[str, np.ndarray]:
        held = np.array(list(table.values()), float).reshape(len(table), k)
        scores = np.log((held + 0.5) / (held.sum(axis=0) + 0.5 * len(table) + 1)).astype(np.float32)
        return dict(zip(table, scores, strict=True))

    words, *grams = map(logs, tables)
    return LanguageModel(languages, prior, words, grams)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MOST_DOCUMENTS) -> LanguageModel:
    """Counts words of ``most`` labelled documents at about, outside the held-out fold."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    rows = bounded_texts(known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")), most)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = defaultdict(Counter)
        held: Counter = Counter()
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held[lang] += 1
                found[lang].update(_RUN.findall(text.lower()))
            if sum(map(len, found.values())) > 300_000:
                yield from told(found, held)
                found.clear()
                held.clear()
        yield from told(found, held)

    def told(found: dict, held: Counter) -> Iterator[pa.RecordBatch]:
        told = [(x, w, n) for x, c in found.items() for r, n in c.items() for w in letter_runs(r)] + [(x, None, n) for x, n in held.items()]
        if told:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*told, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "word", "n"])

    counts = in_arrow(rows.select("lang", "text"), count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "word_counts")  # null word: documents of the language
    sizes = counts.groupBy("lang").agg(F.sum(F.when(F.col("word").isNotNull(), F.col("n"))).alias("all"))
    kept = counts.join(sizes, "lang").where(F.col("word").isNull() | (F.col("n") >= F.lit(RAREST) * F.col("all"))).select("lang", "word", "n").toPandas()
    discard(counts)
    shares: dict[str, int] = {}
    found: dict[str, dict[str, int]] = defaultdict(dict)
    for x, w, n in zip(kept["lang"], kept["word"], kept["n"], strict=True):
        if w is None:
            shares[x] = int(n)
        else:
            found[x][w] = int(n)
    return build_model(shares, found)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by RAREST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            out = [m.predict(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = in_arrow(rows, run, "id long, lang_pred string, score double")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "lang_pred", "score")
