"""Toxicity by a learned lexicon, Levenshtein automata over its trie and context windows.

The lexicon (whole words and word beginnings) is learned from labelled rows outside the
held-out fold: terms that mark toxic documents far beyond chance, as many as there are.
Whole words that a beginning covers stay beside it as further forms, so that they are found
misspelled too.  A word of a text is
looked up by running its Levenshtein automaton against the lexicon's trie, which finds
misspelled terms too.  Each hit is weighed by a window about it: inside quotation marks
or near a reporting word it counts as a mention, not as abuse.  A logistic model over
the weighed hits and over the numbers of mentioned and of misspelled ones, fitted on the
same rows, gives the score; so what a window is worth is learned too.

Rows
    null or empty text: no hits; the score of a text without hits.
    very long texts: read whole.  Ties between words of one distance: the stronger term.
    null ids are never held out; repeated rows: each is scored; equal labelled texts count once.
    without labels of both kinds the lexicon is empty and every score is the toxic share
    (zero without labels).  Empty table: empty result.
    other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bayes import fit_evidence
from .common import bounded_sample, bounded_texts, discard, held_out, in_arrow, materialise

#: Labelled documents read by the fit.
MOST_LABELLED = 12_000
#: Evidence (G squared) that a term needs.
LEAST_RATIO = 14.0
#: Word hashes kept of a text to tell near copies.
SIGNATURE = 16
SHORTEST, LONGEST_STEM = 4, 8
#: Words whose look-up a worker keeps.
MOST_CACHED = 150_000
#: What a hit counts as: misspelled; mentioned (quoted or reported).
MISSPELLED, MENTIONED = 0.6, 0.35
#: Characters about a hit that its window holds.
WINDOW = 60
#: Words of reporting or quoting in the corpus's languages.
REPORTING = frozenset("said says wrote writes called calls quoted quote term word insult dit disait écrit mot sagte sagt schrieb wort dijo dice escribió palabra".split())
_QUOTES = "\"“”„«»‘"
_WORD = re.compile(r"\w+")


class Trie:
    """Forms (text, it is a word beginning, its term) as nested nodes; a stem's node accepts
    every continuation."""

    def __init__(self, forms: Iterable[tuple[str, bool, int]] = ()):
        self.root: dict = {}
        for form, stem, term in forms:
            node = self.root
            for c in form:
                node = node.setdefault(c, {})
            node.setdefault(None, []).append((term, len(form), stem))


def allowed(length: int, stem: bool) -> int:
    """Edits allowed for a term of that length."""
    if stem:
        return 1 if length >= 7 else 0
    return 0 if length < 5 else 1 if length < 10 else 2


class LevenshteinAutomaton:
    """Accepts what is within ``edits`` of ``word``.  A state is one row of distances,
    cut off above ``edits``; ``step`` reads one character."""

    def __init__(self, word: str, edits: int):
        self.word, self.edits = word, edits

    def start(self) -> tuple[int, ...]:
        return tuple(min(i, self.edits + 1) for i in range(len(self.word) + 1))

    def step(self, state: tuple[int, ...], c: str) -> tuple[int, ...]:
        over = self.edits + 1
        row = [min(state[0] + 1, over)]
        for i, w in enumerate(self.word):
            row.append(min(row[i] + 1, state[i + 1] + 1, state[i] + (w != c), over))
        return tuple(row)

    def alive(self, state: tuple[int, ...]) -> bool:
        return min(state) <= self.edits


def intersect(word: str, trie: Trie, edits: int = 2) -> tuple[int, int] | None:
    """(distance, term) of the nearest term that the word spells within the term's
    allowance; the first term among equals.  A stem is compared with every beginning."""
    auto, best = LevenshteinAutomaton(word, edits), None
    todo = [(trie.root, auto.start())]
    while todo:
        node, state = todo.pop()
        for i, length, stem in node.get(None, ()):
            d = min(state) if stem else state[-1]
            if d <= allowed(length, stem) and (best is None or (d, i) < best):
                best = (d, i)
        for c, below in node.items():
            if c is not None and auto.alive(after := auto.step(state, c)):
                todo.append((below, after))
    return best


@dataclass
class ToxicityModel:
    terms: list[tuple[str, bool]]  # (term, it is a word beginning)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))  # by term, four sums, bias
    bias_only: float = -9.0
    further: list[tuple[str, int]] = field(default_factory=list)  # (whole word, its term)
    _cache: dict = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        self._prepare()

    def _prepare(self) -> None:
        forms = [(t, stem, i) for i, (t, stem) in enumerate(self.terms)] + [(w, False, i) for w, i in self.further]
        self.trie = Trie(forms)
        self.exact = {t: i for t, stem, i in reversed(forms) if not stem}
        self.stems = {t: i for t, stem, i in reversed(forms) if stem}
        self.stem_sizes = sorted({len(t) for t in self.stems}, reverse=True)
        # a word within d edits of a term holds one of d + 1 parts of the term, moved by d at most
        self.parts: dict[tuple[int, str], list[tuple[int, int]]] = {}
        for t, stem, _ in forms:
            if d := allowed(len(t), stem):
                cuts = [len(t) * k // (d + 1) for k in range(d + 2)]
                sizes = (len(t) - d, len(t) + d if not stem else 1 << 30)
                for x, y in zip(cuts, cuts[1:], strict=False):
                    for at in range(max(0, x - d), x + d + 1):
                        held = self.parts.setdefault((at, t[x:y]), [])
                        if sizes not in held:
                            held.append(sizes)
        self.places = sorted({(at, at + len(p)) for at, p in self.parts})
        self.shortest = min((a for held in self.parts.values() for a, _ in held), default=1 << 30)
        self.longest = max((b for held in self.parts.values() for _, b in held), default=0)

    def lookup(self, word: str) -> tuple[int, int] | None:
        """(distance, term) of a lower-case word."""
        if word in self.exact:
            return 0, self.exact[word]
        for n in self.stem_sizes:
            if (i := self.stems.get(word[:n])) is not None:
                return 0, i
        n = len(word)
        if self.shortest <= n <= self.longest:
            parts = self.parts
            for x, y in self.places:
                held = parts.get((x, word[x:y]))
                if held is not None and any(a <= n <= b for a, b in held):
                    return intersect(word, self.trie)
        return None

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, float]]]:
        """(words, [(term, what the hit counts as)]) of a whole text."""
        if not text:
            return 0, []
        low = text.lower()
        words = _WORD.findall(low)
        cache, found = self._cache, {}
        for w in set(words):
            try:
                hit = cache[w]
            except KeyError:
                if len(cache) >= MOST_CACHED:
                    cache.clear()
                hit = cache[w] = self.lookup(w)
            if hit is not None:
                found[w] = hit
        if not found:
            return len(words), []
        out = []
        quotes = [i for i, c in enumerate(low) if c in _QUOTES] if any(q in low for q in _QUOTES) else []
        for m in _WORD.finditer(low):
            hit = found.get(m.group())
            if hit is not None:
                value = MISSPELLED if hit[0] else 1.0
                out.append((hit[1], value * (MENTIONED if _mentioned(low, m.start(), m.end(), quotes) else 1.0)))
        return len(words), out

    def features(self, text: str | None) -> dict[int, float]:
        """The features that aren't zero, by place: terms, then four sums."""
        return self._features(*self.hits(text))

    def _features(self, n: int, hits: list[tuple[int, float]]) -> dict[int, float]:
        if not hits:
            return {}
        sums: dict[int, float] = {}
        for i, v in hits:
            sums[i] = sums.get(i, 0.0) + v
        x = {i: math.log1p(v) for i, v in sums.items()}
        total, at = sum(v for _, v in hits), len(self.terms)
        x |= {at: math.log1p(total), at + 1: math.log1p(100 * total / max(n, 20))}
        x[at + 2] = math.log1p(sum(v in (MENTIONED, MENTIONED * MISSPELLED) for _, v in hits))
        x[at + 3] = math.log1p(sum(v in (MISSPELLED, MENTIONED * MISSPELLED) for _, v in hits))
        return x

    def judge(self, text: str | None) -> tuple[float, int]:
        """(score, hits) of a whole text."""
        n, hits = self.hits(text)
        if not len(self.weights):
            z = self.bias_only
        elif not hits:
            z = float(self.weights[-1])
        else:
            z = float(sum(v * self.weights[i] for i, v in self._features(n, hits).items()) + self.weights[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), len(hits)

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "weights": self.weights, "bias_only": self.bias_only, "further": self.further}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, _cache={})
        self._prepare()


def _mentioned(low: str, start: int, end: int, quotes: list[int]) -> bool:
    """Whether the window shows a quotation: marks on both sides of the hit within the
    window on one line, or a reporting word before it."""
    a, b = max(0, start - WINDOW), end + WINDOW
    if quotes:
        before = [i for i in quotes if a <= i < start]
        after = [i for i in quotes if end <= i < b]
        if before and after and len(before) % 2 == 1 and "\n" not in low[before[-1] : after[0]]:
            return True
    return not REPORTING.isdisjoint(_WORD.findall(low[a:start])[-4:])


def _keys(text: str) -> set[str]:
    """Candidate terms of a text: words, and word beginnings marked by a star."""
    out: set[str] = set()
    for w in set(_WORD.findall(text.lower())):
        if len(w) >= SHORTEST and not w.isdigit():
            out.add(w)
            out.update(w[:n] + "*" for n in range(SHORTEST, min(len(w) - 1, LONGEST_STEM) + 1))
    return out


def likelihood_ratio(a: float, c: float, n_toxic: float, n_clean: float) -> float:
    """G squared of a term in ``a`` toxic and ``c`` clean documents; zero unless it is much
    more frequent in toxic ones."""
    if not a or (a + 0.5) / (n_toxic + 1) < 2.5 * (c + 0.5) / (n_clean + 1):
        return 0.0
    p = (a + c) / (n_toxic + n_clean)
    return 2 * (a * math.log(max(a, 1e-9) / (n_toxic * p)) + (c * math.log(c / (n_clean * p)) if c else 0.0))


def least_documents(n_toxic: int) -> float:
    """Toxic documents that a term must stand in to be a candidate."""
    return max(4, 0.004 * n_toxic)


def candidate_terms(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int) -> list[str]:
    """Keys that mark toxic documents beyond chance, the strongest first."""
    scored = [(g, k) for k, a in toxic.items() if a >= least_documents(n_toxic) and (g := likelihood_ratio(a, clean[k], n_toxic, n_clean)) > LEAST_RATIO]
    scored.sort(key=lambda x: (-round(x[0], 6), x[1].endswith("*"), -len(x[1]), x[1]))
    return [k for _, k in scored]


def _signature(text: str) -> list[int]:
    """Least hashes of a text's words under SIGNATURE multipliers; near copies share most."""
    words = set(_WORD.findall(text.lower())) or {""}
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    with np.errstate(over="ignore"):
        return [int((h * np.uint64(2 * i + 1) + np.uint64(i * 0x9E3779B9)).min() >> np.uint64(1)) for i in range(SIGNATURE)]


def distinct_contents(signatures: list[list[int]], share: float = 0.5) -> list[int]:
    """Places of the first of each group of near copies (``share`` of the signature equal
    to a group's first).  The texts are the bounded sample's toxic ones."""
    out: list[int] = []
    kept = np.zeros((len(signatures), SIGNATURE), np.int64)
    for i, s in enumerate(np.array(signatures, np.int64).reshape(-1, SIGNATURE)):
        if not out or ((kept[: len(out)] == s).mean(axis=1) < share).all():
            kept[len(out)] = s
            out.append(i)
    return out


def choose_terms(keys: list[str], held: list[list[int]], clean: Counter, n_clean: int) -> tuple[list[tuple[str, bool]], list[tuple[str, int]]]:
    """The terms of the lexicon, and whole words that its beginnings cover, each with its
    term.  ``held``: candidate keys of each toxic document, near copies left out.

    First a greedy cover: the key that says most about documents not yet covered twice,
    again and again; then every other key whose evidence is beyond what the best of so
    many keys would show by chance.  Of nested keys one stays.  Evidence alone ends both.
    """
    n_toxic = len(held)
    of: dict[int, list[int]] = {}
    for d, ks in enumerate(held):
        for k in ks:
            of.setdefault(k, []).append(d)
    need = [2] * n_toxic
    open_ = {k: len(v) for k, v in of.items()}
    ratio = {k: likelihood_ratio(len(v), clean[keys[k]], n_toxic, n_clean) for k, v in of.items()}
    gain = dict(ratio)
    least = least_documents(n_toxic)
    out: list[str] = []
    further: list[tuple[str, int]] = []

    def take(best: int) -> None:
        out.append(keys[best])
        for d in of[best]:
            if need[d]:
                need[d] -= 1
                if not need[d]:
                    for k in held[d]:
                        if k in open_:
                            open_[k] -= 1
                            gain[k] = likelihood_ratio(open_[k], clean[keys[k]], n_toxic, n_clean)
        del open_[best], gain[best]
        bare, stem = keys[best].rstrip("*"), keys[best].endswith("*")
        for k in list(open_):
            other = keys[k].rstrip("*")
            covers = stem and other.startswith(bare)
            if covers and not keys[k].endswith("*") and allowed(len(other), False):
                further.append((other, len(out) - 1))
            if covers or bare.startswith(other) and len(of[k]) < 1.25 * len(of[best]):
                del open_[k], gain[k]

    while open_:
        best = min((k for k in gain if open_[k] >= least), key=lambda k: (-round(gain[k], 6), k), default=None)
        if best is None or gain[best] < LEAST_RATIO:
            break
        take(best)
    bar = LEAST_RATIO + 2 * math.log(max(1, len(keys)))
    for k in sorted((k for k in open_ if len(of[k]) >= least and ratio[k] >= bar), key=lambda k: (-round(ratio[k], 6), k)):
        if k in open_:
            take(k)
    return [(k.rstrip("*"), k.endswith("*")) for k in out], further


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", most: int = MOST_LABELLED) -> ToxicityModel:
    """Lexicon and weights from ``most`` labelled rows at about, none of them held out."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = bounded_sample(known.select(F.col("doc_id").cast("long").alias("id"), (F.col(label) == 1).alias("bad")), most)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(known), "id").select("bad", F.coalesce("text", F.lit("")).alias("text"))  # bounded by ``most``
    rows = materialise(rows, "labelled_texts")
    once = materialise(bounded_texts(rows, most), "distinct_texts")  # copies of one text say no more than the text
    discard(rows)
    sizes = dict(map(tuple, once.groupBy("bad").count().collect()))
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        discard(once)
        return ToxicityModel([], bias_only=-30.0 if not n_toxic else 30.0)

    def counted(bad: bool, among: frozenset | None, least: float) -> Counter:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: Counter = Counter()

            def told() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["key", "n"])

            for b in batches:
                for t in b.column(1):
                    found.update(_keys(t.as_py()) if among is None else among & _keys(t.as_py()))
                    if len(found) > 100_000:
                        yield told()
                        found.clear()
            yield told()

        sums = in_arrow(once.where(F.col("bad") == bad), run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
        return Counter({r["key"]: r["n"] for r in sums.where(F.col("n") >= least).collect()})

    toxic = counted(True, None, least_documents(n_toxic))
    clean = counted(False, frozenset(toxic), 1)
    keys = candidate_terms(toxic, clean, n_toxic, n_clean)
    place = {k: i for i, k in enumerate(keys)}

    def incidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() for t in b.column(1)]
            held = [sorted(place[k] for k in _keys(t) if k in place) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.int32())), pa.array([_signature(t) for t in texts], pa.list_(pa.int64()))], ["held", "signature"])

    told = in_arrow(once.where("bad"), incidence, "held array<int>, signature array<long>").collect()
    told.sort(key=lambda r: (r["signature"], r["held"]))  # rows arrive in no fixed order
    held = [list(told[i]["held"]) for i in distinct_contents([list(r["signature"]) for r in told])]
    terms, further = choose_terms(keys, held, clean, n_clean)
    model = ToxicityModel(terms, further=further)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [model.features(t) for t in b.column(1).to_pylist()]
            cols = [pa.array([sorted(v) for v in x], pa.list_(pa.int32())), pa.array([[v[i] for i in sorted(v)] for v in x], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["bad", "at", "x"])

    found = sorted(map(tuple, in_arrow(once, featured, "bad boolean, at array<int>, x array<double>").collect()))  # rows arrive in no fixed order
    discard(once)
    x = np.zeros((len(found), len(terms) + 4))
    for r, (_, at, v) in enumerate(found):
        x[r, at] = v
    w, centre, scale = fit_evidence(x, np.array([bad for bad, _, _ in found], float), ridge=2.0)
    plain = w[:-1] / scale
    model.weights = np.append(plain, w[-1] - float(plain @ centre))
    return model


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted, hits) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [model.judge(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in out], pa.float64()), pa.array([n for _, n in out], pa.int64())], ["id", "score", "hits"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = in_arrow(rows, run, "id long, score double, hits long")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "hits")


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows whose text is not predicted to be toxic, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [model.judge(t.as_py())[0] < threshold for t in b.column(at)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return in_arrow(docs, run, docs.schema)
