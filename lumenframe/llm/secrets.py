"""Secret scans: pattern candidates, judged by a random forest.

Candidates are assignments to a secret-like name (any of ``SECRET_NAMES``; quoted values up to
their closing quote), what follows such a name by a space unless it is a plain word, the
password of an address (``scheme://user:password@host``), web tokens of three dotted parts,
long runs of letters and digits with a digit, and private key blocks.  A random forest
removes false positives; its features are the candidate's length and alphabet, its character
transitions, how much of it a dictionary covers, the path of the document, and the words
about it.

The dictionary and the transitions are learned from the whole corpus (``learn_language``):
words that stand in one document of ``RARE_WORD`` or more often, and how often one
character follows another in the corpus's words.  A transition score is the mean log
probability of the value's neighbouring characters, which random keys have low.

The forest is trained from labelled findings (value, before, after, path, label), a list or a
table.  The corpus holds no such labels, so the default is a documented generator of
findings: keys of the usual kinds (label 1), and identifiers, checksums, UUIDs, numbers,
placeholders, paths and joined words in their usual surroundings (label 0).

Rows
    null or empty text: no candidate.  Whole texts and whole values, however long, are
    scanned; spans count code points.  Ties: candidates that overlap are one.
    null paths and ids, repeated rows: each row is scanned.  Empty table: empty result.
    other columns are ignored by ``scan`` and kept by ``redact``, whatever their names.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import astuple, dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, discard, in_arrow, materialise

#: Names that announce a secret, and words about other long strings.
SECRET_NAMES = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "auth", "bearer", "credential", "private_key", "client_secret")
OTHER_NAMES = ("sha", "md5", "hash", "checksum", "digest", "etag", "commit", "revision", "uuid", "guid", "id", "file", "image", "version", "build", "order", "number", "phone", "card", "page", "ref")
TEST_PATHS = ("test", "example", "fixture", "sample", "doc", "mock", "demo")
DICTIONARY = tuple(
    "the and for with this that from have your here not are was key token secret password example test sample user name file data value config "
    "default change replace insert admin root local host server client access account service public private string number index image page path "
    "version build release super long super item list table order date time code text word line main base core type class func method object "
    "module package import export return false true null none todo fixme dummy fake placeholder redacted hidden".split()
)
_RUN = re.compile(r"(?<![A-Za-z0-9_+/\-])[A-Za-z0-9_+/\-]{16,}+={0,2}")
_NAME = "|".join(dict.fromkeys(re.sub("[_-]", "[_-]?", n) for n in sorted(SECRET_NAMES, key=len, reverse=True))) + "|credentials"
#: A name and its value: up to the closing quote, or else up to a space or separator.  The
#: value stands in a look-ahead, since it can be the name of the next one.
_NAMED = re.compile(rf"(?i)(?:{_NAME})(?=[\"']?[ \t]*[:=][ \t]*(?:\"((?:\\.|[^\"\\\n]){{6,}})\"|'((?:\\.|[^'\\\n]){{6,}})'|[\"']?([^\s\"',;<>]{{6,}})))")
#: A name and its value by a space, as in ``Bearer ...``; plain words aren't values.
_SPACED = re.compile(rf"(?i)(?:{_NAME})(?=[ \t]+([^\s\"',;<>]{{6,}}))")
_PLAIN = re.compile(r"[^\W\d_]?[^\W\d_A-Z]*(?:[-./:()][^\W\d_]?[^\W\d_A-Z]*)*[!?]*")
_HINTS = tuple(dict.fromkeys(re.split("[_-]", n)[-1] for n in SECRET_NAMES))
#: A word of the corpus stands in one document of so many at least; so there are at most so
#: many words as RARE_WORD times a document's mean number of different words.
RARE_WORD = 2000
SHORTEST_WORD, LONGEST_WORD = 4, 20
#: How public kinds of tokens begin.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "sk-", "AIza", "eyJ", "-----BEGIN")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_\-.])eyJ[A-Za-z0-9_\-]{6,}\.[A-Za-z0-9_\-]{6,}(?:\.[A-Za-z0-9_\-]*)?")
_ADDRESS = re.compile(r"://[^\s:/@\"']+:([^\s/@\"']{4,})@")
_BLOCK = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----")
#: Characters of text on each side that the features read.
NEAR = 40


@dataclass(frozen=True)
class Finding:
    value: str
    before: str = ""
    after: str = ""
    path: str = ""
    label: int = 0


def candidates(text: str | None) -> list[tuple[int, int]]:
    """Spans that could hold a secret, in order, none inside another."""
    if not text:
        return []
    spans = [m.span() for m in _BLOCK.finditer(text)] if "-----BEGIN" in text else []
    low = text.lower()
    if any(h in low for h in _HINTS):
        spans += [m.span(m.lastindex) for m in _NAMED.finditer(text)]
        spans += [m.span(1) for m in _SPACED.finditer(text) if not _PLAIN.fullmatch(m.group(1))]
    if "eyJ" in text:
        spans += [m.span() for m in _TOKEN.finditer(text)]
    if "://" in text and "@" in text:
        spans += [m.span(1) for m in _ADDRESS.finditer(text)]
    for m in _RUN.finditer(text):
        s = m.group()
        if s.startswith(PREFIXES) or any(c.isdigit() for c in s):
            spans.append(m.span())
    spans.sort(key=lambda s: (s[0], -s[1]))
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@dataclass(frozen=True)
class Language:
    """What the corpus's words look like: the words, and log probabilities of a character
    (rows: the one before; letters a to z, digits, anything else) by the one before it."""

    words: frozenset[str]
    transitions: np.ndarray

    def covered(self, value: str) -> float:
        """Share of the value's characters inside dictionary words."""
        low, held = value.lower(), self.words
        inside = np.zeros(len(low), bool)
        for m in re.finditer(r"[^\W\d_]{%d,}" % SHORTEST_WORD, low):
            run, at = m.group(), m.start()
            i = 0
            while i <= len(run) - SHORTEST_WORD:
                for n in range(min(LONGEST_WORD, len(run) - i), SHORTEST_WORD - 1, -1):
                    if run[i : i + n] in held:
                        inside[at + i : at + i + n] = True
                        break
                i += 1
        return float(inside.mean()) if len(low) else 0.0

    def likelihood(self, value: str) -> float:
        """Mean log probability of the value's characters after their predecessors."""
        codes = _codes(value)
        return float(self.transitions[codes[:-1], codes[1:]].mean()) if len(codes) > 1 else float(self.transitions.mean())


_CODE = np.full(256, 36, np.uint8)
_CODE[97:123] = np.arange(26)
_CODE[65:91] = np.arange(26)
_CODE[48:58] = np.arange(26, 36)


def _codes(value: str) -> np.ndarray:
    """0 to 25: letters in either case; 26 to 35: digits; 36: anything else (by UTF-8 byte)."""
    return _CODE[np.frombuffer(value.encode("utf-8", "surrogatepass"), np.uint8)]


def language_of(words: dict[str, int], pairs: np.ndarray) -> Language:
    """From words and counts of pairs of codes; without any words, the fixed dictionary."""
    if not words:
        words = dict.fromkeys(DICTIONARY, 1)
        pairs = _pair_counts(" ".join(DICTIONARY))
    held = pairs.reshape(37, 37) + 0.5
    return Language(frozenset(words) | {w for w in DICTIONARY if len(w) >= SHORTEST_WORD}, np.log(held / held.sum(axis=1, keepdims=True)))


def _pair_counts(text: str) -> np.ndarray:
    codes = _codes(text).astype(np.int64)
    return np.bincount(codes[:-1] * 37 + codes[1:], minlength=37 * 37).astype(np.float64) if len(codes) > 1 else np.zeros(37 * 37)


_PLAIN_WORD = re.compile(r"[^\W\d_]{%d,%d}" % (SHORTEST_WORD, LONGEST_WORD))


def learn_language(docs: DataFrame, text_col: str = "text", rare: int = RARE_WORD) -> Language:
    """Dictionary and transitions of the whole corpus, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        pairs, n = np.zeros(37 * 37), 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["key", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    n += 1
                    found.update(set(_PLAIN_WORD.findall(t.lower())))
                    pairs += _pair_counts(t)
            if len(found) > 200_000:
                yield told()
                found.clear()
        found.update({f" {i}": int(c) for i, c in enumerate(pairs) if c} | {" n": n})
        yield told()

    counts = in_arrow(docs.select(F.col(text_col).cast("string").alias("text")), run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "words")
    n = counts.where("key = ' n'").agg(F.sum("n")).first()[0] or 0
    kept = {r["key"]: r["n"] for r in counts.where((F.col("n") >= max(2, n // rare)) | F.col("key").startswith(" ")).collect()}
    discard(counts)
    pairs = np.zeros(37 * 37)
    for k in [k for k in kept if k.startswith(" ")]:
        c = kept.pop(k)
        if k != " n":
            pairs[int(k)] = c
    return language_of(kept, pairs)


def _kinds(value: str) -> np.ndarray:
    return np.array([0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in value], np.int8)


def features(value: str, before: str, after: str, path: str | None, language: Language) -> list[float]:
    n = max(1, len(value))
    kinds = _kinds(value)
    shares = (np.bincount(kinds, minlength=4) / n).tolist()
    counts = Counter(value)
    spread = np.array(list(counts.values()), float) / n
    entropy = float(-(spread * np.log2(spread)).sum()) if value else 0.0
    points = np.array([ord(c) for c in value])
    letters = sum(c.isalpha() for c in value)
    vowels = sum(counts[c] for c in "aeiouAEIOU") / max(1, letters)
    b, p = before[-NEAR:].lower(), (path or "").lower()
    last = b[-24:]
    return [
        float(np.log2(1 + len(value))), *shares, float((kinds[1:] != kinds[:-1]).mean()) if n > 1 else 0.0, entropy, entropy / max(1.0, float(np.log2(max(2, n)))),
        float((points[1:] == points[:-1]).mean()) if n > 1 else 0.0, vowels, language.covered(value), language.likelihood(value),
        float(value.startswith("-----BEGIN")), float(value.startswith(PREFIXES)), float(not value.strip("0123456789abcdefABCDEF")),
        float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value))),
        float(any(w in last for w in SECRET_NAMES)), float(any(re.search(rf"\b{w}\W{{0,3}}\w{{0,4}}\W*$", last) for w in OTHER_NAMES)),
        float(bool(re.search(r"[:=]\s*[\"']?$", b))), float(before.endswith(("/", ".", "#"))), float(after[:1] in ("/", ".", "@")), float(bool(re.search(r"://[^\s/@]+:$", b)) and after[:1] == "@"),
        value.count("/") / n, (value.count("-") + value.count("_")) / n, float(any(w in p for w in TEST_PATHS)),
    ]


HEX, UPPER, LOWER, DIGITS = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def labelled_findings(n: int = 5000, seed: int = 7, words: Sequence[str] = DICTIONARY) -> list[Finding]:
    """The default labelled findings: half secrets, half false positives."""
    r = random.Random(seed)
    base, alnum = UPPER + LOWER + DIGITS + "+/", UPPER + LOWER + DIGITS
    draw = lambda a, k: "".join(r.choice(a) for _ in range(k))
    word = lambda: r.choice(words) if r.random() < 0.9 else draw("bcdfghlmnprst", 1) + draw("aeiou", 1) + draw("bcdfghlmnprst", 1) + draw("aeiou", 1)
    prose = lambda k: " ".join(word() for _ in range(k))
    line = lambda: draw(base, 64)
    named = (  # keys that only their name tells
        lambda: draw(HEX, r.choice([32, 40, 48, 64])), lambda: draw(HEX, r.choice([32, 40, 48, 64])).upper(), lambda: draw(base, r.choice([24, 32, 40, 44, 64])) + r.choice(["", "=", "=="]),
        lambda: draw(alnum, r.randint(12, 60)), lambda: draw(alnum + "!@$%", r.randint(9, 16)), lambda: f"{word()}{draw(DIGITS, 3)}{draw('!@$%', 2)}{draw(alnum, 4)}",
    )
    telling = (  # keys that tell themselves, with a name or without
        lambda: r.choice(["AKIA", "ASIA"]) + draw(UPPER + "234567", 16), lambda: r.choice(["ghp_", "gho_", "ghs_"]) + draw(alnum, 36), lambda: r.choice(["xoxb-", "xoxp-"]) + draw(DIGITS, 11) + "-" + draw(alnum, 24),
        lambda: r.choice(["sk_live_", "sk-"]) + draw(alnum, r.choice([24, 40, 48])), lambda: "AIza" + draw(alnum + "_-", 35), lambda: "glpat-" + draw(alnum + "_-", 20),
        lambda: f"eyJ{draw(alnum, r.randint(17, 40))}.eyJ{draw(alnum, r.randint(20, 120))}" + r.choice([f".{draw(alnum + '_-', 43)}", "", "."]),
        lambda: draw(base, r.choice([40, 44, 64, 86, 88])) + r.choice(["", "=", "=="]), lambda: draw(alnum, r.choice([32, 40, 64])),
    )
    out = []
    for i in range(n):
        path = "/".join([r.choice(["src", "conf", "app", "pages", "src0", "data"]), word()])
        before, after = prose(6) + " ", " " + prose(3)
        if i % 2:
            pick = r.random()
            name = r.choice(SECRET_NAMES)
            sign = (name.upper() if r.random() < 0.2 else name) + r.choice([' = "', "=", ": ", ': "', " = '", '": "', " "])
            if pick < 0.08:
                kind = r.choice(["", "RSA ", "EC ", "OPENSSH ", "DSA "])
                value = f"-----BEGIN {kind}PRIVATE KEY-----\n" + "\n".join(line() for _ in range(r.randint(1, 30))) + f"\n{draw(base, r.randint(4, 60))}=\n-----END {kind}PRIVATE KEY-----"
                before = r.choice([before, before + sign, "", prose(2) + "\n"])
            elif pick < 0.16:
                value, before, after = r.choice(named)(), before + r.choice(["postgres", "mysql", "https", "redis", "amqp"]) + "://" + word() + ":", "@" + word() + r.choice([".example.com", ":5432/", "/"]) + prose(1)
                value = value.replace("/", "x").replace("@", "x")
            elif pick < 0.55:
                value, before = r.choice(named + telling)(), before + sign
                after = r.choice(['"', "'", "", " ", "\n"]) + " " + prose(3)
            else:
                value = r.choice(telling)()
                before, after = r.choice([before, prose(3) + ' "', prose(2) + ": ", prose(4) + "\n", prose(2) + " = "]), r.choice(['"', " ", "\n", ", ", ")"]) + prose(3)
            out.append(Finding(value, before, after, path if r.random() < 0.9 else r.choice(TEST_PATHS) + "/" + path, 1))
            continue
        pick = r.randrange(10)
        if pick == 0:
            value, before = draw(HEX, r.choice([32, 40, 64])), before + r.choice(["commit ", "sha256:", "md5: ", "checksum = ", "revision ", "", "etag: ", "hash=", "digest "])
        elif pick == 1:
            h = draw(HEX, 32)
            value, before = f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}", before + r.choice(["uuid: ", "id=", "id ", "", "token = ", "guid: "])
        elif pick == 2:
            value = draw(DIGITS, r.randint(16, 22))
        elif pick == 3:
            value = r.choice(["xxxxxxxx", "changeme1", "your_api_key_here", "your-token-here-1", "example_secret_123", "<redacted>", "password123", "insert_token_here_2", "0000000000000000", "1234567890123456", "aaaaaaaaaaaaaaaa1", draw("x*", 1) * r.randint(6, 30), f"your-{word()}-{word()}-here", f"<{word()}_{word()}>", f"${{{word().upper()}_{word().upper()}}}", f"{word()}_{word()}_placeholder"])
            before += r.choice(SECRET_NAMES) + r.choice([' = "', "=", ": "])
        elif pick == 4:
            value = r.choice("_-/").join([word() for _ in range(r.randint(3, 7))] + [str(r.randint(1, 99))])
        elif pick == 5:
            value, before, after = "/".join(word() for _ in range(4)) + f"/{r.randint(1, 9999)}", before + "https:", ".html " + prose(2)
        elif pick == 6:
            value = "".join(word().title() for _ in range(r.randint(2, 5))) + str(r.randint(1, 99))
        elif pick == 7:
            value, before = f"20{r.randint(10, 30)}-{r.randint(10, 12)}-{r.randint(10, 28)}_{r.randint(100000, 999999)}", before + r.choice(["build ", "version ", "file "])
        elif pick == 8:
            value, before = r.choice([word(), f"{word()}.{word()}", f"{word()}_{word()}", f"{word()}({word()})", f"self.{word()}", f"{word()}-{word()}"]), before + r.choice(SECRET_NAMES) + r.choice([" = ", "=", ": ", " "])
        else:
            value = draw(DIGITS, 4) + "-" + "-".join(draw(DIGITS, 4) for _ in range(3))
        path = path if r.random() < 0.6 else r.choice(TEST_PATHS) + "/" + path
        out.append(Finding(value, before, after, path, 0))
    return out


def findings_table(spark: SparkSession, findings: Sequence[Finding]) -> DataFrame:
    """Labelled findings as a table, which ``train`` reads too."""
    return spark.createDataFrame([astuple(f) for f in findings], "value string, before string, after string, path string, label int")


class Forest:
    """A random forest of Gini trees: bootstrap rows, a few features and thresholds a node."""

    def __init__(self, trees: int = 24, depth: int = 9, least: int = 3, seed: int = 11):
        self.trees, self.depth, self.least, self.seed = trees, depth, least, seed
        self.roots: list[tuple[np.ndarray, ...]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        few = max(2, int(np.sqrt(x.shape[1])) + 1)
        self.roots = []
        for _ in range(self.trees):
            nodes: list[list[float]] = []  # feature (-1: leaf), threshold, left, right, value
            rows = rng.integers(0, len(x), len(x))
            todo = [(rows, 0, -1, 0)]
            while todo:
                at, depth, parent, side = todo.pop()
                here = len(nodes)
                if parent >= 0:
                    nodes[parent][2 + side] = here
                p = float(y[at].mean())
                nodes.append([-1, 0.0, -1, -1, p])
                if depth == self.depth or len(at) < 2 * self.least or p in (0.0, 1.0):
                    continue
                best = (2 * p * (1 - p) - 1e-9, -1, 0.0)
                for f in rng.choice(x.shape[1], few, replace=False):
                    v = x[at, f]
                    cuts = np.unique(rng.choice(v, 12))
                    low = v[:, None] <= cuts
                    k = low.sum(axis=0)
                    fits = (k >= self.least) & (k <= len(at) - self.least)
                    if fits.any():
                        k, cuts, hits = k[fits], cuts[fits], (y[at] @ low)[fits]
                        a, b = hits / k, (y[at].sum() - hits) / (len(at) - k)
                        g = (k * 2 * a * (1 - a) + (len(at) - k) * 2 * b * (1 - b)) / len(at)
                        i = int(g.argmin())
                        best = min(best, (float(g[i]), int(f), float(cuts[i])))
                if best[1] >= 0:
                    nodes[here][:2] = best[1:]
                    low = x[at, best[1]] <= best[2]
                    todo += [(at[low], depth + 1, here, 0), (at[~low], depth + 1, here, 1)]
            table = np.array(nodes)
            self.roots.append((table[:, 0].astype(int), table[:, 1], table[:, 2:4].astype(int), table[:, 4]))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Share of secrets in the leaves, averaged over the trees."""
        out = np.zeros(len(x))
        for feature, cut, child, value in self.roots:
            at = np.zeros(len(x), int)
            while (inner := feature[at] >= 0).any():
                i = np.flatnonzero(inner)
                right = x[i, feature[at[i]]] > cut[at[i]]
                at[i] = child[at[i], right.astype(int)]
            out += value[at]
        return out / max(1, len(self.roots))


#: Labelled findings that the forest is trained on at most.
MOST_FINDINGS = 20_000


@dataclass(frozen=True)
class Detector:
    """A forest and the language whose features it reads."""

    forest: Forest
    language: Language

    def judge(self, findings: Sequence[Finding]) -> np.ndarray:
        return self.forest.predict(np.array([features(f.value, f.before, f.after, f.path, self.language) for f in findings], float))


def train(findings: Sequence[Finding] | DataFrame, language: Language) -> Detector:
    """A detector from labelled findings; of a table MOST_FINDINGS distinct rows at about."""
    if isinstance(findings, DataFrame):
        rows = bounded_sample(findings.select("value", "before", "after", "path", "label").na.fill(""), MOST_FINDINGS).collect()
        findings = [Finding(*r) for r in sorted(rows, key=tuple)]
    x = np.array([features(f.value, f.before, f.after, f.path, language) for f in findings], float)
    return Detector(Forest().fit(x, np.array([f.label for f in findings], float)), language)


def default_detector(language: Language | None = None) -> Detector:
    """Trained on the generator's findings, their prose drawn from the language's words."""
    language = language or language_of({}, np.zeros(0))
    return train(labelled_findings(words=sorted(language.words)), language)


def fit(docs: DataFrame, text_col: str = "text") -> Detector:
    """The default detector with the corpus's own dictionary and transitions."""
    return default_detector(learn_language(docs, text_col))


def _judged(text: str | None, path: str | None, detector: Detector) -> list[tuple[int, int, float]]:
    spans = candidates(text)
    if not spans:
        return []
    found = [Finding(text[a:b], text[max(0, a - NEAR) : a], text[b : b + NEAR], path) for a, b in spans]
    return [(a, b, float(s)) for (a, b), s in zip(spans, detector.judge(found), strict=True)]


def scan(docs: DataFrame, detector: Detector | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", threshold: float = 0.5) -> DataFrame:
    """(id, candidates, secrets): every document with the number of candidates and the
    spans judged to be secrets, as structs of start, end (code points) and score."""
    model = detector or fit(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for b in batches:
            told = [_judged(t.as_py(), p.as_py(), model) for t, p in zip(b.column(1), b.column(2), strict=True)]
            kept = [[{"start": a, "end": e, "score": s} for a, e, s in x if s >= threshold] for x in told]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in told], pa.int64()), pa.array(kept, kind)], ["id", "candidates", "secrets"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(path_col).cast("string").alias("path"))
    return in_arrow(rows, run, "id long, candidates long, secrets array<struct<start: long, end: long, score: double>>").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, detector: Detector | None = None, text_col: str = "text", path_col: str = "source", mark: str = "[secret]", threshold: float = 0.5) -> DataFrame:
    """The same rows and columns with every secret of the text replaced by ``mark``."""
    model = detector or fit(docs, text_col)
    names = docs.columns
    it, ip = names.index(text_col), names.index(path_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, p in zip(b.column(it), b.column(ip), strict=True):
                text = t.as_py()
                path = p.as_py()
                for a, e, s in reversed(_judged(text, None if path is None else str(path), model)):
                    if s >= threshold:
                        text = text[:a] + mark + text[e:]
                out.append(text)
            cols = list(b.columns)
            cols[it] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=list(b.schema.names))

    return in_arrow(docs, run, docs.schema)
