"""URL filters: a Bloom filter cascade with exact membership over the corpus's keys.

The listed keys (host and path prefixes of the rules) are encoded in a first Bloom
filter.  The keys of the corpus that pass it without being listed are encoded in a
second, the listed keys that pass the second in a third, and so on until nothing passes
wrongly.  The universe is every key that any URL of the corpus can ask for, so the
answers are exact for the corpus and no join is needed: each URL tests its own keys in a
projection.  Filters are built and tested with DataFrame functions only.

A key is ``host + path`` where host is one of the URL's host suffixes at a dot and path
one of the URL's path prefixes that ends with ``/`` (rule paths end with ``/``).  Only pairs
of a number of host labels and a number of slashes that some rule has can match, so a URL
has one key for each such pair, however long it is.

Size.  The first level is sized by the universe (``bits_for``): at most half as many keys
pass wrongly as are listed, so that the levels shrink.  A later level holds the keys passed wrongly.  All levels are literals of the plan,
in pieces of ``PIECE_BITS``, which a hash of the key chooses among; no size is an error.

Rows
    null URL or one without ``://``: host and path are empty, no rule, default verdict.
    null ids, repeated rows: each row is judged.  Empty table: empty result.
    very long URLs, with however many slashes or dots: handled whole, in one pass each.
    ties between rules of one length: the one with the longer host.
    no rules: every URL gets the default verdict.
    other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise

#: (host, path, verdict).  Fixed values of the query's contract.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
BITS_PER_KEY, HASHES = 20, 13
#: Bits of one piece of a level: 1 MB.
PIECE_BITS = 1 << 23
#: Bits of a level over a known universe at least.
LEAST_BITS = 1 << 16


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def depths(rules: Sequence[tuple[str, str, str]]) -> list[tuple[int, int]]:
    """(host labels, slashes) of the rules, longest hosts first, then longest paths."""
    return sorted({(h.count(".") + 1, p.count("/")) for h, p, _ in rules}, reverse=True)


def candidate_keys(host: Column, path: Column, at: Sequence[tuple[int, int]]) -> Column:
    """The keys of the URL for the pairs ``at`` of ``depths``; null where it is too short."""
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    keys = [F.when((labels >= n) & (slashes >= m), F.concat(F.substring_index(host, ".", -n), F.substring_index(path, "/", m), F.lit("/"))) for n, m in at]
    return F.array(*keys) if keys else F.array().cast("array<string>")


def bits_for(listed: int, universe: int, least: int = BITS_PER_KEY) -> int:
    """Bits, a power of two, with which at most half as many keys of the universe pass
    wrongly as there are listed ones: 13 places, each taken with the chance
    (listed / 2 / universe) ** (1 / 13).  A universe of zero is an unknown one."""
    need = listed * least
    if universe:
        taken = min(0.5, (listed / 2 / universe) ** (1 / HASHES))
        need = max(need, LEAST_BITS, -HASHES * listed / math.log1p(-taken))
    return 1 << max(10, math.ceil(math.log2(need)))


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))


class Bloom:
    """One level: bits as literal arrays of longs, tested by double hashing.  The step is
    odd and the size a power of two, so a key's places are all different."""

    def __init__(self, keys: DataFrame, level: int, bits: int):
        self.level, self.bits = level, bits
        self.piece = min(bits, PIECE_BITS)
        at = keys.select(F.explode(F.array(*self._places(F.col("key")))).alias("at"))
        words = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(_bit(F.col("at"))).alias("v"))
        held = {r["w"]: r["v"] for r in words.collect()}
        per = self.piece // 64
        self.words = [[held.get(i, 0) for i in range(at, at + per)] for at in range(0, bits // 64, per)]

    def _places(self, key: Column) -> list[Column]:
        a, b, c = (F.xxhash64(key, F.lit(3 * self.level + i)) for i in range(3))
        start = c.bitwiseAND(F.lit(self.bits // self.piece - 1)) * F.lit(self.piece)  # of the key's piece
        step = b.bitwiseAND(F.lit((1 << 47) - 1)).bitwiseOR(F.lit(1))  # sums of 13 stay below 2 ** 63
        return [start + (a.bitwiseAND(F.lit((1 << 47) - 1)) + step * F.lit(i).cast("long")).bitwiseAND(F.lit(self.piece - 1)) for i in range(HASHES)]

    def passes(self, key: Column) -> Column:
        pieces = [F.split(F.lit(",".join(map(str, p))), ",").cast("array<bigint>") for p in self.words]  # folded to literals
        table, per = F.array(*pieces), self.piece // 64
        out = F.lit(True)
        for at in self._places(key):
            w = F.shiftright(at, 6)
            piece = F.get(table, F.shiftright(w, per.bit_length() - 1).cast("int")) if len(pieces) > 1 else pieces[0]
            word = F.get(piece, w.bitwiseAND(F.lit(per - 1)).cast("int"))
            out = out & (F.lit(0) != word.bitwiseAND(_bit(at)))
        return out


class Cascade:
    """Exact membership of listed keys among the keys of ``universe`` (column key; null and
    repeated keys are welcome).  ``size``: an upper estimate of the universe's keys."""

    def __init__(self, listed: DataFrame, universe: DataFrame, size: int = 0, bits_per_key: int = BITS_PER_KEY):
        self.levels: list[Bloom] = []
        listed = listed.select("key").distinct()
        inside, outside = listed, universe.select("key").where("key is not null")
        n, kept = listed.count(), []
        listed = F.broadcast(listed) if n <= 10_000 else listed
        while n:
            level = Bloom(inside, len(self.levels), bits_for(n, size, bits_per_key))
            self.levels.append(level)
            passed = outside.where(level.passes(F.col("key")))
            if len(self.levels) == 1:  # the universe holds listed keys too; they pass rightly
                passed = passed.join(listed, "key", "left_anti")
            passed = materialise(passed.distinct(), "passed_wrongly")
            kept.append(passed)
            inside, outside, size, m = passed, inside, 0, passed.count()
            bits_per_key *= 2 if len(self.levels) > 8 else 1  # settles in any case
            n = m
        for table in kept:
            discard(table)

    def holds(self, key: Column) -> Column:
        """Passing an odd number of levels before the first miss means listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            out = F.when(level.passes(key), out).otherwise(F.lit(i % 2 == 1))
        return out


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for every row; ``default`` where no rule fits."""
    if any(not p.startswith("/") or not p.endswith("/") for _, p, _ in rules):
        raise ValueError("a rule's path starts and ends with /")
    spark: SparkSession = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    listed = spark.range(1).select(F.explode(F.array(*[F.lit(h + p) for h, p, _ in rules]) if rules else F.array().cast("array<string>")).alias("key"))
    at = depths(rules)
    keys = candidate_keys(F.col("host"), F.col("path"), at)
    cascade = Cascade(listed, rows.select(F.explode(keys).alias("key")), rows.count() * len(at))
    fits = F.filter(keys, lambda k: k.isNotNull() & cascade.holds(k))
    longest = F.aggregate(fits, F.lit(""), lambda a, k: F.when(F.length(k) > F.length(a), k).otherwise(a))
    out = rows.withColumn("rule", F.when(longest != "", longest))
    verdict = F.lit(default)
    for h, p, v in rules:
        verdict = F.when(F.col("rule") == h + p, F.lit(v)).otherwise(verdict)
    return out.withColumn("verdict", verdict).withColumnRenamed("id", id_col)
