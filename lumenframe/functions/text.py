"""Text functions: normalising, tokens, term ids, coverage, scripts, presentation."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values of the tokeniser and of text clean-up.
MIN_TOKEN, NGRAM, NGRAM_MIN_WORD, MAX_TEXT = 2, 3, 4, 2000
EMPTY_MARKERS = ("-", "—", "–", "n/a")
LETTER = r"[\p{L}\p{Nl}\p{No}]"
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619


#: Runs of letters (letters and the numbers that are no digits) or of digits.
RUNS = re.compile(r"[^\W\d_]+|\d+")


def folded(text: str) -> str:
    """NFKC and case folding: one spelling for composed, full-width and capital letters."""
    return unicodedata.normalize("NFKC", text).casefold()


def words_of(text: str) -> list[str]:
    """What ``words`` finds in a text, in order of the text."""
    return [w for w in RUNS.findall(folded(text)) if len(w) >= MIN_TOKEN or w[0].isdecimal()]


def terms_of(word: str) -> list[str]:
    """The terms of one word: itself, and trigrams of a long run of letters."""
    grams = [] if word[0].isdecimal() or len(word) < NGRAM_MIN_WORD else ["#" + word[i : i + NGRAM] for i in range(len(word) - NGRAM + 1)]
    return [word, *grams]


def fnv(term: str) -> int:
    """What ``term_id`` gives."""
    h = FNV_OFFSET
    for b in term.encode("utf-8", "surrogatepass"):
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFF
    return h or 1


@F.pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else folded(t))


def normalise(text: Column) -> Column:
    """NFKC and case folding.  Plain ASCII stays inside the JVM; only other texts go to
    an Arrow function, since Spark has neither NFKC nor case folding."""
    return F.when(text.rlike(r"^[\x00-\x7f]*$"), F.lower(text)).otherwise(_folded(F.when(~text.rlike(r"^[\x00-\x7f]*$"), text)))


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(normalise(text), F.lit(pattern), F.lit(group))


def words(text: Column) -> Column:
    """Letter runs of two characters or more, then digit runs."""
    return F.concat(_found(text, LETTER + "{%d,}" % MIN_TOKEN), _found(text, r"\p{Nd}+"))


def tokens(text: Column) -> Column:
    """Words, and for letter runs of four or more their trigrams, marked by ``#``.

    The trigrams come from one pass of a look-ahead: three letters that stand in a run of
    four, that is, with a letter after or before them."""
    grams = _found(text, f"(?=({LETTER}{{{NGRAM}}}))(?:(?={LETTER}{{{NGRAM_MIN_WORD}}})|(?<={LETTER}))", 1)
    return F.concat(words(text), F.transform(grams, lambda g: F.concat(F.lit("#"), g)))


def term_id(term: Column) -> Column:
    """FNV-1a over the UTF-8 bytes, 32 bits, as a long; zero becomes one."""
    raw = F.hex(F.encode(term, "UTF-8"))
    places = F.sequence(F.lit(1), F.length(raw), F.lit(2))
    step = lambda h, i: (h.bitwiseXOR(F.conv(F.substring(raw, i, F.lit(2)), 16, 10).cast("long")) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF))
    h = F.when(F.length(raw) > 0, F.aggregate(places, F.lit(FNV_OFFSET).cast("long"), step)).otherwise(F.lit(FNV_OFFSET).cast("long"))
    return F.when(h == 0, F.lit(1).cast("long")).otherwise(h)


def _asked(query: Column | str) -> Column:
    """The query's distinct words; those of a plain string are literals of the plan."""
    if isinstance(query, Column):
        return F.array_distinct(words(query))
    asked = list(dict.fromkeys(words_of(query)))
    return F.array(*map(F.lit, asked)) if asked else F.array().cast("array<string>")


def coverage(query: Column | str, text: Column) -> Column:
    """Share of the query's distinct words that the text has; zero for no words."""
    asked = _asked(query)
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, words(text))) / F.size(asked)).otherwise(F.lit(0.0))


def matched(query: Column | str, text: Column) -> Column:
    """The words that coverage counts, in order of the alphabet."""
    return F.sort_array(F.array_intersect(_asked(query), words(text)))


def clean_recognised(text: Column) -> Column:
    """One space between words, empty for markers and for text without letter or digit,
    cut to MAX_TEXT characters."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    empty = F.lower(flat).isin(*EMPTY_MARKERS) | ~flat.rlike(r"[\p{L}\p{N}]")
    return F.when(empty, F.lit("")).otherwise(F.substring(flat, 1, MAX_TEXT))


def script_language(text: Column) -> Column:
    """Hebrew letters: he; Cyrillic letters: uk; else en."""
    return F.when(text.rlike(r"[֐-׿]"), "he").when(text.rlike(r"[Ѐ-ӿ]"), "uk").otherwise("en")


def prepare_prompt(text: Column, template: bool = True) -> Column:
    """Lower case, single spaces, and the caption template of the embedding model."""
    flat = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return F.concat(F.lit("this is a photo of "), flat, F.lit(".")) if template else flat


def as_boolean(value: Column) -> Column:
    """true / yes / так, false / no / ні, else null."""
    low = F.lower(F.trim(value))
    return F.when(low.isin("true", "yes", "так"), F.lit(True)).when(low.isin("false", "no", "ні"), F.lit(False))


def confidence(p: Column) -> Column:
    """A share as per cent: no decimals from 10 %, one from 1 %, else two."""
    digits = F.when(p >= 0.10, F.format_string("%.0f%%", p * 100)).when(p >= 0.01, F.format_string("%.1f%%", p * 100))
    return digits.otherwise(F.format_string("%.2f%%", p * 100))


def clock(ms: Column) -> Column:
    """Milliseconds as mm:ss.s; null stays null."""
    s = ms / F.lit(1000.0)
    return F.when(ms.isNotNull(), F.format_string("%02d:%04.1f", F.floor(s / 60), s - 60 * F.floor(s / 60)))
