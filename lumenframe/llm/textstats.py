"""Per-document statistics that the quality operators learn from."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

#: The characters counted as symbols.
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\v\f\r"
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_digits", "n_marks", "n_kinds", "top_word", "longest_word",
)


def repeated_words(words: list) -> int:
    """Words in 3-word windows that occur twice or more, the first occurrence included."""
    if len(words) < 4:
        return 0
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    if len(seen) == len(words) - 2:
        return 0
    again = {k for k, n in seen.items() if n > 1}
    covered = end = 0
    for i, k in enumerate(zip(words, words[1:], words[2:], strict=False)):
        if k in again:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def text_counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of one whole text; all zero for null."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return (0,) * len(COUNTS)
    lines = text.split("\n")
    dup = 0
    if len(lines) > 1:
        told = Counter(x for x in lines if x.strip(_SPACES))
        dup = sum(told.values()) - len(told)
    kinds = Counter(words)
    upper = n_digits = marks = 0
    for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        upper += raw.count(c)
    for c in b"0123456789":
        n_digits += raw.count(c)
    for c in b"!?":
        marks += raw.count(c)
    return (
        n,
        len(text) - sum(text.count(c) for c in _SPACES),
        sum(text.count(c) for c in SYMBOLS),
        dup,
        repeated_words(words),
        len(lines),
        upper,
        n_digits,
        marks,
        len(kinds),
        max(kinds.values()),
        max(map(len, kinds)),
    )


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, *COUNTS): one row per document, its whole text counted in one pass."""
    kept = [f"keep_{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [text_counts(t.as_py()) for t in b.column(1)]
            cols = [pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], *cols], ["id", *kept, *COUNTS])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).cast("string").alias(k) for c, k in zip(keep, kept, strict=True)])
    kind = "id long" + "".join(f", {k} string" for k in kept) + "".join(f", {c} long" for c in COUNTS)
    out = in_arrow(rows, run, kind)
    return out.withColumnsRenamed(dict(zip(kept, keep, strict=True)))


def ratios() -> dict[str, Column]:
    """Length-free features of a row of COUNTS, as Spark expressions."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / n,
        "symbol_share": F.col("n_symbols") / n,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeat_share": F.col("n_repeat_words") / n,
        "upper_share": F.col("n_upper") / chars,
        "digit_share": F.col("n_digits") / chars,
        "mark_share": F.col("n_marks") / n,
        "kind_share": F.col("n_kinds") / n,
        "top_share": F.col("top_word") / n,
        "longest_word": F.col("longest_word").cast("double"),
        "line_length": F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
    }
