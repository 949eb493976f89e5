"""SentencePiece encoding and decoding for merge-type (BPE) models with byte fallback.

Encoding doesn't merge pair by pair.  It takes the longest vocabulary piece at a place
(all matches come from one Aho-Corasick pass), accepts it if it is compatible with the
piece before it, that is, if merging the two pieces' text anew gives just these two, and
otherwise tries shorter prefixes; a place from which nothing fits is marked in a bitfield
and never tried again.  A sequence whose neighbours are all compatible is the sequence
that merging would have given.

A text is cut where no piece can reach across: before a run of spaces, after letters that
something else follows, and around characters that no piece holds (the model's pieces are
checked for this when it is read).  Each distinct unit is encoded once a worker; the memory
for that is bounded.

Rows
    null text: treated as empty; no ids.  Very long texts and units: handled whole.
    null ids, repeated rows: each row is encoded.  Empty table: empty result.
    other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

SPACE = "▁"
#: Units kept a worker, and their longest length in characters.
MOST_UNITS, LONGEST_UNIT = 300_000, 48
#: Pairs of pieces whose compatibility is kept.
MOST_PAIRS = 300_000
_OTHER = r"\d_\u00b2\u00b3\u00b9\u00bc-\u00be"  # digits, and what re counts among word characters besides
_LETTER = rf"[^\W{_OTHER}]"
_UNIT = re.compile(rf"{SPACE}*{_LETTER}+|{SPACE}*(?:[^\w{SPACE}\n]|[{_OTHER}])+{_LETTER}*|{SPACE}+|\n")
_CUT = re.compile(rf"{_LETTER}[\W{_OTHER}]|\n|[^{SPACE}]{SPACE}")


class _Units(dict):
    """Ids by unit; an unknown unit is encoded, and kept unless it is long."""

    def __init__(self, of: PieceModel):
        super().__init__()
        self._of = of

    def __missing__(self, unit: str) -> tuple[int, ...]:
        ids = tuple(self._of.encode_unit(unit))
        if len(unit) <= LONGEST_UNIT:
            self[unit] = ids
        return ids


class PieceModel:
    """A BPE model file of the sentencepiece library, read for encoding and decoding."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        spec = m.normalizer_spec
        if m.trainer_spec.model_type != 2 or not m.trainer_spec.byte_fallback:
            raise ValueError("a merge-type model with byte fallback is needed")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a model that normalises its text isn't supported")
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte_id = [0] * 256
        self.text: list[str | int | None] = [None] * len(m.pieces)
        for i, p in enumerate(m.pieces):
            if p.type == 6:
                self.byte_id[int(p.piece[3:5], 16)] = i
                self.text[i] = int(p.piece[3:5], 16)
            elif p.type == 1:
                self.score[p.piece], self.id[p.piece] = p.score, i
                self.text[i] = p.piece.replace(SPACE, " ")
            elif p.type not in (2, 3):
                raise ValueError("user-defined pieces aren't supported")
            elif p.type == 2:
                self.text[i], self.unknown = m.trainer_spec.unk_surface, i
            else:
                self.text[i] = ""
        if any(_CUT.search(p) for p in self.id):
            raise ValueError("pieces that reach over the border of two units aren't supported")
        self.chars = {c for p in self.id for c in p}
        self._fits: dict[str, dict[str, bool]] = {}
        self._pairs = 0
        self._units = _Units(self)
        # a piece that its own text isn't merged to is never the result of merging
        self.rank = {p: -1.0 if len(p) == 1 else -s for p, s in self.score.items()}
        merged = {p: self._merged(p) for p in self.id}
        self.alone = {p for p, (out, _) in merged.items() if out == [p]}
        self.joined = {p: merged[p][1] for p in self.alone if len(p) > 1}
        # pieces whose merges don't go strictly down the list; these are merged anew in full
        self.odd = {p for p in self.id if any(self.rank[x] >= self.rank[p] for x in merged[p][1] or ())}
        while more := {p for p, two in self.joined.items() if p not in self.odd and not self.odd.isdisjoint(two)}:
            self.odd |= more
        self.right_edge = {p: self._edge(p, 1) for p in self.alone}
        self.left_edge = {p: self._edge(p, 0) for p in self.alone}
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.alone), None) for p in self.alone}
        self.matches = ahocorasick.Automaton()
        for p in self.alone:
            self.matches.add_word(p, len(p))
        self.matches.make_automaton()

    def merge(self, text: str) -> list[str]:
        """Merge neighbours by score, the leftmost first among equals (the definition)."""
        return self._merged(text)[0]

    def _merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The pieces, and the two that the last merge joined."""
        n, score, joined = len(text), self.score, None
        part, after, before = list(text), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-score[p], i, p) for i in range(n - 1) if (p := text[i : i + 2]) in score]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = after[i] if part[i] else n
            if not part[i] or j >= n or part[i] + part[j] != p:
                continue
            joined = part[i], part[j]
            part[i], part[j] = p, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (q := p + part[k]) in score:
                    heapq.heappush(heap, (-score[q], i, q))
            if (b := before[i]) >= 0 and (q := part[b] + p) in score:
                heapq.heappush(heap, (-score[q], b, q))
        return [p for p in part if p], joined

    def _edge(self, piece: str, side: int) -> tuple[tuple[str, float, float], ...]:
        """What stands at one edge of a piece while it is merged, last state first:
        (piece, rank of the merge that made it, rank of the merge that ends it)."""
        out, ends = [], float("inf")
        while True:
            out.append((piece, self.rank[piece], ends))
            if piece not in self.joined:
                return tuple(out)
            ends, piece = self.rank[piece], self.joined[piece][side]

    def fits(self, a: str, b: str) -> bool:
        """Whether merging the text of two neighbouring pieces anew gives just these two.

        The merges are taken back, the latest first; at each state the two symbols at the
        border must not have been joined before one of them was used up otherwise.
        """
        after = self._fits.get(a)
        if after is None:
            if self._pairs >= MOST_PAIRS:
                self._fits.clear()
                self._pairs = 0
            after = self._fits[a] = {}
        known = after.get(b)
        if known is None:
            self._pairs += 1
            known = after[b] = self._border(a, b)
        return known

    def _border(self, a: str, b: str) -> bool:
        if a in self.odd or b in self.odd:
            return self.merge(a + b) == [a, b]
        left, right, rank = self.right_edge[a], self.left_edge[b], self.rank
        i = j = 0
        while True:
            x, made_x, ends_x = left[i]
            y, made_y, ends_y = right[j]
            q = rank.get(x + y)
            if q is not None and q < ends_x and q <= ends_y:
                return x + y in self.odd and self.merge(a + b) == [a, b]
            if made_x > made_y:
                i += 1
            elif made_y >= 0:
                j += 1
            else:
                return True

    def pieces(self, text: str) -> list[str]:
        """Pieces of a text all of whose characters are known, by backtracking."""
        fits, size = self._fits, len(text)
        out: list[str] = []
        pos, last = 0, None
        # the longest matches one after another, as long as each fits the one before
        for end, n in self.matches.iter_long(text):
            piece = text[pos : pos + n]
            if last is not None:
                ok = known.get(piece) if (known := fits.get(last)) is not None else None
                if ok is None:
                    ok = self.fits(last, piece)
                if not ok:
                    break
            out.append(piece)
            pos, last = end + 1, piece
        if pos == size:
            return out
        longest = [0] * size
        for end, n in self.matches.iter(text):
            if n > longest[end - n + 1]:
                longest[end - n + 1] = n
        failed = 0  # bit i: nothing fits from place i on
        piece = text[pos : pos + longest[pos]]
        while pos < size:
            end = pos + len(piece)
            ok = not failed >> end & 1
            if ok and last is not None:
                ok = known.get(piece) if (known := fits.get(last)) is not None else None
                if ok is None:
                    ok = self.fits(last, piece)
            if ok:
                out.append(piece)
                pos, last = end, piece
                if pos < size:
                    piece = text[pos : pos + longest[pos]]
            elif (less := self.shorter[piece]) is not None:
                piece = less
            else:
                failed |= 1 << pos
                piece = out.pop()
                pos -= len(piece)
                last = out[-1] if out else None
        return out

    def encode_unit(self, unit: str) -> list[int]:
        if unit in self.alone:
            return [self.id[unit]]
        if self.chars.issuperset(unit):
            return [self.id[p] for p in self.pieces(unit)]
        out: list[int] = []
        start = 0
        for i in [*(i for i, c in enumerate(unit) if c not in self.chars), len(unit)]:
            if i > start:
                out += [self.id[p] for p in self.pieces(unit[start:i])]
            if i < len(unit):
                out += [self.byte_id[b] for b in unit[i].encode("utf-8")]
            start = i + 1
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text, without begin or end ids."""
        if not text:
            return []
        if len(self._units) > MOST_UNITS:
            self._units.clear()
        units = _UNIT.findall(self.prefix + text.replace(" ", SPACE))
        return list(chain.from_iterable(map(self._units.__getitem__, units)))

    def decode(self, ids: Sequence[int]) -> str:
        """Text of ids.  Bytes that are no UTF-8 become one U+FFFD each, as in the library."""
        parts = list(map(self.text.__getitem__, ids))
        if self.prefix:  # the space put before the text goes again
            first = next((i for i, p in enumerate(parts) if p != ""), None)
            if first is not None and isinstance(parts[first], str) and ids[first] != self.unknown:
                parts[first] = parts[first].removeprefix(" ")
        try:
            return "".join(parts)  # no bytes among them
        except TypeError:
            pass
        out: list[str] = []
        run = bytearray()
        for p in [*parts, ""]:
            if isinstance(p, int):
                run.append(p)
                continue
            if run:
                out.append(_from_bytes(bytes(run)))
                run.clear()
            out.append(p)
        return "".join(out)


def _from_bytes(raw: bytes) -> str:
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode("utf-8"))
            except UnicodeDecodeError:
                continue
            i += n
            break
        else:
            out.append("�")
            i += 1
    return "".join(out)


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The model of a file, read once a worker."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def tokenise(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """(id, ids, decoded): the ids of every whole text and the text that they decode to.

    ``path`` must be readable on every executor (the file comes with the tokenizers).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            for at in range(0, len(b), 256):
                few = b.slice(at, 256)
                ids = [m.encode(t.as_py()) for t in few.column(1)]
                texts = [m.decode(x) if decode else None for x in ids]
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())], ["id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return in_arrow(rows, run, "id long, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def decode_ids(rows: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the decoded text of a column of ids (null ids: empty text)."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def text(ids):  # noqa: ANN001, ANN202
        m = model(path)
        return ids.map(lambda x: m.decode([int(i) for i in x]) if x is not None else "")

    return rows.withColumn(out_col, text(F.col(ids_col)))
