"""Problem 8: texts over a token limit in pieces that end at the text's own breaks.

Content-defined chunking: a rolling hash over the characters marks landmarks, each landmark snaps to the
nearest natural break, and the first snapped landmark between the least and the most new tokens ends the
piece. Where a piece ends thus depends on nearby text alone, and an edit alters only the pieces around it.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.tokens import TOKENIZER, Encoder, _ranks
from shelfmark.plans.runtime import bounded

LIMIT, OVERLAP, LEAST = 512, 64, 224
#: Characters under the rolling hash, and the share of positions that are landmarks (one in so many).
WINDOW, ONE_IN = 24, 96

#: Kinds of break, the strongest first: paragraph, line, sentence, clause, white space.
BREAKS = [
    re.compile(r"(?:\r\n?|\n)[^\S\r\n]*(?:\r\n?|\n)\s*"),
    re.compile(r"[\r\n\u2028\u2029]\s*"),
    re.compile(r"[。！？!?…．]+[”’」』）)\]\"']*|\.(?<!\.\.)\.*[”’)\]\"']*(?=\s|$)"),
    re.compile(r"[，；：、,;](?=\D|$)|[:—](?=\s)"),
    re.compile(r"\s+"),
]

PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece_no", pa.int32()), ("char_start", pa.int64()), ("char_end", pa.int64()), ("overlap_chars", pa.int32()), ("overlap_tokens", pa.int32()), ("n_tokens", pa.int32()), ("text", pa.string())]
)
PIECES_DDL = "doc_id bigint, piece_no int, char_start bigint, char_end bigint, overlap_chars int, overlap_tokens int, n_tokens int, text string"


def rolling(text: str) -> np.ndarray:
    """Of every character, the hash of the ``WINDOW`` characters up to it."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    mixed = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    # The sum of (2 k + 3) * mixed[i - k] over the window, modulo 2^64, by two prefix sums.
    at = np.arange(mixed.size, dtype=np.uint64)
    sums, placed = np.cumsum(mixed, dtype=np.uint64), np.cumsum(mixed * at, dtype=np.uint64)
    sums[WINDOW:], placed[WINDOW:] = sums[WINDOW:] - sums[:-WINDOW], placed[WINDOW:] - placed[:-WINDOW]
    rolled = (np.uint64(2) * at + np.uint64(3)) * sums - np.uint64(2) * placed
    rolled ^= rolled >> np.uint64(31)
    rolled *= np.uint64(0xBF58476D1CE4E5B9)
    return rolled


def landmarks(rolled: np.ndarray) -> np.ndarray:
    """Positions whose preceding ``WINDOW`` characters hash to a landmark, in ascending order."""
    return np.flatnonzero((rolled >> np.uint64(40)) % np.uint64(ONE_IN) == 0) + 1


class Cutter:
    """Pieces of one text after another."""

    def __init__(self, encoder: Encoder, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST):
        self.encoder, self.limit, self.overlap, self.least = encoder, limit, overlap, min(least, max(1, limit - overlap - 8))
        #: Seams may cost a token or two more than the whole text's ids tell.
        self.most = limit - overlap - 4

    def cut(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """``start, end, overlap characters, overlap tokens, tokens`` of each piece; the end of the new text of one is the start of that of the next."""
        ids = self.encoder.ids(text)
        if len(ids) <= self.limit:
            return [(0, len(text), 0, 0, len(ids))] if text else []
        n, whole = len(text), Positions(text, self.encoder.sizes[ids])
        strong = [sorted({m.end() for b in BREAKS[:3] for m in b.finditer(text)} - {0})]
        rolled = rolling(text)
        marks = landmarks(rolled)
        count = lambda a, b: whole.between(a, b) if whole.clean(a) and whole.clean(b) else len(self.encoder.encode(text[a:b]))
        out, new_from = [], 0
        while new_from < n:
            done = whole.tokens(new_from) + (new_from > 0)
            first = not out
            most = self.most + (self.overlap if first else 0)
            end = n if len(ids) - done <= most else self.end(text, strong, rolled, marks, new_from, whole.fits(done + self.least), whole.fits(done + most))
            at = new_from if first else self.back(text, strong, new_from, whole.fits(max(1, whole.tokens(new_from) - self.overlap + 1)))
            while True:
                size, repeated = count(at, end), count(at, new_from) if at < new_from else 0
                if size <= self.limit and repeated <= self.overlap:
                    break
                if at < new_from:
                    at = min(new_from, at + max(1, (new_from - at) // 8))
                else:
                    end = new_from + max(1, (end - new_from) * 15 // 16)
            out.append((at, end, new_from - at, repeated, size))
            new_from = end
        return out

    def end(self, text: str, strong: list[list[int]], rolled: np.ndarray, marks: np.ndarray, start: int, low: int, high: int) -> int:
        """Where the piece ends: between ``low`` and ``high``, at the strongest kind of break found there."""
        low, high = max(low, start + 1), max(high, start + 1)
        for kind in (strong, 3, 4):
            inside = _inside(text, kind, low, high)
            if not inside:
                continue
            for m in marks[marks.searchsorted(low) : marks.searchsorted(high, "right")].tolist():
                k = bisect_left(inside, m)
                return min(inside[max(0, k - 1) : k + 1], key=lambda p: (abs(p - m), p))
            # No landmark: the break of the least hash, which depends on the text around it alone.
            return min(inside, key=lambda p: (int(rolled[p - 1]), -p))
        # No break between the bounds: the last one before them is still better than none.
        before = [p for kind in (strong, 3, 4) for p in _inside(text, kind, start + 1, low)[-1:]]
        return max(before) if before else high

    def back(self, text: str, strong: list[list[int]], new_from: int, earliest: int) -> int:
        """Where the overlap begins: the first sentence or line, else clause or word, within the tokens to repeat."""
        for kind in (strong, 3, 4):
            if inside := _inside(text, kind, earliest, new_from - 1):
                return inside[0]
        return min(earliest, new_from)


class Positions:
    """Characters and tokens of a whole text against each other."""

    def __init__(self, text: str, sizes: np.ndarray):
        self.text = text
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        head = (raw & 0xC0) != 0x80
        chars, ends = np.cumsum(head), np.cumsum(sizes)
        #: Characters begun up to the end of each token, and those complete by then.
        self.up_to = chars[ends - 1]
        self.complete = self.up_to - ~np.append(head[1:], True)[ends - 1]

    def tokens(self, pos: int) -> int:
        """Tokens that end before the character at ``pos``."""
        return int(self.up_to.searchsorted(pos, "left"))

    def fits(self, count: int) -> int:
        """The characters that the first ``count`` tokens hold."""
        return int(self.complete[min(count, self.complete.size) - 1])

    def clean(self, pos: int) -> bool:
        """Whether the text may be cut at ``pos`` without another split on either side: behind a sign that isn't
        an apostrophe and before a letter, number or space, or behind a single line end."""
        t = self.text
        if pos == 0 or pos == len(t):
            return True
        before, after = t[pos - 1], t[pos]
        if before.isspace():
            return before in "\n\r\t" and not after.isspace() and not (pos > 1 and t[pos - 2].isspace())
        return before != "'" and not before.isalnum() and (after.isalnum() or after.isspace())

    def between(self, a: int, b: int) -> int:
        """Tokens of the text from one clean place to another."""
        return int(self.up_to.searchsorted(b, "right") - self.up_to.searchsorted(a, "right"))


def _inside(text: str, kind: list[list[int]] | int, low: int, high: int) -> list[int]:
    """Breaks from ``low`` to ``high`` in order: of the strong kinds, found once a text, or of a weaker one, sought only here."""
    if isinstance(kind, int):
        return [m.end() for m in BREAKS[kind].finditer(text, max(0, low - 1), high) if m.end() >= low]
    return kind[0][bisect_left(kind[0], low) : bisect_right(kind[0], high)]


def _cutting(held, limit: int, overlap: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Counting needs no tree; only very long texts are halved.
        cutter = Cutter(Encoder(held.value, leaf=1 << 14), limit, overlap, least)
        for b in bounded(batches, 1):
            rows = [(i, k, s, e, o, r, c, t[s:e]) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for k, (s, e, o, r, c) in enumerate(cutter.cut(t), 1)]
            for at in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 20_000], strict=True), PIECES, strict=True)], schema=PIECES)

    return run


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, *, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """Every text in pieces of at most ``limit`` tokens.

    ``char_start:char_end`` is the piece in the text; its first ``overlap_chars`` characters repeat the
    end of the piece before, at most ``overlap`` tokens; without them the pieces joined are the text.
    A text within the limit is one piece; null and empty texts give none. No shuffle.
    """
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_cutting(_ranks(docs, tokenizer), limit, overlap, least), PIECES_DDL)
