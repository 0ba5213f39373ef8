"""Problem 7: passages of held-out items standing in training texts.

Every partition of the corpus is cut into shards of a bounded number of tokens; each shard gets a suffix
array, every suffix of every passage is looked up in it by binary search, and each longest verbatim match
is grown across one replaced token. English passages are matched by words, others by characters.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.plans.runtime import bounded

#: Tokens in a row that make a leak.
WORDS, CHARACTERS = 24, 40
#: Tokens of a shard; a suffix array over so many takes some 60 MB.
SHARD = 600_000
#: Characters of passages broadcast at once.
BLOCK_CHARS = 8_000_000
#: Places of matches gone through at once.
PLACES = 1 << 20
MATCH = ["doc_id", "item_id", "length", "verbatim", "doc_at", "item_at"]
MATCH_DDL = ", ".join(f"{c} bigint" for c in MATCH)

_MARK = re.compile(r"(?m)^[^\S\n]*(?:(?:[>|#*+•·‣–—-]+|\(?\d{1,3}[.)、])(?=\s)[^\S\n]*|>+)+")
_WORD = re.compile(r"[^\W_]+(?:['’‐‑\-][^\W_]+)*")
_NOT_WORD = re.compile(r"[\W_]+")
_HAN = re.compile("[㐀-䶿一-鿿豈-﫿]")


def even(text: str) -> str:
    """The text without case, width, marks without a shape and line marks."""
    text = unicodedata.normalize("NFKC", text).casefold().replace("\r\n", "\n").replace("\r", "\n")
    text = re.sub("[­᠎​-‏⁠﻿]", "", text)
    return _MARK.sub("", text)


def words(text: str) -> list[str]:
    return [w if w.isalnum() else _NOT_WORD.sub("", w) for w in _WORD.findall(text)]


def hashed(rows: list[list[str]]) -> list[np.ndarray]:
    """The words of several texts as numbers; each different word is hashed once."""
    flat = np.array([w for r in rows for w in r], object)
    numbers = pd.util.hash_array(flat, categorize=True).astype(np.int64) if flat.size else np.zeros(0, np.int64)
    return np.split(numbers, np.cumsum([len(r) for r in rows])[:-1]) if rows else []


def characters(text: str) -> np.ndarray:
    return np.frombuffer(_NOT_WORD.sub("", text).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def passage(text: str) -> str:
    """The item without its instruction and question: the lines between the first and the last of three, the first of two."""
    lines = [x for x in re.split(r"\r\n?|\n", text) if x.strip()]
    return "\n".join(lines[1:-1] if len(lines) > 2 else lines[:1])


class SuffixArray:
    """Suffixes of token streams, sorted by their first ``depth`` tokens through ranks of doubled length.

    ``tokens`` are dense numbers below ``size``; ``room[i]`` is how many tokens of its text are left at ``i``.
    """

    def __init__(self, tokens: np.ndarray, room: np.ndarray, size: int, depth: int):
        bits = max(1, int(size + 1).bit_length())
        pack = max(k for k in range(1, 63 // bits + 1) if k <= depth)
        self.n, self.depth, self.bits = tokens.size, depth, bits
        self.levels: list[tuple[int, int, np.ndarray]] = []
        key = self.packed(tokens, room, pack)
        have = pack
        while True:
            order = np.argsort(key, kind="stable") if have >= depth else np.argsort(key)
            ordered = key[order]
            new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if self.n else np.zeros(0, bool)
            rank = np.empty(self.n, np.int64)
            rank[order] = np.cumsum(new)
            self.levels.append((have, 0, ordered[new]))
            if have >= depth:
                break
            step = min(have, depth - have)
            key = self.paired(rank, step, room, int(new.sum()) + 1)
            self.levels[-1] = (have, step, self.levels[-1][2])
            have += step
        self.order = order
        self.first = np.flatnonzero(new)
        self.last = np.append(self.first[1:], self.n)

    def packed(self, tokens: np.ndarray, room: np.ndarray, pack: int) -> np.ndarray:
        key = np.zeros(tokens.size, np.int64)
        for k in range(pack):
            nxt = np.zeros(tokens.size, np.int64)
            nxt[: max(0, tokens.size - k)] = tokens[k:] + 1
            key = (key << self.bits) | np.where(room > k, nxt, 0)
        self.pack = pack
        return key

    def paired(self, rank: np.ndarray, step: int, room: np.ndarray, base: int) -> np.ndarray:
        nxt = np.zeros(rank.size, np.int64)
        nxt[: max(0, rank.size - step)] = rank[step:]
        return rank * base + np.where(room > step, nxt, 0)

    def intervals(self, tokens: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a stream of test tokens (-1: not in the shard): the starts whose next ``depth`` tokens stand in the array, and where."""
        known = np.where(tokens < 0, 0, tokens)
        missing = np.concatenate([[0], np.cumsum(tokens < 0)])
        at = np.arange(tokens.size)
        ok = (room >= self.depth) & (missing[np.minimum(at + self.depth, tokens.size)] == missing[at])
        key = self.packed(known, room, self.pack)
        rank = np.zeros(0, np.int64)
        for have, step, keys in self.levels:
            spot = np.searchsorted(keys, key)
            hit = spot < keys.size
            hit[hit] = keys[spot[hit]] == key[hit]
            rank = np.where(hit, spot + 1, 0)
            if have < self.depth:
                # A start whose first half isn't in the array can't be; one whose second half isn't neither.
                nxt = np.zeros(rank.size, np.int64)
                nxt[: max(0, rank.size - step)] = rank[step:]
                ok &= (rank > 0) & (nxt > 0)
                key = self.paired(rank, step, room, keys.size + 1)
        starts = np.flatnonzero(ok & (rank > 0))
        return starts, self.first[rank[starts] - 1], self.last[rank[starts] - 1]


class Passages:
    """The distinct passages of one mode, as one stream."""

    def __init__(self, texts: list[tuple[str, list[int]]], by_words: bool):
        self.by_words, self.need = by_words, WORDS if by_words else CHARACTERS
        # One replaced token leaves at least half of the others verbatim on one side of it.
        self.depth = self.need // 2
        numbers = hashed([words(t) for t, _ in texts]) if by_words else [characters(t) for t, _ in texts]
        streams = list(zip(numbers, [items for _, items in texts], strict=True))
        streams = [(s, i) for s, i in streams if s.size >= self.need]
        self.items = [i for _, i in streams]
        sizes = np.array([s.size for s, _ in streams], np.int64)
        self.tokens = np.concatenate([s for s, _ in streams]) if streams else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(len(streams)), sizes)
        self.begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.room = np.repeat(np.cumsum(sizes), sizes) - np.arange(self.tokens.size)

    def search(self, docs: list[tuple[int, int, np.ndarray]]) -> dict[tuple[int, int], tuple[int, int, int, int]]:
        """By ``(document, item)``, the longest row in one shard that makes a leak: its length, the verbatim part of it, and where it
        begins in the document and in the passage. ``docs`` are documents, the place their tokens begin at, and the tokens."""
        sizes = np.array([s.size for *_, s in docs], np.int64)
        stream = np.concatenate([s for *_, s in docs])
        values, dense = np.unique(stream, return_inverse=True)
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(docs)), sizes)
        array = SuffixArray(dense.astype(np.int64), ends[owner] - np.arange(stream.size), values.size, self.depth)
        spot = np.minimum(np.searchsorted(values, self.tokens), values.size - 1)
        starts, lo, hi = array.intervals(np.where(values[spot] == self.tokens, spot, -1), self.room)
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        # A phrase may recur in many places: the places are gone through in slices.
        cuts = np.flatnonzero(np.diff(np.cumsum(hi - lo) // PLACES)) + 1 if starts.size else []
        for some in np.split(np.arange(starts.size), cuts):
            self.grow(docs, stream, sizes, ends, owner, array, starts[some], lo[some], hi[some], best)
        return {(docs[d][0], i): row for (d, who), row in best.items() for i in self.items[who]}

    def grow(self, docs, stream, sizes, ends, owner, array, starts, lo, hi, best) -> None:
        """Each match that begins at ``starts``, grown over one replaced token; the longest of each document and passage is kept."""
        counts = hi - lo
        test = np.repeat(starts, counts)
        place = array.order[np.repeat(lo, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)]
        # Of a match, only its first token counts: where the tokens before agree as well, it began earlier.
        inner = (test > self.begin[test]) & (place > ends[owner[place]] - sizes[owner[place]])
        inner[inner] = self.tokens[test[inner] - 1] == stream[place[inner] - 1]
        for t, p in zip(test[~inner].tolist(), place[~inner].tolist(), strict=True):
            d, who = int(owner[p]), int(self.owner[t])
            a0, b0 = int(self.begin[t]), int(ends[d] - sizes[d])
            a1, b1 = t + int(self.room[t]), int(ends[d])
            run = self.agree(stream, t, p, min(a1 - t, b1 - p))
            after = self.agree(stream, t + run + 1, p + run + 1, min(a1 - t, b1 - p) - run - 1)
            before = self.agree(stream, t - 2, p - 2, min(t - a0, p - b0) - 1, -1)
            # A replaced token is part of the row only if the row goes on behind it.
            rows = [(run, run, p, t)] + ([(run + 1 + after, max(run, after), p, t)] if after else []) + ([(run + 1 + before, max(run, before), p - before - 1, t - before - 1)] if before else [])
            length, verbatim, at, begin = max(rows)
            if length >= self.need:
                row = (length, verbatim, at - b0 + docs[d][1], begin - a0)
                best[d, who] = max(best.get((d, who), row), row, key=lambda r: (r[0], r[1], -r[2], -r[3]))

    def agree(self, stream: np.ndarray, t: int, p: int, most: int, way: int = 1) -> int:
        """How many tokens agree from both places on, forwards or backwards."""
        if most <= 0:
            return 0
        a = self.tokens[t : t + most] if way > 0 else self.tokens[t - most + 1 : t + 1][::-1]
        b = stream[p : p + most] if way > 0 else stream[p - most + 1 : p + 1][::-1]
        differ = np.flatnonzero(a != b)
        return int(differ[0]) if differ.size else most

    def least(self, is_own) -> int:
        """The least number of tokens of the passages' own script in any row that makes a leak, a replaced one less."""
        own = np.concatenate([[0], np.cumsum([is_own(x) for x in self.tokens.tolist()])])
        at = np.flatnonzero(self.room >= self.need)
        return int((own[at + self.need] - own[at]).min()) - 1 if at.size else 1 << 30


def _searching(held, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_words, by_characters = Passages(held.value[True], True), Passages(held.value[False], False)
        longest = max((int(p.room.max(initial=0)) for p in (by_words, by_characters)), default=0)
        least_han = by_characters.least(lambda c: 0x3400 <= c <= 0x9FFF)
        waiting: dict[bool, list] = {True: [], False: []}
        size = {True: 0, False: 0}

        def flush(mode: bool) -> Iterator[pa.RecordBatch]:
            docs, waiting[mode], size[mode] = waiting[mode], [], 0
            if docs and (found := (by_words if mode else by_characters).search(docs)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*[(*k, *v) for k, v in sorted(found.items())], strict=True)], MATCH)

        def put(mode: bool, doc: int, stream: np.ndarray) -> Iterator[pa.RecordBatch]:
            # A text beyond a shard goes in windows that overlap by more than a passage is long, so no row is cut.
            lap = min(shard // 2, max(2 * CHARACTERS, 2 * longest))
            for at in range(0, max(1, stream.size - lap), shard - lap):
                part = stream[at : at + shard]
                waiting[mode].append((doc, at, part))
                size[mode] += part.size
                if size[mode] >= shard:
                    yield from flush(mode)

        for b in bounded(batches, 1):
            spoken: list[tuple[int, list[str]]] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                plain = even(text)
                if by_words.tokens.size and len(w := words(plain)) >= WORDS:
                    spoken.append((doc, w))
                if by_characters.tokens.size and (least_han <= 0 or _HAN.search(plain)):
                    c = characters(plain)
                    if c.size >= CHARACTERS and np.count_nonzero((c >= 0x3400) & (c <= 0x9FFF)) >= least_han:
                        yield from put(False, doc, c)
            for (doc, _), numbers in zip(spoken, hashed([w for _, w in spoken]), strict=True):
                yield from put(True, doc, numbers)
        yield from flush(True)
        yield from flush(False)

    return run


def matches(docs: DataFrame, items: DataFrame, *, shard: int = SHARD, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, length, verbatim, doc_at, item_at`` of the documents holding a long enough row of an item's passage.

    A row is ``WORDS`` words for items whose ``lang`` is English, else ``CHARACTERS`` letters and digits, at most one
    of them replaced. Of each document and item the longest row is told, in these tokens: its length, the longest part of it that is
    verbatim, and the tokens before it in the document and in the passage. Items that share a passage are found together. Null and
    empty texts, and items without a passage long enough, give nothing. Items are searched in blocks whose passages are
    of bounded size; every block against all documents; the corpus isn't shuffled but for the result.
    """
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    items = items.where("text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "lang", "text")
    blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    out = None
    for k in range(blocks):
        own: dict[bool, dict[str, list[int]]] = {True: defaultdict(list), False: defaultdict(list)}
        for r in items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect():
            text = even(passage(r.text))
            english = (r.lang or "").lower().startswith("en") or not r.lang and not _HAN.search(text)
            own[english][text].append(r.item_id)
        held = sc.broadcast({m: [(t, sorted(i)) for t, i in sorted(p.items())] for m, p in own.items()})
        found = texts.mapInArrow(_searching(held, shard), MATCH_DDL)
        out = found if out is None else out.unionByName(found)
    # Windows of one text, and documents or items that come twice, may each tell a row.
    best = F.max(F.struct("length", "verbatim", (-F.col("doc_at")).alias("d"), (-F.col("item_at")).alias("i"))).alias("x")
    rows = out.groupBy("doc_id", "item_id").agg(best)
    return rows.select("doc_id", "item_id", "x.length", "x.verbatim", (-F.col("x.d")).alias("doc_at"), (-F.col("x.i")).alias("item_at"))


def leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``doc_id, item_id`` of the documents in which an item leaked; see ``matches``."""
    return matches(docs, items, **options).select("doc_id", "item_id")


def without_leaks(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents in which no item leaked."""
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
