"""Problems 6 and 8: a corpus as token ids, and long texts in pieces under a token limit.

Texts are encoded as a tree: halves on their own, neighbours joined. Joining is exact. The pattern that splits text before
the merges has places where a match ends whatever stands around them (see ``stable``): left of the last such place before a seam,
and right of the first behind it, no token can change. The window between the two, grown outwards from the seam until
they are met, is encoded again. Decoding joins the bytes of the halves in the same way.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.plans.runtime import bounded

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the public rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a leaf; shorter texts are leaves themselves.
LEAF = 512


def stable(text: str, at: int) -> bool:
    """Whether every split of a text that holds these two neighbours has a boundary between them.

    Each match of the pattern is white space, or ends in letters, in numbers, or in other signs, with at most one space in
    front. So none goes on from a sign into white space, from a letter into what isn't one, or from a number into what isn't one.
    """
    before, after = text[at - 1], text[at]
    if before.isspace() or unicodedata.category(after) in ("Cn", "Co"):
        return False
    if after in " \n\r\t":
        return True
    kind = unicodedata.category(before)[0]
    return kind in "LN" and unicodedata.category(after)[0] != kind


class Encoder:
    """Ids of texts under byte-level merges. ``ranks`` is the content of a public rank file."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN, leaf: int = LEAF):
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.core = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        self.sizes = np.zeros(max(merges.values()) + 1, np.int64)
        self.bytes = {rank: token for token, rank in merges.items()}
        for token, rank in merges.items():
            self.sizes[rank] = len(token)
        self.leaf = max(leaf, 2)

    def encode(self, text: str | None) -> list[int]:
        return self.ids(text or "").tolist()

    def ids(self, text: str) -> np.ndarray:
        return self.tree(text, 0, len(text)) if text else np.zeros(0, np.uint32)

    def flat(self, text: str) -> np.ndarray:
        """The ids of a text encoded at once."""
        return self.core.encode_to_numpy(text, disallowed_special=())

    def tree(self, text: str, a: int, b: int) -> np.ndarray:
        """Ids of ``text[a:b]``."""
        if b - a <= self.leaf:
            return self.flat(text[a:b])
        mid = (a + b) // 2
        return self.join(text, a, mid, b, self.tree(text, a, mid), self.tree(text, mid, b))

    def join(self, text: str, a: int, mid: int, b: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of two neighbours as one: what lies outside the window around their seam stays."""
        p, q = mid - 1, mid + 1
        while p > a and not stable(text, p):
            p -= 1
        while q < b and not stable(text, q):
            q += 1
        p, q = max(p, a), min(q, b)
        head, tail = left[: len(left) - self.covering(left[::-1], text[p:mid])], right[self.covering(right, text[mid:q]) :]
        return np.concatenate([head, self.flat(text[p:q]), tail])

    def covering(self, ids: np.ndarray, text: str) -> int:
        """How many ids, from the first on, hold the text; a boundary of the split is one of tokens too."""
        size = len(text.encode())
        return int(np.searchsorted(np.cumsum(self.sizes[ids[:size]]), size, "left")) + 1 if size else 0

    def raw(self, ids: list[int]) -> bytes:
        """The bytes of ids, joined up the tree."""
        if len(ids) <= self.leaf:
            return b"".join([self.bytes[i] for i in ids])
        mid = len(ids) // 2
        return self.raw(ids[:mid]) + self.raw(ids[mid:])

    def decode(self, ids: list[int]) -> str:
        """The text of ids; a character may be spread over several of them, so bytes become text only at the root."""
        return self.raw(ids).decode()


def _encoding(held, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(held.value, leaf=leaf)
        for b in bounded(batches, 1):
            ids = [encoder.ids(t or "") for t in b.column(1).to_pylist()]  # one array a text, no Python number a token
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([i.size for i in ids], out=offsets[1:])
            flat = np.concatenate(ids).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "ids"])

    return run


def _ranks(df: DataFrame, tokenizer: str):
    """The rank file, under 1 MB, is read by the driver and broadcast, so executors need no copy."""
    with open(tokenizer, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def token_ids(docs: DataFrame, tokenizer: str = TOKENIZER, *, leaf: int = LEAF) -> DataFrame:
    """``doc_id, ids``: each text's ids without special tokens; an empty list for null and for empty text.

    Strings that look like special tokens are ordinary text. One pass over the rows, no shuffle.
    """
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_encoding(_ranks(docs, tokenizer), leaf), "doc_id bigint, ids array<int>")


def _decoding(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(held.value)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([encoder.decode(i or []) for i in part.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return run


def texts_of(ids: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``: the way back; null and empty lists give the empty text."""
    return ids.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(_decoding(_ranks(ids, tokenizer)), "doc_id bigint, text string")
