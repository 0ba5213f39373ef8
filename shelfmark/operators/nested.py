"""Deeply nested JSON records as flat, linked rows.

``StructuralIndex`` finds the structure of many JSON texts at once without a parser: bitmaps of quotes,
brackets and delimiters over the bytes of the whole batch, nesting depth by prefix sums, and from
these the span, the key and the parent of every value. ``flatten_payloads`` walks those spans and
emits one row per child with its parent.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from json.decoder import scanstring

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.plans.runtime import bounded

OPEN, CLOSE, COLON, COMMA, STRING, SCALAR, NODE = 1, 2, 3, 4, 5, 6, 7
_SOLID = re.compile(rb"[^ \t\n\r]")
#: What a string that holds JSON may begin with: its bracket, an escape, or the first byte of U+00A0, U+0085, U+2000 to U+3000 or U+FEFF.
_MAY_HOLD = (b"{", b"[", b"\\", b"\xc2", b"\xe1", b"\xe2", b"\xe3", b"\xef")
_SCALAR = re.compile(rb"-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?|true|false|null|NaN|-?Infinity")

ROWS = pa.schema([("record_id", pa.int64()), ("kind", pa.string()), ("seq", pa.int64()), ("parent_kind", pa.string()), ("parent_seq", pa.int64()), ("name", pa.string())])
ROWS_DDL = "record_id bigint, kind string, seq bigint, parent_kind string, parent_seq bigint, name string"


Value = tuple["StructuralIndex", int]


class StructuralIndex:
    """Values of many JSON texts as spans.

    ``root[i]`` is the value of text ``i``, or -1 if the text isn't JSON. Of a value ``n``: ``what[n]`` is
    ``{``, ``[``, ``"`` or ``s`` (number or word), ``lo[n]:hi[n]`` are its children, ``key(n)`` and ``text(n)`` are decoded on demand.
    """

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.data = b"\n".join(texts) + b"\n"
        self.known: dict[bytes, str] = {}
        #: Of strings that hold JSON, the value they hold.
        self.held: dict[int, Value] = {}
        buf = np.frombuffer(self.data, np.uint8)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        ends = starts + sizes
        at = np.arange(buf.size)

        # Bitmap of the quotes that aren't escaped: those after an even run of backslashes.
        slash = buf == 0x5C
        run_from = np.maximum.accumulate(np.where(slash, -1, at))
        odd_run = np.zeros(buf.size, bool)
        odd_run[1:] = slash[:-1] & ((at[:-1] - run_from[:-1]) % 2 == 1)
        quote = (buf == 0x22) & ~odd_run
        # Inside or outside of strings: parity of the prefix sum, from each text's own start.
        sums = np.cumsum(quote)
        before = np.where(starts > 0, sums[np.maximum(starts - 1, 0)], 0)
        inside = ((sums - np.repeat(before, sizes + 1)) & 1).astype(bool)
        outside = ~inside & ~quote
        outside[ends] = False

        opening, closing = outside & ((buf == 0x7B) | (buf == 0x5B)), outside & ((buf == 0x7D) | (buf == 0x5D))
        structural = opening | closing | (outside & ((buf == 0x3A) | (buf == 0x2C)))
        space = (buf == 0x20) | (buf == 0x0A) | (buf == 0x0D) | (buf == 0x09)
        word = outside & ~structural & ~space
        word_start = word.copy()
        word_start[1:] &= ~word[:-1]
        word_end = np.flatnonzero(word & ~np.concatenate([word[1:], [False]])) + 1
        quotes = np.flatnonzero(quote)
        is_start = inside[quotes]
        string_start = quotes[is_start]
        # A string left open by a cut-off text ends with the text; the text is thrown out below.
        nth = np.flatnonzero(is_start)
        string_end = np.where(nth + 1 < quotes.size, quotes[np.minimum(nth + 1, max(quotes.size - 1, 0))] if quotes.size else 0, buf.size - 1) + 1

        deep = np.cumsum(opening.astype(np.int64) - closing)
        base = np.where(starts > 0, deep[np.maximum(starts - 1, 0)], 0)

        # Tokens; a bracket that opens is also a value on the level above it.
        o, c = np.flatnonzero(opening), np.flatnonzero(closing)
        colon, comma = np.flatnonzero(structural & (buf == 0x3A)), np.flatnonzero(structural & (buf == 0x2C))
        ws = np.flatnonzero(word_start)
        pos = np.concatenate([o, o, c, colon, comma, string_start, ws])
        kind = np.repeat(np.array([NODE, OPEN, CLOSE, COLON, COMMA, STRING, SCALAR]), [o.size, o.size, c.size, colon.size, comma.size, string_start.size, ws.size])
        end = np.concatenate([o, o, c + 1, colon + 1, comma + 1, string_end, word_end])
        text = np.searchsorted(starts, pos, "right") - 1
        depth = deep[pos] - base[text]
        depth[: o.size] -= 1
        depth[2 * o.size : 2 * o.size + c.size] += 1
        order = np.lexsort((kind == OPEN, pos, depth, text))
        pos, kind, end, text, depth = pos[order], kind[order], end[order], text[order], depth[order]
        size = pos.size

        # Each container now lies in one piece: its opening, its members, its closing.
        bad = np.zeros(len(texts), bool)
        bad |= (sums[ends] - before) % 2 == 1
        bad |= deep[ends] - base != 0
        if size:
            np.logical_or.at(bad, text, depth < 0)
        is_open = kind == OPEN
        holder = np.maximum.accumulate(np.where(is_open, np.arange(size), -1)) if size else np.zeros(0, np.int64)
        in_object = np.zeros(size, bool)
        level0 = depth == 0
        if size:
            first = buf[pos[np.maximum(holder, 0)]]
            in_object = (holder >= 0) & (first == 0x7B) & ~level0
            closes = kind == CLOSE
            np.logical_or.at(bad, text[closes], np.where(first[closes] == 0x7B, buf[pos[closes]] != 0x7D, buf[pos[closes]] != 0x5D) | (holder[closes] < 0))
        value = (kind == STRING) | (kind == SCALAR) | (kind == NODE)
        prev = np.concatenate([[0], kind[:-1]])
        same = np.concatenate([[False], (text[1:] == text[:-1]) & (depth[1:] == depth[:-1])])
        prev = np.where(same, prev, 0)
        is_key = in_object & (kind == STRING) & ((prev == OPEN) | (prev == COMMA))
        prev_value = np.concatenate([[False], (value & ~is_key)[:-1]]) & same
        prev_key = np.concatenate([[False], is_key[:-1]]) & same
        good = np.where(
            level0, value & ~same,
            np.select(
                [kind == OPEN, kind == CLOSE, kind == COLON, kind == COMMA, is_key],
                [(prev == 0) | (prev == CLOSE), (prev == OPEN) | prev_value, in_object & prev_key, prev_value, np.ones(size, bool)],
                np.where(in_object, prev == COLON, (prev == OPEN) | (prev == COMMA)) & value,
            ),
        )
        np.logical_or.at(bad, text, ~good)
        control = inside & (buf < 0x20)
        if control.any():
            bad[np.searchsorted(starts, np.flatnonzero(control), "right") - 1] = True
        for k in np.flatnonzero(kind == SCALAR).tolist():
            if not _SCALAR.fullmatch(self.data, pos[k], end[k]):
                bad[text[k]] = True

        # Values with their keys, children and parents.
        node = np.flatnonzero(value & ~is_key)
        serial = np.full(size, -1)
        serial[node] = np.arange(node.size)
        keyed = in_object[node]
        key_token = np.where(keyed, node - 2, -1)
        self.key_start = np.where(keyed, pos[key_token] + 1, -1).tolist()
        self.key_end = np.where(keyed, end[key_token] - 1, -1).tolist()
        self.start, self.end = pos[node].tolist(), end[node].tolist()
        self.what = [chr(x) if k == NODE else '"' if k == STRING else "s" for x, k in zip(buf[pos[node]].tolist(), kind[node].tolist(), strict=True)]
        # Members of a container are neighbours, so a container's children are a range of values.
        self.lo, self.hi = np.zeros(node.size, np.int64), np.zeros(node.size, np.int64)
        opens = np.flatnonzero(is_open)
        if opens.size:
            up_to = np.cumsum(serial >= 0)
            shut = np.minimum(np.searchsorted(np.flatnonzero(kind == CLOSE), opens), max((kind == CLOSE).sum() - 1, 0))
            close_at = np.flatnonzero(kind == CLOSE)[shut] if (kind == CLOSE).any() else opens
            proxy = np.flatnonzero(kind == NODE)
            of_open = serial[proxy[np.argsort(pos[proxy], kind="stable")]][np.searchsorted(np.sort(pos[proxy]), pos[opens])]
            self.lo[of_open], self.hi[of_open] = up_to[opens], up_to[close_at]
        self.lo, self.hi = self.lo.tolist(), self.hi.tolist()
        self.root = np.full(len(texts), -1)
        top = node[level0[node]]
        self.root[text[top]] = serial[top]
        self.root[bad] = -1
        self.root = self.root.tolist()

    def _decode(self, a: int, b: int) -> str:
        raw = self.data[a:b]
        # Keys and names come again and again within a batch.
        if (text := self.known.get(raw)) is None:
            text = raw.decode("utf-8", "replace")
            if "\\" in text:
                try:
                    text = scanstring(text + '"', 0)[0]
                except ValueError:
                    pass
            self.known[raw] = text
        return text

    def key(self, n: int) -> str:
        return self._decode(self.key_start[n], self.key_end[n])

    def text(self, n: int) -> str:
        return self._decode(self.start[n] + 1, self.end[n] - 1) if self.what[n] == '"' else self.data[self.start[n] : self.end[n]].decode()

    def first_byte(self, n: int) -> bytes:
        """The first byte of a string that isn't white space, or that begins a character outside ASCII or an escape, which may be."""
        at = _SOLID.search(self.data, self.start[n] + 1, self.end[n] - 1)
        return at[0] if at else b""




class Forest:
    """Values of a batch of texts; text that holds JSON counts as that JSON."""

    def __init__(self, texts: list[bytes]):
        self.index = StructuralIndex(texts)
        level = self.index
        while True:
            inner = [n for n, k in enumerate(level.what) if k == '"' and level.first_byte(n) in _MAY_HOLD]
            decoded = [(n, t) for n in inner if (t := level.text(n).strip().lstrip("\ufeff").strip())[:1] in ("{", "[")]
            if not decoded:
                break
            below = StructuralIndex([t.encode("utf-8", "surrogatepass") for _, t in decoded])
            level.held = {n: (below, r) for (n, _), r in zip(decoded, below.root, strict=True) if r >= 0}
            level = below

    def open(self, v: Value) -> Value:
        while (inner := v[0].held.get(v[1])) is not None:
            v = inner
        return v

    def blank(self, v: Value) -> bool:
        ix, n = v = self.open(v)
        if ix.what[n] in "{[":
            return ix.lo[n] == ix.hi[n]
        return not (t := ix.text(n)).strip() or (ix.what[n] == "s" and t == "null")

    def members(self, v: Value) -> list[tuple[str, Value]]:
        ix, n = v
        if not ix.held:
            return [(ix.key(c), (ix, c)) for c in range(ix.lo[n], ix.hi[n])]
        return [(ix.key(c), self.open((ix, c))) for c in range(ix.lo[n], ix.hi[n])]

    def elements(self, v: Value) -> list[Value]:
        """The list's elements that hold something; a lone object or text is a list of one."""
        ix, n = v = self.open(v)
        found = [self.open((ix, c)) for c in range(ix.lo[n], ix.hi[n])] if ix.what[n] == "[" else [v]
        return [x for x in found if not self.blank(x)]

    def is_object(self, v: Value) -> bool:
        return v[0].what[v[1]] == "{"

    def is_list(self, v: Value) -> bool:
        return v[0].what[v[1]] == "["


# The names under which feeds file what a child is called and what it holds.
COLOR_NAME, COLOR_LIST = ("color", "colour", "name", "label"), ("options", "colors", "colours")
SIZE_NAME, SIZE_LIST, SYSTEM_LIST = ("size", "label", "name"), ("skus", "sizes", "values"), ("systems",)
DIMENSION_NAME, DIMENSION_LIST = ("axis", "name", "label"), ("dims", "dimensions")
GROUP_NAME, GROUP_LIST = ("group",), ("items", "parameters")
PARAMETER_NAME, PARAMETER_VALUE = ("name", "key", "k"), ("value", "val", "v")
POLICY_NAME, POLICY_LIST = ("policy", "type", "name"), ("policies",)
CONDITION_NAME, CONDITION_LIST = ("text", "condition", "name", "label"), ("conditions", "terms")
REGION_NAME, REGION_LIST = ("region", "name", "label"), ("regions",)


class Walk:
    """The children of one record, in order, as rows ``kind, seq, parent_kind, parent_seq, name``."""

    def __init__(self, forest: Forest):
        self.f = forest
        self.seen: Counter[str] = Counter()
        self.rows: list[tuple[str, int, str, int, str]] = []

    def emit(self, kind: str, parent: tuple[str, int], name: str) -> tuple[str, int]:
        self.seen[kind] += 1
        self.rows.append((kind, self.seen[kind], *parent, name))
        return kind, self.seen[kind]

    def first(self, own: dict[str, Value], names: tuple[str, ...]) -> Value | None:
        return next((own[k] for k in names if k in own and not self.f.blank(own[k])), None)

    def named(self, v: Value, names: tuple[str, ...]) -> tuple[str | None, dict[str, Value]]:
        """What a child is called, and its fields; fields of an object that stands as the name come along."""
        fields: dict[str, Value] = {}
        while self.f.is_object(v):
            own = dict(self.f.members(v))
            fields |= own
            if (inner := self.first(own, names)) is None:
                return None, fields
            v = inner
        return (None if self.f.is_list(v) or self.f.blank(v) else v[0].text(v[1])), fields

    def each(self, v: Value | None, wrappers: tuple[str, ...]) -> list[Value]:
        while v is not None:
            v = self.f.open(v)
            own = dict(self.f.members(v)) if self.f.is_object(v) else {}
            inside = next((own[k] for k in wrappers if k in own), None)
            if inside is None or not (self.f.is_object(inside) or self.f.is_list(inside)):
                return self.f.elements(v)
            v = inside
        return []

    def record(self, root: Value) -> list[tuple[str, int, str, int, str]]:
        if self.f.is_object(root):
            own, top = dict(self.f.members(root)), ("record", 0)
            for v in self.named_colors(own.get("colors")):
                self.color(v, top)
            self.sizes(own.get("sizes"), top)
            if (v := own.get("parameters")) is not None:
                # Groups may lie in groups, as deep as a record goes: the open ones are a stack of their own.
                open_groups = [self.parameters(v, top)]
                while open_groups:
                    if (inner := next(open_groups[-1], None)) is None:
                        open_groups.pop()
                    else:
                        open_groups.append(inner)
            self.policies(own.get("after_sales"), top)
        return self.rows

    def named_colors(self, v: Value | None) -> list[Value]:
        return self.each(v, COLOR_LIST)

    def color(self, v: Value, top: tuple[str, int]) -> None:
        name, own = self.named(v, COLOR_NAME)
        at = self.emit("color", top, name) if name is not None else top
        for k in SIZE_LIST:
            if k in own:
                self.sizes(own[k], at)

    def sizes(self, v: Value | None, parent: tuple[str, int]) -> None:
        for x in self.each(v, SYSTEM_LIST):
            own = dict(self.f.members(x)) if self.f.is_object(x) else {}
            if "system" in own:
                name, _ = self.named(own["system"], ("system", "name", "label"))
                at = self.emit("size_system", parent, name) if name is not None else parent
                for k in SIZE_LIST:
                    if k in own:
                        for y in self.f.elements(own[k]):
                            self.size(y, at)
            else:
                self.size(x, parent)

    def size(self, v: Value, parent: tuple[str, int]) -> None:
        name, own = self.named(v, SIZE_NAME)
        if name is None:
            return
        at = self.emit("size", parent, name)
        for k in DIMENSION_LIST:
            for x in self.each(own.get(k), ()):
                axis, _ = self.named(x, DIMENSION_NAME)
                if axis is not None:
                    self.emit("dimension", at, axis)

    def parameters(self, v: Value, parent: tuple[str, int]) -> Iterator[Iterator]:
        """Emits the parameters of a value; yields each group inside it, to be gone through before the rest."""
        for x in self.f.elements(v):
            if not self.f.is_object(x):
                if not self.f.is_list(x):
                    self.emit("parameter", parent, x[0].text(x[1]))
                continue
            own = dict(self.f.members(x))
            inside = next((own[k] for k in GROUP_LIST if k in own), None)
            label = next((own[k] for k in PARAMETER_NAME if k in own), None)
            held = next((own[k] for k in PARAMETER_VALUE if k in own), None)
            if any(k in own for k in GROUP_NAME) and inside is not None:
                name, _ = self.named(own[GROUP_NAME[0]], ("name", "label"))
                yield self.parameters(inside, self.emit("group", parent, name) if name is not None else parent)
            elif label is not None and held is not None and len(own) <= 3 and not self.f.is_object(label) and not self.f.is_list(label):
                if not self.f.blank(label):
                    self.parameter(label[0].text(label[1]), held, parent)
            else:
                for k, y in self.f.members(x):
                    if k.strip():
                        if self.f.is_object(y) and not self.is_amount(y) and not self.f.blank(y):
                            yield self.parameters(y, self.emit("group", parent, k))
                        else:
                            self.parameter(k, y, parent)

    def is_amount(self, v: Value) -> bool:
        own = {k for k, _ in self.f.members(v)}
        return "unit" in own and bool(own & {"amount", "value"})

    def parameter(self, name: str, v: Value, parent: tuple[str, int]) -> None:
        at = self.emit("parameter", parent, name)
        if self.f.is_list(v):
            for x in self.f.elements(v):
                text = " ".join(y[0].text(y[1]) for _, y in self.f.members(x) if not self.f.blank(y) and y[0].what[y[1]] not in "{[") if self.f.is_object(x) else self.named(x, ())[0]
                if text:
                    self.emit("option", at, text)

    def policies(self, v: Value | None, top: tuple[str, int]) -> None:
        for x in self.each(v, POLICY_LIST):
            if not self.f.is_object(x) or any(k in POLICY_NAME for k, _ in self.f.members(x)):
                name, own = self.named(x, POLICY_NAME)
                self.policy(name, own, top)
            else:
                for k, y in self.f.members(x):
                    if k.strip() and not (k == "version" and y[0].what[y[1]] == "s"):
                        self.policy(k, dict(self.f.members(y)) if self.f.is_object(y) else {}, top)

    def policy(self, name: str | None, own: dict[str, Value], top: tuple[str, int]) -> None:
        if name is None:
            return
        at = self.emit("policy", top, name)
        for k in CONDITION_LIST:
            for x in self.each(own.get(k), ()):
                text, more = self.named(x, CONDITION_NAME)
                if text is None:
                    continue
                under = self.emit("condition", at, text)
                for r in REGION_LIST:
                    for y in self.each(more.get(r), ()):
                        region, _ = self.named(y, REGION_NAME)
                        if region is not None:
                            self.emit("region", under, region)


def _flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # The index takes some sixty bytes for each byte of text.
    for batch in bounded(batches, 1, 1 << 20):
        ids = batch.column(0).to_pylist()
        forest = Forest([(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()])
        out: list[tuple] = []
        for i, r in zip(ids, forest.index.root, strict=True):
            if r >= 0:
                out += [(i, *row) for row in Walk(forest).record((forest.index, r))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), ROWS, strict=True)], schema=ROWS)


def flatten_payloads(df: DataFrame, key: str = "record_id", payload: str = "payload") -> DataFrame:
    """Every child of every JSON payload as ``record_id, kind, seq, parent_kind, parent_seq, name``.

    Null, empty and cut-off payloads, and payloads that aren't an object, give no rows. A record's
    rows depend on the record alone, so there is no shuffle; records that come twice each give theirs.
    A parameter with a blank value is still a parameter, as it has a name; null, empty and blank
    elements of lists are left out and take no number. Columns besides the two named aren't read.
    """
    return df.select(F.col(key).cast("bigint").alias("record_id"), F.col(payload).alias("payload")).mapInArrow(_flatten, ROWS_DDL)
