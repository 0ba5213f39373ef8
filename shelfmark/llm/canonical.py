"""Problem 3: freely typed values to the entries of a reference list.

Every entry's names stand in a BK-tree under the unrestricted Damerau-Levenshtein distance, which is a
true metric; the triangle inequality prunes the search and every name within the radius is found.
A list beyond ``SHARD_FORMS`` names is cut into shards that are broadcast one after another. A shard decides
nothing: it returns what each lookup finds in it, and the entry is decided on the finds of all shards.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.glyphs import fold, latin

UNMATCHED = "UNMATCHED"
#: Names broadcast at once, a few MB; more are searched shard by shard.
SHARD_FORMS = 50_000


def distance(a: str, b: str) -> int:
    """Edits from one text to the other: insert, delete, replace, swap of neighbours, also with edits between them."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if not n or not m:
        return n + m
    far = n + m
    last: dict[str, int] = {}
    rows = [[far] * (m + 2), [far, *range(m + 1)]]
    for i in range(1, n + 1):
        row = [far, i] + [0] * m
        above, x, hit = rows[i], a[i - 1], 0
        for j in range(1, m + 1):
            y = b[j - 1]
            k, had = last.get(y, 0), hit
            cost = 1
            if x == y:
                cost, hit = 0, j
            best = above[j] + cost
            if row[j] + 1 < best:
                best = row[j] + 1
            if above[j + 1] + 1 < best:
                best = above[j + 1] + 1
            if k and had and (swap := rows[k][had] + (i - k - 1) + 1 + (j - had - 1)) < best:
                best = swap
            row[j + 1] = best
        rows.append(row)
        last[x] = i
    return rows[n + 1][m + 1]


def apart(letters: Counter, n: int, b: str) -> int:
    """Edits at least needed from a text of ``n`` letters: order aside, each edit mends one letter."""
    left, common = dict(letters), 0
    for c in b:
        if left.get(c, 0):
            left[c] -= 1
            common += 1
    return max(n, len(b)) - common


class BKTree:
    """Texts under ``distance``; ``within`` returns every text at most ``radius`` away.

    ``nodes`` are plain data, each a text and the places of the nodes below it by their distance, so a tree built once can be sent on.
    """

    def __init__(self, words: list[str] | None = None, nodes: list[tuple[str, dict[int, int]]] | None = None):
        self.nodes = [] if nodes is None else nodes
        for w in sorted(set(words or ())):
            if not self.nodes:
                self.nodes.append((w, {}))
                continue
            at = 0
            while (d := distance(w, self.nodes[at][0])) in self.nodes[at][1]:
                at = self.nodes[at][1][d]
            if d:
                self.nodes[at][1][d] = len(self.nodes)
                self.nodes.append((w, {}))

    def within(self, word: str, radius: int, known: dict[str, int] | None = None) -> list[tuple[int, str]]:
        """``known`` keeps the distances from ``word`` between searches of growing radius."""
        known = {} if known is None else known
        found, stack = [], [0] if self.nodes else []
        letters = Counter(word)
        while stack:
            w, below = self.nodes[stack.pop()]
            if not below and apart(letters, len(word), w) > radius:
                # Nothing hangs below, and the letters alone put it out of reach.
                continue
            if (d := known.get(w)) is None:
                d = known[w] = distance(word, w)
            if d <= radius:
                found.append((d, w))
            # |d(word, w) - d(w, x)| <= d(word, x): other subtrees can't hold a text within the radius.
            stack += [below[k] for k in range(d - radius, d + radius + 1) if k in below]
        return found


_HAN = "㐀-䶿一-鿿豈-﫿"
_RUNS = re.compile(f"[{_HAN}]+|[^{_HAN}]+")
_BREAK = re.compile(r"[/>|,;、()\[\]【】{}<:：《》「」]+")
_NOISE = re.compile(r"[\W_]+")


_MARKS, _FOREIGN, _GAP = re.compile("[®™©℠]"), re.compile("[Ͱ-ϿЀ-ԯ]"), re.compile(r"(\W+)")


def plain(value: str) -> str:
    """Lower case in one form of characters, signs for trademarks dropped, look-alike letters as Latin ones."""
    text = _MARKS.sub("", fold(value) or "")
    if _FOREIGN.search(text):
        text = "".join(latin(t) or t for t in _GAP.split(text))
    return unicodedata.normalize("NFKC", text).casefold().strip()


def squeezed(text: str) -> str:
    return _NOISE.sub("", text)


def is_han(text: str) -> bool:
    return bool(re.search(f"[{_HAN}]", text))


def radius(text: str, parts: bool) -> int:
    """Edits allowed: none in words too short to bear one, nor in proper names of a few Han characters,
    where another character or another order is another name."""
    n = len(text)
    if is_han(text):
        return 0 if n < 3 or not parts and n < 5 else 1 if n < 5 else 2
    return 0 if n < 4 else 1 if n < 8 else 2


class Matcher:
    """The entry a value means. ``names`` holds each name's entry; ``families`` are the words of wider classes,
    which say nothing about the entry; ``parts`` tells whether a piece of a Han name, or more than
    it, may stand for it (true of kinds of goods, false of proper names)."""

    def __init__(self, names: list[tuple[str, str]], families: list[str], parts: bool, built: tuple[dict[str, set[str]], list] | None = None):
        if built is None:
            self.of: dict[str, set[str]] = {}
            for name, entry in names:
                if form := squeezed(plain(name)):
                    self.of.setdefault(form, set()).add(entry)
            self.tree = BKTree(list(self.of))
        else:
            self.of, self.tree = built[0], BKTree(nodes=built[1])
        self.parts = parts
        self.families = {squeezed(plain(f)) for f in families}
        self.longest = max(map(len, self.of), default=0)
        self.ends: dict[str, set[str]] = {}
        for form, entries in self.of.items():
            if parts and is_han(form):
                for k in range(2, len(form)):
                    self.ends.setdefault(form[-k:], set()).update(entries)
                    if k >= 3:
                        self.ends.setdefault(form[:k], set()).update(entries)

    def closest(self, text: str, r: int) -> tuple[int, dict[str, set[str]]] | None:
        """Edits to the closest names within ``r``, and the entries of each; None if there is none. A name itself is looked up at once."""
        if text in self.of:
            return 0, {text: self.of[text]}
        known: dict[str, int] = {}
        for k in sorted({min(1, r), r} - {0}):
            if found := self.tree.within(text, k, known):
                best = min(d for d, _ in found)
                return best, {w: self.of[w] for d, w in found if d == best}
        return None

    def ended(self, text: str) -> set[str]:
        """The entries of the names that end, or begin, with the text."""
        return self.ends.get(text, set())

    def near(self, text: str, r: int) -> tuple[float, str] | None:
        """Cost and entry of the closest name; None if none is within ``r`` or the closest mean different entries."""
        if not text or len(text) > self.longest + r or not (hit := self.closest(text, r)):
            return None
        best, names = hit
        entries = set().union(*names.values())
        if len(entries) > 1:
            # Letters left out or put in are nearer to what is meant than letters replaced.
            entries = set().union(*(e for w, e in names.items() if abs(len(w) - len(text)) == best))
        return (best, entries.pop()) if len(entries) == 1 else None

    def inside(self, text: str) -> tuple[float, str] | None:
        """The longest name that stands in the text; of the same length, the one nearer its end."""
        n = len(text)
        for size in range(min(n, self.longest), 1, -1):
            for at in range(n - size, -1, -1):
                if hit := self.near(text[at : at + size], 0):
                    return hit
        return None

    def one(self, text: str) -> list[tuple[float, str]]:
        """Costs and entries of a piece of a value."""
        out = []
        if hit := self.near(text, radius(text, self.parts)):
            out.append(hit)
        if is_han(text) and not (out and out[0][0] == 0):
            if hit := self.inside(text):
                out.append((0.5, hit[1]))
            if self.parts:
                if len(e := self.ended(text)) == 1:
                    out.append((0.8, next(iter(e))))
                for t in (text, text[:-1]):
                    if 4 <= len(t) <= self.longest and len({h[1] for k in range(1, len(t)) if (h := self.near(t[k:] + t[:k], 0))}) == 1:
                        out.append((0.9, next(h[1] for k in range(1, len(t)) if (h := self.near(t[k:] + t[:k], 0)))))
                if len(text) >= 6 and (hit := self.shortened(text)):
                    out.append((2.5, hit))
        return out

    def shortened(self, text: str) -> str | None:
        """The entry of which a name of four or more characters remains when a stretch of the text is left out."""
        found = {h[1] for size in range(max(2, len(text) - self.longest), len(text) - 3) for at in range(1, len(text) - size) if (h := self.near(text[:at] + text[at + size :], 0))}
        return found.pop() if len(found) == 1 else None

    def entry(self, value: str) -> str:
        text = plain(value)
        pieces = [p for p in _BREAK.split(text) if squeezed(p)]
        tried: list[tuple[float, str]] = []
        whole = squeezed(text)
        if whole and not is_han(whole) and (hit := self.near(whole, radius(whole, self.parts))):
            return hit[1]
        for p in pieces:
            for run in _RUNS.findall(p):
                words = [run, *re.split(r"[\s\-_·.']+", run)] if not is_han(run) or re.search(r"\s", run) else [run]
                for w in dict.fromkeys(map(squeezed, words)):
                    if w and w not in self.families:
                        tried += self.one(w)
            if is_han(p) and (w := squeezed(p)) not in self.families and (hit := self.near(w, radius(w, self.parts))):
                tried.append(hit)
            for w in re.split(r"[\s\-]+", p):
                if is_han(w) and (s := squeezed(w)) and s not in self.families:
                    tried += self.one(s)
        if not tried:
            return UNMATCHED
        best = min(c for c, _ in tried)
        entries = {e for c, e in tried if c == best}
        return entries.pop() if len(entries) == 1 else UNMATCHED


#: A find: the text looked up, the radius (``_ENDED`` for ends of names), the edits, the name found, its entries.
Find = tuple[str, int, int, str, list[str]]
_ENDED = -1
_FINDS = pa.list_(pa.struct([("text", pa.string()), ("radius", pa.int64()), ("edits", pa.int64()), ("name", pa.string()), ("entries", pa.list_(pa.string()))]))
_FINDS_DDL = "array<struct<text:string,radius:bigint,edits:bigint,name:string,entries:array<string>>>"


class Shard(Matcher):
    """Some names of a list. No lookup is answered while a value is read, so every lookup that a
    reading can come to is made, whatever other shards hold."""

    def finds(self, value: str) -> list[Find]:
        self.asked: dict[tuple[str, int], list[Find]] = {}
        self.entry(value)
        return [f for found in self.asked.values() for f in found]

    def closest(self, text: str, r: int) -> None:
        if (text, r) not in self.asked:
            best, names = super().closest(text, r) or (0, {})
            self.asked[text, r] = [(text, r, best, w, sorted(e)) for w, e in names.items()]

    def ended(self, text: str) -> set[str]:
        if e := super().ended(text):
            self.asked[text, _ENDED] = [(text, _ENDED, 0, text, sorted(e))]
        return set()


class Recalled(Matcher):
    """Answers a value's lookups from the finds of all shards as one tree of all names would."""

    def __init__(self, finds: list[Find], families: list[str], parts: bool):
        super().__init__([], families, parts)
        self.found: dict[tuple[str, int], tuple[int, dict[str, set[str]]]] = {}
        for text, r, edits, name, entries in finds:
            best, names = self.found.get((text, r), (edits, {}))
            if edits < best:
                best, names = edits, {}
            if edits == best:
                names.setdefault(name, set()).update(entries)
            self.found[text, r] = best, names
        self.longest = max((len(text) for text, _ in self.found), default=0)

    def closest(self, text: str, r: int) -> tuple[int, dict[str, set[str]]] | None:
        return self.found.get((text, r))

    def ended(self, text: str) -> set[str]:
        return set().union(*self.found.get((text, _ENDED), (0, {}))[1].values())


def _finding(make: Callable[[], Shard]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys = make(), [f.name for f in _FINDS.value_type]
        for b in batches:
            finds = [[dict(zip(keys, f, strict=True)) for f in shard.finds(v)] for v in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(finds, _FINDS)], ["value", "finds"])

    return run


def _recalling(families: list[str], parts: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, finds = b.column(0), ([tuple(f.values()) for f in of] for of in b.column(1).to_pylist())
            entries = [Recalled(f, families, parts).entry(v) for v, f in zip(values.to_pylist(), finds, strict=True)]
            yield pa.RecordBatch.from_arrays([values, pa.array(entries, pa.string())], ["value", "canonical"])

    return run


def _matching(make: Callable[[], Matcher]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = make()
        for b in batches:
            values = b.column(0)
            yield pa.RecordBatch.from_arrays([values, pa.array([matcher.entry(v) for v in values.to_pylist()], pa.string())], ["value", "canonical"])

    return run


def match_values(values: DataFrame, names: DataFrame, families: list[str], *, parts: bool, shard_forms: int = SHARD_FORMS) -> DataFrame:
    """``value, canonical`` for each distinct ``value``; ``canonical`` is ``UNMATCHED`` where no entry is meant.

    ``names`` has ``name, entry``. Null values are left out. An empty list leaves all unmatched. Two
    entries equally close leave the value unmatched rather than decide by chance.
    """
    sc = values.sparkSession.sparkContext
    # Few bytes but much work: the number of tasks is set by the cores, not left to the size of the shuffle.
    tasks = max(2 * sc.defaultParallelism, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    distinct = values.where("value is not null").select("value").distinct().repartition(tasks)
    names = names.where("name is not null and entry is not null").select("name", "entry").distinct()
    shards = max(1, -(-names.count() // shard_forms))

    def held(k: int):
        # At most about ``shard_forms`` names reach the driver at a time; their tree is built there, once for all tasks.
        built = Matcher([(r.name, r.entry) for r in names.where(F.pmod(F.xxhash64("name"), F.lit(shards)) == k).collect()], [], False)
        return sc.broadcast((built.of, built.tree.nodes))

    if shards == 1:
        return distinct.mapInArrow(_matching(lambda tree=held(0): Matcher([], families, parts, tree.value)), "value string, canonical string")
    found = [distinct.mapInArrow(_finding(lambda tree=held(k): Shard([], families, parts, tree.value)), f"value string, finds {_FINDS_DDL}") for k in range(shards)]
    of_all = reduce(DataFrame.unionByName, found).groupBy("value").agg(F.flatten(F.collect_list("finds")).alias("finds"))
    return of_all.mapInArrow(_recalling(families, parts), "value string, canonical string")


def canonical_values(rows: DataFrame, key: str, field: str, names: DataFrame, entries: DataFrame, families: list[str], *, parts: bool) -> DataFrame:
    """``idx, field, canonical`` of the rows whose value is neither null nor blank nor an entry as it stands.

    ``entries`` has the one column ``entry``. Each distinct value is searched once, however many rows hold it.
    """
    typed = rows.select(F.col(key).alias("idx"), F.col(field).alias("value")).where(F.col("value").isNotNull() & ~F.col("value").rlike(r"^[\s\p{Z}\p{Cf}]*$"))
    typed = typed.join(entries.select(F.col("entry").alias("value")).distinct(), "value", "left_anti")
    return typed.join(match_values(typed, names, families, parts=parts), "value").select("idx", F.lit(field).alias("field"), "canonical")
