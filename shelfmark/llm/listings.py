"""Problem 4: listings of the same product in different words.

Title, description and parameters are read as words, numbers joined to the word before them (a maker's
series and number, of whatever shape), what follows such a number (its edition), quantities in base units, and the
maker. A listing that names no number is known by its words. The tokens are weighed by their rarity over all
listings; listings with equal sets form a class; the classes are joined by weighted containment with prefix,
length and positional filters, checked exactly, and grouped into stars.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.canonical import UNMATCHED, match_values, plain
from shelfmark.plans.runtime import bounded, cut

# Units in base units of their dimension.
UNITS = {
    "kg": ("g", 1000), "千克": ("g", 1000), "公斤": ("g", 1000), "g": ("g", 1), "克": ("g", 1), "斤": ("g", 500),
    "l": ("ml", 1000), "升": ("ml", 1000), "ml": ("ml", 1), "毫升": ("ml", 1),
    "m": ("mm", 1000), "米": ("mm", 1000), "cm": ("mm", 10), "厘米": ("mm", 10), "mm": ("mm", 1), "毫米": ("mm", 1),
    "w": ("w", 1), "瓦": ("w", 1), "kw": ("w", 1000), "千瓦": ("w", 1000),
    "mah": ("mah", 1), "毫安时": ("mah", 1), "毫安": ("mah", 1), "ah": ("mah", 1000), "安时": ("mah", 1000),
    "lm": ("lm", 1), "流明": ("lm", 1), "gb": ("gb", 1), "tb": ("gb", 1000), "inch": ("in", 1), "英寸": ("in", 1),
}
# Words that tell editions of one model apart, and Chinese words and numerals for the same.
EDITIONS = ("pro max", "pro", "max", "mini", "plus", "lite", "ultra", "se", "air", "fe")
VERSIONS = {"迷你": "mini", "专业": "pro", "青春": "lite"}
NUMERALS = {"一": "1", "二": "2", "两": "2", "三": "3", "四": "4", "五": "5", "六": "6"}
# What is counted rather than measured; a number before it names no model.
COUNTED = "次遍周天年月日个件只条台套层档分秒折元位人"
MAKER_KEYS = ("brand", "品牌")

_UNIT = "|".join(sorted(UNITS, key=len, reverse=True))
_VALUE = re.compile(rf"(?<![a-z\d.])(\d+(?:\.\d+)?)\s*({_UNIT})(?![a-z])")
_EDITION = re.compile(rf"[\s\-]*(?:({'|'.join(e.replace(' ', chr(92) + 's+') for e in EDITIONS)})(?![a-z])|(?:gen|mk|ver)[\s.\-]*(\d+)|第?\s*([{''.join(NUMERALS)}]|\d)\s*代|({'|'.join(VERSIONS)})版)")
#: A word, or the last two characters of a Han run, with the number it carries: "wh-1000xm5", "iphone 15", "v15".
_CODE = re.compile(r"((?<![a-z])(?!(?:gen|mk|ver|x)[\s.\-]*\d)[a-z]+|[一-鿿]{2})[\s\-]*(\d+(?:[a-z]+\d+)*(?:[a-z](?![a-z]))?)(?!\d|\.\d)")
#: Small numbers that count: before a measure word, and in prose before a plural.
_COUNT, _PLURAL = re.compile(rf"(?<!\d)\d{{1,3}}[{COUNTED}]"), re.compile(r"\b\d{1,3}\s+[a-z]+s\b")
#: Numbers so long are those of trade items or of a shop's own articles.
ITEM_DIGITS = 7
_WORDS = re.compile(r"[a-z]+|[一-鿿]+|\d+")
_DIGIT, _BRACKET, _CLAUSE = re.compile(r"\d"), re.compile(r"[【】\[\]]"), re.compile(r"[，。；！？,;!?]|\.\s")

#: Prior weights of the kinds of token: code, edition, quantity, maker, word; each is multiplied by the square of the token's rarity.
WEIGHTS = {"c": 4.0, "s": 3.0, "q": 3.0, "b": 2.0, "w": 1.0}
#: Of the smaller set's weight so much must be shared; a pair that shares no code must share tokens whose rarities add up to EVIDENCE.
CONTAINMENT, EVIDENCE = 0.7, 2.0

FACTS_DDL = "codes array<struct<code:string,editions:array<string>,fields:int,head:boolean,at:int>>, tokens array<string>"
_CODES = pa.list_(pa.struct([("code", pa.string()), ("editions", pa.list_(pa.string())), ("fields", pa.int32()), ("head", pa.bool_()), ("at", pa.int32())]))
_TOKENS = pa.list_(pa.string())


def tidy(text: str | None) -> str:
    return _BRACKET.sub("", plain(text)) if text else ""


def quantities_in(text: str) -> set[str]:
    """Quantities in base units: ``q:ml:250``."""
    return {f"q:{UNITS[u][0]}:{round(float(n) * UNITS[u][1], 3):g}" for n, u in _VALUE.findall(text)}


def codes_in(text: str, prose: bool) -> dict[str, set[str]]:
    """Every word with the number it carries, and the editions named behind it. ``text`` is lower case in one form."""
    out: dict[str, set[str]] = {}
    text = _COUNT.sub(";", _VALUE.sub(";", text))
    if prose:
        text = _PLURAL.sub(";", text)
    for m in _CODE.finditer(text):
        if len(m[2]) >= ITEM_DIGITS and m[2].isdigit():
            continue
        held = out.setdefault(m[1] + m[2], set())
        if e := _EDITION.match(text, m.end()):
            word, gen, generation, version = e.groups()
            held.add(" ".join(word.split()) if word else VERSIONS[version] if version else f"gen{gen or NUMERALS.get(generation, generation)}")
    return out


def facts(title: str | None, description: str | None, parameters: list[tuple[str, str | None]], known: dict[str, str] | None = None) -> tuple[list[dict], list[str]]:
    """The codes a listing names, each with its editions, how many fields name it, and whether title or parameters do; and its
    other tokens: quantities, and its words if it names no code. ``known`` keeps values of parameters, which come again and again."""
    known = {} if known is None else known
    for _, v in parameters:
        if v and v not in known:
            known[v] = tidy(v)
    head = [tidy(title), *[known[v] for _, v in parameters if v]]
    # A number and what belongs to it stand in one clause.
    body = ";".join(c for c in _CLAUSE.split(tidy(description)) if _DIGIT.search(c))
    codes: dict[str, dict] = {}
    quantities: set[str] = set()
    for n, text in enumerate([*head, body]):
        if not _DIGIT.search(text):
            continue
        quantities |= quantities_in(text)
        for code, editions in codes_in(text, n == len(head)).items():
            c = codes.setdefault(code, {"code": code, "editions": set(), "fields": 0, "head": n < len(head), "at": len(codes)})
            c["editions"] |= editions
            c["fields"] += 1
    for c in codes.values():
        c["editions"] = sorted(c["editions"])
    words: set[str] = set()
    if not codes:
        for text in head:
            words |= {f"w:{x}" for w in _WORDS.findall(_VALUE.sub(";", text)) for x in ([w] if len(w) < 3 or w.isascii() else [w[k : k + 2] for k in range(len(w) - 1)])}
    return list(codes.values()), sorted(quantities | words)


#: Where a listing names its maker, best first: a parameter before the title, the earlier parameter, the earlier and then
#: the longer name of the title; of names that read the same, the last of the list.
RANK_DDL = "struct<title:boolean,at:bigint,shorter:bigint,before:bigint>"
STATED_DDL = f"idx bigint, rank {RANK_DDL}, entry string"
_STATED_AT = pa.schema([("idx", pa.int64()), ("rank", pa.struct([("title", pa.bool_()), ("at", pa.int64()), ("shorter", pa.int64()), ("before", pa.int64())])), ("entry", pa.string())])


class Names:
    """Names of makers as they stand in parameters and titles. ``names`` has the name, its entry and its place in the list."""

    def __init__(self, names: list[tuple[str, str, int]]):
        self.of: dict[str, tuple[int, str]] = {}
        for name, entry, at in names:
            if name and len(name) > 1 and (form := plain(name)):
                self.of[form] = max(self.of.get(form, (at, entry)), (at, entry), key=lambda x: x[0])
        sizes: dict[str, set[int]] = {}
        for form in self.of:
            sizes.setdefault(form[0], set()).add(len(form))
        self.sizes = {c: sorted(n, reverse=True) for c, n in sizes.items()}

    def stated(self, title: str | None, parameters: list[tuple[str, str | None]]) -> tuple[tuple[bool, int, int, int], str] | None:
        """The maker that the parameters or the title name as the list does, and the rank of that place."""
        for k, (key, v) in enumerate(parameters):
            if key and v and key.casefold() in MAKER_KEYS and (hit := self.of.get(plain(v))):
                return (False, k, 0, -hit[0]), hit[1]
        text = tidy(title)
        for at, c in enumerate(text):
            for size in self.sizes.get(c, ()):
                if hit := self.of.get(text[at : at + size]):
                    return (True, at, -size, -hit[0]), hit[1]
        return None


def _cells(rows: list[dict]) -> list[pa.Array]:
    known: dict[str, str] = {}
    found = [facts(r["title"], r["description"], r["parameters"] or [], known) for r in rows]
    return [pa.array([c for c, _ in found], _CODES), pa.array([t for _, t in found], _TOKENS)]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in bounded(batches, 2, 1 << 20):
        yield pa.RecordBatch.from_arrays([b.column(0), *_cells(b.to_pylist()), b.column(4)], ["idx", "codes", "tokens", "brand"])


def _reader(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(held.value)
        for b in bounded(batches, 2, 1 << 20):
            rows = b.to_pylist()
            stated = [names.stated(r["title"], r["parameters"] or []) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), *_cells(rows), b.column(4), pa.array([s and s[1] for s in stated], pa.string())], ["idx", "codes", "tokens", "brand", "stated"])

    return run


def _finder(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, keys = Names(held.value), [f.name for f in _STATED_AT.field("rank").type]
        for b in bounded(batches, 1, 1 << 20):
            rows = [(r["idx"], dict(zip(keys, s[0], strict=True)), s[1]) for r in b.to_pylist() if (s := names.stated(r["title"], r["parameters"] or []))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _STATED_AT, strict=True)], schema=_STATED_AT)

    return run


def listing_facts(products: DataFrame, makers: DataFrame, *, limit: int | None = None, block: int = 50_000) -> DataFrame:
    """``idx, codes, tokens`` of each listing, ``idx`` being unique; the maker is among the tokens. ``makers`` has ``name, entry``.

    The maker is the entry the typed brand means, each different brand being searched once; else the one
    that parameters or title name. For the latter ``block`` names at a time are broadcast; of the blocks' finds the one
    that stands first is kept. Only a caller who sets ``limit`` has it left out beyond so many names.
    """
    sc = products.sparkSession.sparkContext
    # The place in the list goes along, so that blocks decide as one list does.
    placed = makers.select("name", "entry").withColumn("at", F.monotonically_increasing_id())
    count = makers.count()
    searched = limit is None or count <= limit
    blocks = max(1, -(-count // block)) if searched else 1

    def held(k: int):
        some = placed.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == k) if searched else placed.limit(0)
        return sc.broadcast([tuple(r) for r in some.collect()])

    cols = products.select(F.col("idx").cast("bigint").alias("idx"), "title", "description", "parameters", "brand")
    if blocks == 1:
        read = cols.mapInArrow(_reader(held(0)), f"idx bigint, {FACTS_DDL}, brand string, stated string")
    else:
        places = cols.select("idx", "title", "parameters")
        found = reduce(DataFrame.unionByName, [places.mapInArrow(_finder(held(k)), STATED_DDL) for k in range(blocks)])
        stated = found.groupBy("idx").agg(F.min_by("entry", "rank").alias("stated"))
        read = cols.mapInArrow(_read, f"idx bigint, {FACTS_DDL}, brand string").join(stated, "idx", "left")
    typed = match_values(products.select(F.col("brand").alias("value")), makers, [], parts=False).where(F.col("canonical") != UNMATCHED)
    maker = F.coalesce("canonical", "stated")
    tokens = F.when(maker.isNotNull(), F.array_append("tokens", F.concat(F.lit("b:"), maker))).otherwise(F.col("tokens"))
    return read.join(typed.withColumnRenamed("value", "brand"), "brand", "left").select("idx", "codes", tokens.alias("tokens"))


def listing_tokens(facts_of: DataFrame) -> DataFrame:
    """``idx, tokens`` from ``idx, codes, tokens``: of several codes a listing is known by one.

    That is the one named in most fields, then one of title or parameters, then one that other listings share, then
    the rarest over all listings, then the first. Only listings with more than one code are shuffled for it.
    """
    key = F.struct(F.col("c.fields"), F.col("c.head"), F.coalesce(F.col("df") > 1, F.lit(False)), -F.coalesce("df", F.lit(0)), -F.col("c.at"))
    several = facts_of.where(F.size("codes") > 1).select("idx", F.explode("codes").alias("c"))
    df = facts_of.select(F.explode("codes.code").alias("code")).groupBy("code").agg(F.count("*").alias("df"))
    chosen = several.withColumn("code", F.col("c.code")).join(df, "code").groupBy("idx").agg(F.max_by("c", key).alias("chosen"))
    one = facts_of.join(chosen, "idx", "left").withColumn("c", F.coalesce("chosen", F.try_element_at("codes", F.lit(1))))
    editions = F.when(F.size("c.editions") > 0, F.col("c.editions")).otherwise(F.array(F.lit("")))
    own = F.concat(F.array(F.concat(F.lit("c:"), F.col("c.code"))), F.transform(editions, lambda e: F.concat(F.lit("s:"), F.col("c.code"), F.lit("+"), e)))
    return one.select("idx", F.when(F.col("c").isNotNull(), F.concat(own, "tokens")).otherwise(F.col("tokens")).alias("tokens"))


def _prior(token: Column) -> Column:
    out = F.lit(1.0)
    for k, w in WEIGHTS.items():
        out = F.when(token.startswith(f"{k}:"), F.lit(w)).otherwise(out)
    return out


def weighted(classes: DataFrame) -> DataFrame:
    """``id, t, weight``: the tokens of each class (``id, n, tokens``; ``n`` listings) as structs ``df, token, r, w``, the rarest first.

    ``r`` is the rarity over all listings, 1 - log(df) / log(all), between 0 and 1 at any size of the corpus; the weight is the
    prior of the token's kind times its square, a hundredth at least.
    """
    exploded = classes.select("id", "n", F.explode("tokens").alias("token"))
    df = exploded.groupBy("token").agg(F.sum("n").alias("df"))
    r = 1 - F.log("df") / F.lit(math.log((classes.agg(F.sum("n")).first()[0] or 0) + 1) or 1.0)
    known = df.select("token", "df", r.alias("r"), (_prior(F.col("token")) * F.greatest(r * r, F.lit(0.01))).alias("w"))
    t = exploded.join(known, "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "token", "r", "w"))).alias("t"))
    return t.withColumn("weight", F.aggregate("t", F.lit(0.0), lambda acc, x: acc + x["w"]))


def candidates(sets: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """Pairs of classes that the filters let through, once each: ``p`` the lighter, ``q`` the heavier, with their sets.

    Tokens stand in order of rarity. Of the lighter set the shortest prefix is probed behind which less than ``threshold`` of its
    weight is left; of the heavier the prefix is indexed behind which less is left than the least such share of any set. Any pair that
    passes has its first common token in both prefixes, and only there it is formed (positional filter: what is left from it on, in
    either set, must reach the share; length filter: the heavier must weigh so much).
    """
    least = sets.agg(F.min("weight")).first()[0] or 0.0
    at = sets.select("id", "weight", "t", F.posexplode("t").alias("pos", "x"))
    before = F.aggregate(F.slice("t", 1, F.col("pos")), F.lit(0.0), lambda acc, x: acc + x["w"])
    at = at.select("id", "weight", "t", F.col("x.token").alias("token"), "pos", (F.col("weight") - before).alias("left"))
    probe = at.where(F.col("left") >= threshold * F.col("weight") - 1e-9).select("token", F.col("id").alias("p"), F.col("weight").alias("pw"), F.col("t").alias("pt"), F.col("pos").alias("pp"), F.col("left").alias("pl"))
    index = at.where(F.col("left") >= threshold * least - 1e-9)
    index = index.select("token", F.col("id").alias("q"), F.col("weight").alias("qw"), F.col("t").alias("qt"), F.col("pos").alias("qp"), F.col("left").alias("ql"))
    near = probe.join(index, "token").where("p <> q and (pw < qw or (pw = qw and p < q))")
    near = near.where((F.least("pl", "ql") >= threshold * F.col("pw") - 1e-9) & (F.col("qw") >= threshold * F.col("pw") - 1e-9))
    names = lambda c, n: F.transform(F.slice(c, 1, F.col(n)), lambda x: x["token"])
    return near.where(~F.arrays_overlap(names("pt", "pp"), names("qt", "qp"))).select("p", "pw", "pt", "q", "qw", "qt")


def agreed(pairs: DataFrame, threshold: float = CONTAINMENT, evidence: float = EVIDENCE) -> DataFrame:
    """``a, b, shared, wa, wb`` of the candidates that pass the exact check; ``a`` is the lighter set.

    Enough of its weight is shared; a code is shared, or tokens of enough rarity; and the two don't contradict each other: no two
    editions of a code, quantities of one dimension or makers without one in common.
    """
    tokens = lambda c: F.transform(c, lambda x: x["token"])
    common = F.filter("pt", lambda x: F.array_contains(tokens("qt"), x["token"]))
    total = lambda c, f: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x[f])
    same_code = F.exists("common", lambda x: x["token"].startswith("c:"))
    both = pairs.withColumn("common", common).withColumn("shared", total("common", "w"))
    both = both.where((F.col("shared") >= threshold * F.col("pw") - 1e-9) & (same_code | (total("common", "r") >= evidence)))
    # What a token speaks of: the edition of a code, a dimension, the maker.
    topics = lambda c: F.array_distinct(F.transform(F.filter(c, lambda x: ~x["token"].startswith("w:") & ~x["token"].startswith("c:")), lambda x: F.regexp_replace(F.regexp_extract(x["token"], r"^(s:[^+]*|q:[^:]*|b)", 1), r"^$", "?")))
    met = F.array_except(F.array_intersect(topics("pt"), topics("qt")), topics("common"))
    return both.where(F.size(met) == 0).select(F.col("p").alias("a"), F.col("q").alias("b"), "shared", F.col("pw").alias("wa"), F.col("qw").alias("wb"))


def containment_pairs(sets: DataFrame, threshold: float = CONTAINMENT, evidence: float = EVIDENCE) -> DataFrame:
    """``a, b, shared, wa, wb`` of the weighted sets that mean the same product; see ``candidates`` and ``agreed``."""
    return agreed(candidates(sets, threshold), threshold, evidence)


def stars(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``id, center``: star clustering. In each round a node that outweighs its free neighbours (of equal weight: that has more
    links) becomes a centre, and its neighbours join the centre they share most with. The heaviest
    is the fullest listing, so what joins it is contained in it, and two products that one vague listing
    resembles are never merged: it joins one of them."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared", F.col("wb").alias("wa"), F.col("wa").alias("wb")))
    both = cut(both)
    done: DataFrame | None = None
    free = both
    while not free.isEmpty():
        degree = free.groupBy("a").agg(F.count("*").alias("n"))
        ranked = free.join(degree.withColumnsRenamed({"a": "b", "n": "nb"}), "b").join(degree, "a")
        beaten = ranked.where("wb > wa or (wb = wa and (nb > n or (nb = n and b < a)))").select("a").distinct()
        centers = degree.select("a").join(beaten, "a", "left_anti")
        leaves = free.join(centers.select(F.col("a").alias("b")), "b", "left_semi")
        best = Window.partitionBy("a").orderBy(F.desc("shared"), F.desc("wb"), "b")
        taken = leaves.withColumn("r", F.row_number().over(best)).where("r = 1").select(F.col("a").alias("id"), F.col("b").alias("center"))
        found = cut(taken.unionByName(centers.select(F.col("a").alias("id"), F.col("a").alias("center"))))
        done = found if done is None else done.unionByName(found)
        gone = found.select(F.col("id"))
        rest = free.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti")
        free = cut(rest.select("a", "b", "shared", "wa", "wb"))
    alone = nodes.select("id") if done is None else nodes.select("id").join(done, "id", "left_anti")
    alone = alone.withColumn("center", F.col("id"))
    return alone if done is None else done.select("id", "center").unionByName(alone)


def telling(sets: DataFrame, evidence: float = EVIDENCE) -> DataFrame:
    """The weighted sets that tell a product: those with a code, or with tokens of enough rarity. A quantity and a maker don't."""
    rarity = F.aggregate("t", F.lit(0.0), lambda acc, x: acc + x["r"])
    return sets.where(F.exists("t", lambda x: x["token"].startswith("c:")) | (rarity >= evidence))


def product_groups(products: DataFrame, makers: DataFrame) -> DataFrame:
    """``idx, group_id``: the listings of one product have one ``group_id``.

    Null and empty fields give no tokens. A listing whose tokens don't tell a product stays alone. Equal sets of
    tokens, however many listings have them, are one class and are compared once.
    """
    tokens = cut(listing_tokens(cut(listing_facts(products, makers))))
    keyed = tokens.withColumn("id", F.xxhash64(F.array_sort("tokens")))
    classes = cut(keyed.groupBy("id").agg(F.first("tokens").alias("tokens"), F.count("*").alias("n")))
    sets = cut(telling(weighted(classes)))
    groups = stars(sets, containment_pairs(sets))
    return keyed.select("idx", "id").join(groups, "id", "left").select("idx", F.coalesce("center", F.xxhash64(F.lit("alone"), "idx")).alias("group_id"))


def same_product_pairs(groups: DataFrame) -> DataFrame:
    """``idx_a, idx_b`` of listings of one group: as many rows as the definition of the result asks for."""
    a, b = groups.select("group_id", F.col("idx").alias("idx_a")), groups.select("group_id", F.col("idx").alias("idx_b"))
    return a.join(b, "group_id").where("idx_a < idx_b").select("idx_a", "idx_b")
