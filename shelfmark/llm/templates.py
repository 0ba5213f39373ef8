"""Problem 5: the article of a page without the furniture of its site.

A page's text is a tree: the page, blocks between empty lines, lines, and the parts of a line (the items of
a menu or a path, the leading part of a notice). Every subtree is hashed without what varies (numbers, link
targets, the site's own name). One that recurs on many pages of a host is part of its template; article text that
recurs (section headings, stock phrases) is spread thinly over all hosts instead. Where a host's pages are too few to tell one
from the other, the hosts where the subtree occurs decide, one vote each, however large. A block recurs only where its lines do,
so blocks need no hash of their own; the whole rest of a page has one where the page doesn't show its own heading.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.plans.runtime import bounded, cut

#: Share of a host's pages on which an element must recur.
SHARE = 0.2
#: Standard deviations beyond the share, or below half of it, at which a host's own count decides: article text that
#: recurs stands on an eighth of the pages, so nearer counts come about by chance.
CLEAR = 3.0
#: Share of a host's pages below which an element strayed there: such a host has no vote. Its own count is then clear in any case.
STRAY = 0.01
#: Pages with other articles on which it must stand, and pages a host needs to be counted.
PAGES, HOST_PAGES = 3, 5

_SPACE = re.compile(r"\s+")
_LEAD = re.compile(r"^[#\s*•·\-–>]+")
_LINK = re.compile(r"\((?:https?:)?//[^)\s]*\)")
_LABEL = re.compile(r"^[^:]{1,16}:")
_TABLE = re.compile(r"^\|.*\|$")
_ITEMS = re.compile(r"\s*[|»>/·•]\s*")
_SENTENCE = re.compile(r"[.,:;!?。，：；！？、]")

LINES = pa.schema([("result_id", pa.int64()), ("line_no", pa.int64()), ("block", pa.int64()), ("place", pa.int8()), ("host", pa.int64()), ("article", pa.int64()), ("titled", pa.int64()), ("shape", pa.string()), ("part", pa.string()), ("items", pa.list_(pa.string()))])
LINES_DDL = "result_id bigint, line_no bigint, block bigint, place tinyint, host bigint, article bigint, titled bigint, shape string, part string, items array<string>"
#: Where a line stands: before the page's own heading, from it on, or on a page that doesn't show it.
BEFORE, FROM, NOWHERE = 0, 1, 2
#: Items a line needs to be a list of them, and their share that must be part of a template.
ITEMS, MOST = 3, 0.6


def host_of(url: Column) -> Column:
    """The host of an address in lower case; empty where there is none."""
    return F.coalesce(F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.\-]*://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit(""))


def even(line: str) -> str:
    return _SPACE.sub(" ", unicodedata.normalize("NFKC", line)).strip()


def heading(line: str) -> str:
    return _LEAD.sub("", even(line)).rstrip("#* ").casefold()


def items(line: str) -> list[str]:
    """The items of a menu or a path in one line: between bars or arrows, or capitalised or Han words set side by side; none if it isn't one."""
    if _LINK.search(line):
        return []
    found = [x for x in _ITEMS.split(line) if x]
    if len(found) < 2 and not _SENTENCE.search(line):
        words = line.split(" ")
        found = words if len(words) > ITEMS and 2 * sum(not w[:1].islower() for w in words) > len(words) else []
    return found if len(found) >= ITEMS else []


def shape(line: str, host: str) -> tuple[str, str | None, list[str]]:
    """The line without what varies; its leading part where it has one: a label, the start of a path, or of a line that names its
    own site; and the items of a list in one line. A row of a table has none of these."""
    if _TABLE.match(line):
        return "", None, []
    text = line.replace(host, "@") if host else line
    text = re.sub(r"\d+", "0", _LINK.sub("()", text))
    if m := _LABEL.match(text):
        return text, m[0], []
    if held := items(text):
        return text, text[: text.index(held[1])] if text.startswith(held[0]) and _ITEMS.search(text) else None, held
    return text, text.split(",")[0] if "@" in text else None, []


def own_heading(lines: list[str], title: str) -> int | None:
    """The line with the page's own heading: marked as one, else before an empty line, else the first that reads like the title
    (lists of other articles may name the page too)."""
    found = [k for k, raw in enumerate(lines) if title and raw.strip() and heading(raw) == title]
    apart = [k for k in found if k + 1 == len(lines) or not lines[k + 1].strip()]
    return next((k for k in found if lines[k].lstrip().startswith("#")), next(iter([*apart, *found]), None))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in bounded(batches, 6, 1 << 20):
        rows = []
        for r in b.to_pylist():
            text, title = r["reader_content_preview"], heading(r["title"] or "")
            if not text or not text.strip():
                continue
            lines = text.split("\n")
            at = own_heading(lines, title)
            block = 0
            for k, raw in enumerate(lines):
                if not raw.strip() or k == at:
                    block += 1
                if k == at:
                    rows.append((r["result_id"], k, -1, FROM, r["host"], r["article"], r["titled"], "", None, []))
                elif raw.strip():
                    place = (FROM if not title else NOWHERE) if at is None else FROM if k > at else BEFORE
                    rows.append((r["result_id"], k, block, place, r["host"], r["article"], r["titled"], *shape(even(raw), r["name"])))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), LINES, strict=True)], schema=LINES)


def read_pages(pages: DataFrame) -> DataFrame:
    """``result_id, name, host, article, titled, title, reader_content_preview`` of the pages with a text; host, article and its title as hashes.

    Titles are fewer than articles: a site that grows puts ever more articles under each. So an article is told by the title and
    the longest line from there on, which its furniture, read again or not, seldom is.
    """
    own = pages.where("reader_content_preview is not null").select(F.col("result_id").cast("bigint").alias("result_id"), host_of(F.col("url")).alias("name"), "title", "reader_content_preview")
    # A page without a title is told from others by its text.
    known = F.coalesce(F.nullif(F.lower(F.trim("title")), F.lit("")), "reader_content_preview")
    body = F.expr("substring(reader_content_preview, greatest(1, coalesce(instr(reader_content_preview, trim(title)), 1)))")
    longest = F.array_max(F.transform(F.split(body, "\n"), lambda x: F.struct(F.length(x), x.alias("line"))))["line"]
    return own.select("result_id", "name", F.xxhash64("name").alias("host"), F.xxhash64(known, F.btrim(longest, F.lit(" \t\r"))).alias("article"), F.xxhash64(known).alias("titled"), "title", "reader_content_preview")


def page_lines(own: DataFrame) -> DataFrame:
    """All lines: ``result_id, line_no, block, place, host, article, titled`` and the hashes ``shape, part, items``.

    The heading and rows of tables have a null ``shape``: they are never furniture.
    """
    number = lambda c: F.when(F.col(c) != "", F.xxhash64(F.lit(c), c))
    return own.mapInArrow(_lines, LINES_DDL).withColumns({"shape": number("shape"), "part": number("part"), "items": F.transform("items", lambda x: F.xxhash64(F.lit("item"), x))})


def template_elements(own: DataFrame, lines: DataFrame, share: float = SHARE, pages: int = PAGES, host_pages: int = HOST_PAGES) -> DataFrame:
    """``element, voted, other``: whether the hosts' votes make the element a part of templates, and the hosts that decide otherwise on their own count.

    Elements that no host has in its template are left out. Hosts of fewer than ``pages / share`` pages, on which the share is
    less than ``pages``, vote together: each casts what their summed counts say. Pages are counted by their article, so a page
    read again, or under two addresses, counts once. The count is by element and host before it is gathered by element: no
    host, however large, meets in one task.
    """
    n, k = F.col("n"), F.col("k")
    sized = own.select("host", "article").distinct().groupBy("host").agg(F.count("*").alias("n")).where(n >= host_pages)
    elements = lines.select("host", "article", F.explode(F.array_append(F.array_append("items", F.col("shape")), F.col("part"))).alias("element")).where("element is not null").distinct()
    per_host = elements.groupBy("element", "host").agg(F.count("*").alias("k"))
    beyond = lambda p: CLEAR * F.sqrt(p * (1 - p) * n)
    # Only hosts where the element occurs are seen: on few pages that alone lifts the count that the share leads to.
    least = share * n / (1 - F.pow(1 - F.lit(share), n))
    clear = F.when((k >= pages) & (k >= share * n + beyond(share)), True).when(k < share / 2 * n - beyond(share / 2), False)
    small = n < pages / share
    counted = per_host.join(sized, "host").withColumns({"clear": clear, "small": small}).groupBy("element").agg(
        F.sum("k").alias("k"), F.count_if(k >= STRAY * n).alias("hosts"), F.count_if(~F.col("small") & (k >= share * n)).alias("yes"),
        F.count_if("small").alias("together"), F.coalesce(F.sum(F.when(F.col("small"), k - least)), F.lit(0.0)).alias("over"),
        F.collect_list(F.when(F.col("clear"), F.col("host"))).alias("do"), F.collect_list(F.when(~F.col("clear"), F.col("host"))).alias("do_not"),
    )
    voted = (k >= pages) & (2 * (F.col("yes") + F.when(F.col("over") >= 0, F.col("together")).otherwise(0)) > F.col("hosts"))
    decided = counted.withColumn("voted", voted).select("element", "voted", F.when(F.col("voted"), F.col("do_not")).otherwise(F.col("do")).alias("other"))
    return decided.where(F.col("voted") | (F.size("other") > 0))


def article_lines(pages: DataFrame) -> DataFrame:
    """``result_id, line_no`` of the lines that belong to the page's article, counted from 0 between line feeds.

    A line goes if it, its leading part, or most of its items are elements of a template, and with it what
    follows in its block (the links under "related", the rest of a footer). What no count decides goes only
    before the page's own heading. Of a page that doesn't show its heading the rest goes if the same rest is left of pages of
    other articles: a robot check, an error page. Null and blank texts give nothing; a page without a title is taken from its first line.
    """
    own = read_pages(pages)
    # Read once; hashes only.
    lines = cut(page_lines(own))
    known = cut(template_elements(own, lines))
    rest = by_counts(lines.where(F.col("place") == NOWHERE), known).where(F.col("gone").isNull())
    whole = rest.groupBy("result_id", "titled").agg(F.xxhash64(F.array_sort(F.collect_list(F.struct("line_no", "shape")))["shape"]).alias("rest"))
    # Counted by rest before it is joined, so a robot check met everywhere isn't gathered in one task.
    often = whole.select("rest", "titled").distinct().groupBy("rest").agg(F.count("*").alias("n")).where(F.col("n") >= PAGES)
    empty = whole.join(often, "rest", "left_semi").select("result_id")
    left = by_counts(lines, known).where(F.col("gone").isNull() & (F.col("place") != BEFORE))
    return left.join(empty, "result_id", "left_anti").select("result_id", "line_no")


def by_counts(lines: DataFrame, known: DataFrame) -> DataFrame:
    """The lines with ``gone``, 1 where the counts of the line's host, or the votes, take it away; null elsewhere."""
    each = F.concat(F.array(F.struct(F.lit(0).alias("item"), F.col("shape").alias("element")), F.struct(F.lit(0).alias("item"), F.col("part").alias("element"))), F.transform("items", lambda x: F.struct(F.lit(1).alias("item"), x.alias("element"))))
    elements = lines.select("result_id", "line_no", "host", F.size("items").alias("n"), F.explode(each).alias("x")).select("result_id", "line_no", "host", "n", "x.*").where("element is not null")
    met = elements.join(known, "element").where(F.col("voted") != F.array_contains("other", F.col("host"))).groupBy("result_id", "line_no").agg(F.count_if(F.col("item") == 0).alias("whole"), F.sum("item").alias("k"), F.max("n").alias("n"))
    # Of each page, at most as many numbers as it has lines.
    goes = met.where((F.col("whole") > 0) | (F.col("k") >= F.greatest(MOST * F.col("n"), F.lit(1)))).groupBy("result_id").agg(F.collect_set("line_no").alias("goes"))
    own = lines.select("result_id", "line_no", "block", "place", "titled", "shape").join(goes, "result_id", "left")
    so_far = Window.partitionBy("result_id", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumn("gone", F.max(F.when(F.array_contains("goes", F.col("line_no")), 1)).over(so_far)).drop("goes")
