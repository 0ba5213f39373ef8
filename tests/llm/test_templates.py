from pyspark.sql import functions as F

from shelfmark.llm.templates import article_lines, by_counts, host_of, own_heading, page_lines, read_pages, shape, template_elements

SCHEMA = "result_id bigint, url string, title string, reader_content_preview string, line_no int, shape string"
FOOT = "Terms | Privacy\nCopyright 2025 {h}"
TAIL = "Related\n* [Other one](https://{h}/1)\n* [Other two](https://{h}/2)"


def page(i, host, body, title=None, head="Home | Shop\nHome > X", foot=FOOT):
    title = title or f"Story {chr(97 + i % 26)} of {host}"
    return (i, f"https://{host}/p{i}", title, f"{head}\n# {title}\n\n{body}\n{TAIL.format(h=host)}\n\n{foot.format(h=host)}", 0, "x")


def kept(spark, rows):
    out = {}
    for r in article_lines(spark.createDataFrame(rows, SCHEMA)).collect():
        out.setdefault(r.result_id, set()).add(r.line_no)
    return out


def body(i):
    words = ["amber", "brass", "cedar", "delta", "ember", "fjord", "grove", "heron"]
    extra = "\n\n## Verdict\nGood." if i % 8 == 0 else ""
    return f"The {words[i % 8]} lamp number {i} was {words[(i * 3 + 1) % 8]} {words[(i // 8) % 8]} in use {chr(97 + i)}.\n\n| a | b |\n| 1 | 2 |{extra}"


def test_furniture_goes_and_articles_stay(spark):
    rows = [page(i, h, body(i)) for i, h in enumerate(["one.test"] * 12 + ["two.test"] * 12)]
    rows.append(page(24, "tail.example", body(24)))
    got = kept(spark, rows)
    for i, (_, _, _, text, *_) in enumerate(rows):
        lines = text.split("\n")
        want = {k for k, x in enumerate(lines) if 2 <= k < lines.index("Related") and x.strip()}
        assert got[i] == want, (i, [lines[k] for k in got[i] ^ want])


def test_pages_read_again_are_not_templates(spark):
    rows = [page(i, "one.test", body(i)) for i in range(12)] + [(100 + k, "https://one.test/again", *page(0, "one.test", body(0))[2:]) for k in range(30)]
    got = kept(spark, rows)
    assert got[100] == got[0] and len(got[0]) == 6


def test_odd_pages(spark):
    rows = [(1, "https://a.test/", "T", None, 0, "x"), (2, None, None, "a line\r\n\r\nanother", 0, "x"), (3, "https://a.test/", "T", "", 0, "x"), (4, "https://a.test/", "T", "no heading here", 0, "x"), (5, "https://a.test/", "Ｔitle　x", "m\n\n## Title x\r\n  \ntext", 0, "x"), (6, "u", "L", "# L\n" + "word " * 50_000, 0, "x")]
    assert kept(spark, rows) == {2: {0, 2}, 4: {0}, 5: {2, 4}, 6: {0, 1}}
    assert article_lines(spark.createDataFrame(rows, SCHEMA).limit(0)).count() == 0


def test_hosts_and_shapes(spark):
    urls = spark.createDataFrame([("https://U@A.test:80/x?y",), (None,), ("x",)], "u string")
    assert [r.h for r in urls.select(host_of(F.col("u")).alias("h")).collect()] == ["a.test", "", ""]
    assert shape("| a | b |", "h") == ("", None, [])
    assert shape("(c) 2025 h.test Ltd, all", "h.test") == ("(c) 0 @ Ltd, all", "(c) 0 @ Ltd", [])
    assert shape("Address: Mill Road 7", "h.test") == ("Address: Mill Road 0", "Address:", [])
    assert shape("Home > Garden > rake", "x.test") == ("Home > Garden > rake", "Home > ", ["Home", "Garden", "rake"])
    assert shape("Shop Register About Gift cards", "x.test")[2] == ["Shop", "Register", "About", "Gift", "cards"]
    assert shape("Looks close to the photos", "x.test")[2] == shape("A long sentence, with Many Capital Words", "x.test")[2] == []


def test_the_heading_is_not_its_mention_in_a_list():
    assert own_heading(["Related", "T", "Other", "# T", "", "text"], "t") == 3 and own_heading(["T", "Other", "T", "", "x"], "t") == 2
    assert own_heading(["a", "T", "b"], "t") == 1 and own_heading(["a"], "t") is None and own_heading(["", "a"], "") is None


def lines_but(text, gone):
    return {k for k, x in enumerate(text.split("\n")) if x.strip() and x not in gone}


def plain_pages(host, n, foot="The same foot", title=True):
    """Pages without menus: a heading or none, a body of their own, a foot."""
    return [(f"https://{host}/{i}", f"{host} {WORDS[i]}" if title else None, (f"# {host} {WORDS[i]}\n\n" if title else "") + f"Body of {host} {WORDS[i]}.\n\n{foot}\n\nLast words of {WORDS[i]}.") for i in range(n)]


WORDS = [f"{a}{b}" for a in "abcdefghijklmnopq" for b in "abcdefghijklmnopq"]


def numbered(pages):
    return [(k, u, t, x, 0, "x") for k, (u, t, x) in enumerate(pages)]


def test_a_large_host_does_not_keep_the_furniture_of_a_small_one(spark):
    large = plain_pages("large.test", 201, foot="")
    large[7] = (*large[7][:2], large[7][2] + "\n\nThe same foot\n\nText after the quotation.")
    rows = numbered(plain_pages("small.test", 10) + large)
    got = kept(spark, rows)
    for k, u, _, text, *_ in rows:
        assert got[k] == lines_but(text, {"The same foot"} if "small" in u else ()), u


def test_pages_without_a_title_are_told_apart(spark):
    rows = numbered(plain_pages("bare.test", 10, title=False))
    got = kept(spark, rows)
    assert all(got[k] == lines_but(text, {"The same foot"}) for k, _, _, text, *_ in rows)


def test_menus_in_one_line_go_by_their_items(spark):
    names = ["Home", "Deals", "Cart", "Brands", "Stores", "Help"]
    pages = [(u, t, " | ".join(n for j, n in enumerate(names) if j != i % 6) + f"\nHome > Kitchen > {WORDS[i]}\n{x}") for i, (u, t, x) in enumerate(plain_pages("menu.test", 18))]
    rows = numbered(pages)
    own = read_pages(spark.createDataFrame(rows, SCHEMA))
    lines = page_lines(own)
    marked = by_counts(lines, template_elements(own, lines)).where("line_no < 2").select("gone").collect()
    # The counts take them, not their place before the heading.
    assert len(marked) == 36 and all(r.gone for r in marked)


def test_a_rest_met_under_many_titles_is_no_article(spark):
    rows = numbered([(f"https://h{i}.test/", f"Title {WORDS[i]}", "Please confirm you are no robot") for i in range(4)] + [("https://x.test/", "Title x", "A page that shows another heading.\nText.")])
    assert kept(spark, rows) == {4: {0, 1}}


def test_no_host_decides_for_others(spark):
    def pages(host, n, said):
        return [(None, f"https://{host}/{i}", f"{host} {chr(65 + i % 26)}{chr(65 + i // 26)}", "# {t}\n\n" + f"Body of {host} {chr(65 + i % 26)}{chr(65 + i // 26)}." + (f"\n\n{said(i)}" if said(i) else ""), 0, "x") for i in range(n)]

    small = [f"s{chr(97 + j)}.test" for j in range(4)]
    # "Accept all" is on every page of the small hosts and on one of the large; "Well made" on every page of the large and on one of each small.
    rows = [r for h in small for r in pages(h, 16, lambda i: "Accept all" + ("\n\nWell made" if i == 3 else ""))] + pages("large.test", 300, lambda i: "Well made" + ("\n\nAccept all" if i == 3 else "")) + pages("tail.test", 1, lambda i: "Accept all")
    rows = [(k, u, t, text.replace("{t}", t), *rest) for k, (_, u, t, text, *rest) in enumerate(rows)]
    got = kept(spark, rows)
    for k, (_, u, _, text, *_) in enumerate(rows):
        goes = "Well made" if "large" in u else "Accept all"
        assert got[k] == {i for i, x in enumerate(text.split("\n")) if x and x != goes}, (u, text)


def test_many_articles_under_few_titles(spark):
    # An eighth of the articles has a verdict, so every title has one somewhere; one page is read again with other adverts.
    pages = [(f"https://one.test/{w}", f"Title {'abcdefghijklm'[i % 13]}", f"Body of {w} in a line that is longer than others.\n\n" + ("Verdict\nGood.\n\n" if i % 8 == 0 else "")) for i, w in enumerate(WORDS)]
    again = [(*pages[0][:2], pages[0][2] + f"Advert for {w}\n\n") for w in WORDS[:100]]
    rows = numbered([(u, t, f"One | Two | Three\n# {t}\n\n{x}The same foot") for u, t, x in pages + again])
    got = kept(spark, rows)
    for k, u, _, text, *_ in rows:
        assert got[k] == lines_but(text, {"One | Two | Three", "The same foot"}), text


def test_a_host_where_an_element_strayed_has_no_vote(spark):
    # The foot of two hosts stands once on each of four large ones, as a page of another site; a host seen once shows it too.
    large = [f"large{c}.test" for c in "abcd"]
    pages = [p for h in ("one.test", "two.test") for p in plain_pages(h, 20)] + plain_pages("tail.test", 1)
    for h in large:
        own = plain_pages(h, 150, foot="")
        pages += [*own[:-1], (*own[-1][:2], own[-1][2] + "\n\nThe same foot")]
    rows = numbered(pages)
    got = kept(spark, rows)
    for k, u, _, text, *_ in rows:
        assert got[k] == lines_but(text, {"The same foot"} if "large" not in u else ()), u
