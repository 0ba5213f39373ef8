import itertools
import math
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm.listings import CONTAINMENT, EVIDENCE, WEIGHTS, candidates, containment_pairs, facts, listing_facts, listing_tokens, product_groups, same_product_pairs, stars, telling, weighted

SCHEMA = "idx bigint, title string, description string, parameters map<string,string>, brand string, shop_name string, tokens string"


def read(title, description=None, parameters=()):
    codes, tokens = facts(title, description, list(parameters))
    return {c["code"]: c["editions"] for c in codes}, tokens


def test_facts():
    assert read("珂鸥岚 哈塔9018 MAX 烧水壶", "标称0.25L，以实物为准。大约52遍，货号100077854。") == ({"哈塔9018": ["max"]}, ["q:ml:250"])
    assert read("【1】5【0】0 ml Ricvox-1375 第二代", None, [("Model", "RICVOX 1375 Gen 2"), ("包装清单", "主机 x1")]) == ({"ricvox1375": ["gen2"]}, ["q:ml:1500"])
    assert read("МIΟRВ 2248 迷你版 2 斤", "We counted 33 wipes. Article no. 100163989.") == ({"miorb2248": ["mini"]}, ["q:g:1000"])
    assert read("布丽 1233 猫树 3m", "12周") == ({"布丽1233": []}, ["q:mm:3000"])
    assert read(None) == read("") == read("", "", [("型号", None)]) == ({}, [])
    assert read("x" * 100_000, "y " * 100_000) == ({}, ["w:" + "x" * 100_000])


def test_numbers_of_any_shape_name_a_product():
    titles = {"Sony WH-1000XM5 headphones": "wh1000xm5", "iPhone 15 Pro Max 256GB": "iphone15", "Galaxy S24 Ultra": "s24", "Dyson V15 Detect": "v15", "Casio F91W": "f91w", "小米14 手机": "小米14"}
    assert {t: next(iter(read(t)[0])) for t in titles} == titles
    assert read("iPhone 15 Pro Max 256GB") == ({"iphone15": ["pro max"]}, ["q:gb:256"]) and read("Galaxy S24 Ultra")[0]["s24"] == ["ultra"]
    assert read("Ergonomic chair 办公椅 0.5 m") == ({}, ["q:mm:500", "w:chair", "w:ergonomic", "w:公椅", "w:办公"])


def test_one_code_of_several(spark):
    c = lambda code, fields, head, at, *e: (code, list(e), fields, head, at)
    rows = [
        (1, [c("a1", 1, True, 0), c("b2", 2, False, 1, "max", "pro")], ["q:x"]), (2, [c("x1", 1, False, 0), c("b2", 1, True, 1)], []), (3, [c("x1", 1, True, 0), c("once9", 1, True, 1), c("b2", 1, True, 2)], []), (4, [], ["w:k"]),
        (5, [c("x1", 1, True, 0)], []), (6, [c("u1", 1, True, 0), c("u2", 1, True, 1)], []), (7, [c("x1", 9, True, 0)], []),
    ]
    df = spark.createDataFrame(rows, "idx bigint, codes array<struct<code:string,editions:array<string>,fields:int,head:boolean,at:int>>, tokens array<string>")
    want = {1: ["c:b2", "s:b2+max", "s:b2+pro", "q:x"], 2: ["c:b2", "s:b2+"], 3: ["c:b2", "s:b2+"], 4: ["w:k"], 5: ["c:x1", "s:x1+"], 6: ["c:u1", "s:u1+"], 7: ["c:x1", "s:x1+"]}
    assert {r.idx: r.tokens for r in listing_tokens(df).collect()} == want


def test_makers(spark):
    rows = [(1, "t", None, {"Brand": "珂鸥岚"}, "OEM"), (2, "x Rasobpol y", None, None, None), (3, "x Rasobpol y", None, {"品牌": "?"}, "Csasobras"), (4, None, None, None, " ")]
    products = spark.createDataFrame(rows, "idx bigint, title string, description string, parameters map<string,string>, brand string")
    makers = spark.createDataFrame([("Cassobras", "Cassobras"), ("珂鸥岚", "Cassobras"), ("Rasobpol", "Rasobpol")], "name string, entry string")
    assert {r.idx: [t for t in r.tokens if t[0] == "b"] for r in listing_facts(products, makers).collect()} == {1: ["b:Cassobras"], 2: ["b:Rasobpol"], 3: ["b:Cassobras"], 4: []}
    assert {r.idx: [t for t in r.tokens if t[0] == "b"] for r in listing_facts(products, makers, limit=1).collect()} == {1: [], 2: [], 3: ["b:Cassobras"], 4: []}


def test_makers_beyond_one_block(spark):
    """What parameters and titles name is found however many names there are: one block, a block a name, past the old 50,000."""
    rows = [
        (1, "t", None, {"Brand": "珂鸥岚"}, "OEM"), (2, "x Rasobpol Cassobras", None, None, None), (3, "Cassobras Plus y", None, {"品牌": "?"}, None), (4, None, None, None, " "), (5, "none", None, None, "Rasobpol"),
        (6, "Rasobpol", None, {"brand": "nobody", "品牌": "Cassobras"}, None), (7, "twice", None, None, None),
    ]
    products = spark.createDataFrame(rows, "idx bigint, title string, description string, parameters map<string,string>, brand string")
    few = [("Cassobras", "Cassobras"), ("珂鸥岚", "Cassobras"), ("Rasobpol", "Rasobpol"), ("Cassobras Plus", "Plus"), ("Twice", "A"), ("TWICE", "B")]
    want = {1: ["b:Cassobras"], 2: ["b:Rasobpol"], 3: ["b:Plus"], 4: [], 5: ["b:Rasobpol"], 6: ["b:Cassobras"], 7: ["b:B"]}
    for block in (1, 2, 50_000):
        assert {r.idx: [t for t in r.tokens if t[0] == "b"] for r in listing_facts(products, spark.createDataFrame(few, "name string, entry string"), block=block).collect()} == want
    filler = spark.range(50_000).selectExpr("concat('#', id, 'filler') as name", "'filler' as entry")
    some = products.where("brand is null").limit(9)
    many = spark.createDataFrame(few, "name string, entry string").coalesce(1).unionByName(filler)
    assert {r.idx: [t for t in r.tokens if t[0] == "b"] for r in listing_facts(some, many).collect()} == {i: want[i] for i in (2, 3, 6, 7)}


KINDS = st.tuples(st.sampled_from(["c:1", "c:2", "c:3", None]), st.sampled_from(["+", "+pro"]), st.sampled_from(["q:ml:1", "q:ml:2", "q:w:1", None]), st.sampled_from(["b:x", "b:y", None]), st.sets(st.sampled_from(["w:k", "w:l", "w:m", "w:n", "w:o"])))
SETS = "id bigint, n bigint, tokens array<string>"


def tokens_of(code, edition, quantity, maker, words):
    own = [code, f"s:{code[2:]}{edition}"] if code else sorted(words)
    return [*own, *[t for t in (quantity, maker) if t]]


def brute(rows):
    """All pairs, by the definition."""
    df = Counter()
    for n, t in rows:
        df.update({x: n for x in t})
    size = 1 + sum(n for n, _ in rows)
    r = {t: 1 - math.log(k) / math.log(size) for t, k in df.items()}
    w = {t: WEIGHTS[t[0]] * max(0.01, r[t] ** 2) for t in df}
    topic = lambda t: t.split("+")[0] if t[0] == "s" else t.rsplit(":", 1)[0] if t[0] == "q" else t[0]
    want = set()
    for (i, (_, a)), (j, (_, b)) in itertools.combinations(enumerate(rows), 2):
        common = set(a) & set(b)
        enough = sum(w[t] for t in common) >= CONTAINMENT * min(sum(w[t] for t in a), sum(w[t] for t in b)) - 1e-9
        told = any(t[0] == "c" for t in common) or sum(r[t] for t in common) >= EVIDENCE
        parted = {topic(t) for t in a if t[0] in "sqb"} & {topic(t) for t in b if t[0] in "sqb"} - {topic(t) for t in common}
        if enough and told and not parted:
            want.add((i, j))
    return want


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), KINDS), min_size=1, max_size=40))
def test_join_against_all_pairs(spark, rows):
    rows = [(n, t) for n, x in rows if (t := tokens_of(*x))]
    sets = weighted(spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(rows)], SETS))
    got = [(min(r.a, r.b), max(r.a, r.b)) for r in containment_pairs(sets).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_filters_leave_few_candidates(spark):
    """Every listing shares a maker, every tenth a quantity; only those of one code are ever put together."""
    rows = [(k, 1, [f"c:m{k // 3}", f"s:m{k // 3}+", f"q:ml:{k % 10}", "b:x"]) for k in range(300)]
    sets = weighted(spark.createDataFrame(rows, SETS))
    assert candidates(sets).count() == 300
    assert containment_pairs(sets).count() == 0  # each of the three states another quantity


def test_a_quantity_and_a_maker_tell_no_product(spark):
    rows = [(1, 3, ["b:x", "q:ml:1"]), (2, 1, ["c:a1", "s:a1+"]), (3, 1, ["w:chair", "w:oak", "w:tall"]), (4, 5, ["w:chair"])]
    assert {r.id for r in telling(weighted(spark.createDataFrame(rows, SETS))).collect()} == {2, 3}


def test_stars_do_not_chain(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "id bigint")
    pairs = spark.createDataFrame([(1, 2, 9.0, 10.0, 10.0), (2, 3, 9.5, 10.0, 10.0), (3, 4, 9.0, 10.0, 10.0), (6, 5, 9.0, 10.0, 12.0)], "a bigint, b bigint, shared double, wa double, wb double")
    assert {r.id: r.center for r in stars(nodes, pairs).collect()} == {1: 2, 2: 2, 3: 2, 4: 4, 5: 5, 6: 5, 7: 7}
    # A vague listing between two full ones joins one of them.
    pairs = spark.createDataFrame([(1, 2, 10.0, 10.0, 12.0), (1, 3, 10.0, 10.0, 12.0)], "a bigint, b bigint, shared double, wa double, wb double")
    assert {r.id: r.center for r in stars(nodes.where("id < 4"), pairs).collect()} == {1: 2, 2: 2, 3: 3}
    assert {r.id: r.center for r in stars(nodes, pairs.limit(0)).collect()} == {i: i for i in range(1, 8)}


def test_groups(spark):
    rows = [
        (1, "珂鸥岚 哈塔9018 MAX 0.25L", None, None, None), (2, "Cassobras 哈塔-9018 max kettle", "", {"容积": "250 毫升"}, "Cassobras"), (3, "哈塔9018 Max 250ml", None, None, "OEM"),
        (4, "哈塔9018 250ml", None, None, "Cassobras"), (5, "哈塔9018 MAX 0.5L", None, None, "Cassobras"), (6, "Rasobpol 哈塔9018 MAX 0.25L", None, None, "Rasobpol"), (7, None, None, None, None), (8, "kettle 250ml", None, None, "Cassobras"), (9, "kettle 250ml", None, None, "Cassobras"),
        (10, "珂鸥岚 哈塔9018 MAX 0.25L", None, None, None),
    ]
    products = spark.createDataFrame([(*r, "shop", "clash") for r in rows], SCHEMA)
    makers = spark.createDataFrame([("Cassobras", "Cassobras"), ("珂鸥岚", "Cassobras"), ("Rasobpol", "Rasobpol")], "name string, entry string")
    groups = product_groups(products, makers)
    of = {r.idx: r.group_id for r in groups.collect()}
    assert len(of) == 10 and of[1] == of[2] == of[10] and len({of[i] for i in (1, 4, 5, 6, 7, 8, 9)}) == 7
    pairs = {(r.idx_a, r.idx_b) for r in same_product_pairs(groups).collect()}
    assert {(1, 2), (1, 10), (2, 10)} <= pairs and all(a < b for a, b in pairs)
    assert same_product_pairs(product_groups(products.limit(0), makers)).count() == 0
    assert product_groups(products, makers.limit(0)).count() == 10

def test_listings_without_a_number_are_grouped_by_their_words(spark):
    rows = [(1, "Walnut reading chair Nordhelm", None), (2, "Nordhelm reading chair walnut", "0.9 m"), (3, "Chair", None), (4, "Chair", None), (5, "Oak dining table Fernvale", None), (6, "hot sale walnut reading chair Nordhelm", "2 m")]
    products = spark.createDataFrame([(i, t, None, {"size": v} if v else None, None, "shop", "x") for i, t, v in rows] + [(100 + k, f"filler{k * 7}x thing{k}y", None, None, None, "shop", "x") for k in range(60)], SCHEMA)
    of = {r.idx: r.group_id for r in product_groups(products, spark.createDataFrame([], "name string, entry string")).collect()}
    # The first is contained in two that state different sizes: it joins the fuller one.
    assert of[1] == of[6] and len({of[i] for i in (2, 3, 4, 5, 6)}) == 5


def test_a_hot_product_is_compared_once(spark):
    rows = [(k, f"Ricvox-1375 Max {'0.5L' if k % 2 else '500 ml'} sale{'!' * (k % 5)}", None, None, None, "shop", "x") for k in range(3000)] + [(9000 + k, f"Other {5000 + k}", None, None, None, "shop", "x") for k in range(50)]
    groups = product_groups(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], "name string, entry string"))
    assert groups.where("idx < 9000").select("group_id").distinct().count() == 1 and groups.select("group_id").distinct().count() == 51
