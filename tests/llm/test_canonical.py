import pytest
from hypothesis import given
from hypothesis import strategies as st

from shelfmark.llm.canonical import UNMATCHED, BKTree, Matcher, Recalled, Shard, canonical_values, distance, match_values, plain

WORDS = st.text("abc", max_size=6)


def reference(a, b):
    """The textbook recurrence over all pairs of earlier positions."""
    d = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i, j] = i + j
                continue
            best = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            for k in range(1, i):
                for m in range(1, j):
                    if a[k - 1] == b[j - 1] and b[m - 1] == a[i - 1]:
                        best = min(best, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
            d[i, j] = best
    return d[len(a), len(b)]


@given(WORDS, WORDS)
def test_distance_against_the_recurrence(a, b):
    assert distance(a, b) == reference(a, b) == distance(b, a)


@given(WORDS, WORDS, WORDS)
def test_distance_is_a_metric(a, b, c):
    assert distance(a, c) <= distance(a, b) + distance(b, c) and (distance(a, b) == 0) == (a == b)


def test_a_tree_from_its_nodes_is_the_tree():
    words = [f"{a}{b}cd" for a in "abcde" for b in "abcde"]
    tree = BKTree(words)
    assert sorted(BKTree(nodes=tree.nodes).within("abcx", 2)) == sorted(tree.within("abcx", 2)) and BKTree().within("a", 3) == []


@given(st.lists(WORDS, max_size=25), WORDS, st.integers(0, 3))
def test_tree_finds_everything_within_the_radius(words, q, r):
    assert sorted(BKTree(words).within(q, r)) == sorted((d, w) for w in set(words) if (d := distance(q, w)) <= r)


KINDS = [("电热水壶", "电热水壶"), ("electric kettle", "电热水壶"), ("烧水壶", "电热水壶"), ("洒水壶", "洒水壶"), ("骑行头盔", "骑行头盔"), ("黑胶唱机", "黑胶唱机"), ("工具箱", "工具箱"), ("钢笔", "钢笔"), ("rice cooker", "电饭煲"), ("运动水壶", "运动水壶")]
BRANDS = [("Cassobras", "Cassobras"), ("珂鸥岚", "Cassobras"), ("Rasobpol", "Rasobpol"), ("岚鸥珀", "Rasobpol")]


@pytest.mark.parametrize(("typed", "entry"), [
    ("　电热水壶 ", "电热水壶"), ("【电热水壶]", "电热水壶"), ("ELECTRIC-KETTLE", "电热水壶"), ("electri kettle", "电热水壶"), ("electrickettle", "电热水壶"), ("厨房电器/电热水壶", "电热水壶"), ("便携电热水壶", "电热水壶"), ("烧水壶等", "电热水壶"), ("电水壶", "电热水壶"),
    ("头盔", "骑行头盔"), ("唱机黑胶", "黑胶唱机"), ("五金工具箱", "工具箱"), ("rіcе сооkеr", "电饭煲"), ("其他", UNMATCHED), ("水壶", UNMATCHED), ("雨伞", UNMATCHED), ("厨房电器", UNMATCHED), ("phone case", UNMATCHED), ("/", UNMATCHED), ("x" * 50_000, UNMATCHED), ("戊" * 20_000, UNMATCHED), ("戊 " * 20_000, UNMATCHED),
])
def test_kinds(typed, entry):
    assert Matcher(KINDS, ["厨房电器", "kitchen"], True).entry(typed) == entry


@pytest.mark.parametrize(("typed", "entry"), [
    ("CASSOBRAS", "Cassobras"), ("Csasobras", "Cassobras"), ("Cass·obras", "Cassobras"), ("Cassobras®", "Cassobras"), ("珂鸥岚旗舰店", "Cassobras"), ("珂鸥岚（Cassobras）", "Cassobras"), ("Ｃａｓｓｏｂｒａｓ", "Cassobras"), ("Cassobras's", "Cassobras"), ("Cassobras Official Store", "Cassobras"),
    ("岚珀鸥", UNMATCHED), ("Raspolobqel 岚珀鸥", UNMATCHED), ("OEM", UNMATCHED), ("自有品牌", UNMATCHED),
])
def test_brands(typed, entry):
    assert Matcher(BRANDS, [], False).entry(typed) == entry


def test_equally_close_entries_leave_a_value_unmatched():
    assert Matcher([("abcdx", "1"), ("abcdy", "2")], [], False).entry("abcdz") == UNMATCHED
    assert Matcher([], [], True).entry("abc") == UNMATCHED


def test_rows_and_shards(spark):
    names = spark.createDataFrame(BRANDS + [(None, "x"), ("Dup", "A"), ("Dup", "B")], "name string, entry string")
    entries = spark.createDataFrame([("Cassobras",), ("Rasobpol",)], "entry string")
    rows = spark.createDataFrame([(1, "Cassobras", "k"), (2, None, "k"), (3, " 　", "k"), (4, "cassobras", "k"), (4, "cassobras", "k"), (5, "zzz", "k"), (6, "dup", "k"), (7, "Cassobars", "k")], "idx bigint, brand string, value string")
    want = [(4, "brand", "Cassobras"), (4, "brand", "Cassobras"), (5, "brand", UNMATCHED), (6, "brand", UNMATCHED), (7, "brand", "Cassobras")]
    assert sorted(tuple(r) for r in canonical_values(rows, "idx", "brand", names, entries, [], parts=False).collect()) == want
    assert canonical_values(rows.limit(0), "idx", "brand", names, entries, [], parts=False).count() == 0
    typed = rows.selectExpr("brand as value")
    one = {tuple(r) for r in match_values(typed, names, [], parts=False).collect()}
    assert {tuple(r) for r in match_values(typed, names, [], parts=False, shard_forms=2).collect()} == one
    assert {r.canonical for r in match_values(typed, names.limit(0), [], parts=False).collect()} == {UNMATCHED}
    assert plain("Ａ™b") == "ab"


def test_shards_decide_as_one_tree(spark):
    """Names one edit apart, the same name with two entries, and ties, each spread over different shards."""
    near = [("abcdefgh", "1"), ("abcdefgx", "2"), ("abcdefxh", "3"), ("mnopqrs", "4"), ("mnopqrz", "5"), ("Mnopqrs!", "6"), ("uvwxyzab", "7")]
    typed = ["abcdefgh", "abcdefgx", "ABCDEFXH", "abcdefzz", "abcdefg", "mnopqrs", "mnopqrz", "uvwxyzaa", "none"]
    names = spark.createDataFrame(near, "name string, entry string")
    values = spark.createDataFrame([(v,) for v in typed], "value string")
    want = {v: Matcher(near, [], False).entry(v) for v in typed}
    assert want["abcdefgh"] == "1" and want["abcdefgx"] == "2" and want["mnopqrs"] == UNMATCHED
    for n in (1, 3, 100):
        assert {r.value: r.canonical for r in match_values(values, names, [], parts=False, shard_forms=n).collect()} == want


HAN = st.text("水壶热电箱头", min_size=1, max_size=7)
NAMES = st.lists(st.tuples(st.one_of(HAN, st.text("abc ", min_size=3, max_size=9)), st.sampled_from("XYZW"), st.integers(0, 2)), max_size=14)


@given(NAMES, st.one_of(HAN, st.text("abc -", max_size=12), st.text("水壶热电ab/ ", max_size=14)), st.booleans())
def test_finds_of_shards_against_one_matcher(names, value, parts):
    families = ["热水", "ab"]
    finds = [f for k in range(3) for f in Shard([(n, e) for n, e, s in names if s == k], families, parts).finds(value)]
    assert Recalled(finds, families, parts).entry(value) == Matcher([(n, e) for n, e, _ in names], families, parts).entry(value)
