import json

import pytest

from shelfmark.operators.nested import Forest, StructuralIndex, Walk, flatten_payloads


def build(v):
    ix, n = v
    kind = ix.what[n]
    if kind == "{":
        return {ix.key(c): build((ix, c)) for c in range(ix.lo[n], ix.hi[n])}
    if kind == "[":
        return [build((ix, c)) for c in range(ix.lo[n], ix.hi[n])]
    return ix.text(n) if kind == '"' else json.loads(ix.text(n))


GOOD = [
    "{}", "[]", '""', "0", "-1.5e3", "true", "null", ' {"a" : [1, {"b": [[], {}]}, "x\\"y\\\\"], "c": {"d": null}} ', '["\\u4e2d\\n", "中{[,:]}"]', '{"a":{"a":{"a":[[[1]]]}}}', '"\\\\"', '{"k":"\\\\\\""}',
]
BAD = ["", " ", "{", "}", "[1,]", '{"a"}', '{"a":}', '{"a":1,}', "[1 2]", '{"a" 1}', "[}", '{"a":[1}', "[1]]", "tru", "01", '"abc', '{"a":1}{"b":2}', "[1] [2]", '["a\nb"]', '{1:2}', '["a":1]', '{"a":1', ",", ":", '{"a":"b\\"}', "-"]


def test_index_agrees_with_a_parser():
    ix = StructuralIndex([t.encode() for t in GOOD + BAD])
    for t, r in zip(GOOD, ix.root, strict=False):
        assert r >= 0, t
        assert build((ix, r)) == json.loads(t)
    for t, r in zip(BAD, ix.root[len(GOOD) :], strict=True):
        with pytest.raises(ValueError):
            json.loads(t)
        assert r == -1, t


def test_index_of_nothing_and_of_a_very_long_text():
    assert StructuralIndex([]).root == []
    long = json.dumps({"a": ["中" * 100_000] * 3, "b": list(range(50_000))})
    ix = StructuralIndex([b"", long.encode(), b"{"])
    assert ix.root[0] == -1 and ix.root[2] == -1 and build((ix, ix.root[1])) == json.loads(long)


def rows(payload):
    f = Forest([payload.encode()])
    return [] if f.index.root[0] < 0 else Walk(f).record((f.index, f.index.root[0]))


def test_shapes_of_colors_and_sizes():
    got = rows(json.dumps({"sizes": {"systems": [{"system": "EU", "values": ["S", {"label": "M", "dims": [{"axis": "h", "cm": 1}]}]}]}, "colors": [None, "", {}, "red", {"name": "blue", "skus": ["L", {"size": "XL", "stock": 0}]}]}))
    assert got == [
        ("color", 1, "record", 0, "red"), ("color", 2, "record", 0, "blue"), ("size", 1, "color", 2, "L"), ("size", 2, "color", 2, "XL"), ("size_system", 1, "record", 0, "EU"),
        ("size", 3, "size_system", 1, "S"), ("size", 4, "size_system", 1, "M"), ("dimension", 1, "size", 4, "h"),
    ]
    inner = {"options": [{"color": {"name": "c", "hex": None}, "skus": [{"size": {"name": "s", "dims": [{"axis": "w"}]}, "barcode": "1"}]}]}
    assert rows(json.dumps({"colors": inner})) == rows(json.dumps({"colors": json.dumps(inner)})) == [("color", 1, "record", 0, "c"), ("size", 1, "color", 1, "s"), ("dimension", 1, "size", 1, "w")]
    assert rows('{"colors": {"label": "x"}, "sizes": "S"}') == [("color", 1, "record", 0, "x"), ("size", 1, "record", 0, "S")]


def test_shapes_of_parameters():
    want = [("group", 1, "record", 0, "g"), ("parameter", 1, "group", 1, "p"), ("option", 1, "parameter", 1, "a"), ("option", 2, "parameter", 1, "b"), ("parameter", 2, "group", 1, "w")]
    assert rows(json.dumps({"parameters": {"g": {"p": ["a", None, "b"], "w": {"amount": 1.5, "unit": "kg"}}}})) == want
    assert rows(json.dumps({"parameters": [{"group": "g", "items": [{"name": "p", "value": ["a", "b", ""]}, {"k": "w", "v": "1"}]}]})) == want
    assert rows(json.dumps({"parameters": [{"key": "p", "val": "x"}, {}, None]})) == [("parameter", 1, "record", 0, "p")]
    assert rows('{"parameters": {"p": ""}}') == [("parameter", 1, "record", 0, "p")]


def test_shapes_of_after_sales():
    want = [("policy", 1, "record", 0, "returns"), ("condition", 1, "policy", 1, "unopened"), ("region", 1, "condition", 1, "east"), ("policy", 2, "record", 0, "invoice")]
    assert rows(json.dumps({"after_sales": {"version": 3, "policies": [{"type": "returns", "terms": [{"text": "unopened", "regions": ["east", ""]}]}, {"name": "invoice", "promise": "x"}]}})) == want
    assert [r[4] for r in rows('{"after_sales": {"returns": "7d", "invoice": "x"}}')] == ["returns", "invoice"]
    assert [r[4] for r in rows('{"after_sales": [{"policy": "p", "conditions": "one"}]}')] == ["p", "one"]


def test_records_without_children_and_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "[1]", "x"), (4, '{"colors": null}', "x"), (5, '{"colors": ["r"', "x"), (6, '{"colors": ["r"]}', "x"), (6, '{"colors": ["r"]}', "x")], "record_id bigint, payload string, name string")
    assert [tuple(r) for r in flatten_payloads(df).collect()] == [(6, "color", 1, "record", 0, "r")] * 2
    assert flatten_payloads(df.limit(0)).count() == 0


def test_records_nested_as_deep_as_they_come():
    deep = lambda n, inner: '{"a":' * n + inner + "}" * n
    got = rows('{"parameters": ' + deep(3000, '{"p": "x"}') + "}")
    assert len(got) == 3001 and got[-1] == ("parameter", 1, "group", 3000, "p") and got[1] == ("group", 2, "group", 1, "a")
    assert rows('{"colors": ' + '{"name":' * 3000 + '"red"' + "}" * 3000 + "}") == [("color", 1, "record", 0, "red")]
    assert rows('{"colors": ' + '{"options":' * 3000 + '["red"]' + "}" * 3000 + "}") == [("color", 1, "record", 0, "red")]
    # A group's rows stand before those of what follows it.
    assert [r[4] for r in rows('{"parameters": {"g": {"h": {"p": 1}, "q": 2}, "r": 3}}')] == ["g", "h", "p", "q", "r"]


@pytest.mark.parametrize("space", [" " * 40, "\t\n" * 9, "\u3000", "\u00a0\u2003", "\ufeff", ""])
def test_json_in_text_behind_white_space(space):
    assert rows(json.dumps({"colors": space + '["red"]'}, ensure_ascii=False)) == rows(json.dumps({"colors": space + '["red"]'})) == [("color", 1, "record", 0, "red")]
