import json
import os
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from shelfmark import models as Y
from shelfmark.plans.runtime import broadcastable, cut, spread
from shelfmark.sources import files, search

LINE = {"id": "a", "category": "c", "subcategory": "s", "title": "t", "brand": "b", "price": 1.5, "colors": ["r"], "sizes": [], "parameters": {"k": "v"}, "rating": 4.0, "shop_name": "n", "after_sales": {}, "description": "d", "image": "i/x/y/1.jpg"}


def write_lines(path, lines):
    path.write_text("".join((x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)) + "\n" for x in lines), encoding="utf-8")
    return str(path)


def test_products_keep_the_place_of_their_line(spark, tmp_path):
    (tmp_path / "p").mkdir()
    write_lines(tmp_path / "p/a.jsonl", [{**LINE, "id": f"a{i}"} for i in range(700)])
    write_lines(tmp_path / "p/b.jsonl", [{**LINE, "id": f"b{i}"} for i in range(3)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = files.read_products(spark, str(tmp_path / "p")).orderBy("idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.idx for r in rows] == list(range(703)) and [r.id for r in rows] == [f"a{i}" for i in range(700)] + [f"b{i}" for i in range(3)]


@pytest.mark.parametrize("line", [{**LINE, "more": 1}, {k: v for k, v in LINE.items() if k != "brand"}, "{broken", ""])
def test_strict_product_lines(spark, tmp_path, line):
    path = write_lines(tmp_path / "p.jsonl", [LINE, line])
    with pytest.raises(Exception, match="not a product, line 1"):
        files.read_products(spark, path).collect()
    assert files.read_products(spark, path, strict=False).count() == 2


def test_envelope_and_ranges(spark, tmp_path):
    path = str(tmp_path / "e.json")
    files.write_json(path, {"rows": [{"k": i} for i in range(6)]})
    get = lambda **o: [r.k for r in files.read_envelope(spark, path, "k int", **o).orderBy("pos").collect()]
    assert get() == list(range(6)) and get(start=4) == [4, 5] and get(start=1, limit=2) == [1, 2] and get(start=9, limit=2) == [] and get(limit=-1) == list(range(6))


def test_judge_files_with_other_headers(spark, tmp_path):
    row = {"subcategory_slug": "s", "canonical_zh": "z", "top5_relevant_ratio_gpt": 1.0, "filtered_correct_ratio_gpt": 0.2, "notes": "n"}
    files.write_json(str(tmp_path / "j/1.json"), {"method_name": "a", "case_start": 0, "case_end": 24, "rows": [row]})
    files.write_json(str(tmp_path / "j/2.json"), {"method_name": "a", "case_range": [25, 49], "source_file": "f", "evaluation_mode": "m", "rows": [row, row]})
    assert files.read_judge_batches(spark, str(tmp_path / "j")).groupBy("method_name").count().collect()[0]["count"] == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", [1, 2], 0.5), (None, None, None)], "s string, l array<int>, `p@1` double")
    files.write_csv(df, str(tmp_path / "c"))
    got = files.read_csv(spark, str(tmp_path / "c")).collect()
    assert {tuple(r) for r in got} == {("a", "[1,2]", "0.5"), (None, None, None)}
    files.write_csv(df, str(tmp_path / "d"), ["s"])
    assert files.read_csv(spark, str(tmp_path / "d")).columns == ["s"]
    files.write_json_lines(df, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 2
    files.write_rows_json(df, str(tmp_path / "n/r.json"))
    text = (tmp_path / "n/r.json").read_text()
    assert json.loads(text)["rows"][0] == {"s": "a", "l": [1, 2], "p@1": 0.5} and text.endswith("}\n")
    name = files.run_name("run", datetime(2026, 4, 3, 15, 53, 4, tzinfo=UTC))
    assert name == "run_20260403T155304Z"
    assert json.load(open(os.path.join(files.write_manifest(str(tmp_path), name, rows=2), "run_manifest.json")))["rows"] == 2
    assert files.read_report(spark, str(tmp_path / "n/r.json")).count() == 1


def test_predictions_and_images(spark, tmp_path):
    ranking = spark.createDataFrame([(1, 1, 5, 0.9), (1, 2, 6, 0.8), (1, 3, 7, 0.7)], "query_id bigint, rank int, idx bigint, score double")
    qrels = spark.createDataFrame([(1, 6)], "query_id bigint, idx bigint")
    products = spark.createDataFrame([(5, "p5"), (6, "p6"), (7, "p7")], "idx bigint, image string")
    r = files.predictions(ranking, qrels, products, 2).first()
    assert (r.topk_image_paths, r.topk_scores, r.topk_correct_flags) == (["p5", "p6"], [0.9, 0.8], [0, 1])
    (tmp_path / "x.jpg").write_bytes(b"abc")
    assert bytes(files.read_images(spark, str(tmp_path / "x.jpg")).first().content) == b"abc"


def test_search_through_an_injected_transport(spark):
    def transport(url, params, headers, timeout):
        if params.get("q") == "bad":
            raise RuntimeError("HTTP 502")
        return json.dumps({"url": url, "q": params.get("q"), "n": len(headers), "timeout": timeout})

    config = search.SearchConfig("key")
    rows = {r.key: r for r in search.search(spark, {"a": search.text_search(config, "lamp"), "b": search.text_search(config, "bad"), "c": search.image_search(config, "lamp", 2)}, transport).collect()}
    assert json.loads(rows["a"].content)["timeout"] == 60 and rows["a"].content_length == len(rows["a"].content)
    assert rows["b"].error == "HTTP 502" and rows["b"].content is None and rows["c"].error is None
    pages = search.read_pages(spark, ["http://x.test/1"], transport, api_key="k", instruction="i").collect()
    assert pages[0].key == "http://x.test/1" and json.loads(pages[0].content) == {"url": "https://r.jina.ai/http://x.test/1", "q": None, "n": 2, "timeout": 120}
    with pytest.raises(RuntimeError):
        search.text_search(search.SearchConfig(), "x")
    assert search.search_params(config, hl="en")["hl"] == "en"
    assert search.reader_headers("k", "i", "markdown", {"a": "中"}) == {"Authorization": "Bearer k", "x-instruction": "i", "x-respond-with": "markdown", "x-json-schema": '{"a": "中"}'}


def test_models_by_name(spark):
    df = spark.createDataFrame([(1, "Red lamp"), (2, "red lamp"), (3, None)], "idx bigint, text string")
    v = {r.idx: r.vector for r in Y.encode(df, "idx", "text", Y.PRESETS["siglip2"]).collect()}
    assert v[1] == v[2] and v[3] is None and abs(sum(x * x for x in v[1]) - 1) < 1e-5
    assert {r.idx: r.vector for r in Y.encode(df, "idx", "text", Y.PRESETS["clip"]).collect()}[1] != v[1]
    s = df.select("idx", Y.pair_score(F.lit("lamp"), F.col("text"), Y.ModelConfig("overlap")).alias("s")).collect()
    assert s[2].s is None and 0.5 < s[0].s < 1
    g = df.select(Y.generated(F.col("text"), Y.ModelConfig("echo"), 1).alias("g")).collect()
    assert [(r.g.value, r.g.error) for r in g] == [("Red", None), ("red", None), (None, "no prompt")]
    with pytest.raises(ValueError):
        Y.build(Y.ENCODERS, Y.ModelConfig("other"))
    assert Y.ModelConfig("x", device="cpu").used_dtype == "float32" and Y.ModelConfig("x", device="cuda:0").used_dtype == "float16"


def test_runtime_helpers(spark):
    df = spark.range(10, numPartitions=1)
    assert spread(df).rdd.getNumPartitions() >= 2 and broadcastable(df, 10) and not broadcastable(df, 9)
    assert cut(df.selectExpr("id + 1 as x")).count() == 10
