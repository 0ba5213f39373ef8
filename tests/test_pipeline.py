"""The stages put together, on small tables and stand-ins for models."""

import json
import os
from types import SimpleNamespace

import numpy as np
import pytest

from shelfmark import adapters
from shelfmark.models import ModelConfig
from shelfmark.operators.report import variants
from shelfmark.plans import pipeline

PRODUCT = "idx bigint, id string, category string, subcategory string, title string, brand string, description string, image string"


@pytest.fixture(scope="module")
def shop(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"p{i}", "lamps" if i % 2 else "kettles", "lamp" if i % 2 else "kettle", f"title {i}", "b", "long " * (i % 7), f"images/x/{'lamp' if i % 2 else 'kettle'}/{i}.jpg") for i in range(40)]
    vectors = [(i, (np.eye(8)[i % 2] + 0.3 * rng.normal(size=8)).tolist()) for i in range(40)]
    products = spark.createDataFrame(rows, PRODUCT)
    corpus = spark.createDataFrame(vectors, "idx bigint, vector array<double>")
    members = spark.createDataFrame([("lamp" if i % 2 else "kettle", i) for i in range(40)], "key string, idx bigint")
    attributes = spark.createDataFrame([("lamp", "lamps", "lamp", "lamp"), ("kettle", "kettles", "kettle", "kettle")], "key string, category string, canonical_subcategory string, slug_text string")
    return products, corpus, members, attributes


def test_what_is_reranked_was_retrieved(spark, shop, tmp_path):
    products, corpus, members, attributes = shop
    texts = spark.createDataFrame([("kettle", np.eye(8)[0].tolist()), ("lamp", np.eye(8)[1].tolist())], "key string, vector array<double>")
    found = pipeline.in_domain(members, texts, corpus, products, attributes, repeats=3, seed=1)
    agreed = {(r.key, r.idx) for r in found["agreed"].collect()}
    rows = {r.key: r for r in found["candidates"].collect()}
    assert {(k, c) for k, r in rows.items() for c in (x["index"] for x in r.multi_route_top10)} == agreed and rows["lamp"].category == "lamps" and len(rows["lamp"].reference_image_paths) == 3
    assert {r.route for r in found["multi_route"].collect()} == {"multi-route", "image-text-to-image"}
    ranked = pipeline.rerank(found["agreed"], products, attributes, ModelConfig("overlap"), ModelConfig("longest"))
    for name in ("cross_encoder", "generator"):
        assert {(r.query_id, i) for r in ranked[name].collect() for i in r.top5_indices + r.filtered_indices} == agreed
    assert {r.method_name for r in ranked["summary"].collect()} == {"overlap", "longest"}
    own = pipeline.write_run({k: ranked[k] for k in ("summary",)}, str(tmp_path), "run", seed=1)
    assert json.load(open(os.path.join(own, "run_manifest.json")))["tables"] == ["summary"] and spark.read.parquet(os.path.join(own, "summary")).count() == 2
    with pytest.raises(Exception, match="no idx"):
        pipeline.rerank(found["agreed"], products.where("idx > 1000"), attributes, ModelConfig("overlap"), ModelConfig("longest"))["summary"].collect()


def test_benchmark(spark, shop):
    from shelfmark.models import PRESETS, encode

    products, _, members, attributes = shop
    some = variants(spark).where("model_name in ('clip', 'siglip2') and input_language = 'en'")
    images = {n: encode(products, "idx", "subcategory", PRESETS[n]) for n in ("clip", "siglip2")}
    run = pipeline.benchmark(attributes, some, images, members, products, 10)
    summary = {r.model_name: r for r in run["summary"].collect()}
    assert set(summary) == {"clip", "siglip2"} and all(0 < r["avg_precision@10"] <= 1 for r in summary.values())
    assert {r.model for r in run["report"].collect()} == {"clip", "siglip2"} and run["predictions"].count() == 4


def test_web(spark):
    payload = json.dumps({"organic_results": [{"title": "one", "link": "https://a.test"}, {"title": "two", "link": "https://b.test"}]})
    searches = spark.createDataFrame([(True, payload, None), (False, None, ["https://c.test"])], "searched boolean, payload string, urls array<string>")

    def transport(url, params, headers, timeout):
        if "b.test" in url:
            raise OSError("no answer")
        return "text of " + url[-6:]

    got = {r.link: r for r in pipeline.web(spark, searches, transport, ModelConfig("echo"), "Which?")["pages"].collect()}
    assert got["https://a.test"].title == "one" and got["https://a.test"].reader_content_preview == "text of a.test" and got["https://a.test"].summary and got["https://a.test"].error is None
    assert got["https://b.test"].error == "no answer" and got["https://b.test"].reader_content_preview is None and got["https://c.test"].title == "https://c.test"


def test_adapters_without_their_libraries(tmp_path):
    tensor = np.zeros((1, 2))
    assert adapters.features(tensor) is tensor and adapters.features(SimpleNamespace(image_embeds=None, text_embeds=None, pooler_output=tensor, last_hidden_state=1)) is tensor
    with pytest.raises(TypeError):
        adapters.features(SimpleNamespace(other=1))
    asked = []
    read = lambda n: asked.append(n) or n.encode()
    for _ in range(2):
        adapters.fetch(["a.json", "sub/b.bin"], str(tmp_path), read)
    assert asked == ["a.json", "sub/b.bin"] and (tmp_path / "sub" / "b.bin").read_bytes() == b"sub/b.bin" and not list(tmp_path.rglob("*.part"))
    assert adapters.device("cuda:1") == "cuda:1" and adapters.device() in ("cpu", "cuda")
    adapters.register("encoder", "mine", "/nowhere")
    from shelfmark.models import ENCODERS

    assert callable(ENCODERS.pop("mine"))
