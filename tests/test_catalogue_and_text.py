import pytest
from pyspark.sql import functions as F

from shelfmark.functions import generation as G
from shelfmark.functions import text as X
from shelfmark.operators import catalogue as A
from shelfmark.operators import rerank as K
from shelfmark.operators import report as P
from shelfmark.operators import web as V

PRODUCT = (
    "idx bigint, id string, category string, subcategory string, title string, brand string, price double, colors array<string>, sizes array<string>, parameters map<string,string>, "
    "rating double, shop_name string, after_sales map<string,string>, description string, image string"
)


def product(spark, **own):
    base = dict(idx=0, id="p", category="c", subcategory="s", title="t", brand="b", price=0.125, colors=[], sizes=["S", "M"], parameters={"k": "v"}, rating=0.0, shop_name="", after_sales={}, description="d", image="images/x/y/1.jpg")
    return spark.createDataFrame([tuple({**base, **o}[f.split()[0]] for f in PRODUCT.split(", ")) for o in (own.get("rows") or [own])], PRODUCT)


def test_documents(spark):
    p = product(spark, brand="　")
    assert p.select(X.document_text("rich_zh")).first()[0] == "商品ID: p\n一级类目: c\n二级类目: s\n标题: t\n品牌: 　\n价格: 0.12\n尺码/规格: S、M\n商品参数: k: v\n评分: 0.0\n商品描述: d"
    assert p.select(X.document_text("compact_rerank_zh")).first()[0] == "一级类目: c\n二级类目: s\n商品标题: t\n商品描述: d"
    assert p.select(X.document_text("title_brand_desc")).first()[0] == "商品标题: t；品牌: 　；商品描述: d"
    empty = product(spark, **{k: None for k in ("id", "category", "subcategory", "title", "brand", "price", "colors", "sizes", "parameters", "rating", "shop_name", "after_sales", "description", "image")})
    assert [empty.select(X.document_text(m)).first()[0] for m in X.DOCUMENT_MODES] == ["", "", "", "商品标题: ；品牌: ；商品描述: "]
    assert product(spark, description="\x85 x　\n").select(X.document_text("description_only")).first()[0] == "x"
    with pytest.raises(ValueError):
        X.document_text("other")
    with pytest.raises(ValueError):
        X.query_text("other", F.lit(1), F.lit(1), F.lit(1), F.lit(1))


def test_half_even_and_percent(spark):
    r = spark.createDataFrame([(0.125, 0.8410), (0.375, 1.0), (54.78, 0.9409), (None, None)], "p double, q double").select(X.half_even_text(F.col("p")), X.percent(F.col("q"))).collect()
    assert [tuple(x) for x in r] == [("0.12", "84.1%"), ("0.38", "100.0%"), ("54.78", "94.1%"), (None, None)]


TIES = [2.675, 1.015, 8.345, 0.125, 0.375, 0.005, 0.015, 1e-9, 0.0, -2.5, -0.125, 1234567.125, 99999999.995, 4503599627370496.5, 1e21, 0.0245, 0.0805, 123.455, 5e-324, 90071992547.4099, 0.045, 999.995]


@pytest.mark.parametrize("digits", [0, 1, 2])
def test_fixed_decimals_are_those_of_printf(spark, digits):
    import random

    rnd = random.Random(digits)
    xs = TIES + [rnd.randint(0, 10**7) / 1000 for _ in range(3000)] + [rnd.random() * 10 ** rnd.randint(-4, 9) for _ in range(2000)] + [rnd.randint(0, 10**6) / 64 for _ in range(500)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", X.half_even_text(F.col("x"), digits).alias("t")).collect()
    assert {r.i: r.t for r in got} == {i: f"{x:.{digits}f}" for i, x in enumerate(xs)}
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "x double").select(X.half_even_text(F.col("x")).alias("t")).collect()
    assert [r.t for r in odd] == ["nan", "inf", "-inf", None]
    with pytest.raises(ValueError):
        X.half_even_text(F.col("x"), 3)


def test_subcategory_queries_mode_ties_and_shared_folders(spark):
    rows = [dict(idx=i, category=c, subcategory=s, image=p) for i, (c, s, p) in enumerate([("c1", "B", "i/x/shared/1"), ("c2", "A", "i/y/shared/2"), ("c2", "A", "i/y/shared/3"), (None, "B", "i/y/shared/4"), ("c", None, "i/z/lone_one/5"), ("c", "s", "short")])]
    q = {r.key: r for r in A.subcategory_queries(product(spark, rows=rows), "slug_en").collect()}
    assert set(q) == {"shared", "lone_one"}
    assert (q["shared"].canonical_subcategory, q["shared"].category, q["shared"].category_slug, q["shared"].positive_count) == ("B", "c2", "x", 4)
    assert q["lone_one"].canonical_subcategory is None and q["lone_one"].query_text == "lone one"
    packed = {r.key: r for r in A.packed_positives(product(spark, rows=rows)).collect()}
    assert packed["shared"].positive_indices == [0, 1, 2, 3]
    assert A.subcategory_queries(product(spark).limit(0)).count() == 0


def test_prompts(spark):
    r = spark.range(1).select(X.fill(F.lit("a photo of a {label}"), F.lit("x")), X.fill(F.lit(None).cast("string"), F.lit("x")), X.slug_to_text(F.lit("_a_b_")), X.display_name(F.lit("a_b"))).first()
    assert tuple(r) == ("a photo of a x", "x", "a b", "a-b")
    m = spark.range(1).select(G.summary_messages(F.lit("😀" * 30_001), F.lit("q")).alias("m")).first().m
    assert m[1].content.count("😀") == 30_000 and m[0].role == "system" and m[1].content.endswith("Question: q")
    assert spark.range(1).select(X.preview(F.lit("😀" * 600))).first()[0] == "😀" * 500


def test_decoding_of_answers(spark):
    texts = ['x {"ranked_doc_ids":[1,1,99],"filtered_doc_ids":[2]} y', '"ranked_doc_ids": [3, 1] "filtered_doc_ids":[2]', '{"ranked_doc_ids":[1', "{not json}", "none", '{"filtered_doc_ids":[1]}', None, ""]
    got = [r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select(G.decode_selection(F.col("t")).alias("s")).collect()]
    assert [s.ranked_doc_ids for s in got] == [[1, 1, 99], [3, 1], None, None, None, None, None, None]
    assert [s.error is None for s in got] == [True, True] + [False] * 6


def test_candidates_without_a_product_are_an_error(spark):
    lines, own = product(spark, rows=[dict(idx=1), dict(idx=2)]), spark.createDataFrame([("q", 1, 1), ("q", 2, 9)], "query_id string, cand_rank int, idx bigint")
    assert K.candidate_documents(own, lines, strict=False).count() == 1 and K.candidate_documents(own.where("idx = 1"), lines).collect()[0].document.startswith("一级类目")
    with pytest.raises(Exception, match="no idx 9"):
        K.candidate_documents(own, lines).collect()


def test_answers_come_in_batches_and_fail_alone(spark):
    from shelfmark import models

    class Picky:
        def __init__(self, config):
            pass

        def generate(self, prompts, max_new_tokens):
            if any("bad" in p for p in prompts):
                raise ValueError("bad prompt")
            return [f"{len(prompts)}:{p}" for p in prompts]

        def close(self):
            pass

    models.GENERATORS["picky"] = Picky
    try:
        df = spark.createDataFrame([(i, p) for i, p in enumerate(["a", "b", None, "bad", "c", "d", "e"])], "i int, p string").coalesce(1)
        got = {r.i: (r.a.value, r.a.error) for r in df.select("i", models.generated(F.col("p"), models.ModelConfig("picky"), batch_size=2).alias("a")).collect()}
    finally:
        del models.GENERATORS["picky"]
    assert got == {0: ("2:a", None), 1: ("2:b", None), 2: (None, "no prompt"), 3: (None, "bad prompt"), 4: ("1:c", None), 5: ("2:d", None), 6: ("2:e", None)}


def candidates(spark, n=7):
    return spark.createDataFrame([("q", i, 100 + i, f"p{i}", "A" if i % 2 else "B", "img", "doc") for i in range(1, n + 1)], "query_id string, cand_rank int, idx bigint, product_id string, subcategory string, image_path string, document string")


def test_selection_by_a_model(spark):
    c = candidates(spark)
    a = spark.createDataFrame([("q", '{"ranked_doc_ids":[3,1,1,99,2],"filtered_doc_ids":[]}'), ("z", "?")], "query_id string, answer string")
    chosen = sorted(K.select_by_model(a, c).collect(), key=lambda r: r["rank"])
    assert [(r.cand_rank, r.score) for r in chosen] == [(3, 3.0), (1, 5.0), (1, 5.0), (2, 4.0)]
    ratios = K.selection_ratios(K.select_by_model(a, c), c, F.col("subcategory") == "A").first()
    assert ratios.top5_relevance_ratio == 0.75 and ratios.filtered_irrelevant_ratio == 0.5
    row = K.case_rows(K.select_by_model(a, c), c).first()
    assert row.top5_indices == [103, 101, 101, 102] and row.filtered_indices == [104, 105, 106, 107]


def test_ratios_without_filtered_or_selected(spark):
    c = candidates(spark, 5)
    scored = K.rank_by_score(c.withColumn("score", F.lit(1.0)))
    assert [r.cand_rank for r in sorted(scored.collect(), key=lambda r: r["rank"])] == [1, 2, 3, 4, 5]
    assert K.selection_ratios(scored, c, F.col("subcategory") == "A").first().filtered_irrelevant_ratio == 0.0
    none = K.selection_ratios(scored.limit(0), c, F.col("subcategory") == "A").first()
    assert none.top5_relevance_ratio is None
    assert K.selection_ratios(scored.limit(0), c.limit(0), F.lit(True)).count() == 0


def test_links_are_cut_before_they_are_skipped(spark):
    rows = spark.createDataFrame([("s", 1, "a"), ("s", 2, None), ("s", 3, "c"), ("s", 4, "d")], "q string, pos int, link string")
    assert [r.link for r in V.results_to_read(rows, ["q"], "pos", "link").orderBy("pos").collect()] == ["a", "c"]
    payload = '{"organic_results":[{"title":"1","link":"a"},{"title":"2"},{"title":"3","link":"c"},{"title":"4","link":"d"}]}'
    r = spark.createDataFrame([(True, payload, ["u"]), (True, "{}", ["u"]), (False, None, ["u", "v", "w", "x"]), (False, None, None)], "ran boolean, p string, urls array<string>").select(V.links_or_urls(F.col("ran"), F.col("p"), F.col("urls")).alias("x")).collect()
    assert [[i.link for i in x.x] for x in r] == [["a", "c"], [], ["u", "v", "w", "x"], []]
    pages = spark.createDataFrame([("é😀" * 300, None), (None, "timeout"), ("", None)], "content string, error string")
    got = [(r.reader_content_length, r.reader_content_preview and len(r.reader_content_preview)) for r in V.reader_rows(pages).collect()]
    assert got == [(600, 500), (None, None), (0, "")]


def test_report_orders_and_merges(spark):
    rows = spark.createDataFrame([("x", "fr"), ("clip", "en"), ("siglip2", "zh")], "model_name string, input_language string")
    got = P.with_sample_order(rows).orderBy("language_order", "model_order").collect()
    assert [(r.model_name, r.language_order, r.model_order) for r in got] == [("siglip2", 1, 3), ("clip", 2, 1), ("x", 999, 999)]
    with pytest.raises(Exception, match="not in the list"):
        P.in_benchmark_order(rows).collect()
    assert [r.place for r in P.in_benchmark_order(P.variants(spark)).collect()] == list(range(1, 9))
    a = spark.createDataFrame([("m", "s", 0.5, 0.2)], "method_name string, subcategory_slug string, top5_relevant_ratio_gpt double, filtered_correct_ratio_gpt double")
    b = spark.createDataFrame([("m", 1.0, 0.8, "n")], "method_name string, top5_relevant_ratio_gpt double, filtered_correct_ratio_gpt double, notes string")
    s = P.judge_summary(P.merge_judge_batches([a, b])).first()
    assert (s.avg_top5_relevant_ratio_gpt, s.avg_filtered_correct_ratio_gpt, s.case_count) == (0.75, 0.5, 2)
    summary = spark.createDataFrame([("m", 0.932, 0.316, 2), ("gone", 1.0, 1.0, 1)], "method_name string, avg_top5_relevance_ratio double, avg_filtered_irrelevant_ratio double, case_count int")
    assert [tuple(r) for r in P.rerank_table(summary, P.judge_summary(P.merge_judge_batches([a, b]))).collect()] == [("m", "93.2%", "31.6%", "75.0%", "50.0%")]
    assert P.listed(" a, ,b ") == ["a", "b"] and P.suffixed("n", "_1") == "n_1" and P.suffixed("n", "") == "n"
    assert [r.model_name for r in P.restrict(rows, "model_name", "clip, x").orderBy("model_name").collect()] == ["clip", "x"]


# Published macro precision of eight runs at six cut-offs and its mean.
PUBLISHED = [
    ("clip", "en", 0.8400, 0.8533, 0.8360, 0.8040, 0.7590, 0.7136, 0.8010), ("chinese_clip", "en", 0.8400, 0.8067, 0.7680, 0.7460, 0.7010, 0.6436, 0.7509), ("siglip2", "en", 0.9400, 0.9600, 0.9560, 0.9460, 0.9360, 0.9076, 0.9409),
    ("gme_2b", "en", 1.0000, 0.9733, 0.9520, 0.9400, 0.9100, 0.8696, 0.9408), ("clip", "zh", 0.1000, 0.0533, 0.0520, 0.0540, 0.0520, 0.0420, 0.0589), ("chinese_clip", "zh", 0.8200, 0.8267, 0.8200, 0.8040, 0.7840, 0.7424, 0.7995),
    ("siglip2", "zh", 0.9400, 0.8733, 0.8520, 0.8520, 0.8390, 0.8080, 0.8607), ("gme_2b", "zh", 0.8600, 0.8600, 0.8640, 0.8180, 0.8150, 0.7608, 0.8296),
]


def test_published_means(spark):
    cols = ["model_name", "input_language", *[f"avg_precision@{k}" for k in (1, 3, 5, 10, 20, 50)], "published"]
    rows = P.with_mean_precision(spark.createDataFrame(PUBLISHED, cols))
    assert all(abs(r.avg_precision_mean - r.published) < 1e-4 for r in rows.collect())
    table = {(r.model, r.input_language): r for r in P.retrieval_table(rows.drop("published")).collect()}
    assert table["siglip2", "en"].top1 == "94.0%" and table["chinese-clip", "zh"].average == "80.0%"
