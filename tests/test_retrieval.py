"""Rankings, routes, fusion and metrics on small cases, one for each trap."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.functions.vectors import fuse, l2_normalize
from shelfmark.operators import metrics as M
from shelfmark.operators import ranking as R
from shelfmark.operators.cases import rank_routes, repeat_cases
from shelfmark.operators.fusion import aggregate_lists, merge_routes


def corpus(spark, rows):
    return spark.createDataFrame([(i, v) for i, v in rows], "idx bigint, vector array<float>")


def lists(spark, rows, by="query_id"):
    return spark.createDataFrame([(q, r, i) for q, items in rows.items() for r, i in enumerate(items, 1)], f"{by} bigint, rank int, idx bigint")


def order(df, by="query_id"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r[by], r["rank"])):
        out.setdefault(r[by], []).append(r["idx"])
    return out


@pytest.mark.parametrize("strategy", ["block", "sql"])
def test_nearest_ties_exclusion_and_short_lists(spark, strategy):
    c = corpus(spark, [(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (4, [float("nan"), 0.0]), (5, None)])
    q = spark.createDataFrame([(10, [1.0, 0.1], 2), (11, [0.0, 1.0], None)], "query_id bigint, vector array<float>, own bigint")
    assert order(R.nearest(q, c, 50, exclude="own", strategy=strategy)) == {10: [1, 3, 4], 11: [2, 1, 3, 4]}
    assert order(R.nearest(q, c, 50, exclude="own", how="last", strategy=strategy))[10][-2:] == [2, 4]
    assert order(R.nearest(q, c, 1, strategy=strategy)) == {10: [1], 11: [2]}
    assert R.nearest(q.limit(0), c, 3, strategy=strategy).count() == 0
    assert R.nearest(q, c.limit(0), 3, strategy=strategy).count() == 0


def test_block_strategy_agrees_with_brute_force_in_blocks(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(1300, 8)).astype(np.float32)
    c = corpus(spark, [(i, v.tolist()) for i, v in enumerate(vectors)]).repartition(3)
    q = c.where("idx % 100 = 0").select(F.col("idx").alias("query_id"), "vector", F.col("idx").alias("own"))
    got = order(R.nearest(q, c, 7, exclude="own", block=4))
    for i in range(0, 1300, 100):
        s = vectors.astype(float) @ vectors[i].astype(float)
        s[i] = -np.inf
        assert got[i] == np.argsort(-s, kind="stable")[:7].tolist()


def test_rank_of_positive(spark):
    c = corpus(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])])
    q = spark.createDataFrame([(1, [1.0, 0.0], 2), (2, [1.0, 0.0], 3), (3, [0.0, 1.0], 3)], "query_id bigint, vector array<float>, positive bigint")
    ranks = R.rank_of_positive(q, c)
    assert {r.query_id: r["rank"] for r in ranks.collect()} == {1: 2, 2: 3, 3: 1}
    m = M.single_positive(ranks).first()
    assert (m["recall@1"], m["median_rank"], m["mean_rank"]) == (pytest.approx(1 / 3), 2.0, 2.0) and m["mrr"] == pytest.approx((1 / 2 + 1 / 3 + 1) / 3)


def test_fusion_of_opposite_vectors_is_zero_not_nan(spark):
    r = spark.range(1).select(fuse(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(-1.0), F.lit(0.0))).alias("z"), fuse(F.array(F.lit(3.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(3.0))).alias("u"), l2_normalize(F.array(F.lit(0.0), F.lit(0.0))).alias("n")).first()
    assert r.z == [0.0, 0.0] and r.n == [0.0, 0.0] and r.u == pytest.approx([math.sqrt(0.5)] * 2)


def test_merge_takes_the_next_of_the_second_route(spark):
    text, image = lists(spark, {1: [1, 2, 3, 4, 5, 6], 2: [1, 1, 2]}), lists(spark, {1: [5, 4, 3, 2, 1, 9, 8, 7, 6, 10, 11], 2: [2, 3]})
    assert order(merge_routes(text, image)) == {1: [1, 2, 3, 4, 5, 9, 8, 7, 6, 10], 2: [1, 2, 3]}
    assert order(merge_routes(text, image, 0))[1] == [1, 2, 3, 4, 5, 6, 9, 8, 7, 10, 11]
    assert order(merge_routes(text.limit(0), image, 2)) == {1: [5, 4], 2: [2, 3]}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=12), st.lists(st.integers(0, 12), max_size=12), st.integers(1, 5))
def test_merge_against_a_loop(spark, a, b, per):
    want, first = [], list(dict.fromkeys(a))[:per]
    want = first + [x for x in dict.fromkeys(b) if x not in first][:per]
    got = order(merge_routes(lists(spark, {1: a}), lists(spark, {1: b}), per))
    assert got.get(1, []) == want


def test_aggregation_order(spark):
    rows = spark.createDataFrame([("k", 1, 1, 5), ("k", 2, 2, 5), ("k", 1, 2, 6), ("k", 2, 1, 6), ("k", 1, 3, 8), ("k", 2, 3, 7)], "key string, repeat_id int, rank int, idx bigint")
    got = [(r.idx, r.score, r.hits, r.best_rank) for r in sorted(aggregate_lists(rows, "key", "repeat_id", 3).collect(), key=lambda r: r["rank"])]
    assert got == [(5, 1.5, 2, 1), (6, 1.5, 2, 1), (7, pytest.approx(1 / 3), 1, 3)]


def test_metrics_divide_by_k_and_leave_recall_open(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id bigint")
    rel = spark.createDataFrame([(1, 10), (1, 10), (1, 11), (3, 12)], "query_id bigint, idx bigint")
    m = {r.query_id: r for r in M.per_query(lists(spark, {1: [10, 99, 11], 2: [10]}), rel, q).collect()}
    assert m[1]["precision@50"] == 2 / 50 and m[1]["recall@3"] == 1.0 and m[1]["precision@1"] == 1.0 and m[1].positive_count == 2.0
    assert m[2]["recall@1"] is None and m[2]["hit@50"] == 0.0 and m[3]["precision@1"] == 0.0 and m[3]["recall@50"] == 0.0
    s = M.macro(M.per_query(lists(spark, {1: [10, 99, 11], 2: [10]}), rel, q)).first()
    assert s["avg_recall@3"] == 0.5 and s["query_count"] == 3
    assert M.per_query(lists(spark, {1: [1]}).limit(0), rel.limit(0), q.limit(0)).count() == 0


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(0, 60), unique=True, max_size=60), st.sets(st.integers(0, 60), min_size=1, max_size=20))
def test_metric_invariants(spark, ranked, relevant):
    q = spark.createDataFrame([(1,)], "query_id bigint")
    rel = spark.createDataFrame([(1, i) for i in relevant], "query_id bigint, idx bigint")
    m = M.per_query(lists(spark, {1: ranked}), rel, q).first()
    assert all((m[f"hit@{k}"] > 0) == (m[f"precision@{k}"] > 0) for k in M.KS)
    recalls = [m[f"recall@{k}"] for k in M.KS]
    assert recalls == sorted(recalls)


def test_sampling_is_stable_without_replacement_and_strict(spark):
    rows = spark.createDataFrame([("a", i) for i in range(20)] + [("b", 1)], "key string, idx bigint")
    pick = lambda: sorted(tuple(r) for r in R.sample_groups(rows.repartition(3), "key", "idx", 5, 7).collect())
    assert pick() == pick() and len({r[1] for r in pick() if r[0] == "a"}) == 5 and len([r for r in pick() if r[0] == "b"]) == 1
    with pytest.raises(Exception, match="fewer than 5"):
        R.sample_groups(rows, "key", "idx", 5, 7, strict=True).collect()


def test_reference_is_in_none_of_its_routes(spark):
    rng = np.random.default_rng(1)
    c = corpus(spark, [(i, rng.normal(size=4).tolist()) for i in range(4)])
    members = spark.createDataFrame([("a", 0), ("a", 1), ("b", 2), ("b", 3)], "key string, idx bigint")
    cases = repeat_cases(members, 1, 5)
    texts = spark.createDataFrame([("a", [1.0, 0.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0, 0.0])], "key string, vector array<double>")
    routes = rank_routes(cases, texts, c).join(cases, "case_id").collect()
    assert all(r.idx != r.reference for r in routes)
    assert {(r.case_id, r.route): 0 for r in routes}.keys() == {(k, n) for k in {r.case_id for r in routes} for n in ("text_to_image", "image_to_image", "image_text_to_image", "multi_route")}
    assert max(r["rank"] for r in routes) == 3


def test_first_best_row_wins(spark):
    rows = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 2.0)], "pos int, s double")
    assert R.first_best(rows, F.col("s"), "pos").first().pos == 1


def test_equal_vectors_tie_wherever_they_stand(spark):
    """Duplicates in other partitions and places of a batch have the same score to the last bit."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(60, 33))
    vectors = base[np.arange(600) % 60]
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "idx bigint, vector array<double>").repartition(5)
    queries = spark.createDataFrame([(q, rng.normal(size=33).tolist(), int(rng.integers(0, 600))) for q in range(40)], "query_id bigint, vector array<double>, positive bigint")
    score = {r.query_id: (vectors * np.array(r.vector)).sum(axis=1) for r in queries.collect()}
    want = {r.query_id: 1 + sum(1 for i in range(600) if (-score[r.query_id][i], i) < (-score[r.query_id][r.positive], r.positive)) for r in queries.collect()}
    for block in (None, 7):
        assert {r.query_id: r["rank"] for r in R.rank_of_positive(queries, corpus, block=block).collect()} == want
        got = {}
        for r in R.nearest(queries, corpus, 25, block=block).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.idx)
        assert got == {q: np.lexsort((np.arange(600), -s))[:25].tolist() for q, s in score.items()}


def test_norms_are_computed_once_a_vector(spark):
    import time

    took = []
    for size in (256, 2048):
        df = spark.range(400).selectExpr("id", f"transform(sequence(1, {size}), i -> cast(i + id as double)) as v").cache()
        df.count()
        best = 1e9
        for _ in range(3):
            began = time.time()
            df.select(l2_normalize(F.col("v")).alias("a"), fuse(F.col("v"), F.col("v")).alias("b")).write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - began)
        took.append(best)
    # Eight times the size; the square would be sixty-four times.
    assert took[1] < 30 * took[0]
    assert spark.range(1).select(l2_normalize(F.lit(None).cast("array<double>"))).first()[0] is None
