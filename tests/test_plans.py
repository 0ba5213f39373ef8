"""Physical plans are the ones wanted: columns pruned, filters pushed down, no product of tables, few Python stages."""

import io
import os
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from shelfmark.operators.ranking import nearest, sample_groups
from shelfmark.plans import registry, retrieval

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_scans_read_only_what_is_used(spark):
    assert "ReadSchema: struct<record_id:bigint,payload:string>" in plan(registry.QUERIES["p2_found"](spark, SF))
    assert "ReadSchema: struct<idx:bigint,image:string>" in plan(registry.QUERIES["slugs"](spark, SF))
    text = plan(spark.read.parquet(f"{SF}/products.parquet").where("idx > 5").select("idx", "title"))
    assert "GreaterThan(idx,5)" in text


def test_search_moves_only_the_best_of_each_partition(spark):
    c = retrieval.corpus(spark, SF)
    text = plan(nearest(retrieval.queries_of(c), c, 10, exclude="own"))
    assert "MapInArrow" in text and "WindowGroupLimit" in text and "Join" not in text and "Cartesian" not in text


def test_sampling_limits_groups_before_the_shuffle(spark):
    text = plan(sample_groups(spark.read.parquet(f"{SF}/qrels.parquet"), "key", "idx", 5, 1))
    assert text.count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - {"i2i_ranked_sql_strategy", "prompts"}))
def test_no_query_multiplies_tables(spark, name):
    text = plan(registry.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_vectors_stay_in_the_jvm(spark):
    from shelfmark.functions.vectors import fuse, l2_normalize

    c = retrieval.corpus(spark, SF)
    assert "Python" not in plan(c.select(l2_normalize(fuse(F.col("vector"), F.col("vector")))))
