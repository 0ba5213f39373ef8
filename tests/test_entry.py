import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 45


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() == 6 and set(df.columns) == {"k", "precision", "recall", "hit", "query_count"}
