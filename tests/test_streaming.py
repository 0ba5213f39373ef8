from shelfmark.operators.nested import flatten_payloads
from shelfmark.streaming.feed import arrivals, children, once, read_feed

SCHEMA = "record_id bigint, feed string, payload string, received_at timestamp"


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_feed(spark, tmp_path):
    rows = [(1, "a", '{"colors": ["r", "g"]}', "2026-01-01 00:00:00"), (2, "a", "{", "2026-01-01 10:00:00"), (1, "a", '{"colors": ["r", "g"]}', "2026-01-01 12:00:00"), (3, "b", None, "2026-01-05 00:00:00")]
    df = spark.createDataFrame(rows, "record_id bigint, feed string, payload string, t string").selectExpr("record_id", "feed", "payload", "cast(t as timestamp) received_at")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    feed = lambda: read_feed(spark, str(tmp_path / "in"), SCHEMA, 1)
    assert sorted(run(children(feed()), "kids").collect()) == sorted(flatten_payloads(df).collect())
    assert sorted(r.record_id for r in run(once(feed()), "once").collect()) == [1, 2, 3]
    got = {(r.feed, str(r.start), r.records) for r in run(arrivals(feed()), "arrivals").collect()}
    assert got == {("a", "2026-01-01 00:00:00", 3)}
