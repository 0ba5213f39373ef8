"""The registered queries over the whole smallest tables."""

import os

import pytest

from shelfmark.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")

COLUMNS = {
    "p1_found": {"field": "string", "idx_a": "bigint", "idx_b": "bigint"},
    "p3_found": {"idx": "bigint", "field": "string", "canonical": "string"},
    "p4_found": {"idx_a": "bigint", "idx_b": "bigint"},
    "p5_found": {"result_id": "bigint", "line_no": "bigint"},
    "p6_ids": {"doc_id": "bigint", "ids": "array<int>"},
    "p7_found": {"doc_id": "bigint", "item_id": "bigint"},
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows and (name not in COLUMNS or dict(df.dtypes) == COLUMNS[name])
    if name not in ("p6_ids", "p8_pieces"):
        assert len({tuple(r) for r in rows}) == len(rows)


def test_every_document_has_ids_and_every_text_its_pieces(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = {r.doc_id: r.ids for r in queries.p6_ids(spark, SF).collect()}
    assert ids.keys() == docs.keys() and all(bool(ids[k]) == bool(t) for k, t in docs.items())
    joined = {}
    for r in queries.p8_pieces(spark, SF).orderBy("doc_id", "piece_no").collect():
        joined[r.doc_id] = joined.get(r.doc_id, "") + r.text[r.overlap_chars :]
    assert joined == {k: t for k, t in docs.items() if t}
