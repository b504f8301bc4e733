"""Operators that hand whole texts to Python turn a bounded number of rows into objects at once."""

from stratafind.operators import chunking


def test_rows_come_in_slices_and_results_stay(spark):
    docs = spark.range(1001).selectExpr("id AS doc_id", "concat('# Head ', id, '\\nfirst. second.') AS text").coalesce(1)
    found = chunking.sections(docs)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= chunking.BATCH_ROWS
    assert {r.doc_id for r in found.collect()} == set(range(1001))
    assert chunking.sections(docs.limit(0)).collect() == []
