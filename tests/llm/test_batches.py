"""Whole texts reach Python workers in bounded batches in every stage of the pipeline."""

from __future__ import annotations

import corpus_pipeline
import pyarrow as pa

from tutorloom.llm.common import BATCH_ROWS

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_the_pipeline_bounds_the_rows_of_a_batch(spark):
    before = spark.conf.get(KEY)
    docs = spark.range(3 * BATCH_ROWS, numPartitions=1).selectExpr("id AS doc_id", "concat('the line number ', id) AS text", "'en' AS lang", "20L AS n_chars")
    try:
        for given, want in (("10000", BATCH_ROWS), ("0", BATCH_ROWS), ("100", 100)):
            spark.conf.set(KEY, given)
            corpus_pipeline.line_dedup(spark, docs, "")
            sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
            assert max(r["n"] for r in sizes) == want
    finally:
        spark.conf.set(KEY, before)
