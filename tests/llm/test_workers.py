"""Batches of Arrow functions."""

import pyarrow as pa
import pytest

from dwellspark.llm import workers


ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("own, rows", [(None, 2000), ("700", 700)])
def test_batches_are_small_unless_set(spark, own, rows):
    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows])], names=["n"])

    try:
        if own:
            spark.conf.set(ROWS, own)
        got = [r["n"] for r in workers.map_batches(spark.range(0, 5000, 1, 1), sizes, "n long").collect()]
    finally:
        spark.conf.unset(ROWS)
    assert sum(got) == 5000 and max(got) == rows


def test_batches_of_long_rows_hold_few(spark):
    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows])], names=["n"])

    got = [r["n"] for r in workers.map_batches(spark.range(0, 40, 1, 1).selectExpr("repeat('x', 1000000) as t"), sizes, "n long").collect()]
    assert sum(got) == 40 and max(got) <= 5
