"""How the stored index of problem 9 is laid out in its files."""

import pyarrow.parquet as pq

from isoweave.llm import leakage


def test_a_row_group_of_the_index_holds_one_block(spark):
    blocks = 4
    n = (blocks - 1) * leakage.BLOCK_DOCS + 1
    index = leakage.build_index(spark.range(n).coalesce(1).selectExpr("id AS doc_id", "concat('text of document ', id) AS text"))
    groups = [m.row_group(i).num_rows for f in index.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file://")).metadata] for i in range(m.num_row_groups)]
    assert groups == [1] * blocks
    assert sum(len(r.docs) for r in index.select("docs").toLocalIterator()) == n
