"""What is stored asks for no memory that grows with the rows of a file."""

from __future__ import annotations

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from psephos.shared import stored


def test_texts_are_stored_in_small_row_groups(spark):
    """Some 30 MB of text in one file; a task that reads or writes a row group holds it whole."""
    words = F.concat_ws(" ", *[F.sha2(F.concat_ws("-", "id", F.lit(k)), 512) for k in range(8)])
    rows = spark.range(0, 30_000, 1, 1).select("id", words.alias("text"))
    back = stored(rows, "texts")
    (file,) = back.inputFiles()
    found = pq.ParquetFile(file.removeprefix("file://")).metadata
    groups = [found.row_group(k) for k in range(found.num_row_groups)]
    largest = max(g.column(1).total_compressed_size for g in groups)
    print("row groups", len(groups), "bytes of the largest", largest)
    assert largest <= 4 << 20 and max(g.num_rows for g in groups) < 10_000
    assert back.dtypes == rows.dtypes and back.exceptAll(rows).isEmpty() and back.count() == rows.count()
