"""Findings of the fourth round on the operators for training data."""

from urllib.parse import urlparse

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from trailhead.llm import packing


def test_row_groups_of_matrices_are_bounded_by_bytes(spark):
    """What a writer holds and a reader takes at once doesn't grow with the sequences of a task."""
    zeros = F.expr(f"unhex(repeat('0000', {packing.LENGTH}))")
    packed = spark.range(0, 24 * packing.MATRIX_ROWS, 1, 1).select(
        F.col("id").alias("pack_id"), F.array("id").alias("doc_ids"), F.array(F.lit(0).cast("long")).alias("doc_starts"), F.array(F.lit(0), F.lit(packing.LENGTH)).alias("cu_seqlens"), zeros.alias("ids"), zeros.alias("positions")
    )
    stored = packing.write_matrices(packed)
    groups = []
    for file in stored.inputFiles():
        made = pq.ParquetFile(urlparse(file).path).metadata
        groups += [made.row_group(i) for i in range(made.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 24
    assert max(g.total_byte_size for g in groups) < 24 << 20
    assert packing.read_matrices(stored).count() == 24 * packing.MATRIX_ROWS
