from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from lumenframe.llm import common as C


@pytest.mark.parametrize("n", [0, 1, 7, 1024, 1025, 5000])
def test_blocks_by_tree_and_by_search(spark, n):
    bounds = [3 * i - 50 for i in range(n)]
    got = spark.range(-80, 3 * n + 10, 1 if n < 100 else 7).select("id", C.block_of(F.col("id"), bounds).alias("b")).collect()
    assert all(r["b"] == bisect_right(bounds, r["id"]) for r in got)


def test_bounds_cut_into_even_ranges(spark):
    bounds = C.block_bounds(spark.range(10_000), F.col("id"), 8)
    assert len(bounds) == 7 and all(abs(b - 1250 * (i + 1)) < 130 for i, b in enumerate(bounds))
    assert C.block_bounds(spark.range(0), F.col("id"), 8) == [] and C.block_bounds(spark.range(5), F.col("id"), 1) == []
