"""Partitions whose number follows the rows, so that a task's memory doesn't grow with the input.

Adaptive execution joins small partitions up to a size in *compressed* bytes. Rows that compress well make few, large tasks: the sorts and
hash tables of such a stage grow with the input until that size is reached. Stages that build much from each row are dealt by number instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

#: Rows of one partition.
EACH = 400_000


def parts_for(df: DataFrame, rows: int, each: int = EACH) -> int:
    """How many partitions hold ``rows`` rows at ``each`` rows a partition; one for each core at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each))


def dealt(df: DataFrame, keys: Sequence[str], rows: int, each: int = EACH) -> DataFrame:
    """``df`` dealt by ``keys`` into the partitions that ``rows`` rows need. Joins, windows and groups on the same keys follow it."""
    return df.repartition(parts_for(df, rows, each), *keys)
