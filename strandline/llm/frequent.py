"""Problem 1: most frequent items among billions."""

from __future__ import annotations

from fractions import Fraction
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frequent_items(df: DataFrame, column: str, k: int | None = None, min_share: float | None = None) -> DataFrame:
    """The most frequent values of ``column`` as (item, n), by exact spillable aggregation.

    Each task counts its own rows first (map-side combining), so a value that holds a third of all rows reaches the
    shuffle as one row a task; the hash partitions spill to disk, each sends its local top k, and one ordered limit
    merges them. Memory is bounded by Spark's aggregation buffers and k, not by the number of distinct values.

    Give ``k``, or ``min_share``: the share of all rows that a value must reach, null and empty rows counted in the
    total. No more than 1/min_share values can reach it, so that is the k then, and nothing is cut off.

    Nulls and empty strings are never items. Ties at the limit go to the smaller value in byte order. Values are
    compared whole. An empty table gives no rows. Only ``column`` is read, so other columns may have any name.
    """
    if (k is None) == (min_share is None):
        raise ValueError("give either k or min_share")
    values = df.select(F.col(column).alias("item"))
    groups = values.groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter("item is not null and item != ''")
    if k is not None:
        return groups.orderBy(F.desc("n"), "item").limit(k)
    share = Fraction(str(min_share))
    if not 0 < share <= 1:
        raise ValueError("min_share must be over 0 and at most 1")
    need = max(1, ceil(share * df.count()))
    return groups.orderBy(F.desc("n"), "item").limit(int(1 / share)).filter(F.col("n") >= need)
