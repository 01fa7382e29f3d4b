"""Paired reads: two files as one, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.runtime import positions
from strandline.schema import require


def _extent(df: DataFrame) -> tuple[int, bool]:
    """(rows, whether idx is 0, 1, 2, ...), by one aggregation over idx."""
    low, high, n = df.agg(F.min("idx"), F.max("idx"), F.count(F.lit(1))).first()
    return n, n == 0 or (low == 0 and high == n - 1)


def interleave(r1: DataFrame, r2: DataFrame) -> DataFrame:
    """R1[0], R2[0], R1[1], R2[1], ...: mates stand next to each other by ``idx``.

    Positions decide, names are not compared, so no join is needed: each side's new idx follows from its old one, which
    is counted anew where it has gaps. Both sides must have as many reads; this is checked before anything is read in
    full.
    """
    require(r1, "idx")
    require(r2, "idx")
    (one, dense1), (two, dense2) = _extent(r1), _extent(r2)
    if one != two:
        raise ValueError(f"R{1 if one > two else 2} has extra reads: {one} and {two}")
    side = lambda df, mate: df.withColumn("idx", F.col("idx") * 2 + mate)
    return side(positions(r1, dense1), 0).unionByName(side(positions(r2, dense2), 1))


def deinterleave(df: DataFrame, dense: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(R1, R2): the reads at even and at odd positions, each numbered anew. With an odd total R1 is longer by one.

    An idx with gaps is counted anew first; ``dense`` tells that there are none, or that there are, and saves a look.
    """
    require(df, "idx")
    df = positions(df, dense)
    side = lambda mate: df.filter(F.col("idx") % 2 == mate).withColumn("idx", F.expr("idx div 2"))
    return side(0), side(1)
