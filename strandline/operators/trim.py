"""Trimming of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import quality_ends, trim_bounds
from strandline.schema import require


def trim_reads(
    df: DataFrame,
    quality_cutoff: int | None = None,
    trim_front: int = 0,
    trim_tail: int = 0,
    max_length: int | None = None,
    min_length: int | None = None,
) -> DataFrame:
    """Each read cut to its bounds (see ``quality_ends`` and ``trim_bounds``), sequence and quality alike; what is then shorter than
    ``min_length`` is dropped. Reads that are trimmed to nothing stay as empty reads otherwise."""
    require(df, "sequence", "quality")
    if min(trim_front, trim_tail, quality_cutoff or 0, max_length or 0) < 0:
        raise ValueError("trimming takes no negative numbers")
    names = df.columns
    head, end = quality_ends(F.col("quality"), quality_cutoff)
    if quality_cutoff:
        # A generator of one row: the optimizer would copy these expressions into every use and every later filter.
        df = df.select("*", F.inline(F.array(F.struct(head.alias("__head"), end.alias("__end")))))
        head, end = F.col("__head"), F.col("__end")
    first, size = trim_bounds(head, end, F.length("sequence"), trim_front, trim_tail, max_length)
    if min_length is not None:
        df = df.filter(size >= min_length)
    cut = lambda name: F.substring(F.col(name), first + 1, size).alias(name)
    return df.select(*[cut(c) if c in ("sequence", "quality") else F.col(c) for c in names])
