"""Filters by length, N content and mean quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import mean_quality, n_fraction, read_length
from strandline.schema import as_float, in_unit, require


def filter_reads(
    df: DataFrame,
    min_quality: float | None = None,
    min_length: int | None = None,
    max_length: int | None = None,
    max_n_fraction: float | None = None,
) -> DataFrame:
    """Reads that meet every limit given; a limit not given is not applied, and reads at a limit stay.

    Length and N content are judged in the JVM, before any read goes to Python for its quality. Thresholds of quality
    and N content are compared in single precision. An empty read has no N content, so it passes that limit.
    """
    in_unit("max_n_fraction", max_n_fraction)
    sequence = F.col("sequence")
    if min_length is not None:
        df = df.filter(read_length(sequence) >= min_length)
    if max_length is not None:
        df = df.filter(read_length(sequence) <= max_length)
    if max_n_fraction is not None:
        df = df.filter(F.coalesce(n_fraction(sequence) <= as_float(max_n_fraction), F.lit(True)))
    if min_quality is not None:
        require(df, "quality")
        df = df.filter(mean_quality(F.col("quality")) >= as_float(min_quality))
    return df
