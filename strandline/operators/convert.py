"""One row in, one row out: opposite strand, RNA, FASTA. Narrow projections that stay in whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import dna_to_rna, mean_quality, reverse_complement, reverse_quality
from strandline.schema import as_float, has_quality, require


def revcomp(df: DataFrame) -> DataFrame:
    """The opposite strand of each read; the quality string is turned round with it."""
    require(df, "sequence")
    out = df.withColumn("sequence", reverse_complement(F.col("sequence")))
    return out.withColumn("quality", reverse_quality(F.col("quality"))) if has_quality(df) else out


def dna2rna(df: DataFrame) -> DataFrame:
    """RNA of each read; the quality string stays."""
    require(df, "sequence")
    return df.withColumn("sequence", dna_to_rna(F.col("sequence")))


def to_fasta(df: DataFrame, min_quality: float | None = None) -> DataFrame:
    """FASTQ as FASTA: the marker changes, the quality goes; reads of a lower mean quality are dropped first."""
    require(df, "header", "sequence", "quality")
    if min_quality is not None:
        df = df.filter(mean_quality(F.col("quality")) >= as_float(min_quality))
    return df.withColumn("header", F.concat(F.lit(">"), F.substring("header", 2, 2**31 - 1))).drop("quality")
