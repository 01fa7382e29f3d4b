"""The tables of a data folder as reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import strip_whitespace

COLUMNS = ("idx", "header", "sequence", "quality")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fastq_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every FASTQ row, white space stripped from sequence and quality, whether or not the quality is valid."""
    return all_fastq(spark, sf_dir).select(
        "idx", "header", *[strip_whitespace(F.col(c)).alias(c) for c in ("sequence", "quality")]
    )


def all_fastq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every FASTQ row as it came, numbered without gaps."""
    return table(spark, sf_dir, "fastq_reads").select(*COLUMNS)


def fastq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The well-formed FASTQ records, as the reader's DROPMALFORMED mode gives them: white space is stripped, and the
    quality is as long as the sequence."""
    return fastq_bases(spark, sf_dir).filter(F.length("sequence") == F.length("quality"))


def fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every FASTA record, white space stripped from its body."""
    return table(spark, sf_dir, "fasta_reads").select("idx", "header", strip_whitespace(F.col("sequence")).alias("sequence"))


_WS = r"'[ \t\r\n]', '', 'g'"

#: The same relations in SQL.
ALL_FASTQ_SQL = "(SELECT idx, header, sequence, quality FROM fastq_reads)"
BASES_SQL = (
    f"(SELECT idx, header, regexp_replace(sequence, {_WS}) AS sequence, regexp_replace(quality, {_WS}) AS quality FROM fastq_reads)"
)
FASTQ_SQL = f"(SELECT * FROM {BASES_SQL} WHERE length(sequence) = length(quality))"
FASTA_SQL = f"(SELECT idx, header, regexp_replace(sequence, {_WS}) AS sequence FROM fasta_reads)"
