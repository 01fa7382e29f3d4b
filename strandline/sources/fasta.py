"""FASTA files through the built-in text source, split-safe and in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import strip_whitespace
from strandline.runtime import small, stage

#: A record begins where a line begins with the marker; splitting there makes every file splittable by Spark itself.
SEPARATOR = "\n>"


def parse_record(value: Column) -> tuple[Column, Column]:
    """(header, sequence) of the text between two separators."""
    head = F.substring_index(value, "\n", 1)
    body = F.substring(value, F.length(head) + 2, F.length(value))
    return F.concat(F.lit(">"), head), strip_whitespace(body)


def _after_first_marker(value: Column) -> Column:
    return F.substring(value, F.instr(value, ">") + 1, F.length(value))


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Reads (idx, header, sequence) of files, folders or globs, ``.gz`` ones included, numbered in order of path.

    A header is all of its line after the marker, untrimmed; a sequence is all lines up to the next line that begins
    with the marker, without white space. Sequences may be empty. Anything before the first marker of a file is skipped.
    The rows are written once as Parquet, so that their numbers are fixed and later passes don't parse text again.
    """
    raw = spark.read.option("lineSep", SEPARATOR).text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    raw = stage(raw, "fasta")
    blocks = raw.groupBy("file", "block").agg(F.min("at").alias("low"))
    # The text before the first separator is a record only if it has a marker itself; so it is dropped before counting.
    marked = raw.join(small(blocks), ["file", "block"]).withColumn("first", (F.col("block") == 0) & (F.col("at") == F.col("low")))
    marked = marked.filter(~F.col("first") | (F.instr("value", ">") > 0))
    sizes = marked.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("start"))
    order = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    # One row a file split.
    before = sizes.select("file", "block", "start", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    value = F.when(F.col("first"), _after_first_marker(F.col("value"))).otherwise(F.col("value"))
    header, sequence = parse_record(value)
    return marked.join(small(before), ["file", "block"]).select(
        (F.col("before") + F.col("at") - F.col("start")).alias("idx"), header.alias("header"), sequence.alias("sequence")
    )
