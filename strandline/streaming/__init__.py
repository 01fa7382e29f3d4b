"""The operators over unbounded input, with Structured Streaming.

Filters, trimming, conversion and the like are narrow, so they take a streaming DataFrame as it is. What needs state or
an order is here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.functions import gc_count, n_count, phred_sum, read_length
from strandline.operators.sampling import reservoir_slot
from strandline.operators.pairs import deinterleave, interleave
from strandline.operators.stats import BINS, summary
from strandline.sources.fasta import SEPARATOR, parse_record
from strandline.sources.fastq import FastqDataSource


def read_fasta_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """(header, sequence) of FASTA files as they are put in a folder; each file must begin with its marker."""
    source = spark.readStream.option("lineSep", SEPARATOR)
    if max_files:
        source = source.option("maxFilesPerTrigger", max_files)
    value = F.regexp_replace("value", r"^\s*>", "")
    header, sequence = parse_record(value)
    return source.text(path).select(header.alias("header"), sequence.alias("sequence"))


def read_fastq_stream(spark: SparkSession, path: str, mode: str = "FAILFAST", wrapped: bool = False) -> DataFrame:
    """(header, sequence, quality) of FASTQ files as they are put in a folder, ``.gz`` ones included."""
    spark.dataSource.register(FastqDataSource)
    return spark.readStream.format("fastq").options(mode=mode, wrapped=str(wrapped).lower()).load(path)


def dedup_stream(df: DataFrame) -> DataFrame:
    """The first arrival of each sequence; the state grows with the number of distinct sequences."""
    return df.dropDuplicates(["sequence"])


def stats_stream(df: DataFrame) -> DataFrame:
    """The running statistics for complete mode, with the columns of ``operators.stats``."""
    size = F.coalesce(read_length(F.col("sequence")), F.lit(0))
    total = lambda column: F.coalesce(F.sum(column), F.lit(0))
    return summary(
        df.agg(
            F.count(F.lit(1)).alias("total_reads"),
            total(size).alias("total_bases"),
            F.coalesce(F.min(size), F.lit(0)).alias("min_length"),
            F.coalesce(F.max(size), F.lit(0)).alias("max_length"),
            total(phred_sum(F.col("quality"))).alias("_score"),
            total(gc_count(F.col("sequence"))).alias("_gc"),
            total(n_count(F.col("sequence"))).alias("_n"),
        )
    )


def length_histogram_stream(df: DataFrame, bin_size: int) -> DataFrame:
    """The ten-bin length histogram for complete mode; a stream has no first read, so the bin size is given."""
    size = F.coalesce(read_length(F.col("sequence")), F.lit(0))
    found = df.groupBy(F.least(F.floor(size / bin_size), F.lit(BINS - 1)).cast("int").alias("bin"))
    return found.agg(F.count(F.lit(1)).alias("reads")).select(
        "bin", (F.col("bin") * bin_size).cast("long").alias("range_start"), ((F.col("bin") + 1) * bin_size).cast("long").alias("range_end"), "reads"
    )


def reservoir_stream(df: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """The reservoir sample of the reads so far, for complete mode; the source must number them in ``idx``."""
    row = F.struct(*df.columns)
    entered = df.withColumn("slot", reservoir_slot(F.col("idx"), k, seed)).filter("slot is not null")
    return entered.groupBy("slot").agg(F.max_by(row, "idx").alias("row")).select("slot", "row.*")


def interleave_stream(
    r1: DataFrame, r2: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Interleave the mates that arrive in the same micro-batch of two streams, which must number their reads in idx.

    Both streams are read by one query, told apart by a column, so that a micro-batch holds what is available of both.
    """
    both = r1.withColumn("__mate", F.lit(0)).unionByName(r2.withColumn("__mate", F.lit(1)))
    pick = lambda batch, mate: batch.filter(F.col("__mate") == mate).drop("__mate")
    return each_batch(both, lambda batch: interleave(pick(batch, 0), pick(batch, 1)), sink, checkpoint)


def deinterleave_stream(
    df: DataFrame, sink: Callable[[DataFrame, DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Part each micro-batch into (R1, R2), positions counted within it; the source must number its reads in idx."""
    return each_batch(df, deinterleave, lambda halves, epoch: sink(*halves, epoch), checkpoint)


def each_batch(df: DataFrame, operator: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run an operator that needs a whole table, such as a sort, on each micro-batch of what is available now."""
    write = df.writeStream.foreachBatch(lambda batch, epoch: sink(operator(batch), epoch))
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
