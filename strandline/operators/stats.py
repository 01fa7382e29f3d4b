"""Summary statistics of reads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import read_length
from strandline.runtime import bound_arrow_batches
from strandline.schema import require

BINS = 10
_PARTIAL = "reads long, bases long, shortest long, longest long, score long, gc long, n long"
_GC = np.isin(np.arange(256), [ord(c) for c in "GCgc"])
_N = np.isin(np.arange(256), [ord(c) for c in "Nn"])
_SCORE = np.maximum(np.arange(256) - 33, 0)


def _bytes(column: pa.Array) -> np.ndarray:
    """All bytes of a string column, end to end, without a copy."""
    column = column.fill_null("") if column.null_count else column
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(column.type) else np.int32)
    return np.frombuffer(data, np.uint8)[at[column.offset] : at[column.offset + len(column)]]


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        sizes = pa.compute.binary_length(batch["sequence"]).fill_null(0).to_numpy(zero_copy_only=False)
        bases = np.bincount(_bytes(batch["sequence"]), minlength=256)
        scores = np.bincount(_bytes(batch["quality"]), minlength=256)
        row = [len(batch), sizes.sum(), sizes.min(), sizes.max(), scores @ _SCORE, bases[_GC].sum(), bases[_N].sum()]
        names = [x.split()[0] for x in _PARTIAL.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in row], names)


def stats(df: DataFrame) -> DataFrame:
    """One row: total_reads, total_bases, min_length, max_length, mean_length, mean_quality, gc_percentage,
    n_percentage. Everything is 0 for an empty input; the mean quality is over bases, not over reads. A null sequence
    or quality counts as an empty one.

    One Arrow pass turns each batch into one row of sums by counting bytes, and only those rows are aggregated.
    """
    require(df, "sequence", "quality")
    bound_arrow_batches(df.sparkSession)
    parts = df.select("sequence", "quality").mapInArrow(_partials, _PARTIAL)
    sums = parts.agg(
        F.coalesce(F.sum("reads"), F.lit(0)).alias("total_reads"),
        F.coalesce(F.sum("bases"), F.lit(0)).alias("total_bases"),
        F.coalesce(F.min("shortest"), F.lit(0)).alias("min_length"),
        F.coalesce(F.max("longest"), F.lit(0)).alias("max_length"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"_{c}") for c in ("score", "gc", "n")],
    )
    return summary(sums)


def summary(sums: DataFrame) -> DataFrame:
    """The statistics from sums: total_reads, total_bases, min_length, max_length, _score, _gc and _n."""
    over = lambda a, b, by=1.0: F.when(F.col(b) > 0, F.col(a) * F.lit(by) / F.when(F.col(b) > 0, F.col(b))).otherwise(0.0)
    return sums.select(
        "total_reads",
        "total_bases",
        "min_length",
        "max_length",
        over("total_bases", "total_reads").alias("mean_length"),
        over("_score", "total_bases").alias("mean_quality"),
        over("_gc", "total_bases", 100.0).alias("gc_percentage"),
        over("_n", "total_bases", 100.0).alias("n_percentage"),
    )


def length_histogram(df: DataFrame, bin_size: int | None = None) -> DataFrame:
    """(bin, range_start, range_end, reads) of the lengths in ten bins; empty bins are left out, the last is open.

    Without ``bin_size`` a bin is a tenth of the first read's length, at least 1. A stream, which has no first read,
    needs it given. A null sequence has length 0.
    """
    require(df, "idx", "sequence")
    sizes = df.select("idx", F.coalesce(read_length(F.col("sequence")), F.lit(0)).alias("size"))
    if bin_size is None:
        first = sizes.agg(F.min_by("size", "idx").alias("size")).first()
        bin_size = max((first["size"] or 0) // BINS, 1)
    found = sizes.groupBy(F.least(F.floor(F.col("size") / bin_size), F.lit(BINS - 1)).cast("int").alias("bin"))
    return found.agg(F.count(F.lit(1)).alias("reads")).select(
        "bin",
        (F.col("bin") * bin_size).cast("long").alias("range_start"),
        ((F.col("bin") + 1) * bin_size).cast("long").alias("range_end"),
        "reads",
    )


# The report's headings and labels.
REPORT = (
    ("FASTQ Statistics", "=", (("Total reads:", "total_reads", "{}"), ("Total bases:", "total_bases", "{}"))),
    (
        "Length Statistics",
        "-",
        (("Min length:", "min_length", "{}"), ("Max length:", "max_length", "{}"), ("Mean length:", "mean_length", "{:.2f}")),
    ),
    ("Quality Statistics", "-", (("Mean quality:", "mean_quality", "{:.2f}"),)),
    ("Base Composition", "-", (("GC content:", "gc_percentage", "{:.2f}%"), ("N-bases:", "n_percentage", "{:.2f}%"))),
)
DISTRIBUTION = "Length Distribution"
BAR, BAR_WIDTH, LABEL_WIDTH = "\u2588", 40, 18


def format_report(summary: DataFrame, histogram: DataFrame | None = None) -> str:
    """The statistics as text for a terminal, in sections; both inputs have ten rows at most. Bins without reads, and
    the histogram of no reads, are left out."""
    row = summary.first()
    sections = [
        [title, rule * len(title), *(label.ljust(LABEL_WIDTH) + form.format(row[name]) for label, name, form in lines)]
        for title, rule, lines in REPORT
    ]
    bins = histogram.orderBy("bin").collect() if histogram is not None else []
    if bins:
        most = max(r.reads for r in bins)
        bars = [f"{r.range_start:4}-{r.range_end:<4}  {r.reads:8}  {BAR * (BAR_WIDTH * r.reads // most)}" for r in bins]
        sections.append([DISTRIBUTION, "-" * len(DISTRIBUTION), *bars])
    return "\n\n".join("\n".join(x) for x in sections)
