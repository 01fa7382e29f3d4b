"""Reads as text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.schema import FORMATS, has_quality, require


def record_text(kind: str) -> Column:
    """A whole record as one string: sequences on one line, a bare ``+`` between sequence and quality.

    A null header or sequence is written as an empty one. A FASTQ record whose quality isn't as long as its sequence
    (a null one has no length) can't be read back, so it is an error.
    """
    if kind not in FORMATS:
        raise ValueError(f"kind must be one of {FORMATS}, not {kind!r}")
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    if kind == "fasta":
        return F.concat_ws("\n", text("header"), text("sequence"))
    whole = F.concat_ws("\n", text("header"), text("sequence"), F.lit("+"), text("quality"))
    wrong = F.concat(F.lit("quality and sequence differ in length: "), text("header"))
    return F.when(F.length(text("sequence")) == F.length(text("quality")), whole).otherwise(F.raise_error(wrong))


def write_reads(df: DataFrame, path: str, kind: str | None = None, single: bool = False, ordered: bool = True, compression: str | None = None) -> None:
    """Write reads in order of idx; the part files in order of name are the file.

    ``ordered=False`` keeps the order the frame has, for one that was just sorted. ``single`` writes one part, for
    results that fit one task. The target is replaced.
    """
    require(df, "header", "sequence")
    kind = kind or ("fastq" if has_quality(df) else "fasta")
    if kind == "fastq":
        require(df, "quality")
    rows = df.orderBy("idx") if ordered else df
    rows = rows.select(record_text(kind).alias("value"))
    out = (rows.coalesce(1) if single else rows).write.mode("overwrite")
    (out.option("compression", compression) if compression else out).text(path)
