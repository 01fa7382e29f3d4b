"""Sorting by header, sequence or length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import read_length
from strandline.runtime import numbered
from strandline.schema import require

KEYS = ("name", "sequence", "length")


def sort_keys(by: str = "name", reverse: bool = False) -> list[Column]:
    """Sort columns with idx as the tie-breaker, so that the order is total.

    In reverse, equal headers or sequences come in reverse of their order in the file; equal lengths keep it.
    """
    if by not in KEYS:
        raise ValueError(f"by must be one of {KEYS}, not {by!r}")
    key = {"name": F.col("header"), "sequence": F.col("sequence"), "length": read_length(F.col("sequence"))}[by]
    if not reverse:
        return [key.asc(), F.col("idx").asc()]
    return [key.desc(), F.col("idx").asc() if by == "length" else F.col("idx").desc()]


def sort_reads(df: DataFrame, by: str = "name", reverse: bool = False) -> DataFrame:
    """Reads in total order, by a range-partitioned sort: its partitions in sequence are the sorted file."""
    require(df, "idx", "header", "sequence")
    return df.orderBy(*sort_keys(by, reverse))


def ranks(df: DataFrame, by: str = "name", reverse: bool = False) -> DataFrame:
    """(idx, rank): each read's place in the sorted order, counted from 0. Only the key and idx are sorted, and only idx
    is written."""
    require(df, "idx", "header", "sequence")
    keys = sort_keys(by, reverse)
    narrow = df.select("idx", "header" if by == "name" else "sequence")
    if by == "length":
        size = read_length(F.col("sequence"))
        narrow, keys = df.select("idx", size.alias("size")), [F.desc("size") if reverse else F.asc("size"), F.asc("idx")]
    return numbered(narrow.orderBy(*keys).select("idx"), "rank", "ranks")


def rank_reads(df: DataFrame, by: str = "name", reverse: bool = False) -> DataFrame:
    """Reads with their place in the sorted order as ``rank``, counted from 0; they join their rank by idx."""
    return df.join(ranks(df, by, reverse), "idx").select(*df.columns, "rank")
