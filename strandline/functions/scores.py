"""Functions of the quality string: Phred scores, and where trimming cuts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

OFFSET = 33
HIGHEST = 126


def score_of(character: Column) -> Column:
    """Phred score of a one-character column, never below 0."""
    return F.greatest(F.ascii(character) - OFFSET, F.lit(0))


def phred_to_ascii(score: Column) -> Column:
    """The character of a Phred score, no higher than ``~``."""
    return F.char(F.least(score + OFFSET, F.lit(HIGHEST)))


_SCORE = np.maximum(np.arange(256) - OFFSET, 0)


def _sums(column: pa.Array) -> pa.Array:
    """The sum of the scores of each string, from the column's bytes as they lie in memory; null stays null."""
    if not len(column):
        return pa.array([], pa.int64())
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    text = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    total = np.concatenate(([0], np.cumsum(_SCORE[text])))
    mask = column.is_null().to_numpy(zero_copy_only=False) if column.null_count else None
    return pa.array(total[at[1:] - at[0]] - total[at[:-1] - at[0]], pa.int64(), mask=mask)


@arrow_udf(T.LongType())
def _phred_sum(quality: pa.Array) -> pa.Array:
    return _sums(quality)


def phred_sum(quality: Column) -> Column:
    """Sum of the Phred scores of a quality string, by Arrow batches: a fold in SQL costs four times as much."""
    return _phred_sum(quality)


def mean_quality(quality: Column) -> Column:
    """Arithmetic mean of the scores in single precision; 0 for an empty string."""
    size = F.octet_length(quality)
    mean = phred_sum(quality) / F.when(size > 0, size)
    return F.when(quality.isNotNull(), F.coalesce(mean, F.lit(0.0))).cast("float")


def _below(cutoff: int) -> str:
    return "".join(map(chr, range(0, OFFSET + min(cutoff, 255 - OFFSET))))


def quality_ends(quality: Column, cutoff: int | None) -> tuple[Column, Column]:
    """(head, end): where scores first reach the cutoff from either end; the whole read without a cutoff. A read that
    never reaches it ends where it begins, at its end."""
    size = F.length(quality)
    if not cutoff:
        return F.lit(0), size
    low = F.lit(_below(cutoff))
    head = size - F.length(F.ltrim(quality, low))
    return head, F.greatest(head, F.length(F.rtrim(quality, low)))


def trim_bounds(
    head: Column, end: Column, size: Column, trim_front: int = 0, trim_tail: int = 0, max_length: int | None = None
) -> tuple[Column, Column]:
    """(start, length): what trimming leaves of a read of ``size`` bases between its quality ends, start counted from 0.

    A fixed number of bases goes from the front and from the tail, then everything beyond ``max_length``. The tail is
    taken off the end that quality trimming left, unless less than that remains: then nothing but the front is counted.
    """
    front = head + trim_front
    tail = F.when(end > trim_tail, end - trim_tail).otherwise(front)
    first = F.least(front, tail, size)
    last = F.least(tail, size)
    if max_length is not None:
        last = F.least(last, first + max_length)
    return first, last - first
