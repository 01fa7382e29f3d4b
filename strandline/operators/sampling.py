"""Seeded sampling whose result is the same as that of one sequential pass, computed in parallel.

The generator is linear, s -> s * A + 1 modulo 2**64, so the state after n draws follows from the seed and n alone, and
each row computes its own draw from its position: ``idx``, counted anew where it has gaps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from strandline.runtime import positions
from strandline.schema import in_unit, require

# Fixed values of the generator.
MULTIPLIER = 6364136223846793005
INCREMENT = 1
MODULUS = 2**64


def states(draws: np.ndarray, seed: int) -> np.ndarray:
    """The generator's state after each number of draws: affine maps of 1, 2, 4, ... steps, composed bit by bit."""
    state = np.full(len(draws), seed % MODULUS, np.uint64)
    factor, shift, left = MULTIPLIER, INCREMENT, draws.astype(np.uint64)
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        state[odd] = state[odd] * np.uint64(factor) + np.uint64(shift)
        factor, shift, left = factor * factor % MODULUS, shift * (factor + 1) % MODULUS, left >> np.uint64(1)
    return state


def threshold(fraction: float) -> int:
    """The highest state that a fraction accepts."""
    if fraction <= 0:
        return 0
    return min(int(fraction * float(MODULUS)), MODULUS - 1)


def reservoir_slot(idx: Column, k: int, seed: int) -> Column:
    """The reservoir slot that a row is put in when its turn comes, null if in none."""

    @pandas_udf(T.LongType())
    def slot(at: pd.Series) -> pd.Series:
        n = at.to_numpy(np.int64)
        drawn = np.maximum(n - k + 1, 0)
        picked = (states(drawn, seed) % (n + 1).astype(np.uint64)).astype(np.int64)
        picked = np.where(n < k, n, picked)
        return pd.Series(picked).where(picked < k).astype("Int64")

    return slot(idx)


def accepted(idx: Column, fraction: float, seed: int) -> Column:
    """Whether a row's own draw is at most the threshold of ``fraction``."""
    limit = threshold(fraction)

    @pandas_udf(T.BooleanType())
    def accept(at: pd.Series) -> pd.Series:
        return pd.Series(states(at.to_numpy(np.int64) + 1, seed) <= np.uint64(limit))

    return accept(idx)


def sample_count(df: DataFrame, k: int, seed: int = 0, dense: bool | None = None) -> DataFrame:
    """A reservoir sample of k rows, with ``slot``, its place in the sample: the last row put in a slot is the one in it.

    Only the rows that ever enter the reservoir, about k * (1 + ln(n / k)) of n, leave their task, and only as
    (slot, idx); the k survivors then pick their rows by idx. All rows, in order, if there are no more than k.

    Positions count: an idx with gaps is counted anew (see ``positions``), and is the new one in the result. ``dense``
    tells that there are none, or that there are, and saves a look.
    """
    require(df, "idx")
    if k < 0:
        raise ValueError("k must not be negative")
    if k == 0:
        return df.limit(0).withColumn("slot", F.lit(None).cast("long"))
    df = positions(df, dense)
    entered = df.select("idx", reservoir_slot(F.col("idx"), k, seed).alias("slot")).filter("slot is not null")
    last = entered.groupBy("slot").agg(F.max("idx").alias("idx"))
    return df.join(last, "idx").orderBy("slot")


def sample_fraction(df: DataFrame, fraction: float, seed: int = 0, dense: bool | None = None) -> DataFrame:
    """Each row with probability ``fraction``, in one pass without a shuffle if idx has no gaps; else by its position,
    which takes a sort. ``dense`` as in ``sample_count``."""
    require(df, "idx")
    in_unit("fraction", fraction)
    if fraction <= 0:
        return df.limit(0)
    return df if fraction >= 1 else positions(df, dense).filter(accepted(F.col("idx"), fraction, seed))
