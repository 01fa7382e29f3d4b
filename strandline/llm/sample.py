"""Problem 4: a fixed-size uniform sample from data of unknown length that arrives in pieces."""

from __future__ import annotations

from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.runtime import remove, stage

_BITS = 48


def sample_key(seed: int, *columns: Column) -> Column:
    """A uniform number in [0, 1) that depends on the seed and the record only, so a task that runs again draws the
    same; any engine with MD5 can draw it, too."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("\0")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, _BITS // 4), 16, 10).cast("double") / F.lit(float(2**_BITS))


def bounds(k: int, n: int, delta: float) -> tuple[float, float]:
    """(accept, reject): of n uniform keys, fewer than k are under accept and at least k under reject, each but for a
    probability of delta (Meng, Scalable Simple Random Sampling and Stratified Sampling, ICML 2013). A delta of 0 gives
    no bounds: nothing is accepted or rejected unsorted."""
    if delta == 0:
        return 0.0, 1.0
    if k >= n:
        return 1.0, 1.0
    p, g = k / n, -log(delta) / n
    low = p + 2 * g / 3 - sqrt((2 * g / 3) ** 2 + 2 * g * p)
    return max(0.0, low), min(1.0, p + g + sqrt(g * g + 2 * g * p))


class PieceSampler:
    """Uniform sample of k records over pieces whose number and sizes are not known in advance.

    After each piece the rejection bound for the count so far is applied to the piece and to what was kept; as the
    bound only falls while the count grows, no record that was rejected could come back. What is kept is k records and
    a narrow waitlist. ``result`` accepts the records under the lower bound outright and sorts only the waitlist.
    """

    def __init__(self, k: int, key: Column, delta: float = 1e-9, seed_pieces: int = 0):
        if k < 0:
            raise ValueError("k must not be negative")
        self.k, self.key, self.delta, self.n, self.kept = k, key, delta, seed_pieces, None

    def add(self, piece: DataFrame) -> None:
        """Take in one piece: a count, and one pass that keeps the records under the bound."""
        self.n += piece.count()
        _, reject = bounds(self.k, self.n, self.delta)
        new = piece.withColumn("__key", self.key).filter(F.col("__key") <= reject)
        old = self.kept
        self.kept = stage(new if old is None else old.filter(F.col("__key") <= reject).unionByName(new), "sample")
        if old is not None:
            remove(old.sparkSession, old.inputFiles()[0].rpartition("/")[0]) if old.inputFiles() else None

    def result(self) -> DataFrame | None:
        """The sample so far, or None where the bounds failed and the pieces must be read again with wider ones."""
        accept, _ = bounds(self.k, self.n, self.delta)
        sure, all_ = self.kept.agg(
            F.count(F.when(F.col("__key") < accept, 1)), F.count(F.lit(1))
        ).first()
        if sure > self.k or all_ < min(self.k, self.n):
            return None
        if all_ <= self.k:
            return self.kept.drop("__key")
        waiting = self.kept.filter(F.col("__key") >= accept).orderBy("__key").limit(self.k - sure)
        return self.kept.filter(F.col("__key") < accept).unionByName(waiting).drop("__key")


def fixed_size_sample(df: DataFrame, k: int, id_cols: list[str], seed: int = 0, delta: float = 1e-4) -> DataFrame:
    """A uniform sample of k rows of ``df`` (all, if there are fewer), every row equally likely.

    Accept-waitlist sampling: count, reject most rows by one bound and accept most of the sample by the other, sort
    only the waitlist between them. If a bound fails, with a probability of delta, the pass is repeated with delta
    squared, at last with no bound at all, so the result never depends on luck: it is the k rows of the smallest keys.

    Nulls are values like any other. Rows that agree in ``id_cols`` have the same key and are chosen together as far
    as k allows; give columns that tell rows apart. An empty table gives no rows. All columns are kept; a column named
    ``__key`` is not allowed.
    """
    return sample_pieces([df], k, id_cols, seed, delta)


def arrived(df: DataFrame, batch: str, most: int = 4) -> list[DataFrame]:
    """``df`` as at most ``most`` pieces of consecutive batches, in order; rows without a batch come with the first."""
    low, high = df.agg(F.min(batch), F.max(batch)).first()
    if low is None:
        return [df]
    step, at = -(-(high - low + 1) // most), F.col(batch)
    pieces = [(at >= a) & (at < a + step) for a in range(low, high + 1, step)]  # as the scan can use them
    return [df.filter(pieces[0] | at.isNull()), *[df.filter(x) for x in pieces[1:]]]


def sample_pieces(pieces: list[DataFrame], k: int, id_cols: list[str], seed: int = 0, delta: float = 1e-4) -> DataFrame:
    """``fixed_size_sample`` of pieces that arrive one after the other: each is taken in without a look at later ones,
    and where a bound turns out to have failed, all are read again with wider ones."""
    key = sample_key(seed, *[F.col(c) for c in id_cols])
    while True:
        one = PieceSampler(k, key, delta)
        for piece in pieces:
            one.add(piece)
        if (out := one.result()) is not None:
            return out
        delta = delta * delta if delta > 1e-60 else 1e-300 if delta > 1e-300 else 0
