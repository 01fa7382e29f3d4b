"""Problem 2: has this key been seen before?"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import strip_whitespace
from strandline.runtime import new_path, remove, stage

_KEYS = ["h", "key"]

#: A batch of up to so many rows tells the runs which hashes it asks for, and they read only the blocks that may have them.
SMALL_BATCH = 1000


class SeenStore:
    """All keys seen so far, as levelled immutable sorted runs in a shared folder.

    A run is a Parquet table of (h, key, scope, first): ``scope`` numbers the key space (here, the table), ``key`` begins
    with it, h is a 64-bit hash of ``key``. Its blocks are ``buckets`` files by a hash of h, each sorted by h, so that
    the minima and maxima of h of their row groups are fences. A batch is reduced to one row a key by map-side combining
    (a hot key is one row a task), and probes run after run by a merge join on h: a run is neither shuffled nor sorted
    again. The full key verifies each hit. A batch of up to ``SMALL_BATCH`` rows opens no more blocks than it has hashes.
    Keys that no run holds become a new run of level 0; when a level has ``fanout`` runs they are merged, without a
    shuffle either, into one run of the next level.

    The store keeps one row for each distinct key on disk and no key in memory. ``close`` removes it.
    """

    #: (scope, at) of the records that are new, found without the store; what `error_report` compares it with.
    exact: DataFrame | None = None

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = 3, hash_bits: int = 64):
        self.spark, self.fanout, self.hash_bits = spark, fanout, hash_bits
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.root = new_path(spark, "seen")
        self.levels: list[list[str]] = [[]]
        self.paths: dict[str, str] = {}
        # A bucket is one file, written in order of h; with this, a scan says so and a merge join need not sort it again.
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")

    def hashed(self, key: Column) -> Column:
        """The hash of a key; fewer bits than 64 are for tests of collisions."""
        h = F.xxhash64(key)
        return h if self.hash_bits >= 64 else F.pmod(h, F.lit(2**self.hash_bits))

    def runs(self) -> list[str]:
        """Names of all runs, the oldest first."""
        return [run for level in reversed(self.levels) for run in level]

    def _write(self, df: DataFrame) -> str:
        name = f"seen_{uuid.uuid4().hex}"
        self.paths[name] = f"{self.root}/{name}"
        df.write.format("parquet").bucketBy(self.buckets, "h").sortBy("h").option("path", self.paths[name]).option(
            "compression", "zstd"
        ).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, self.paths.pop(name))

    def close(self) -> None:
        """Remove all runs."""
        for name in list(self.paths):
            self._drop(name)
        remove(self.spark, self.root)
        self.levels = [[]]

    def unknown(self, keys: DataFrame, hashes: list[int] | None = None) -> DataFrame:
        """The rows of ``keys``, which are one for each (h, key), that no run holds; ``hashes`` are theirs, if they are few."""
        for run in self.runs():
            old = self.spark.table(run).select(F.col("h").alias("old_h"), F.col("key").alias("old_key"))
            if hashes is not None:
                old = old.filter(F.col("old_h").isin(hashes))
            # Keys are compared by order, as equality would become part of the join key, by which no run is bucketed. An
            # outer join, as the optimizer would push an anti-join below the aggregation, where keys are still hot.
            same = (F.col("h") == F.col("old_h")) & (F.col("key") <= F.col("old_key")) & (F.col("key") >= F.col("old_key"))
            keys = keys.join(old.hint("merge"), same, "left").filter("old_h is null").drop("old_h", "old_key")
        return keys

    def add(self, batch: DataFrame, answer: bool = True) -> DataFrame | None:
        """Take in a batch of (scope, key, at) and, unless told not to, answer it: (scope, at) of each record whose key a run
        or a smaller ``at`` of the batch has. Each new key is recorded with its smallest ``at``."""
        rows = batch.select("scope", F.concat(F.col("scope"), F.lit(":"), F.col("key")).alias("key"), "at")
        rows = rows.withColumn("h", self.hashed(F.col("key")))
        hashes = None
        if self.runs():
            few = rows.select("h").limit(SMALL_BATCH + 1).collect()
            hashes = sorted({r.h for r in few}) if len(few) <= SMALL_BATCH else None
        new = rows.groupBy(*_KEYS).agg(F.min("scope").alias("scope"), F.min("at").alias("first"))
        run = self._write(self.unknown(new, hashes) if self.runs() else new.repartition(self.buckets, "h"))
        self.levels[0].append(run)
        out = None
        if answer:
            first = self.spark.table(run).select("scope", F.col("first").alias("at")).filter("at is not null")
            # The first records of new keys are told by their positions, which no hot key can skew.
            out = stage(batch.select("scope", "at").join(first, ["scope", "at"], "left_anti").distinct(), "seen-answer")
        self._compact()
        return out

    def _compact(self) -> None:
        for i in range(len(self.levels)):
            if len(self.levels[i]) < self.fanout:
                return
            if i + 1 == len(self.levels):
                self.levels.append([])
            old = self.levels[i]
            merged = self.spark.table(old[0])
            for run in old[1:]:
                merged = merged.unionByName(self.spark.table(run))
            # The runs' keys differ, so this merges nothing; it asks for a clustering that runs and union already have.
            name = self._write(merged.groupBy(*_KEYS).agg(F.min("scope").alias("scope"), F.min("first").alias("first")))
            self.levels[i + 1].append(name)
            self.levels[i] = []
            for run in old:
                self._drop(run)

    def stored(self) -> DataFrame:
        """(h, scope, first) of all keys."""
        tables = [self.spark.table(run).select("h", "scope", "first") for run in self.runs()]
        return reduce(lambda a, b: a.unionByName(b), tables)


def keys_of(df: DataFrame, scope: int, id_col: str = "idx", sequence: str = "sequence") -> DataFrame:
    """(scope, key, at): the sequence without blanks, tabs and line ends; null ones and those without a letter are left
    out."""
    return df.select(
        F.lit(scope).alias("scope"),
        strip_whitespace(F.col(sequence)).alias("key"),
        F.col(id_col).cast("long").alias("at"),
    ).filter(F.col("key").rlike("[A-Za-z]"))


def pieces(rows: DataFrame, count: int) -> list[Column]:
    """Conditions that cut rows by position into ``count`` consecutive pieces."""
    low, high = rows.agg(F.min("at"), F.max("at")).first()
    if low is None:
        return []
    step = max(1, -(-(high - low + 1) // count))
    return [(F.col("at") >= a) & (F.col("at") < a + step) for a in range(low, high + 1, step)]


def seen_before(
    tables: dict[str, DataFrame],
    known: DataFrame | None = None,
    id_col: str = "idx",
    sequence: str = "sequence",
    batches: int = 4,
    **store,
) -> tuple[DataFrame, SeenStore]:
    """(seen, store): (tbl, idx) of each record of each table whose key occurred at a smaller idx of the same table, or
    among ``known``.

    The records go through a ``SeenStore`` in ``batches`` pieces in order of idx, ``known`` first; the result is what it
    answers to each of them as it comes. Null sequences, sequences without a letter and rows without idx are never seen.
    Rows that repeat an idx stand or fall together. Empty tables give no rows; only the two named columns are read.
    """
    names = list(tables)
    memory = SeenStore(tables[names[0]].sparkSession, **store)
    union = lambda parts: reduce(lambda a, b: a.unionByName(b), parts)
    rows = union([keys_of(tables[name], i, id_col, sequence) for i, name in enumerate(names)]).filter("at is not null")
    if known is not None:
        early = union([keys_of(known, i, id_col, sequence) for i in range(len(names))])
        memory.add(early.withColumn("at", F.lit(None).cast("long")), answer=False)
    memory.exact = rows.groupBy("scope", "key").agg(F.min("at").alias("at"))
    if known is not None:
        memory.exact = memory.exact.join(early.select("scope", "key").distinct(), ["scope", "key"], "left_anti")
    memory.exact = rows.select("scope", "at").join(memory.exact.select("scope", "at"), ["scope", "at"], "left_anti").distinct()
    out = union([memory.add(rows.filter(piece)) for piece in pieces(rows.select("at"), batches) or [F.lit(True)]])
    name = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("scope") + 1)
    return out.select(name.alias("tbl"), F.col("at").alias("idx")), memory


def error_report(seen: DataFrame, memory: SeenStore, names: list[str]) -> DataFrame:
    """(tbl, distinct_keys, hash_only_wrong, hash_only_rate, verified_wrong): how often the hash alone would have called
    a new key seen, and how many answers are wrong.

    Every key that the hash alone would have taken for another shares its hash with another key of its scope in the
    store. verified_wrong counts the records whose answer in ``seen`` differs from that of an exact minimum of ``at`` for
    each key, which is found without the store.
    """
    scopes = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("scope") + 1).alias("tbl")
    exact = memory.exact.select(scopes, F.col("at").alias("idx"))
    both = seen.withColumn("got", F.lit(1)).join(exact.withColumn("exact", F.lit(1)), ["tbl", "idx"], "full")
    wrong = both.groupBy("tbl").agg(F.count(F.when(F.expr("got is null or exact is null"), 1)).alias("verified_wrong"))
    by_hash = memory.stored().groupBy("scope", "h").agg(F.count(F.lit(1)).alias("n"))
    out = by_hash.groupBy(scopes).agg(F.sum("n").alias("distinct_keys"), F.sum(F.col("n") - 1).alias("hash_only_wrong"))
    return out.join(wrong, "tbl", "left").select(
        "tbl",
        "distinct_keys",
        "hash_only_wrong",
        (F.col("hash_only_wrong") / F.col("distinct_keys")).alias("hash_only_rate"),
        F.coalesce("verified_wrong", F.lit(0).cast("long")).alias("verified_wrong"),
    )
