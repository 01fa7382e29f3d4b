"""Problem 9: sources mixed to target weights."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.runtime import bound_arrow_batches, stage

#: Where public tokenizers lie, and the ranks file used by default; the folder is a parameter.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"

# Fixed value: how texts are split before byte-pair merging with this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: As many sources may have a target.
MOST_TARGETS = 10_000

_BITS, _STEP = 60, 10
_SCHEMA = "doc_id long, source string, n_tokens long"


def load_encoding(path: str):
    """A tokenizer from a ranks file."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(
    df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}"
) -> DataFrame:
    """(doc_id, source, n_tokens) of each document; a null text has no tokens.

    The vocabulary is read where the driver finds it and sent to the executors as a file of the session; it is loaded
    once a task.
    """
    bound_arrow_batches(df.sparkSession)
    df.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(SparkFiles.get(name))
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["source"], pa.array(sizes, pa.int64())], ["doc_id", "source", "n_tokens"]
            )

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    return rows.mapInArrow(run, _SCHEMA)


def plan(
    targets: dict[str, tuple[float, int]], available: dict[str, int], total: int | None = None
) -> dict[str, tuple[int, int, int]]:
    """source -> (budget in tokens, whole copies of every document, tokens of the copies of some).

    Without ``total`` it is the largest at which every source that has tokens gets its share within its repeats, shares
    being taken among those sources. A source can't give more than its tokens times its repeats.
    """
    usable = {s: (share, repeats) for s, (share, repeats) in targets.items() if share > 0 and repeats > 0 and available.get(s, 0) > 0}
    weight = sum(share for share, _ in usable.values())
    if not usable:
        return {}
    if total is None:
        total = min(int(available[s] * repeats * weight / share) for s, (share, repeats) in usable.items())
    out = {}
    for s, (share, repeats) in usable.items():
        budget = min(round(total * share / weight), available[s] * repeats)
        out[s] = (budget, budget // available[s], budget % available[s])
    return out


def _bucket(key: Column, level: int) -> Column:
    return F.shiftright(key, _BITS - _STEP * (level + 1)).bitwiseAND(F.lit(2**_STEP - 1))


def thresholds(sizes: DataFrame, wanted: dict[str, int]) -> dict[str, int]:
    """source -> t: the documents of a source with a key under t hold its wanted tokens, as nearly as whole documents can.

    Tokens are summed by source and by the key's first bits; the bucket in which the running sum crosses the wanted
    tokens is summed again by its next bits, and no other is. The running sums are over 1,024 buckets a source, in the
    cluster; the driver gets one row a source and round. Without ties the last bucket is one document, which is taken if
    that comes nearer.
    """
    spark = sizes.sparkSession
    open_ = {s: (0, 0, w) for s, w in wanted.items() if w > 0}  # source -> bits so far, tokens before, wanted
    out = {s: 0 for s in wanted}
    order = Window.partitionBy("source").orderBy("b")
    for level in range(_BITS // _STEP):
        if not open_:
            break
        rule = spark.createDataFrame([(s, *x) for s, x in open_.items()], "source string, prefix long, before long, want long")
        # One row a target: at most MOST_TARGETS.
        inside = sizes.join(F.broadcast(rule), "source").filter(F.shiftright("key", _BITS - _STEP * level) == F.col("prefix"))
        grouped = inside.groupBy("source", "before", "want", _bucket(F.col("key"), level).alias("b"))
        sums = grouped.agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
        crossed = sums.withColumn("upto", F.col("before") + F.sum("t").over(order)).filter("upto > want")
        found = {r.source: r for r in crossed.withColumn("nth", F.row_number().over(order)).filter("nth = 1").collect()}
        again = {}
        for s, (prefix, _, want) in open_.items():
            if s not in found:
                out[s] = (prefix + 1) << (_BITS - _STEP * level)
                continue
            r = found[s]
            here, before = prefix << _STEP | r.b, r.upto - r.t
            if r.n == 1 or level + 1 == _BITS // _STEP:
                take = r.upto - want < want - before
                out[s] = (here + take) << (_BITS - _STEP * (level + 1))
            else:
                again[s] = (here, before, want)
        open_ = again
    return out


def mix(
    df: DataFrame,
    targets: DataFrame,
    total: int | None = None,
    seed: int = 9,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}",
) -> tuple[DataFrame, DataFrame]:
    """(mix, report). mix: (doc_id, source, n_tokens, copies) of the documents that are used, with how often. report:
    (source, target_share, max_repeats, available_tokens, mixed_tokens, actual_share, n_docs, most_copies) of each target.

    Hash-threshold histograms: each source gets whole copies of all its documents, and the rest of its budget from the
    documents whose hash lies under a threshold (see ``plan`` and ``thresholds``); larger budgets contain the documents
    of smaller ones. Nothing is sorted, and a source that holds a third of all rows is only ever summed and filtered.

    Documents without source, of a source that is no target, or without a token are not used. A source without
    documents gets 0; repeated targets must not differ, the first counts. Rows that repeat a doc_id are separate
    documents that are used alike. An empty table gives an empty mix. There may be ``MOST_TARGETS`` targets.
    """
    spark = df.sparkSession
    chosen = targets.select("source", "target_share", "max_repeats").filter("source is not null").dropDuplicates(["source"])
    rows = chosen.limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    wanted = {r.source: (r.target_share or 0.0, r.max_repeats or 0) for r in rows}
    names = spark.createDataFrame([(s,) for s in wanted], "__target string")
    meant = df.join(F.broadcast(names), F.col(source) == F.col("__target"), "left_semi")
    counted = token_counts(meant, doc_id, source, text, vocabulary).filter("n_tokens > 0")
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 64 - _BITS)
    sizes = stage(counted.withColumn("key", key), "mix-sizes")
    available = {r.source: r.t for r in sizes.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    planned = plan(wanted, available, total)
    limits = thresholds(sizes, {s: rest for s, (_, _, rest) in planned.items()})
    rule = spark.createDataFrame(
        [(s, whole, limits[s]) for s, (_, whole, _) in planned.items()], "source string, whole long, below long"
    )
    # One row a target: at most MOST_TARGETS.
    copies = F.col("whole") + (F.col("key") < F.col("below")).cast("long")
    mixed = sizes.join(F.broadcast(rule), "source").select("doc_id", "source", "n_tokens", copies.alias("copies")).filter("copies > 0")
    return mixed, _report(spark, mixed, wanted, available)


def _report(spark: SparkSession, mixed: DataFrame, wanted: dict, available: dict) -> DataFrame:
    base = spark.createDataFrame(
        [(s, float(share), int(repeats), int(available.get(s, 0))) for s, (share, repeats) in wanted.items()],
        "source string, target_share double, max_repeats long, available_tokens long",
    )
    used = mixed.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"),
        F.count(F.lit(1)).alias("n_docs"),
        F.max("copies").alias("most_copies"),
    )
    out = base.join(used, "source", "left").fillna(0, ["mixed_tokens", "n_docs", "most_copies"])
    # The window is over the targets, MOST_TARGETS rows at most.
    out = out.withColumn("all", F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0))))
    share = F.when(F.col("all") > 0, F.col("mixed_tokens") / F.col("all")).otherwise(0.0)
    return out.select(*base.columns, "mixed_tokens", share.alias("actual_share"), "n_docs", "most_copies")
