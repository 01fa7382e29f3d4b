"""Problem 8: evaluation texts leaking into training text."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.letters import mixed, spread
from strandline.runtime import bound_arrow_batches, small, stage

#: A maximal run of Unicode letters or digits.
WORD = re.compile(r"[^\W_]+")

#: Upper limits of the size classes of document blocks, in shingles.
SIZES = (9, 12, 16, 24)

#: Chance that the search misses a passage that a document holds in full.
MISS = 1e-6

#: Bits of a filter for each of its keys, places of a key among them, and the most bits it may have (16 MB).
KEY_BITS, PLACES, MOST_BITS = 32, 4, 27

_MULT = 0x9E3779B97F4A7C15

#: Numbers that take the place of a min-hash's in the keys of shingles of poor passages, and of whole runs of words.
_POOR, _RUN = 1 << 20, 1 << 21

#: Rows of passages and documents that are joined once as a broadcast: some 25 MB.
_BROADCAST = 200_000


class Words(dict):
    """64-bit hashes of words in lower case, by the word as it stands; forgets all when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 20:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.lower().encode())
        return h


def word_hashes(text: str | None, words: Words) -> np.ndarray:
    """Hashes of the words of a text, in order."""
    found = WORD.findall(text) if text else []
    return np.fromiter([words[w] for w in found], np.uint64, len(found))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, width):
        out = out * np.uint64(_MULT) + words[j : j + n]
    return mixed(out)


def permutations_for(size: int, passage: int, miss: float = MISS) -> int:
    """How many min-hashes find a passage of so many shingles in a block of ``size`` but for a chance of ``miss``.

    A block that contains the passage has a Jaccard similarity of passage / size with it, and each min-hash agrees with
    that probability; so larger blocks take more of them.
    """
    share = min(1.0, passage / size)
    return 1 if share == 1 else math.ceil(math.log(miss) / math.log(1 - share))


@dataclass(frozen=True)
class Search:
    """What to search for: runs of ``words`` words, as sets of shingles of ``shingle`` words."""

    words: int
    shingle: int
    sizes: tuple[int, ...]
    miss: float

    @property
    def passage(self) -> int:
        """Shingles in a passage."""
        return self.words - self.shingle + 1

    @property
    def factors(self) -> np.ndarray:
        """A factor for each min-hash; larger blocks use more of them."""
        most = max(permutations_for(s, self.passage, self.miss) for s in self.sizes)
        return np.random.default_rng(29).integers(0, 2**31, most, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _short(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(32)).astype(np.uint32)


def _key(number: int, values: np.ndarray) -> np.ndarray:
    """The filter key of the values of a min-hash."""
    return mixed(values.astype(np.uint64) * np.uint64(_MULT) + np.uint64((number + 1) * 0xD1B54A32D192ED03 % 2**64))


def _places(key: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    low, high = key & np.uint64(2**31 - 1), key >> np.uint64(33) | np.uint64(1)
    for i in range(PLACES):
        yield (low + np.uint64(i) * high) & np.uint64(2**bits - 1)


class Filter:
    """A set of keys of which a look-up may say yes by chance, but never no: one bit for each of several places of a key.

    It is put together in the cluster, 4 KB at a time, and its size is bounded whatever the number of keys; beyond
    2 ** MOST_BITS / KEY_BITS of them more look-ups say yes, and the join that follows sorts them out.
    """

    def __init__(self, bits: int, parts: list[tuple[int, bytes]]):
        self.bits, whole = bits, np.zeros(max(4096, 2**bits // 8), np.uint8)
        for number, part in parts:
            whole[number * 4096 : (number + 1) * 4096] = np.frombuffer(part, np.uint8)
        self.set = whole

    @classmethod
    def of(cls, keys: DataFrame) -> Filter:
        """The filter of a column ``key`` of distinct keys."""
        bits = min(MOST_BITS, max(15, (keys.count() * KEY_BITS).bit_length()))
        low, high = F.col("key").bitwiseAND(F.lit(2**31 - 1)), F.shiftrightunsigned("key", 33).bitwiseOR(F.lit(1).cast("long"))
        places = [(low + high * F.lit(i)).bitwiseAND(F.lit(2**bits - 1)) for i in range(PLACES)]
        at = keys.select(F.explode(F.array(*places)).alias("at"))
        # These functions count places from 1.
        parts = at.groupBy((F.bitmap_bucket_number(F.col("at") + 1) - 1).alias("number")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("part")
        )
        return cls(bits, [(r.number, bytes(r.part)) for r in parts.collect()])  # at most 4,096 rows

    def __call__(self, key: np.ndarray) -> np.ndarray:
        out, some = np.zeros(len(key), bool), np.arange(len(key))
        for place in _places(key, self.bits):
            at = place[some]
            some = some[(self.set[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)]
        out[some] = True
        return out


def item_keys(items: DataFrame, search: Search) -> DataFrame:
    """(key): the filter keys of the passages of items (i, t): their min-hashes, and their runs of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, factors, passage = Words(), search.factors, search.passage
        for batch in batches:
            for text in batch["t"].to_pylist():
                w = word_hashes(text, known)
                if len(w) < search.words:
                    continue
                windows = np.lib.stride_tricks.sliding_window_view(_short(shingle_hashes(w, search.shingle)), passage)
                keys = [_key(j, (windows * f).min(axis=1)) for j, f in enumerate(factors)]
                # Passages that repeat a shingle have fewer to share than the search allows for: any of theirs makes a candidate.
                s = np.sort(windows, axis=1)
                poor = (s[:, 1:] == s[:, :-1]).any(axis=1) if passage > 1 else np.zeros(len(s), bool)
                keys += [_key(_POOR, windows[poor].reshape(-1)), _key(_RUN, shingle_hashes(w, search.words))]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(keys)).view(np.int64))], ["key"])

    return items.select("t").mapInArrow(run, "key long").distinct()


def item_runs(items: DataFrame, search: Search) -> DataFrame:
    """(run, item_id): each run of words of items (i, t), as the bytes of the hashes of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            for item, text in zip(batch["i"].to_pylist(), batch["t"].to_pylist()):
                w = word_hashes(text, known)
                if len(w) >= search.words:
                    runs = _run_bytes(w, np.arange(len(w) - search.words + 1), search.words)
                    yield pa.RecordBatch.from_arrays([runs, pa.array(np.full(len(runs), item))], ["run", "item_id"])

    return items.select("i", "t").mapInArrow(run, "run binary, item_id long").distinct()


def _run_bytes(words: np.ndarray, at: np.ndarray, width: int) -> pa.Array:
    view = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(words, width)[at])
    return pa.Array.from_buffers(pa.binary(8 * width), len(at), [None, pa.py_buffer(view)]).cast(pa.binary())


def candidate_blocks(x: np.ndarray, lengths: np.ndarray, search: Search, held: Filter):
    """(start, size) in shingles of the blocks that may hold a passage, for documents of ``lengths`` shingles end to end.

    Each document is cut into blocks that overlap by a passage less one shingle, so that every passage lies in one block
    whole. Blocks are partitioned by size, and each size class looks up as many min-hashes as it needs.
    """
    passage, most = search.passage, search.sizes[-1]
    step = most - passage + 1
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else np.zeros(0, np.int64)
    able = lengths >= passage
    number = np.where(able, np.maximum(1, -(-(lengths - passage + 1) // step)), 0)
    nth = spread(np.zeros(len(lengths), np.int64), number)
    doc = np.repeat(np.arange(len(lengths)), number)
    begin = starts[doc] + nth * step
    size = np.minimum(most, lengths[doc] - nth * step)
    hit = np.zeros(len(begin), bool)
    if not len(begin):
        return begin, size
    poor = held(_key(_POOR, x))
    low, factors = 0, search.factors
    for high in search.sizes:
        rows = np.flatnonzero((size > low) & (size <= high)) if low else np.flatnonzero(size <= high)
        low = high
        for part in np.array_split(rows, 1 + len(rows) * high // (1 << 20)):
            if not len(part):
                continue
            own = spread(begin[part], size[part])
            edge = np.concatenate(([0], np.cumsum(size[part])[:-1]))
            found = np.logical_or.reduceat(poor[own], edge)
            own = x[own]
            for j in range(permutations_for(high, passage, search.miss)):
                found |= held(_key(j, np.minimum.reduceat(own * factors[j], edge)))
            hit[part] = found
    return begin[hit], size[hit]


def leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    words: int = 13,
    shingle: int = 5,
    sizes: tuple[int, ...] = SIZES,
    miss: float = MISS,
) -> DataFrame:
    """(doc_id, item_id): the documents that hold ``words`` or more consecutive words which stand in the same order,
    consecutively, in the item. Words are runs of letters or digits, compared in lower case.

    Size-partitioned MinHash containment search. The items' passages of ``words`` words, as sets of shingles, are the
    queries; blocks of the documents are the domain, partitioned by size, with as many min-hashes for each size class as
    containment needs there (see ``permutations_for``). The passages' min-hashes become a filter of bounded size, which
    is all that travels to the documents; these are read once, whatever the number of items. The runs of words of
    candidate blocks are then joined with those of the items on the hashes of all their words, so no pair is wrong; a
    passage is missed with a probability of ``miss``, and a pair usually shares several.

    A document sends each run once. The items' runs are broadcast if they were counted to be few, else both sides are
    shuffled. Null and blank texts, items of fewer than ``words`` words and empty tables give no rows; repeated rows make
    no difference; other columns are not read.
    """
    if not 0 < shingle <= words or sizes[-1] < words - shingle + 1 or list(sizes) != sorted(sizes):
        raise ValueError("0 < shingle <= words and rising sizes, the last at least a passage, must hold")
    bound_arrow_batches(docs.sparkSession)
    search = Search(words, shingle, tuple(sizes), miss)
    chosen = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).filter("t is not null and i is not null").distinct()
    held = Filter.of(stage(item_keys(chosen, search), "leak-keys"))
    runs = stage(item_runs(chosen, search), "leak-runs")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter(F.length("text") >= words)
    found = rows.mapInArrow(_searcher(search, held), "run binary, doc_id long")
    return found.join(small(runs, _BROADCAST), "run").select("doc_id", "item_id").distinct()


def _searcher(search: Search, held: Filter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            hashes = [word_hashes(t, known) for t in batch["text"].to_pylist()]
            sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
            words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            doc, first = candidate_runs(words, sizes, search, held)
            if len(first):
                ids = pa.array(batch["doc_id"].to_numpy(zero_copy_only=False)[doc], pa.int64(), from_pandas=True)
                yield pa.RecordBatch.from_arrays([_run_bytes(words, first, search.words), ids], ["run", "doc_id"])

    return run


def candidate_runs(words: np.ndarray, sizes: np.ndarray, search: Search, held: Filter) -> tuple[np.ndarray, np.ndarray]:
    """(document, first word) of each run of words in a candidate block that the filter holds too, for documents given as
    word hashes end to end."""
    counts = np.maximum(sizes - search.shingle + 1, 0)
    word_at = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else np.zeros(0, np.int64)
    every = spread(word_at, counts)  # the word at which each shingle begins
    none = np.zeros(0, np.int64)
    if not len(every):
        return none, none
    begin, size = candidate_blocks(_short(shingle_hashes(words, search.shingle))[every], counts, search, held)
    runs = np.unique(spread(begin, size - search.passage + 1))
    if not len(runs):
        return none, none
    first = every[runs]
    grams = shingle_hashes(words, search.words)[first]
    # Empty documents begin where the next one does; the last of them with words is meant.
    doc = np.searchsorted(word_at, first, "right") - 1
    some = np.flatnonzero(held(_key(_RUN, grams)))
    _, once = np.unique(np.stack((doc[some].astype(np.uint64), grams[some])), axis=1, return_index=True)
    return doc[some[once]], first[some[once]]
