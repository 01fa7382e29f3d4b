"""Problem 7: near-duplicate records with small edits, insertions or moved blocks, by MinHash banding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.letters import joined, letters, mixed, pack, packed, spread, unpack, window_hashes
from strandline.runtime import bound_arrow_batches, freed_shuffles, join_groups, stage

#: Bands of a fingerprint, and its coordinates in each of them.
BANDS, ROWS = 24, 2

#: Texts of one band key that a task compares; the key is hot beyond, and split in blocks of about so many texts.
HOT = 2048

#: Bands whose keys travel at once. A row carries the signature of its text, and all bands together several times the input.
BANDS_AT_ONCE = 4

#: 64-bit words of a signature, see ``signatures``; those of ``distinct_texts`` are as long as their texts need.
WORDS = 8

#: Letters that are fingerprinted at once.
_CHUNK = 1 << 21


def fingerprints(
    codes: np.ndarray, lengths: np.ndarray, k: int, bands: int, rows: int, some: range | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(which, keys): the rows with at least k letters, and for each the 64-bit keys of its bands, or of ``some`` of them.

    A fingerprint has ``bands * rows`` coordinates, the minima of as many hashes over the distinct k-letter substrings. A
    band is a block of ``rows`` of them, and its key a hash of their values.
    """
    some = range(bands) if some is None else some
    counts = np.maximum(lengths - k + 1, 0)
    which = np.flatnonzero(counts)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))[which] if len(lengths) else np.zeros(0, np.int64)
    counts = counts[which]
    keys = np.empty((len(which), len(some)), np.uint64)
    rng = np.random.default_rng(11)
    factors = rng.integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    for at, end, own, begin in _some(codes, starts, counts, k):
        for column, a in enumerate(some):
            key = np.full(end - at, a + 1, np.uint64)
            for c in range(a * rows, (a + 1) * rows):
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(own * factors[c], begin))
            keys[at:end, column] = key
    return which, keys


def _some(codes: np.ndarray, starts: np.ndarray, counts: np.ndarray, k: int):
    """(first row, end, hashes of the substrings, where each row's begin) of some rows at a time."""
    cut = np.searchsorted(np.cumsum(counts), np.arange(_CHUNK, int(counts.sum()) + _CHUNK, _CHUNK), "left") + 1
    at = 0
    for end in np.unique(np.minimum(cut, len(starts))).tolist():
        if end == at:
            continue
        low, high = int(starts[at]), int(starts[end - 1] + counts[end - 1] + k - 1)
        hashes = (window_hashes(codes[low:high], k, 3) >> np.uint64(32)).astype(np.uint32)
        own = hashes[spread(starts[at:end] - low, counts[at:end])]
        yield at, end, own, np.concatenate(([0], np.cumsum(counts[at:end])[:-1]))
        at = end


def signatures(codes: np.ndarray, lengths: np.ndarray, k: int, words: int | np.ndarray = WORDS) -> np.ndarray:
    """A bitmap of each row's k-letter substrings, of 64 * ``words`` bits: each substring sets the bit that its hash names.
    ``words`` are powers of two; where they are given row by row, the bitmaps come end to end.

    A bit that one row has and another has not is a substring that they don't share, so bitmaps bound what two rows can
    have in common, and never from below. Halves of a bitmap put together are the bitmap of half the length.
    """
    counts = np.maximum(lengths - k + 1, 0)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else np.zeros(0, np.int64)
    each = np.broadcast_to(words, len(lengths)).astype(np.int64)
    edge = np.concatenate(([0], np.cumsum(each)))
    out = np.zeros(int(edge[-1]), np.uint64)
    full = np.flatnonzero(counts)
    for at, end, own, begin in _some(codes, starts[full], counts[full], k):
        row, size = full[at:end], np.diff(np.append(begin, len(own)))
        low, high = int(edge[row[0]]), int(edge[row[-1] + 1])
        bits = np.zeros(64 * (high - low), bool)
        bit = (own * np.uint32(0x9E3779B1)) & np.repeat(64 * each[row] - 1, size)
        bits[np.repeat(64 * (edge[row] - low), size) + bit] = True
        out[low:high] = np.packbits(bits, bitorder="little").view(np.uint64)
    return out.reshape(-1, words) if isinstance(words, int) else out


class Bitmaps:
    """The signatures of some rows, and bounds of the similarity of any two of them.

    ``n`` are the rows' numbers of distinct substrings, ``column`` their signatures, which may be of several lengths: two rows
    are compared at the shorter one.
    """

    def __init__(self, n: np.ndarray, column: pa.Array):
        data, size = joined(column)
        self.n, self.words, self.size = n, np.frombuffer(data.tobytes(), np.uint64), size // 8
        self.begin = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        self._folded: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def folded(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(column of each row, words, bits that are set) of the rows with ``width`` words or more, folded to so many."""
        if width not in self._folded:
            rows = np.flatnonzero(self.size >= width)
            words, size = np.zeros((width, len(rows)), np.uint64), self.size[rows]
            for s in np.unique(size).tolist():
                own = np.flatnonzero(size == s)
                whole = self.words[self.begin[rows[own], None] + np.arange(s)]
                words[:, own] = np.bitwise_or.reduce(whole.reshape(len(own), s // width, width), axis=1).T
            place = np.zeros(len(self.size), np.int64)
            place[rows] = np.arange(len(rows))
            self._folded[width] = place, words, np.bitwise_count(words).sum(axis=0, dtype=np.int64)
        return self._folded[width]

    def near(self, x: np.ndarray, y: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
        """Which of the pairs of rows x and y may reach the threshold; what does is never left out."""
        one, other = threshold
        low, high = np.minimum(self.n[x], self.n[y]), np.maximum(self.n[x], self.n[y])
        out, width = low * other >= high * one, np.minimum(self.size[x], self.size[y])
        for w in np.flatnonzero(np.bincount(width[out])).tolist():
            place, words, bits = self.folded(w)
            at = np.flatnonzero(out & (width == w))
            p, q, both = place[x[at]], place[y[at]], np.zeros(len(at), np.int64)
            for word in words:
                both += np.bitwise_count(word[p] & word[q])
            common = np.minimum(self.n[x[at]] - bits[p], self.n[y[at]] - bits[q]) + both
            out[at] = common * other >= (low[at] + high[at] - common) * one
        return out


def distinct_texts(df: DataFrame, id_col: str, sequence: str, k: int) -> DataFrame:
    """(idx, p, n, w): one row for each distinct letters, with the smallest id; those of fewer than k letters have no
    k-letter substring and are left out. The letters are packed, as they will travel with each pair; n is the number of
    distinct substrings and w their signature, of at least two bits for each."""
    bound_arrow_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("idx"), letters(F.col(sequence)).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, lengths = joined(batch["s"])
            p = pack(codes, lengths)
            most = _most(k)
            n = np.concatenate([np.zeros(0, np.int64), *(_sizes(p.slice(i, most), k) for i in range(0, len(p), most))])
            words = 1 << np.ceil(np.log2(np.maximum(n / 32, 1))).astype(np.int64)
            edge = np.concatenate(([0], np.cumsum(8 * words))).astype(np.int32)
            w = signatures(codes, lengths, k, words)
            w = pa.Array.from_buffers(pa.binary(), len(p), [None, pa.py_buffer(edge), pa.py_buffer(w)])
            yield pa.RecordBatch.from_arrays([batch["idx"], p, pa.array(n, pa.int64()), w], ["idx", "p", "n", "w"])

    texts = rows.filter(F.length("s") >= k).groupBy("s").agg(F.min("idx").alias("idx")).select("idx", "s")
    return texts.mapInArrow(run, "idx long, p binary, n long, w binary")


def candidate_pairs(
    texts: DataFrame, k: int, bands: int, rows: int, threshold: tuple[int, int], hot: int = HOT, *, bounded: bool = False
) -> DataFrame:
    """(idx_a, idx_b), idx_a < idx_b: the texts that share a band key and may reach the threshold.

    Each text goes to the keys of all its bands. The rows are sorted by key, and a Python task pairs them up in a sorted
    stream. A key of more than ``hot`` texts only passes through that task, and is compared in blocks, see ``_hot_pairs``.

    Unrelated texts share keys by chance, and their pairs grow as the square of the table. With ``bounded``, rows carry the
    signatures of their texts, a task holds each pair against the bound before it gives it out, and only pairs that may
    reach the threshold are ever written. A few bands travel at once, and their shuffle is gone before the next do.
    """
    spark = texts.sparkSession
    bound_arrow_batches(spark)
    carried, kinds = (["idx", "n", "w"], "a long, idx long, n long, w binary") if bounded else (["idx"], "a long, idx long")

    def anchor(some: range):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes, lengths = unpack(batch["p"])
                which, keys = fingerprints(codes, lengths, k, bands, rows, some)
                row = pa.array(np.repeat(which, len(some)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.reshape(-1).view(np.int64)), *[batch[c].take(row) for c in carried]], ["a", *carried]
                )

        return run

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "idx_a", "idx_b"]
        rest, over = [], False  # rows of the last key; whether it is hot and they were passed on
        for batch in batches:
            waiting = sum(map(len, rest))
            here = pa.Table.from_batches([*rest, batch]).combine_chunks()
            if not len(here):
                continue
            a, ids = here["a"].to_numpy(), here["idx"].to_numpy()
            marks = Bitmaps(here["n"].to_numpy(), here["w"].chunk(0)) if bounded else None
            first = np.concatenate(([0], np.flatnonzero(a[1:] != a[:-1]) + 1))
            size = np.diff(np.concatenate((first, [len(a)])))
            large = size > hot
            large[0] |= over and waiting > 0
            passed = np.repeat(large, size)
            if over:
                passed[:waiting] = False
            some = np.flatnonzero(passed)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(a[some]), pa.array(ids[some]), pa.nulls(len(some), pa.int64())], names)
            place = np.arange(len(a)) - np.repeat(first, size)
            # Every new row with all rows of its key before it; those of earlier batches wait in `rest`.
            left = np.flatnonzero((np.arange(len(a)) >= waiting) & (place > 0) & ~np.repeat(large, size))
            for part in _parts(left, place[left]):
                partner, own = spread(part - place[part], place[part]), np.repeat(part, place[part])
                if marks:
                    near = marks.near(partner, own, threshold)
                    partner, own = partner[near], own[near]
                x, y = ids[own], ids[partner]
                pair = [pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(x), pa.int64()), *pair], names)
            over = bool(large[-1])
            rest = here.slice(len(a) - 1 if over else first[-1]).to_batches()  # of a hot key one row tells that it goes on

    parts, step = int(spark.conf.get("spark.sql.shuffle.partitions")), BANDS_AT_ONCE if bounded else bands
    found = None
    with freed_shuffles(spark):
        for low in range(0, bands, step):
            keyed = texts.mapInArrow(anchor(range(low, min(low + step, bands))), kinds)
            out = keyed.repartition(parts, "a").sortWithinPartitions("a").mapInArrow(compare, "a long, idx_a long, idx_b long")
            one = stage(out, "near-band")
            found = one if found is None else found.union(one)
        pairs, large = found.filter("a is null").select("idx_a", "idx_b"), found.filter("a is not null")
        if not large.isEmpty():
            pairs = pairs.union(_hot_pairs(large.select("a", F.col("idx_a").alias("idx")), texts, threshold, hot))
        return stage(pairs.distinct(), "near-pairs")


def _hot_pairs(large: DataFrame, texts: DataFrame, threshold: tuple[int, int], hot: int) -> DataFrame:
    """(idx_a, idx_b), with repeats: the pairs of texts of hot keys that may reach the threshold.

    A hot key's texts are cut into blocks of about ``hot`` by a hash of their ids, and each two blocks meet in a cell of
    their own, so no task has more than two blocks in memory and the work of the hottest key is spread evenly. Within a
    cell texts are held against each other by their signatures and numbers of substrings, which bound a similarity from
    above: what doesn't reach the threshold by that bound can't reach it, and nothing else is left out.
    """

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts = None, []
        for batch in batches:
            edge = [0, *(np.flatnonzero(np.diff(batch["cell"].to_numpy())) + 1).tolist(), len(batch)]
            for low, high in zip(edge, edge[1:]):
                if low == high:
                    continue
                cell = batch["cell"][low].as_py()
                if cell != last and parts:
                    yield from _cell(pa.Table.from_batches(parts).combine_chunks(), threshold)
                    parts = []
                last = cell
                parts.append(batch.slice(low, high - low))
        if parts:
            yield from _cell(pa.Table.from_batches(parts).combine_chunks(), threshold)

    sizes = stage(large.groupBy("a").agg(F.count(F.lit(1)).alias("size")), "near-hot")
    signed = stage(texts.join(large.select("idx").distinct(), "idx", "left_semi").select("idx", "n", "w"), "near-signed")
    blocks = F.ceil(F.col("size") / hot)
    rows = join_groups(large, sizes, ["a"], "size", large.count()).join(signed, "idx")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("idx"), blocks)).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    cell = F.xxhash64("a", F.least("block", "with"), F.greatest("block", "with"))
    rows = rows.select(cell.alias("cell"), "block", "with", "idx", "n", "w")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(cells, "idx_a long, idx_b long")


def _cell(rows: pa.Table, threshold: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """The pairs of a cell that may reach the threshold: within a block, or between two."""
    ids, n, block, other_block = (rows[c].to_numpy() for c in ("idx", "n", "block", "with"))
    marks = Bitmaps(n, rows["w"].chunk(0))
    inner = (block == other_block).all()
    left = np.arange(len(ids)) if inner else np.flatnonzero(block < other_block)
    right = left if inner else np.flatnonzero(block > other_block)
    for part in _parts(left, np.full(len(left), max(1, len(right)))):
        x, y = np.repeat(part, len(right)), np.tile(right, len(part))
        some = (ids[x] != ids[y]) & (y > x) if inner else ids[x] != ids[y]
        x, y = x[some], y[some]
        near = marks.near(x, y, threshold)
        x, y = ids[x[near]], ids[y[near]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["idx_a", "idx_b"])


def _most(k: int) -> int:
    """Rows whose number fits beside k letters of 5 bits."""
    return min(1 << 13, 1 << (64 - 5 * k))


def _sizes(column: pa.Array, k: int) -> np.ndarray:
    """How many distinct k-letter substrings each row has."""
    return np.bincount((_grams(column, k) >> np.uint64(5 * k)).astype(np.int64), minlength=len(column))


def _parts(rows: np.ndarray, weights: np.ndarray, most: int = 1 << 20) -> list[np.ndarray]:
    """``rows`` in runs whose weights add up to about ``most``."""
    if not len(rows):
        return []
    return np.split(rows, np.flatnonzero(np.diff(np.cumsum(weights) // most)) + 1)


def _grams(column: pa.Array, k: int) -> np.ndarray:
    """The distinct k-letter substrings of each row of packed texts, as row << 5k | letters, in order."""
    codes, lengths = unpack(column)
    counts = np.maximum(lengths - k + 1, 0)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    row = np.repeat(np.arange(len(lengths), dtype=np.uint64), counts)
    keys = np.sort((row << np.uint64(5 * k)) | packed(codes, k)[spread(starts, counts)])
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


def _grams_of_runs(column: pa.Array, ids: np.ndarray, k: int) -> np.ndarray:
    """``_grams`` where neighbouring rows of one id have one text, which is then taken apart once."""
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    grams = _grams(column.take(pa.array(first)), k)
    size = np.bincount((grams >> np.uint64(5 * k)).astype(np.int64), minlength=len(first))
    run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    row = np.repeat(np.arange(len(ids), dtype=np.uint64), size[run])
    return row << np.uint64(5 * k) | grams[spread(begin[run], size[run])] & np.uint64(2 ** (5 * k) - 1)


def _jaccard(k: int):
    most = min(1 << 14, 1 << (64 - 5 * k))  # see `_most`

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), most):
                batch = whole.slice(at, most)
                a, b = _grams(batch["sa"], k), _grams_of_runs(batch["sb"], batch["idx_b"].to_numpy(), k)
                both = np.sort(np.concatenate((a, b)), kind="stable")
                twice = both[1:][both[1:] == both[:-1]]
                count = lambda x: np.bincount((x >> np.uint64(5 * k)).astype(np.int64), minlength=len(batch))
                common = count(twice)
                total = count(a) + count(b) - common
                yield pa.RecordBatch.from_arrays(
                    [batch["idx_a"], batch["idx_b"], pa.array(common), pa.array(total)],
                    ["idx_a", "idx_b", "common", "total"],
                )

    return run


def similar_pairs(
    df: DataFrame,
    id_col: str = "idx",
    sequence: str = "sequence",
    k: int = 10,
    threshold: tuple[int, int] = (1, 2),
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """(idx_a, idx_b, common, total), idx_a < idx_b: the pairs of distinct texts whose sets of k-letter substrings have
    an intersection (common) of at least ``threshold`` (numerator, denominator) of their union (total).

    MinHash banding. It stands in place of anchor-point covering, whose guarantee it does not give: no covering code over
    min-hash fingerprints was found that reaches a similarity of 0.5 at a bearable number of copies (see the README). A
    text goes to the keys of its ``bands`` bands of ``rows`` min-hashes, and two texts share one with a probability of
    1 - (1 - J**rows)**bands: 0.999 at J = 0.5, 0.99998 at 0.6, for the default 24 bands of 2. Every pair that shares a key and
    may reach the threshold by an upper bound of its similarity, which loses none, is verified by its exact sets, so no row is
    wrong and none is lost after the bands. Pairs that can't are dropped where they meet: by chance alone they are as many
    as the square of the table.

    Only the record with the smallest id of each group with equal letters takes part; nulls and texts of fewer than k
    letters have no pairs. k may be at most 12. Repeated rows make no difference, an empty table gives no rows, other
    columns are not read. Copies never meet at a key; a group of texts that are all similar gives all its pairs, as
    they are the result.
    """
    if not 1 <= k <= 12:
        raise ValueError("k must be from 1 to 12")
    with freed_shuffles(df.sparkSession):
        texts = stage(distinct_texts(df, id_col, sequence, k), "near-texts")
    one, other = threshold
    pairs = candidate_pairs(texts, k, bands, rows, threshold, bounded=True)
    # The texts of a pair come together by two joins on unique ids, in which only texts of candidates survive. A hub's
    # pairs are many short rows of one key; adaptive execution splits such a partition.
    a = texts.select(F.col("idx").alias("idx_a"), F.col("p").alias("sa"))
    b = texts.select(F.col("idx").alias("idx_b"), F.col("p").alias("sb"))
    scored = pairs.join(a, "idx_a").join(b, "idx_b").select("idx_a", "idx_b", "sa", "sb")
    out = scored.mapInArrow(_jaccard(k), "idx_a long, idx_b long, common long, total long")
    return out.filter(F.col("common") * other >= F.col("total") * one)


def classes(pairs: DataFrame, texts: DataFrame, rounds: int = 50) -> DataFrame:
    """(idx, class_id, n_links): one row for each text, with the smallest idx linked to it by any chain of pairs and the
    number of its own pairs; a text without a pair is its own class.

    Alternating large-star and small-star steps (Kiveris and others, Connected Components in MapReduce and Beyond,
    2014) on tables in the shared folder; nothing is collected, and a hub's links never meet in one task (see
    ``join_groups``).
    """
    both = pairs.select(F.col("idx_a").alias("u"), F.col("idx_b").alias("v")).union(pairs.select("idx_b", "idx_a"))
    links = both.groupBy("u").agg(F.count(F.lit(1)).alias("n_links"))
    edges = stage(pairs.select(F.col("idx_b").alias("u"), F.col("idx_a").alias("v")).distinct(), "edges")
    before = None
    lowest = lambda df: df.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    mark = F.sum(F.shiftrightunsigned(F.xxhash64("u", "v"), 40))  # 24 bits, so that no number of edges overflows
    count = edges.count()
    for _ in range(rounds):
        both = edges.union(edges.select("v", "u"))
        low = lowest(both).withColumn("m", F.least("m", "u"))
        large = join_groups(both, low, ["u"], "n", 2 * count).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = stage(large.filter("u != v").distinct(), "down")
        low = lowest(down)
        small = join_groups(down, low, ["u"], "n", down.count()).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(small.union(low.select("u", "m")).filter("u != v").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), mark).first()
        count = now[0]
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the classes did not settle; allow more rounds")
    ends = edges.groupBy(F.col("u").alias("idx")).agg(F.min("v").alias("class_id"))
    links = links.withColumnRenamed("u", "idx")
    return (
        texts.select("idx").join(ends, "idx", "left").join(links, "idx", "left")
        .select("idx", F.coalesce("class_id", "idx").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )


def memberships(df: DataFrame, pairs: DataFrame, id_col: str = "idx", sequence: str = "sequence") -> DataFrame:
    """(idx, class_id, n_links): one row for each record with letters; exact copies stand in the class of their text.

    ``pairs`` are the ``similar_pairs`` of ``df``. n_links counts the links of the record's text to other texts, so all
    copies of a text have the same number and links between copies are not counted. Records without an id are left out.

    Records meet the class of their text by the SHA-256 of the letters; those of a text that makes up much of the table
    stay where they are.
    """
    one = df.select(F.col(id_col).cast("long").alias("idx"), letters(F.col(sequence)).alias("s"))
    records = stage(one.filter("idx is not null and s <> ''").select("idx", F.sha2("s", 256).alias("h")), "near-records")
    texts = stage(records.groupBy("h").agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("n")), "near-groups")
    found = classes(pairs, texts.select(F.col("first").alias("idx"))).withColumnRenamed("idx", "first")
    groups = stage(texts.join(found, "first").drop("first"), "near-classes")
    return join_groups(records, groups, ["h"], "n", records.count()).select("idx", "class_id", "n_links")
