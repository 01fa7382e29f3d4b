"""Problem 6: long exact spans shared between records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.letters import joined, letters, mixed, packed, spread, windows_hashes
from strandline.runtime import bound_arrow_batches, join_groups, stage

#: Letters of a suffix's shortest prefix that decides its group.
PREFIX = 20

#: Suffixes in a group, at most, before its prefix is lengthened; also about as many as a task takes at once.
GROUP = 1 << 21

#: Groups that may be too large at the same time. The list of them travels with the tasks.
MOST_LARGE = 1 << 18

#: The record that a stretch travels as when several records are known to have it: another one to each of them.
SEVERAL = -(2**62) - 2

#: Letters cut into stretches at once in a map task.
_CHUNK = 1 << 22


def _running_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values, by doubling."""
    reach = 1
    while reach * 2 <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[: len(x) - (width - reach)], x[width - reach :]) if reach < width else x


def prefix_lengths(min_len: int, prefix: int) -> list[int]:
    """The lengths that a prefix may have: the shortest, and as it is lengthened, up to the whole depth."""
    more = min_len - prefix
    return sorted({prefix, prefix + more // 2, prefix + 3 * more // 4, min_len})


def _bucket(group: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(group * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values if len(table) else np.zeros(len(values), bool)


def grouped(codes: np.ndarray, lengths: np.ndarray, min_len: int, prefix: int, large: list[np.ndarray], bits: int):
    """(at, row, group, deepest) of the suffixes of at least ``min_len`` letters: place, row and group of each, and which of
    them have as long a prefix as ``large`` asks for.

    The prefix of a suffix is found within its first min_len letters: the ``prefix`` letters of least hash, the leftmost
    of equal ones. Equal runs of min_len letters so have equal prefixes, and neighbouring suffixes mostly share theirs.
    ``large`` has, for each length of prefixes but the last, the sorted buckets of the groups that are too large. The
    prefixes of their suffixes are lengthened to either side, within the first min_len letters, so that again as many
    neighbouring suffixes as can share one. At full length a group is one run of min_len letters.
    """
    counts = np.maximum(lengths - min_len + 1, 0)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else np.zeros(0, np.int64)
    at, row = spread(starts, counts), np.repeat(np.arange(len(lengths)), counts)
    if not len(at):
        return at, row, np.zeros(0, np.uint64), at
    (short,) = windows_hashes(codes, (prefix,), 17)
    group = _running_min(short, min_len - prefix + 1)[at]
    deepest = np.arange(len(at))
    if not large or not len(large[0]):
        return at, row, group, deepest
    deepest = np.flatnonzero(_among(_bucket(group, bits), large[0]))
    places = np.flatnonzero(_among(_bucket(short, bits), large[0]))
    nth = np.searchsorted(places, at[deepest])
    while len(wrong := np.flatnonzero(short[places[nth]] != group[deepest])):
        nth[wrong] += 1
    place = places[nth]  # where the shortest prefix stands
    for length, some in zip(prefix_lengths(min_len, prefix)[1:], [*large[1:], None]):
        shift = place - at[deepest]
        step = min_len - length + 1
        before = np.minimum(shift // step * step, length - prefix)
        (long,) = windows_hashes(codes, (length,), 17 + length)
        group[deepest] = long[place - before]
        if some is None or not len(some):
            break
        more = _among(_bucket(group[deepest], bits), some)
        deepest, place = deepest[more], place[more]
    return at, row, group, deepest


def stretches(codes: np.ndarray, lengths: np.ndarray, min_len: int, prefix: int, large: list[np.ndarray] = (), bits: int = 12):
    """(row, start, count, group, ends): each row's suffixes of at least ``min_len`` letters in stretches of one group,
    of at most min_len suffixes each; ends are hashes of a stretch's first and last min_len letters, which together
    are all its letters. Neighbouring suffixes of one group travel as one stretch of letters, some 4 letters a suffix,
    not min_len.
    """
    at, row, group, _ = grouped(codes, lengths, min_len, prefix, large, bits)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    (whole,) = windows_hashes(codes, (min_len,), 17)
    first = np.ones(len(at), bool)
    first[1:] = (group[1:] != group[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(first)
    size = np.diff(np.concatenate((first, [len(at)])))
    pieces = -(-size // min_len)
    if pieces.max() > 1:  # only repeats of a short unit go on for longer
        nth = spread(np.zeros(len(size), np.int64), pieces)
        first, size = np.repeat(first, pieces) + nth * min_len, np.minimum(np.repeat(size, pieces) - nth * min_len, min_len)
    begin, end = at[first], at[first + size - 1]
    ends = mixed(whole[begin] * np.uint64(0x9E3779B97F4A7C15) ^ whole[end] + size.astype(np.uint64))
    return row[first], begin - starts[row[first]], size, group[first], ends


def settled(record: np.ndarray, begin: np.ndarray, size: np.ndarray, ends: np.ndarray, codes: np.ndarray):
    """(travels, shared): which stretches must travel, and which are found here to be shared with another record.

    Of equal stretches of several records only the first travels, as ``SEVERAL``, and all are shared; their letters are
    compared.
    """
    order = np.argsort(ends, kind="stable")
    first = np.concatenate(([0], np.flatnonzero(ends[order][1:] != ends[order][:-1]) + 1))
    count = np.diff(np.concatenate((first, [len(order)])))
    many = np.minimum.reduceat(record[order], first) != np.maximum.reduceat(record[order], first)
    travels, shared = np.ones(len(order), bool), np.zeros(len(order), bool)
    member = np.flatnonzero(np.repeat(many, count))
    if not len(member):
        return travels, shared
    mine, model = order[member], order[np.repeat(first, count)[member]]
    equal = size[mine] == size[model]
    mine, model = mine[equal], model[equal]
    differ = codes[spread(begin[mine], size[mine])] != codes[spread(begin[model], size[mine])]
    upto = np.concatenate(([0], np.cumsum(differ)))
    edge = np.concatenate(([0], np.cumsum(size[mine])))
    equal = upto[edge[1:]] == upto[edge[:-1]]
    mine, model = mine[equal], model[equal]
    other = record[mine] != record[model]
    shared[mine[other]] = True
    shared[model[other]] = True
    shared[mine] |= shared[model]  # a second copy in the model's own record
    travels[mine[(mine != model) & shared[model]]] = False
    return travels, shared


class Settled:
    """Stretches of several records that a task has sent already; the same stretch need not travel from it again.

    It holds ``most`` letters at most. What it can't hold travels once a chunk, so its size changes no result.
    """

    def __init__(self, most: int = 1 << 24):
        self.most = most
        self.ends, self.size, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.text = np.zeros(0, np.uint8)

    def known(self, begin: np.ndarray, size: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Which stretches are among them, letter by letter."""
        out = np.zeros(len(ends), bool)
        if not len(self.ends):
            return out
        place = np.minimum(np.searchsorted(self.ends, ends), len(self.ends) - 1)
        some = np.flatnonzero((self.ends[place] == ends) & (self.size[place] == size))
        mine = codes[spread(begin[some], size[some])]
        differ = np.concatenate(([0], np.cumsum(mine != self.text[spread(self.at[place[some]], size[some])])))
        edge = np.concatenate(([0], np.cumsum(size[some])))
        out[some[differ[edge[1:]] == differ[edge[:-1]]]] = True
        return out

    def add(self, begin: np.ndarray, size: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> None:
        """Remember stretches as far as there is room."""
        _, one = np.unique(ends, return_index=True)
        one = one[~np.isin(ends[one], self.ends)]
        one = one[np.cumsum(size[one]) <= self.most - len(self.text)]
        if not len(one):
            return
        at = len(self.text) + np.concatenate(([0], np.cumsum(size[one])[:-1]))
        self.text = np.concatenate((self.text, codes[spread(begin[one], size[one])]))
        all_ = [np.concatenate(x) for x in ((self.ends, ends[one]), (self.size, size[one]), (self.at, at))]
        order = np.argsort(all_[0])
        self.ends, self.size, self.at = (x[order] for x in all_)


def _pack(arrays: list[np.ndarray]) -> bytes:
    press = zstandard.ZstdCompressor(level=1)
    parts = [press.compress(np.ascontiguousarray(x).tobytes()) for x in arrays]
    return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)


def _unpack(blob: bytes, kinds: tuple) -> list[np.ndarray]:
    sizes = np.frombuffer(blob[: 8 * len(kinds)], np.int64)
    out, at, press = [], 8 * len(kinds), zstandard.ZstdDecompressor()
    for size, kind in zip(sizes, kinds):
        raw = press.decompress(blob[at : at + size])
        out.append(np.frombuffer(raw, kind))
        at += size
    return out


_KINDS = (np.int64, np.int64, np.int32, np.uint8)  # record, start, letters of each stretch; their letters


def sorted_suffixes(text: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, deep): the suffixes at ``at`` in order of their first ``depth`` letters, and for each the letters that it
    has in common with the one before, as far as is compared: ``depth`` or fewer.

    The first 12 letters sort all suffixes; after that only those that are still equal are sorted by 8 letters more, so
    that suffixes come apart as they do on the way down a suffix tree.
    """
    first, more = min(12, depth), packed(text, min(8, depth))
    key = packed(text, first)[at]
    order = np.argsort(key)
    key = key[order]
    common = np.zeros(len(at), np.int32)
    common[1:][key[1:] == key[:-1]] = first
    done = first
    while done < depth:
        tied = np.zeros(len(at), bool)  # in a run of suffixes that agree so far
        tied[1:] = common[1:] >= done
        tied[:-1] |= tied[1:]
        rows = np.flatnonzero(tied)
        if not len(rows):
            break
        node = np.cumsum(common[rows] < done).astype(np.uint64) - np.uint64(1)
        # The last letters may be compared twice, which changes nothing.
        key = more[at[order[rows]] + min(done, depth - 8 if depth >= 8 else 0)]
        if node[-1] < 1 << 24:
            key = node << np.uint64(40) | key
            new = np.argsort(key)
        else:
            new = np.lexsort((key, node))
        order[rows], key, node = order[rows[new]], key[new], node[new]
        done = min(done + 8, depth)
        common[rows[1:][(key[1:] == key[:-1]) & (node[1:] == node[:-1])]] = done
    return order, common


def shared_suffixes(
    record: np.ndarray, start: np.ndarray, size: np.ndarray, text: np.ndarray, min_len: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, start, end) of the runs of suffixes, end exclusive, whose first ``min_len`` letters also begin a suffix
    of another record in the group.

    The group's suffix tree, as its leaves in order and the letters that neighbours have in common. An inner node of
    depth min_len or more is a run of neighbours that have that many in common; if its leaves are of two or more
    records, its letters are a repeat between records, and all its leaves are shared.
    """
    counts = (size - min_len + 1).astype(np.int64)
    begin = np.concatenate(([0], np.cumsum(size.astype(np.int64))[:-1]))
    at = spread(begin, counts)
    owner = np.repeat(np.arange(len(record)), counts)
    order, common = sorted_suffixes(text, at, min_len)
    first = np.flatnonzero(common < min_len)
    records = record[owner[order]]
    several = np.minimum.reduceat(records, first) != np.maximum.reduceat(records, first)
    shared = np.zeros(len(at), bool)
    shared[order] = np.repeat(several, np.diff(np.append(first, len(at))))
    # A node of SEVERAL alone is shared, too, but its records were told so where they were found to be several.
    # Neighbouring shared suffixes of one stretch make one run.
    flag = np.concatenate(([0], shared.view(np.int8), [0]))
    edge = np.diff(flag)
    inner = np.cumsum(counts)[:-1]  # borders between stretches part runs, too
    border = np.zeros(len(at) + 1, bool)
    border[inner] = True
    opens = np.flatnonzero((edge == 1) | (border & (flag[1:] == 1)))
    closes = np.flatnonzero((edge == -1) | (border & (flag[:-1] == 1)))
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    o = owner[opens]
    return record[o], start[o] + opens - first[o], start[o] + closes - first[o]


def large_groups(texts: DataFrame, min_len: int, prefix: int, group: int, bits: int, most: int) -> list[np.ndarray]:
    """For each length of prefixes but the last, the buckets of groups with more than ``most`` suffixes, in order.

    Suffixes are counted by a hash of their prefix in 2 ** bits buckets, first by the shortest; those in large buckets
    are counted again by longer prefixes. Tasks count for themselves before the sums meet. There are fewer than
    suffixes / most large buckets, whatever the data.
    """
    out: list[np.ndarray] = []
    for _ in prefix_lengths(min_len, prefix)[:-1]:
        counts = texts.select("s").mapInArrow(_counter(min_len, prefix, out, bits), "bucket long, n long")
        rows = counts.groupBy("bucket").agg(F.sum("n").alias("n")).filter(F.col("n") > most).select("bucket").collect()
        if not rows:
            break
        out.append(np.sort(np.array([r.bucket for r in rows], np.int64)))
    return out


def _counter(min_len: int, prefix: int, large: list[np.ndarray], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = bits <= 20
        total = np.zeros(1 << bits if dense else 0, np.int64)
        send = lambda b, n: pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["bucket", "n"])
        for codes, lengths, _ in _chunks(batches):
            _, _, group, deepest = grouped(codes, lengths, min_len, prefix, large, bits)
            bucket = _bucket(group[deepest], bits)
            if dense:
                total += np.bincount(bucket, minlength=len(total))
            else:
                yield send(*np.unique(bucket, return_counts=True))
        some = np.flatnonzero(total)
        yield send(some, total[some])

    return run


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """(letters end to end, lengths, ids) of some texts at a time."""
    for batch in batches:
        codes, lengths = joined(batch["s"])
        ids = batch["rec"].to_numpy() if "rec" in batch.schema.names else None
        ends, at = np.cumsum(lengths), 0
        while at < len(lengths):
            done = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, done + _CHUNK, "right")))
            yield codes[int(done) : int(ends[end - 1])], lengths[at:end], ids[at:end] if ids is not None else None
            at = end


def shared_spans(
    df: DataFrame,
    known: DataFrame | None = None,
    id_col: str = "idx",
    sequence: str = "sequence",
    min_len: int = 60,
    prefix: int = PREFIX,
    group: int = GROUP,
) -> DataFrame:
    """(idx, span_start, span_end): each maximal run of letter positions of a record that lie in a stretch of at least
    ``min_len`` letters which also occurs in the letters of another record or of ``known``; end exclusive.

    Prefix-partitioned suffix trees. Records with equal letters are merged first: a copy shares all its letters, so
    only one of each group travels. Prefixes are counted, and those of more than ``group`` suffixes are lengthened until
    each group fits (see ``large_groups`` and ``grouped``). The suffixes travel to their groups as stretches of letters,
    and each group's tree is built in memory down to depth min_len (see ``shared_suffixes``). Equal stretches of a map
    task travel once: those of two or more records are settled there (see ``Settled``), so a repeat that a third of all
    records contain reaches its group as one stretch a task.

    Null sequences and those of fewer than min_len letters have no span. A record never shares with itself. Repeated
    rows are copies of each other. Rows of one id with different letters are one record. An empty table gives no rows;
    other columns are not read.
    """
    if not 8 <= prefix <= min_len:
        raise ValueError("8 <= prefix <= min_len must hold")
    bound_arrow_batches(df.sparkSession)
    marks = [F.xxhash64(F.lit(i), "s").alias(f"f{i}") for i in (1, 2)]
    rows = df.select(F.col(id_col).cast("long").alias("idx"), letters(F.col(sequence)).alias("s"))
    rows = rows.filter(F.length("s") >= min_len)
    texts = rows.groupBy("s").agg(F.min("idx").alias("rec"), F.count(F.lit(1)).alias("n"))
    if known is not None:
        near = known.select(letters(F.col(sequence)).alias("s")).filter(F.length("s") >= min_len).distinct()
        # Known texts get negative numbers, so that none is taken for a record.
        near = near.select("s", (-1 - F.pmod(F.xxhash64("s"), F.lit(2**62))).alias("rec"), F.lit(0).cast("long").alias("n"))
        texts = texts.select("s", "rec", "n").unionByName(near)
    texts = stage(texts.select("rec", "n", F.length("s").cast("long").alias("size"), *marks, "s"), "span-texts")
    total = texts.agg(F.sum("size")).first()[0] or 0
    groups = max(1, -(-total // group))
    bits = min(30, max(12, (64 * groups).bit_length()))
    large = large_groups(texts, min_len, prefix, group, bits, max(group, total // MOST_LARGE))
    sent = texts.select("rec", "s").mapInArrow(_cutter(min_len, prefix, groups, large, bits), _SENT)
    sent = sent.repartition(min(groups, 10_000), "part").sortWithinPartitions("part")
    runs = sent.mapInArrow(_builder(min_len), _RUNS)
    return _merged(runs, texts, min_len).unionByName(_copies(rows, texts, marks))


_SENT = "part int, blob binary, rec long, a long, b long"
_RUNS = "rec long, a long, b long"


def _cutter(min_len: int, prefix: int, groups: int, large: list[np.ndarray] = (), bits: int = 12):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = Settled()
        for some in _chunks(batches):
            yield from _route(*some, stretches(*some[:2], min_len, prefix, large, bits), min_len, groups, sent)

    return run


def _builder(min_len: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blobs = None, []
        for batch in batches:
            done = batch.filter(pc.is_null(batch["blob"]))
            yield done.select(["rec", "a", "b"])
            batch = batch.filter(pc.is_valid(batch["blob"]))
            for p, blob in zip(batch["part"].to_pylist(), batch["blob"].to_pylist()):
                if p != part and blobs:
                    yield _judge(blobs, min_len)
                    blobs = []
                part = p
                blobs.append(blob)
        if blobs:
            yield _judge(blobs, min_len)

    return run


def _route(codes, lengths, ids, found, min_len, groups, sent: Settled) -> Iterator[pa.RecordBatch]:
    """The stretches of some records by part, and the runs that are settled at once, which only pass through."""
    row, start, count, group, ends = found
    if not len(row):
        return
    begin, size, record = np.concatenate(([0], np.cumsum(lengths)[:-1]))[row] + start, count + min_len - 1, ids[row]
    travels, shared = settled(record, begin, size, ends, codes)
    known = sent.known(begin, size, ends, codes)
    new = np.flatnonzero(shared & travels & ~known)
    sent.add(begin[new], size[new], ends[new], codes)
    shared |= known
    travels &= ~known
    own = np.flatnonzero(shared & (record >= 0))
    if len(own):
        to = pa.array((mixed(record[own].astype(np.uint64)) % np.uint64(groups)).astype(np.int32))
        runs = [pa.array(x[own].astype(np.int64)) for x in (record, start, start + count)]
        yield pa.RecordBatch.from_arrays([to, pa.nulls(len(own), pa.binary()), *runs], ["part", "blob", "rec", "a", "b"])
    part = (mixed(group) % np.uint64(groups)).astype(np.int32)
    order = np.flatnonzero(travels)
    order = order[np.argsort(part[order], kind="stable")]
    record = np.where(shared, SEVERAL, record)
    part, record, start, size, begin = part[order], record[order], start[order], size[order], begin[order]
    first = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]))
    blobs = [
        _pack([record[a:b], start[a:b], size[a:b].astype(np.int32), codes[spread(begin[a:b], size[a:b])]])
        for a, b in zip(first[:-1], first[1:])
    ]
    none = [pa.nulls(len(blobs), pa.int64())] * 3
    to = pa.array(part[first[:-1]], pa.int32())
    yield pa.RecordBatch.from_arrays([to, pa.array(blobs, pa.binary()), *none], ["part", "blob", "rec", "a", "b"])


def _judge(blobs: list[bytes], min_len: int) -> pa.RecordBatch:
    record, start, size, text = (np.concatenate(x) for x in zip(*[_unpack(b, _KINDS) for b in blobs]))
    out = shared_suffixes(record, start, size, text, min_len)
    own = out[0] >= 0
    return pa.RecordBatch.from_arrays([pa.array(x[own].astype(np.int64)) for x in out], ["rec", "a", "b"])


def _merged(runs: DataFrame, texts: DataFrame, min_len: int) -> DataFrame:
    """Runs of suffixes as maximal runs of positions, of the records that have no copy."""
    spans = runs.select("rec", F.col("a").alias("lo"), (F.col("b") + (min_len - 1)).alias("hi"))
    order = Window.partitionBy("rec").orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.coalesce(F.col("lo") > before, F.lit(True)).cast("int"))
    marked = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = marked.groupBy("rec", "island").agg(F.min("lo").alias("span_start"), F.max("hi").alias("span_end"))
    single = texts.filter("n = 1").select("rec")
    return islands.join(single, "rec", "left_semi").select(F.col("rec").alias("idx"), "span_start", "span_end")


def _copies(rows: DataFrame, texts: DataFrame, marks: list) -> DataFrame:
    """The records with copies, each shared as a whole. Fingerprints travel, not letters, unless two texts have one."""
    whole = texts.filter("n > 1")
    clash = not texts.filter("n > 0").groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").isEmpty()
    keys = ["f1", "f2"] + ["s"] * clash
    found = join_groups(rows.select("idx", *marks, *["s"] * clash), whole.select(*keys, "n", "size"), keys, "n", rows.count())
    return found.select("idx", F.lit(0).cast("long").alias("span_start"), F.col("size").alias("span_end"))
