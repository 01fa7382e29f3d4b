"""Problem 10: per-document text quality statistics, and what kind of text they tell."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.runtime import bound_arrow_batches, stage

#: A line belongs to sentences if so large a share of its words are common words and of its characters stand in words, or
#: if both its neighbours do.
COMMON_IN_LINE, WORDS_IN_LINE = 0.1, 0.5

_STATS = (
    "doc_id long, n_words long, mean_word_length double, symbol_ratio double, punct_line_share double, "
    "common_share double, digit_ratio double, words_per_line double, sentence_share double"
)

TYPES = ("prose", "listing", "junk")
_PROSE, _LISTING, _JUNK = range(3)

#: Labelling functions: (statistic, ((condition, type), ...)); the first condition that holds votes, else it abstains.
LABELLERS: tuple[tuple[str, tuple[tuple[str, int], ...]], ...] = (
    ("sentence_share", (("sentence_share < 0.2", _LISTING), ("sentence_share >= 0.4", _PROSE))),
    ("common_share", (("common_share < 0.02", _JUNK), ("common_share < 0.1", _LISTING), ("common_share >= 0.2", _PROSE))),
    ("symbol_ratio", (("symbol_ratio > 0.3", _JUNK), ("symbol_ratio > 0.08", _LISTING), ("symbol_ratio between 0.005 and 0.05", _PROSE))),
    ("punct_line_share", (("punct_line_share < 0.04", _LISTING), ("punct_line_share between 0.12 and 0.6", _PROSE))),
    ("mean_word_length", (("mean_word_length > 12 or mean_word_length < 1.8", _JUNK), ("mean_word_length < 3.4", _LISTING), ("mean_word_length between 4 and 9", _PROSE))),
    ("digit_ratio", (("digit_ratio > 0.12", _LISTING), ("digit_ratio < 0.06", _PROSE))),
    ("words_per_line", (("words_per_line < 4.5", _LISTING), ("words_per_line > 6", _PROSE))),
)


# Kinds of characters, as bits: letters and digits, symbols, digits 0-9, blanks that are stripped from lines, line ends in
# sentences.
_WORD, _SYMBOL, _DIGIT, _BLANK, _END = 1, 2, 4, 8, 16

#: Characters that are measured at once.
_CHUNK = 1 << 21


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(kinds, lower) of each code point. Lower case is kept where it is one character, which is all that words of the
    list can have."""
    points = [chr(c) for c in range(0x110000)]
    word = np.fromiter((c.isalnum() for c in points), bool, len(points))
    kinds = np.where(word, _WORD, _SYMBOL).astype(np.uint8)
    for characters, kind in ((" \t\r\f", _BLANK), ("\n", 0), (".!?;:", _SYMBOL | _END), ("0123456789", _WORD | _DIGIT)):
        kinds[[ord(c) for c in characters]] = kind
    low = [c.lower() for c in points]
    lower = np.fromiter((ord(x) if len(x) == 1 else ord(c) for c, x in zip(points, low)), np.uint32, len(points))
    return kinds, lower


class CommonWords:
    """Looks up many words at once: by a hash, and then letter by letter."""

    def __init__(self, words: list[str]):
        self.lower = _tables()[1]
        self.longest = max(map(len, words), default=0)
        letters = np.zeros((len(words), self.longest), np.uint32)
        for row, w in zip(letters, words):
            row[: len(w)] = [ord(c) for c in w]
        size = np.array([len(w) for w in words], np.int64)
        for self.factor in map(np.uint64, range(0x9E3779B97F4A7C15, 2**64, 2)):
            keys = self._hash(letters.reshape(-1), np.arange(len(words)) * self.longest, size)
            if len(np.unique(keys)) == len(words):
                break
        order = np.argsort(keys)
        self.keys, self.letters, self.size = keys[order], letters[order], size[order]

    def _hash(self, text: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        some = np.arange(len(at))
        for j in range(self.longest):
            some = some[size[some] > j]
            out[some] = (out[some] + self.lower[text[at[some] + j]]) * self.factor
        return out

    def __call__(self, text: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which words of ``text``, given by place and size, are in the list, whatever their case."""
        found = np.zeros(len(at), bool)
        some = np.flatnonzero(size <= self.longest)
        if not len(some) or not len(self.keys):
            return found
        keys = self._hash(text, at[some], size[some])
        entry = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = (self.keys[entry] == keys) & (self.size[entry] == size[some])
        some, entry = some[hit], entry[hit]
        same, left = np.ones(len(some), bool), np.arange(len(some))
        for j in range(self.longest):
            left = left[size[some[left]] > j]
            same[left] &= self.lower[text[at[some[left]] + j]] == self.letters[entry[left], j]
        found[some[same]] = True
        return found


def measure(texts: list[str], common: CommonWords) -> np.ndarray:
    """All statistics of texts, one row each, in the order of the schema; a text without words has zeros where words are
    divided by.

    The texts are one array of characters; words, lines and symbols are runs and places in it, and what a text or a line
    has of them is a difference of counts. Function words make sentences: damaged, machine-translated and claim sentences
    still have them, while lists, tables, codes and noise don't. A line between two lines of sentences belongs to them,
    as hard-wrapped lines may hold none.
    """
    kinds, _ = _tables()
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    text = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le"), np.uint32)
    first = np.cumsum(size + 1) - size - 1
    last = first + size
    kind = kinds[text]
    begin, end = _runs((kind & _WORD).view(np.int8))
    count = lambda places, low, high: np.searchsorted(places, high) - np.searchsorted(places, low)
    letters = np.concatenate(([0], np.cumsum(end - begin)))
    known = np.concatenate(([0], np.cumsum(common(text, begin, end - begin))))
    inside = lambda total, low, high: total[np.searchsorted(begin, high)] - total[np.searchsorted(begin, low)]

    line_end = np.flatnonzero(text == 10)
    line = np.concatenate(([0], line_end[:-1] + 1)) if len(line_end) else line_end
    blank, upto = _runs(((kind & _BLANK) > 0).view(np.int8))
    if len(blank):
        run = np.minimum(np.searchsorted(blank, line), len(blank) - 1)
        line = np.where(blank[run] == line, upto[run], line)
        run = np.maximum(np.searchsorted(upto, line_end, "right") - 1, 0)
        line_end = np.where(upto[run] == line_end, np.maximum(blank[run], line), line_end)
    full = line < line_end
    line, line_end = line[full], line_end[full]
    owner = np.searchsorted(first, line, "right") - 1
    long, words = line_end - line, count(begin, line, line_end)
    commons, spelt = inside(known, line, line_end), inside(letters, line, line_end)
    sentence = (commons > 0) & (commons >= COMMON_IN_LINE * words) & (spelt >= WORDS_IN_LINE * long)
    between = np.zeros(len(line), bool)
    between[1:-1] = sentence[:-2] & sentence[2:] & (owner[:-2] == owner[2:])
    of = lambda weights: np.bincount(owner, weights, len(texts))

    over = lambda a, b: np.divide(a, b, out=np.zeros(len(texts)), where=b > 0)
    n_words, lines, characters = count(begin, first, last), of(np.ones(len(line))), of(long)
    return np.stack(
        [
            n_words,
            over(inside(letters, first, last), n_words),
            over(count(np.flatnonzero(kind & _SYMBOL), first, last), size),
            over(of((kind[line_end - 1] & _END) > 0), lines),
            over(inside(known, first, last), n_words),
            over(count(np.flatnonzero(kind & _DIGIT), first, last), characters),
            over(n_words, lines),
            over(of(long * (sentence | between)), characters),
        ],
        axis=1,
    )


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ones."""
    edge = np.diff(flags, prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def quality_statistics(
    df: DataFrame, common_words: DataFrame, doc_id: str = "doc_id", text: str = "text", most_words: int = 1_000_000
) -> DataFrame:
    """Per document: n_words, mean_word_length, symbol_ratio (characters that are no letter, digit or ASCII white space),
    punct_line_share (non-blank lines that end in . ! ? ; or :), common_share (words in ``common_words``, of any
    language, as a document's own is often wrong), digit_ratio, words_per_line and sentence_share.

    Null and blank texts have no row. Documents are measured many at once (see ``measure``) and there is no shuffle; the
    word list travels with the tasks and must not have more than ``most_words`` words. Repeated rows give repeated rows; other
    columns are not read.
    """
    bound_arrow_batches(df.sparkSession)
    words = [r.w for r in common_words.select(F.lower("word").alias("w")).filter("w is not null").distinct().limit(most_words + 1).collect()]
    if len(words) > most_words:
        raise ValueError(f"more than {most_words} common words")
    names = [x.split()[0] for x in _STATS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = CommonWords([w for w in words if w.isalnum()])
        for batch in batches:
            upto = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False))
            cuts = np.unique(np.append(np.flatnonzero(np.diff(upto // _CHUNK, prepend=0)), len(batch))).tolist()
            for low, high in zip([0, *cuts], cuts):
                if low < high:
                    part = batch.slice(low, high - low)
                    rows = measure(part["text"].to_pylist(), common)
                    arrays = [pa.array(rows[:, 0].astype(np.int64))] + [pa.array(c) for c in rows[:, 1:].T]
                    yield pa.RecordBatch.from_arrays([part["doc_id"], *arrays], names)

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.filter(F.col("text").rlike(r"\S")).mapInArrow(run, _STATS)


def vote(name: str) -> Column:
    """The vote of a labelling function: a type's number, or -1 if it abstains."""
    column = F.lit(-1)
    for condition, kind in reversed(dict(LABELLERS)[name]):
        column = F.when(F.expr(condition), kind).otherwise(column)
    return column.cast("int")


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """The posterior of each type for each pattern of votes, by expectation-maximization.

    Nothing but the agreements of the labelling functions is known. Each function has a table of how it votes on texts of
    each type, learnt together with the share of each type; the majority of votes is where it begins. Abstaining tells
    nothing. A function is assumed to be right more often than a random vote, which is what the prior counts say.
    """
    kinds = len(TYPES)
    cast = np.stack([(patterns == k) for k in range(kinds)], axis=2).astype(float)  # pattern, function, vote
    start = cast.sum(axis=1) + 0.1
    posterior = start / start.sum(axis=1, keepdims=True)
    prior = np.where(np.eye(kinds, dtype=bool), 2.0, 0.5)
    for _ in range(rounds):
        weight = posterior * counts[:, None]
        share = (weight.sum(axis=0) + 1) / (weight.sum() + kinds)
        table = np.einsum("pt,pfv->ftv", weight, cast) + prior
        table /= table.sum(axis=2, keepdims=True)
        log = np.log(share) + np.einsum("pfv,ftv->pt", cast, np.log(table))
        log -= log.max(axis=1, keepdims=True)
        new = np.exp(log)
        new /= new.sum(axis=1, keepdims=True)
        done = np.abs(new - posterior).max() < tolerance
        posterior = new
        if done:
            break
    return posterior


def text_types(statistics: DataFrame) -> DataFrame:
    """The statistics with p_prose, p_listing and p_junk, the posterior of each text type, and ``text_type``, the likeliest.

    Thresholds on the statistics are noisy labelling functions. Documents are counted by their votes; there are no more
    than 4 ** 7 patterns of votes, whatever the number of documents, so the model is fitted to these counts of all
    documents and its posteriors are joined back by a broadcast of that bounded size. An empty table gives no rows.
    """
    spark = statistics.sparkSession
    names = [name for name, _ in LABELLERS]
    voted = statistics
    for name in names:
        voted = voted.withColumn(f"vote_{name}", vote(name))
    votes = [f"vote_{name}" for name in names]
    rows = voted.groupBy(*votes).agg(F.count(F.lit(1)).alias("n")).collect()
    patterns = np.array([[r[v] for v in votes] for r in rows], int).reshape(len(rows), len(votes))
    posterior = fit(patterns, np.array([r.n for r in rows], float)) if rows else np.zeros((0, len(TYPES)))
    model = [(*map(int, p), *map(float, q), TYPES[int(q.argmax())]) for p, q in zip(patterns, posterior)]
    schema = ", ".join([f"{v} int" for v in votes] + [f"p_{k} double" for k in TYPES] + ["text_type string"])
    return voted.join(F.broadcast(spark.createDataFrame(model, schema)), votes).drop(*votes)


def typed_documents(df: DataFrame, common_words: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``text_types`` of the statistics of ``df``, which are computed once and kept in a table."""
    return text_types(stage(quality_statistics(df, common_words, doc_id, text), "quality"))
