"""Problem 3: duplicates hidden by formatting differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.letters import letters
from strandline.runtime import join_groups, stage

#: Where a KEY=VALUE attribute of a FASTA header begins, and what may part it from the next one.
ATTRIBUTE, BETWEEN = "([A-Z]+=)", " ;|\t\r\n"

_MARK = "\x01"


def squashed(column: Column) -> Column:
    """A text without white space, punctuation and case."""
    return F.lower(F.regexp_replace(column, r"[^\p{L}\p{Nd}]+", ""))


def attributes(header: Column) -> Column:
    """The KEY=VALUE attributes of a FASTA header, in upper case, as an array in their order; blanks, bars or semicolons
    part them. A null header has none, and what stands before the first isn't one."""
    parts = F.split(F.regexp_replace(F.coalesce(header, F.lit("")), ATTRIBUTE, f"{_MARK}$1"), _MARK)
    return F.transform(F.slice(parts, 2, 1 << 20), lambda x: F.upper(F.rtrim(x, F.lit(BETWEEN))))


def multiset_hash(pairs: list[Column], salt: int = 0, arrays: list[Column] = ()) -> Column:
    """A 64-bit hash of (name, value) pairs that doesn't depend on their order, and counts repeated pairs.

    Each pair is hashed and the hashes are added. They are cut to 56 bits first, so 128 pairs can't overflow.
    """
    one = lambda *x: F.shiftright(F.xxhash64(F.lit(salt), *x), 8)
    parts = [one(x) for x in pairs]
    parts += [F.aggregate(x, F.lit(0).cast("long"), lambda a, v: (a + one(v)) % F.lit(2**60)) for x in arrays]
    return reduce(lambda a, b: a + b, parts)


def duplicate_groups(
    df: DataFrame, id_col: str, fields: dict[str, Column], more: tuple[Column, ...] = ()
) -> tuple[DataFrame, DataFrame, bool]:
    """(records, groups, exact): the light records, with ``more`` columns, and the groups of two or more of them with equal
    fields.

    Fingerprints are two multiset hashes over (field name, normalized value). The values travel once, to a hash
    aggregation on (fingerprint, values) that compares whole values without sorting and merges copies in the map
    tasks; after that only fingerprints do. Where one fingerprint stands for different values, which two 56-bit hashes
    all but rule out, ``exact`` is False and both tables carry the values, too.
    """
    named = [F.struct(F.lit(name), F.coalesce(value, F.lit(""))) for name, value in sorted(fields.items())]
    values = [value.alias(f"v{i}") for i, (_, value) in enumerate(sorted(fields.items()))]
    some = reduce(lambda a, b: a | b, [F.coalesce(v, F.lit("")) != "" for v in fields.values()])
    whole = df.filter(some).select(
        F.col(id_col).alias("id"), multiset_hash(named, 1).alias("f1"), multiset_hash(named, 2).alias("f2"), *more, *values
    )
    names = [f"v{i}" for i in range(len(values))]
    equal = whole.groupBy("f1", "f2", *names).agg(F.min("id").alias("idx_a"), F.count(F.lit(1)).alias("n"))
    light = equal.groupBy("f1", "f2").agg(
        F.min("idx_a").alias("idx_a"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")
    )
    groups = stage(light.filter("n > 1"), "format-groups")
    if groups.filter("kinds > 1").isEmpty():
        return whole.drop(*names), groups.drop("kinds"), True
    return whole, stage(equal.filter("n > 1"), "format-exact"), False


def copies(df: DataFrame, id_col: str, fields: dict[str, Column]) -> DataFrame:
    """Each record that equals an earlier one in all normalized fields: (idx_a, idx_b), idx_a the group's smallest id.

    Records whose fields are all null or empty belong to no group. Ties in the id can't be told apart: rows with one
    id count as one record with copies of itself left out. Groups may hold a third of all rows (see ``join_groups``).
    An empty table gives no rows. Other columns of the input are not read, so their names can't clash.
    """
    records, groups, exact = duplicate_groups(df, id_col, fields)
    keys = ["f1", "f2"] if exact else [c for c in groups.columns if c not in ("idx_a", "n")]
    out = join_groups(records, groups, keys, "n", df.count())
    return out.filter("id != idx_a").select("idx_a", F.col("id").alias("idx_b"))


def collapse(df: DataFrame, id_col: str, fields: dict[str, Column], header: Column | None = None) -> DataFrame:
    """One row for each record: (idx, n_copies, n_headers), idx the smallest id, n_copies the records it stands for.

    n_headers counts the different headers among them by multiset hashes of their attributes, 112 bits together, so the
    order of attributes makes no difference and nothing is estimated. Fingerprints are verified as in ``copies``; after
    that only fingerprints and header hashes are grouped, first together and then by fingerprint alone. Edge cases as in
    ``copies``.
    """
    heads = [multiset_hash([], i, [attributes(header)]) if header is not None else F.lit(0) for i in (3, 4)]
    more = tuple(h.alias(f"h{i}") for i, h in enumerate(heads))
    records, groups, exact = duplicate_groups(df, id_col, fields, more)
    keys = ["f1", "f2"] if exact else [c for c in groups.columns if c not in ("idx_a", "n")]
    one = records.groupBy(*keys, "h0", "h1").agg(F.min("id").alias("idx"), F.count(F.lit(1)).alias("n"))
    out = one.groupBy(*keys).agg(F.min("idx").alias("idx"), F.sum("n").alias("n_copies"), F.count(F.lit(1)).alias("n_headers"))
    return out.select("idx", "n_copies", "n_headers")


def sequence_fields(sequence: str = "sequence") -> dict[str, Column]:
    """The one field of FASTA records that TESTDATA compares: the letters."""
    return {"letters": letters(F.col(sequence))}
