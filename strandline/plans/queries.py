"""The queries for the operators, and the SQL that gives the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import operators as ops
from strandline.functions import gc_count, mean_quality, n_count, n_fraction, phred_to_ascii, read_length, score_of
from strandline.plans.reads import ALL_FASTQ_SQL, BASES_SQL, FASTA_SQL, FASTQ_SQL, all_fastq, fasta, fastq, fastq_bases
from strandline.runtime import new_path
from strandline.sources import detect_format_column, read_fasta, read_fastq, write_reads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_SUM = "coalesce(list_sum(list_transform(string_split(quality, ''), lambda c: greatest(ascii(c) - 33, 0))), 0)"
_MEAN = f"CASE WHEN quality IS NULL THEN NULL WHEN quality = '' THEN CAST(0 AS FLOAT) ELSE CAST(CAST({_SUM} AS DOUBLE) / length(quality) AS FLOAT) END"
_N = "(length(sequence) - length(replace(upper(sequence), 'N', '')))"
_NFRAC = f"CASE WHEN length(sequence) > 0 THEN CAST(CAST({_N} AS DOUBLE) / length(sequence) AS FLOAT) END"
_ALL = "idx, header, sequence, quality"


def _first(source: str, columns: str) -> str:
    return (
        f"SELECT {columns} FROM (SELECT *, min(idx) OVER (PARTITION BY sequence) AS f FROM {source}) WHERE idx = f"
    )


@_query(_first(FASTA_SQL, "idx, header, sequence"))
def fasta_dedup(spark, sf_dir):
    """The first record of each sequence of the FASTA records."""
    return ops.dedup(fasta(spark, sf_dir))


@_query(_first(BASES_SQL, _ALL))
def fastq_dedup(spark, sf_dir):
    """The first record of each sequence of the FASTQ records."""
    return ops.dedup(fastq_bases(spark, sf_dir))


def _states(seed: int) -> str:
    return (
        f"WITH RECURSIVE g(n, s) AS (SELECT 0, {seed}::HUGEINT UNION ALL SELECT n + 1, (s * 6364136223846793005::HUGEINT + 1) "
        "% 18446744073709551616::HUGEINT FROM g WHERE n <= (SELECT max(idx) FROM fastq_reads))"
    )


SAMPLE_K, SAMPLE_F, SAMPLE_SEED = 1000, 0.1, 42


SAMPLED_SQL = (
    f"{_states(SAMPLE_SEED)}, t AS (SELECT idx, idx AS slot FROM fastq_reads WHERE idx < {SAMPLE_K} UNION ALL SELECT idx, "
    f"CAST(s % (idx + 1) AS BIGINT) FROM fastq_reads JOIN g ON n = idx - {SAMPLE_K - 1} WHERE idx >= {SAMPLE_K}), "
    f"w AS (SELECT slot, max(idx) AS idx FROM t WHERE slot < {SAMPLE_K} GROUP BY slot) "
    "SELECT w.slot, r.idx, header, sequence, quality FROM w JOIN fastq_reads r USING (idx)"
)


@_query(SAMPLED_SQL)
def sample_count(spark, sf_dir):
    """A seeded reservoir sample of 1,000 reads, with each read's slot."""
    return ops.sample_count(all_fastq(spark, sf_dir), SAMPLE_K, SAMPLE_SEED)


@_query(
    f"{_states(SAMPLE_SEED)} SELECT idx, header, sequence, quality FROM fastq_reads JOIN g ON n = idx + 1 "
    "WHERE s <= 1844674407370955161::HUGEINT + 0"
)
def sample_fraction(spark, sf_dir):
    """A seeded sample of a tenth of the reads."""
    return ops.sample_fraction(all_fastq(spark, sf_dir), SAMPLE_F, SAMPLE_SEED)


def _sorted(name: str, by: str, reverse: bool, source, sql: str, order: str) -> None:
    def query(spark, sf_dir):
        return ops.ranks(source(spark, sf_dir), by, reverse)

    query.__name__ = name
    query.__doc__ = f"The place of each record by {by}{', reversed' if reverse else ''}."
    _query(f"SELECT idx, row_number() OVER (ORDER BY {order}) - 1 AS rank FROM {sql}")(query)


_sorted("sort_name", "name", False, fasta, FASTA_SQL, "header NULLS FIRST, idx")
_sorted("sort_name_reverse", "name", True, fasta, FASTA_SQL, "header DESC NULLS LAST, idx DESC")
_sorted("sort_sequence", "sequence", False, fasta, FASTA_SQL, "sequence NULLS FIRST, idx")
_sorted("sort_sequence_reverse", "sequence", True, fasta, FASTA_SQL, "sequence DESC NULLS LAST, idx DESC")
_sorted("sort_length", "length", False, fastq_bases, BASES_SQL, "strlen(sequence) NULLS FIRST, idx")
_sorted("sort_length_reverse", "length", True, fastq_bases, BASES_SQL, "strlen(sequence) DESC NULLS LAST, idx")

_REVCOMP = "reverse(translate(sequence, 'ACGTacgtRYKMBVDH', 'TGCAtgcaYRMKVBHD'))"


@_query(f"SELECT idx, header, {_REVCOMP} AS sequence FROM {FASTA_SQL}")
def revcomp(spark, sf_dir):
    """The opposite strand of each FASTA record."""
    return ops.revcomp(fasta(spark, sf_dir))


@_query(f"SELECT idx, header, {_REVCOMP} AS sequence, reverse(quality) AS quality FROM {BASES_SQL}")
def revcomp_fastq(spark, sf_dir):
    """The opposite strand of each FASTQ record, with its quality."""
    return ops.revcomp(fastq_bases(spark, sf_dir))


@_query(f"SELECT idx, header, translate(sequence, 'Tt', 'Uu') AS sequence FROM {FASTA_SQL}")
def dna2rna(spark, sf_dir):
    """RNA of each FASTA record."""
    return ops.dna2rna(fasta(spark, sf_dir))


def _filtered(name: str, where: str, **limits) -> None:
    def query(spark, sf_dir):
        return ops.filter_reads(fastq_bases(spark, sf_dir), **limits)

    query.__name__ = name
    query.__doc__ = f"Reads within {limits}."
    _query(f"SELECT {_ALL} FROM {BASES_SQL} WHERE {where}")(query)


_filtered("filter_quality", f"{_MEAN} >= CAST(33.5 AS FLOAT)", min_quality=33.5)
_filtered("filter_length", "strlen(sequence) BETWEEN 90 AND 150", min_length=90, max_length=150)
_filtered("filter_n_fraction", f"coalesce({_NFRAC} <= CAST(0.01 AS FLOAT), true)", max_n_fraction=0.01)
_filtered(
    "filter_all",
    f"{_MEAN} >= CAST(30.1 AS FLOAT) AND strlen(sequence) BETWEEN 50 AND 200 AND coalesce({_NFRAC} <= CAST(0.02 AS FLOAT), true)",
    min_quality=30.1,
    min_length=50,
    max_length=200,
    max_n_fraction=0.02,
)


def _trim_sql(cutoff: int | None, front: int, tail: int, longest: int | None, shortest: int | None) -> str:
    low = "".join(chr(c) for c in range(33, 33 + (cutoff or 0))).replace("'", "''")
    s0 = f"length(sequence) - length(ltrim(quality, '{low}'))" if cutoff else "0"
    e0 = f"greatest({s0}, length(rtrim(quality, '{low}')))" if cutoff else "length(sequence)"
    last = "least(e1, length(sequence))" if longest is None else f"least(least(e1, length(sequence)), st + {longest})"
    return (
        f"WITH a AS (SELECT *, {s0} + {front} AS s1, {e0} AS e0 FROM {FASTQ_SQL}), "
        f"b AS (SELECT *, CASE WHEN e0 > {tail} THEN e0 - {tail} ELSE s1 END AS e1 FROM a), "
        "c AS (SELECT *, least(s1, e1, length(sequence)) AS st FROM b), "
        f"d AS (SELECT idx, header, substring(sequence, st + 1, {last} - st) AS sequence, substring(quality, st + 1, {last} - st) AS quality FROM c) "
        f"SELECT {_ALL} FROM d" + (f" WHERE length(sequence) >= {shortest}" if shortest is not None else "")
    )


def _trimmed(name: str, cutoff=None, front=0, tail=0, longest=None, shortest=None) -> None:
    def query(spark, sf_dir):
        return ops.trim_reads(fastq(spark, sf_dir), cutoff, front, tail, longest, shortest)

    query.__name__ = name
    query.__doc__ = f"Trimmed reads: cutoff {cutoff}, front {front}, tail {tail}, longest {longest}, shortest {shortest}."
    _query(_trim_sql(cutoff, front, tail, longest, shortest))(query)


TRIM_SQL = _trim_sql(30, 0, 0, None, None)
_trimmed("trim_quality", cutoff=30)
_trimmed("trim_fixed", front=5, tail=90)
_trimmed("trim_max_length", cutoff=20, longest=80)
_trimmed("trim_then_min_length", cutoff=32, front=3, tail=4, longest=120, shortest=70)


def stats_sql(source: str) -> str:
    return (
        f"WITH r AS (SELECT coalesce(strlen(sequence), 0) AS l, {_SUM} AS q, {_N} AS n, length(sequence) - "
        f"length(regexp_replace(sequence, '[GCgc]', '', 'g')) AS g FROM {source}), "
        "t AS (SELECT count(*) AS total_reads, CAST(coalesce(sum(l), 0) AS BIGINT) AS total_bases, coalesce(min(l), 0) AS min_length, "
        "coalesce(max(l), 0) AS max_length, CAST(sum(q) AS BIGINT) AS q, CAST(sum(g) AS BIGINT) AS g, CAST(sum(n) AS BIGINT) AS n FROM r) "
        "SELECT total_reads, total_bases, min_length, max_length, coalesce(total_bases::DOUBLE / nullif(total_reads, 0), 0) AS mean_length, "
        "coalesce(q::DOUBLE / nullif(total_bases, 0), 0) AS mean_quality, coalesce(g::DOUBLE * 100::DOUBLE / nullif(total_bases, 0), 0) AS "
        "gc_percentage, coalesce(n::DOUBLE * 100::DOUBLE / nullif(total_bases, 0), 0) AS n_percentage FROM t"
    )


@_query(stats_sql(BASES_SQL))
def stats(spark, sf_dir):
    """Summary statistics of the FASTQ records."""
    return ops.stats(fastq_bases(spark, sf_dir))


def histogram_sql(source: str, width: str) -> str:
    """The histogram of a relation; ``width`` is an expression over its lengths l."""
    return (
        f"WITH r AS (SELECT idx, coalesce(strlen(sequence), 0) AS l FROM {source}), b AS (SELECT {width} AS w FROM r LIMIT 1) "
        "SELECT CAST(least(l // w, 9) AS INTEGER) AS bin, CAST(least(l // w, 9) * w AS BIGINT) AS range_start, "
        "CAST((least(l // w, 9) + 1) * w AS BIGINT) AS range_end, count(*) AS reads FROM r, b GROUP BY 1, 2, 3"
    )


@_query(histogram_sql(BASES_SQL, "greatest(arg_min(l, idx) // 10, 1)"))
def length_histogram(spark, sf_dir):
    """The ten-bin length histogram of the FASTQ records."""
    return ops.length_histogram(fastq_bases(spark, sf_dir))


@_query(f"SELECT idx, concat('>', substring(header, 2)) AS header, sequence FROM {BASES_SQL}")
def to_fasta(spark, sf_dir):
    """FASTQ records as FASTA."""
    return ops.to_fasta(fastq_bases(spark, sf_dir))


@_query(
    f"SELECT idx, concat('>', substring(header, 2)) AS header, sequence FROM {BASES_SQL} WHERE {_MEAN} >= CAST(34 AS FLOAT)"
)
def to_fasta_min_quality(spark, sf_dir):
    """FASTQ records of a mean quality of 34 or more as FASTA."""
    return ops.to_fasta(fastq_bases(spark, sf_dir), 34)


@_query(f"SELECT {_ALL} FROM {ALL_FASTQ_SQL}")
def interleave(spark, sf_dir):
    """The two halves of the reads zipped again."""
    return ops.interleave(*ops.deinterleave(all_fastq(spark, sf_dir)))


@_query(f"SELECT idx // 2 AS idx, header, sequence, quality FROM {ALL_FASTQ_SQL} WHERE idx % 2 = 0")
def deinterleave_r1(spark, sf_dir):
    """The reads at even positions."""
    return ops.deinterleave(all_fastq(spark, sf_dir))[0]


@_query(f"SELECT idx // 2 AS idx, header, sequence, quality FROM {ALL_FASTQ_SQL} WHERE idx % 2 = 1")
def deinterleave_r2(spark, sf_dir):
    """The reads at odd positions."""
    return ops.deinterleave(all_fastq(spark, sf_dir))[1]


@_query(
    "SELECT 'fasta_reads' AS tbl, idx, CASE substring(header, 1, 1) WHEN '>' THEN 'fasta' WHEN '@' THEN 'fastq' END AS format FROM fasta_reads "
    "UNION ALL SELECT 'fastq_reads', idx, CASE substring(header, 1, 1) WHEN '>' THEN 'fasta' WHEN '@' THEN 'fastq' END FROM fastq_reads"
)
def detect_format(spark, sf_dir):
    """The format that each header's marker tells."""
    both = [(n, f(spark, sf_dir)) for n, f in (("fasta_reads", fasta), ("fastq_reads", all_fastq))]
    parts = [df.select(F.lit(n).alias("tbl"), "idx", detect_format_column(F.col("header")).alias("format")) for n, df in both]
    return parts[0].unionByName(parts[1])


@_query(f"SELECT idx, CAST({_MEAN} AS DOUBLE) AS mean_quality FROM {BASES_SQL}")
def mean_quality_per_read(spark, sf_dir):
    """The mean quality of each read."""
    return fastq_bases(spark, sf_dir).select("idx", mean_quality(F.col("quality")).cast("double").alias("mean_quality"))


@_query(
    f"SELECT idx, strlen(sequence) AS n_bases, CAST(length(sequence) - length(regexp_replace(sequence, '[GCgc]', '', 'g')) AS BIGINT) AS n_gc, "
    f"CAST({_N} AS BIGINT) AS n_n, CAST({_NFRAC} AS DOUBLE) AS n_fraction FROM {BASES_SQL}"
)
def gc_n_content(spark, sf_dir):
    """Bases, G and C, N and the share of N of each read."""
    s = F.col("sequence")
    return fastq_bases(spark, sf_dir).select(
        "idx",
        read_length(s).alias("n_bases"),
        gc_count(s).alias("n_gc"),
        n_count(s).alias("n_n"),
        n_fraction(s).cast("double").alias("n_fraction"),
    )


@_query(
    f"SELECT idx, greatest(ascii(substring(quality, 1, 1)) - 33, 0) AS score, chr(least(greatest(ascii(substring(quality, 1, 1)) - 33, 0) + 33, 126)) "
    f"AS mark FROM {FASTQ_SQL} WHERE quality <> ''"
)
def phred(spark, sf_dir):
    """The score of each read's first base, and the character of that score."""
    score = score_of(F.substring("quality", 1, 1))
    rows = fastq(spark, sf_dir).filter("quality != ''")
    return rows.select("idx", score.alias("score"), phred_to_ascii(score).alias("mark"))


@_query(
    f"SELECT idx, row_number() OVER (ORDER BY strlen(sequence) DESC NULLS LAST, idx) - 1 AS rank FROM ({_first(FASTA_SQL, '*')})"
)
def dedup_sort_reverse(spark, sf_dir):
    """Pipeline: deduplicate, then sort by length, longest first."""
    return fasta(spark, sf_dir).transform(ops.dedup).transform(ops.ranks, "length", True)


_FILTERED = f"(SELECT * FROM {BASES_SQL} WHERE {_MEAN} >= CAST(20 AS FLOAT) AND strlen(sequence) >= 40)"


@_query(stats_sql(_FILTERED))
def filter_stats(spark, sf_dir):
    """Pipeline: filter by quality and length, then sum up."""
    return fastq_bases(spark, sf_dir).transform(ops.filter_reads, 20, 40).transform(ops.stats)


@_query(stats_sql(f"(SELECT * FROM ({_trim_sql(25, 2, 2, 140, 50)}) WHERE {_MEAN} >= CAST(30 AS FLOAT))"))
def trim_filter_stats(spark, sf_dir):
    """Pipeline: trim, filter, sum up."""
    trimmed = fastq(spark, sf_dir).transform(ops.trim_reads, 25, 2, 2, 140, 50)
    return trimmed.transform(ops.filter_reads, 30).transform(ops.stats)


@_query(f"SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, header, sequence, quality FROM (SELECT idx, regexp_replace(header, '[\\r\\n]+$', '') AS header, sequence, quality FROM {FASTQ_SQL})")
def fastq_round_trip(spark, sf_dir):
    """FASTQ records written as text files and read again."""
    path = new_path(spark, "fastq-text")
    write_reads(fastq(spark, sf_dir), path)
    return read_fastq(spark, path)


def _wrapped(column: str) -> Column:
    return F.regexp_replace(column, "(.{20})(?=.)", "$1\n")


@_query(
    f"SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, header, sequence, quality FROM (SELECT idx, "
    f"regexp_replace(header, '[\\r\\n]+$', '') AS header, sequence, quality FROM {FASTQ_SQL})"
)
def fastq_wrapped_round_trip(spark, sf_dir):
    """FASTQ records written with lines of 20 bases and scores, and read again by ranges of 64,000 bytes."""
    path = new_path(spark, "fastq-wrapped")
    text = F.concat_ws("\n", "header", _wrapped("sequence"), F.lit("+"), _wrapped("quality"))
    fastq(spark, sf_dir).orderBy("idx").select(text.alias("value")).write.text(path)
    return read_fastq(spark, path, split_bytes=64_000)


_BARE = "CASE WHEN header LIKE '>%' THEN header ELSE concat('>', coalesce(header, '')) END"


@_query(f"SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, {_BARE} AS header, coalesce(sequence, '') AS sequence FROM {FASTA_SQL}")
def fasta_round_trip(spark, sf_dir):
    """FASTA records written as text files and read again; a record without a marker gets one."""
    path = new_path(spark, "fasta-text")
    bare = F.concat(F.lit(">"), F.coalesce("header", F.lit("")))
    rows = fasta(spark, sf_dir).withColumn("header", F.when(F.col("header").startswith(">"), F.col("header")).otherwise(bare))
    write_reads(rows, path)
    return read_fasta(spark, path)


_LONG = f"(SELECT row_number() OVER (ORDER BY idx) - 1 AS n, * FROM {BASES_SQL} WHERE strlen(sequence) >= 100)"


@_query(
    f"SELECT 2 * n AS idx, header, sequence, quality FROM {_LONG} UNION ALL "
    f"SELECT 2 * n + 1 AS idx, header, {_REVCOMP} AS sequence, reverse(quality) AS quality FROM {_LONG}"
)
def filter_interleave(spark, sf_dir):
    """Pipeline: filter by length, and zip what is left with its opposite strand; the ordinals of both sides have gaps."""
    kept = fastq_bases(spark, sf_dir).transform(ops.filter_reads, min_length=100)
    return ops.interleave(kept, ops.revcomp(kept))


_DISTINCT = f"(SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, header, sequence, quality FROM ({_first(BASES_SQL, _ALL)}))"


@_query(
    f"{_states(SAMPLE_SEED)}, d AS {_DISTINCT}, t AS (SELECT idx, idx AS slot FROM d WHERE idx < 100 UNION ALL SELECT idx, "
    "CAST(s % (idx + 1) AS BIGINT) FROM d JOIN g ON n = idx - 99 WHERE idx >= 100), "
    "w AS (SELECT slot, max(idx) AS idx FROM t WHERE slot < 100 GROUP BY slot) "
    "SELECT w.slot, d.idx, header, sequence, quality FROM w JOIN d USING (idx)"
)
def dedup_sample_count(spark, sf_dir):
    """Pipeline: deduplicate, then a seeded reservoir sample of 100 reads of what is left."""
    return fastq_bases(spark, sf_dir).transform(ops.dedup).transform(ops.sample_count, 100, SAMPLE_SEED)
