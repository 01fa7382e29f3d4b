"""Queries for streams and the command line: a table goes through files or a stream, and the result is a table again."""

from __future__ import annotations

import contextlib
import hashlib
import io
import sys
from collections.abc import Callable
from pathlib import Path
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import cli, streaming
from strandline import operators as ops
from strandline.plans.queries import (
    SAMPLE_SEED,
    SAMPLED_SQL,
    TRIM_SQL,
    _query,
    histogram_sql,
    stats_sql,
)
from strandline.plans.reads import ALL_FASTQ_SQL, BASES_SQL, FASTA_SQL, FASTQ_SQL, all_fastq, fasta, fastq, fastq_bases
from strandline.runtime import freed_shuffles, new_path, remove
from strandline.sources import write_reads


def _streamed(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """A table as a stream of the files it is written to."""
    path = new_path(spark, "stream")
    rows.repartition(4).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(path)


def _appended(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """What a stream in append mode has written when everything there is has been read."""
    path = new_path(spark, "appended")
    write = stream.writeStream.format("parquet").option("checkpointLocation", new_path(spark, "progress"))
    write.trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _completed(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """The last state of a stream in complete mode."""
    path = new_path(spark, "completed")
    write = stream.writeStream.outputMode("complete").option("checkpointLocation", new_path(spark, "progress"))
    query = write.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _by_batch(spark: SparkSession, start: Callable) -> DataFrame:
    """What a query that works by micro-batch has written; ``start`` takes a sink and the place of its progress."""
    path = new_path(spark, "batches")
    start(lambda batch, epoch: batch.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(path), new_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(path)


@_query(f"SELECT idx, header, sequence, quality FROM ({TRIM_SQL}) WHERE strlen(sequence) >= 60")
def stream_trim_filter(spark, sf_dir):
    """Reads trimmed and filtered as a stream."""
    stream = _streamed(spark, fastq(spark, sf_dir)).transform(ops.trim_reads, 30).transform(ops.filter_reads, None, 60)
    return _appended(spark, stream)


@_query(f"SELECT DISTINCT regexp_replace(sequence, '[ \\t\\r\\n]', '', 'g') AS sequence FROM {FASTQ_SQL}")
def stream_dedup(spark, sf_dir):
    """The different sequences of FASTQ files that are read as a stream."""
    path = new_path(spark, "fastq-text")
    write_reads(fastq(spark, sf_dir), path)
    return _appended(spark, streaming.dedup_stream(streaming.read_fastq_stream(spark, path)).select("sequence"))


@_query(f"SELECT coalesce(sequence, '') AS sequence, count(*) AS n FROM {FASTA_SQL} GROUP BY 1")
def stream_fasta(spark, sf_dir):
    """FASTA files read as a stream, and counted."""
    path = new_path(spark, "fasta-text")
    write_reads(fasta(spark, sf_dir).withColumn("header", F.concat(F.lit(">"), F.col("idx"))), path)
    return _completed(spark, streaming.read_fasta_stream(spark, path).groupBy("sequence").agg(F.count(F.lit(1)).alias("n")))


@_query(stats_sql(BASES_SQL))
def stream_stats(spark, sf_dir):
    """Running statistics of the FASTQ records."""
    return _completed(spark, streaming.stats_stream(_streamed(spark, fastq_bases(spark, sf_dir))))


@_query(histogram_sql(BASES_SQL, "12"))
def stream_length_histogram(spark, sf_dir):
    """The length histogram of the FASTQ records as a stream, with bins of 12."""
    return _completed(spark, streaming.length_histogram_stream(_streamed(spark, fastq_bases(spark, sf_dir)), 12))


@_query(SAMPLED_SQL)
def stream_reservoir(spark, sf_dir):
    """A seeded reservoir sample of 1,000 reads as a stream."""
    return _completed(spark, streaming.reservoir_stream(_streamed(spark, all_fastq(spark, sf_dir)), 1000, SAMPLE_SEED))


@_query(f"SELECT idx, row_number() OVER (ORDER BY strlen(sequence) NULLS FIRST, idx) - 1 AS rank, CAST(0 AS INTEGER) AS epoch FROM {BASES_SQL}")
def stream_sort(spark, sf_dir):
    """The reads of a micro-batch in order of length."""
    return _by_batch(spark, lambda sink, progress: streaming.each_batch(_all_at_once(spark, sf_dir), lambda b: ops.ranks(b, "length"), sink, progress))


def _all_at_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "stream")
    fastq_bases(spark, sf_dir).write.parquet(path)
    return spark.readStream.schema("idx long, header string, sequence string, quality string").parquet(path)


@_query(f"SELECT idx, header, sequence, quality, CAST(0 AS INTEGER) AS epoch FROM {BASES_SQL}")
def stream_interleave(spark, sf_dir):
    """The even and the odd reads as two streams, zipped."""
    even, odd = (_all_at_once(spark, sf_dir).filter(F.col("idx") % 2 == side) for side in (0, 1))
    return _by_batch(spark, lambda sink, progress: streaming.interleave_stream(even, odd, sink, progress))


@_query(f"SELECT idx // 2 AS idx, header, CAST(idx % 2 + 1 AS INTEGER) AS mate, CAST(0 AS INTEGER) AS epoch FROM {BASES_SQL}")
def stream_deinterleave(spark, sf_dir):
    """A stream of reads parted into mates."""

    def start(sink, progress):
        both = lambda a, b: a.withColumn("mate", F.lit(1)).unionByName(b.withColumn("mate", F.lit(2)))
        parted = lambda a, b, epoch: sink(both(a, b).select("idx", "header", "mate"), epoch)
        return streaming.deinterleave_stream(_all_at_once(spark, sf_dir), parted, progress)

    return _by_batch(spark, start)


class _Hashed(io.RawIOBase):
    """A file of which only the hash is kept."""

    def __init__(self):
        self.md5 = hashlib.md5()

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.md5.update(data)
        return len(data)


def _run(spark: SparkSession, argv: list[str], stdin: BinaryIO | None = None) -> tuple[int, str, str]:
    """(exit code, hash of the output, errors) of a command. Its output is as large as its input, so it isn't kept."""
    hashed, err, before = _Hashed(), io.StringIO(), sys.stdin
    out = io.TextIOWrapper(io.BufferedWriter(hashed), encoding="utf-8")
    with contextlib.redirect_stdout(out), contextlib.redirect_stderr(err):
        try:
            if stdin is not None:
                sys.stdin = io.TextIOWrapper(stdin)
            code = cli.run(spark, argv)
        finally:
            sys.stdin = before
    out.flush()
    return code, hashed.md5.hexdigest(), err.getvalue()


_FA = f"(SELECT idx, concat('>r', idx) AS header, coalesce(sequence, '') AS sequence FROM {FASTA_SQL})"
_FQ = f"(SELECT idx, concat('@r', idx) AS header, sequence, quality FROM {FASTQ_SQL})"
_FA_LINES = "string_agg(concat(header, chr(10), sequence, chr(10)), '' ORDER BY {order})"
_FQ_LINES = "string_agg(concat(header, chr(10), sequence, chr(10), '+', chr(10), quality, chr(10)), '' ORDER BY idx)"
_ONCE = "SELECT *, min(idx) OVER (PARTITION BY sequence) AS f"


@_query(
    f"SELECT 'dedup' AS tool, md5({_FA_LINES.format(order='idx')}) AS hash FROM ({_ONCE} FROM {_FA}) WHERE idx = f UNION ALL "
    f"SELECT 'sort', md5({_FA_LINES.format(order='strlen(sequence) DESC, idx')}) FROM {_FA} UNION ALL "
    f"SELECT 'dna2rna', md5({_FA_LINES.format(order='idx')}) FROM (SELECT idx, header, translate(sequence, 'Tt', 'Uu') AS sequence FROM {_FA}) UNION ALL "
    f"SELECT 'to-fasta', md5({_FA_LINES.format(order='idx')}) FROM (SELECT idx, concat('>', substring(header, 2)) AS header, sequence FROM {_FQ}) UNION ALL "
    f"SELECT 'filter', md5({_FQ_LINES}) FROM {_FQ} WHERE strlen(sequence) BETWEEN 90 AND 150 UNION ALL "
    f"SELECT 'trim', md5({_FQ_LINES}) FROM (SELECT idx, header, substring(sequence, 6) AS sequence, substring(quality, 6) AS quality FROM {_FQ}) UNION ALL "
    f"SELECT 'interleave', md5(string_agg(l || l, '' ORDER BY idx)) FROM (SELECT idx, concat(header, chr(10), sequence, chr(10), '+', chr(10), quality, "
    f"chr(10)) AS l FROM {_FQ}) UNION ALL "
    f"SELECT 'deinterleave', md5({_FQ_LINES}) FROM (SELECT *, row_number() OVER (ORDER BY idx) AS n FROM {_FQ}) WHERE n % 2 = 0 UNION ALL "
    f"SELECT 'standard input', md5({_FA_LINES.format(order='idx')}) FROM ({_ONCE} FROM {_FA}) WHERE idx = f"
)
def command_line(spark, sf_dir):
    """Tools of the command line on files of all records, as the hash of each one's output."""
    staged = [new_path(spark, x) for x in ("fa", "fq", "out1", "out2")]
    fa, fq, one, two = (x.removeprefix("file://") for x in staged)
    commands = {
        "dedup": ["dedup", fa],
        "sort": ["sort", fa, "-l", "-r"],
        "dna2rna": ["dna2rna", fa],
        "to-fasta": ["to-fasta", fq],
        "filter": ["filter", fq, "-l", "90", "-L", "150"],
        "trim": ["trim", fq, "-f", "5"],
        "interleave": ["interleave", fq, fq],
        "deinterleave": ["deinterleave", fq, "-1", one, "-2", two],
        "standard input": ["dedup"],
    }
    hashes = {}
    # One format after the other, so that only one's files take up disk.
    for path, df, mark in ((staged[0], fasta(spark, sf_dir), ">"), (staged[1], fastq(spark, sf_dir), "@")):
        with freed_shuffles(spark):
            write_reads(df.withColumn("header", F.concat(F.lit(mark), F.lit("r"), F.col("idx"))), path, single=True)
        for tool, argv in commands.items():
            if path.removeprefix("file://") in argv:
                _, hashes[tool], _ = _run(spark, argv)
            elif tool == "standard input" and mark == ">":
                (part,) = Path(fa).glob("part-*")
                with part.open("rb") as text:
                    _, hashes[tool], _ = _run(spark, argv, text)
        remove(spark, path)
    with Path(two).open("rb") as text:
        hashes["deinterleave"] = hashlib.file_digest(text, "md5").hexdigest()
    for path in staged[2:]:
        remove(spark, path)
    return spark.createDataFrame([(tool, hashes[tool]) for tool in commands], "tool string, hash string")


_ERRORS = {
    "no format": (["dedup"], b"ACGT\n", "Error: Unknown format: expected '@' or '>', found 'A'"),
    "nothing": (["sort"], b" \n", "Error: Empty or whitespace-only file"),
    "fraction": (["filter", "-n", "1.5"], b"@a\nA\n+\nI\n", "Error: max_n_fraction must be between 0 and 1, not 1.5"),
    "short quality": (["stats"], b"@a\nAC\n+\nI\n", "Error: b'@a' has 2 bases and 1 scores"),
    "fine": (["filter", "-q", "20"], b"@a\nA\n+\nI\n", ""),
}


@_query(" UNION ALL ".join(
    f"SELECT '{name}' AS name, CAST({int(bool(said))} AS BIGINT) AS code, '{said.replace(chr(39), chr(39) * 2)}' AS said" for name, (_, _, said) in _ERRORS.items()
))
def command_line_errors(spark, sf_dir):
    """Exit codes and messages of the command line."""
    rows = []
    for name, (argv, text, _) in _ERRORS.items():
        code, _, err = _run(spark, argv, io.BytesIO(text))
        rows.append((name, code, err.strip()))
    return spark.createDataFrame(rows, "name string, code long, said string")
