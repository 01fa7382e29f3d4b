"""FASTA and FASTQ files as reads, and back."""

from strandline.sources.fasta import read_fasta
from strandline.sources.fastq import FastqDataSource, read_fastq
from strandline.sources.sniff import detect_format, detect_format_column, sniff
from strandline.sources.writer import record_text, write_reads


def read_reads(spark, path, format="auto", **options):  # noqa: A002
    """Reads from a path of either format; ``auto`` looks at the first byte that isn't white space."""
    kind = detect_format(spark, path) if format == "auto" else format
    if kind == "fasta":
        return read_fasta(spark, path, **options)
    if kind == "fastq":
        return read_fastq(spark, path, **options)
    raise ValueError(f"format must be auto, fasta or fastq, not {format!r}")


__all__ = [
    "FastqDataSource",
    "detect_format",
    "detect_format_column",
    "read_fasta",
    "read_fastq",
    "read_reads",
    "record_text",
    "sniff",
    "write_reads",
]
