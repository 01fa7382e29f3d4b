"""Sequence analytics on Spark: FASTA and FASTQ reads as ordinary DataFrames."""

__version__ = "0.1.0"
