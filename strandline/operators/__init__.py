"""Operators: each takes and gives DataFrames, and composes with ``df.transform``."""

from strandline.operators.convert import dna2rna, revcomp, to_fasta
from strandline.operators.dedup import dedup
from strandline.operators.filters import filter_reads
from strandline.operators.order import rank_reads, ranks, sort_reads
from strandline.operators.pairs import deinterleave, interleave
from strandline.operators.sampling import sample_count, sample_fraction
from strandline.operators.stats import format_report, length_histogram, stats
from strandline.operators.trim import trim_reads

__all__ = [
    "dedup",
    "deinterleave",
    "dna2rna",
    "filter_reads",
    "format_report",
    "interleave",
    "length_histogram",
    "rank_reads",
    "ranks",
    "revcomp",
    "sample_count",
    "sample_fraction",
    "sort_reads",
    "stats",
    "to_fasta",
    "trim_reads",
]
