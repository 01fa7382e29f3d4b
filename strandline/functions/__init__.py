"""Column functions over sequences and quality strings, all JVM-side but for the Arrow ones of ``scores``."""

from strandline.functions.bases import (
    dna_to_rna,
    gc_count,
    n_count,
    n_fraction,
    read_length,
    reverse_complement,
    reverse_quality,
    strip_whitespace,
)
from strandline.functions.scores import mean_quality, phred_sum, phred_to_ascii, quality_ends, score_of, trim_bounds

__all__ = [
    "dna_to_rna",
    "gc_count",
    "mean_quality",
    "n_count",
    "n_fraction",
    "phred_sum",
    "phred_to_ascii",
    "quality_ends",
    "read_length",
    "reverse_complement",
    "reverse_quality",
    "score_of",
    "strip_whitespace",
    "trim_bounds",
]
