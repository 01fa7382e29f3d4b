"""The relation that every operator works on, and checks of its arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Reads: ``idx`` is the ordinal in the file, ``header`` keeps its marker, ``quality`` is null for FASTA.
READS = T.StructType(
    [
        T.StructField("idx", T.LongType(), False),
        T.StructField("header", T.StringType(), False),
        T.StructField("sequence", T.StringType(), False),
        T.StructField("quality", T.StringType(), True),
    ]
)

FORMATS = ("fasta", "fastq")


def require(df: DataFrame, *columns: str) -> None:
    """Fail early, with the missing names, rather than in the middle of a plan."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def has_quality(df: DataFrame) -> bool:
    """Whether the relation has a quality column at all; its values may still be null for FASTA rows."""
    return "quality" in df.columns


def as_float(value: float) -> Column:
    """A threshold in single precision, in which scores are compared."""
    return F.lit(float(value)).cast("float")


def in_unit(name: str, value: float | None) -> None:
    """Check that a fraction lies in [0, 1]."""
    if value is not None and not 0 <= value <= 1:
        raise ValueError(f"{name} must be between 0 and 1, not {value}")
