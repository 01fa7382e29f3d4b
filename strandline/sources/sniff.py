"""Which format a file has."""

from __future__ import annotations

import gzip

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from strandline.sources.fastq import PACKED, FastqReader, resolve

_HEAD = 8192
_BLANK = b" \t\r\n\x0b\x0c"


def sniff(head: bytes) -> str:
    """fasta or fastq, by the first byte that isn't white space."""
    body = head.lstrip(_BLANK)
    if not body:
        raise ValueError("Empty or whitespace-only file")
    if body[:1] in (b">", b"@"):
        return "fasta" if body[:1] == b">" else "fastq"
    raise ValueError(f"Unknown format: expected '@' or '>', found {body[:1].decode('latin-1')!r}")


def head_of(stream) -> bytes:
    """The first bytes of a stream from the first that isn't white space on, however much of that there is."""
    while block := stream.read(_HEAD):
        if body := block.lstrip(_BLANK):
            return body
    return b""


def detect_format(spark: SparkSession, path: str) -> str:
    """The format of the first file of a path. Gzip is looked into; some bytes of one file are read, on the driver."""
    files = sorted(FastqReader({"path": path}).files(), key=lambda x: x[1].path)
    if not files:
        raise ValueError("Empty or whitespace-only file")
    given, first = files[0]
    with resolve(given)[0].open_input_file(first.path) as raw:
        return sniff(head_of(gzip.open(raw) if first.path.endswith(PACKED) else raw))


def detect_format_column(header: Column) -> Column:
    """The same for a column of headers; null where it is neither."""
    first = F.substring(F.ltrim(header), 1, 1)
    return F.when(first == ">", "fasta").when(first == "@", "fastq")
