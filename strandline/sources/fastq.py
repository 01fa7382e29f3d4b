"""FASTQ files through a Python data source with byte ranges as partitions.

The marker of a FASTQ record may also begin a quality line, so no separator splits these files safely. What is safe is a
*proven* header: a line that begins with ``@``, then one that doesn't begin with a marker, then one that begins with
``+``, then one as long as the second, then the end of the file, a blank line or another ``@``; and none of the three lines
before it is like that. Whether a line is proven follows from eight lines alone, so every reader of any byte range agrees on it. The proven headers cut a file into
segments; a segment belongs to the range in which its header lies, and whoever reads it reads it to its end, be that
beyond the range. So all ranges together read every line once, whatever their size, and give the same records or the
same error. A file whose first record isn't proven (its records span more lines) is read whole by its first range.
"""

from __future__ import annotations

import fnmatch
import gzip
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from strandline.runtime import numbered

MODES = ("FAILFAST", "DROPMALFORMED", "PERMISSIVE")
PACKED = (".gz", ".gzip")
_SCHEMA = "header string, sequence string, quality string"
_ROWS = 8192

#: Bytes that are searched for lines at once.
BLOCK = 16 << 20

_NEWLINE, _RETURN, _AT, _PLUS = b"\n\r@+"


class MalformedRecord(ValueError):
    """A record that isn't valid FASTQ."""


@dataclass
class ByteRange(InputPartition):
    """Part of a file; ``whole`` ones are wrapped or packed files that can't be cut."""

    path: str
    start: int
    end: int
    whole: bool


def _strip(line: bytes) -> bytes:
    return line.translate(None, b" \t\r\n")


def parse_records(lines: Iterator[bytes], mode: str = "FAILFAST") -> Iterator[tuple[bytes, bytes, bytes]]:
    """Records of complete lines: sequence lines up to the one that begins with ``+``, then quality lines until they are
    as long as the sequence. White space inside both and before the marker is dropped, blank lines between records are
    skipped."""
    for line in lines:
        header = line.rstrip(b"\r\n").lstrip()
        if not header:
            continue
        try:
            if not header.startswith(b"@"):
                raise MalformedRecord(f"FASTQ header must start with '@', found {header[:40]!r}")
            bases, separator = [], None
            for part in lines:
                if part.startswith(b"+"):
                    separator = part
                    break
                bases.append(_strip(part))
            if separator is None:
                raise MalformedRecord(f"no '+' line after {header[:40]!r}")
            sequence, quality = b"".join(bases), b""
            for part in lines:
                quality += _strip(part)
                if len(quality) >= len(sequence):
                    break
            if len(quality) != len(sequence):
                raise MalformedRecord(f"{header[:40]!r} has {len(sequence)} bases and {len(quality)} scores")
        except MalformedRecord:
            if mode == "FAILFAST":
                raise
            if mode == "PERMISSIVE":
                yield header, None, None
            continue
        yield header, sequence, quality


@dataclass
class _Lines:
    """The lines of a stretch of bytes: where each begins and ends (line end left out), and its first byte."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    next: np.ndarray

    @classmethod
    def of(cls, data: bytes, last: bool) -> _Lines:
        """All complete lines; at the end of a file an unfinished line counts, too."""
        text = np.frombuffer(data, np.uint8)
        stop = np.flatnonzero(text == _NEWLINE)
        after = stop + 1
        if last and len(text) and (not len(stop) or after[-1] < len(text)):
            stop, after = np.append(stop, len(text)), np.append(after, len(text))
        begin = np.concatenate(([0], after[:-1])).astype(np.int64) if len(stop) else np.zeros(0, np.int64)
        back = text[np.maximum(stop - 1, 0)] == _RETURN if len(stop) else np.zeros(0, bool)
        return cls(text, begin, stop - (back & (stop > begin)), after)

    def proven(self, last: bool) -> np.ndarray:
        """Numbers of the proven headers, among the lines that four more, or the file's last ones, follow. Of the first three
        lines it can't be told unless they are a file's."""
        n = len(self.begin)
        size = self.end - self.begin
        mark = np.where(size > 0, self.data[np.minimum(self.begin, max(len(self.data) - 1, 0))], 0) if n else np.zeros(0, np.uint8)
        able = n - 3 if last else n - 4
        if able <= 0:
            return np.zeros(0, np.int64)
        follow = np.concatenate((mark, np.zeros(4, mark.dtype)))[4 : 4 + able]
        ok = (mark[:able] == _AT) & (mark[2 : 2 + able] == _PLUS) & (size[1 : 1 + able] == size[3 : 3 + able])
        ok &= (mark[1 : 1 + able] != _AT) & (mark[1 : 1 + able] != _PLUS) & ((follow == _AT) | (follow == 0))
        like = np.flatnonzero(ok)
        return like[np.diff(like, prepend=-4) > 3]

    def texts(self, which: np.ndarray) -> pa.Array:
        """Some lines as an Arrow array."""
        # One array in which every line lies between two gaps, the line ends; taking every second element copies the lines.
        edges = np.stack((self.begin[which], self.end[which]), axis=1).reshape(-1).astype(np.int64)
        if not len(edges):
            return pa.array([], pa.large_binary())
        both = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(self.data)])
        return both.take(pa.array(np.arange(0, len(edges), 2)))

    def raw(self, low: int, high: int) -> list[bytes]:
        """Lines low to high as they stand, with their line ends."""
        return [self.data[self.begin[i] : self.next[i]].tobytes() for i in range(low, high)]


def _blank_free(column: pa.Array) -> bool:
    _, _, data = column.buffers()
    text = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return not ((text == 32) | (text == 9) | (text == _RETURN)).any()


def _four_line_batch(lines: _Lines, heads: np.ndarray, mode: str) -> Iterator[pa.RecordBatch]:
    """Batches of records that stand in four lines each."""
    if not len(heads):
        return
    columns = [lines.texts(heads), lines.texts(heads + 1), lines.texts(heads + 3)]
    if _blank_free(columns[1]) and _blank_free(columns[2]):
        columns = [c.cast(pa.large_string()).cast(pa.string()) for c in columns]
        columns[0] = pc.ascii_rtrim(columns[0], "\r\n")
        yield pa.RecordBatch.from_arrays(columns, ["header", "sequence", "quality"])
        return
    # Blanks within lines are rare: they are dropped line by line, and the lengths compared again.
    yield from _batches(parse_records((x for h in heads.tolist() for x in lines.raw(h, h + 4)), mode))


def _batches(records: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    rows = []
    for record in records:
        rows.append(record)
        if len(rows) == _ROWS:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    arrays = [pa.array(x, pa.binary()).cast(pa.string()) for x in zip(*rows)]
    return pa.RecordBatch.from_arrays(arrays, ["header", "sequence", "quality"])


def read_range(stream, start: int, end: int, mode: str = "FAILFAST", block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The records of the segments whose header begins in [start, end), and of what stands before a file's first one."""
    base = _three_lines_before(stream, start)
    stream.seek(base)
    held, loose, open_, last, done = b"", [], start == 0, False, 0
    while not last:
        more = stream.read(block)
        last, data = len(more) < block, held + more
        lines = _Lines.of(data, last)
        done = max(done, int(np.searchsorted(lines.begin, start - base)))  # lines that are there for those after them
        heads = lines.proven(last)
        heads = heads[heads >= done]
        upto = len(lines.begin) if last else max(len(lines.begin) - 4, done)
        if len(heads):
            upto = max(upto, int(heads[-1]) + 4)
        first = done
        if not open_:
            first, open_ = (int(heads[0]), True) if len(heads) else (upto, False)
            if open_ and lines.begin[first] + base >= end:
                return
        beyond = np.flatnonzero(lines.begin[heads] + base >= end)
        stop = int(heads[beyond[0]]) if len(beyond) else upto
        heads = heads[: beyond[0]] if len(beyond) else heads
        if open_:
            sent = 0
            inner = np.ones(max(stop - first, 0), bool)
            for j in range(4):
                inner[heads + j - first] = False
            for i in (np.flatnonzero(inner) + first).tolist():  # lines of no proven record
                if not loose and lines.begin[i] == lines.end[i]:
                    continue
                ready = int(np.searchsorted(heads, i))
                if ready > sent:
                    yield from _loose(loose, mode)
                    yield from _four_line_batch(lines, heads[sent:ready], mode)
                    sent = ready
                loose += lines.raw(i, i + 1)
            if len(heads) > sent:
                yield from _loose(loose, mode)
                yield from _four_line_batch(lines, heads[sent:], mode)
        if len(beyond):
            break
        kept = max(upto - 3, 0)
        cut = int(lines.next[kept - 1]) if kept else 0
        held, base, done = data[cut:], base + cut, upto - kept
    yield from _loose(loose, mode)


def _three_lines_before(stream, start: int) -> int:
    """Where the third line before the one that begins at or after ``start`` begins, or an earlier one."""
    back = 1024
    while back < start:
        stream.seek(start - back)
        data = stream.read(back)
        if data.count(b"\n") >= 5:
            return start - back + data.index(b"\n") + 1
        back *= 4
    return 0


def _loose(lines: list[bytes], mode: str) -> Iterator[pa.RecordBatch]:
    """Records of the lines between proven ones: blank lines, wrapped records, or an error. Empties the list."""
    found = [x for x in lines] if any(x.strip() for x in lines) else []
    lines.clear()
    return _batches(parse_records(iter(found), mode))


def _is_wrapped(stream) -> bool:
    """Whether the first record of a file is valid, but isn't proven to stand in four lines, and holds no proven header."""
    stream.seek(0)
    data = b""
    while True:
        more = stream.read(1 << 16)
        data += more
        body = data.lstrip()
        lines = _Lines.of(body, not more)
        heads = lines.proven(not more)
        if not body or (heads[:1] == 0).any():
            return False
        if len(lines.begin) >= 5 or not more:
            rest = iter(lines.raw(0, len(lines.begin)))
            try:
                next(parse_records(rest))
                return not len(heads) or len(lines.begin) - len(list(rest)) <= heads[0]
            except MalformedRecord:
                if not more or len(data) > 1 << 20:
                    return False


class FastqReader(DataSourceReader):
    """Plans byte ranges in order of path and yields Arrow batches."""

    def __init__(self, options: dict):
        self.paths = options["path"].split(",")
        self.mode = options.get("mode", "FAILFAST").upper()
        self.split = int(options.get("splitbytes", options.get("splitBytes", str(64 << 20))))
        self.wrapped = str(options.get("wrapped", "false")).lower() == "true"
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")

    def partitions(self) -> list[ByteRange]:
        return self.ranges(sorted(self.files(), key=lambda x: x[1].path)) or [ByteRange("", 0, 0, True)]

    def files(self) -> list[tuple[str, fs.FileInfo]]:
        """(given path, file) of all files there are: files, folders with what lies in them, and globs."""
        out = []
        for given in self.paths:
            system, path = resolve(given)
            pattern = path if any(c in path for c in "*?[") else None
            if pattern:
                parts = pattern.split("/")
                path = "/".join(parts[: next(i for i, x in enumerate(parts) if any(c in x for c in "*?["))])
            info = system.get_file_info(path)
            found = [info]
            if info.type == fs.FileType.Directory:
                inside = system.get_file_info(fs.FileSelector(path, recursive=True))
                found = [x for x in inside if x.type == fs.FileType.File and not _hidden(x.path[len(path) :])]
            elif info.type == fs.FileType.NotFound:
                raise FileNotFoundError(given)
            out += [(given, x) for x in found if not pattern or fnmatch.fnmatch(x.path, pattern)]
        return out

    def ranges(self, files: list[tuple[str, fs.FileInfo]]) -> list[ByteRange]:
        """Byte ranges of files, in their order."""
        out = []
        for given, x in files:
            whole = self.wrapped or x.path.endswith(PACKED)
            step = max(1, x.size if whole else self.split)
            out += [ByteRange(_address(given, x.path), a, min(a + step, x.size), whole) for a in range(0, x.size, step)]
        return out

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, path = resolve(partition.path)
        with system.open_input_file(path) as raw:
            stream = io.BufferedReader(raw, 1 << 20)
            if path.endswith(PACKED):
                stream = gzip.open(stream)
            if self.wrapped or _is_wrapped(stream):
                if partition.start == 0:
                    stream.seek(0)
                    yield from _batches(parse_records(iter(stream), self.mode))
                return
            end = 1 << 62 if path.endswith(PACKED) else partition.end
            yield from read_range(stream, partition.start, end, self.mode)


def _hidden(path: str) -> bool:
    return any(x.startswith(("_", ".")) for x in path.split("/") if x)


class FastqStreamReader(FastqReader, DataSourceStreamReader):
    """The files of a folder in order of arrival (time of change, then path); a file must be complete when it appears."""

    def _arrived(self) -> list[tuple[int, str, tuple]]:
        return sorted((x.mtime_ns, x.path, (given, x)) for given, x in self.files())

    def initialOffset(self) -> dict:  # noqa: N802  a name of the interface
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        found = self._arrived()
        return {"time": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return self.ranges([x for time, path, x in self._arrived() if low < (time, path) <= high])

    def commit(self, end: dict) -> None:
        """Nothing is kept, so nothing is to be released."""


def resolve(address: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address and the path in it."""
    if "://" in address or address.startswith("file:"):
        return fs.FileSystem.from_uri(address.replace("file:/", "file:///") if address.count("/") and "://" not in address else address)
    return fs.LocalFileSystem(), address


def _address(given: str, path: str) -> str:
    return f"{given.split('://')[0]}://{path}" if "://" in given else path


class FastqDataSource(DataSource):
    """``spark.read.format("fastq")`` and ``spark.readStream.format("fastq")`` after ``spark.dataSource.register(FastqDataSource)``.

    Options: ``mode`` (FAILFAST, DROPMALFORMED, PERMISSIVE: header kept, the rest null), ``splitBytes``, and ``wrapped``,
    which reads every file whole; without it that is done for the files whose first record spans more than four lines.
    """

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options)

    def streamReader(self, schema) -> FastqStreamReader:  # noqa: N802
        return FastqStreamReader(self.options)


def read_fastq(spark: SparkSession, path: str | list[str], mode: str = "FAILFAST", wrapped: bool = False, split_bytes: int = 64 << 20) -> DataFrame:
    """Reads (idx, header, sequence, quality) of FASTQ files or folders, numbered in order of path and place.

    Partitions are planned in that order, so numbering needs no sort. The rows are written once as Parquet.
    """
    spark.dataSource.register(FastqDataSource)
    paths = path if isinstance(path, str) else ",".join(path)
    rows = spark.read.format("fastq").options(mode=mode, wrapped=str(wrapped).lower(), splitBytes=str(split_bytes)).load(paths)
    return numbered(rows, "idx", "fastq").select("idx", "header", "sequence", "quality")
