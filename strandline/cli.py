"""``python -m strandline.cli TOOL ...``: the operators on files, one tool for each."""

from __future__ import annotations

import argparse
import codecs
import re
import shutil
import sys

from py4j.protocol import Py4JError
from pyarrow import fs
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import operators as ops
from strandline.runtime import freed_shuffles, new_path, remove, scope
from strandline.schema import has_quality
from strandline.sources import read_fastq, read_reads, sniff, write_reads
from strandline.sources.fastq import resolve
from strandline.sources.sniff import head_of

_TASK_ERROR = re.compile(r"^(?:.*(?:Error|Exception|MalformedRecord|RUNTIME_EXCEPTION\])):? (.+)$", re.MULTILINE)


def parser() -> argparse.ArgumentParser:
    """Options of all tools."""
    top = argparse.ArgumentParser(prog="strandline")
    tools = top.add_subparsers(dest="tool", required=True)

    def tool(name: str, *inputs: str, output: bool = True) -> argparse.ArgumentParser:
        one = tools.add_parser(name)
        for x in inputs:
            one.add_argument(x)
        if not inputs:
            one.add_argument("input", nargs="?", default="-", help="file or folder; standard input if left out or -")
        if output:
            one.add_argument("-o", "--output", help="output file; standard output if left out or -")
            one.add_argument("--parts", action="store_true", help="make the output a folder of part files")
        return one

    tool("dedup")
    tool("revcomp")
    tool("dna2rna")
    sample = tool("sample")
    how = sample.add_mutually_exclusive_group(required=True)
    how.add_argument("-n", "--count", type=int)
    how.add_argument("-f", "--fraction", type=float)
    sample.add_argument("-s", "--seed", type=int, default=0)
    sort = tool("sort")
    key = sort.add_mutually_exclusive_group()
    for flag in ("name", "sequence", "length"):
        key.add_argument(f"-{flag[0]}", f"--{flag}", dest="by", action="store_const", const=flag)
    sort.set_defaults(by="name")
    sort.add_argument("-r", "--reverse", action="store_true")
    flt = tool("filter")
    flt.add_argument("-q", "--min-quality", type=float)
    flt.add_argument("-l", "--min-length", type=int)
    flt.add_argument("-L", "--max-length", type=int)
    flt.add_argument("-n", "--max-n-fraction", type=float)
    trim = tool("trim")
    trim.add_argument("-q", "--quality-cutoff", type=int)
    trim.add_argument("-f", "--trim-front", type=int, default=0)
    trim.add_argument("-t", "--trim-tail", type=int, default=0)
    trim.add_argument("-L", "--max-length", type=int)
    trim.add_argument("-l", "--min-length", type=int)
    tool("stats", output=False).add_argument("--histogram", action="store_true")
    tool("to-fasta").add_argument("-q", "--min-quality", type=float)
    tool("interleave", "r1", "r2")
    split = tool("deinterleave", output=False)
    split.add_argument("-1", "--r1", required=True)
    split.add_argument("-2", "--r2", required=True)
    split.add_argument("--parts", action="store_true", help="make the outputs folders of part files")
    return top


def _emit(df: DataFrame, output: str | None, parts: bool, ordered: bool = True) -> None:
    if not output or output == "-":
        _print(df, ordered)
    elif parts:
        write_reads(df, output, ordered=ordered)
    else:
        _one_file(df, output, ordered)


def _print(df: DataFrame, ordered: bool) -> None:
    """Write packed parts to the shared folder, and print one after the other. No row comes to the driver, so its memory
    follows neither the output nor the largest partition, and a task that fails does so before anything is printed."""
    made = new_path(df.sparkSession, "printed")
    lines = ["header", "sequence"] + ([F.lit("+"), "quality"] if has_quality(df) else [])
    rows = (df.orderBy("idx") if ordered else df).select(F.concat_ws("\n", *lines).alias("value"))
    with freed_shuffles(df.sparkSession):
        rows.write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(made)
    sys.stdout.flush()
    _append(made, getattr(sys.stdout, "buffer", None) or _Decoded(sys.stdout))
    remove(df.sparkSession, made)


def _one_file(df: DataFrame, output: str, ordered: bool) -> None:
    """Write parts to the shared folder, and append one after the other to the output."""
    made = new_path(df.sparkSession, "parts")
    with freed_shuffles(df.sparkSession):
        write_reads(df, made, ordered=ordered)
    target, name = resolve(output)
    with target.open_output_stream(name) as out:
        _append(made, out)
    remove(df.sparkSession, made)


def _append(made: str, out) -> None:
    """Part files in order of name, unpacked, at the end of an open file."""
    source, path = resolve(made)
    for file in sorted(x.path for x in source.get_file_info(fs.FileSelector(path)) if x.base_name.startswith("part-")):
        with source.open_input_stream(file) as part:
            shutil.copyfileobj(part, out, 1 << 20)


class _Decoded:
    """A text stream without bytes below it, such as a StringIO, as one that takes bytes."""

    def __init__(self, text):
        self.text, self.decoder = text, codecs.getincrementaldecoder("utf-8")()

    def write(self, data: bytes) -> None:
        self.text.write(self.decoder.decode(data))


class _Chained:
    """A stream whose beginning has been read already."""

    def __init__(self, head: bytes, rest):
        self.head, self.rest = head, rest

    def read(self, size: int = -1) -> bytes:
        if self.head:
            out, self.head = self.head, b""
            return out
        return self.rest.read(size)


def _spooled(spark: SparkSession, any_format: bool) -> str:
    """Standard input as a file in the shared folder, where all executors can read it. Its format is told by its first
    bytes, before the rest is read, where either is allowed."""
    head = head_of(sys.stdin.buffer)
    if any_format:
        sniff(head)
    path = new_path(spark, "stdin")
    system, name = resolve(path)
    system.create_dir(name.rpartition("/")[0])
    with system.open_output_stream(name) as out:
        shutil.copyfileobj(_Chained(head, sys.stdin.buffer), out)
    return path


def _message(error: Exception) -> str:
    """What an error says, without the stack traces of tasks and the JVM."""
    text = str(error)
    found = _TASK_ERROR.findall(text)
    return found[-1].strip() if found and "\n" in text else text.split("\n")[0]


def _run(spark: SparkSession, a: argparse.Namespace) -> None:
    if getattr(a, "input", None) == "-":
        a.input = _spooled(spark, a.tool in ("dedup", "sample", "sort", "revcomp", "dna2rna"))
    if a.tool == "stats":
        df = read_fastq(spark, a.input)
        print(ops.format_report(ops.stats(df), ops.length_histogram(df) if a.histogram else None))
        return
    if a.tool == "deinterleave":
        for df, path in zip(ops.deinterleave(read_fastq(spark, a.input), dense=True), (a.r1, a.r2)):
            _emit(df, path, a.parts)
        return
    ordered = True
    if a.tool == "interleave":
        out = ops.interleave(read_fastq(spark, a.r1), read_fastq(spark, a.r2))
    elif a.tool == "filter":
        out = ops.filter_reads(read_fastq(spark, a.input), a.min_quality, a.min_length, a.max_length, a.max_n_fraction)
    elif a.tool == "trim":
        df = read_fastq(spark, a.input)
        out = ops.trim_reads(df, a.quality_cutoff, a.trim_front, a.trim_tail, a.max_length, a.min_length)
    elif a.tool == "to-fasta":
        out = ops.to_fasta(read_fastq(spark, a.input), a.min_quality)
    elif a.tool == "sort":
        out, ordered = ops.sort_reads(read_reads(spark, a.input), a.by, a.reverse), False
    elif a.tool == "sample" and a.count is not None:
        out, ordered = ops.sample_count(read_reads(spark, a.input), a.count, a.seed, dense=True).drop("slot"), False
    elif a.tool == "sample":
        out = ops.sample_fraction(read_reads(spark, a.input), a.fraction, a.seed, dense=True)
    else:
        out = {"dedup": ops.dedup, "revcomp": ops.revcomp, "dna2rna": ops.dna2rna}[a.tool](read_reads(spark, a.input))
    _emit(out, a.output, a.parts, ordered)


def run(spark: SparkSession, argv: list[str]) -> int:
    """Run one tool; errors of its input or its tasks go to standard error, and a reader that stops early is no error."""
    a = parser().parse_args(argv)
    try:
        with scope():
            _run(spark, a)
        sys.stdout.flush()
    except BrokenPipeError:
        return 0
    except (ValueError, OSError, PySparkException, Py4JError) as error:
        print(f"Error: {_message(error)}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.appName("strandline").getOrCreate(), sys.argv[1:]))
