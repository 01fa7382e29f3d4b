"""Readers, writers, the command line and streams."""

import contextlib
import gzip
import hashlib
import io
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from strandline import cli
from strandline import operators as ops
from strandline.plans import services
from strandline.sources import detect_format, read_fasta, read_fastq, read_reads, sniff, write_reads
from strandline.sources.fastq import FastqReader, MalformedRecord, _is_wrapped, parse_records, read_range
from strandline.streaming import (
    deinterleave_stream,
    dedup_stream,
    each_batch,
    interleave_stream,
    length_histogram_stream,
    read_fasta_stream,
    read_fastq_stream,
    reservoir_stream,
    stats_stream,
)


def rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.orderBy("idx").collect()]


FASTA = [
    (">seq1\nACGT\n>seq2\nTGCA\n>seq3\nACGT\n", [(">seq1", "ACGT"), (">seq2", "TGCA"), (">seq3", "ACGT")]),
    (">seq1\nACGT\nTGCA\n>seq2\nAAAA\n", [(">seq1", "ACGTTGCA"), (">seq2", "AAAA")]),
    (">seq1\n  ACGT  \n\tTGCA\t\n  GGGG  \n>seq2\nAAAA \n TTTT\n", [(">seq1", "ACGTTGCAGGGG"), (">seq2", "AAAATTTT")]),
    (">seq1\nACGT\n\nTGCA\n\n>seq2\nAAAA\n", [(">seq1", "ACGTTGCA"), (">seq2", "AAAA")]),
    (">seq1 description\nACGT TGCA\n  GGGG\n\tCCCC  \n>seq2\n  AAAA\n", [(">seq1 description", "ACGTTGCAGGGGCCCC"), (">seq2", "AAAA")]),
    ("junk\n\n>a\nAC", [(">a", "AC")]),
    ("ab >c x\nAC\n  >not\nG>T\n>d", [(">c x", "AC>notG>T"), (">d", "")]),
    (">a\r\nAC\r\nGT\r\n", [(">a\r", "ACGT")]),
    ("\n \n", []),
]


class TestFasta:
    @pytest.mark.parametrize("text,want", FASTA)
    def test_grammar(self, spark, tmp_path, text, want):
        (tmp_path / "x.fa").write_bytes(text.encode())
        got = read_fasta(spark, str(tmp_path / "x.fa"))
        assert rows(got, "idx", "header", "sequence") == [(i, *w) for i, w in enumerate(want)]

    @pytest.mark.parametrize("split", [137, 1000, 1 << 20])
    def test_numbers_hold_across_splits_and_files(self, spark, tmp_path, split):
        rng = random.Random(5)
        want = []
        for name, n in (("a", 5), ("b", 300), ("c", 40)):
            text = ""
            for i in range(n):
                lines = ["A" + "".join(rng.choice("ACGT>") for _ in range(rng.randrange(30))) for _ in range(rng.randrange(4))]
                text += "\n".join([f">{name}{i} d", *lines]) + "\n"
                want.append((len(want), f">{name}{i} d", "".join(lines)))
            (tmp_path / f"{name}.fa").write_text(text)
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        try:
            assert rows(read_fasta(spark, str(tmp_path)), "idx", "header", "sequence") == want
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)

    def test_gzip(self, spark, tmp_path):
        with gzip.open(tmp_path / "x.fa.gz", "wt") as f:
            f.write(FASTA[1][0])
        assert rows(read_fasta(spark, str(tmp_path)), "header", "sequence") == FASTA[1][1]


FASTQ = [
    ("@seq1\nACGT\n+\nIIII\n@seq2\nTGCA\n+\nHHHH\n", [("@seq1", "ACGT", "IIII"), ("@seq2", "TGCA", "HHHH")]),
    ("@seq1 description here\nACGT\n+\nIIII\n", [("@seq1 description here", "ACGT", "IIII")]),
    ("@seq1\n\n+\n\n", [("@seq1", "", "")]),
    ("@a\r\nAC\r\n+a\r\n@I\r\n\r\n@b\r\nG\r\n+\r\n+", [("@a", "AC", "@I"), ("@b", "G", "+")]),
]


class TestFastq:
    @pytest.mark.parametrize("text,want", FASTQ)
    def test_grammar(self, spark, tmp_path, text, want):
        (tmp_path / "x.fq").write_bytes(text.encode())
        assert rows(read_fastq(spark, str(tmp_path / "x.fq")), "header", "sequence", "quality") == want

    def test_wrapped(self, spark, tmp_path):
        (tmp_path / "x.fq").write_text("@seq1\nACGT\nTGCA\n+\nIIII\n@HHH\n\n@s2\nA\n+\nI\n")
        got = read_fastq(spark, str(tmp_path / "x.fq"), wrapped=True)
        assert rows(got, "idx", "sequence", "quality") == [(0, "ACGTTGCA", "IIII@HHH"), (1, "A", "I")]

    @pytest.mark.parametrize("text", ["@s\nACGT\n+\n!!!\n", "@s\nACGT\n", "@s\nAC\n+\nIII\n", "x\nAC\n+\nII\n", "@s\nACGT\n+\n!!!\n@t\nA\n+\nI\n"])
    def test_malformed(self, text):
        with pytest.raises(ValueError):
            list(parse_records(iter(text.encode().splitlines(True))))
        assert all(len(s) == len(q) for _, s, q in parse_records(iter(text.encode().splitlines(True)), "DROPMALFORMED"))

    def test_modes(self, spark, tmp_path):
        (tmp_path / "x.fq").write_text("@a\nAC\n+\nI!I\n@b\nAC\n+\nII\n")
        path = str(tmp_path / "x.fq")
        assert rows(read_fastq(spark, path, mode="DROPMALFORMED"), "header") == [("@b",)]
        assert rows(read_fastq(spark, path, mode="PERMISSIVE"), "header", "sequence") == [("@a", None), ("@b", "AC")]
        with pytest.raises(Exception, match="scores"):
            read_fastq(spark, path).count()

    @pytest.mark.parametrize("split", [50, 333, 5000, 1 << 20])
    def test_every_split_gives_all_records_in_order(self, spark, tmp_path, split):
        rng = random.Random(split)
        want, text = [], {"a": "", "b": ""}
        for name in text:
            for i in range(60):
                n = rng.choice([0, 1, 30, 70])
                s, q = "".join(rng.choice("ACGT") for _ in range(n)), "".join(rng.choice("@+>I!") for _ in range(n))
                text[name] += f"@{name}{i}\n{s}\n+\n{q}\n"
                want.append((len(want), f"@{name}{i}", s, q))
            (tmp_path / f"{name}.fq").write_text(text[name])
        got = read_fastq(spark, str(tmp_path), split_bytes=split)
        assert rows(got, "idx", "header", "sequence", "quality") == want

    TRICKY = [
        # four-line records, with blank lines, a wrapped and an empty record between them
        "".join(f"@{i}\nACGT{'A' * (i % 7)}\n+\n@+II{'I' * (i % 7)}\n" + ("\n" if i % 5 == 0 else "") for i in range(40))
        + "@w\nAC\nGT\n+\nII\nII\n@e\n\n+\n\n@z\nA C\n+\nI I\n",
        # wrapped records throughout
        "".join(f"@{i}\n{'ACGTACGT' * 3}\n{'AC' * (i % 9)}G\n+x\n{'@IIIIIII' * 3}\n{'+I' * (i % 9)}I\n" for i in range(40)),
        # a quality of wrong length, a record without one, and junk, each between good ones
        "".join(f"@{i}\nACGT\n+\n{'II' if i in (9, 30) else 'IIII'}\n" + ("junk\n" if i == 20 else "") for i in range(40)),
        "@a\nACGTAC\n+\nIIII\n@b\nAC\n+\nII\n@c\nACG\n@d\nAC\n+\nII\n@e\nACGT\n+\nII",
    ]

    @pytest.mark.parametrize("text", TRICKY)
    @pytest.mark.parametrize("mode", ["FAILFAST", "DROPMALFORMED", "PERMISSIVE"])
    def test_ranges_of_any_size_give_the_same(self, tmp_path, text, mode):
        path = tmp_path / "x.fq"
        path.write_text(text)

        def read(size, block):
            reader = FastqReader({"path": str(path), "mode": mode, "splitBytes": str(size)})
            out = []
            for part in reader.partitions():
                with open(path, "rb") as stream:
                    if _is_wrapped(stream):
                        out += [r for b in reader.read(part) for r in b.to_pylist()]
                    else:
                        out += [r for b in read_range(stream, part.start, part.end, mode, block) for r in b.to_pylist()]
            return out

        results = []
        for size, block in [(1 << 30, 1 << 24), (1 << 30, 64), (500, 1 << 24), (137, 100), (50, 7), (11, 33)]:
            try:
                results.append(read(size, block))
            except ValueError as error:
                results.append(type(error))
        assert all(r == results[0] for r in results)
        if text in self.TRICKY[:2]:
            assert len(results[0]) in (43, 40) and all(r["quality"] is not None for r in results[0])
        elif mode == "FAILFAST":
            assert results[0] is MalformedRecord
        else:
            good = [r["header"] for r in results[0] if r["sequence"] is not None]
            assert len(good) == (38 if "junk" in text else 2)

    def test_ranges_of_random_files_give_the_same(self):
        rng = random.Random(11)
        for _ in range(60):
            text = ""
            for i in range(rng.randrange(1, 8)):
                n = rng.choice([0, 1, 2, 5, 9])
                lines = [f"@{i}", "".join(rng.choice("ACGT") for _ in range(n)), "+", "".join(rng.choice("@+I!") for _ in range(n))]
                what = rng.random()
                if what < 0.2:
                    lines[3] = rng.choice([lines[3][:-1], lines[3] + "I"])
                elif what < 0.3:
                    lines.pop(rng.randrange(4))
                elif what < 0.4:
                    lines.insert(rng.randrange(5), rng.choice(["", "junk"]))
                text += "".join(x + rng.choice(["\n", "\r\n"]) for x in lines)
            for mode in ("FAILFAST", "DROPMALFORMED", "PERMISSIVE"):
                results = []
                for size, block in ((10**6, 10**6), (10**6, 7), (9, 10**6), (14, 5), (3, 100)):
                    try:
                        parts = [read_range(io.BytesIO(text.encode()), a, a + size, mode, block) for a in range(0, len(text), size)]
                        results.append([r for part in parts for batch in part for r in batch.to_pylist()])
                    except ValueError:
                        results.append("error")
                assert all(r == results[0] for r in results), text

    def test_folders_and_globs(self, spark, tmp_path):
        (tmp_path / "in" / "deep").mkdir(parents=True)
        for name in ("a.fq", "deep/b.fq", "deep/c.txt", "_no.fq"):
            (tmp_path / "in" / name).write_text(f"@{name}\nA\n+\nI\n")
        assert rows(read_fastq(spark, str(tmp_path / "in")), "header") == [("@a.fq",), ("@deep/b.fq",), ("@deep/c.txt",)]
        assert rows(read_fastq(spark, str(tmp_path / "in" / "*" / "*.fq")), "header") == [("@deep/b.fq",)]
        with pytest.raises(Exception, match="nothing"):
            read_fastq(spark, str(tmp_path / "nothing"))

    def test_gzip(self, spark, tmp_path):
        with gzip.open(tmp_path / "x.fq.gz", "wt") as f:
            f.write(FASTQ[0][0])
        assert rows(read_fastq(spark, str(tmp_path)), "header", "sequence", "quality") == FASTQ[0][1]


class TestSniff:
    def test_first_byte(self):
        assert sniff(b">x") == "fasta" and sniff(b"@x") == "fastq" and sniff(b"  \n  >seq1") == "fasta"
        with pytest.raises(ValueError, match="Unknown format"):
            sniff(b"ACGT")
        with pytest.raises(ValueError, match="Empty"):
            sniff(b" \n")

    def test_files(self, spark, tmp_path):
        (tmp_path / "y").write_text("\t\n" * 9000 + ">a\nAC")
        assert detect_format(spark, str(tmp_path / "y")) == "fasta"
        (tmp_path / "x").write_text("\n  @a\nAC\n+\nII\n")
        assert detect_format(spark, str(tmp_path / "x")) == "fastq"
        assert read_reads(spark, str(tmp_path / "x")).columns == ["idx", "header", "sequence", "quality"]


class TestWriter:
    def test_round_trip_is_normal_form(self, spark, tmp_path, reads):
        df = reads(("@a x", "ACGT", "@+>I"), ("@b", "", ""), ("@c", "A", "I"))
        write_reads(df.repartition(3), str(tmp_path / "out"), single=True)
        (part,) = (tmp_path / "out").glob("part-*")
        assert part.read_text() == "@a x\nACGT\n+\n@+>I\n@b\n\n+\n\n@c\nA\n+\nI\n"
        assert rows(read_fastq(spark, str(tmp_path / "out")), *df.columns) == rows(df, *df.columns)

    def test_nulls(self, spark, tmp_path):
        df = spark.createDataFrame([(0, "@a", None, None), (1, None, "AC", "II")], "idx long, header string, sequence string, quality string")
        write_reads(df, str(tmp_path / "out"), single=True)
        assert next((tmp_path / "out").glob("part-*")).read_text() == "@a\n\n+\n\n\nAC\n+\nII\n"
        with pytest.raises(Exception, match="differ in length: @b"):
            write_reads(spark.createDataFrame([(0, "@b", "AC", None)], df.schema), str(tmp_path / "bad"))

    def test_fasta(self, spark, tmp_path, records):
        write_reads(records("AC", "GT"), str(tmp_path / "out"), compression="gzip")
        assert rows(read_fasta(spark, str(tmp_path / "out")), "idx", "sequence") == [(0, "AC"), (1, "GT")]


class TestCli:
    def run(self, spark, capsys, *argv):
        code = cli.run(spark, list(argv))
        out = capsys.readouterr()
        return code, out.out, out.err

    def test_tools(self, spark, tmp_path, capsys):
        fa, fq = tmp_path / "x.fa", tmp_path / "x.fq"
        fa.write_text(">b\nAACT\n>a\nGG\n>c\nAACT\n")
        fq.write_text("@a\nACGT\n+\nIIII\n@b\nTT\n+\n!!\n")
        say = lambda *a: self.run(spark, capsys, *map(str, a))[1]
        assert say("dedup", fa) == ">b\nAACT\n>a\nGG\n"
        assert say("revcomp", fa).startswith(">b\nAGTT\n")
        assert say("dna2rna", fq) == "@a\nACGU\n+\nIIII\n@b\nUU\n+\n!!\n"
        assert say("sort", fa) == ">a\nGG\n>b\nAACT\n>c\nAACT\n"
        assert say("sort", fa, "-l", "-r") == ">b\nAACT\n>c\nAACT\n>a\nGG\n"
        assert say("sample", fa, "-n", 3) == ">b\nAACT\n>a\nGG\n>c\nAACT\n"
        assert say("sample", fa, "-f", 1.0) == ">b\nAACT\n>a\nGG\n>c\nAACT\n"
        assert say("filter", fq, "-q", 20) == "@a\nACGT\n+\nIIII\n"
        assert say("trim", fq, "-f", 1, "-l", 2) == "@a\nCGT\n+\nIII\n"
        assert say("to-fasta", fq) == ">a\nACGT\n>b\nTT\n"
        assert "Total bases:      6" in say("stats", fq, "--histogram")
        assert say("interleave", fq, fq).count("@a\n") == 2
        say("deinterleave", fq, "-1", tmp_path / "r1", "-2", tmp_path / "r2")
        assert (tmp_path / "r2").read_text() == "@b\nTT\n+\n!!\n"
        say("sort", fa, "-l", "-r", "-o", tmp_path / "out.fa")
        assert (tmp_path / "out.fa").read_text() == ">b\nAACT\n>c\nAACT\n>a\nGG\n"
        say("dedup", fa, "-o", tmp_path / "parts", "--parts")
        assert rows(read_fasta(spark, str(tmp_path / "parts")), "header") == [(">b",), (">a",)]

    def test_standard_input(self, spark, capsys, monkeypatch):
        monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(b">a\nAC\n>b\nAC\n")))
        assert self.run(spark, capsys, "dedup")[1] == ">a\nAC\n"

    def test_letters_over_the_end_of_a_block(self, spark, tmp_path):
        text = "".join(f">{i}{'é' * 700}\nAC\n" for i in range(1001))
        (tmp_path / "x.fa").write_text(text)
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            assert cli.run(spark, ["sort", str(tmp_path / "x.fa"), "-l"]) == 0
        assert len(text.encode()) > 1 << 20 and out.getvalue() == text

    def test_nothing_to_print(self, spark, tmp_path, capsys):
        (tmp_path / "x.fq").write_text("@a\nACGT\n+\nIIII\n")
        assert self.run(spark, capsys, "filter", str(tmp_path / "x.fq"), "-l", "9") == (0, "", "")

    def test_memory_does_not_follow_the_output(self, spark, tmp_path):
        fa = spark.range(2000).selectExpr("id AS idx", "'>x' AS header", "repeat(md5(cast(id AS string)), 64) AS sequence")
        fq = spark.range(20000).selectExpr("id AS idx", "'@x' AS header", "repeat(md5(cast(id AS string)), 6) AS sequence", "repeat('I', 192) AS quality")
        fa.write.parquet(str(tmp_path / "fasta_reads.parquet"))
        fq.write.parquet(str(tmp_path / "fastq_reads.parquet"))
        tracemalloc.start()
        try:
            got = {r.tool: r.hash for r in services.command_line(spark, str(tmp_path)).collect()}
            peak = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        fa = "".join(f">r{r.idx}\n{r.sequence}\n" for r in fa.orderBy("idx").collect())
        fq = [f"@r{r.idx}\n{r.sequence}\n+\n{r.quality}\n" for r in fq.orderBy("idx").collect()]
        hashed = lambda text: hashlib.md5(text.encode()).hexdigest()
        assert got["dedup"] == got["sort"] == got["standard input"] == hashed(fa)
        assert got["interleave"] == hashed("".join(x + x for x in fq)) and got["deinterleave"] == hashed("".join(fq[1::2]))
        assert peak < len("".join(fq)), peak  # half of what interleave prints

    def test_errors(self, spark, tmp_path, capsys):
        (tmp_path / "x").write_text("ACGT\n")
        code, _, err = self.run(spark, capsys, "dedup", str(tmp_path / "x"))
        assert code == 1 and "Unknown format" in err
        (tmp_path / "y").write_text("@a\nACGT\n+\nII\n")
        for argv in (("dedup", str(tmp_path / "y")), ("stats", str(tmp_path / "y")), ("filter", str(tmp_path / "none"))):
            code, _, err = self.run(spark, capsys, *argv)
            assert code == 1 and err.startswith("Error: ") and len(err.splitlines()) == 1
        assert "none" in err


class TestStreams:
    def drain(self, spark, df, mode, name):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name)

    def test_fasta(self, spark, tmp_path):
        for name, text in (("a", ">1\nAC\nGT\n>2\nACGT\n"), ("b", ">3\nTT\n")):
            (tmp_path / f"{name}.fa").write_text(text)
        stream = read_fasta_stream(spark, str(tmp_path), max_files=1)
        got = self.drain(spark, dedup_stream(ops.revcomp(stream)), "append", "deduped")
        assert sorted(r.sequence for r in got.collect()) == ["AA", "ACGT"]

    def test_fastq(self, spark, tmp_path):
        (tmp_path / "in").mkdir()
        (tmp_path / "in" / "a.fq").write_text(FASTQ[0][0])
        stream = ops.filter_reads(read_fastq_stream(spark, str(tmp_path / "in")), min_length=4)
        write = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck"))
        for more in (None, FASTQ[1][0], None):
            if more:
                (tmp_path / "in" / "b.fq").write_text(more)
            write.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
        got = spark.read.parquet(str(tmp_path / "out")).collect()
        assert sorted(r.header for r in got) == ["@seq1", "@seq1 description here", "@seq2"]

    def test_totals_histogram_and_reservoir(self, spark, tmp_path):
        data = [(i, f"@{i}", "ACGTN"[: i % 5 + 1], "IIIII"[: i % 5 + 1]) for i in range(50)]
        df = spark.createDataFrame(data, "idx long, header string, sequence string, quality string")
        df.repartition(3).write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        r = self.drain(spark, stats_stream(stream), "complete", "totals").first()
        assert r == ops.stats(df).first() and (r.total_reads, r.mean_quality) == (50, 40.0)
        h = self.drain(spark, length_histogram_stream(stream, 2), "complete", "hist").collect()
        assert sum(x.reads for x in h) == 50
        kept = self.drain(spark, reservoir_stream(stream, 5, 42), "complete", "kept")
        assert {x.idx for x in kept.collect()} == {x.idx for x in ops.sample_count(df, 5, 42).collect()}

    def test_pairs_by_batch(self, spark, tmp_path):
        df = spark.createDataFrame([(i, f"@{i}", "A", "I") for i in range(6)], "idx long, header string, sequence string, quality string")
        for name, some in (("one", df.filter("idx in (1, 3)")), ("two", df.filter("idx in (2, 4)")), ("all", df)):
            some.coalesce(1).write.parquet(str(tmp_path / name))
        read = lambda name: spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
        seen = []
        query = interleave_stream(read("one"), read("two"), lambda b, _: seen.extend(rows(b, "header")), str(tmp_path / "ck1"))
        query.awaitTermination(120)
        assert seen == [("@1",), ("@2",), ("@3",), ("@4",)]
        halves = []
        query = deinterleave_stream(read("all"), lambda a, b, _: halves.extend([rows(a, "header"), rows(b, "header")]), str(tmp_path / "ck2"))
        query.awaitTermination(120)
        assert halves == [[("@0",), ("@2",), ("@4",)], [("@1",), ("@3",), ("@5",)]]

    def test_sort_by_batch(self, spark, tmp_path):
        df = spark.createDataFrame([(0, "@b", "A"), (1, "@a", "C")], "idx long, header string, sequence string")
        df.write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        seen = []
        query = each_batch(stream, ops.sort_reads, lambda batch, _: seen.extend(r.header for r in batch.collect()), str(tmp_path / "ck"))
        query.awaitTermination(120)
        assert seen == ["@a", "@b"]
