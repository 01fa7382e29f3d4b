"""Operators on small relations: scenarios of dedup, conversion, filters, trimming, sampling, order, pairs, statistics."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline import operators as ops
from strandline.functions import mean_quality, phred_to_ascii, quality_ends, score_of, trim_bounds
from strandline.operators import sampling


def column(df, name="sequence"):
    return [r[name] for r in df.orderBy("idx").collect()]


class TestDedup:
    def test_keeps_first(self, records, reads):
        assert column(ops.dedup(records("ACGT", "TGCA", "ACGT")), "header") == [">seq1", ">seq2"]
        fastq = reads(("@a", "ACGT", "IIII"), ("@b", "TGCA", "HHHH"), ("@c", "ACGT", "!!!!"))
        assert column(ops.dedup(fastq), "quality") == ["IIII", "HHHH"]

    def test_case_counts_and_order_of_rows_does_not(self, records):
        df = records("acgt", "ACGT", "acgt").orderBy(F.desc("idx"))
        assert column(ops.dedup(df), "idx") == [0, 1]

    def test_hot_sequence_and_nulls(self, spark):
        df = spark.range(1000).select(F.col("id").alias("idx"), F.when(F.col("id") % 3 > 0, "AC").alias("sequence"))
        assert column(ops.dedup(df), "idx") == [0, 1]
        assert ops.dedup(df.limit(0)).count() == 0


class TestConvert:
    @pytest.mark.parametrize("dna,rna", [("ACGT", "ACGU"), ("ACGACG", "ACGACG"), ("TTTT", "UUUU"), ("AcGt", "AcGu"), ("", "")])
    def test_dna2rna(self, records, dna, rna):
        assert column(ops.dna2rna(records(dna))) == [rna]

    def test_dna2rna_keeps_quality(self, reads):
        out = ops.dna2rna(reads(("@a", "ATGC", "IIII"), ("@b", "TTAA", "HHHH")))
        assert column(out) == ["AUGC", "UUAA"] and column(out, "quality") == ["IIII", "HHHH"]

    @pytest.mark.parametrize(
        "one,other",
        [("ACGT", "ACGT"), ("GAATTC", "GAATTC"), ("AcGt", "aCgT"), ("ACGTN", "NACGT"), ("RYKMBVDHSWN", "NWSDHBVKMRY"), ("ryU-", "-Uyr")],
    )
    def test_revcomp(self, records, one, other):
        assert column(ops.revcomp(records(one))) == [other]

    def test_revcomp_turns_quality_and_is_its_own_inverse(self, reads):
        df = reads(("@a", "AACG", "!I#5"))
        assert column(ops.revcomp(df), "quality") == ["5#I!"]
        assert ops.revcomp(ops.revcomp(df)).collect() == df.collect()

    def test_to_fasta(self, reads):
        df = reads(("@seq1 description here", "ACGT", "IIII"), ("@seq2", "TGCA", "!!!!"))
        out = ops.to_fasta(df)
        assert column(out, "header") == [">seq1 description here", ">seq2"] and "quality" not in out.columns
        assert column(ops.to_fasta(df, 20), "header") == [">seq1 description here"]
        assert ops.to_fasta(df.limit(0)).count() == 0


class TestScores:
    def test_scale(self, spark):
        df = spark.createDataFrame([("!", 0), ("I", 40), (" ", 0), ("~", 93)], "c string, q int")
        assert all(r.s == r.q for r in df.select("q", score_of(F.col("c")).alias("s")).collect())
        back = spark.createDataFrame([(0, "!"), (40, "I"), (200, "~")], "q int, c string")
        assert all(r.s == r.c for r in back.select("c", phred_to_ascii(F.col("q")).alias("s")).collect())

    def test_mean(self, spark):
        df = spark.createDataFrame([("IIII", 40.0), ("!!!!", 0.0), ("!I", 20.0), ("", 0.0), (None, None)], "q string, m double")
        assert all(r.m == r.x for r in df.select("m", mean_quality(F.col("q")).alias("x")).collect())


class TestFilter:
    @pytest.fixture
    def three(self, reads):
        return reads(("@1", "ACGT", "IIII"), ("@2", "AC", "HH"), ("@3", "ACGTACGT", "!!!!!!!!"))

    def test_each_limit(self, three, reads):
        assert column(ops.filter_reads(three, min_quality=20), "header") == ["@1", "@2"]
        assert column(ops.filter_reads(three, min_length=4, max_length=6), "header") == ["@1"]
        n = reads(("@1", "ACGT", "IIII"), ("@2", "NNNN", "IIII"), ("@3", "ACNT", "IIII"), ("@4", "", ""))
        assert column(ops.filter_reads(n, max_n_fraction=0.5), "header") == ["@1", "@3", "@4"]
        assert column(ops.filter_reads(three, min_quality=20, min_length=4), "header") == ["@1"]
        assert ops.filter_reads(three).count() == 3

    def test_reads_at_a_limit_stay(self, reads):
        df = reads(("@1", "ACGTN", "56789"))
        assert ops.filter_reads(df, min_quality=22, min_length=5, max_length=5, max_n_fraction=0.2).count() == 1

    def test_fraction_is_checked(self, three):
        with pytest.raises(ValueError):
            ops.filter_reads(three, max_n_fraction=1.5)


class TestTrim:
    def test_scenarios(self, reads):
        df = reads(("@1", "ACGTACGT", "IIIIIIII"))
        assert column(ops.trim_reads(df, trim_front=2)) == ["GTACGT"]
        assert column(ops.trim_reads(df, trim_tail=2)) == ["ACGTAC"]
        assert ops.trim_reads(df, trim_front=2, min_length=10).count() == 0
        assert column(ops.trim_reads(df, max_length=0)) == [""]
        with pytest.raises(ValueError):
            ops.trim_reads(df, trim_front=-1)

    CASES = [
        # quality, what trimming is asked for, which places of the read are left
        ("IIIIIIII", dict(quality_cutoff=20), "01234567"),
        ("!!II!I!!", dict(quality_cutoff=20), "2345"),
        ("!!!!!!!!", dict(quality_cutoff=20), ""),
        ("5I!!!!I4", dict(quality_cutoff=20), "0123456"),
        ("!!IIII!!", dict(quality_cutoff=20, trim_front=1, trim_tail=1), "34"),
        ("!!IIII!!", dict(quality_cutoff=20, trim_front=9), ""),
        ("IIIIIIII", dict(trim_front=3, max_length=2), "34"),
        ("IIIIIIII", dict(trim_tail=8), ""),
        ("IIIIIIII", dict(trim_tail=7), "0"),
        ("IIIIIIII", dict(trim_front=6, trim_tail=6), ""),
        ("!!!!IIII", dict(quality_cutoff=0), "01234567"),
        ("", dict(quality_cutoff=20, trim_front=2, trim_tail=2), ""),
    ]

    @pytest.mark.parametrize("quality,how,left", CASES)
    def test_cases(self, reads, quality, how, left):
        row = ops.trim_reads(reads(("@", "01234567"[: len(quality)], quality)), **how).first()
        assert row.sequence == left and row.quality == "".join(quality[int(i)] for i in left)

    @pytest.mark.parametrize("cutoff", [2, 20])
    def test_quality_trimming_stops_at_the_first_good_base_of_either_end(self, spark, cutoff):
        rng = np.random.default_rng(1)
        rows = [(i, "@", "A" * n, "".join(rng.choice(list("!#5I"), n))) for i, n in enumerate(rng.integers(0, 25, 120).tolist())]
        df = spark.createDataFrame(rows, "idx long, header string, sequence string, quality string")
        good = f"[{chr(33 + cutoff)}-~]"
        for r in ops.trim_reads(df, cutoff).orderBy("idx").collect():
            found = re.search(f"{good}.*{good}|{good}", rows[r.idx][3])
            assert r.quality == (found.group() if found else "") and len(r.sequence) == len(r.quality)

    def test_fixed_cuts_are_counted_once(self, spark):
        rows = [(n, "@", "".join(chr(65 + i) for i in range(n)), "I" * n) for n in range(26)]
        df = spark.createDataFrame(rows, "idx long, header string, sequence string, quality string")
        got = {r.idx: r.sequence for r in ops.trim_reads(df, None, 3, 4, 5).collect()}
        assert all(got[n] == rows[n][2][3 : n - 4][:5] for n in range(7, 26))
        assert {len(got[n]) for n in range(7)} <= {0, 1, 2, 3}

    def test_bounds_are_columns(self, reads):
        first, size = trim_bounds(*quality_ends(F.col("quality"), None), F.length("sequence"), trim_front=1)
        assert tuple(reads(("@1", "ACGT", "IIII")).select(first, size).first()) == (1, 3)


def reservoir(n, k, seed):
    """Algorithm R, one row after the other."""
    state, kept = seed, []
    for i in range(n):
        if i < k:
            kept.append(i)
            continue
        state = (state * sampling.MULTIPLIER + sampling.INCREMENT) % sampling.MODULUS
        if state % (i + 1) < k:
            kept[state % (i + 1)] = i
    return kept


class TestSampling:
    def rows(self, spark, n):
        return spark.range(n).select(F.col("id").alias("idx"), F.col("id").cast("string").alias("header"))

    @pytest.mark.parametrize("n,k,seed", [(4, 2, 42), (3, 2, 123), (2000, 50, 7), (10, 10, 1), (5, 9, 1)])
    def test_reservoir(self, spark, n, k, seed):
        got = ops.sample_count(self.rows(spark, n).repartition(3), k, seed).collect()
        assert [r.idx for r in got] == reservoir(n, k, seed)

    def test_known_draws(self, spark):
        assert reservoir(4, 2, 42) == [3, 1] and reservoir(3, 2, 123) == [0, 2]
        assert [r.idx for r in ops.sample_fraction(self.rows(spark, 4), 0.5, 42).orderBy("idx").collect()] == [0, 1, 3]

    def test_extremes(self, spark):
        df = self.rows(spark, 5)
        assert ops.sample_count(df, 0).count() == 0
        assert ops.sample_fraction(df, 0).count() == 0 and ops.sample_fraction(df, 1).count() == 5
        with pytest.raises(ValueError):
            ops.sample_fraction(df, 1.1)

    def test_positions_count_not_ordinals(self, spark):
        odd = spark.range(2000).filter("id % 2 = 1").select(F.col("id").alias("idx"), F.col("id").alias("old"))
        got = ops.sample_count(odd, 100, 5).collect()
        assert [r.idx for r in got] == reservoir(1000, 100, 5) and all(r.old == 2 * r.idx + 1 for r in got)
        want = [r.idx for r in ops.sample_fraction(self.rows(spark, 1000), 0.1, 5).orderBy("idx").collect()]
        assert [r.idx for r in ops.sample_fraction(odd, 0.1, 5).orderBy("idx").collect()] == want
        assert ops.sample_count(odd, 5000).count() == 1000

    def test_states_jump_ahead(self):
        state, want = 42, []
        for _ in range(300):
            want.append(state)
            state = (state * sampling.MULTIPLIER + 1) % sampling.MODULUS
        assert sampling.states(np.arange(300), 42).tolist() == want


class TestOrder:
    def names(self, df):
        return [r.header for r in df.collect()]

    def test_keys(self, spark, records):
        df = spark.createDataFrame([(0, ">seq3", "TGCA"), (1, ">seq1", "ACGTACGT"), (2, ">seq2", "GG")], "idx long, header string, sequence string")
        assert self.names(ops.sort_reads(df)) == [">seq1", ">seq2", ">seq3"]
        assert self.names(ops.sort_reads(df, "sequence")) == [">seq1", ">seq2", ">seq3"]
        assert self.names(ops.sort_reads(df, "length")) == [">seq2", ">seq3", ">seq1"]
        assert self.names(ops.sort_reads(df, "length", True)) == [">seq1", ">seq3", ">seq2"]
        with pytest.raises(ValueError):
            ops.sort_reads(df, "quality")

    def test_ties(self, records):
        df = records("AA", "CC", "AA", "GG")
        assert [r.idx for r in ops.sort_reads(df, "length", True).collect()] == [0, 1, 2, 3]
        assert [r.idx for r in ops.sort_reads(df, "sequence").collect()] == [0, 2, 1, 3]
        assert [r.idx for r in ops.sort_reads(df, "sequence", True).collect()] == [3, 1, 2, 0]

    def test_ranks_follow_the_sort(self, spark):
        df = spark.range(500).selectExpr("id as idx", "concat('>', id * 7919 % 101) as header", "repeat('A', int(id % 17)) as sequence").repartition(5)
        for by, reverse in (("name", False), ("length", True)):
            want = [r.idx for r in ops.sort_reads(df, by, reverse).collect()]
            got = [r.idx for r in ops.rank_reads(df, by, reverse).orderBy("rank").collect()]
            assert got == want
        assert ops.rank_reads(df.limit(0)).count() == 0


class TestPairs:
    def test_interleave(self, reads):
        one = reads(("@read1/1", "A", "I"), ("@read2/1", "C", "I"))
        two = reads(("@read1/2", "G", "I"), ("@read2/2", "T", "I"))
        assert column(ops.interleave(one, two), "header") == ["@read1/1", "@read1/2", "@read2/1", "@read2/2"]

    def test_mismatch(self, reads):
        one, two = reads(("@a", "A", "I"), ("@b", "A", "I")), reads(("@a", "A", "I"))
        with pytest.raises(ValueError, match="R1 has extra"):
            ops.interleave(one, two)
        with pytest.raises(ValueError, match="R2 has extra"):
            ops.interleave(two, one)

    def test_deinterleave(self, reads):
        one, two = ops.deinterleave(reads(*[(f"@{i}", "A", "I") for i in range(5)]))
        assert column(one, "header") == ["@0", "@2", "@4"] and column(two, "header") == ["@1", "@3"]
        assert column(one, "idx") == [0, 1, 2]

    def test_positions_count_not_ordinals(self, reads):
        df = reads(*[(f"@{i}", "A", "I") for i in range(8)])
        mixed = ops.interleave(df.filter("idx in (1, 3, 5)"), df.filter("idx in (1, 5, 7)"))
        assert column(mixed, "header") == ["@1", "@1", "@3", "@5", "@5", "@7"] and column(mixed, "idx") == list(range(6))
        one, two = ops.deinterleave(df.filter("idx % 2 = 1"))
        assert column(one, "header") == ["@1", "@5"] and column(two, "header") == ["@3", "@7"]


class TestStats:
    def test_summary(self, reads):
        r = ops.stats(reads(("@1", "ACGT", "IIII"), ("@2", "ACGTACGT", "IIIIIIII"))).first()
        assert (r.total_reads, r.total_bases, r.min_length, r.max_length, r.mean_length) == (2, 12, 4, 8, 6.0)
        assert (r.mean_quality, r.gc_percentage, r.n_percentage) == (40.0, 50.0, 0.0)

    def test_empty_and_odd_characters(self, reads, spark):
        empty = spark.createDataFrame([], "sequence string, quality string")
        assert tuple(ops.stats(empty).first()) == (0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0)
        r = ops.stats(reads(("@1", "NnSg", " !I!"), ("@2", "", ""))).first()
        assert (r.total_reads, r.min_length, r.mean_quality, r.gc_percentage, r.n_percentage) == (2, 0, 10.0, 25.0, 50.0)

    def test_histogram(self, records):
        df = records("A" * 20, "A" * 3, "A" * 39, "A" * 19)
        got = {r.bin: (r.range_start, r.range_end, r.reads) for r in ops.length_histogram(df).collect()}
        assert got == {9: (18, 20, 3), 1: (2, 4, 1)}
        assert ops.length_histogram(records("AC", "A" * 500)).orderBy("bin").collect()[-1].bin == 9
        assert ops.length_histogram(df.limit(0)).count() == 0

    def test_report(self, reads):
        df = reads(("@1", "ACGT", "IIII"), ("@2", "ACGTACGT", "IIIIIIII"))
        text = ops.format_report(ops.stats(df), ops.length_histogram(df))
        assert text.split("\n")[:4] == ["FASTQ Statistics", "================", "Total reads:      2", "Total bases:      12"]
        assert "Mean length:      6.00\n\nQuality Statistics\n------------------\nMean quality:     40.00" in text
        assert text.endswith(f"   8-12           1  {'█' * 40}") or "█" * 40 in text.split("\n")[-1]
        assert "Length Distribution" not in ops.format_report(ops.stats(df), ops.length_histogram(df.limit(0)))


def test_operators_compose(records):
    out = records("GATTACA", "ACGT", "GATTACA", "AC").transform(ops.dedup).transform(ops.sort_reads, "length", True)
    assert [r.sequence for r in out.collect()] == ["GATTACA", "ACGT", "AC"]


def test_missing_columns_are_named(records):
    with pytest.raises(ValueError, match="quality"):
        ops.trim_reads(records("AC"))
