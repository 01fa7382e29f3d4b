"""Problems 1 to 5 against brute force, with nulls, empty and repeated rows, ties, empty tables and clashing names."""

import random
import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import chunking, formatting, frequent, queries, sample, seen

SEQ = "idx long, sequence string"


def letters(s):
    return re.sub("[^A-Za-z]", "", s or "").upper()


@pytest.fixture(scope="module")
def dirty(spark):
    """Few distinct sequences in many spellings, one of them a third of all rows."""
    rng = random.Random(3)
    base = ["ACGT" * 5, "acgt" * 5, "TTTTGGGG", "", None, "  ", "123", "A-C*G T\r\n", "ACGT", "acgt", "é" * 3 + "AC"]
    rows = []
    for i in range(600):
        s = base[0] if i % 3 == 0 else rng.choice(base)
        if s and rng.random() < 0.3:
            at = rng.randrange(len(s))
            s = s[:at] + rng.choice([" ", "\n", "\t", "-", ""]) + s[at:]
        rows.append((i, s, "x", "y"))
    return spark.createDataFrame(rows, "idx long, sequence string, n string, h string"), [(i, s) for i, s, *_ in rows]


class TestFrequent:
    def test_against_counter(self, dirty):
        df, rows = dirty
        want = Counter(s for _, s in rows if s)
        order = sorted(want.items(), key=lambda x: (-x[1], x[0].encode()))
        got = [tuple(r) for r in frequent.frequent_items(df, "sequence", k=5).collect()]
        assert got == order[:5]

    def test_share_counts_null_and_empty_rows(self, spark):
        df = spark.createDataFrame([("A",)] * 2 + [("B",)] + [(None,)] * 3 + [("",)] * 4, "sequence string")
        assert [r.item for r in frequent.frequent_items(df, "sequence", min_share=0.2).collect()] == ["A"]
        assert frequent.frequent_items(df, "sequence", min_share=0.1).count() == 2

    def test_ties_and_empty(self, spark):
        df = spark.createDataFrame([("b",), ("a",), ("c",)], "item string")
        assert [r.item for r in frequent.frequent_items(df, "item", k=2).collect()] == ["a", "b"]
        assert frequent.frequent_items(df.limit(0), "item", k=2).count() == 0
        assert frequent.frequent_items(df.limit(0), "item", min_share=0.5).count() == 0

    def test_arguments(self, spark):
        df = spark.createDataFrame([("b",)], "item string")
        with pytest.raises(ValueError):
            frequent.frequent_items(df, "item")
        with pytest.raises(ValueError):
            frequent.frequent_items(df, "item", min_share=0.0)


def brute_seen(rows, known=()):
    keys, out = {re.sub("[ \t\r\n]", "", k) for k in known}, set()
    for i, s in sorted(rows, key=lambda x: x[0]):
        key = re.sub("[ \t\r\n]", "", s or "")
        if re.search("[A-Za-z]", key):
            if key in keys:
                out.add(i)
            keys.add(key)
    return out


class TestSeen:
    @pytest.mark.parametrize("bits,fanout,batches", [(64, 3, 4), (2, 2, 6), (64, 2, 1)])
    def test_against_set(self, spark, dirty, bits, fanout, batches):
        df, rows = dirty
        known = spark.createDataFrame([(0, "TTTTGGGG"), (1, None), (2, "acgt")], SEQ)
        got, store = seen.seen_before({"t": df}, known, batches=batches, hash_bits=bits, fanout=fanout)
        assert {r.idx for r in got.collect()} == brute_seen(rows, ["TTTTGGGG", "acgt"])
        report = seen.error_report(got, store, ["t"]).first()
        assert report.verified_wrong == 0
        assert (report.hash_only_wrong > 0) == (bits == 2)

    def test_a_lost_key_is_reported(self, spark, monkeypatch):
        df = spark.createDataFrame([(0, "AC"), (1, "GG"), (2, "A C"), (3, "GG")], SEQ)
        got, store = seen.seen_before({"t": df}, batches=2)
        assert seen.error_report(got, store, ["t"]).first().verified_wrong == 0
        unknown = seen.SeenStore.unknown
        monkeypatch.setattr(seen.SeenStore, "unknown", lambda self, keys, _: unknown(self, keys, []) if self.runs() else keys)
        got, store = seen.seen_before({"t": df}, batches=2)
        assert seen.error_report(got, store, ["t"]).first().verified_wrong == 2

    def test_tables_do_not_mix(self, spark):
        one = spark.createDataFrame([(0, "AC"), (1, "GG")], SEQ)
        two = spark.createDataFrame([(0, "AC"), (1, "A C")], SEQ)
        got, _ = seen.seen_before({"one": one, "two": two})
        assert [tuple(r) for r in got.collect()] == [("two", 1)]

    def test_late_rows_and_empty(self, spark):
        late = spark.createDataFrame([(5, "AC"), (1, "AC"), (3, "AC"), (None, "AC"), (9, "--")], SEQ)
        assert sorted(r.idx for r in seen.seen_before({"t": late})[0].collect()) == [3, 5]
        assert seen.seen_before({"t": late.limit(0)})[0].count() == 0

    def test_runs_are_neither_shuffled_nor_sorted(self, spark, dirty):
        store = seen.SeenStore(spark)
        rows = seen.keys_of(dirty[0], 0)
        store.add(rows.filter("at < 300"))
        new = rows.filter("at >= 300").groupBy(store.hashed(F.col("key")).alias("h"), "key").agg(F.min("at"))
        plan = store.unknown(new)._jdf.queryExecution().executedPlan().toString()
        run = plan[plan.index("SortMergeJoin") :].split("Scan parquet spark_catalog")[0].split("\n")[-4:]
        assert not any("Exchange" in x or "Sort" in x for x in run), plan
        store.add(rows.filter("at >= 300"))
        assert len(store.runs()) == 2
        assert store.stored().count() == len({re.sub("[ \t\r\n]", "", s) for _, s in dirty[1] if re.search("[A-Za-z]", s or "")})
        store.close()
        assert not store.paths

    def test_a_small_batch_reads_few_blocks(self, spark):
        store = seen.SeenStore(spark, buckets=64)
        text = lambda col: F.concat(F.lit("AC"), col.cast("string"))
        many = spark.range(2000).select(F.lit(0).alias("scope"), text(F.col("id")).alias("key"), F.col("id").alias("at"))
        store.add(many)
        few = [(0, f"AC{i}", 5000 + i) for i in (3, 700, 5001, 5002, 5003, 5004)]
        plans, unknown = [], store.unknown
        store.unknown = lambda keys, hashes: plans.append(unknown(keys, hashes)) or plans[0]
        answer = store.add(spark.createDataFrame(few, "scope int, key string, at long"))
        assert sorted(r["at"] for r in answer.collect()) == [5003, 5700]
        opened = re.search(r"SelectedBucketsCount: (\d+) out of 64", plans[0]._jdf.queryExecution().executedPlan().toString())
        assert int(opened.group(1)) <= 6
        store.close()

class TestFormatting:
    def pairs(self, rows):
        groups = {}
        for i, s in rows:
            if letters(s):
                groups.setdefault(letters(s), []).append(i)
        return {(min(g), i) for g in groups.values() for i in g if i != min(g)}

    def test_against_groups(self, dirty):
        df, rows = dirty
        got = formatting.copies(df, "idx", formatting.sequence_fields())
        assert {tuple(r) for r in got.collect()} == self.pairs(rows)

    def test_colliding_fingerprints(self, dirty, monkeypatch):
        df, rows = dirty
        monkeypatch.setattr(formatting, "multiset_hash", lambda *a, **k: F.lit(1).cast("long"))
        got = formatting.copies(df, "idx", formatting.sequence_fields())
        assert {tuple(r) for r in got.collect()} == self.pairs(rows)

    def test_collapse_counts_copies_and_headers(self, spark):
        df = spark.createDataFrame(
            [(0, ">A1 OS=x LEN=2", "AC"), (1, ">A1|LEN=2;OS=x", "a c"), (2, ">B OS=y LEN=2", "A-C"), (3, None, "G"), (4, ">", None)],
            "idx long, header string, sequence string",
        )
        got = formatting.collapse(df, "idx", formatting.sequence_fields(), F.col("header"))
        assert sorted(tuple(r) for r in got.collect()) == [(0, 3, 2), (3, 1, 1)]
        assert formatting.collapse(df.limit(0), "idx", formatting.sequence_fields(), F.col("header")).count() == 0

    def test_attributes(self, spark):
        heads = [(">A OS=a b;LEN=2 | FN=x y\r",), (">A [no such]",), (None,), (">A FN=",)]
        got = spark.createDataFrame(heads, "h string").select(formatting.attributes(F.col("h"))).collect()
        assert [r[0] for r in got] == [["OS=A B", "LEN=2", "FN=X Y"], [], [], ["FN="]]

    def test_collapse_counts_many_headers_exactly(self, spark):
        df = spark.range(3000).select(F.col("id").alias("idx"), F.format_string(">A N=%d;M=1", F.col("id") % 777).alias("header"), F.lit("ac").alias("sequence"))
        got = formatting.collapse(df, "idx", formatting.sequence_fields(), F.col("header"))
        assert [tuple(r) for r in got.collect()] == [(0, 3000, 777)]

    def test_several_fields_ignore_their_order(self, spark):
        df = spark.createDataFrame([(0, "a b", "C!"), (1, "AB", "c"), (2, "c", "ab")], "idx long, p string, q string")
        fields = {"p": formatting.squashed(F.col("p")), "q": formatting.squashed(F.col("q"))}
        back = dict(reversed(fields.items()))
        for one in (fields, back):
            assert [tuple(r) for r in formatting.copies(df, "idx", one).collect()] == [(0, 1)]


class TestSample:
    def test_is_the_k_smallest_keys(self, spark):
        df = spark.range(5000).select(F.col("id").alias("idx"), F.lit(None).cast("string").alias("n"))
        key = sample.sample_key(7, F.col("idx"))
        want = {r.idx for r in df.orderBy(key).limit(100).collect()}
        assert {r.idx for r in sample.fixed_size_sample(df, 100, ["idx"], 7).collect()} == want

    def test_failed_bounds_are_widened(self, spark):
        df = spark.range(2000).withColumnRenamed("id", "idx")
        assert sample.fixed_size_sample(df, 50, ["idx"], 1, delta=0.999999).count() == 50

    def test_small_inputs(self, spark):
        df = spark.range(7).withColumnRenamed("id", "idx")
        assert sample.fixed_size_sample(df, 10, ["idx"]).count() == 7
        assert sample.fixed_size_sample(df, 7, ["idx"]).count() == 7
        assert sample.fixed_size_sample(df, 0, ["idx"]).count() == 0
        assert sample.fixed_size_sample(df.limit(0), 3, ["idx"]).count() == 0
        same = spark.createDataFrame([(1,)] * 20, "idx int")
        assert sample.fixed_size_sample(same, 5, ["idx"]).count() == 5

    def test_pieces_give_the_same_as_the_whole(self, spark):
        df = spark.range(3000).withColumnRenamed("id", "idx")
        pieces = sample.PieceSampler(40, sample.sample_key(3, F.col("idx")))
        for low, high in ((0, 10), (10, 10), (10, 1500), (1500, 1501), (1501, 3000)):
            pieces.add(df.filter((F.col("idx") >= low) & (F.col("idx") < high)))
        whole = sample.fixed_size_sample(df, 40, ["idx"], 3)
        assert {r.idx for r in pieces.result().collect()} == {r.idx for r in whole.collect()}

    def test_registered_sample_takes_batches_as_they_arrive(self, spark, tmp_path, monkeypatch):
        batch = F.when(F.col("id") % 50 == 0, None).otherwise(3 + F.col("id") % 11).cast("int").alias("batch_no")
        df = spark.range(2000).select(F.col("id").alias("idx"), F.lit("AC").alias("sequence"), F.lit(">x").alias("header"), batch)
        for name in ("fasta_reads", "fastq_reads"):
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        sizes, add = [], sample.PieceSampler.add
        monkeypatch.setattr(sample.PieceSampler, "add", lambda self, piece: (sizes.append(piece.count()), add(self, piece))[1])
        got = queries.p4_sample(spark, str(tmp_path)).collect()
        assert len(sizes) >= 8 and sum(sizes) % 2000 == 0 and max(sizes) < 2000
        key = sample.sample_key(queries.SAMPLE_SEED, F.col("idx"))
        for name, k in (("fastq_reads", queries.SAMPLE_READS), ("fasta_reads", queries.SAMPLE_HEADERS)):
            want = sorted(r.idx for r in df.orderBy(key).limit(k).collect())
            assert sorted(r.idx for r in got if r.tbl == name) == want
        again = sample.sample_pieces(sample.arrived(df, "batch_no"), 100, ["idx"], queries.SAMPLE_SEED, 0.9)
        assert sorted(r.idx for r in again.collect()) == want

    def test_a_hot_id_ends_without_bounds(self, spark, monkeypatch):
        seed, number = 0, lambda i, s: int(hashlib.md5(f"{s}:{i}".encode()).hexdigest()[:12], 16) / 2**48
        while not 0.7 < number(-1, seed) < 0.9:
            seed += 1
        deltas, bounds = [], sample.bounds
        monkeypatch.setattr(sample, "bounds", lambda k, n, delta: (deltas.append(delta), bounds(k, n, delta))[1])
        monkeypatch.setattr(sample, "stage", lambda df, label: df if len(deltas) < 40 else pytest.fail("it never ends"))
        df = spark.range(5000).select(F.when(F.col("id") < 4000, -1).otherwise(F.col("id")).alias("idx"))
        got = Counter(r.idx for r in sample.fixed_size_sample(df, 1000, ["idx"], seed).collect())
        assert sum(got.values()) == 1000 and deltas[-1] == 0
        assert set(got) - {-1} == {i for i in range(4000, 5000) if number(i, seed) < number(-1, seed)}

    def test_every_row_is_equally_likely(self, spark):
        df = spark.range(60).withColumnRenamed("id", "idx")
        times = Counter(r.idx for seed in range(60) for r in sample.fixed_size_sample(df, 15, ["idx"], seed).collect())
        # 60 draws of a quarter: mean 15, standard deviation 3.4
        assert min(times[i] for i in range(60)) > 2 and max(times.values()) < 30


class TestChunking:
    def record(self, rng, n, gaps=()):
        codes = rng.choice(np.frombuffer(b"ACGT", np.uint8), n)
        for at, size in gaps:
            codes[at : at + size] = ord("N")
        return codes.tobytes().decode()

    def test_gaps(self, spark):
        rng = np.random.default_rng(1)
        rows = [
            (0, self.record(rng, 6000, [(0, 10), (200, 9), (5990, 10)])),
            (1, self.record(rng, 5001)),
            (2, self.record(rng, 5000, [(100, 50)])),
            (3, None),
            (4, ""),
        ]
        rows[1] = (1, rows[1][1].lower()[:2500] + "\n  *" + rows[1][1][2500:])
        got = chunking.natural_boundaries(spark.createDataFrame(rows, SEQ)).select("idx", "gap_start").collect()
        assert sorted(map(tuple, got)) == [(0, 0), (0, 5990), (1, -1)]

    def test_pieces_cover_overlap_and_cut_at_gaps(self, spark):
        rng = np.random.default_rng(2)
        text = self.record(rng, 32000, [(4000, 30), (12345, 10), (20000, 600)])
        got = chunking.split_oversized(spark.createDataFrame([(0, text), (1, "AC")], SEQ)).orderBy("piece_no").collect()
        assert got[0].piece_start == 0 and got[-1].piece_end == len(text) and {r.idx for r in got} == {0}
        for a, b in zip(got, got[1:]):
            assert b.piece_start == a.piece_end - 200
        starts = [m.start() for m in re.finditer("N{10,}", text)]
        for r in got:
            assert r.piece == text[r.piece_start : r.piece_end] and len(r.piece) <= 5000
            reach = [g for g in starts if r.piece_start + 1000 <= g <= r.piece_start + 5000]
            if r.cut_by != "end":
                assert (r.cut_by == "gap") == bool(reach)
                assert r.cut_by != "gap" or r.piece_end in reach

    def test_gaps_come_with_the_pieces(self, spark, monkeypatch):
        rng, whole = np.random.default_rng(8), chunking._chunks
        gaps = [(40, 10), (4000, 30), (4700, 12), (12345, 10), (20000, 600), (31980, 20)]
        df = spark.createDataFrame([(0, self.record(rng, 32000, gaps)), (1, self.record(rng, 9000))], SEQ)
        expected = {(0, a, a + n) for a, n in gaps} | {(1, -1, -1)}
        got = [tuple(r) for r in chunking.natural_boundaries(df).collect()]
        assert len(got) == len(expected) and set(got) == expected
        monkeypatch.setattr(chunking, "_chunks", lambda *a: whole(*a).filter("piece_no = 0"))
        end = chunking.split_oversized(df.filter("idx = 0")).first().piece_end
        assert {r.gap_start for r in chunking.natural_boundaries(df.filter("idx = 0")).collect()} == {
            a for a, _ in gaps if a < end - 200
        }

    def test_an_edit_changes_only_neighbours(self):
        rng = np.random.default_rng(4)
        text = self.record(rng, 60000)
        other = text[:30000] + "ACGTACG" + text[30000:]
        pieces = []
        for t in (text, other):
            codes = np.frombuffer(t.encode(), np.uint8)
            pieces.append({t[a:b] for a, b, _ in chunking.cut_points(codes, np.zeros(0, np.int64), 5000, 200, 1000, 32)})
        assert len(pieces[0] - pieces[1]) <= 4 and len(pieces[0]) > 12

    def test_arguments_and_empty(self, spark):
        df = spark.createDataFrame([], SEQ)
        assert chunking.split_oversized(df).count() == 0 and chunking.natural_boundaries(df).count() == 0
        with pytest.raises(ValueError):
            chunking.split_oversized(df, overlap=2000)
