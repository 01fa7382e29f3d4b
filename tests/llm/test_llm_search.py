"""Problems 6 to 8 against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import leaks, neardup, queries, spans
from strandline.llm.letters import pack, unpack

SEQ = "idx long, sequence string"


def letters(s):
    return re.sub("[^A-Za-z]", "", s or "").upper()


def brute_spans(rows, known, w):
    where = {}
    texts = [(i, letters(s)) for i, s in enumerate(s for _, s in rows)] + [(-1 - i, letters(s)) for i, s in enumerate(known)]
    for i, s in texts:
        for p in range(len(s) - w + 1):
            where.setdefault(s[p : p + w], set()).add(i)
    out = set()
    for (idx, _), (i, s) in zip(rows, texts):
        shared = [False] * len(s)
        for p in range(len(s) - w + 1):
            if len(where[s[p : p + w]]) > 1:
                shared[p : p + w] = [True] * w
        for m in re.finditer("x+", "".join("x" if b else "." for b in shared)):
            out.add((idx, m.start(), m.end()))
    return out


def sequences(seed, n):
    """Families with edits, copies, moved blocks, repeats of one letter, junk and nulls."""
    rng = random.Random(seed)
    pick = lambda size, alphabet="ACGT": "".join(rng.choice(alphabet) for _ in range(size))
    bases = [pick(rng.randrange(60, 300)) for _ in range(4)] + [pick(150, "ACDEFGHIKLMNPQRSTVWY")]
    rows = []
    for i in range(n):
        kind, s = rng.random(), rng.choice(bases)
        if kind < 0.2:
            pass
        elif kind < 0.6:
            at = rng.randrange(len(s))
            s = s[:at] + rng.choice(["", "A", pick(7)]) + s[at + rng.randrange(3) :]
        elif kind < 0.75:
            at = rng.randrange(len(s))
            s = s[at:] + s[:at]
        elif kind < 0.85:
            s = pick(rng.randrange(1, 120)) + "N" * rng.choice([30, 90, 130]) + pick(30)
        elif kind < 0.9:
            s = "A" * rng.randrange(5, 200)
        else:
            s = rng.choice([None, "", "***", "acg", pick(80)])
        if s and rng.random() < 0.3:
            s = s[: len(s) // 2].lower() + "\n" + s[len(s) // 2 :]
        rows.append((i, s))
    return rows


def sorted_batches(batches):
    table = pa.Table.from_batches(batches).sort_by("part")
    return table.combine_chunks().to_batches()


class TestSpans:
    @pytest.mark.parametrize("seed,group", [(1, 1 << 21), (2, 300), (3, 1500)])
    def test_against_brute_force(self, spark, seed, group):
        rows = sequences(seed, 60)
        known = ["ACGT" * 30, letters(rows[5][1])[:70], letters(rows[5][1])[:70]]
        df = spark.createDataFrame(rows, SEQ).withColumn("s", F.lit("clash")).repartition(3)
        lib = spark.createDataFrame(list(enumerate(known)), SEQ)
        got = spans.shared_spans(df, lib, min_len=40, prefix=12, group=group)
        assert {tuple(r) for r in got.collect()} == brute_spans(rows, known, 40)

    @pytest.mark.parametrize("seed", range(40))
    def test_records_of_few_blocks(self, seed):
        """Blocks that recur within records and between them, through the kernels alone."""
        rng = random.Random(seed)
        blocks = ["".join(rng.choice("ACGT") for _ in range(rng.choice([5, 20, 41, 60]))) for _ in range(5)]
        texts = sorted({"".join(rng.choice(blocks) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(2, 9))})
        batch = pa.RecordBatch.from_pydict({"s": texts, "rec": list(range(len(texts)))})
        out = list(spans._cutter(40, 12, 3)(iter([batch])))
        runs = list(spans._builder(40)(iter(sorted_batches(out))))
        got = {(r, p) for x in runs for r, a, b in zip(*x.to_pydict().values()) for p in range(a, b)}
        assert got == {
            (i, p)
            for i, t in enumerate(texts)
            for p in range(len(t) - 39)
            if any(t[p : p + 40] in other for j, other in enumerate(texts) if j != i)
        }

    def test_without_known_and_empty(self, spark):
        rows = [(0, "ACGTTGCA" * 10), (1, None), (2, "acgttgca" * 10), (3, "G" * 59)]
        df = spark.createDataFrame(rows, SEQ)
        assert {tuple(r) for r in spans.shared_spans(df).collect()} == {(0, 0, 80), (2, 0, 80)}
        assert spans.shared_spans(df.limit(0)).count() == 0

    def test_chunks_of_a_task_share_what_is_settled(self, monkeypatch):
        rng = random.Random(6)
        base = "".join(rng.choice("ACGT") for _ in range(100))
        rows = [(i, base + "".join(rng.choice("ACGT") for _ in range(30))) for i in range(40)] + sequences(6, 30)
        sent = []
        for chunk, room in ((1 << 22, 1 << 24), (400, 1 << 24), (400, 500)):
            monkeypatch.setattr(spans, "_CHUNK", chunk)
            monkeypatch.setattr(spans.Settled.__init__, "__defaults__", (room,))
            texts = [letters(s).encode() for _, s in rows if len(letters(s)) >= 40]
            batch = pa.RecordBatch.from_pydict({"s": [t.decode() for t in texts], "rec": list(range(len(texts)))})
            out = list(spans._cutter(40, 12, 5)(iter([batch])))
            sent.append(sum(len(b) for x in out for b in x["blob"].to_pylist() if b))
            runs = list(spans._builder(40)(iter(sorted_batches(out))))
            got = {(r, p) for x in runs for r, a, b in zip(*x.to_pydict().values()) for p in range(a, b)}
            want = {
                (i, p)
                for i, t in enumerate(texts)
                for p in range(len(t) - 39)
                if any(t[p : p + 40] in other for j, other in enumerate(texts) if j != i)
            }
            assert got == want
        assert sent[0] < sent[1] < sent[2]

    def test_suffixes_are_sorted_by_their_letters(self):
        rng = np.random.default_rng(3)
        for alphabet, depth in ((b"AB", 40), (b"ACGT", 13), (b"ACGTNXYZ", 60), (b"A", 25), (b"AC", 5)):
            text = rng.choice(np.frombuffer(alphabet, np.uint8), 900)
            text[300:400] = text[500:600]
            at = rng.permutation(900 - depth)[:700]
            order, common = spans.sorted_suffixes(text, at, depth)
            found = [text[a : a + depth].tobytes() for a in at[order]]
            assert found == sorted(found)
            for one, other, n in zip(found, found[1:], common[1:]):
                same = next((i for i in range(depth) if one[i] != other[i]), depth)
                assert n <= same and (n == depth) == (same == depth)

    @pytest.mark.parametrize("seed", range(12))
    def test_lengthened_prefixes_change_nothing(self, seed):
        """As in ``test_records_of_few_blocks``, with every, some or no bucket taken for too large."""
        rng = random.Random(seed)
        blocks = ["".join(rng.choice("ACGT") for _ in range(rng.choice([5, 20, 41, 60]))) for _ in range(5)] + ["N" * 70]
        texts = sorted({"".join(rng.choice(blocks) for _ in range(rng.randrange(1, 7))) for _ in range(8)})
        batch = pa.RecordBatch.from_pydict({"s": texts, "rec": list(range(len(texts)))})
        want = {
            (i, p)
            for i, t in enumerate(texts)
            for p in range(len(t) - 39)
            if any(t[p : p + 40] in other for j, other in enumerate(texts) if j != i)
        }
        every = np.arange(1 << 12)
        some = np.sort(np.random.default_rng(seed).choice(every, 2000, replace=False))
        for large in ([], [some], [every], [every, some], [every, every, every], [some, every, some]):
            out = list(spans._cutter(40, 12, 3, large)(iter([batch])))
            runs = list(spans._builder(40)(iter(sorted_batches(out))))
            assert {(r, p) for x in runs for r, a, b in zip(*x.to_pydict().values()) for p in range(a, b)} == want

    def test_a_motif_in_a_third_of_records_makes_no_large_group(self, spark):
        rng = np.random.default_rng(5)
        dna = np.frombuffer(b"ACGT", np.uint8)
        motif = rng.choice(dna, 59)
        largest, most = {}, 600
        assert spans.prefix_lengths(60, 20) == [20, 40, 50, 60]
        for n in (3000, 9000):
            codes = rng.choice(dna, (n, 160))
            codes[::3, 40:99] = motif
            data = [(i, c.tobytes().decode()) for i, c in enumerate(codes)]
            texts = spark.createDataFrame(data, "rec long, s string").repartition(4)
            large = spans.large_groups(texts, 60, 20, most, 20, most)
            lengths = np.full(n, 160)
            _, _, plain, _ = spans.grouped(codes.reshape(-1), lengths, 60, 20, [], 20)
            at, _, group, _ = spans.grouped(codes.reshape(-1), lengths, 60, 20, large, 20)
            assert len(large) == 3 and np.unique(plain, return_counts=True)[1].max() > n // 3
            _, place, size = np.unique(group, return_index=True, return_counts=True)
            # What is larger still is one run of 60 letters over and over, which travels once a task.
            for g, p in zip(group[place[size > most]], place[size > most]):
                assert len({codes.reshape(-1)[x : x + 60].tobytes() for x in at[group == g]}) == 1
            largest[n] = size[size <= most].max()
        assert largest[9000] <= most


def brute_pairs(rows, k=10):
    first = {}
    for i, s in rows:
        if letters(s):
            first.setdefault(letters(s), i)
    sets = [(i, {s[p : p + k] for p in range(len(s) - k + 1)}) for s, i in first.items()]
    sets = [x for x in sets if x[1]]
    return {
        (min(i, j), max(i, j))
        for a, (i, x) in enumerate(sets)
        for j, y in sets[:a]
        if 2 * len(x & y) >= len(x | y)
    }


class TestNearDuplicates:
    @pytest.mark.parametrize("seed", [4, 5])
    def test_against_brute_force(self, spark, seed):
        rows = sequences(seed, 150)
        df = spark.createDataFrame(rows, SEQ).withColumn("a", F.lit("clash"))
        got = {tuple(r)[:2] for r in neardup.similar_pairs(df).collect()}
        want = brute_pairs(rows)
        assert got <= want and len(got) >= 0.98 * len(want) > 50

    def test_edges(self, spark):
        df = spark.createDataFrame([(0, "ACGTACGTAC"), (1, "acgtacgt AC"), (2, None), (3, "ACG"), (4, "ACGTACGTACG")], SEQ)
        assert {tuple(r) for r in neardup.similar_pairs(df).collect()} == {(0, 4, 1, 2)}
        assert neardup.similar_pairs(df.limit(0)).count() == 0
        with pytest.raises(ValueError):
            neardup.similar_pairs(df, k=13)

    def test_keys_do_not_depend_on_chunks(self, monkeypatch):
        rng = np.random.default_rng(1)
        lengths = rng.integers(0, 300, 200)
        codes = rng.choice(np.frombuffer(b"ACGT", np.uint8), lengths.sum())
        one = neardup.fingerprints(codes, lengths, 10, 4, 2)
        monkeypatch.setattr(neardup, "_CHUNK", 777)
        two = neardup.fingerprints(codes, lengths, 10, 4, 2)
        assert all((x == y).all() for x, y in zip(one, two))

    def test_keys_agree_as_often_as_sets_overlap(self):
        rng = np.random.default_rng(3)
        base = rng.choice(np.frombuffer(b"ACGT", np.uint8), 3000)
        other = np.concatenate((base[:1500], rng.choice(np.frombuffer(b"ACGT", np.uint8), 1500)))
        _, keys = neardup.fingerprints(np.concatenate((base, other)), np.array([3000, 3000]), 10, 600, 1)
        grams = [{t[i : i + 10].tobytes() for i in range(len(t) - 9)} for t in (base, other)]
        assert abs((keys[0] == keys[1]).mean() - len(grams[0] & grams[1]) / len(grams[0] | grams[1])) < 0.06

    @pytest.mark.parametrize("alphabet", ["ACGT", "ACGTN", "A", "QWERTY"])
    def test_packed_texts(self, alphabet):
        rng = np.random.default_rng(4)
        texts = ["", "A", "ACGTA"] + ["".join(rng.choice(list(alphabet), rng.integers(0, 40))) for _ in range(50)]
        codes, lengths = np.frombuffer("".join(texts).encode(), np.uint8), np.array([len(t) for t in texts])
        packed = pack(codes, lengths)
        for low in (0, 3):
            back, sizes = unpack(packed.slice(low))
            assert back.tobytes().decode() == "".join(texts[low:]) and sizes.tolist() == lengths[low:].tolist()
        assert len(packed[2].as_py()) == 3
        assert unpack(pack(codes[:0], lengths[:0]))[0].size == 0

    def test_signatures_bound_what_is_shared(self):
        rng = np.random.default_rng(9)
        texts = ["".join(rng.choice(list("ACGT"), rng.integers(5, 400))) for _ in range(60)]
        texts += [t[: len(t) // 2] + texts[0] for t in texts]
        codes, lengths = np.frombuffer("".join(texts).encode(), np.uint8), np.array([len(t) for t in texts])
        words, sizes = neardup.signatures(codes, lengths, 10), neardup._sizes(pack(codes, lengths), 10)
        sets = [{t[i : i + 10] for i in range(len(t) - 9)} for t in texts]
        assert sizes.tolist() == [len(s) for s in sets]
        for x, a in zip(words, sets):
            for y, b in zip(words, sets):
                assert len(a & b) <= len(a) - int(np.bitwise_count(x & ~y).sum())

    def test_hot_keys_lose_no_pair(self, spark, monkeypatch):
        """An adapter in a third of the reads, which alone makes no two of them similar."""
        rng = np.random.default_rng(2)
        dna = lambda n: "".join(rng.choice(list("ACGT"), n))
        adapter, rows = dna(40), []
        for i in range(900):
            rows.append(((adapter if i % 3 == 0 else dna(40)) + dna(60)))
        for i in range(0, 90, 3):
            rows.append(rows[i][:50] + "A" + rows[i][51:])
        rows = list(enumerate(rows))
        table = spark.createDataFrame(rows, SEQ)
        plain = {tuple(r) for r in neardup.similar_pairs(table).collect()}
        monkeypatch.setattr(neardup.candidate_pairs, "__defaults__", (12,))
        assert {tuple(r) for r in neardup.similar_pairs(table).collect()} == plain and len(plain) >= 20
        # Hardly any pair that has no more in common than the adapter leaves its cell.
        texts = neardup.distinct_texts(table, "idx", "sequence", 10)
        hot = neardup.candidate_pairs(texts, 10, 16, 2, (1, 2), 12).count()
        assert hot < neardup.candidate_pairs(texts, 10, 16, 2, (1, 2), 10**6).count() / 4

    def test_pairs_that_meet_by_chance_are_not_written(self, spark, monkeypatch):
        """Reads share an adapter and few are similar: what goes to disk follows the similar ones, under no hot key."""
        rng = np.random.default_rng(12)
        dna = lambda n: "".join(rng.choice(list("ACGT"), n))
        adapter = dna(40)
        rows = [adapter + dna(rng.integers(50, 300)) for _ in range(500)]
        rows += [r[:50] + "A" + r[51:] for r in rows[:40]]
        rows = list(enumerate(rows))
        written, plain = {}, neardup.stage

        def counted(df, label):
            out = plain(df, label)
            written[label] = written.get(label, 0) + out.count()
            return out

        monkeypatch.setattr(neardup, "stage", counted)
        got = {tuple(r)[:2] for r in neardup.similar_pairs(spark.createDataFrame(rows, SEQ)).collect()}
        assert got == brute_pairs(rows) and 30 <= len(got) < 100
        assert len(got) <= written["near-pairs"] < 3 * len(got)
        assert written["near-band"] < neardup.BANDS * 3 * len(got)

    def test_bounds_hold_for_bitmaps_of_any_size(self):
        rng = np.random.default_rng(10)
        texts = ["".join(rng.choice(list("ACGT"), int(n))) for n in 10 ** rng.uniform(1, 3.5, 50)] + ["A" * 500]
        texts += [t[: len(t) * 2 // 3] + texts[0] for t in texts] + [t[len(t) // 10 :] + "ACGT" * 3 for t in texts]
        codes, lengths = np.frombuffer("".join(texts).encode(), np.uint8), np.array([len(t) for t in texts])
        sets = [{t[i : i + 10] for i in range(len(t) - 9)} for t in texts]
        n = np.array([len(s) for s in sets])
        words = 1 << np.ceil(np.log2(np.maximum(n / 32, 1))).astype(np.int64)
        edge = np.concatenate(([0], np.cumsum(words)))
        flat = neardup.signatures(codes, lengths, 10, words)
        marks = neardup.Bitmaps(n, pa.array([flat[a:b].tobytes() for a, b in zip(edge, edge[1:])], pa.binary()))
        x, y = (a.reshape(-1) for a in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
        near = marks.near(x, y, (1, 2))
        true = np.array([2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b]) for a, b in zip(x, y)])
        assert len(set(words.tolist())) > 4 and near[true].all() and true.sum() > len(texts) + 20
        assert (near & ~true).sum() < 0.1 * len(x)

    def test_long_substrings(self, spark, monkeypatch):
        rows = sequences(7, 120)
        df, want = spark.createDataFrame(rows, SEQ), brute_pairs(rows, 12)
        for hot in (neardup.HOT, 5):
            monkeypatch.setattr(neardup.candidate_pairs, "__defaults__", (hot,))
            got = {tuple(r)[:2] for r in neardup.similar_pairs(df, k=12).collect()}
            assert got <= want and len(got) >= 0.98 * len(want) > 50

    def test_classes(self, spark):
        links = [(1, 2), (2, 3), (3, 4), (4, 5), (7, 8), (10, 11), (10, 12), (10, 13)]
        pairs = spark.createDataFrame(links, "idx_a long, idx_b long")
        texts = spark.range(14).withColumnRenamed("id", "idx")
        got = {r.idx: (r.class_id, r.n_links) for r in neardup.classes(pairs, texts).collect()}
        assert len(got) == 14
        assert [got[i][0] for i in (1, 2, 3, 4, 5, 7, 8, 10, 11, 12, 13)] == [1] * 5 + [7] * 2 + [10] * 4
        assert got[10][1] == 3 and got[3][1] == 2 and got[0] == (0, 0)

    def test_large_ids_and_hubs(self, spark):
        low = 5 * 10**18
        pairs = spark.range(1, 3000).select(F.lit(low).alias("idx_a"), (F.col("id") + low).alias("idx_b"))
        texts = spark.range(3001).select((F.col("id") + low).alias("idx"))
        got = {r.idx: (r.class_id, r.n_links) for r in neardup.classes(pairs, texts).collect()}
        assert got[low] == (low, 2999) and got[low + 7] == (low, 1) and got[low + 3000] == (low + 3000, 0)

    def test_every_record_has_a_class(self, spark, tmp_path):
        rng = random.Random(6)
        text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
        hot, lone = text(200), text(120)
        near = hot[:100] + "G" + hot[101:]
        rows = [(i, hot if i % 3 else hot.lower() + " ") for i in range(20, 60)]  # a hot text, and its copies in other spellings
        rows += [(3, near), (70, near), (5, lone), (80, lone), (6, "ACG"), (81, "a-cg"), (7, None), (8, ""), (9, "--")]
        table = spark.createDataFrame(rows, SEQ)
        for name in ("fasta_reads", "fastq_reads"):
            table.write.parquet(f"{tmp_path}/{name}.parquet")
        got = queries.p7_classes(spark, str(tmp_path)).collect()
        expected = {(i, 3, 1) for i in (*range(20, 60), 3, 70)} | {(5, 5, 0), (80, 5, 0), (6, 6, 0), (81, 6, 0)}
        for name in ("fasta_reads", "fastq_reads"):
            one = [(r.idx, r.class_id, r.n_links) for r in got if r.tbl == name]
            assert len(one) == len(expected) and set(one) == expected


def words(t):
    return [w.lower() for w in re.findall(r"[^\W_]+", t or "")]


def brute_leaks(docs, items, n):
    out = set()
    for i, t in items:
        w = words(t)
        runs = {tuple(w[p : p + n]) for p in range(len(w) - n + 1)}
        for d, s in docs:
            v = words(s)
            if any(tuple(v[p : p + n]) in runs for p in range(len(v) - n + 1)):
                out.add((d, i))
    return out


class TestLeaks:
    @pytest.fixture(scope="class")
    def tables(self):
        rng = random.Random(8)
        vocabulary = ["the", "of", "É", "straße", "x1", "42"] + [f"w{i}" for i in range(60)]
        text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
        items = [(i, text(rng.randrange(5, 60))) for i in range(25)] + [(90, None), (91, ""), (92, "the " * 20)]
        docs = []
        for d in range(120):
            t = text(rng.randrange(1, 200)).split()
            if rng.random() < 0.7:
                w = rng.choice(items[:25])[1].split()
                n = rng.choice([12, 13, 14, 30])
                at = rng.randrange(max(1, len(w) - n + 1))
                part = w[at : at + n]
                where = rng.randrange(len(t))
                t[where:where] = part
            docs.append((d, rng.choice([" ", ", ", "\n", "_"]).join(t).upper() if d % 3 else " ".join(t)))
        return docs + [(500, None), (501, "  "), (502, "THE_the, the;the " * 10)], items

    @pytest.mark.parametrize("rows,bits", [(200_000, 27), (1, 27), (200_000, 5)])
    def test_against_brute_force(self, spark, tables, monkeypatch, rows, bits):
        """With a filter of good size and with one that says yes to everything, by a broadcast and by a shuffle."""
        monkeypatch.setattr(leaks, "_BROADCAST", rows)
        monkeypatch.setattr(leaks, "MOST_BITS", bits)
        docs, items = tables
        d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1))
        got = leaks.leaks(d, spark.createDataFrame(items, "item_id long, text string"))
        want = brute_leaks(docs, items, 13)
        assert {tuple(r) for r in got.collect()} == want and len(want) > 30 and (502, 92) in want

    def test_filter_holds_its_keys_and_few_others(self, spark):
        keys = leaks._key(3, np.arange(20_000))
        held = leaks.Filter.of(spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "key long"))
        assert held(keys).all() and held(leaks._key(4, np.arange(20_000))).mean() < 0.005
        assert not leaks.Filter.of(spark.createDataFrame([], "key long"))(keys).any()

    def test_empty(self, spark, tables):
        docs, items = tables
        d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        assert leaks.leaks(d.limit(0), i).count() == 0 and leaks.leaks(d, i.limit(0)).count() == 0

    def test_permutations_follow_the_size_class(self):
        assert leaks.permutations_for(9, 9) == 1
        counts = [leaks.permutations_for(s, 9) for s in leaks.SIZES]
        assert counts == sorted(counts) and (1 - 9 / 24) ** counts[-1] <= leaks.MISS


def test_very_long_texts(spark):
    """Texts far longer than a chunk or an Arrow batch's usual row, beside short ones."""
    rng = np.random.default_rng(12)
    long = rng.choice(np.frombuffer(b"ACGT", np.uint8), 400_000).tobytes().decode()
    edited = long[:200_000] + "T" + long[200_000:]
    df = spark.createDataFrame([(0, long), (1, edited), (2, "ACGT"), (3, long[5000:5100])], SEQ)
    pairs = {tuple(r)[:2] for r in neardup.similar_pairs(df).collect()}
    assert pairs == {(0, 1)}
    found = {tuple(r) for r in spans.shared_spans(df).collect()}
    assert {(0, 0, 400_000), (3, 0, 100)} <= found and {r[0] for r in found} == {0, 1, 3}
    text = " ".join(f"w{i}" for i in rng.integers(0, 5000, 100_000))
    item = " ".join(text.split(" ")[77_000:77_013])
    docs = spark.createDataFrame([(1, text), (2, text[:50])], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [tuple(r) for r in leaks.leaks(docs, items).collect()] == [(1, 7)]
