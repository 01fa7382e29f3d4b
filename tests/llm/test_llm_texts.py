"""Problems 9 and 10."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import mixing, quality

TARGETS = "source string, target_share double, max_repeats int"


class TestMix:
    @pytest.fixture(scope="class")
    def tables(self, spark):
        rng = random.Random(2)
        word = lambda: rng.choice(["the", "valve", "closes", "a", "42", "Größe"])
        rows = []
        for i in range(900):
            source = "big" if i % 3 else rng.choice(["mid", "small", None, "other"])
            text = rng.choice([None, ""]) if i % 50 == 0 else " ".join(word() for _ in range(rng.randrange(1, 60)))
            rows.append((i, source, text, 7))
        docs = spark.createDataFrame(rows, "doc_id long, source string, text string, key int")
        return docs, spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 3), ("none", 0.1, 2)], TARGETS)

    def test_counts_are_the_tokenizer_s(self, spark, tables):
        encoding = mixing.load_encoding(f"{mixing.TOKENIZERS}/{mixing.VOCABULARY}")
        text = {r.doc_id: r.text for r in tables[0].collect()}
        for r in mixing.token_counts(tables[0]).collect():
            assert r.n_tokens == (len(encoding.encode(text[r.doc_id])) if text[r.doc_id] else 0)
            assert encoding.decode(encoding.encode_ordinary(text[r.doc_id] or "")) == (text[r.doc_id] or "")

    def test_shares_and_repeats(self, tables):
        mixed, report = mixing.mix(*tables)
        rows = {r.source: r for r in report.collect()}
        assert set(rows) == {"big", "mid", "small", "none"} and rows["none"].mixed_tokens == 0
        for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.1)):
            assert abs(rows[s].actual_share - share / 0.9) < 0.01
            assert rows[s].most_copies <= rows[s].max_repeats
        assert abs(sum(r.actual_share for r in rows.values()) - 1) < 1e-9
        got = mixed.collect()
        assert len({r.doc_id for r in got}) == len(got) and all(r.n_tokens > 0 and r.copies > 0 for r in got)
        assert sum(r.n_tokens * r.copies for r in got) == sum(r.mixed_tokens for r in rows.values())

    def test_threshold_takes_the_smallest_keys(self, spark):
        rng = np.random.default_rng(1)
        keys = rng.integers(0, 2**60, 3000)
        keys[1:40] = keys[0] + np.arange(1, 40)  # one crowded bucket
        data = [(int(k), "s", int(t)) for k, t in zip(keys, rng.integers(1, 50, len(keys)))]
        sizes = spark.createDataFrame(data, "key long, source string, n_tokens long")
        ordered = sorted(data)
        for want in (0, 1, 500, sum(t for k, _, t in data if k < keys[20]) + 3, 70_000, 10**9):
            limit = mixing.thresholds(sizes, {"s": want})["s"]
            took = sum(t for k, _, t in data if k < limit)
            best, total = 0, 0
            for _, _, t in ordered:
                best = total + t if abs(total + t - want) < abs(best - want) else best
                total += t
            assert abs(took - want) == abs(best - want)

    def test_ten_thousand_sources(self, spark):
        sizes = spark.range(40_000).select(
            F.concat(F.lit("s"), F.col("id") % 10_000).alias("source"), F.shiftright(F.abs(F.xxhash64("id")), 4).alias("key"), F.lit(10).cast("long").alias("n_tokens")
        )
        limits = mixing.thresholds(sizes, {f"s{i}": 20 for i in range(10_000)})
        rule = spark.createDataFrame(list(limits.items()), "source string, below long")
        taken = sizes.join(rule, "source").filter("key < below").groupBy("source").count()
        assert taken.count() == 10_000 and taken.filter("count <> 2").isEmpty()

    def test_larger_budgets_contain_smaller_ones(self, tables):
        small, large = (mixing.mix(*tables, total=n)[0] for n in (500, 900))
        a = {r.doc_id: r.copies for r in small.collect()}
        b = {r.doc_id: r.copies for r in large.collect()}
        assert all(b.get(d, 0) >= c for d, c in a.items()) and len(a) < len(b)

    def test_a_source_gives_no_more_than_its_repeats(self, tables):
        mixed, report = mixing.mix(*tables, total=10**7)
        rows = {r.source: r for r in report.collect()}
        assert all(rows[s].mixed_tokens == rows[s].available_tokens * rows[s].max_repeats for s in rows)

    def test_empty(self, spark, tables):
        docs, targets = tables
        mixed, report = mixing.mix(docs.limit(0), targets)
        assert mixed.count() == 0 and [r.actual_share for r in report.collect()] == [0.0] * 4
        mixed, report = mixing.mix(docs, targets.limit(0))
        assert mixed.count() == 0 and report.count() == 0


PROSE = "The valve is opened by the lever, and the pump is stopped when it has been closed. It follows that the seal may be worn.\n"
TABLE = "\n".join(f"S-{i}\t{i * 0.37:.2f}\t{i * 91}\t{i % 7}" for i in range(20)) + "\n"
LIST = "\n".join(f"{i} cylindrical hydrovalve" for i in range(10, 60, 2)) + "\n"
NOISE = "\n".join("A™|[AI Ã] ﬀ 1%:¢€[ $]~" for _ in range(12)) + "\n"


class TestQuality:
    @pytest.fixture(scope="class")
    def common(self, spark):
        words = "the is by and when it has been that may be of to a".split()
        return spark.createDataFrame([("en", w) for w in words] + [("en", None)], "lang string, word string")

    @pytest.fixture(scope="class")
    def docs(self, spark):
        rows = []
        for i in range(200):
            kind = i % 5
            text = [PROSE * 5, PROSE.replace(" ", "\n", 3) * 4, PROSE + TABLE * 3, LIST * (1 + i % 3), NOISE][kind]
            rows.append((i, text, kind < 2))
        return spark.createDataFrame(rows + [(900, None, None), (901, " \n\t", None)], "doc_id long, text string, n_words boolean")

    def test_statistics(self, spark, common):
        text = "The cat, the DOG.\n\n  x1 y_z!  \nend"
        df = spark.createDataFrame([(1, text), (2, "!!!")], "doc_id long, text string")
        got = {r.doc_id: r for r in quality.quality_statistics(df, common).collect()}
        r = got[1]
        assert r.n_words == 8 and r.mean_word_length == 19 / 8 and r.symbol_ratio == 4 / len(text)
        assert r.punct_line_share == 2 / 3 and r.common_share == 2 / 8 and r.words_per_line == 8 / 3
        assert got[2].n_words == 0 and got[2].mean_word_length == 0.0 and got[2].symbol_ratio == 1.0

    def test_types(self, docs, common):
        rows = quality.typed_documents(docs, common).collect()
        assert len(rows) == 200
        for r in rows:
            assert (r.p_prose > 0.5) == (r.doc_id % 5 < 2), r
            assert abs(r.p_prose + r.p_listing + r.p_junk - 1) < 1e-9
            if r.doc_id % 5 == 4:
                assert r.text_type == "junk"

    def test_empty(self, docs, common):
        assert quality.typed_documents(docs.limit(0), common).count() == 0
        assert quality.typed_documents(docs, common.limit(0)).count() == 200

    def test_em_finds_the_good_function(self):
        rng = np.random.default_rng(0)
        truth = rng.integers(0, 3, 4000)
        right = np.array([0.95, 0.8, 0.8, 0.6])
        votes = np.where(rng.random((4000, 4)) < right, truth[:, None], rng.integers(0, 3, (4000, 4)))
        patterns, which, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
        found = quality.fit(patterns, counts.astype(float)).argmax(axis=1)[which.reshape(-1)]
        majority = np.array([np.bincount(v, minlength=3).argmax() for v in votes])
        assert (found == truth).mean() > max(0.93, (majority == truth).mean())

    def test_line_between_sentences(self):
        text = "\n".join(["the pump is", "cylindrical", "the end is near", "12 34"])
        inside = quality.measure([text, "the", ""], quality.CommonWords(["the", "is"]))[:, -1]
        assert inside.tolist() == [37 / 42, 1.0, 0.0]

    def test_against_one_text_at_a_time(self):
        rng, known = random.Random(4), ["the", "is", "größe", "x1", "a"]
        parts = ["the", "THE", "is", "Größe", "x1", "thee", "İs", "½", "_", "a_b", "\t", " ", "\x0b", "\r", "\n", "\n\n", " \n ", ".", ":", "—", "९", "7"]
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 60))) for _ in range(400)]
        got = quality.measure(texts, quality.CommonWords(known))
        assert np.array_equal(got, [one_by_one(t, set(known)) for t in texts])
        assert quality.measure([], quality.CommonWords([])).shape == (0, 8)


def one_by_one(text, known):
    words = re.findall(r"[^\W_]+", text)
    lines = [x for x in (line.strip(" \t\r\f") for line in text.split("\n")) if x]
    over = lambda a, b: a / b if b else 0.0
    kinds = []
    for line in lines:
        w = re.findall(r"[^\W_]+", line)
        common = sum(x.lower() in known for x in w)
        kinds.append(bool(common) and common >= 0.1 * len(w) and sum(map(len, w)) >= 0.5 * len(line))
    size = sum(map(len, lines))
    inside = sum(len(x) for i, x in enumerate(lines) if kinds[i] or (0 < i < len(lines) - 1 and kinds[i - 1] and kinds[i + 1]))
    return [
        len(words),
        over(sum(map(len, words)), len(words)),
        over(sum(not c.isalnum() and c not in " \t\r\n\f" for c in text), len(text)),
        over(sum(x[-1] in ".!?;:" for x in lines), len(lines)),
        over(sum(w.lower() in known for w in words), len(words)),
        over(sum(c in "0123456789" for c in text), size),
        over(len(words), len(lines)),
        over(inside, size),
    ]


def test_all_queries_have_results(spark):
    from strandline.llm.queries import QUERIES

    for query in QUERIES.values():
        assert not query(spark, "/root/testdata/sf0.001").isEmpty()
