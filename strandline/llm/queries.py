"""The pN_ queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import chunking, formatting, frequent, leaks, mixing, neardup, quality, sample, seen, spans
from strandline.llm.letters import letters
from strandline.runtime import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Share of all rows that makes a sequence a frequent one.
FREQUENT_SHARE = 0.005
SAMPLE_SEED = 42
SAMPLE_READS, SAMPLE_HEADERS = 500, 100


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_LETTERS = "upper(regexp_replace(sequence, '[^A-Za-z]', '', 'g'))"
_KEY = r"regexp_replace(sequence, '[ \t\r\n]', '', 'g')"


@_query(
    "SELECT sequence FROM fastq_reads WHERE sequence <> '' GROUP BY sequence "
    "HAVING count(*) >= 0.005 * (SELECT count(*) FROM fastq_reads)"
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each non-empty sequence that makes up at least 0.5 % of all rows of fastq_reads."""
    reads = _table(spark, sf_dir, "fastq_reads")
    return frequent.frequent_items(reads, "sequence", min_share=FREQUENT_SHARE).select(F.col("item").alias("sequence"))


@_query(
    "SELECT sequence AS item, count(*) AS n FROM fastq_reads WHERE sequence <> '' GROUP BY sequence "
    "ORDER BY n DESC, item LIMIT 100"
)
def p1_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 most frequent sequences of fastq_reads and their counts."""
    return frequent.frequent_items(_table(spark, sf_dir, "fastq_reads"), "sequence", k=100)


_READS = ("fasta_reads", "fastq_reads")


def _seen(spark: SparkSession, sf_dir: str):
    tables = {t: _table(spark, sf_dir, t) for t in _READS}
    return seen.seen_before(tables, _table(spark, sf_dir, "control_library"))


def _seen_sql(table: str) -> str:
    return (
        f"SELECT '{table}' AS tbl, idx FROM (SELECT idx, {_KEY} AS k, min(idx) OVER (PARTITION BY {_KEY}) AS f FROM {table}) "
        f"WHERE regexp_matches(k, '[A-Za-z]') AND (idx > f OR k IN (SELECT {_KEY} FROM control_library))"
    )


@_query(_seen_sql("fasta_reads") + " UNION ALL " + _seen_sql("fastq_reads"))
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of fasta_reads and fastq_reads whose key was seen before."""
    found, store = _seen(spark, sf_dir)
    store.close()  # the answers are kept
    return found


@_query(
    "SELECT tbl, count(*) AS distinct_keys, CAST(0 AS BIGINT) AS hash_only_wrong, CAST(0 AS DOUBLE) AS hash_only_rate, "
    "CAST(0 AS BIGINT) AS verified_wrong FROM ("
    + " UNION ".join(
        f"SELECT '{t}' AS tbl, {_KEY} AS k FROM {s} WHERE regexp_matches({_KEY}, '[A-Za-z]')"
        for t in ("fasta_reads", "fastq_reads")
        for s in (t, "control_library")
    )
    + ") GROUP BY tbl"
)
def p2_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of wrong answers of p2_found, with the hash alone and with the full key verified."""
    found, store = _seen(spark, sf_dir)
    report = stage(seen.error_report(found, store, list(_READS)), "seen-report")
    store.close()
    return report


@_query(
    f"SELECT f AS idx_a, idx AS idx_b FROM (SELECT idx, min(idx) OVER (PARTITION BY {_LETTERS}) AS f FROM fasta_reads "
    f"WHERE {_LETTERS} <> '') WHERE idx <> f"
)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the smallest idx and each other idx of the records of fasta_reads with equal letters."""
    return formatting.copies(_table(spark, sf_dir, "fasta_reads"), "idx", formatting.sequence_fields())


_ATTRIBUTES = (
    r"list_sort(list_transform(string_split(regexp_replace(coalesce(header, ''), '([A-Z]+=)', chr(1) || '\1', 'g'), chr(1))[2:], "
    "lambda x: upper(rtrim(x, ' ;|' || chr(9) || chr(10) || chr(13)))))"
)


@_query(
    f"SELECT min(idx) AS idx, count(*) AS n_copies, count(DISTINCT {_ATTRIBUTES}) AS n_headers FROM fasta_reads WHERE {_LETTERS} <> '' GROUP BY {_LETTERS}"
)
def p3_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each distinct letters of fasta_reads, with its number of copies and of different headers."""
    reads = _table(spark, sf_dir, "fasta_reads")
    return formatting.collapse(reads, "idx", formatting.sequence_fields(), F.col("header"))


_U = "CAST(CAST('0x' || substr(md5('{seed}:' || idx), 1, 12) AS BIGINT) AS DOUBLE)"


@_query(
    f"(SELECT 'fastq_reads' AS tbl, idx, sequence AS item FROM fastq_reads ORDER BY {_U.format(seed=SAMPLE_SEED)} LIMIT {SAMPLE_READS}) "
    f"UNION ALL (SELECT 'fasta_reads' AS tbl, idx, header AS item FROM fasta_reads ORDER BY {_U.format(seed=SAMPLE_SEED)} LIMIT {SAMPLE_HEADERS})"
)
def p4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A uniform sample of 500 reads and of 100 headers, taken from the batches as they arrived."""
    out = None
    for name, column, k in (("fastq_reads", "sequence", SAMPLE_READS), ("fasta_reads", "header", SAMPLE_HEADERS)):
        rows = _table(spark, sf_dir, name).select(F.lit(name).alias("tbl"), "idx", F.col(column).alias("item"), "batch_no")
        one = sample.sample_pieces(sample.arrived(rows, "batch_no"), k, ["idx"], SAMPLE_SEED).drop("batch_no")
        out = one if out is None else out.unionByName(one)
    return out


_TOKENS = (
    f"SELECT idx, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM (SELECT idx, regexp_extract_all({_LETTERS}, 'N+|[^N]+') AS t "
    f"FROM fasta_reads WHERE length({_LETTERS}) > 5000)"
)


@_query(
    f"WITH t AS ({_TOKENS}), p AS (SELECT idx, w, sum(length(w)) OVER (PARTITION BY idx ORDER BY i) - length(w) AS pos FROM t) "
    "SELECT idx, CAST(pos AS BIGINT) AS gap_start FROM p WHERE w LIKE 'N%' AND length(w) >= 10 UNION ALL "
    "SELECT idx, CAST(-1 AS BIGINT) AS gap_start FROM p GROUP BY idx HAVING count(*) FILTER (w LIKE 'N%' AND length(w) >= 10) = 0"
)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assembly gaps of the records of fasta_reads with more than 5,000 letters."""
    return chunking.natural_boundaries(_table(spark, sf_dir, "fasta_reads")).select("idx", "gap_start")


@_query()
def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of fasta_reads with more than 5,000 letters in pieces of at most 5,000 that overlap by 200."""
    return chunking.split_oversized(_table(spark, sf_dir, "fasta_reads"))


@_query(
    f"SELECT idx, CAST(length({_LETTERS}) AS BIGINT) AS n_letters, md5({_LETTERS}) AS hash, true AS sizes_hold, true AS overlaps_hold, "
    f"true AS gaps_hold FROM fasta_reads WHERE length({_LETTERS}) > 5000"
)
def p5_reassembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of fasta_reads with more than 5,000 letters put together again from their pieces, and whether all pieces
    have at most 5,000 letters, overlap by 200, and end at a gap wherever one can be reached."""
    pieces = chunking.split_oversized(_table(spark, sf_dir, "fasta_reads"))
    parts = F.sort_array(F.collect_list(F.struct("piece_no", "piece_start", "piece_end", "cut_by", "piece")))
    rows = pieces.groupBy("idx").agg(parts.alias("p"))
    new = F.transform("p", lambda x, i: F.when(i == 0, x["piece"]).otherwise(F.substring(x["piece"], 201, 1 << 20)))
    text = F.array_join(new, "")
    sizes = F.forall("p", lambda x: (F.length(x["piece"]) <= 5000) & (F.length(x["piece"]) == x["piece_end"] - x["piece_start"]))
    laps = F.transform("p", lambda x, i: (i == 0) | (x["piece_start"] == F.get("p", i - 1)["piece_end"] - 200))
    # A piece that isn't the last ends at the start of a run of N, or there is none in reach.
    reach = lambda x: F.substring(x["piece"], 1000, 1 << 20)
    gaps = F.forall("p", lambda x: (x["cut_by"] != "landmark") | ~reach(x).rlike("[^N]N{10}"))
    return rows.select(
        "idx",
        F.length(text).cast("long").alias("n_letters"),
        F.md5(text).alias("hash"),
        sizes.alias("sizes_hold"),
        F.forall(laps, lambda x: x).alias("overlaps_hold"),
        gaps.alias("gaps_hold"),
    )


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(_table(spark, sf_dir, "fasta_reads"), _table(spark, sf_dir, "control_library"))


_WINDOWS = (
    f"t AS (SELECT idx, {_LETTERS} AS s FROM fasta_reads UNION ALL SELECT -1 - idx, {_LETTERS} FROM control_library), "
    "l AS (SELECT idx, s FROM t WHERE length(s) >= 60), "
    "w AS (SELECT idx, p, md5_number(substr(s, p + 1, 60)) AS h FROM (SELECT idx, s, unnest(range(length(s) - 59)) AS p FROM l)), "
    "h AS (SELECT h FROM w GROUP BY h HAVING min(idx) <> max(idx)), "
    "q AS (SELECT idx, p FROM w JOIN h USING (h) WHERE idx >= 0), "
    "r AS (SELECT idx, p, CASE WHEN p <= lag(p) OVER (PARTITION BY idx ORDER BY p) + 60 THEN 0 ELSE 1 END AS fresh FROM q), "
    "g AS (SELECT idx, p, sum(fresh) OVER (PARTITION BY idx ORDER BY p) AS k FROM r), "
    "spans AS (SELECT idx, min(p) AS span_start, max(p) + 60 AS span_end FROM g GROUP BY idx, k)"
)


@_query(f"WITH {_WINDOWS} SELECT idx, CAST(span_start AS BIGINT) AS span_start, CAST(span_end AS BIGINT) AS span_end FROM spans")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal runs of shared positions of each record of fasta_reads."""
    return _spans(spark, sf_dir)


@_query(
    f"WITH {_WINDOWS} SELECT t.idx, CAST(length(s) AS BIGINT) AS n_letters, CAST(coalesce(sum(span_end - span_start), 0) AS BIGINT) AS n_shared "
    "FROM t LEFT JOIN spans ON spans.idx = t.idx WHERE t.idx >= 0 AND length(s) > 0 GROUP BY t.idx, s"
)
def p6_shared_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many letters of each record of fasta_reads are shared, of how many."""
    sizes = _table(spark, sf_dir, "fasta_reads").select("idx", F.length(letters(F.col("sequence"))).cast("long").alias("n_letters"))
    amount = _spans(spark, sf_dir).groupBy("idx").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("n_shared"))
    return sizes.filter("n_letters > 0").join(amount, "idx", "left").select(
        "idx", "n_letters", F.coalesce("n_shared", F.lit(0)).alias("n_shared")
    )


def _similar(table: str) -> str:
    """The pairs of a table by shared substrings, all of them counted."""
    return (
        f"SELECT '{table}' AS tbl, a.idx AS idx_a, b.idx AS idx_b FROM (SELECT a.idx AS i, b.idx AS j, count(*) AS c FROM g_{table} a "
        f"JOIN g_{table} b ON a.w = b.w AND a.idx < b.idx GROUP BY 1, 2) JOIN n_{table} a ON a.idx = i JOIN n_{table} b ON b.idx = j "
        "WHERE 2 * c >= a.n + b.n - c"
    )


_GRAMS = ", ".join(
    f"s_{t} AS (SELECT min(idx) AS idx, {_LETTERS} AS s FROM {t} WHERE length({_LETTERS}) >= 10 GROUP BY {_LETTERS}), "
    f"g_{t} AS (SELECT DISTINCT idx, substr(s, p + 1, 10) AS w FROM (SELECT idx, s, unnest(range(length(s) - 9)) AS p FROM s_{t})), "
    f"n_{t} AS (SELECT idx, count(*) AS n FROM g_{t} GROUP BY idx)"
    for t in _READS
)


@_query(f"WITH {_GRAMS} " + " UNION ALL ".join(_similar(t) for t in _READS))
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of different texts within a table whose sets of 10-letter substrings overlap by half or more."""
    parts = [
        neardup.similar_pairs(_table(spark, sf_dir, t)).select(F.lit(t).alias("tbl"), "idx_a", "idx_b") for t in _READS
    ]
    return parts[0].unionByName(parts[1])


@_query(
    f"WITH RECURSIVE {_GRAMS}, pairs AS MATERIALIZED ({' UNION ALL '.join(_similar(t) for t in _READS)}), "
    "ties AS (SELECT tbl, idx_a AS u, idx_b AS v FROM pairs UNION ALL SELECT tbl, idx_b, idx_a FROM pairs), "
    "reach(tbl, u, v) AS (SELECT tbl, u, u FROM ties UNION SELECT reach.tbl, reach.u, ties.v FROM reach JOIN ties ON ties.tbl = reach.tbl "
    "AND ties.u = reach.v), c AS (SELECT tbl, u, min(v) AS class_id FROM reach GROUP BY tbl, u), "
    "n AS (SELECT tbl, u, count(*) AS n_links FROM ties GROUP BY tbl, u), "
    + "m AS ("
    + " UNION ALL ".join(
        f"SELECT '{t}' AS tbl, idx, min(idx) OVER (PARTITION BY {_LETTERS}) AS f FROM {t} WHERE {_LETTERS} <> ''" for t in _READS
    )
    + ") SELECT m.tbl, idx, coalesce(class_id, f) AS class_id, coalesce(n_links, 0) AS n_links FROM m LEFT JOIN c ON c.tbl = m.tbl AND c.u = f "
    "LEFT JOIN n ON n.tbl = m.tbl AND n.u = f"
)
def p7_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each record with letters of both tables and its text's number of links."""
    out = None
    for t in _READS:
        table = _table(spark, sf_dir, t)
        pairs = stage(neardup.similar_pairs(table), "near-links")
        one = neardup.memberships(table, pairs).select(F.lit(t).alias("tbl"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def _runs(table: str, number: str) -> str:
    return (
        f"SELECT DISTINCT {number}, md5_number(array_to_string(w[p + 1 : p + 13], ' ')) AS h FROM (SELECT {number}, w, unnest(range(len(w) - 12)) AS p "
        rf"FROM (SELECT {number}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM {table}) WHERE len(w) >= 13)"
    )


@_query(
    f"SELECT DISTINCT doc_id, item_id FROM ({_runs('documents', 'doc_id')}) d JOIN ({_runs('eval_items', 'item_id')}) i ON d.h = i.h"
)
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 13 or more consecutive words of an evaluation item, and the items."""
    return leaks.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def _mix(spark: SparkSession, sf_dir: str):
    return mixing.mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))


@_query()
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that make up the mix, with how often each is used."""
    return _mix(spark, sf_dir)[0]


@_query()
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target and the actual share of each source."""
    return _mix(spark, sf_dir)[1]


@_query()
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which less than a fifth stands in sentences: those whose text type isn't prose."""
    typed = quality.typed_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "common_words"))
    return typed.filter("p_prose < 0.5").select("doc_id").distinct()


_WORDS = r"regexp_extract_all(text, '[\p{L}\p{N}]+')"
_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(12) || chr(13))), lambda l: l <> '')"


@_query(
    f"WITH d AS (SELECT doc_id, text, {_WORDS} AS w, {_LINES} AS l FROM documents WHERE regexp_matches(text, '[^ \\t\\r\\n\\f]')), "
    "c AS (SELECT list(DISTINCT lower(word)) AS known FROM common_words), "
    "s AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS DOUBLE) AS letters, "
    r"CAST(length(text) - length(regexp_replace(text, '[^\p{L}\p{N} \t\r\n\f]', '', 'g')) AS DOUBLE) AS symbols, length(text) AS n, "
    "CAST(len(list_filter(l, lambda x: regexp_matches(x, '[.!?;:]$'))) AS DOUBLE) AS ends, len(l) AS lines, "
    "CAST(len(list_filter(w, lambda x: list_contains(known, lower(x)))) AS DOUBLE) AS commons FROM d, c) "
    "SELECT doc_id, n_words, CASE WHEN n_words > 0 THEN letters / n_words ELSE 0 END AS mean_word_length, symbols / n AS symbol_ratio, "
    "ends / lines AS punct_line_share, CASE WHEN n_words > 0 THEN commons / n_words ELSE 0 END AS common_share FROM s"
)
def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five statistics of each document's text."""
    one = quality.quality_statistics(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "common_words"))
    return one.select("doc_id", "n_words", "mean_word_length", "symbol_ratio", "punct_line_share", "common_share")


@_query()
def p10_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of each document with the posterior of each text type."""
    return quality.typed_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "common_words"))
