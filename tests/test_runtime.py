"""The shared folder, numbering and joins with hot keys."""

import __spark_entry__
from pyspark.sql import functions as F

from strandline.runtime import join_groups, numbered, scope, shared_dir, stage


def test_tables_lie_in_the_shared_folder(spark):
    path = stage(spark.range(3), "t").inputFiles()[0]
    assert shared_dir(spark).removeprefix("file://") in path


def test_scopes_clean_up(spark):
    from pathlib import Path

    with scope():
        path = Path(stage(spark.range(3), "t").inputFiles()[0].removeprefix("file://")).parent
        assert path.exists()
    assert not path.exists()


def test_numbers_are_dense(spark):
    df = numbered(spark.range(1000).repartition(7).sortWithinPartitions("id"), "n")
    assert sorted(r.n for r in df.collect()) == list(range(1000)) and df.columns == ["id", "n"]


def test_hot_groups_join_like_all_others(spark):
    records = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 500).alias("k"))
    groups = records.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    want = {(r.id, r.first) for r in records.join(groups, "k").collect()}
    assert {(r.id, r.first) for r in join_groups(records, groups, ["k"], "n", 9000).collect()} == want
    assert {(r.id, r.first) for r in join_groups(records, groups, ["k"], "n", 10**9).collect()} == want


def test_entry_names():
    names, checks = set(__spark_entry__.queries()), set(__spark_entry__.oracle_sql())
    assert checks <= names and "filter_stats" in names
