"""What every operator needs from the cluster: a folder that all executors share, tables that cut lineage, and a
join that survives hot keys.

Lineage is only ever cut by a table written to the folder that ``spark.checkpoint.dir`` names, so a lost executor costs
a re-read and nothing else.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Arrow batches end at this many bytes, so that a Python worker's memory does not follow the length of the texts.
ARROW_BATCH_BYTES = 16 << 20

#: Tables of one short row a task are broadcast up to this many rows, and joined by a shuffle beyond.
BROADCAST_ROWS = 200_000

#: A key is hot when it holds more than 1/HOT_PARTS of all rows; so there can be no more than HOT_PARTS hot keys.
HOT_PARTS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder from ``spark.checkpoint.dir``; a temporary one where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="strandline-")
    spark.conf.set("spark.checkpoint.dir", made)
    _staged[made] = spark
    return made


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder. What is written there is removed when the enclosing ``scope`` ends, or else with the
    process."""
    path = f"{shared_dir(spark)}/strandline-{label}-{uuid.uuid4().hex}"
    _staged[path] = spark
    return path


#: Paths given out by this process that were not removed yet.
_staged: dict[str, SparkSession] = {}


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: later steps restart from there."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more; a folder that is gone already is fine."""
    _staged.pop(path, None)
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may have ended
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file:"), ignore_errors=True)


@contextmanager
def scope() -> Iterator[None]:
    """Remove on leaving what was staged inside: ``with scope(): df.transform(...).write...``. Results that are still to be
    read must be written or collected inside."""
    before = set(_staged)
    try:
        yield
    finally:
        for path in [x for x in _staged if x not in before]:
            remove(_staged[path], path)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when their query ends, instead of when the driver happens to collect its garbage.
    For queries that run once, as those of ``stage`` do; another run of the same DataFrame shuffles again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@atexit.register
def _remove_all() -> None:
    for path, spark in list(_staged.items()):
        remove(spark, path)


def bound_arrow_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes, unless the session's limit is lower."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = "".join(filter(str.isdigit, spark.conf.get(key)))
    if int(now) > ARROW_BATCH_BYTES:
        spark.conf.set(key, str(ARROW_BATCH_BYTES))


def small(df: DataFrame, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it was counted to have no more than ``most_rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def join_groups(records: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of records with one row per group, where a group may hold a third of all records.

    ``size`` is the column of ``groups`` with the number of records in the group and ``total`` the number of records.
    Groups of more than total / HOT_PARTS records (at most HOT_PARTS of them, whatever the data) are broadcast and
    their records never move; all others meet in a shuffled join in which no key is larger than that.
    """
    limit = max(1, total // HOT_PARTS)
    hot = groups.filter(F.col(size) > limit)
    if hot.isEmpty():
        return records.join(groups, keys)
    cold = records.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return records.join(F.broadcast(hot), keys).unionByName(cold.join(groups.filter(F.col(size) <= limit), keys))


def positions(df: DataFrame, dense: bool | None = None) -> DataFrame:
    """``df`` with ``idx`` counted anew from 0 in its order where it has gaps, as after a filter.

    ``dense`` tells what is known of idx; if nothing is, one aggregation over that column alone finds out.
    """
    if dense is None:
        low, high, n = df.agg(F.min("idx"), F.max("idx"), F.count("idx")).first()
        dense = n == 0 or (low == 0 and high == n - 1)
    if dense:
        return df
    return numbered(df.orderBy("idx"), "__position", "positions").withColumn("idx", F.col("__position")).drop("__position")


def numbered(df: DataFrame, column: str, label: str = "numbered") -> DataFrame:
    """``df`` with each row's position, from 0, in the order of its partitions and of the rows within them.

    The rows are written once with their place in their partition; the counts of the partitions, one row a task and so no
    more than there are files, are added up and joined back. So no task sees more than its own partition, as it would with an unpartitioned
    row_number, and the numbers can't change when a task runs again.
    """
    placed = stage(df.withColumn("__at", F.monotonically_increasing_id()), label)
    task, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit(2**33 - 1))
    sizes = placed.groupBy(task.alias("__task")).agg(F.count(F.lit(1)).alias("__n"))
    order = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("__task", F.coalesce(F.sum("__n").over(order), F.lit(0)).alias("__before"))
    few = len(placed.inputFiles()) <= BROADCAST_ROWS
    out = placed.withColumn("__task", task).withColumn("__place", place).join(F.broadcast(before) if few else before, "__task")
    return out.withColumn(column, F.col("__before") + F.col("__place")).drop("__at", "__task", "__place", "__before")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application; where it is installed there this changes nothing."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="strandline-ship-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
