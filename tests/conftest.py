import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(root / "warehouse"))
        .config("spark.checkpoint.dir", f"file://{root / 'shared'}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def reads(spark):
    """A FASTQ relation from (header, sequence, quality) triples, numbered in order."""

    def make(*rows):
        data = [(i, h, s, q) for i, (h, s, q) in enumerate(rows)]
        return spark.createDataFrame(data, "idx long, header string, sequence string, quality string")

    return make


@pytest.fixture(scope="session")
def records(spark):
    """A FASTA relation from sequences, with headers >seq1, >seq2, ..."""

    def make(*sequences):
        data = [(i, f">seq{i + 1}", s) for i, s in enumerate(sequences)]
        return spark.createDataFrame(data, "idx long, header string, sequence string")

    return make
