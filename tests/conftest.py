import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("siftline-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


PLAIN = [
    "2023-06-02 09:30:00 DEBUG  cache warmed with 12 keys",
    "2023-06-02 09:30:04 ERROR  payment gateway unreachable via eu-west:7001",
    "2023-06-02 09:30:04 INFO  order 88 queued",
    "2023-06-02 09:31:20 WARN  queue depth 95%",
    "2023-06-02 09:31:45 INFO  order 88 gateway answered",
    "2023-06-02 09:33:10 FATAL  ledger volume is read-only",
    "2023-06-02 09:33:11 ERROR  payment gateway unreachable via eu-west:7002",
    "2023-06-02 09:40:00 INFO  shutdown",
]


@pytest.fixture
def lines(spark):
    """Lines given as a list, as positioned lines."""

    def make(texts, file="app.log"):
        rows = [(file, i, i, t) for i, t in enumerate(texts, 1)]
        return spark.createDataFrame(rows, "file STRING, lineno BIGINT, seq BIGINT, raw STRING")

    return make


@pytest.fixture
def plain(lines):
    return lines(PLAIN)


@pytest.fixture
def large(spark):
    """10,000 lines made in Spark; every fourth is an error, every fourth a warning."""
    level = F.element_at(F.array(*map(F.lit, ["INFO", "ERROR", "WARN", "INFO"])), (F.col("id") % 4 + 1).cast("int"))
    raw = F.format_string("2023-06-%02d 10:%02d:00 %s shard %d flushed", F.col("id") % 28 + 1, F.col("id") % 60, level, "id")
    seq = F.col("id") + 1
    return spark.range(10_000).select(F.lit("app.log").alias("file"), seq.alias("lineno"), seq.alias("seq"), raw.alias("raw"))
