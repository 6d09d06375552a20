"""Intermediate tables, and joins whose small side is measured before it is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrow.session import scratch_path

#: A side is broadcast only if its files are at most this large.
BROADCAST_BYTES = 48 << 20


def put(df: DataFrame, name: str = "llm") -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder; the table read back, and its path."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def kept(df: DataFrame, name: str = "llm") -> DataFrame:
    """``df`` written to the shared folder and read back, which cuts its lineage."""
    return put(df, name)[0]


def table_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files below ``path``, in any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.getContentSummary(place).getLength()


def measured(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` written, with a broadcast hint if its files are at most ``limit`` bytes.

    Beyond the limit it is joined by shuffle like any table; the rows are the same.
    """
    back, path = put(df)
    return F.broadcast(back) if table_bytes(df.sparkSession, path) <= limit else back


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Lets the session hand Python workers at most ``rows`` rows at once. Texts and vectors are
    wide rows: with Spark's default of 10,000 the buffers on both sides take hundreds of MB."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def parts(spark: SparkSession, least: int = 1) -> int:
    """The number of shuffle partitions that the session asks for."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
