"""Token counts kept by content fingerprint, so that only new texts are counted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(text: Column) -> Column:
    """SHA-256 of a text; a null text counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache at ``path``: fingerprint, tokens; empty where there is none yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    schema = "fingerprint string, tokens bigint"
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def refresh(docs: DataFrame, text: str, path: str, count: Callable[[Column], Column]) -> None:
    """Count the texts of ``docs`` that the cache at ``path`` does not hold and append them.

    Fingerprints are compared by an anti-join of narrow rows; counts, not texts,
    are shuffled, and a text is entered once, however many rows hold it. What is
    appended appears when the job commits, so a lost executor leaves no half of it.
    """
    known = read_cache(docs.sparkSession, path).select("fingerprint")
    own = docs.select(fingerprint(F.col(text)).alias("fingerprint"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    fresh = own.join(known, "fingerprint", "left_anti").select("fingerprint", count(F.col("_text")).cast("long").alias("tokens"))
    fresh.groupBy("fingerprint").agg(F.first("tokens").alias("tokens")).write.mode("append").parquet(path)


def with_tokens(docs: DataFrame, text: str, path: str) -> DataFrame:
    """``docs`` with ``fingerprint`` and ``tokens`` of the cache; rows that it does not hold have null tokens."""
    keyed = docs.withColumn("fingerprint", fingerprint(F.col(text)))
    return keyed.join(read_cache(docs.sparkSession, path), "fingerprint", "left")
