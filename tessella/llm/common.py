"""Helpers that several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.operators.staging import discard, shared_folder, staged  # noqa: F401

#: A word is a maximal run of characters other than space and TAB..CR.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_offset(df: DataFrame, group: list[str], salt: str, order: list, value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the earlier rows of the group.

    ``salt`` is the coarse leading part of the order. Sums by (group, salt) are
    scanned first and each salt is then scanned alone, so a group that holds a
    third of all rows spreads over as many tasks as it has salts. ``df`` is
    read twice: pass a narrow staged table. Rows equal in group, salt and
    order must be interchangeable.
    """
    keys = [*group, salt]
    before = W.partitionBy(*group).orderBy(salt).rowsBetween(W.unboundedPreceding, -1)
    base = (
        df.groupBy(*keys)
        .agg(F.sum(value).alias("_part"))
        .select(*keys, F.coalesce(F.sum("_part").over(before), F.lit(0)).cast("long").alias("_base"))
    )
    within = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        df.join(base, keys)
        .withColumn(out, (F.col("_base") + F.coalesce(F.sum(value).over(within), F.lit(0))).cast("long"))
        .drop("_base")
    )
