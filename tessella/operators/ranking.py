"""Global ranks and running sums without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window as W

#: Blocks in a run of blocks.
RUN = 4096
#: Hex digits of a hash that make its block: 65,536 blocks a group.
HASH_DIGITS = 4


def hash_key(seed: str, *columns: str) -> Column:
    """Reproducible random order: SHA-256 of the seed and the columns."""
    return F.sha2(F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def hash_block() -> Column:
    """Block of ``hash_key`` for ``running_sum``."""
    return F.substring("hash_key", 1, HASH_DIGITS)


def running_sum(df: DataFrame, value: Column, order: list[str], block: Column, group: list[str] | None = None, out: str = "before") -> DataFrame:
    """Add ``out``: the sum of ``value`` over earlier rows in ``order`` (of the group).

    ``block`` must not decrease along ``order``. Sums by block are scanned
    first, then each block alone, so no task sorts a whole group. Numeric
    blocks, whose number may grow with the rows, are scanned by runs of
    ``RUN`` in the same way.
    """
    keys = [*(group or []), "_block"]
    blocked = df.withColumn("_block", block).withColumn("_value", value)
    sums = blocked.groupBy(*keys).agg(F.sum("_value").alias("_sum"))
    earlier = W.partitionBy(*(group or [])).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    if isinstance(sums.schema["_block"].dataType, NumericType):
        runs = [*(group or []), "_run"]
        sums = sums.withColumn("_run", F.floor(F.col("_block") / RUN))
        before_run = W.partitionBy(*(group or [])).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
        starts = sums.groupBy(*runs).agg(F.sum("_sum").alias("_all")).select(*runs, F.coalesce(F.sum("_all").over(before_run), F.lit(0)).alias("_start"))
        inside = W.partitionBy(*runs).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
        same_run = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in runs]
        base = sums.join(starts.toDF(*[f"_of_{k}" for k in runs], "_start"), same_run).select(*keys, (F.col("_start") + F.coalesce(F.sum("_sum").over(inside), F.lit(0))).cast("long").alias("_base"))
    else:
        base = sums.select(*keys, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).cast("long").alias("_base"))
    within = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    # Null groups are groups.
    names = [f"_key{i}" for i in range(len(keys))]
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    joined = blocked.join(base.toDF(*names, "_base"), same).drop(*names)
    return joined.withColumn(out, (F.col("_base") + F.coalesce(F.sum("_value").over(within), F.lit(0))).cast("long")).drop("_block", "_value", "_base")


def hash_ranked(df: DataFrame, seed: str, *columns: str, group: list[str] | None = None) -> DataFrame:
    """Add ``hash_key`` and ``hash_rank`` (0-based rank in its order, of the group)."""
    keyed = df.withColumn("hash_key", hash_key(seed, *columns))
    return running_sum(keyed, F.lit(1), ["hash_key"], hash_block(), group, "hash_rank")


def even_parts(rank: Column, total: Column, parts: int) -> Column:
    """Part (0-based) of a 0-based rank: contiguous parts, the first ``total % parts`` one longer."""
    small, more = F.floor(total / parts), total % parts
    wide = more * (small + 1)
    return F.when(rank < wide, F.floor(rank / (small + 1))).otherwise(more + F.floor((rank - wide) / F.greatest(small, F.lit(1)))).cast("int")
