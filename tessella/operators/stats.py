"""Exact corpus statistics: five percentile rules by rank, modes and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Rank rules for quantile q of n sorted values (0-based index).
RULES = {
    "floor": lambda n, q: F.floor(n * F.lit(q)),
    "clamped": lambda n, q: F.least(n - 1, F.floor(n * F.lit(q))),
    "inner": lambda n, q: F.floor(F.lit(q) * (n - 1)),
    "ceil": lambda n, q: F.ceil(F.lit(q) * n) - 1,
}


def value_ranks(df: DataFrame, group: list[str], value: str, width: int = 4096, times: str | None = None) -> DataFrame:
    """Distinct values per group with how many rows lie ``before`` and ``upto`` each, and the group's ``total``.

    Equal values are counted before any sort. The counts are summed by ranges
    of ``width`` and each range is sorted alone, so no task and no buffer holds
    all values of a group; choose a width that few thousand distinct values
    share. ``times`` names a column that says how many rows a row stands for.
    """
    rows = F.count(F.lit(1)) if times is None else F.sum(times)
    counts = df.groupBy(*group, value).agg(rows.alias("n_value")).withColumn("_range", F.floor(F.col(value) / width))
    ranges = counts.groupBy(*group, "_range").agg(F.sum("n_value").alias("_n"))
    sums = ranges.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_range").alias("_r"),
        F.coalesce(F.sum("_n").over(W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
        F.sum("_n").over(W.partitionBy(*group)).alias("total"),
    )
    same = [F.col("_range") == F.col("_r")] + [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    upto = W.partitionBy(*group, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = counts.join(sums, same).withColumn("upto", F.col("_base") + F.sum("n_value").over(upto))
    return ranked.select(*group, value, "n_value", "total", "upto", (F.col("upto") - F.col("n_value")).alias("before"))


def rank_percentiles(df: DataFrame, group: list[str], value: str, wanted: dict[str, tuple[str, float]], width: int = 4096, times: str | None = None) -> DataFrame:
    """Exact elements by rank: ``wanted`` maps an output name to (rule, quantile); see ``value_ranks``."""
    ranked = value_ranks(df.where(F.col(value).isNotNull()), group, value, width, times)

    def pick(rule: str, q: float) -> Column:
        rank = RULES[rule](F.col("total"), q)
        return F.max(F.when((F.col("before") <= rank) & (rank < F.col("upto")), F.col(value)))

    return ranked.groupBy(*group).agg(*[pick(*w).alias(name) for name, w in wanted.items()])


def linear_percentile(df: DataFrame, group: list[str], value: str, q: float, out: str, times: str | None = None, width: int = 4096) -> DataFrame:
    """Exact percentile with linear interpolation between the two elements around rank q (n - 1)."""
    ranked = value_ranks(df.where(F.col(value).isNotNull()), group, value, width, times)
    place = F.lit(q) * (F.col("total") - 1)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("before") <= rank) & (rank < F.col("upto")), F.col(value)))

    ends = ranked.groupBy(*group).agg(at(F.floor(place)).alias("_low"), at(F.ceil(place)).alias("_high"), F.max(place - F.floor(place)).alias("_part"))
    return ends.select(*group, (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias(out))


def token_stats(df: DataFrame, group: list[str], value: str, budget: int) -> DataFrame:
    """Rows, total, mean, maximum, median, p95 and rows over the budget, per group."""
    sums = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(value).cast("long").alias("total_tokens"),
        F.avg(value).alias("avg_tokens"),
        F.max(value).cast("long").alias("max_tokens"),
        F.sum((F.col(value) > budget).cast("long")).alias("n_over"),
    )
    ranks = rank_percentiles(df, group, value, {"p50": ("clamped", 0.5), "p95": ("clamped", 0.95)})
    return sums.join(ranks, group)


def mode_by_group(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Most frequent value per group (ties: the smallest) and its share."""
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*group).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("_b"), F.sum("n").alias("_all"), F.count(F.lit(1)).alias("n_variants"))
    return best.select(*group, F.col("_b.v").alias("mode_value"), (-F.col("_b.m")).alias("mode_count"), "n_variants", (-F.col("_b.m") / F.col("_all")).alias("mode_share"))
