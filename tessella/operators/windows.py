"""Ordered-sequence operators: segments, deltas, as-of values, sessions and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.operators.folds import consume_rows, ordered_fold


def _upto(key: list[str], order: list[str]):
    return W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)


def segment_at_marker(df: DataFrame, key: list[str], order: list[str], marker: Column, out: str = "segment") -> DataFrame:
    """Number the rows from each marker on (0-based); rows before the first marker go."""
    return df.withColumn(out, F.sum(F.when(marker, 1).otherwise(0)).over(_upto(key, order)) - 1).where(F.col(out) >= 0)


def local_index(df: DataFrame, key: list[str], order: list[str], modulus: int = 128, out: str = "local_index") -> DataFrame:
    """0-based position in the group, modulo ``modulus``."""
    return df.withColumn(out, ((F.row_number().over(W.partitionBy(*key).orderBy(*order)) - 1) % modulus).cast("int"))


def delta_from_previous(df: DataFrame, key: list[str], order: list[str], tick: Column, out: str = "delta") -> DataFrame:
    """Difference from the previous row's tick, not below 0; the first row has 0."""
    return df.withColumn(out, F.greatest(F.lit(0), F.coalesce(tick - F.lag(tick).over(W.partitionBy(*key).orderBy(*order)), F.lit(0))))


def asof_backward(df: DataFrame, key: list[str], order: list[str], anchor: Column, value: Column, out: str = "anchor_value") -> DataFrame:
    """The value of the latest anchor row at or before each row; null before the first."""
    return df.withColumn(out, F.last(F.when(anchor, value), ignorenulls=True).over(_upto(key, order)))


def asof_forward(df: DataFrame, key: list[str], order: list[str], anchor: Column, value: Column, out: str = "anchor_value") -> DataFrame:
    """The value of the first anchor row at or after each row, else that of the last anchor."""
    ahead = W.partitionBy(*key).orderBy(*order).rowsBetween(W.currentRow, W.unboundedFollowing)
    found = F.when(anchor, value)
    return df.withColumn(out, F.coalesce(F.first(found, ignorenulls=True).over(ahead), F.last(found, ignorenulls=True).over(W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))))


def collapse_repeats(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before."""
    before = F.lag(value).over(W.partitionBy(*key).orderBy(*order))
    return df.withColumn("_same", before.eqNullSafe(F.col(value)) & F.lag(F.lit(True)).over(W.partitionBy(*key).orderBy(*order)).isNotNull()).where("NOT _same").drop("_same")


def gap_sessions(df: DataFrame, key: list[str], order: list[str], tick: Column, gap: int, out: str = "session") -> DataFrame:
    """Number sessions (0-based): a new one starts after a gap of more than ``gap``."""
    far = tick - F.lag(tick).over(W.partitionBy(*key).orderBy(*order)) > gap
    return df.withColumn("_far", F.coalesce(far.cast("int"), F.lit(0))).withColumn(out, F.sum("_far").over(_upto(key, order))).drop("_far")


def onset_groups(df: DataFrame, key: list[str], order: list[str], tick: str, width: int) -> DataFrame:
    """Groups of rows within ``width`` of their group's first row: key, tick, group (0-based), anchor.

    Unlike ``gap_sessions`` a chain of small gaps ends where it leaves the first
    row's reach, which only a fold can say.
    """

    def fold(rows):
        group, anchor = -1, None
        for (at,) in rows:
            if at is not None and (anchor is None or at - anchor > width):
                group, anchor = group + 1, at
            yield at, max(group, 0), anchor

    kind = df.schema[tick].dataType.simpleString()
    return ordered_fold(df, key, order, [tick], f"`{tick}` {kind}, group int, anchor {kind}", fold)


def consume_counts(df: DataFrame, key: list[str], order: list[str], item: str, expected: str, total: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The groups each row consumes when rows take their expected count in turn: key, item, first_group, last_group and the columns of ``keep`` (see ``folds.consume_rows``)."""

    def fold(rows):
        rest = ()

        def bare():
            nonlocal rest
            for own, count, most, *rest in rows:
                yield own, count, most

        for out in consume_rows(bare()):
            yield (*out, *rest)

    kinds = {c: df.schema[c].dataType.simpleString() for c in (item, *keep)}
    schema = ", ".join([f"`{item}` {kinds[item]}", "first_group bigint", "last_group bigint", *[f"`{c}` {kinds[c]}" for c in keep]])
    return ordered_fold(df, key, order, [item, expected, total, *keep], schema, fold)


def interpolate(df: DataFrame, key: list[str], position: str, value: str, out: str = "filled") -> DataFrame:
    """Fill nulls linearly by position between known values; flat beyond the ends."""
    back = _upto(key, [position])
    ahead = W.partitionBy(*key).orderBy(position).rowsBetween(W.currentRow, W.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(position).alias("p"), F.col(value).alias("v")))
    low, high = F.last(known, ignorenulls=True).over(back), F.first(known, ignorenulls=True).over(ahead)
    part = (F.col(position) - F.col("_low.p")) / (F.col("_high.p") - F.col("_low.p"))
    return (
        df.withColumn("_low", low)
        .withColumn("_high", high)
        .withColumn(
            out,
            F.when(F.col(value).isNotNull(), F.col(value))
            .when(F.col("_low").isNull(), F.col("_high.v"))
            .when(F.col("_high").isNull(), F.col("_low.v"))
            .otherwise(F.col("_low.v") + (F.col("_high.v") - F.col("_low.v")) * part),
        )
        .drop("_low", "_high")
    )


def hole_flags(df: DataFrame, key: list[str], order: list[str], flag: Column, before: int = 15, after: int = 15, share: float = 0.75, out: str = "in_hole") -> DataFrame:
    """Whether more than ``share`` of the rows around each row carry the flag."""
    frame = W.partitionBy(*key).orderBy(*order).rowsBetween(-before, after)
    return df.withColumn(out, F.avg(flag.cast("int")).over(frame) > share)


def take_while(df: DataFrame, key: list[str], order: list[str], condition: Column) -> DataFrame:
    """The leading rows of each group that all meet the condition."""
    return df.withColumn("_on", F.min(condition.cast("int")).over(_upto(key, order))).where("_on = 1").drop("_on")


def refined_times(ranges: DataFrame, groups: DataFrame, key: list[str], item: str, nominal: str, group: str, at: str) -> DataFrame:
    """Start and end of items that consumed ranges of groups: key, item, start, end.

    ``ranges`` has key, item, first_group, last_group (null: consumed nothing)
    and the ``nominal`` duration; ``groups`` has key, number and time. An item
    ends one step after its last group: the upper median of its positive steps
    between groups, else its nominal duration. One that consumed nothing ends
    where its nominal time does. Items follow each other without gaps and last
    at least their nominal duration: end = max(start + nominal, own end), which
    is a running maximum over the sums of the durations.
    """
    # Ranges of a key do not overlap, so a group belongs to the range that began last: one table in one order, no join by number.
    follows = W.partitionBy(*key).orderBy(group)
    known = groups.where(" AND ".join(f"`{k}` IS NOT NULL" for k in key)).select(
        *key, F.col(group).cast("long").alias("_pos"), F.lit(1).alias("_side"), F.col(at).alias("_at"), F.lead(group).over(follows).alias("_next"), (F.lead(at).over(follows) - F.col(at)).alias("_step")
    )
    asked = ranges.select(*key, F.col("first_group").alias("_pos"), F.lit(0).alias("_side"), item, F.col("last_group").alias("_last"), nominal)
    placed = W.partitionBy(*key).orderBy("_pos", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    taker = F.when((F.col("_side") == 0) & F.col("_pos").isNotNull(), F.struct(F.col(item).alias("item"), F.col("_last").alias("last")))
    met = asked.unionByName(known, allowMissingColumns=True).withColumn("_own", F.last(taker, ignorenulls=True).over(placed))
    inside = (F.col("_side") == 1) & (F.col("_pos") <= F.col("_own.last"))
    step = F.when(inside & (F.col("_next") <= F.col("_own.last")) & (F.col("_step") > 0), F.col("_step"))
    owned = met.where((F.col("_side") == 0) | inside).withColumn(item, F.when(F.col("_side") == 0, F.col(item)).otherwise(F.col("_own.item"))).withColumn("_step", step)
    ended = F.when(F.col("_side") == 1, F.struct("_pos", "_at"))
    told = owned.groupBy(*key, item).agg(F.max(nominal).alias(nominal), F.max(ended).alias("_end"), F.sort_array(F.collect_list("_step")).alias("_steps"))
    order = W.partitionBy(*key).orderBy(item)
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = told.withColumn("_sum", F.sum(nominal).over(upto))
    median = F.get("_steps", F.floor(F.size("_steps") / 2).cast("int"))
    own = F.when(F.col("_end").isNull(), F.col("_sum")).otherwise(F.col("_end._at") + F.coalesce(median, nominal))
    closed = summed.withColumn("end", F.col("_sum") + F.greatest(F.lit(0), F.max(own - F.col("_sum")).over(upto)))
    return closed.select(*key, item, F.coalesce(F.lag("end").over(order), F.lit(0)).alias("start"), "end")
