"""Reproducible sampling, resampling and splitting; every order is a hash of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.operators.folds import accept_rows, ordered_fold
from tessella.operators.ranking import even_parts, hash_block, hash_key, hash_ranked, running_sum
from tessella.operators.staging import staged

#: Places in a block of a scan, and rows that one streamed fold may decide.
PLACES, FOLDED = 1 << 16, 100_000


def with_total(df: DataFrame, group: list[str], value: Column | None = None, out: str = "total") -> DataFrame:
    """Add the group's sum of ``value`` (its rows if unset), aggregated before the join."""
    total = F.lit(1).cast("long") if value is None else value.cast("long")
    if group:
        return df.join(df.groupBy(*group).agg(F.sum(total).alias(out)), group)
    # The grand total is one number.
    return df.withColumn(out, F.lit(df.agg(F.coalesce(F.sum(total), F.lit(0)).cast("long").alias("t")).first()["t"]))


def sample_share(df: DataFrame, group: list[str], key: str, seed: str, share: float) -> DataFrame:
    """Of each group the floor(n * share + 0.5) rows (one at least) with the smallest hashes."""
    ranked = with_total(hash_ranked(df, seed, key, group=group), group)
    wanted = F.greatest(F.lit(1), F.least(F.col("total"), F.floor(F.col("total") * F.lit(share) + F.lit(0.5))))
    return ranked.where(F.col("hash_rank") < wanted).drop("total")


def even_rounds(df: DataFrame, key: str, seed: str, rounds: int) -> DataFrame:
    """Deal rows in hash order to contiguous rounds (0-based) whose sizes differ by one at most."""
    ranked = with_total(hash_ranked(df, seed, key), [])
    return ranked.withColumn("round", even_parts(F.col("hash_rank"), F.col("total"), rounds)).drop("total")


def resample(df: DataFrame, group: list[str], key: str, seed: str, ratio: Column) -> DataFrame:
    """Repeat rows: floor(ratio) times all, and the fraction of the group in hash order once more."""
    ranked = with_total(hash_ranked(df, seed, key, group=group), group).withColumn("_ratio", ratio)
    whole = F.floor(F.col("_ratio"))
    extra = F.floor(F.col("total") * (F.col("_ratio") - whole) + F.lit(0.5))
    times = (whole + F.when(F.col("hash_rank") < extra, 1).otherwise(0)).cast("int")
    return ranked.withColumn("_n", times).where("_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("total", "_ratio", "_n")


def accept_fitting(df: DataFrame, order: list[str], block: Column, cost: str, budget: int, soft: float = 0, until_full: bool = False, folded: int = FOLDED) -> DataFrame:
    """Rows accepted in ``order`` under one budget of ``cost``; those that do not fit are passed over: adds ``place``.

    While less than ``soft`` is spent every row is accepted, even one that
    exceeds the budget. With ``until_full`` nothing follows once the budget is
    spent, else rows that cost nothing do. ``block`` must not decrease along
    ``order``; costs are whole numbers.

    Exact without a task over all rows. With 2^k <= left < 2^(k+1), rows under
    2^k fit until so many are accepted that less than 2^k is left, and a larger
    row that fits ends the phase as well, since less than 2^k is left behind it.
    Where that happens first is a minimum over running sums of the small rows,
    so a budget takes a scan for each of its binary digits at most. Once
    ``folded`` rows or fewer could still fit, one streamed fold decides them.
    """
    ranked = staged(running_sum(df, F.lit(1), order, block, None, "place"), "accept")
    place, price = F.col("place"), F.col(cost)

    def scanned(rows: DataFrame, value: Column) -> DataFrame:
        return running_sum(rows, value, ["place"], F.floor(place / PLACES), None, "_spent")

    kept, chosen, at, left = F.lit(False), None, -1, budget
    if soft > 0 and left > 0:
        first = scanned(ranked, price).where(F.col("_spent") < soft).agg(F.max("place").alias("at"), F.coalesce(F.sum(cost), F.lit(0)).alias("spent")).first()
        if first["at"] is not None:
            kept, at, left = place <= first["at"], first["at"], left - first["spent"]
    while left > 0 or (left == 0 and not until_full):
        rest = ranked.where((place > at) & (price <= left))
        if left == 0:
            kept = kept | ((place > at) & (price <= 0))
            break
        if rest.count() <= folded:
            one = rest.select("place", cost, F.lit(0).alias("_all"))
            chosen = ordered_fold(one, ["_all"], ["place"], ["place", cost], "_chosen bigint", accept_rows(left, until_full)).select("_chosen")
            break
        small = 1 << (left.bit_length() - 1)
        here = F.lit(left) - F.col("_spent")
        ends = F.when(price < small, here - price < small).otherwise(price <= here)
        end = scanned(rest, F.when(price < small, price).otherwise(0)).where(ends).agg(F.min(F.struct("place", "_spent", price.alias("price"))).alias("e")).first()["e"]
        if end is None:
            kept = kept | ((place > at) & (price < small))
            break
        kept = kept | ((place > at) & (place <= end["place"]) & ((price < small) | (place == end["place"])))
        at, left = end["place"], left - end["_spent"] - end["price"]
    accepted = ranked.where(kept)
    return accepted if chosen is None else accepted.unionByName(ranked.join(chosen, place == F.col("_chosen"), "left_semi"))


def by_depth(df: DataFrame, group: list[str], order: list[str], block: Column) -> DataFrame:
    """Add ``depth``, the 0-based place in the group by ``order``."""
    return running_sum(df, F.lit(1), order, block, group, "depth")


def round_robin(df: DataFrame, group: list[str], key: str, seed: str, cost: str, budget: int) -> DataFrame:
    """Rows of a budget by depth in their group (hash order), then cost, then hash; what does not fit is passed over."""
    ranked = hash_ranked(df, seed, key, group=group).withColumnRenamed("hash_rank", "depth")
    block = F.col("depth") * 4096 + F.least(F.floor(F.col(cost) / 16), F.lit(4095))
    return accept_fitting(ranked, ["depth", cost, "hash_key"], block, cost, budget).drop("place")


def smallest_round_robin(df: DataFrame, protected: Column, group: str, key: str, seed: str, cost: str, target: int, soft: float, smallest: bool = True) -> DataFrame:
    """All protected rows, the smallest other row of each group, then the next smallest ones round by round up to ``target``.

    The groups of a round come in a hash order. A row that does not fit is still
    accepted while less than ``soft * target`` is spent. Without ``smallest`` the
    rows of a group come in hash order. Adds ``why``: protected, first or drawn. ``df`` is read several times: pass a narrow staged table.
    """
    fixed = df.where(protected).withColumn("why", F.lit("protected"))
    others = df.where(~protected).withColumn("_tie", hash_key(seed, key))
    order, part = ([cost, "_tie"], F.col(cost)) if smallest else (["_tie"], F.substring("_tie", 1, 4))
    ranked = staged(by_depth(others, [group], order, part).withColumn("_round", hash_key(seed, "depth", group)), "rounds")
    first = ranked.where("depth = 0").withColumn("why", F.lit("first"))
    # Two numbers decide what the rounds may spend.
    spent = sum(part.agg(F.coalesce(F.sum(cost), F.lit(0)).alias("t")).first()["t"] for part in (fixed, first))
    block = F.col("depth") * 256 + F.conv(F.substring("_round", 1, 2), 16, 10).cast("long")
    drawn = accept_fitting(ranked.where("depth > 0"), ["depth", "_round"], block, cost, target - spent, soft * target - spent, True).withColumn("why", F.lit("drawn"))
    names = [*df.columns, "why"]
    return fixed.select(names).unionByName(first.select(names)).unionByName(drawn.select(names))


def protected_round_robin(df: DataFrame, protected: Column, group: str, key: str, seed: str, cost: str, target: int) -> DataFrame:
    """Protected rows from the smallest on, then the others round by round of their groups, each row if it still fits ``target``.

    A group's rows come smallest first, the groups of a round in a hash order;
    nothing follows once the target is met. Adds ``is_protected``.
    """
    tied = df.withColumn("is_protected", protected).withColumn("_tie", hash_key(seed, key))
    ranked = by_depth(tied, ["is_protected", group], [cost, "_tie"], F.col(cost)).withColumn("_round", hash_key(seed, "depth", group))
    # Protected rows stand before all rounds, by cost.
    ordered = ranked.withColumn("_part", F.when(F.col("is_protected"), 0).otherwise(1)).withColumn("_first", F.when(F.col("is_protected"), F.col(cost)).otherwise(F.col("depth")))
    ordered = ordered.withColumn("_second", F.when(F.col("is_protected"), F.col("_tie")).otherwise(F.col("_round")))
    block = F.col("_part") * (1 << 52) + F.col("_first") * 256 + F.conv(F.substring("_second", 1, 2), 16, 10).cast("long")
    return accept_fitting(ordered, ["_part", "_first", "_second"], block, cost, target, 0, True).select(*df.columns, "is_protected")


def protected_then_shares(df: DataFrame, protected: Column, group: str, key: str, seed: str, cost: str, target: int) -> DataFrame:
    """All protected rows, one of each group, then each group's rows in hash order within its share of what is left.

    A share is floor(left * group / all) by the costs of the unprotected rows; a
    group stops at its first row that does not fit. Adds ``why``. ``df`` is read
    several times: pass a narrow staged table.
    """
    fixed = df.where(protected).withColumn("why", F.lit("protected"))
    ranked = staged(hash_ranked(df.where(~protected), seed, key, group=[group]), "shares")
    first = ranked.where("hash_rank = 0").withColumn("why", F.lit("first"))
    # Three numbers decide the shares.
    kept, ones, every = (part.agg(F.coalesce(F.sum(cost), F.lit(0)).alias("t")).first()["t"] for part in (fixed, first, ranked))
    names, left = [*df.columns, "why"], target - kept - ones
    if target <= kept:
        return fixed.select(names)
    both = fixed.select(names).unionByName(first.select(names))
    if left <= 0 or not every:
        return both
    sums = ranked.groupBy(F.col(group).alias("_group")).agg(F.sum(cost).alias("_sum"))
    shared = ranked.where("hash_rank > 0").join(sums, F.col(group).eqNullSafe(F.col("_group"))).withColumn("_share", F.floor(F.lit(left) * F.col("_sum") / F.lit(every)))
    spent = running_sum(shared, F.col(cost), ["hash_key"], hash_block(), [group], "_spent").where(F.col("_spent") + F.col(cost) <= F.col("_share"))
    return both.unionByName(spent.withColumn("why", F.lit("drawn")).select(names))


def share_targets(sums: DataFrame, group: str, cost: str, target: int) -> DataFrame:
    """Split ``target`` by the groups' costs, half to even; the last group by name takes what is left: group, cost, target.

    ``sums`` has a row a group, so a window over it is small.
    """
    every = W.partitionBy()
    share = F.bround(F.lit(target) * F.col(cost) / F.sum(cost).over(every)).cast("long")
    shared = sums.select(group, cost, share.alias("_share"), (F.max(F.struct(F.lit(1), F.col(group))).over(every)[group].eqNullSafe(F.col(group))).alias("_last"))
    others = F.sum(F.when(F.col("_last"), 0).otherwise(F.col("_share"))).over(every)
    return shared.select(group, cost, F.when(F.col("_last"), F.greatest(F.lit(0), F.lit(target) - others)).otherwise(F.col("_share")).cast("long").alias("target"))


def protected_first(df: DataFrame, protected: Column, key: str, seed: str, wanted: int) -> DataFrame:
    """All protected rows, then others in hash order until ``wanted`` rows are kept."""
    flagged = df.withColumn("is_protected", protected)
    fixed = flagged.where("is_protected").count()
    rest = hash_ranked(flagged.where("NOT is_protected"), seed, key).where(F.col("hash_rank") < max(0, wanted - fixed))
    return flagged.where("is_protected").unionByName(rest.drop("hash_key", "hash_rank"))


def proportional(df: DataFrame, group: list[str], key: str, seed: str, cost: str, budget: int) -> DataFrame:
    """Per group, rows in hash order while they fit the group's share of the budget."""
    sized = with_total(with_total(df, group, F.col(cost), "group_cost"), [], F.col(cost), "all_cost")
    share = F.floor(F.lit(budget) * F.col("group_cost") / F.col("all_cost"))
    ranked = hash_ranked(sized.withColumn("share", share), seed, key, group=group)
    spent = running_sum(ranked, F.col(cost), ["hash_key"], hash_block(), group, "spent")
    return spent.where(F.col("spent") + F.col(cost) <= F.col("share")).drop("group_cost", "all_cost")


def equal_budgets(counts: DataFrame, group: str, available: str, budget: int) -> DataFrame:
    """Split a budget equally over groups, none above what it has; one more to the first by name.

    Depth-ordered: unit d of every group comes before unit d + 1 of any, so a
    group that runs out leaves its share to the others.
    """
    level = W.orderBy(available, group)
    sized = counts.withColumn("_before", F.coalesce(F.sum(available).over(level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn(
        "_left", F.count(F.lit(1)).over(level.rowsBetween(W.currentRow, W.unboundedFollowing))
    )
    full = (F.lit(budget) - F.col("_before")) >= F.col(available) * F.col("_left")
    first = F.min(F.when(~full, F.struct(available, group, (F.lit(budget) - F.col("_before")).alias("rest"), "_left"))).over(W.partitionBy())
    filled = sized.withColumn("_full", full).withColumn("_open", first)
    place = F.row_number().over(W.partitionBy("_full").orderBy(group)) - 1
    base, more = F.floor(F.col("_open.rest") / F.col("_open._left")), F.col("_open.rest") % F.col("_open._left")
    return filled.withColumn("_place", place).select(
        group, available, F.when(F.col("_full") | F.col("_open").isNull(), F.col(available)).otherwise(base + F.when(F.col("_place") < more, 1).otherwise(0)).cast("long").alias("granted")
    )


def hold_out_groups(df: DataFrame, group: str, seed: str, wanted: int) -> DataFrame:
    """Groups in hash order whose rows start before ``wanted`` rows are held out: group, n."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    ranked = hash_ranked(counts, seed, group)
    return running_sum(ranked, F.col("n"), ["hash_key"], hash_block(), None, "held").where(F.col("held") < wanted).select(group, "n")


def hold_out_fitting(df: DataFrame, group: str, seed: str, wanted: int, most: float = 1.5) -> DataFrame:
    """Groups in hash order, those that would exceed ``most * wanted`` rows passed over, until ``wanted`` rows are held: group, n.

    Groups up to (most - 1) * wanted rows always fit until ``wanted`` is
    reached, so only those of them that start before it, and the larger ones
    that fit at all, are candidates: at most ``wanted`` small groups and
    rows / ((most - 1) * wanted) large ones, which one task folds.
    """
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most * wanted)
    small = F.when(F.col("n") <= (most - 1) * wanted, F.col("n")).otherwise(0)
    ranked = running_sum(hash_ranked(counts, seed, group), small, ["hash_key"], hash_block(), None, "_small").where(F.col("_small") < wanted)

    def fold(rows):
        held = 0
        for own, n in rows:
            if held >= wanted:
                return
            if held + n <= most * wanted:
                held += n
                yield own, n

    kind = counts.schema[group].dataType.simpleString()
    chosen = ordered_fold(ranked.withColumn("_all", F.lit(0)), ["_all"], ["hash_key"], [group, "n"], f"`{group}` {kind}, n bigint", fold)
    return chosen.drop("_all")


def fill_to_floor(df: DataFrame, order: list[str], block: Column, cost: str, floor: int, extra: list[int]) -> DataFrame:
    """All rows once (``cycle`` 0), then again, cycle after cycle, row by row until their costs reach ``floor``.

    A row of cycle c > 0 costs ``extra[(c - 1) % len(extra)]`` more. Adds
    ``cycle`` and ``spent``, what was reached before the row.
    """
    sums = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(cost), F.lit(0)).alias("t")).first()  # two numbers
    period = [sums["t"] + e * sums["n"] for e in extra]
    if not sum(period):
        return df.withColumn("cycle", F.lit(0)).withColumn("spent", F.lit(0).cast("long"))
    # Whole periods by division; the cycles of the last one are few.
    periods = max(0, floor - sums["t"]) // sum(period) + 1
    placed = running_sum(running_sum(df, F.col(cost), order, block, None, "_cost"), F.lit(1), order, block, None, "_place")
    again = placed.withColumn("cycle", F.explode(F.sequence(F.lit(1), F.lit(periods * len(extra)))))
    at = (F.col("cycle") - 1) % len(extra)
    steps, starts = F.array(*[F.lit(e) for e in extra]), F.array(*[F.lit(sum(period[:i])) for i in range(len(extra))])
    begun = F.lit(sums["t"]) + F.floor((F.col("cycle") - 1) / len(extra)) * sum(period) + F.element_at(starts, at + 1)
    again = again.withColumn("spent", (begun + F.col("_cost") + F.col("_place") * F.element_at(steps, at + 1)).cast("long")).where(F.col("spent") < floor)
    first = placed.withColumn("cycle", F.lit(0)).withColumn("spent", F.col("_cost"))
    return first.unionByName(again).drop("_cost", "_place")


def train_rows(df: DataFrame, held: DataFrame, group: str) -> DataFrame:
    """Rows whose group is not held out, so that no group is on both sides."""
    return df.join(held.select(group), group, "left_anti")
