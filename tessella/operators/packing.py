"""Greedy packing of ordered items under a token budget.

Items inside one row are folded as an array (``fold_pack``); items that are
rows of a group are streamed (``greedy_pack``, ``accept_in_order``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.folds import accept_rows, ordered_fold, pack_rows

CHUNK = "struct<first: bigint, last: bigint, items: bigint, tokens: bigint>"


def fold_pack(items: Column, budget: int, prefix: int | Column = 0, skip_oversize: bool = False) -> Column:
    """Chunks of an ordered array of (pos, cost): array of (first, last, items, tokens).

    A chunk closes before an item that would exceed the budget. An item larger
    than the budget is a chunk of its own, or with ``skip_oversize`` it is left
    out and closes the chunk before it. Every chunk pays ``prefix``.
    """
    none = F.expr(f"cast(array() as array<{CHUNK}>)")
    start = F.struct(none.alias("done"), F.expr(f"cast(null as {CHUNK})").alias("now"))

    def chunk(first, last, n, tokens):
        return F.struct(first.cast("long").alias("first"), last.cast("long").alias("last"), n.cast("long").alias("items"), tokens.cast("long").alias("tokens"))

    def closed(a):
        return F.when(a["now"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["now"]))

    def step(a, x):
        one = chunk(x["pos"], x["pos"], F.lit(1), x["cost"] + prefix)
        fits = a["now"].isNotNull() & (a["now"]["tokens"] + x["cost"] <= budget)
        grown = chunk(a["now"]["first"], x["pos"], a["now"]["items"] + 1, a["now"]["tokens"] + x["cost"])
        large = x["cost"] + prefix > budget
        new = F.when(large, F.expr(f"cast(null as {CHUNK})")).otherwise(one) if skip_oversize else one
        fits = fits & ~large if skip_oversize else fits
        return F.struct(F.when(fits, a["done"]).otherwise(closed(a)).alias("done"), F.when(fits, grown).otherwise(new).alias("now"))

    return F.aggregate(items, start, step, closed)


def greedy_pack(df: DataFrame, group: list[str], pos: Column, cost: Column, budget: int, prefix: int = 0, skip_oversize: bool = False) -> DataFrame:
    """Pack the rows of each group in order: group, chunk_id, first, last, items, tokens, is_over_budget."""
    items = df.select(*group, pos.cast("long").alias("_pos"), cost.cast("long").alias("_cost"))
    chunks = ordered_fold(items, group, ["_pos", "_cost"], ["_pos", "_cost"], "chunk_id int, first bigint, last bigint, items bigint, tokens bigint", pack_rows(budget, prefix, skip_oversize))
    return chunks.withColumn("is_over_budget", F.col("tokens") > budget)


def pack_lines(docs: DataFrame, key: str, text: Column, budget: int, tokens) -> DataFrame:
    """Pack the non-blank lines of each text; no shuffle, as a text is one row."""
    lines = F.filter(
        F.transform(F.split(text, "\n", -1), lambda line, i: F.struct(i.cast("long").alias("pos"), tokens(line).cast("long").alias("cost"))),
        lambda x: x["cost"] > 0,
    )
    chunks = docs.select(key, F.posexplode(fold_pack(lines, budget)).alias("chunk_id", "_c"))
    return chunks.select(key, "chunk_id", "_c.*", (F.col("_c.tokens") > budget).alias("is_over_budget"))


def accept_while_fits(items: Column, budget: Column) -> Column:
    """Ids accepted from an ordered array of (id, cost) when items that do not fit are skipped."""
    start = F.struct(F.expr("cast(array() as array<bigint>)").alias("ids"), budget.cast("long").alias("left"))

    def step(a, x):
        fits = x["cost"] <= a["left"]
        return F.struct(F.when(fits, F.array_append(a["ids"], x["id"])).otherwise(a["ids"]).alias("ids"), F.when(fits, a["left"] - x["cost"]).otherwise(a["left"]).alias("left"))

    return F.aggregate(items, start, step, lambda a: a["ids"])


def accept_in_order(df: DataFrame, group: list[str], order: list[str], own: str, cost: str, budget: int) -> DataFrame:
    """Ids (``own``) accepted in order within the group's budget when rows that do not fit are passed over."""
    kind = df.schema[own].dataType.simpleString()
    return ordered_fold(df, group, order, [own, cost], f"`{own}` {kind}", accept_rows(budget))
