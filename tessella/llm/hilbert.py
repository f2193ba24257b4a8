"""Sharding by a Hilbert curve over quantised metadata (DataFrame functions only).

Every metadata dimension is quantised to ``BITS`` bits in the order of its
values, the cells are visited in the order of a Hilbert curve, and the ordered
rows are cut into runs. Cells that are near on the curve are near in every
dimension, so a shard covers a compact box and the minima and maxima of its file
prune on any dimension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.llm.common import running_offset, staged

BITS = 5
#: Rows of a cell of the curve that one task ranks, about; fuller cells are salted.
CELL_ROWS = 1024
#: Bits of a row's hash that salts are cut from.
SALT_BITS = 24
#: Bits of a row's hash, a positive long.
HASH_BITS = 60
#: Distinct values of a dimension up to which their cells are broadcast.
BROADCAST_VALUES = 100_000


def fine_length(size: Column) -> Column:
    """A positive number by sixteenths of its binary logarithm, of which there are at most 1,024."""
    return F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")) * 16).cast("int")


def row_hash(key: Column) -> Column:
    """Leading bits of the SHA-256 of ``key`` as text; SQL can repeat it."""
    return F.conv(F.substring(F.sha2(F.coalesce(key.cast("string"), F.lit("null")), 256), 1, HASH_BITS // 4), 16, 10).cast("long")


def add_cell(df: DataFrame, value: Column, name: str, bits: int = BITS) -> DataFrame:
    """Add ``name``: the cell of ``value``, ascending in it, null last.

    As many values as cells or fewer have a cell each, spread over the whole
    range, so that the curve's coarse steps part them too. More are cut at the
    quantiles of the rows, so that cells hold about equally many. The table of
    values grows with the distinct values, not with the rows.
    """
    order = W.orderBy(F.col("_value").asc_nulls_last())
    counts = df.groupBy(value.alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    whole = W.partitionBy()
    cells = counts.select(
        "_value",
        F.when(F.count(F.lit(1)).over(whole) <= 1 << bits, F.floor((F.row_number().over(order) - 1) * (1 << bits) / F.count(F.lit(1)).over(whole)))
        .otherwise(F.floor((F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")) * (1 << bits) / F.sum("_n").over(whole)))
        .cast("int")
        .alias(name),
    )
    cells = staged(cells, "hilbert-cells")
    few = cells.count() <= BROADCAST_VALUES
    return df.withColumn("_own", value).join(F.broadcast(cells) if few else cells, F.col("_own").eqNullSafe(F.col("_value"))).drop("_own", "_value")


def curve_index(cells: list[Column], bits: int = BITS) -> Column:
    """Hilbert index of a cell with ``len(cells)`` coordinates of ``bits`` bits.

    The coordinates are folded bit by bit from the highest: a set bit reflects
    the lower bits of the first axis, a clear one swaps them with the first
    axis; a Gray code over the axes then gives the index.
    """
    n = len(cells)
    axes = F.array(*[c.cast("int") for c in cells])
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def reflect_or_swap(x: Column, step: Column) -> Column:
        q, i = step["q"], step["i"]
        low = q - F.lit(1)
        here = F.element_at(x, i + 1)
        set_bit = here.bitwiseAND(q) != 0
        first = F.element_at(x, 1)
        swap = first.bitwiseXOR(here).bitwiseAND(low)
        return F.transform(
            x,
            lambda v, j: F.when(set_bit, F.when(j == 0, v.bitwiseXOR(low)).otherwise(v)).otherwise(
                F.when((j == 0) | (j == i), F.when(i == 0, v).otherwise(v.bitwiseXOR(swap))).otherwise(v)
            ),
        )

    def gray(x: Column) -> Column:
        return F.transform(x, lambda _, j: F.aggregate(F.slice(x, F.lit(1), j + 1), F.lit(0), lambda a, v: a.bitwiseXOR(v)))

    def unwind(x: Column) -> Column:
        last = F.element_at(x, n)
        turn = F.aggregate(
            F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]),
            F.lit(0),
            lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - F.lit(1))).otherwise(t),
        )
        return F.transform(x, lambda v: v.bitwiseXOR(turn))

    def interleave(x: Column) -> Column:
        places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
        return F.aggregate(
            places,
            F.lit(0).cast("long"),
            lambda d, p: d * F.lit(2) + F.getbit(F.element_at(x, p["i"] + 1), p["b"]).cast("long"),
        )

    chain = F.array(axes)
    chain = F.transform(chain, lambda x: F.aggregate(steps, x, reflect_or_swap))
    chain = F.transform(chain, gray)
    chain = F.transform(chain, unwind)
    return F.element_at(F.transform(chain, interleave), 1)


def hilbert_shards(df: DataFrame, key: str, cells: list[Column], size: Column, shards: int = 16, law: str = "rows", carry: list[Column] | None = None) -> DataFrame:
    """Cut ``df`` into ``shards`` runs along the curve.

    Returns ``key``, the ``carry`` columns, ``size``, ``curve`` (the index),
    ``shard`` and ``slot`` (position in the shard, gapless from 0). Law
    ``rows``: the row counts of the shards differ by one at most. Law
    ``bytes``: a row falls to the shard that holds the middle of its bytes, so
    shards differ by about one row's bytes.

    Rows of a cell follow in the order of a hash of ``key``; a cell has as many
    salts of that hash as its rows ask for, so one with a third of all rows stays
    spread. The counts of the curve's cells are broadcast only if there are at
    most ``2 ** 16`` cells. Nulls, empty and very long
    texts are ordinary rows; repeated rows stay repeated and take neighbouring
    slots; an empty table gives no row; other columns are ignored.
    """
    mixed = row_hash(F.col(key))
    narrow = staged(
        df.select(
            F.col(key),
            *(carry or []),
            size.cast("long").alias("size"),
            curve_index(cells).alias("curve"),
            mixed.alias("_mixed"),
        ),
        "hilbert-rows",
    )
    salts = narrow.groupBy("curve").agg(F.expr(f"count(*) div {CELL_ROWS} + 1").alias("_salts"))
    # Salts are cut from the leading bits, so that they ascend with the hash.
    top = F.shiftright("_mixed", HASH_BITS - SALT_BITS)
    bounded = BITS * len(cells) <= 16
    salted = narrow.join(F.broadcast(salts) if bounded else salts, "curve").withColumn("_cell", F.shiftleft("curve", SALT_BITS) + F.shiftright(top * F.col("_salts"), SALT_BITS))
    narrow = staged(salted.drop("_salts"), "hilbert")
    one = F.lit(1) if law == "rows" else F.col("size")
    # The order of all cells: coarse blocks of 64 curve indices first, then the cells of a block.
    cells_of = narrow.groupBy((F.shiftright("curve", 6)).alias("_block"), "_cell").agg(F.sum(one).cast("long").alias("_n"), F.count(F.lit(1)).alias("_rows"))
    placed = running_offset(cells_of.groupBy("_block").agg(F.sum("_n").cast("long").alias("_n"), F.sum("_rows").cast("long").alias("_rows")), [], "_block", ["_block"], F.col("_n"), "_first")
    placed = placed.withColumn("_all", F.sum("_n").over(W.partitionBy()))
    inner = W.partitionBy("_block").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    start = cells_of.join(placed.select("_block", "_first", "_all"), "_block").select(
        "_cell", "_all", (F.col("_first") + F.coalesce(F.sum("_n").over(inner), F.lit(0))).cast("long").alias("_base")
    )
    within = W.partitionBy("_cell").orderBy("_mixed", key, "size").rowsBetween(W.unboundedPreceding, -1)
    ranked = (
        narrow.join(start, "_cell")
        .withColumn("_rank", (F.col("_base") + F.coalesce(F.sum(one).over(within), F.lit(0))).cast("long"))
    )
    if law == "rows":
        low, more = F.expr(f"_all div {shards}"), F.col("_all") % shards
        wide = more * (low + 1)
        shard = F.when(F.col("_rank") < wide, F.expr(f"_rank div (_all div {shards} + 1)")).otherwise(
            more + F.expr(f"(_rank - (_all % {shards}) * (_all div {shards} + 1)) div greatest(_all div {shards}, 1)")
        )
        slot = F.col("_rank") - F.when(F.col("shard") <= more, F.col("shard") * (low + 1)).otherwise(wide + (F.col("shard") - more) * low)
        ranked = ranked.withColumn("shard", shard.cast("int")).withColumn("slot", slot.cast("long"))
    else:
        shard = F.least(F.lit(shards - 1), F.expr(f"((2 * _rank + size) * {shards}) div (2 * _all)"))
        ranked = ranked.withColumn("shard", shard.cast("int"))
        ranked = running_offset(staged(ranked.drop("_base", "_all"), "hilbert-bytes"), ["shard"], "_cell", ["_mixed", key, "size"], F.lit(1), "slot")
    names = [c for c in narrow.columns if not c.startswith("_") and c != "curve"]
    return ranked.select(*names, "curve", "shard", "slot")
