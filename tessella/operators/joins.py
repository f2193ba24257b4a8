"""Joins that Spark has no operator for: ranges, bands, nearest values, sequences."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.operators.staging import staged


def range_join(points: DataFrame, spans: DataFrame, key: list[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Pairs of points and spans of one key with start <= at < end.

    Spans are spread over bins of ``width``, so the join is an equi-join on key
    and bin; choose a width near the usual length of a span.
    """
    binned = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    return points.withColumn("_bin", F.floor(F.col(at) / width)).join(binned, [*key, "_bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bin")


def ratio_join(left: DataFrame, right: DataFrame, key: list[str], value: str, low: float, high: float) -> DataFrame:
    """Pairs (aliases l and r) of one key whose positive values have a ratio from ``low`` to ``high``.

    Logarithms are cut into bands as wide as the rule, so the bands of a pair
    are equal or neighbours: the right side stands in three bands, the left side
    in one, and a pair meets once. Null keys and values meet nothing.
    """
    width = max(-math.log(low), math.log(high))
    band = F.floor(F.ln(value) / width)
    a = left.where(F.col(value) > 0).withColumn("_band", band).alias("l")
    b = right.where(F.col(value) > 0).withColumn("_band", F.explode(F.array(band - 1, band, band + 1))).alias("r")
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*key, "_band"]]
    return a.join(b, same).where((F.col(f"l.{value}") / F.col(f"r.{value}")).between(low, high))


def nearest(left: DataFrame, right: DataFrame, key: list[str], value: str, right_id: str, width: float = 4096) -> DataFrame:
    """For each left row the right row of its key with the nearest value.

    The nearest rows below and above are the only candidates. Values are sorted
    by key and range of ``width``; a range without a right row below or above
    takes that of the nearest range that has one, carried over the ranges of the
    key. Ties go to the smaller distance, then the smaller id. ``left`` keeps
    its columns and gains ``match_id`` and ``distance``; without a right row
    they are null. Null keys are equal, a null value has no match.
    """
    own = left.withColumn("_side", F.lit(1)).withColumn("_hit", F.lit(None).cast(f"struct<v: double, id: {right.schema[right_id].dataType.simpleString()}>"))
    other = right.where(F.col(value).isNotNull()).select(*key, value, F.lit(0).alias("_side"), F.struct(F.col(value).cast("double").alias("v"), F.col(right_id).alias("id")).alias("_hit"))
    both = own.unionByName(other, allowMissingColumns=True).withColumn("_bin", F.floor(F.col(value) / width))
    # Lowest and highest right row of each range; equal values keep the smaller id.
    low = F.min("_hit")
    high = F.min(F.when(F.col("_hit").isNotNull(), F.struct((-F.col("_hit.v")).alias("m"), F.col("_hit.id").alias("id"))))
    edges = both.groupBy(*key, "_bin").agg(low.alias("_low"), high.alias("_top")).withColumn("_high", F.when(F.col("_top").isNotNull(), F.struct((-F.col("_top.m")).alias("v"), F.col("_top.id").alias("id"))))
    ranges = W.partitionBy(*key).orderBy("_bin")
    carried = edges.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)],
        F.col("_bin").alias("_at"),
        F.last("_high", ignorenulls=True).over(ranges.rowsBetween(W.unboundedPreceding, -1)).alias("_under"),
        F.first("_low", ignorenulls=True).over(ranges.rowsBetween(1, W.unboundedFollowing)).alias("_over"),
    )
    order = [value, "_side", F.col("_hit.id").desc()]
    below = F.last("_hit", ignorenulls=True).over(W.partitionBy(*key, "_bin").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    rev = [F.col(value).desc(), "_side", F.col("_hit.id").desc()]
    above = F.last("_hit", ignorenulls=True).over(W.partitionBy(*key, "_bin").orderBy(*rev).rowsBetween(W.unboundedPreceding, 0))
    same = [F.col("_bin") == F.col("_at")] + [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]
    inside = both.withColumn("_b", below).withColumn("_a", above).where("_side = 1")
    found = inside.join(carried, same, "left").withColumn("_b", F.coalesce("_b", "_under")).withColumn("_a", F.coalesce("_a", "_over"))

    def option(c: str) -> Column:
        return F.when(F.col(c).isNotNull() & F.col(value).isNotNull(), F.struct(F.abs(F.col(f"{c}.v") - F.col(value)).alias("d"), F.col(f"{c}.id").alias("id")))

    best = F.array_min(F.array_compact(F.array(option("_b"), option("_a"))))
    return found.withColumn("_best", best).select(*left.columns, F.col("_best.id").alias("match_id"), F.col("_best.d").alias("distance"))


def sliding_offset_match(left: DataFrame, right: DataFrame, key: list[str], pos: str, value: str, offsets: range) -> DataFrame:
    """Best offset of two sequences per key: the one with most equal values, then the smallest."""
    moved = left.select(*key, F.col(pos).alias("_p"), F.col(value).alias("_v"), F.explode(F.array(*[F.lit(o) for o in offsets])).alias("offset")).withColumn(pos, F.col("_p") + F.col("offset"))
    scored = moved.join(right.select(*key, pos, F.col(value).alias("_w")), [*key, pos]).groupBy(*key, "offset").agg(F.sum((F.col("_v") == F.col("_w")).cast("int")).alias("score"))
    return scored.groupBy(*key).agg(F.min(F.struct((-F.col("score")).alias("s"), "offset")).alias("_b")).select(*key, F.col("_b.offset").alias("offset"), (-F.col("_b.s")).alias("score"))


def wrapped_map(left: DataFrame, right: DataFrame, key: list[str], pos: str, value: str, offsets: range) -> DataFrame:
    """Places of ``left`` mapped to places of ``right`` at the offset with most equal values: key, left_pos, right_pos, left_value, right_value.

    Places count from 0; a place beyond the end of ``right`` goes round. Ties
    go to the smallest offset; keys without a right row have no map.
    """
    sizes = right.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    own = left.select(*key, F.col(pos).alias("left_pos"), F.col(value).alias("left_value")).join(sizes, key)
    other = right.select(*key, F.col(pos).alias("right_pos"), F.col(value).alias("right_value"))

    def at(offset):
        return F.pmod(F.col("left_pos") + offset, F.col("_n"))

    moved = own.withColumn("_offset", F.explode(F.array(*[F.lit(o) for o in offsets]))).withColumn("right_pos", at(F.col("_offset"))).join(other, [*key, "right_pos"])
    scored = moved.groupBy(*key, "_offset").agg(F.count_if(F.col("left_value") == F.col("right_value")).alias("_score"))
    best = scored.groupBy(*key).agg(F.min(F.struct((-F.col("_score")).alias("s"), F.col("_offset").alias("o"))).alias("_b")).select(*key, F.col("_b.o").alias("_best"))
    return own.join(best, key).withColumn("right_pos", at(F.col("_best"))).join(other, [*key, "right_pos"]).select(*key, "left_pos", "right_pos", "left_value", "right_value")


def positional_audit(left: DataFrame, right: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Full comparison by position in the group: status ok, changed, missing or extra per row."""
    rank = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    a = left.select(*key, rank.alias("ordinal"), F.col(value).alias("left_value"), F.lit(1).alias("_l"))
    b = right.select(*key, rank.alias("ordinal"), F.col(value).alias("right_value"), F.lit(1).alias("_r"))
    status = F.when(F.col("_r").isNull(), "missing").when(F.col("_l").isNull(), "extra").when(F.col("left_value").eqNullSafe(F.col("right_value")), "ok").otherwise("changed")
    return a.join(b, [*key, "ordinal"], "full").select(*key, "ordinal", "left_value", "right_value", status.alias("status"))


#: Counters that order the items of sets; items share one by their hash.
COUNTERS = 1 << 18
#: Ids of sets in candidate pairs that a join may broadcast.
BROADCAST_IDS = 1_000_000


def similar_pairs(sets: DataFrame, key: str, items: str, similarity: float) -> DataFrame:
    """Pairs of sets (arrays of distinct items) whose Jaccard similarity reaches ``similarity``.

    Prefix filter: two such sets share one of their first n - ceil(s n) + 1
    items in any order that all sets keep to. Here it is by the items' hashes,
    those first whose counter counts least, so frequent items join nothing; the
    counters are few, whatever the input, and broadcast. The heads of a pair
    share more than one item: of the t common items that the pair needs, only
    those can be missing that lie behind the head which ends first. So only
    heads are shuffled, and of the sets only such as a candidate pair names.
    The sizes of exploded and array columns cannot be estimated from the files,
    so the joins are merged, never broadcast on such an estimate.
    """
    hashes = sets.select(key, F.transform(items, lambda i: F.xxhash64(i)).alias("h"))
    counter = F.pmod("item", F.lit(COUNTERS)).cast("int")
    counted = hashes.select(F.explode("h").alias("item")).groupBy(counter.alias("at")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[counted.column("at").to_numpy()] = counted.column("n").to_numpy()
    order = sets.sparkSession.sparkContext.broadcast(counts)

    def heads(batches):
        for batch in batches:
            ends = batch.column(1).offsets.to_numpy()
            flat = batch.column(1).values.to_numpy(zero_copy_only=False)
            rank = order.value[flat % len(order.value)]
            sizes = np.diff(ends)
            kept = np.where(sizes > 0, sizes - np.ceil(sizes * similarity - 1e-9).astype(np.int64) + 1, 0)
            first = [at + np.lexsort((flat[at:to], rank[at:to]))[:n] for at, to, n in zip(ends[:-1].tolist(), ends[1:].tolist(), kept.tolist())]
            taken = np.concatenate(first) if first else np.empty(0, np.int64)
            owner = np.repeat(np.arange(len(sizes)), kept)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(sizes[owner].astype(np.int32)), pa.array(flat[taken])], [key, "size", "item"])

    spread = hashes.mapInArrow(heads, f"`{key}` {sets.schema[key].dataType.simpleString()}, size int, item long")
    # Items that one set alone has meet nothing.
    several = spread.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("item"))).where("_n > 1").drop("_n")
    several = staged(several, "set-heads")
    smaller = several.select(F.col(key).alias("x"), F.col("size").alias("nx"), "item")
    larger = several.select(F.col(key).alias("y"), F.col("size").alias("ny"), "item")
    fits = (F.col("nx") >= similarity * F.col("ny") - 1e-9) & ((F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y"))))
    met = smaller.join(larger.hint("merge"), "item").where(fits).groupBy("x", "nx", "y", "ny").agg(F.count(F.lit(1)).alias("met"))
    needed = F.ceil((F.col("nx") + F.col("ny")) * (similarity / (1 + similarity)) - 1e-9)
    behind = F.ceil(F.greatest("nx", "ny") * similarity - 1e-9) - 1
    pairs = staged(met.where(F.col("met") >= needed - behind).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), "set-pairs")
    named = staged(pairs.select(F.explode(F.array("a", "b")).alias(key)).distinct(), "set-ids")
    # Counted before it is broadcast.
    few = named.hint("broadcast") if named.count() <= BROADCAST_IDS else named.hint("merge")
    asked = sets.select(key, items).join(few, key, "left_semi")
    full = pairs.join(asked.select(F.col(key).alias("a"), F.col(items).alias("_x")).hint("merge"), "a").join(asked.select(F.col(key).alias("b"), F.col(items).alias("_y")).hint("merge"), "b")
    shared = F.size(F.array_intersect("_x", "_y"))
    return full.select("a", "b", shared.alias("shared"), (shared / (F.size("_x") + F.size("_y") - shared)).alias("jaccard")).where(F.col("jaccard") >= similarity)


#: Words of the right side that a task holds, and rows of the left side that meet them at once.
TILE_WORDS, LEFT_ROWS = 2_000_000, 4096


def _best_of_tile(ids: list, held: list) -> Callable:
    """Scorer of one tile of the right side, by the postings of its words: rows of words to (row, id, jaccard)."""
    sizes, postings = np.asarray([len(w) for w in held], float), {}
    for i, own in enumerate(held):
        for w in own:
            postings.setdefault(w, []).append(i)
    index = {w: np.asarray(i) for w, i in postings.items()}

    def best(rows: Iterable) -> Iterator[tuple]:
        for at, own in enumerate(rows):
            hits = [index[w] for w in own if w in index] if own is not None else []
            if hits:
                shared = np.bincount(np.concatenate(hits), minlength=len(ids))
                jaccard = shared / (len(own) + sizes - shared)
                top = int(jaccard.argmax())
                yield at, ids[top], float(jaccard[top])

    return best


def best_overlap(left: DataFrame, key: str, right: DataFrame, right_id: str, words: str, tile: int = TILE_WORDS) -> DataFrame:
    """For each left row the right row whose set of words has the highest Jaccard similarity: key, right_id, jaccard.

    ``words`` is an array column of distinct words on both sides. Only pairs
    that share a word count; ties go to the smaller ``right_id``. A right side
    of at most ``tile`` words, which is counted first, is broadcast. A larger one
    is cut into tiles and the left side into blocks; each tile meets each block
    in one task, and the best of a row's tiles is kept. So nothing of a large
    right side passes the driver, and a task holds a tile and a block.
    """
    keyed = right.select(F.col(right_id).alias("id"), F.col(words).alias("w"))
    total = keyed.agg(F.coalesce(F.sum(F.size("w")), F.lit(0)).alias("n")).first()["n"]  # one number
    tiles = max(1, -(-int(total) // tile))
    kind, id_kind = left.schema[key].dataType.simpleString(), right.schema[right_id].dataType.simpleString()
    schema = f"`{key}` {kind}, `{right_id}` {id_kind}, jaccard double"
    if tiles == 1:
        own = keyed.orderBy("id").toPandas()
        held = left.sparkSession.sparkContext.broadcast((own["id"].tolist(), [list(w) for w in own["w"]]))

        def run(batches):
            best = _best_of_tile(*held.value)
            for batch in batches:
                found = list(zip(*best(batch.column(1).to_pylist()))) or [(), (), ()]
                keys = batch.column(0).take(pa.array(found[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(found[1]) if found[1] else pa.array([], pa.int64()), pa.array(found[2], pa.float64())], [key, right_id, "jaccard"])

        return left.select(key, words).mapInArrow(run, schema)
    blocks = max(1, -(-left.count() // LEFT_ROWS))
    spread_left = left.select(F.col(key).alias("k"), F.col(words).alias("w"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"))
    spread_right = keyed.select("id", "w", F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int").alias("tile"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def meet(rows: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        other = other.sort_values("id")
        found = list(_best_of_tile(other["id"].tolist(), other["w"].tolist())(rows["w"])) if len(rows) and len(other) else []
        return pd.DataFrame({key: [rows["k"].iloc[f[0]] for f in found], right_id: [f[1] for f in found], "jaccard": [f[2] for f in found]})

    met = spread_left.groupBy("block", "tile").cogroup(spread_right.groupBy("block", "tile")).applyInPandas(meet, schema)
    best = met.groupBy(key).agg(F.min(F.struct((-F.col("jaccard")).alias("_less"), F.col(right_id).alias("_id"))).alias("_b"))
    return best.select(key, F.col("_b._id").alias(right_id), (-F.col("_b._less")).alias("jaccard"))
