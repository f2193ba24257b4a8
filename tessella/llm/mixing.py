"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

Golden-ratio points u(t) = frac(t * phi) are mapped through the cumulative
target shares of the sources: slot t belongs to the source whose interval holds
u(t). The slots of a source are ranked, its documents are shuffled and cut into
blocks of equally many words, and the slot of rank r takes block r of the
source's stream, which runs through the shuffled documents twice. Blocks that
the schedule gives no slot follow after its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.llm.common import discard, running_offset, staged

WEIGHTS = (3, 1, 2)
SHARE = 1.5
PASSES = 2
SLOTS_PER_SOURCE = 1024
MAX_BLOCK = 65536
PHI = 0.6180339887498949
CELLS = 4096
#: Hex digits of the shuffle key that a task sorts alone: 4,096 parts of a source.
SALT_DIGITS = 3


def sized_documents(docs: DataFrame, size) -> DataFrame:
    """Narrow staged table: doc_id, source, size, the shuffle key and its salt."""
    key = F.sha2(F.concat_ws(":", F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    return staged(
        docs.select("doc_id", "source", size.alias("size"), F.substring(key, 1, 16).alias("key")).withColumn("salt", F.substring("key", 1, SALT_DIGITS)),
        "mix-sized",
    )


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """One row per source: source, source_rank, weight, source_size, target.

    Sources are taken in code-point order, null last, and get the weights in
    turn. Water filling: with the sources ordered by size over weight, those
    that fill up first stop at ``passes`` times their size and the others share
    the rest by weight. The rows are as many as the sources, not the documents.
    """
    everyone = W.orderBy(F.col("source").asc_nulls_last())
    sources = (
        sized.groupBy("source")
        .agg(F.sum("size").cast("long").alias("source_size"))
        .withColumn("source_rank", F.row_number().over(everyone) - 1)
        .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * passes)
    )
    filling = W.orderBy((F.col("cap") / F.col("weight")).asc(), "source_rank")
    behind = filling.rowsBetween(W.unboundedPreceding, -1)
    ahead = filling.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (
        sources.withColumn("total", F.sum("source_size").over(W.partitionBy()) * F.lit(share))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(behind), F.lit(0))) / F.sum("weight").over(ahead))
        .withColumn("is_full", F.col("cap") <= F.col("level") * F.col("weight"))
        .withColumn("open_level", F.min(F.when(~F.col("is_full"), F.struct(F.col("cap") / F.col("weight"), F.col("source_rank"), F.col("level")))).over(W.partitionBy())["level"])
    )
    return level.select(
        "source",
        "source_rank",
        "weight",
        "source_size",
        F.when(F.col("is_full") | F.col("open_level").isNull(), F.col("cap").cast("double")).otherwise(F.col("open_level") * F.col("weight")).alias("target"),
    )


def schedule(targets: DataFrame, slots: int) -> DataFrame:
    """Slots 0.. mapped to sources: slot, source_rank, rank (within its source).

    The intervals of the sources are spread over ``CELLS`` equal cells of [0, 1)
    and the slots are joined by cell, an equi-join.
    """
    spark = targets.sparkSession
    upto = W.orderBy("source_rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    intervals = (
        targets.where("target > 0")
        .withColumn("_all", F.sum("target").over(W.partitionBy()))
        .withColumn("high", F.sum("target").over(upto) / F.col("_all"))
        .withColumn("low", F.coalesce(F.lag("high").over(W.orderBy("source_rank")), F.lit(0.0)))
        .withColumn("high", F.when(F.lead("high").over(W.orderBy("source_rank")).isNull(), F.lit(1.0)).otherwise(F.col("high")))
        .select("source_rank", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    )
    points = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") + 1) * F.lit(PHI) % 1.0).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    owned = points.join(intervals, "cell").where("low <= u AND u < high").select("slot", "source_rank", F.shiftright("slot", 16).alias("span"))
    return running_offset(owned, ["source_rank"], "span", ["slot"], F.lit(1), "rank").select("slot", "source_rank", "rank")


def mix(docs: DataFrame, size, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> tuple[DataFrame, DataFrame]:
    """Mix the documents; returns (documents, pieces).

    ``documents``: one row per input row with doc_id, source, size, source_rank,
    source_size, target, place (word offset in its source's shuffled stream) and
    row_key. ``pieces``: row_key, slot, at, pass, start, words: the words of a
    document that a slot of the schedule takes, and how many words of the slot's
    block stand before them. The mix is the pieces in the order of (slot, at).

    A source takes floor(target) words: its last slot is cut there. Points fall
    unevenly on a small share, so a source may have fewer slots than blocks; its
    blocks of the ranks left over go, rank by rank, behind the schedule. Each pass
    takes a document once at most, so none exceeds ``passes`` times its size.
    Documents without words take nothing; a null source is a source; repeated
    rows are separate documents; an empty table gives empty results; columns but
    doc_id and source are not read. The order is a hash of doc_id, so reruns agree.
    """
    sized = sized_documents(docs, size)
    targets = staged(source_targets(sized, weights, share, passes), "mix-targets")
    # Bounded by the number of sources, not of documents: three numbers to size the schedule.
    facts = targets.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("all"), F.count(F.lit(1)).alias("sources")).first()
    block = max(1, min(MAX_BLOCK, int(facts["all"] // max(1, SLOTS_PER_SOURCE * facts["sources"]))))
    slots = int(facts["all"] / block * 1.25) + 64 * facts["sources"]
    known = targets.select(F.col("source").alias("_source"), "source_rank", "source_size", "target")
    ranked = sized.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ranked = staged(ranked, "mix-ranked")
    discard(sized)
    order = ["key", "doc_id", "size"]
    placed = running_offset(ranked, ["source_rank"], "salt", order, F.col("size"), "place")
    placed = placed.withColumn("row_key", F.concat_ws(":", "source_rank", "salt", F.row_number().over(W.partitionBy("source_rank", "salt").orderBy(*order))))
    placed = staged(placed.drop("key", "salt"), "mix-placed")
    discard(ranked)
    quota = F.floor(F.col("target")).cast("long")
    turns = F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))
    begin = F.col("place") + F.col("turn") * F.col("source_size")
    parts = (
        placed.where("size > 0")
        .select("row_key", "source_rank", "place", "size", "source_size", quota.alias("quota"), turns.alias("turn"))
        .withColumn("begin", begin)
        .withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("quota")))
        .where("begin < end")
        .select("*", F.explode(F.sequence(F.expr(f"begin div {block}"), F.expr(f"(end - 1) div {block}"))).alias("rank"))
    )
    plan = schedule(targets, slots)
    first = F.greatest(F.col("begin"), F.col("rank") * block)
    last = F.least(F.col("end"), (F.col("rank") + 1) * block)
    behind = F.lit(slots) + F.col("rank") * facts["sources"] + F.col("source_rank")
    pieces = parts.join(plan, ["source_rank", "rank"], "left").select(
        "row_key", F.coalesce("slot", behind).alias("slot"), (first - F.col("rank") * block).alias("at"), F.col("turn").alias("pass"), (first - F.col("begin")).alias("start"), (last - first).alias("words")
    )
    return placed, pieces
