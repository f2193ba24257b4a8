"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.staging import discard, staged


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from every node of ``edges`` (a, b): node, component.

    Alternates two star contractions: the large star links a node's greater
    neighbours to its smallest neighbour, the small star its smaller ones. The
    edges never grow in number, and the rounds grow with the logarithm of the
    size. Minima are aggregated before each shuffle; every round's edges are
    written to the shared folder. Ends when a round changes no edge; only the
    two numbers that tell this (count and checksum) reach the driver.
    """

    def mark(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))), F.lit(0))).first())

    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = mark(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = staged(large, "edges")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            down.join(least, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .where("a <> b")
            .distinct()
        )
        before, now = now, staged(small, "edges")
        discard(before, large)
        then, seen = seen, mark(now)
        if then == seen:
            break
    else:
        raise RuntimeError(f"components: not settled after {most_rounds} rounds")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
