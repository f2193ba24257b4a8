"""Matching of sequences: near-duplicates by band join, best match under a composite distance, greedy look-ahead."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.operators.components import components
from tessella.operators.composite import best_match  # noqa: F401
from tessella.operators.folds import ordered_fold
from tessella.operators.staging import discard, staged


def shifted(events: DataFrame, key: list[str], at: str) -> DataFrame:
    """``events`` with ``at`` counted from the first event of each sequence."""
    first = events.groupBy(*key).agg(F.min(at).alias("_first"))
    return events.join(first, key).withColumn(at, F.col(at) - F.col("_first")).drop("_first")


#: Sequences of a block, those with the most events, that all its others are compared with first.
LEADERS = 64
#: Sequences of a block that one group of rows of that comparison has, about; they are streamed, only the leaders are held.
MET = 2048


def leader_links(notes: DataFrame, block: str, value: str, at: str, tolerance: int, share: float) -> DataFrame:
    """Links of sequences that are close to one of their block's leaders: a, b.

    The leaders have the most events, so others are close to them sooner than
    to any. A block is cut into groups, each of which meets copies of the
    leaders in one task. A sequence reports one link, and those that connect
    leaders which no link of its group does.
    """
    nodes = notes.select(block, "node", "n").distinct()
    top = nodes.withColumn("_turn", F.row_number().over(W.partitionBy(block).orderBy(F.desc("n"), "node"))).where(F.col("_turn") <= LEADERS)
    parts = nodes.groupBy(block).agg(F.ceil(F.count(F.lit(1)) / MET).alias("_parts"))
    events = F.collect_list(F.struct(F.col(value).alias("v"), F.col(at).cast("long").alias("t")))
    known = notes.where(F.col(value).isNotNull() & F.col(at).isNotNull()).groupBy(block, "node", "n").agg(events.alias("_e"))
    lists = known.select(block, "node", "n", F.col("_e.v").alias("v"), F.col("_e.t").alias("t")).join(parts.hint("merge"), block)
    lists = staged(lists, "sequence-lists")
    members = lists.withColumn("_part", F.pmod(F.xxhash64("node"), "_parts")).withColumn("_side", F.lit(1))
    leads = lists.join(top.select(block, "node").hint("merge"), [block, "node"]).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).withColumn("_side", F.lit(0))
    both = members.unionByName(leads).select(F.col(block).alias("block"), "_part", "_side", "node", "n", "v", "t")

    def close(leaders: list[tuple], batch: pa.RecordBatch) -> np.ndarray:
        """Which rows of ``batch`` (node, n, v, t) are close to which leaders: rows x leaders."""
        sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(batch.num_rows), sizes)
        values, times = batch.column(2).flatten(), batch.column(3).flatten().to_numpy(zero_copy_only=False)
        least = batch.column(1).to_numpy(zero_copy_only=False) * share
        kinds = pa.concat_arrays([k for _, k, _ in leaders]).unique()
        code = pc.fill_null(pc.index_in(values, value_set=kinds), -1).to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        owner, times = owner[order], times[order]
        edges = np.searchsorted(code[order], np.arange(len(kinds) + 1))
        out = np.zeros((batch.num_rows, len(leaders)), bool)
        for i, (_, k, held) in enumerate(leaders):
            near = np.zeros(len(times), bool)
            for c, own in zip(pc.index_in(k, value_set=kinds).to_pylist(), held):
                t = times[edges[c] : edges[c + 1]]
                first = np.searchsorted(own, t - tolerance)
                near[edges[c] : edges[c + 1]] = (first < len(own)) & (own[np.minimum(first, len(own) - 1)] <= t + tolerance)
            out[:, i] = np.bincount(owner[near], minlength=batch.num_rows) >= least
        return out

    def run(batches):
        key, leaders, root = None, [], np.empty(0, np.int64)
        for batch in batches:
            found: list[tuple[int, int]] = []
            marks = list(zip(*[batch.column(k).to_pylist() for k in range(3)]))
            starts = [i for i, m in enumerate(marks) if not i or m != marks[i - 1]]
            for lo, hi in zip(starts, [*starts[1:], len(marks)]):
                rows = pa.RecordBatch.from_arrays(batch.slice(lo, hi - lo).columns[3:], ["node", "n", "v", "t"])
                if marks[lo][:2] != key:
                    key, leaders = marks[lo][:2], []
                if not marks[lo][2]:
                    for node, v, t in zip(rows.column(0).to_pylist(), rows.column(2), rows.column(3)):
                        kinds, t = v.values.unique(), t.values.to_numpy(zero_copy_only=False)
                        of = pc.index_in(v.values, value_set=kinds).to_numpy(zero_copy_only=False)
                        leaders.append((node, kinds, [np.sort(t[of == c]) for c in range(len(kinds))]))
                    root = np.arange(len(leaders))
                    continue
                ids = rows.column(0).to_pylist()
                near = close(leaders, rows) & (np.asarray(ids)[:, None] != np.asarray([z[0] for z in leaders])[None, :])
                found += [(ids[x], leaders[int(near[x].argmax())][0]) for x in np.flatnonzero(near.any(axis=1)).tolist()]
                while True:
                    low, high = np.where(near, root, len(root)).min(axis=1), np.where(near, root, -1).max(axis=1)
                    joins = np.flatnonzero(low < high)
                    if not len(joins):
                        break
                    x = int(joins[0])
                    found += [(ids[x], leaders[i][0]) for i in np.flatnonzero(near[x]).tolist()]
                    root[np.isin(root, root[near[x]])] = low[x]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    grouped = both.repartition("block", "_part").sortWithinPartitions("block", "_part", "_side")
    links = staged(grouped.mapInArrow(run, "a long, b long"), "sequence-links")
    discard(lists)
    return links


def near_duplicate_sequences(events: DataFrame, block: str, seq: str, value: str, at: str, tolerance: int, share: float = 0.5) -> DataFrame:
    """Components of near-duplicate sequences of one block: block, seq, cluster (the least seq that links reach).

    A sequence x is close to z if at least ``share`` of its events have an event
    of z with the same value at most ``tolerance`` away; one direction is enough
    for a link. Times are whole numbers from the sequence's start; ``seq`` is a
    long and names a sequence in all blocks.

    Equal sequences are one node. First all meet the leaders of their block
    (``leader_links``), which joins most of a block whose sequences are widely
    close. No pairs of a whole block are formed for the rest: if enough events
    of x are matched, one of any n - ceil(share n) + 1 is, so x probes with
    those whose (value, time bin) the fewest sequences hold. Of what no leader
    reached, first only the least sequence of a bin is a partner, so a large
    group of copies is linked by hubs; then partners outside the own component
    are, and every candidate is verified by its events. Staged tables are small
    as files and large as rows, so their joins are merged, never broadcast.
    """
    own = events.select(block, seq, value, at, F.floor(F.col(at) / tolerance).alias("bin"))
    # Equal sequences by number, and two sums of hashes, of their events: one stands for all.
    prints = own.groupBy(block, seq).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.xxhash64(F.lit(salt), value, at).cast("decimal(38,0)")).alias(f"h{salt}") for salt in (1, 2)]
    )
    heads = prints.groupBy(block, "n", "h1", "h2").agg(F.min(seq).alias("node"))
    same = staged(prints.join(heads.hint("merge"), [block, "n", "h1", "h2"]).select(block, F.col(seq).alias("seq"), "node", "n"), "sequence-nodes")
    nodes = same.where("seq = node").select(block, "node", "n").hint("merge")
    notes = staged(own.join(nodes, (own[block] == nodes[block]) & (own[seq] == nodes["node"])).select(own[block], "node", value, at, "bin", "n"), "sequence-notes")
    links = leader_links(notes, block, value, at, tolerance, share)
    held = notes.select(block, value, "bin", "node").distinct()
    widths = held.groupBy(block, value, "bin").agg(F.count(F.lit(1)).alias("width"))
    rare = W.partitionBy(block, "node").orderBy("width", value, at)
    ranked = notes.join(widths.hint("merge"), [block, value, "bin"]).withColumn("rank", F.row_number().over(rare))
    asked = ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * share) + 1)
    probes = staged(asked.select(block, value, "node", F.explode(F.array(F.col("bin") - 1, "bin", F.col("bin") + 1)).alias("bin")).distinct(), "sequence-probes")

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among candidate pairs (block, x, z): of x's events, those with one of z near enough are counted."""
        x = notes.select(block, F.col("node").alias("x"), value, F.col(at).alias("ax"), "bin", "n")
        z = notes.select(block, F.col("node").alias("z"), value, F.col(at).alias("az"), F.explode(F.array(F.col("bin") - 1, "bin", F.col("bin") + 1)).alias("bin"))
        near = pairs.join(x.hint("merge"), [block, "x"]).join(z.hint("merge"), [block, "z", value, "bin"]).where(F.abs(F.col("ax") - F.col("az")) <= tolerance)
        # Equal events of x count each: they are grouped with how many they are, once per partner's event at most.
        once = near.groupBy(block, "x", "z", value, "ax").agg(F.first("n").alias("n"))
        times = notes.groupBy(block, F.col("node").alias("x"), value, F.col(at).alias("ax")).agg(F.count(F.lit(1)).alias("times"))
        counted = once.join(times.hint("merge"), [block, "x", value, "ax"]).groupBy(block, "x", "z", "n").agg(F.sum("times").alias("close"))
        return counted.where(F.col("close") >= F.col("n") * share).select(F.col("x").alias("a"), F.col("z").alias("b"))

    def linked(edges: DataFrame) -> DataFrame:
        return staged(components(edges).withColumnRenamed("node", "_n"), "sequence-components")

    def labelled(rows: DataFrame, found: DataFrame, name: str) -> DataFrame:
        return rows.join(found.hint("merge"), F.col("node") == F.col("_n"), "left").withColumn(name, F.coalesce("component", "node")).drop("_n", "component")

    led = linked(links)
    alone = led.select(F.col("_n").alias("node")).hint("merge")
    hubs = held.join(alone, "node", "left_anti").groupBy(block, value, "bin").agg(F.min("node").alias("z"))
    first = probes.join(alone, "node", "left_anti").join(hubs.hint("merge"), [block, value, "bin"]).where("node <> z").select(block, F.col("node").alias("x"), "z").distinct()
    more = staged(verified(first), "sequence-links")
    found = linked(links.unionByName(more))
    # Components that hold a bin, then their members: sets of one component are not paired again.
    members = staged(labelled(held, found, "cz"), "sequence-members")
    bins = members.select(block, value, "bin", "cz").distinct()
    apart = labelled(probes, found, "cx").join(bins.hint("merge"), [block, value, "bin"]).where("cx <> cz")
    rest = apart.join(members.withColumnRenamed("node", "z").hint("merge"), [block, value, "bin", "cz"]).select(block, F.col("node").alias("x"), "z").distinct()
    every = staged(verified(rest), "sequence-links")
    last = linked(links.unionByName(more).unionByName(every)).hint("merge")
    result = same.join(last, F.col("node") == F.col("_n"), "left").select(block, F.col("seq").alias(seq), F.coalesce("component", "node").alias("cluster"))
    done = staged(result, "sequence-clusters")
    discard(same, notes, probes, links, led, more, found, members, every)
    return done


def with_leads(clusters: DataFrame, cluster: list[str], order: list[Column], seq: str) -> DataFrame:
    """Add ``n_members`` and ``lead``: the first of each cluster in ``order``, then by ``seq``; aggregated before the join."""
    rank = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)], F.col(seq).alias("seq"))
    leads = clusters.groupBy(*cluster).agg(F.count(F.lit(1)).alias("n_members"), F.min(rank).alias("_l")).select(*cluster, "n_members", F.col("_l.seq").alias("lead"))
    return clusters.join(leads.hint("merge"), cluster)


def look_ahead(steps: int = 8):
    """Fold of two streams of groups (side, pos, counts) to the monotone greedy match: left, right, score.

    Side 0 is the right stream, whose group ``pos`` arrives before the left
    group pos div ``steps``; side 1 the left one. Each left group takes, of the
    next ``steps`` right groups, the one with the greatest score (ties: the
    nearest), ``steps`` times the overlap of the counts, less the difference of
    their sizes and the groups passed over; a negative score takes none. Groups
    up to the one taken are passed. Held are right groups that arrived and are
    not passed.
    """

    def fold(rows: Iterator[tuple]) -> Iterable[tuple]:
        ahead, at = deque(), 0
        for side, pos, counts in rows:
            if side == 0:
                ahead.append((counts, sum(counts)))
                continue
            size, best, score = sum(counts), None, -1
            for skipped, (other, n) in enumerate(islice(ahead, steps)):
                now = steps * sum(map(min, counts, other)) - abs(size - n) - skipped
                if now > score:
                    best, score = skipped, now
            if best is None:
                yield pos, None, None
                continue
            yield pos, at + best, score
            at += best + 1
            for _ in range(best + 1):
                ahead.popleft()

    return fold


def greedy_match(left: DataFrame, right: DataFrame, key: list[str], pos: str, counts: str, steps: int = 8) -> DataFrame:
    """Monotone greedy match of two sequences of groups per key with a look-ahead: key, left_pos, right_pos, score.

    Positions count from 0 without gaps; ``counts`` is an array of one length.
    The streams of a key are merged in one sorted partition and read by two
    cursors (see ``look_ahead``).
    """

    def side(df: DataFrame, number: int, order: Column) -> DataFrame:
        return df.select(*key, F.lit(number).alias("side"), F.col(pos).cast("long").alias("pos"), F.col(counts).cast("array<long>").alias("counts"), order.cast("long").alias("turn"))

    both = side(right, 0, F.floor(F.col(pos) / steps)).unionByName(side(left, 1, F.col(pos)))
    return ordered_fold(both, key, ["turn", "side", "pos"], ["side", "pos", "counts"], "left_pos bigint, right_pos bigint, score bigint", look_ahead(steps))
