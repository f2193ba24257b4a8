"""N-gram Jaccard join with an R-tree over count vectors.

The n-grams of a text are hashed into groups, and the counts by group are a
point. What two sets share is at most the sum of the coordinates' minima, and
what a set shares with any set below a node of the tree is at most the sum of
the minima with the node's upper corner. Subtrees whose bound is too small are
left out; pairs whose points pass are verified by their sets (``setjoin``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.setjoin import SetFilter, as_ratio, linked_sets

SHINGLE, SIMILARITY = 3, 0.9
#: Groups of n-grams (a power of two) and entries of a node.
GROUPS, FANOUT = 128, 16
#: Counts are stored in a byte; the greatest one means "as many or more".
MOST = (1 << 8) - 1


def count_vector(grams: np.ndarray) -> np.ndarray:
    """Counts of 64-bit n-gram hashes by group (their leading bits), as signed 64-bit words."""
    shift = np.uint64(64 - (GROUPS.bit_length() - 1))
    counts = np.bincount((grams >> shift).astype(np.int64), minlength=GROUPS)
    return np.minimum(counts, MOST).astype(np.uint8).view(np.int64)


def read_counts(words: np.ndarray) -> np.ndarray:
    """Points of stored count vectors; a count that was cut off bounds nothing."""
    counts = words.view(np.uint8).astype(np.int32)
    counts[counts == MOST] = np.iinfo(np.int32).max // GROUPS
    return counts


def bound_holds(shared, na, nb, similarity: float):
    """Whether sets of these sizes may be similar if they share at most ``shared``: s / (1 + s) of both sizes is needed."""
    over, under = as_ratio(similarity)
    return (over + under) * shared.astype(np.int64) >= over * (na + nb)


def sizes_allow(na, nb, similarity: float):
    """Whether the smaller size is large enough for the greater one."""
    over, under = as_ratio(similarity)
    return under * np.minimum(na, nb) >= over * np.maximum(na, nb)


def near_counts(na, nb, a, b, similarity: float) -> np.ndarray:
    """Whether pairs of sets are candidates by their sizes and count vectors."""
    return sizes_allow(na, nb, similarity) & bound_holds(np.minimum(a, b).sum(axis=1), na, nb, similarity)


class CountTree:
    """R-tree of count vectors, loaded at once.

    Points are ordered by halving the widest coordinate (the size is one of
    them), ``FANOUT`` neighbours make a node, and so on up to one root. A node
    keeps its upper corner, its least and greatest size and how many of its
    points are still free.
    """

    def __init__(self, sizes: np.ndarray, points: np.ndarray):
        self.order = self._tiles(np.column_stack([sizes, points]).astype(np.float64))
        at = self.order
        # Levels from the points up: upper corner, least size, greatest size, free points.
        self.levels = [(points[at], sizes[at], sizes[at], np.ones(len(at), np.int64))]
        while len(self.levels[-1][1]) > 1:
            corner, low, high, free = self.levels[-1]
            starts = np.arange(0, len(low), FANOUT)
            self.levels.append((np.maximum.reduceat(corner, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.add.reduceat(free, starts)))
        self.visited = 0

    @staticmethod
    def _tiles(values: np.ndarray) -> np.ndarray:
        """Order of the points: parts are halved along their widest coordinate, at whole nodes, until they are one."""
        done, open_parts = [], [np.arange(len(values))]
        while open_parts:
            part = open_parts.pop()
            if len(part) <= FANOUT:
                done.append(part)
                continue
            own = values[part]
            axis = int(own.std(axis=0).argmax())
            part = part[np.argsort(own[:, axis], kind="stable")]
            half = max(1, len(part) // FANOUT // 2) * FANOUT
            open_parts += [part[half:], part[:half]]
        return np.concatenate(done) if done else np.empty(0, np.int64)

    def take(self, places: np.ndarray) -> None:
        """Mark points (by place in the order) as no longer free."""
        for corner, low, high, free in self.levels:
            np.subtract.at(free, places, 1)
            places = places // FANOUT

    def near(self, place: int, similarity: float) -> np.ndarray:
        """Places of the free points that may be similar to the one at ``place``."""
        point, size = self.levels[0][0][place], self.levels[0][1][place]
        over, under = as_ratio(similarity)
        nodes = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            corner, low, high, free = self.levels[depth]
            nodes = nodes[nodes < len(low)]
            nodes = nodes[(free[nodes] > 0) & (under * high[nodes] >= over * size) & (under * size >= over * low[nodes])]
            self.visited += len(nodes)
            # A set below has at least the least size, and at least the size that the similarity asks for.
            least = np.maximum(low[nodes], -(-over * size // under))
            nodes = nodes[bound_holds(np.minimum(corner[nodes], point).sum(axis=1), size, least, similarity)]
            if depth:
                nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        return nodes


def candidate_groups(sizes: np.ndarray, points: np.ndarray, similarity: float) -> list[np.ndarray]:
    """Row numbers of each group of two or more sets that candidate pairs connect.

    What a search finds is taken from the tree, so a group of n near copies
    costs about n visits and not their pairs.
    """
    if len(sizes) <= FANOUT:
        return _leaf_groups(sizes, points, similarity)
    tree = CountTree(sizes, points)
    free = np.ones(len(sizes), bool)
    left, groups = len(sizes), []
    for root in range(len(sizes)):
        if not free[root]:
            continue
        group, queue = [root], [root]
        free[root] = False
        tree.take(np.array([root]))
        left -= 1
        while queue and left:
            found = tree.near(queue.pop(), similarity)
            if len(found):
                tree.take(found)
                free[found] = False
                left -= len(found)
                group += found.tolist()
                queue += found.tolist()
        if len(group) > 1:
            groups.append(tree.order[group])
    return groups


def _leaf_groups(sizes: np.ndarray, points: np.ndarray, similarity: float) -> list[np.ndarray]:
    """``candidate_groups`` of a tree that is one leaf: all its entries are compared at once."""
    shared = np.minimum(points[:, None], points[None]).sum(axis=2)
    near = sizes_allow(sizes[:, None], sizes[None], similarity) & bound_holds(shared, sizes[:, None], sizes[None], similarity)
    left, groups = np.ones(len(sizes), bool), []
    for root in range(len(sizes)):
        reached = np.zeros(len(sizes), bool)
        new = left & (np.arange(len(sizes)) == root)
        while new.any():
            reached |= new
            new = near[new].any(axis=0) & left & ~reached
        left &= ~reached
        if reached.sum() > 1:
            groups.append(np.flatnonzero(reached))
    return groups


COUNTS = SetFilter(GROUPS // 8, count_vector, read_counts, near_counts, candidate_groups)


def jaccard_components(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``.

    A document's set are its distinct shingles of ``size`` lower-cased words
    (fewer words: the whole as one). Two link when their Jaccard similarity is
    at least ``similarity``; ``component_id`` is the smallest doc_id that links
    reach. Texts of equal sets are one node, so a group of copies costs no
    pairs. Null and texts without words have no set, zero shingles and no link.
    Repeated rows repeat; a null doc_id is returned, and as component_id only
    where a component has no other; other columns are not read.
    """
    known, found = linked_sets(docs, size, similarity, COUNTS)
    nodes = known.where("n > 0").groupBy("sh").agg(F.min("doc_id").alias("_least"))
    joined = nodes.join(found.withColumnRenamed("node", "sh"), "sh", "left").withColumn("component", F.coalesce("component", "sh"))
    named = joined.groupBy("component").agg(F.min("_least").alias("component_id"))
    of = joined.select("sh", "component").join(named, "component").select("sh", "component_id")
    return known.join(of, "sh", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
