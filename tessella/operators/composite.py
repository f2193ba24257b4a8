"""Best match under a composite distance: blocks of a k-d tree, each searched in a task by the boxes of its leaves."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.operators.staging import discard, staged

#: Different rows of the pool in a block, about; the driver holds the boxes of all blocks and ``FITTED`` rows a block.
BLOCK, MOST_BLOCKS, FITTED = 4096, 1024, 32
#: Queries that meet a copy of a block in one task, about, and those compared with all boxes at once.
MET, AT_ONCE = 8192, 1024
#: Different rows of the pool in a leaf; a leaf is compared whole.
LEAF = 32
#: Scores are rounded to so many digits; ties of rounded scores go to the smaller id.
DIGITS = 9
NO_ID = np.iinfo(np.int64).max


class Rows:
    """Columns of rows as arrays: values (0 for null), where they are null, histograms, and their points for splits."""

    def __init__(self, values: list[np.ndarray], nulls: list[np.ndarray], hist: np.ndarray):
        self.values, self.nulls, self.hist = values, nulls, hist

    @classmethod
    def of(cls, table: pa.Table | pa.RecordBatch, n: int) -> Rows:
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (table.column(f"w{i}") for i in range(n))]
        lists = table.column("h")
        flat = (lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists).flatten().to_numpy(zero_copy_only=False)
        values = [c.fill_null(0).to_numpy(zero_copy_only=False) for c in columns]
        return cls(values, [c.is_null().to_numpy(zero_copy_only=False) for c in columns], flat.reshape(table.num_rows, -1 if len(flat) else 0))

    def take(self, at) -> Rows:
        return Rows([v[at] for v in self.values], [z[at] for z in self.nulls], self.hist[at])

    def points(self) -> np.ndarray:
        return np.column_stack([*[np.where(z, -1.0, v) for v, z in zip(self.values, self.nulls)], self.hist]).astype(float)


class Metric:
    """The distance: weighted relative deltas, and the histograms' difference over the counts (column ``count``)."""

    def __init__(self, weights: list[float], count: int, hist_weight: float):
        self.weights, self.count, self.hist_weight = weights, count, hist_weight

    def between(self, a: Rows, b: Rows) -> np.ndarray:
        """Distances of all rows of ``a`` and ``b``; a delta from null is zero, as is one whose larger value is zero."""
        total = 0.0
        for w, x, y, xn, yn in zip(self.weights, a.values, b.values, a.nulls, b.nulls):
            larger = np.maximum(x[:, None], y[None, :]).astype(float)
            void = (larger == 0) | xn[:, None] | yn[None, :]
            larger[void] = 1.0
            delta = np.abs(x[:, None] - y[None, :]) / larger
            delta[void] = 0.0
            total = total + w * delta
        apart = np.zeros((len(a.hist), len(b.hist)), np.int64)
        for i in range(a.hist.shape[1]):
            apart += np.abs(a.hist[:, i, None] - b.hist[None, :, i])
        return total + self.hist_weight * (apart / np.maximum(1, a.values[self.count][:, None] + b.values[self.count][None, :]))

    def least(self, a: Rows, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Bounds of the distances of rows of ``a`` to all that boxes hold (boxes x columns; infinite where a box has a null)."""
        total, n = np.zeros((len(a.hist), len(low))), len(self.weights)
        for i, (w, x, z) in enumerate(zip(self.weights, a.values, a.nulls)):
            x = x.astype(float)[:, None]
            near = np.clip(x, low[None, :, i], high[None, :, i])
            larger = np.maximum(x, near)
            total += np.where((larger == 0) | z[:, None], 0.0, w * np.abs(x - near) / np.where(larger == 0, 1.0, larger))
        apart = np.zeros_like(total)
        for i in range(a.hist.shape[1]):
            x = a.hist[:, i, None].astype(float)
            apart += np.abs(x - np.clip(x, low[None, :, n + i], high[None, :, n + i]))
        total += self.hist_weight * apart / np.maximum(1.0, a.values[self.count][:, None] + high[None, :, self.count])
        # A negative value has negative deltas to others, which nothing bounds.
        total[np.any([v < 0 for v in a.values], axis=0)] = -np.inf
        return total

    def widest(self, points: np.ndarray) -> int | None:
        """The column to split rows by: that whose values lie furthest apart as the distance counts; none if all are equal."""
        low, high = np.quantile(points, [0.05, 0.95], axis=0)
        n = len(self.weights)
        logs = np.log(np.maximum(points[:, :n], 1e-9))
        wide = np.r_[np.minimum(np.ptp(np.quantile(logs, [0.05, 0.95], axis=0), axis=0), 2) * self.weights, (high[n:] - low[n:]) * self.hist_weight / max(1.0, 2 * np.median(points[:, self.count]))]
        flat = points.min(axis=0) == points.max(axis=0)
        if flat.all():
            return None
        return int(np.where(flat, -1.0, wide).argmax())


def split(points: np.ndarray, metric: Metric, depth: int, least: int = 1) -> tuple | None:
    """Tree of halvings (column, greatest value of the lower half, lower, upper) of ``points``; a leaf is None."""
    column = metric.widest(points) if depth > 0 and len(points) > least else None
    if column is None:
        return None
    own = points[:, column]
    cut = np.partition(own, (len(own) - 1) // 2)[(len(own) - 1) // 2]
    if cut == own.max():
        cut = own[own < cut].max()
    return column, cut, split(points[own <= cut], metric, depth - 1, least), split(points[own > cut], metric, depth - 1, least)


def leaves(tree: tuple | None, points: np.ndarray) -> list[np.ndarray]:
    """Places of ``points`` in each leaf of ``tree``, in the order of the leaves."""

    def down(node, at):
        if node is None:
            return [at]
        lower = points[at, node[0]] <= node[1]
        return down(node[2], at[lower]) + down(node[3], at[~lower])

    return down(tree, np.arange(len(points)))


def rounded(x: np.ndarray) -> np.ndarray:
    """``x`` rounded as Spark rounds doubles: half up by their decimal digits."""
    scale = 10.0**DIGITS
    y = x * scale
    out = np.floor(y + 0.5) / scale
    for i in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-4):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-DIGITS), ROUND_HALF_UP))
    return out


class Found:
    """Best matches of queries so far: rounded scores, ids of matches, rows compared."""

    def __init__(self, ids: np.ndarray, score: np.ndarray, match: np.ndarray):
        self.ids, self.score, self.match, self.compared = ids, score, match, np.zeros(len(ids), np.int64)

    def hopeful(self, least: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether rows at ``least`` distances and of ids from ``first`` on may be better, or as good with a smaller id."""
        half = 0.5 * 10.0**-DIGITS
        score, match = self.score[:, None], self.match[:, None]
        return (least <= score - 0.8 * half) | ((least <= score + 1.2 * half) & (first[None, :] < match))

    def meet(self, at: np.ndarray, distances: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
        """Queries ``at`` are compared with rows, each of which stands for its two smallest ids; no query matches its own."""
        other = np.where(first[None, :] != self.ids[at, None], first[None, :], second[None, :])
        distances = np.where(other == NO_ID, np.inf, distances)
        self.compared[at] += (other != NO_ID).sum(axis=1)
        least = distances.min(axis=1)
        row, column = np.nonzero((distances <= least[:, None] + 1.2 * 10.0**-DIGITS) & np.isfinite(least)[:, None])
        scores, matches = rounded(distances[row, column]), other[row, column]
        order = np.lexsort((matches, scores, row))
        row, scores, matches = row[order], scores[order], matches[order]
        head = np.r_[True, row[1:] != row[:-1]] if len(row) else np.empty(0, bool)
        row, scores, matches = at[row[head]], scores[head], matches[head]
        better = (scores < self.score[row]) | ((scores == self.score[row]) & (matches < self.match[row]))
        self.score[row[better]], self.match[row[better]] = scores[better], matches[better]


def boxes_of(points: np.ndarray, nulls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest values of each column; infinite where one is null."""
    low, high = points.min(axis=0), points.max(axis=0)
    low[: len(nulls)][nulls], high[: len(nulls)][nulls] = -np.inf, np.inf
    return low, high


def search(found: Found, queries: Rows, pool: Rows, first: np.ndarray, second: np.ndarray, metric: Metric) -> None:
    """Compare queries with the leaves of a block that may hold a better match, the nearest leaf first."""
    points = pool.points()
    parts = leaves(split(points, metric, 64, LEAF), points)
    held = [(pool.take(at), first[at], second[at]) for at in parts]
    edges = [boxes_of(points[at], np.asarray([z[at].any() for z in pool.nulls])) for at in parts]
    low, high = np.asarray([e[0] for e in edges]), np.asarray([e[1] for e in edges])
    heads = np.asarray([first[at].min() for at in parts])
    for start in range(0, len(found.ids), MET):
        rows = np.arange(start, min(start + MET, len(found.ids)))
        least = np.concatenate([metric.least(queries.take(rows[k : k + AT_ONCE]), low, high) for k in range(0, len(rows), AT_ONCE)])
        nearest = least.argmin(axis=1)
        for turn in (0, 1):
            for leaf, (own, one, two) in enumerate(held):
                here = nearest == leaf
                now = Found(found.ids[rows], found.score[rows], found.match[rows]).hopeful(least[:, leaf : leaf + 1], heads[leaf : leaf + 1])[:, 0]
                at = rows[now & (~here if turn else here)]
                if len(at):
                    found.meet(at, metric.between(queries.take(at), own), one, two)


def best_match(queries: DataFrame, pool: DataFrame, query_id: str, pool_id: str, weights: dict[str, float], count: str, hist: str, hist_weight: float, second: str | None = None) -> DataFrame:
    """For each query the row of the pool with the least composite distance: ids, score, n_compared.

    The distance is the weighted sum of the relative deltas of the columns in
    ``weights`` (positive weights; ``count``, the histogram's sum, among them)
    and of the histograms' distance, rounded. Ties go to the smaller
    ``pool_id``; a row is no match of itself. Ids are longs, histograms of one
    length. ``second`` is not needed any more: all columns part the rows.

    Rows of the pool that are equal but for their ids are one, with their two
    smallest ids. A k-d tree over all columns, fitted on a bounded sample, deals
    them to blocks; the sample decides where a row lies, not what is found. A
    query meets its own block, whose best match bounds its distance, then the
    blocks whose boxes are within that bound, and in each of them the leaves
    whose boxes are (rows compared: ``n_compared``). Queries of a block are cut
    into groups, each of which meets a copy of the block in one task.
    """
    names = list(weights)
    metric = Metric(list(weights.values()), names.index(count), hist_weight)
    n = len(names)
    features = [*[f"w{i}" for i in range(n)], "h"]

    def plain(df: DataFrame, key: str) -> DataFrame:
        return df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), *[F.col(c).alias(f"w{i}") for i, c in enumerate(names)], F.col(hist).cast("array<long>").alias("h"))

    asked = staged(plain(queries, query_id), "match-queries")
    given = asked if pool is queries and query_id == pool_id else plain(pool, pool_id)
    turn = F.dense_rank().over(W.partitionBy(*features).orderBy("id"))
    least = given.withColumn("_turn", turn).where("_turn <= 2").groupBy(*features).agg(F.min("id").alias("first"), F.max("id").alias("_last"))
    nodes = staged(least.withColumn("second", F.when(F.col("_last") > F.col("first"), F.col("_last")).otherwise(F.lit(int(NO_ID)))).drop("_last"), "match-pool")
    blocks = min(MOST_BLOCKS, -(-nodes.count() // BLOCK))  # one number
    sample = nodes.orderBy(F.xxhash64("first", "second"), "first").select(*features).limit(FITTED * max(1, blocks)).toArrow()
    if not sample.num_rows:
        return asked.select(F.col("id").alias(query_id), F.col("id").alias("match_id"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_compared")).limit(0)
    fitted = Rows.of(sample, n)
    tree, bins = split(fitted.points(), metric, (blocks - 1).bit_length()), fitted.hist.shape[1]

    def placed(df: DataFrame) -> DataFrame:
        """``df`` with the number of the block that each row lies in."""

        def run(batches):
            for batch in batches:
                block = np.zeros(batch.num_rows, np.int32)
                if batch.num_rows and tree is not None:
                    for number, at in enumerate(leaves(tree, Rows.of(batch, n).points())):
                        block[at] = number
                yield batch.append_column("block", pa.array(block))

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
        return df.mapInArrow(run, f"{kinds}, block int")

    held = staged(placed(nodes), "match-blocks")
    spans = [f(c).alias(f"{f.__name__}{i}") for i, c in enumerate([*[F.col(f"w{k}") for k in range(n)], *[F.col("h")[k] for k in range(bins)]]) for f in (F.min, F.max)]
    edges = held.groupBy("block").agg(*spans, *[F.max(F.col(f"w{k}").isNull()).alias(f"null{k}") for k in range(n)], F.min("first").alias("head")).orderBy("block").collect()  # a row a block
    low, high = (np.asarray([[np.nan if e[f"{f}{i}"] is None else e[f"{f}{i}"] for i in range(n + bins)] for e in edges], float).reshape(len(edges), n + bins) for f in ("min", "max"))
    void = np.asarray([[i < n and e[f"null{i}"] for i in range(n + bins)] for e in edges], bool).reshape(low.shape)
    low, high = np.where(void, -np.inf, low), np.where(void, np.inf, high)
    numbers, heads = np.asarray([e["block"] for e in edges], np.int32), np.asarray([e["head"] for e in edges], np.int64)

    def met(rows: DataFrame, last: bool) -> DataFrame:
        """Queries (with score and match so far) meet their ``block``; unless ``last``, they learn what others may hold a match."""
        groups = F.broadcast(rows.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / MET).alias("_groups")))  # a row a block
        left = rows.join(groups, "block").withColumn("_group", F.pmod(F.xxhash64("id"), "_groups")).drop("_groups")
        right = held.join(groups, "block").withColumn("_group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_groups") - 1))).drop("_groups")

        def run(own: pa.Table, other: pa.Table) -> pa.Table:
            score, match = own.column("score").to_numpy().copy(), own.column("match").to_numpy().copy()
            found, asking = Found(own.column("id").to_numpy(), score, match), Rows.of(own, n)
            if own.num_rows and other.num_rows:
                search(found, asking, Rows.of(other, n), other.column("first").to_numpy(), other.column("second").to_numpy(), metric)
            result = pa.table({"id": own.column("id"), "score": found.score, "match": found.match, "n_compared": found.compared})
            if last:
                return result
            rest, block = [], own.column("block").to_numpy()
            for k in range(0, own.num_rows, AT_ONCE):
                some = slice(k, k + AT_ONCE)
                near = Found(found.ids[some], found.score[some], found.match[some]).hopeful(metric.least(asking.take(some), low, high), heads)
                rest += [numbers[r] for r in near & (block[some, None] != numbers[None, :])]
            result = result.append_column("rest", pa.array(rest, pa.list_(pa.int32())))
            for c in features:
                result = result.append_column(c, own.column(c))
            return result

        more = "" if last else ", rest array<int>, " + ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in features)
        return left.groupBy("block", "_group").cogroup(right.groupBy("block", "_group")).applyInArrow(run, f"id long, score double, match long, n_compared long{more}")

    unmatched = staged(placed(asked).withColumn("score", F.lit(float("inf"))).withColumn("match", F.lit(int(NO_ID))), "match-placed")
    near = staged(met(unmatched, False), "match-near")
    far = near.select("id", "score", "match", *features, F.explode("rest").alias("block"))
    both = near.select("id", "score", "match", "n_compared").unionByName(met(far, True))
    best = both.groupBy("id").agg(F.min(F.struct("score", "match")).alias("_b"), F.sum("n_compared").alias("n_compared")).where(F.col("_b.match") != int(NO_ID))
    done = staged(best.select(F.col("id").alias(query_id), F.col("_b.match").alias("match_id"), F.col("_b.score").alias("score"), "n_compared"), "match-best")
    discard(asked, nodes, held, unmatched, near)
    return done
