"""Components of sets of shingles by exact Jaccard similarity.

Sets meet in the buckets of the few shingles that each probes. In a bucket a
filter (``SetFilter``: a fixed-size mark of each set) splits the sets into
groups of candidates; equal groups of different buckets are one. The groups are
then verified by the exact similarity: first the largest group of each set, then
all groups that still hold two components.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import discard, staged
from tessella.llm.components import components

SEED = 42
#: Texts that the order of the shingles (not the result) is fitted on, and shingles it ranks.
ORDER_SAMPLE, MOST_COMMON = 4096, 1 << 17
#: Sets that one task of the exact search holds, and sets that a task remembers to have probed.
SEARCHED, SEEN_SETS = 8192, 1_000_000
#: Texts that a task cuts into sets at once.
CUT_ROWS = 1024
#: Sets of a bucket that the filter searches in one task; a larger bucket is a group as it is.
FILTERED = 1 << 17
#: Expected leaders of a group that no task holds: every block of the group is searched together with them.
LEADERS = 24
#: Turns of the exact search; the last one takes all groups that are open.
SEARCH_TURNS = 3


@dataclass(frozen=True)
class SetFilter:
    """A necessary condition of similarity that sets are judged by before they are compared.

    ``mark`` gives ``words`` signed 64-bit numbers of a set; ``read`` turns rows
    of them into what ``pairs`` (two rows of sizes and marks, pair by pair) and
    ``groups`` (a bucket's sizes and marks, to groups of row numbers that
    candidate pairs connect) take.
    """

    words: int
    mark: Callable[[np.ndarray], np.ndarray]
    read: Callable[[np.ndarray], np.ndarray]
    pairs: Callable[..., np.ndarray]
    groups: Callable[..., list[np.ndarray]]


def as_ratio(similarity: float) -> tuple[int, int]:
    """A similarity as a ratio of small integers, so that the threshold itself is exact."""
    ratio = Fraction(similarity).limit_denominator(10_000)
    return ratio.numerator, ratio.denominator


def spans(text: str, size: int) -> tuple[bytes, list[tuple[int, int]]]:
    """Lower-cased words joined by spaces and the byte spans of its shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return b"", []
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    ends = starts + lengths
    n = max(1, len(words) - size + 1)
    return b" ".join(words), list(zip(starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist()))


def prefix(shingles: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Leading shingles of a sorted set: two sets as similar as ``similarity`` share one of them.

    The order is any that all sets share; here by ``counts`` of the sorted
    ``common`` shingles (others have none), then by hash.
    """
    keep = len(shingles) - int(np.ceil(similarity * len(shingles) - 1e-9)) + 1 if len(shingles) else 0
    if not len(common):
        return shingles[:keep]
    at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
    return shingles[np.lexsort((shingles, np.where(common[at] == shingles, counts[at], 0)))][:keep]


def exact_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of row numbers that connect ``sets`` (distinct items) as the pairs of enough Jaccard similarity do.

    Search from one set to all that are not reached yet; the exact similarity is
    counted from postings and decides each edge, so none that fails hides another.
    """
    over, under = as_ratio(similarity)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    _, items, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    several = seen[items] > 1
    own = np.split(items[several], np.cumsum(np.bincount(owner[several], minlength=len(sets)))[:-1])
    order = np.argsort(items[several], kind="stable")
    holders, values = owner[several][order], items[several][order]
    first = np.searchsorted(values, np.arange(len(seen)))
    last = first + np.where(seen > 1, seen, 0)
    left = np.ones(len(sets), bool)
    edges: list[tuple[int, int]] = []
    queue: list[int] = []
    start = 0
    while left.any():
        if not queue:
            start += int(np.argmax(left[start:]))
            left[start] = False
            queue = [start]
        node = queue.pop()
        hits = [holders[first[i] : last[i]] for i in own[node].tolist()]
        shared = np.bincount(np.concatenate(hits), minlength=len(sets)) if hits else np.zeros(len(sets), np.int64)
        near = np.flatnonzero(left & (under * shared >= over * (sizes[node] + sizes - shared)))
        left[near] = False
        edges += [(node, int(f)) for f in near]
        queue += near.tolist()
    return edges


def runs(batches):
    """Rows of ``batches`` (sorted by the first column) as arrays that cut no run of equal first values."""
    held: list[np.ndarray] = []
    for batch in batches:
        rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)], axis=1)
        if not len(rows):
            continue
        if held and held[0][0, 0] != rows[-1, 0]:
            whole = np.concatenate([*held, rows])
            cut = int(np.searchsorted(whole[:, 0], rows[-1, 0]))
            yield whole[:cut]
            held = [whole[cut:]]
        else:
            held.append(rows)
            if held[0][0, 0] != held[-1][-1, 0]:
                whole = np.concatenate(held)
                cut = int(np.searchsorted(whole[:, 0], whole[-1, 0]))
                yield whole[:cut]
                held = [whole[cut:]]
    if held:
        yield np.concatenate(held)



def with_leaders(groups: DataFrame) -> DataFrame:
    """Parts in which the sets of ``groups`` (key, sh, members) meet first: part, id.

    A group that a task may hold is one part. A larger one is cut into blocks,
    and every block meets the group's leaders, about ``LEADERS`` sets chosen by
    hash: near copies of one text are linked by them, block by block.
    """
    large = F.col("members") > SEARCHED
    blocks = F.when(large, F.ceil(F.col("members") / (SEARCHED // 2))).otherwise(1).cast("long")
    own = F.array(F.pmod(F.xxhash64("sh"), blocks))
    leads = large & (F.pmod(F.xxhash64("sh", F.lit(7)), F.col("members")) < LEADERS)
    met = F.when(leads, F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(own)
    return groups.select(F.col("sh").alias("id"), F.explode(F.transform(met, lambda b: F.xxhash64("key", b))).alias("part"))


def left_over(groups: DataFrame, found: DataFrame) -> DataFrame:
    """Parts in which sets of large groups meet that the leaders left apart: part, id.

    Sets outside the most frequent component of a group, in blocks, meet all
    sets of the group, in blocks. Pairs inside that component need no search.
    """
    half = SEARCHED // 2
    own = groups.where(F.col("members") > SEARCHED).join(found.withColumnRenamed("node", "sh"), "sh", "left").select("key", "sh", F.coalesce("component", "sh").alias("of"))
    own = staged(own, "set-large")
    counts = own.groupBy("key", "of").agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy("key").agg(F.max(F.struct("n", "of")).alias("main"), F.sum("n").alias("n")).where("main.n < n")
    apart = own.join(most, "key").select("key", "sh", (F.col("of") != F.col("main.of")).alias("out"), F.ceil((F.col("n") - F.col("main.n")) / half).alias("outer"), F.ceil(F.col("n") / half).alias("inner"))

    def numbers(n):
        return F.sequence(F.lit(0).cast("long"), n - 1)

    x, b = F.pmod(F.xxhash64("sh"), F.col("outer")), F.pmod(F.xxhash64("sh"), F.col("inner"))
    asks = F.when(F.col("out"), F.transform(numbers(F.col("inner")), lambda i: F.xxhash64("key", x, i))).otherwise(F.expr("cast(array() as array<long>)"))
    meets = F.transform(numbers(F.col("outer")), lambda o: F.xxhash64("key", o, b))
    return apart.select(F.col("sh").alias("id"), F.explode(F.array_union(asks, meets)).alias("part"))


def linked_sets(docs: DataFrame, size: int, similarity: float, test: SetFilter) -> tuple[DataFrame, DataFrame]:
    """Sets of shingles of ``size`` words of all rows of ``docs``, and their components.

    Returns ``known`` (a row of ``docs`` each: doc_id, did: doc_id or the least
    long, th: hash of the text, sh: hash of the set, n: its size) and ``found``
    (node, component: for sets with a link, the smallest set hash they reach).
    A link is a pair of sets of at least ``similarity``; none is lost. Equal
    sets are one node, so copies cost no pairs.

    A bucket's sets are held by a task as marks, up to ``FILTERED``; the exact
    search holds ``SEARCHED`` sets (see ``with_leaders`` and ``left_over``).
    """
    import xxhash

    spark = docs.sparkSession
    marks = [f"w{k}" for k in range(test.words)]

    def cut_sets(column):
        for t in column.to_pylist():
            joined, cut = spans(t, size)
            yield np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in cut), "<u8", len(cut)))

    def few_rows(batches):
        return (whole.slice(at, CUT_ROWS) for whole in batches for at in range(0, whole.num_rows, CUT_ROWS))

    def shingles(batches):
        for batch in few_rows(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in cut_sets(batch.column(1))], pa.list_(pa.int64()))], ["id", "shingles"])

    own = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("did"), F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "th", F.xxhash64("text")
    )
    texts = own.select(F.col("th").alias("id"), "text")
    kinds = (*[pa.int64()] * (2 + test.words), pa.list_(pa.int64()))
    # A bounded sample of texts and of its common shingles decides only the order of shingles, not the result.
    few = texts.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(ORDER_SAMPLE)
    usual = (
        texts.join(F.broadcast(few), "id", "left_semi").groupBy("id").agg(F.first("text").alias("text")).mapInArrow(shingles, "id long, shingles array<long>")
        .select(F.explode("shingles").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
        .orderBy(F.col("n").desc(), "item").limit(MOST_COMMON).toPandas().sort_values("item")
    )
    common = spark.sparkContext.broadcast((usual["item"].to_numpy(np.int64), usual["n"].to_numpy(np.int64)))

    def heads(batches):
        seen: set[int] = set()
        for batch in few_rows(batches):
            rows = []
            for s in cut_sets(batch.column(0)):
                node = xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63)
                # A set probes once in a task, however many copies it has there.
                lead = np.empty(0, np.int64) if node in seen else prefix(np.sort(s.view(np.int64)), similarity, *common.value)
                if len(seen) < SEEN_SETS:
                    seen.add(node)
                rows.append((node, len(s), *test.mark(s).tolist(), lead))
            columns = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], ["doc_id", "did", "th", "sh", "n", *marks, "lead"])

    kind = own.schema["doc_id"].dataType.simpleString()
    mark_types = ", ".join(f"{m} long" for m in marks)
    marked = staged(own.select("text", "doc_id", "did", "th").mapInArrow(heads, f"doc_id {kind}, did long, th long, sh long, n long, {mark_types}, lead array<long>"), "set-heads")

    def recur(batches):
        for run in runs(batches):
            item, node, inner = run[:, 0], run[:, 1], run[:, 2]
            fresh = np.concatenate([[True], (item[1:] != item[:-1]) | (node[1:] != node[:-1])])
            item, node, inner = item[fresh], node[fresh], inner[fresh]
            begin = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
            m = np.diff(np.append(begin, len(item)))
            met = np.repeat(m, m)
            kept = (met > 1) & np.repeat(np.add.reduceat(inner, begin) > 0 if len(begin) else begin > 0, m)
            yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in (item, node, inner, met)], ["item", "sh", "inner", "m"])

    # The smaller set of a pair shares one of its first items by a stricter count: what it shares is 2 s / (1 + s) of it.
    over, under = as_ratio(similarity)
    stricter = F.col("n") - F.ceil(F.col("n") * F.lit(2 * over / (over + under)) - 1e-9)
    probed = marked.select("sh", stricter.alias("_inner"), F.posexplode("lead").alias("pos", "item")).select("item", "sh", (F.col("pos") <= F.col("_inner")).cast("long").alias("inner"))
    met = staged(probed.repartition("item").sortWithinPartitions("item", "sh").mapInArrow(recur, "item long, sh long, inner long, m long"), "set-buckets")
    known = staged(marked.drop("lead"), "set-nodes")
    discard(marked)
    nodes = known.groupBy("sh").agg(F.min(F.struct("did", "th")).alias("row"), *[F.first(c).alias(c) for c in ("n", *marks)])

    def gather(batches):
        for run in runs(batches):
            item, node, inner, n, bits = run[:, 0], run[:, 1], run[:, 2], run[:, 3], test.read(np.ascontiguousarray(run[:, 4:]))
            begin = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
            m = np.diff(np.append(begin, len(item)))
            # Most buckets hold two sets: these are judged at once.
            i = begin[m == 2]
            i = i[np.where(n[i] < n[i + 1], inner[i], np.where(n[i] > n[i + 1], inner[i + 1], inner[i] | inner[i + 1])) > 0]
            i = i[test.pairs(n[i], n[i + 1], bits[i], bits[i + 1], similarity)]
            a, b = np.minimum(node[i], node[i + 1]), np.maximum(node[i], node[i + 1])
            keys = (a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            out = [(np.repeat(keys.view(np.int64), 2), np.stack([a, b], axis=1).ravel(), np.full(2 * len(a), 2))]
            for lo, k in zip(begin[m > 2].tolist(), m[m > 2].tolist()):
                for group in test.groups(n[lo : lo + k], bits[lo : lo + k], similarity):
                    members = np.sort(node[lo + group])
                    key = xxhash.xxh64_intdigest(members.tobytes()) - (1 << 63)
                    out.append((np.full(len(members), key), members, np.full(len(members), len(members))))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["key", "sh", "members"])

    told = met.where(F.col("m") <= FILTERED).join(nodes, "sh").select("item", "sh", "inner", "n", *marks).repartition("item").sortWithinPartitions("item")
    hot = met.where(F.col("m") > FILTERED).select(F.col("item").alias("key"), "sh", F.col("m").alias("members"))
    groups = staged(told.mapInArrow(gather, "key long, sh long, members long").distinct().unionByName(hot), "set-groups")
    discard(met)
    asked = nodes.join(groups.select("sh").distinct(), "sh").select("row.did", "row.th", "sh")
    # One row stands for all copies; its key spreads them.
    whole = own.join(asked, ["did", "th"]).select("sh", "text")
    sets = staged(whole.mapInArrow(shingles, "id long, shingles array<long>"), "sets")

    def search(batches):
        part, ids, held = None, [], []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for p, d, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if p != part:
                    found += [(ids[a], ids[b]) for a, b in exact_forest(held, similarity)] if held else []
                    part, ids, held = p, [], []
                ids.append(d)
                held.append(s.values.to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])
        found = [(ids[a], ids[b]) for a, b in exact_forest(held, similarity)] if held else []
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    def searched(parts: DataFrame) -> DataFrame:
        met_sets = parts.join(sets, "id").select("part", "id", "shingles")
        return staged(met_sets.repartition("part").sortWithinPartitions("part").mapInArrow(search, "a long, b long"), "set-links")

    has_large = not groups.where(F.col("members") > SEARCHED).isEmpty()
    open_groups, done, edges, found = groups, None, None, None
    for turn in range(SEARCH_TURNS):
        if turn < SEARCH_TURNS - 1:
            chosen = open_groups.groupBy("sh").agg(F.max(F.struct("members", "key")).alias("top")).select("top.key").distinct()
        else:
            chosen = open_groups.select("key").distinct()
        chosen = staged(groups.join(chosen, "key", "left_semi"), "set-chosen")
        done = chosen if done is None else done.unionByName(chosen)
        for parts in (with_leaders, left_over) if has_large else (with_leaders,):
            links = searched(parts(chosen) if parts is with_leaders else parts(chosen, found))
            edges = links if edges is None else edges.unionByName(links)
            found = staged(components(edges), "set-components")
        # Still open: groups of two components or more that no searched group holds whole.
        of = F.coalesce("component", "sh")
        parted = groups.join(found.withColumnRenamed("node", "sh"), "sh", "left").groupBy("key").agg(F.min(of).alias("x"), F.max(of).alias("y")).where("x <> y")
        apart = groups.join(parted.select("key"), "key", "left_semi")
        inside = apart.join(done.select("sh", F.col("key").alias("_in")), "sh").groupBy("key", "_in").agg(F.count(F.lit(1)).alias("_n"), F.first("members").alias("_all"))
        open_groups = staged(apart.join(inside.where("_n = _all").select("key").distinct(), "key", "left_anti"), "set-open")
        if open_groups.isEmpty():
            break
    discard(groups, sets, done, edges, open_groups)
    return known, found
