"""SimHash near-duplicates by a generalised pigeonhole join.

The 64 bits are grouped into partitions of correlated bits. If two fingerprints
differ in at most D bits, then for any thresholds that sum to D - m + 1 over m
partitions (-1 leaves a partition out) some partition differs in at most its
threshold. Dynamic programming picks the partitions' thresholds that cost the
fewest estimated probes and candidates; fingerprints are probed within them and
verified, and the links of a bucket are reported as a spanning forest.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import discard, staged
from tessella.llm.components import components
from tessella.llm.setjoin import SetFilter, exact_forest, linked_sets, prefix, spans  # noqa: F401

BITS = 64
DISTANCE = 3
SHINGLE = 3
SEED = 42
#: Fingerprints that the plan (not the result) is fitted on.
PLAN_SAMPLE = 2048
#: Buckets of more members are split on before they are searched.
SMALL_BUCKET = 512
#: Buckets of so few members report all their links.
TINY_BUCKET = 16
# Similar documents: shingles of so many words and their Jaccard similarity.
CHECK_SHINGLE, SIMILARITY = 5, 0.8
#: Bits of 128 that candidates may differ in. Every bit of a pair at similarity 0.8 differs with a chance of 0.15, so
#: 19 bits are expected and more than 46 have a chance under 1e-8; small sets vary more and are not filtered.
FILTER_DISTANCE, FILTER_LEAST = 46, 32


def majority(hashes: np.ndarray) -> int:
    """Number whose bits are those set in over half of the 64-bit ``hashes``."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * counts > len(hashes)).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum())


def simhash(text: str, size: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of one text: majority of the XXH64 bits of its shingles, repeats included."""
    import xxhash

    joined, cut = spans(text, size)
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(joined[a:b], seed) for a, b in cut), "<u8", len(cut))) if cut else 0


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (signed 64-bit) of every row of ``docs``.

    A null or empty text has fingerprint zero; fewer words than a shingle are
    one shingle; texts are read whole.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            bits = np.asarray([simhash(t or "", size) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint long")


@dataclass(frozen=True)
class Plan:
    """Partitions (bit positions) and their thresholds; a threshold of -1 skips a partition."""

    parts: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]


def _bits(sample: np.ndarray) -> np.ndarray:
    """Bits of the rows of ``sample`` (rows x words), one column each."""
    return np.concatenate([((sample[:, [k]] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(float) for k in range(sample.shape[1])], axis=1)


def _masks(part: tuple[int, ...], words: int) -> np.ndarray:
    """Mask of a partition in each word."""
    return np.asarray([sum(1 << (b - BITS * k) for b in part if b // BITS == k) for k in range(words)], np.uint64)


def group_bits(sample: np.ndarray, m: int) -> list[tuple[int, ...]]:
    """Split the bits into ``m`` near-equal groups, correlated bits together."""
    bits = _bits(sample)
    n = bits.shape[1]
    if len(bits) < 2:
        return [tuple(range(k * n // m, (k + 1) * n // m)) for k in range(m)]
    centred = bits - bits.mean(axis=0)
    norm = np.sqrt((centred**2).sum(axis=0))
    like = np.abs(centred.T @ centred) / np.maximum(np.outer(norm, norm), 1e-9)
    # A constant bit separates nothing; it counts as correlated with every other.
    like[norm == 0, :] = like[:, norm == 0] = 1.0
    free, parts = np.ones(n, bool), []
    for k in range(m):
        room = int(free.sum()) // (m - k)
        part: list[int] = []
        pull = like[:, free].sum(axis=1)
        while len(part) < room:
            best = int(np.argmax(np.where(free, pull, -np.inf)))
            pull = like[:, best].copy() if not part else pull + like[:, best]
            part.append(best)
            free[best] = False
        parts.append(tuple(sorted(part)))
    return parts


def probes(width: int, radius: int) -> int:
    """Values within ``radius`` of a value of ``width`` bits."""
    total, term = 0, 1
    for r in range(radius + 1):
        total += term
        term = term * (width - r) // (r + 1)
    return total


def plan_join(sample: np.ndarray, rows: int, distance: int = DISTANCE, choices: tuple[int, ...] = (2, 3, 4), least: int = -1) -> Plan:
    """Cheapest plan for ``rows`` distinct fingerprints, judged on a sample of them.

    The cost of a partition is what it emits (index row and probes) plus its
    expected candidates: the share of sampled pairs within the threshold there
    (at least what random bits give) times all rows. No threshold is under
    ``least``.
    """
    best, best_cost = None, np.inf
    for m in choices:
        parts = group_bits(sample, m)
        budget = distance - m + 1
        top = max(0, min(distance, budget - least * (m - 1)))
        cost = np.zeros((m, top + 2))
        for i, part in enumerate(parts):
            own = sample & _masks(part, sample.shape[1])
            far = np.zeros(top + 1)
            for row in own:
                d = np.bitwise_count(own ^ row).sum(axis=1)
                far += [(d <= r).sum() - 1 for r in range(top + 1)]
            pairs = max(1, len(sample) * (len(sample) - 1))
            for r in range(top + 1):
                near = max(far[r] / pairs, probes(len(part), r) / 2.0 ** len(part))
                cost[i, r + 1] = 1 + (probes(len(part), r) if r else 0) + 0.05 * near * rows
        # table[s]: cheapest thresholds of the first partitions that sum to s.
        table: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for i in range(m):
            step: dict[int, tuple[float, tuple[int, ...]]] = {}
            for s, (c, chosen) in table.items():
                for r in range(least, top + 1):
                    new = (c + cost[i, r + 1], chosen + (r,))
                    if s + r not in step or new < step[s + r]:
                        step[s + r] = new
            table = step
        if budget in table and table[budget][0] < best_cost:
            best_cost, chosen = table[budget]
            best = Plan(tuple(parts), chosen)
    return best


def forest(prints: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Pairs of row numbers that connect ``prints`` (rows x words) as the links within ``distance`` do.

    Search from one member to all that are not reached yet, so a dense bucket
    takes about as many steps as it has members. Larger sets of one word are
    first split by their exact 16-bit blocks, one of which any linked pair
    shares. Tiny sets report every link.
    """
    rows = np.arange(len(prints))
    if len(prints) <= TINY_BUCKET:
        near = np.bitwise_count(prints[:, None, :] ^ prints[None, :, :]).sum(axis=2) <= distance
        return [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(near, 1)))]
    if len(prints) > SMALL_BUCKET and distance < 4 and prints.shape[1] == 1:
        edges: list[tuple[int, int]] = []
        for block in range(4):
            values = (prints[:, 0] >> np.uint64(16 * block)) & np.uint64(0xFFFF)
            order = np.argsort(values, kind="stable")
            for own in np.split(rows[order], np.flatnonzero(np.diff(values[order])) + 1):
                if len(own) > 1:
                    edges += _search(prints, own, distance)
        return edges
    return _search(prints, rows, distance)


def _search(prints: np.ndarray, rows: np.ndarray, distance: int) -> list[tuple[int, int]]:
    edges: list[tuple[int, int]] = []
    queue: list[int] = []
    left, bits = rows, prints[rows]
    while len(left):
        if not queue:
            queue, left, bits = [int(left[0])], left[1:], bits[1:]
        node = queue.pop()
        near = np.bitwise_count(bits ^ prints[node]).sum(axis=1) <= distance
        if near.any():
            found = left[near].tolist()
            edges += [(node, f) for f in found]
            queue += found
            left, bits = left[~near], bits[~near]
    return edges


def links(prints: DataFrame, words: list[str], distance: int = DISTANCE, choices: tuple[int, ...] = (2, 3, 4), least: int = -1, within: int | None = None) -> DataFrame:
    """Edges (a, b) between rows of ``prints`` (id and 64-bit columns ``words``).

    All pairs within ``distance`` meet in a bucket; pairs that meet and are
    within ``within`` bits (``distance`` if unset) are linked, by edges enough
    for the components of each bucket. Ids are distinct. Index rows and probe
    rows of a partition's value meet in one bucket; rows of a bucket are
    streamed in order through a task that searches it.
    """
    prints = prints.select("id", *words)
    within = distance if within is None else within
    # A bounded sample (PLAN_SAMPLE rows) decides only how the join is planned.
    few = prints.orderBy(F.xxhash64("id"), "id").limit(PLAN_SAMPLE).toPandas()
    sample = np.stack([few[w].to_numpy(np.int64).view(np.uint64) for w in words], axis=1) if len(few) else np.zeros((0, len(words)), np.uint64)
    plan = plan_join(sample, prints.count(), distance, choices, least)
    odd = np.asarray([2 * k * 0x9E3779B97F4A7C15 + 1 & (1 << 64) - 1 for k in range(len(words))], np.uint64)
    jobs = []
    for i, (part, radius) in enumerate(zip(plan.parts, plan.thresholds)):
        if radius >= 0:
            flips = [_masks(c, len(words)) for r in range(1, radius + 1) for c in combinations(part, r)]
            jobs.append((i, _masks(part, len(words)), np.stack([np.zeros(len(words), np.uint64), *flips])))
    names = ["part", "value", "id", *words]

    def spread(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                own = np.stack([batch.column(1 + k).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(len(words))], axis=1)
                for i, mask, flips in jobs:
                    # One number per value: the masked words, flipped, times odd factors.
                    values = (((own & mask)[:, None, :] ^ flips[None, :, :]) * odd).sum(axis=2, dtype=np.uint64)
                    index = np.repeat(np.arange(len(own)), len(flips))
                    again = [c.take(pa.array(index)) for c in batch.columns]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(values.size, i, np.int32)), pa.array(values.ravel().view(np.int64)), *again], names)

    def search(batches):
        key, held = None, []
        found: list[np.ndarray] = []

        def close():
            if sum(map(len, held)) > 1:
                rows = np.unique(np.concatenate(held), axis=0) if len(held) > 1 else np.unique(held[0], axis=0)
                if len(rows) > 1:
                    # The order of the search differs from bucket to bucket, and so do the trees.
                    rows = rows[np.argsort((rows[:, 0].view(np.uint64) ^ np.uint64(key[1] & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93))]
                    pairs = forest(np.ascontiguousarray(rows[:, 1:]).view(np.uint64), within)
                    if pairs:
                        found.append(rows[:, 0][np.asarray(pairs)])

        def out():
            pairs = np.concatenate(found) if found else np.empty((0, 2), np.int64)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            p, v, *rest = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns))
            if not len(p):
                continue
            rows = np.stack(rest, axis=1)
            new = np.flatnonzero((np.diff(p) != 0) | (np.diff(v) != 0)) + 1
            edges = [0, *new.tolist(), len(p)]
            for lo, hi in zip(edges, edges[1:]):
                if (int(p[lo]), int(v[lo])) != key:
                    close()
                    key, held = (int(p[lo]), int(v[lo])), []
                held.append(rows[lo:hi])
            yield out()
        close()
        yield out()

    wide = prints.mapInArrow(spread, "part int, value long, id long, " + ", ".join(f"`{w}` long" for w in words))
    buckets = wide.repartition("part", "value").sortWithinPartitions("part", "value")
    return buckets.mapInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, size: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of ``docs``.

    Rows with one fingerprint, copies among them, are one node of the search, so
    a group of copies costs no pairs. ``component_id`` is the smallest doc_id
    that links within ``distance`` reach. Null and empty texts have fingerprint
    zero and are linked like others; repeated rows repeat; a null doc_id is
    returned, and as component_id only where a component has no other.
    """
    own = staged(fingerprints(docs, size), "simhash")
    nodes = staged(own.groupBy("fingerprint").agg(F.min("doc_id").alias("_least")), "simhash-nodes")
    found = components(links(nodes.withColumnRenamed("fingerprint", "id").withColumn("w0", F.col("id")), ["w0"], distance))
    joined = nodes.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn(
        "component", F.coalesce("component", "fingerprint")
    )
    named = joined.groupBy("component").agg(F.min("_least").alias("component_id"))
    of = joined.select("fingerprint", "component").join(named, "component").select("fingerprint", "component_id")
    return own.join(of, "fingerprint").select("doc_id", "fingerprint", "component_id")


def wide_print(shingles: np.ndarray) -> np.ndarray:
    """128-bit SimHash of a set of 64-bit shingle hashes, as two signed words."""
    other = (shingles ^ (shingles >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return np.array([majority(shingles), majority(other ^ (other >> np.uint64(32)))], np.uint64).view(np.int64)


def near_groups(sizes: np.ndarray, prints: np.ndarray, similarity: float, distance: int = FILTER_DISTANCE) -> list[np.ndarray]:
    """Row numbers of each group of two or more sets that candidate pairs connect.

    A pair is a candidate if its sizes allow the similarity and its ``prints``
    are within ``distance`` bits; sets under ``FILTER_LEAST`` shingles are judged
    by size alone. Rows are walked by size, so a search looks only at sizes near.
    """
    order = np.argsort(sizes, kind="stable")
    n, bits = sizes[order], prints[order]
    low = np.searchsorted(n, np.ceil(similarity * n - 1e-9))
    high = np.searchsorted(n, np.floor(n / similarity + 1e-9), side="right")
    free = np.ones(len(n), bool)
    groups = []
    for root in range(len(n)):
        if not free[root]:
            continue
        free[root] = False
        group, queue = [root], [root]
        while queue:
            at = queue.pop()
            lo, hi = int(low[at]), int(high[at])
            near = (np.bitwise_count(bits[lo:hi] ^ bits[at]).sum(axis=1) <= distance) | (n[lo:hi] < FILTER_LEAST) | (n[at] < FILTER_LEAST)
            found = (np.flatnonzero(near & free[lo:hi]) + lo).tolist()
            free[found] = False
            group += found
            queue += found
        if len(group) > 1:
            groups.append(order[group])
    return groups


def near_prints(na, nb, a, b, similarity: float) -> np.ndarray:
    """Whether pairs of sets are candidates by their sizes and prints (see ``near_groups``)."""
    ok = np.minimum(na, nb) >= similarity * np.maximum(na, nb) - 1e-9
    return ok & ((np.bitwise_count(a ^ b).sum(axis=1) <= FILTER_DISTANCE) | (np.minimum(na, nb) < FILTER_LEAST))


#: Candidates among sets that share a probed shingle, by 128-bit SimHash.
PRINTS = SetFilter(2, wide_print, lambda words: words.view(np.uint64), near_prints, near_groups)


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY, size: int = CHECK_SHINGLE) -> DataFrame:
    """Groups of documents whose shingles are similar: did, th, component.

    One row per distinct text and doc_id (``did``: doc_id, a null as the least
    long; ``th``: text hash); ``component`` is the smallest set hash of the
    group. A link is a pair whose sets of shingles of ``size`` words have a
    Jaccard similarity of at least ``similarity``, and all links count. Texts of
    equal sets, copies and texts without words among them, are one node.

    The pigeonhole runs over the shingles as one-bit partitions: a pair that
    similar shares one of the few shingles that either probes (threshold zero),
    which are those with the fewest estimated candidates; all others are left
    out. In a shingle's bucket SimHash fingerprints split the sets into groups
    of candidates, which the exact similarity verifies (``setjoin``).
    """
    known, found = linked_sets(docs, size, similarity, PRINTS)
    of = known.select("did", "th", "sh").join(found.withColumnRenamed("node", "sh"), "sh", "left").select("did", "th", F.coalesce("component", "sh").alias("component"))
    return of.distinct()
