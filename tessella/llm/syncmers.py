"""Document fingerprints of closed syncmers.

A k-mer of code points is an anchor if the smallest hash among its s-mers is
that of its first or last one. The choice depends on nothing outside the k-mer,
so an edit moves or removes only the anchors it touches. A fingerprint keeps the
anchors with the smallest hashes and where each first occurs.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K, S = 16, 6
SKETCH = 64
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Rows are read in slices of this many, so that a batch of long texts stays small.
SLICE = 256


def _mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values by shifts and odd factors."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 32-bit hashes of the closed syncmers of ``text``.

    A text shorter than k has one anchor, itself; an empty text has none.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if not len(points):
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    if len(points) < k:
        powers = BASE ** np.arange(len(points), dtype=np.uint64)
        whole = _mixed(np.asarray([(points * powers).sum() + np.uint64(len(points))], np.uint64))
        return np.zeros(1, np.int64), (whole >> np.uint64(32)).astype(np.uint32)
    n = len(points) - s + 1
    inner = points[:n].copy()
    for j in range(1, s):
        inner *= BASE
        inner += points[j : j + n]
    inner = _mixed(inner)
    width = k - s + 1
    least, span = inner, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(inner) - width + 1], least[width - span :][: len(inner) - width + 1])
    last = inner[width - 1 :]
    at = np.flatnonzero((inner[: len(least)] == least) | (last == least))
    hashes = inner[at].copy()
    for j in (*range(s, k - s, s), k - s):
        hashes = _mixed(hashes * BASE + inner[at + j])
    return at, (hashes >> np.uint64(32)).astype(np.uint32)


def fingerprint(text: str, size: int | None = SKETCH) -> tuple[np.ndarray, np.ndarray]:
    """The ``size`` smallest distinct anchor hashes (None: all), ascending, and their first positions."""
    at, hashes = anchors(text)
    distinct, first = np.unique(hashes, return_index=True)
    return distinct[:size], at[first[:size]]


def written(print_: tuple[np.ndarray, np.ndarray]) -> str:
    """A fingerprint as text: hash@position, both hexadecimal, comma-joined."""
    return ",".join(f"{h:08x}@{p:x}" for h, p in zip(print_[0].tolist(), print_[1].tolist()))


def sketch(whole: tuple[np.ndarray, np.ndarray], size: int = SKETCH) -> str:
    """The ``size`` smallest anchors of all, written."""
    return written((whole[0][:size], whole[1][:size]))


def read(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Undo :func:`written`."""
    pairs = [item.split("@") for item in text.split(",")] if text else []
    return np.asarray([int(h, 16) for h, _ in pairs], np.uint32), np.asarray([int(p, 16) for _, p in pairs], np.int64)


def in_order(a: list[int], b: list[int]) -> int:
    """Most pairs (a[i], b[i]) that ascend together: the longest positional match. No two of ``a`` are equal."""
    placed = sorted(zip(a, b))
    if all(x[1] < y[1] for x, y in zip(placed, placed[1:])):
        return len(placed)
    tails: list[int] = []
    for _, at in placed:
        i = bisect_left(tails, at)
        tails[i : i + 1] = [at]
    return len(tails)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size: int | None = SKETCH) -> float:
    """Share of anchors that two texts have in common and in one order (Dice), 0 to 1.

    ``a`` and ``b`` are fingerprints. Among the ``size`` smallest hashes of both
    together, those that both hold and whose positions match in order estimate a
    Jaccard similarity J; the share is 2J / (1 + J). With all anchors and no
    ``size`` it is exact. Two empty texts are alike.
    """
    if not len(a[0]) and not len(b[0]):
        return 1.0
    union = np.union1d(a[0], b[0])[:size]
    shared, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    counted = shared <= union[-1]
    jaccard = in_order(a[1][ia[counted]].tolist(), b[1][ib[counted]].tolist()) / len(union)
    return float(2 * jaccard / (1 + jaccard))


def matches(a: str, b: str) -> list[tuple[int, int]]:
    """Where the shared anchors of two written fingerprints lie in either text."""
    (ha, pa_), (hb, pb) = read(a), read(b)
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    return sorted(zip(pa_[ia].tolist(), pb[ib].tolist()))


def anchor_table(docs: DataFrame) -> DataFrame:
    """doc_id, hash and position of every anchor of every row, for positional matching of whole texts.

    Nothing is left out, however long a text is; null and empty texts have no
    row; repeated rows repeat theirs; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                found = [anchors(t or "") for t in batch.column(1).to_pylist()]
                index = np.repeat(np.arange(len(found)), [len(p) for p, _ in found])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(index)), pa.array(np.concatenate([h for _, h in found]).astype(np.int64)), pa.array(np.concatenate([p for p, _ in found]))],
                    ["doc_id", "hash", "position"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, hash long, position long")


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the start of ``following``."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def with_following(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows of ``docs`` bucketed by ranges of doc_id, each range with the start of the next.

    Returns _bucket, _guest, doc_id, text, sorted in each partition, so that the
    row after a document is the next one by doc_id. The first rows of a range
    are also given, as guests, to the range before it; those of the first range
    to the last one. The bounds are quantiles of doc_id, one per partition.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    own = docs.select(key.alias("_key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marks = own.agg(F.percentile_approx("_key", [i / n for i in range(1, n)], 10000).alias("m")).first()["m"] if n > 1 else []
    bounds = sorted(set(marks or []))
    # Two steps of about the square root of the number of bounds each.
    step = max(1, math.isqrt(len(bounds)))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]

    def below(marks: Column) -> Column:
        return F.size(F.filter(marks, lambda b: F.col("_key") > b))

    coarse = below(F.array(*[F.lit(p[-1]) for p in parts]))
    fine = F.get(F.array(*[F.array(*[F.lit(b) for b in p]) for p in parts]), coarse)
    above = coarse * step + F.when(coarse < len(parts), below(fine)).otherwise(0) if bounds else F.lit(0)
    if bounds and len(bounds) % step:
        above = F.least(above, F.lit(len(bounds)))
    ranged = own.withColumn("_bucket", above)
    # One row per range: its smallest key.
    firsts = sorted((r["_bucket"], r["least"]) for r in ranged.groupBy("_bucket").agg(F.min("_key").alias("least")).collect())
    buckets = [b for b, _ in firsts]
    # Range number to its smallest key and to the range before it; ranges without rows have none.
    least_of, before_of = dict(firsts), dict(zip(buckets, [*buckets[-1:], *buckets[:-1]]))
    spots = range(len(bounds) + 1)
    first_key = F.get(F.array(*[F.lit(least_of.get(b)).cast("long") for b in spots]), F.col("_bucket"))
    guest = F.when(F.col("_key") == first_key, F.get(F.array(*[F.lit(before_of.get(b)).cast("int") for b in spots]), F.col("_bucket")))
    copies = F.array_compact(F.array(F.struct(F.col("_bucket"), F.lit(0).alias("_guest")), F.when(guest.isNotNull(), F.struct(guest.alias("_bucket"), F.lit(1).alias("_guest")))))
    spread = ranged.withColumn("_copy", F.explode(copies)).select("_copy.*", "doc_id", "text")
    return spread.repartitionById(n, F.col("_bucket")).sortWithinPartitions("_bucket", "_guest", F.col("doc_id").asc_nulls_first(), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint every row of ``docs`` (doc_id, text) and its edited text.

    Returns doc_id, n_chars, edited, fingerprint, edited_fingerprint,
    near_edited and near_next. A null text is empty. Rows follow by doc_id, then
    text; a null doc_id comes first; repeated rows follow each other; the last
    row is followed by the first, a single one by itself. Texts are whole and
    likeness counts all their anchors; a written fingerprint keeps the ``SKETCH``
    smallest, from which likeness can be estimated (error about 0.06). Other
    columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        held = None
        key = pa.int64()

        def done(row, text, own):
            _, doc_id, said, mine = row
            new = edited(said, text)
            changed = fingerprint(new, None)
            return (doc_id, len(said), new, sketch(mine), sketch(changed), likeness(mine, changed, None), likeness(mine, own, None))

        def flush(rows):
            kinds = (key, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        for whole in batches:
            key = whole.schema.field(2).type
            for at in range(0, whole.num_rows, SLICE):
                batch, rows = whole.slice(at, SLICE), []
                for bucket, guest, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    if guest and held is None:
                        continue
                    own = fingerprint(text, None)
                    if held is not None:
                        rows.append(done(held, text, own))
                    held = None if guest else (bucket, doc_id, text, own)
                if rows:
                    yield flush(rows)

    schema = f"doc_id {kind}, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_following(docs).mapInArrow(run, schema)

