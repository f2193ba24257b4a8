"""Folds over the ordered rows of each key, streamed through sorted partitions."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Output rows a task holds before it passes them on.
BATCH_ROWS = 8192


def ordered_fold(df: DataFrame, key: list[str], order: list[str], values: list[str], schema: str, fold: Callable[[Iterator[tuple]], Iterable[tuple]]) -> DataFrame:
    """``fold`` over the ``values`` of each key in ``order``: key and the rows it yields (``schema``).

    For rules whose next step depends on what was accepted before, which no
    window can say. A key's rows are sorted in one partition, where Spark may
    spill, and reach ``fold`` as an iterator: a task holds what ``fold`` keeps,
    not the key. A key without rows is not called; null keys are one key.
    """
    width, rows = len(key), df.select(*key, *values, *order)
    typed = StructType([df.schema[k] for k in key] + list(StructType.fromDDL(schema)))
    arrow = to_arrow_schema(typed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
        made = (own + tuple(out) for own, part in groupby(flat, lambda row: row[:width]) for out in fold(row[width : width + len(values)] for row in part))
        while held := list(islice(made, BATCH_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    # A column may be a value and part of the order.
    names = [f"_{i}" for i in range(len(rows.columns))]
    ordered = rows.toDF(*names).repartition(*names[:width]).sortWithinPartitions(*names[:width], *names[width + len(values) :])
    return ordered.mapInArrow(run, typed)


def pack_rows(budget: int, prefix: int = 0, skip_oversize: bool = False):
    """Fold of (pos, cost) rows into chunks: chunk_id, first, last, items, tokens (see ``packing.fold_pack``)."""

    def fold(rows):
        n, now = 0, None
        for pos, cost in rows:
            large = cost + prefix > budget
            if now and now[3] + cost <= budget and not (large and skip_oversize):
                now = (now[0], pos, now[2] + 1, now[3] + cost)
                continue
            if now:
                yield (n, *now)
                n += 1
            now = None if large and skip_oversize else (pos, pos, 1, cost + prefix)
        if now:
            yield (n, *now)

    return fold


def accept_rows(budget: int, until_full: bool = False):
    """Fold of (id, cost) rows to the ids accepted when rows that do not fit are passed over.

    With ``until_full`` nothing follows once the budget is spent, rows that cost nothing neither.
    """

    def fold(rows):
        left = budget
        for own, cost in rows:
            if until_full and left <= 0:
                return
            if cost <= left:
                left -= cost
                yield (own,)

    return fold


def longest_spans(budget: int):
    """Fold of (pos, cost) rows to the longest span from each row that fits: first, last, cost.

    A row over the budget alone is a span of its own. Both ends only move on, so
    the rows of one span are held.
    """

    def fold(rows):
        held, total = deque(), 0
        for pos, cost in rows:
            while held and total + cost > budget:
                first, own = held.popleft()
                yield first, last, total
                total -= own
            held.append((pos, cost))
            total, last = total + cost, pos
        while held:
            first, own = held.popleft()
            yield first, last, total
            total -= own

    return fold


def segment_rows(least: int, most: int, length_score: Callable[[int, int], float], tail: Callable[[int], bool], prefer_long: bool = False):
    """Fold of (score) rows into segments: segment, start, n.

    From each start the segment ends where its last row's score plus
    ``length_score(n, room)`` is greatest, over the lengths from ``least`` to
    ``room`` = the rows left or ``most``; ties go to the shorter length, or with
    ``prefer_long`` to the longer. Where ``tail(room)`` holds, the rows left are
    one segment. Only ``most`` rows are held.
    """

    def fold(rows):
        segment, start, held = 0, 0, list(islice(((score,) for (score,) in rows), most))
        while held:
            room = len(held)
            if tail(room):
                n = room
            else:
                n = max(range(least, room + 1), key=lambda k: (held[k - 1][0] + length_score(k, room), k if prefer_long else -k))
            yield segment, start, n
            segment, start = segment + 1, start + n
            held = held[n:] + [(score,) for (score,) in islice(rows, n)]

    return fold


def consume_rows(rows):
    """Fold of (item, expected, total) rows to the range of groups each consumes: item, first, last.

    A row takes the next ``expected`` of ``total`` groups; one that expects none
    or more than are left takes nothing (null) and leaves the place as it is.
    """
    at = 0
    for item, expected, total in rows:
        if expected > 0 and at + expected <= total:
            yield item, at, at + expected - 1
            at += expected
        else:
            yield item, None, None
