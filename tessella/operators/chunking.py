"""Chunkers that split oversize units, boundary segmentation, and repetition to a target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.operators.folds import ordered_fold, segment_rows
from tessella.operators.packing import fold_pack
from tessella.operators.ranking import running_sum
from tessella.operators.text import WORD, with_value, words

#: Boundary bonus by length of a segment.
PREFERRED = {4: 40, 8: 35}
SEGMENT = "segment int, start bigint, n bigint"


def line_units(text: Column, budget: int | Column) -> Column:
    """Non-blank lines as units; a line of more than ``budget`` words is split into runs of that many."""

    def units(own: Column) -> Column:
        starts = F.when(F.size(own) > 0, F.sequence(F.lit(1), F.size(own), F.lit(budget)))
        return F.coalesce(F.transform(starts, lambda i: F.array_join(F.slice(own, i, budget), " ")), F.expr("cast(array() as array<string>)"))

    return F.flatten(F.transform(F.split(text, "\n", -1), lambda line: with_value(words(line), units)))


def chunk_text(docs: DataFrame, key: str, text: str, budget: int, opening: Column | None = None, closing: Column | None = None) -> DataFrame:
    """Chunks of at most ``budget`` words: key, chunk_id, n_units, num_tokens, chunk.

    Lines are packed greedily and never cut unless a line alone exceeds the
    budget. With ``opening`` and ``closing`` the text is the body of a fenced
    block: each chunk is a block of its own, whose fences count. A text is one
    row, so nothing is shuffled.
    """
    edges = [e if e is not None else F.lit("") for e in (opening, closing)]
    fences = F.size(words(edges[0])) + F.size(words(edges[1]))
    units = docs.select(key, edges[0].alias("_open"), edges[1].alias("_close"), fences.alias("_fences"), F.col(text).alias("_text"))
    units = units.withColumn("_units", line_units(F.col("_text"), F.greatest(F.lit(1), F.lit(budget) - F.col("_fences"))))
    costs = F.transform("_units", lambda u, i: F.struct(i.cast("long").alias("pos"), F.size(F.split(u, " ")).cast("long").alias("cost")))
    packed = units.select(key, "_open", "_close", "_units", F.posexplode(fold_pack(costs, budget, F.col("_fences"))).alias("chunk_id", "_c"))
    own = F.slice("_units", (F.col("_c.first") + 1).cast("int"), F.col("_c.items").cast("int"))
    fence = [F.filter(F.array(e), lambda x: x != "") for e in ("_open", "_close")]
    body = F.array_join(F.concat(fence[0], own, fence[1]), "\n")
    return packed.select(key, "chunk_id", F.col("_c.items").alias("n_units"), F.col("_c.tokens").alias("num_tokens"), body.alias("chunk"))


def chunk_chars(docs: DataFrame, key: str, text: str, heading: Column, budget: int) -> DataFrame:
    """Chunks of non-blank lines under a repeated heading, at most ``budget`` characters as rendered: key, chunk_id, n_lines, num_chars, chunk.

    What counts is the whole chunk with its heading and line ends. A line that
    is too long alone is a chunk of its own.
    """
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    own = docs.select(key, heading.alias("_heading"), lines.alias("_lines"))
    costs = F.transform("_lines", lambda line, i: F.struct(i.cast("long").alias("pos"), (F.length(line) + 1).cast("long").alias("cost")))
    packed = own.select(key, "_heading", "_lines", F.posexplode(fold_pack(costs, budget, F.length("_heading"))).alias("chunk_id", "_c"))
    body = F.slice("_lines", (F.col("_c.first") + 1).cast("int"), F.col("_c.items").cast("int"))
    return packed.select(key, "chunk_id", F.col("_c.items").alias("n_lines"), F.col("_c.tokens").alias("num_chars"), F.array_join(F.concat(F.array("_heading"), body), "\n").alias("chunk"))


def adaptive_segments(scores: Column, least: int, most: int) -> Column:
    """Lengths of consecutive segments of an array of boundary scores.

    From each start the segment ends where the score of its last item plus the
    bonus of its length is greatest (ties: the shortest), over lengths from
    ``least`` to below ``most``. What is shorter than ``least`` at the end is
    one segment.
    """

    def choose(start: Column) -> Column:
        room = F.least(F.lit(most), F.size(scores) - start)
        lengths = F.sequence(F.lit(least), F.greatest(F.lit(least), room - 1))

        def value(n: Column) -> Column:
            bonus = F.lit(0)
            for length, extra in PREFERRED.items():
                bonus = F.when((n == length) & (n < room), extra).otherwise(bonus)
            return F.struct((F.element_at(scores, start + n) + bonus).alias("s"), (-n).alias("n"))

        return F.when(room < least, room).otherwise(-F.array_max(F.transform(lengths, value))["n"])

    first = F.struct(F.lit(0).alias("start"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(a: Column, i: Column) -> Column:
        # A segment is chosen at its start; the items inside it are passed over.
        return with_value(
            F.when(a["start"] == i, choose(a["start"])),
            lambda n: F.when(n.isNull(), a).otherwise(F.struct((a["start"] + n).alias("start"), F.array_append(a["out"], n).alias("out"))),
        )

    places = F.when(F.size(scores) > 0, F.sequence(F.lit(0), F.size(scores) - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(places, first, step, lambda a: a["out"])


def segment_ordered(df: DataFrame, key: list[str], order: list[str], score: str, least: int, most: int) -> DataFrame:
    """``adaptive_segments`` over rows in order, streamed: key, segment, start, n."""

    def bonus(n: int, room: int) -> float:
        return float("-inf") if least < n == room else PREFERRED.get(n, 0) if n < room else 0

    return ordered_fold(df, key, order, [score], SEGMENT, segment_rows(least, most, bonus, lambda room: room < least))


def select_segments(df: DataFrame, key: list[str], order: list[str], bonus: str, unit: int, least: int, most: int, target: int, shortest: int, longest: int) -> DataFrame:
    """Segments of ``least`` to ``most`` rows near ``target``, each row lasting ``unit``: key, segment, start, n.

    A segment may be longer than ``most`` rows while it lasts no more than
    ``longest``. Scores are -20 |time - target| - 5 |rows - middle| + 7 bonus of
    the last row; ties go to the longer one. ``least`` rows or fewer at the end
    are one segment.
    """
    first, last = max(least, -(-shortest // unit)), max(most, longest // unit)
    middle = (least + most) / 2

    def closeness(n: int, room: int) -> float:
        return -20 * abs(n * unit - target) - 5 * abs(n - middle)

    weighted = df.withColumn("_score", (F.col(bonus) * 7).cast("double"))
    return ordered_fold(weighted, key, order, ["_score"], SEGMENT, segment_rows(first, last, closeness, lambda room: room <= least or room < first, True))


def cycle_to_target(df: DataFrame, order: list[str], block: Column, cost: str, target: int) -> DataFrame:
    """Repeat the rows in order, cycle after cycle, until their costs reach ``target``: adds ``cycle``."""
    total = df.agg(F.coalesce(F.sum(cost), F.lit(0)).alias("t")).first()["t"]  # one number
    if not total:
        return df.withColumn("cycle", F.lit(0)).limit(0)
    whole, rest = divmod(target, total)
    ordered = running_sum(df, F.col(cost), order, block, None, "_before")
    times = F.lit(whole) + F.when(F.col("_before") < rest, 1).otherwise(0)
    return ordered.withColumn("_n", times.cast("int")).where("_n > 0").withColumn("cycle", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_before", "_n")


def repeat_count(total: int, repeats: range, low: int, high: int) -> int:
    """Repeats whose total is in [low, high], the fewest, else the one that comes nearest."""
    return min(repeats, key=lambda r: (max(low - total * r, total * r - high, 0), r))


def cascade_rows(budget: int):
    """Fold of (pos, phrase, phrase_cost, measure, measure_cost) rows to their chunks: chunk, pos, spent (see ``cascade_events``)."""

    def fold(rows):
        chunk, spent, phrase, measure, split, cut = -1, 0, None, None, False, False
        for pos, own_phrase, phrase_cost, own_measure, measure_cost in rows:
            begins = chunk < 0 or own_phrase != phrase
            if begins and phrase_cost <= budget:
                if chunk < 0 or split or spent + phrase_cost > budget:
                    chunk, spent = chunk + 1, 0
                spent, split = spent + phrase_cost, False
            elif phrase_cost > budget:
                if begins:
                    chunk, spent, split = chunk + 1, 1, True
                if begins or own_measure != measure:
                    cut = measure_cost > budget - 1
                    if spent > 1 and (cut or spent + measure_cost > budget):
                        chunk, spent = chunk + 1, 1
                    spent += 1 if cut else measure_cost
                if cut:
                    if spent + 1 > budget:
                        chunk, spent = chunk + 1, 2
                    spent += 1
            phrase, measure = own_phrase, own_measure
            yield chunk, pos, spent

    return fold


def cascade_events(df: DataFrame, key: list[str], order: list[str], phrase: str, measure: str, budget: int) -> DataFrame:
    """Chunks of event rows with their header rows: key, chunk_id, first_pos, last_pos, n_events, n_rows (with headers).

    A phrase has a header row and each of its measures one. Phrases are packed
    in order while they fit ``budget`` rows (at least 3); a larger phrase is
    split at measures, a larger measure at events, and a chunk that begins
    inside a phrase or a measure repeats their headers. Streamed: a task holds a row.
    """
    place = F.row_number().over(W.partitionBy(*key).orderBy(*order)).cast("long") - 1
    counted = df.select(*key, *order, F.col(phrase).alias("_phrase"), F.col(measure).alias("_measure")).withColumn("pos", place)
    rows = F.count(F.lit(1))
    starts = F.lag(F.struct("_phrase", "_measure")).over(W.partitionBy(*key).orderBy("pos"))
    counted = counted.withColumn("_begins", F.when(starts.eqNullSafe(F.struct("_phrase", "_measure")), 0).otherwise(1))
    sized = counted.withColumn("_mc", rows.over(W.partitionBy(*key, "_phrase", "_measure")) + 1).withColumn("_pc", rows.over(W.partitionBy(*key, "_phrase")) + F.sum("_begins").over(W.partitionBy(*key, "_phrase")) + 1)
    chunks = ordered_fold(sized, key, ["pos"], ["pos", "_phrase", "_pc", "_measure", "_mc"], "chunk_id int, pos bigint, spent bigint", cascade_rows(budget))
    return chunks.groupBy(*key, "chunk_id").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), rows.alias("n_events"), F.max("spent").alias("n_rows"))
