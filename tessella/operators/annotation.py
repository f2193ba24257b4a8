"""Annotations put around the onset groups of a measure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Order of annotation types at one place.
PRIORITY = ("ornament", "articulation", "range_start", "range_end", "fermata", "dynamic", "expression", "pedal")


def onset_groups(rows: DataFrame, key: list[str]) -> DataFrame:
    """Onset groups of rows (key, pos, kind: note, extension or other, starts, pitch): key, group, insert_at, first, last, pitches.

    A note that ``starts``, or is the first of the key, begins a group.
    ``insert_at`` is the last extension row before the group's first note and
    after that of the group before, else the first note.
    """
    order = W.partitionBy(*key).orderBy("pos")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    note = F.col("kind") == "note"
    begins = note & (F.col("starts") | (F.sum(note.cast("int")).over(upto) == 1))
    marked = rows.withColumn("_begins", begins.cast("int"))
    # Rows before a group's first note, since the note that began the group before.
    part = F.coalesce(F.sum("_begins").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parted = marked.withColumn("_part", part).withColumn("group", F.sum("_begins").over(upto) - 1)
    leads = parted.where("kind = 'extension'").groupBy(*key, F.col("_part").alias("group")).agg(F.max("pos").alias("_lead"))
    notes = parted.where(note).groupBy(*key, "group").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("pitch").alias("pitches"))
    joined = notes.join(leads, [*key, "group"], "left")
    # An extension behind the group's first note belongs to the next group.
    return joined.select(*key, "group", F.coalesce("_lead", "first").alias("insert_at"), "first", "last", "pitches")


def insert_annotations(rows: DataFrame, annotations: DataFrame, key: list[str]) -> DataFrame:
    """Rows and annotations of each measure in one order: key, place, id, is_annotation.

    ``annotations``: key, id, position, type, anchor (pitches). An annotation
    goes to the onset group of its position (the last one if there are fewer);
    with an anchor to the first from there on that holds its pitches, or their
    pitch classes. It stands before the group, or before the extension that
    leads it; a pedal without such an extension stands behind the group.
    Annotations of one place follow by position, type and id; without groups
    they precede all rows. Null anchors are empty.
    """
    groups = onset_groups(rows, key)
    sizes = groups.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    rank = F.array_position(F.array(*[F.lit(p) for p in PRIORITY]), F.col("type"))
    asked = annotations.select(*key, "id", "position", "type", F.coalesce("anchor", F.expr("cast(array() as array<int>)")).alias("anchor"), F.when(rank > 0, rank).otherwise(99).alias("_rank"))
    placed = asked.join(sizes, key, "left").withColumn("_at", F.least("position", F.col("_n") - 1))
    near = placed.where("size(anchor) > 0").join(groups, key).where("group >= _at")

    def classes(pitches):
        return F.transform(pitches, lambda p: p % 12)

    holds = (F.size(F.array_except("anchor", "pitches")) == 0) | (F.size(F.array_except(classes("anchor"), classes("pitches"))) == 0)
    found = near.where(holds).groupBy(*key, "id").agg(F.min("group").alias("_found"))
    settled = placed.join(found, [*key, "id"], "left").withColumn("group", F.coalesce("_found", "_at")).join(groups, [*key, "group"], "left")
    behind = (F.col("type") == "pedal") & (F.col("insert_at") == F.col("first"))
    spot = F.when(behind, F.col("last")).otherwise(F.coalesce("insert_at", F.lit(-1)))
    told = settled.select(*key, "id", F.lit(True).alias("is_annotation"), spot.cast("long").alias("_spot"), F.when(behind, 2).otherwise(0).alias("_side"), "position", "_rank")
    own = rows.select(*key, "id", F.lit(False).alias("is_annotation"), F.col("pos").cast("long").alias("_spot"), F.lit(1).alias("_side"), F.lit(0).alias("position"), F.lit(0).alias("_rank"))
    both = own.unionByName(told)
    order = W.partitionBy(*key).orderBy("_spot", "_side", "position", "_rank", "id")
    return both.select(*key, F.row_number().over(order).cast("long").alias("place"), "id", "is_annotation")
