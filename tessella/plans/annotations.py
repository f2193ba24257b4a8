"""Query that puts annotations around the onset groups of a measure."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.operators import annotation
from tessella.plans.catalogue import query
from tessella.plans.sequences import EVENTS, HOUR, events

MEASURE, NEAR = 48 * HOUR, 4 * HOUR
KINDS = ", ".join(f"'{k}'" for k in annotation.PRIORITY)


@query(
    "annotation_insertion",
    f"""WITH {EVENTS}, m AS (SELECT *, us // {MEASURE} AS measure, row_number() OVER (PARTITION BY user_id, us // {MEASURE} ORDER BY us, event_id) - 1 AS seq FROM e WHERE user_id IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id, measure ORDER BY seq) - 1 AS pos, event_type IN ('click', 'view') AS note, event_id % 24 + 48 AS pitch FROM m WHERE event_type IN ('click', 'view', 'error')),
n AS (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY user_id, measure ORDER BY pos) > {NEAR}, true) AS begins FROM b WHERE note),
g AS (SELECT *, sum(begins::INT) OVER (PARTITION BY user_id, measure ORDER BY pos) - 1 AS grp FROM n),
h AS (SELECT user_id, measure, grp, min(pos) AS first, max(pos) AS last, list(DISTINCT pitch) AS pitches FROM g GROUP BY ALL),
-- The extension that leads a group: the last one before its first note and behind the first note of the group before.
x AS (SELECT h.*, coalesce((SELECT max(b.pos) FROM b WHERE b.user_id = h.user_id AND b.measure = h.measure AND NOT b.note AND b.pos < h.first
    AND b.pos > coalesce((SELECT max(o.first) FROM h o WHERE o.user_id = h.user_id AND o.measure = h.measure AND o.grp < h.grp), -1)), h.first) AS lead FROM h),
a AS (SELECT user_id, measure, event_id, (row_number() OVER (PARTITION BY user_id, measure ORDER BY seq) - 1) % 3 AS position, event_id % 8 AS rank, CASE WHEN event_id % 3 = 0 THEN [event_id % 24 + 48] ELSE [] END AS anchor FROM m WHERE event_type IN ('signup', 'purchase')),
c AS (SELECT a.*, least(position, (SELECT max(grp) FROM x WHERE x.user_id = a.user_id AND x.measure = a.measure)) AS base FROM a),
d AS (SELECT c.*, coalesce(CASE WHEN len(anchor) > 0 THEN (SELECT min(grp) FROM x WHERE x.user_id = c.user_id AND x.measure = c.measure AND grp >= base
    AND (list_has_all(pitches, anchor) OR list_has_all(list_transform(pitches, lambda p: p % 12), list_transform(anchor, lambda p: p % 12)))) END, base) AS grp FROM c),
s AS (SELECT d.user_id, d.measure, d.event_id, true AS is_annotation, CASE WHEN rank = 7 AND lead = first THEN last ELSE coalesce(lead, -1) END AS spot, CASE WHEN rank = 7 AND lead = first THEN 2 ELSE 0 END AS side, position, rank + 1 AS rank
  FROM d LEFT JOIN x ON x.user_id = d.user_id AND x.measure = d.measure AND x.grp = d.grp
  UNION ALL SELECT user_id, measure, event_id, false, pos, 1, 0, 0 FROM b)
SELECT user_id, measure, row_number() OVER (PARTITION BY user_id, measure ORDER BY spot, side, position, rank, event_id) AS place, event_id, is_annotation FROM s""",
)
def annotation_insertion(spark, sf_dir):
    """Two days of a user as a measure: pages are notes, errors extensions, signups and purchases annotations of eight types."""
    key = ["user_id", "measure"]
    own = events(spark, sf_dir).where("user_id IS NOT NULL").withColumn("measure", F.expr(f"us div {MEASURE}"))
    order = W.partitionBy(*key).orderBy("us", "event_id")
    body = own.where("event_type IN ('click', 'view', 'error')").withColumn("pos", F.row_number().over(order) - 1).withColumn("kind", F.when(F.col("event_type") == "error", "extension").otherwise("note"))
    before = F.last(F.when(F.col("kind") == "note", F.col("us")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    pitch = (F.col("event_id") % 24 + 48).cast("int")
    rows = body.select(*key, F.col("event_id").alias("id"), "pos", "kind", F.coalesce(F.col("us") - before > NEAR, F.lit(True)).alias("starts"), pitch.alias("pitch"))
    kinds = F.array(*[F.lit(k) for k in annotation.PRIORITY])
    anchor = F.when(F.col("event_id") % 3 == 0, F.array(pitch))
    marks = own.where("event_type IN ('signup', 'purchase')").select(
        *key, F.col("event_id").alias("id"), ((F.row_number().over(order) - 1) % 3).alias("position"), F.element_at(kinds, (F.col("event_id") % 8 + 1).cast("int")).alias("type"), anchor.alias("anchor")
    )
    return annotation.insert_annotations(rows, marks, key).select(*key, "place", F.col("id").alias("event_id"), "is_annotation")
