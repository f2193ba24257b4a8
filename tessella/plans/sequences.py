"""Queries over events, read as one sequence per user."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.functions import events as ev
from tessella.operators import joins, stats, windows
from tessella.plans.catalogue import query
from tessella.plans.corpus import table

KEY, ORDER = ["user_id"], ["us", "event_id"]
EVENTS = "e AS (SELECT event_id, user_id, event_type, value, props, epoch_us(ts) AS us FROM events)"
WIN = "PARTITION BY user_id ORDER BY us, event_id"


def events(spark, sf_dir):
    """Events with their time in microseconds."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props", us.alias("us"))


@query(
    "segment_at_marker",
    f"WITH {EVENTS}, s AS (SELECT *, sum((event_type = 'signup')::INT) OVER ({WIN}) - 1 AS segment FROM e) SELECT user_id, segment::BIGINT AS segment, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM s WHERE segment >= 0 GROUP BY user_id, segment",
)
def segment_at_marker(spark, sf_dir):
    cut = windows.segment_at_marker(events(spark, sf_dir), KEY, ORDER, F.col("event_type") == "signup")
    return cut.groupBy("user_id", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@query("local_index_mod128", f"WITH {EVENTS} SELECT event_id, ((row_number() OVER ({WIN}) - 1) % 128)::INTEGER AS local_index FROM e")
def local_index_mod128(spark, sf_dir):
    return windows.local_index(events(spark, sf_dir), KEY, ORDER).select("event_id", "local_index")


@query(
    "note_offset_delta",
    f"""WITH {EVENTS}, d AS (SELECT event_id, least(65535, greatest(0, coalesce(us // 10000000 - lag(us // 10000000) OVER ({WIN}), 0))) AS delta FROM e)
SELECT event_id, delta, (delta // 256)::INTEGER AS high, (delta % 256)::INTEGER AS low FROM d""",
)
def note_offset_delta(spark, sf_dir):
    tick = F.expr("us div 10000000")
    d = windows.delta_from_previous(events(spark, sf_dir), KEY, ORDER, tick).withColumn("delta", F.least(F.lit(65535).cast("long"), F.col("delta")))
    high, low = ev.split_u16(F.col("delta"))
    return d.select("event_id", "delta", high.alias("high"), low.alias("low"))


@query(
    "pedal_asof_last_note",
    f"WITH {EVENTS}, a AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN us END IGNORE NULLS) OVER ({WIN} ROWS UNBOUNDED PRECEDING) AS note_us FROM e) SELECT event_id, note_us, us - note_us AS delta_us FROM a WHERE event_type = 'click'",
)
def pedal_asof_last_note(spark, sf_dir):
    a = windows.asof_backward(events(spark, sf_dir), KEY, ORDER, F.col("event_type") == "view", F.col("us"), "note_us")
    return a.where("event_type = 'click'").select("event_id", "note_us", (F.col("us") - F.col("note_us")).alias("delta_us"))


@query(
    "next_anchor_forward",
    f"""WITH {EVENTS}, a AS (SELECT *, coalesce(first_value(CASE WHEN event_type = 'view' THEN us END IGNORE NULLS) OVER ({WIN} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
  last_value(CASE WHEN event_type = 'view' THEN us END IGNORE NULLS) OVER ({WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS anchor_us FROM e)
SELECT event_id, anchor_us FROM a WHERE event_type = 'click'""",
)
def next_anchor_forward(spark, sf_dir):
    a = windows.asof_forward(events(spark, sf_dir), KEY, ORDER, F.col("event_type") == "view", F.col("us"), "anchor_us")
    return a.where("event_type = 'click'").select("event_id", "anchor_us")


HOUR = 3_600_000_000


@query(
    "range_join_events_in_spans",
    f"""WITH {EVENTS}, s AS (SELECT event_id AS span_id, user_id, us AS s, us + 21600000000 AS t FROM e WHERE event_type = 'signup')
SELECT span_id, count(*) AS n_events, count(DISTINCT event_type) AS n_types FROM e JOIN s ON e.user_id = s.user_id AND e.us >= s.s AND e.us < s.t GROUP BY span_id""",
)
def range_join_events_in_spans(spark, sf_dir):
    e = events(spark, sf_dir)
    spans = e.where("event_type = 'signup'").select(F.col("event_id").alias("span_id"), "user_id", F.col("us").alias("start"), (F.col("us") + 6 * HOUR).alias("end"))
    found = joins.range_join(e.select("user_id", "event_type", "us"), spans, KEY, "us", "start", "end", 6 * HOUR)
    return found.groupBy("span_id").agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("event_type").alias("n_types"))


@query(
    "band_join_median",
    f"""WITH {EVENTS} SELECT p.event_id, count(*) AS n, median(o.us - p.us) AS median_us FROM e p JOIN e o ON o.user_id = p.user_id AND o.us >= p.us - 7200000000 AND o.us < p.us + 7200000000
WHERE p.event_type = 'purchase' AND o.event_type <> 'purchase' GROUP BY p.event_id""",
)
def band_join_median(spark, sf_dir):
    e = events(spark, sf_dir)
    probes = e.where("event_type = 'purchase'").select("event_id", "user_id", F.col("us").alias("at"), (F.col("us") - 2 * HOUR).alias("start"), (F.col("us") + 2 * HOUR).alias("end"))
    found = joins.range_join(e.where("event_type <> 'purchase'").select("user_id", "us"), probes, KEY, "us", "start", "end", 4 * HOUR)
    return found.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.median(F.col("us") - F.col("at")).alias("median_us"))


@query(
    "nearest_within_tolerance",
    f"""WITH {EVENTS}, v AS (SELECT * FROM e WHERE event_type = 'view'), c AS (SELECT * FROM e WHERE event_type = 'error'),
m AS (SELECT c.event_id, min(row(abs(v.us - c.us), v.event_id)) AS b FROM c JOIN v USING (user_id) GROUP BY c.event_id)
SELECT c.event_id, CASE WHEN m.b[1] <= 3600000000 THEN m.b[2] END AS match_id FROM c LEFT JOIN m USING (event_id)""",
)
def nearest_within_tolerance(spark, sf_dir):
    e = events(spark, sf_dir)
    found = joins.nearest(e.where("event_type = 'error'").select("event_id", "user_id", "us"), e.where("event_type = 'view'").select("event_id", "user_id", "us"), KEY, "us", "event_id", 24 * HOUR)
    return found.select("event_id", F.when(F.col("distance") <= HOUR, F.col("match_id")).alias("match_id"))


@query(
    "collapse_repeats",
    f"WITH {EVENTS}, l AS (SELECT *, lag(event_type) OVER ({WIN}) AS before FROM e) SELECT event_id, user_id, event_type FROM l WHERE before IS NULL OR before <> event_type",
)
def collapse_repeats(spark, sf_dir):
    return windows.collapse_repeats(events(spark, sf_dir), KEY, ORDER, "event_type").select("event_id", "user_id", "event_type")


@query(
    "gap_sessions",
    f"""WITH {EVENTS}, f AS (SELECT *, CASE WHEN us - lag(us) OVER ({WIN}) > 14400000000 THEN 1 ELSE 0 END AS far FROM e), s AS (SELECT *, sum(far) OVER ({WIN}) AS session FROM f)
SELECT user_id, session::BIGINT AS session, count(*) AS n, max(us) - min(us) AS span_us FROM s GROUP BY user_id, session""",
)
def gap_sessions(spark, sf_dir):
    s = windows.gap_sessions(events(spark, sf_dir), KEY, ORDER, F.col("us"), 4 * HOUR)
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), (F.max("us") - F.min("us")).alias("span_us"))


@query(
    "gap_fill_interpolate",
    f"""WITH {EVENTS}, h AS (SELECT user_id, us // 86400000000 AS day, count(*) AS n FROM e GROUP BY ALL),
b AS (SELECT user_id, unnest(range(min(day), max(day) + 1)) AS day FROM h GROUP BY user_id),
g AS (SELECT b.user_id, b.day, CASE WHEN n >= 2 THEN n END AS n FROM b LEFT JOIN h USING (user_id, day)),
k AS (SELECT *, last_value(CASE WHEN n IS NOT NULL THEN day END IGNORE NULLS) OVER w AS p0, last_value(n IGNORE NULLS) OVER w AS v0,
  first_value(CASE WHEN n IS NOT NULL THEN day END IGNORE NULLS) OVER x AS p1, first_value(n IGNORE NULLS) OVER x AS v1 FROM g
  WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING), x AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, day, n IS NULL AS is_filled, round(CASE WHEN n IS NOT NULL THEN n WHEN p0 IS NULL THEN v1 WHEN p1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * ((day - p0) / (p1 - p0)) END::DOUBLE, 6) AS filled FROM k""",
)
def gap_fill_interpolate(spark, sf_dir):
    days = events(spark, sf_dir).groupBy("user_id", F.expr(f"us div {24 * HOUR}").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    grid = days.groupBy("user_id").agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    sparse = grid.join(days, ["user_id", "day"], "left").withColumn("n", F.when(F.col("n") >= 2, F.col("n").cast("double")))
    return windows.interpolate(sparse, KEY, "day", "n").select("user_id", "day", F.col("n").isNull().alias("is_filled"), F.round("filled", 6).alias("filled"))


@query(
    "irregular_interval_flag",
    f"""WITH {EVENTS}, d AS (SELECT event_id, user_id, us, lead(us) OVER ({WIN}) - us AS gap FROM e), r AS (SELECT *, first_value(gap) OVER ({WIN}) AS ref FROM d)
SELECT event_id, NOT abs(gap - ref) <= 0.5 * greatest(abs(gap), abs(ref)) AS is_irregular FROM r WHERE gap IS NOT NULL""",
)
def irregular_interval_flag(spark, sf_dir):
    w = W.partitionBy(*KEY).orderBy(*ORDER)
    d = events(spark, sf_dir).withColumn("gap", F.lead("us").over(w) - F.col("us")).withColumn("ref", F.first("gap").over(w))
    near = F.abs(F.col("gap") - F.col("ref")) <= 0.5 * F.greatest(F.abs("gap"), F.abs("ref"))
    return d.where("gap IS NOT NULL").select("event_id", (~near).alias("is_irregular"))


@query(
    "nearest_rank_median_gap",
    f"""WITH {EVENTS}, d AS (SELECT user_id, us - lag(us) OVER ({WIN}) AS gap FROM e), l AS (SELECT user_id, list_sort(list(gap)) AS g FROM d WHERE gap > 0 GROUP BY user_id)
SELECT user_id, g[len(g) // 2 + 1] AS median_gap FROM l""",
)
def nearest_rank_median_gap(spark, sf_dir):
    gaps = events(spark, sf_dir).select("user_id", (F.col("us") - F.lag("us").over(W.partitionBy(*KEY).orderBy(*ORDER))).alias("gap")).where("gap > 0")
    return stats.rank_percentiles(gaps, ["user_id"], "gap", {"median_gap": ("floor", 0.5)}, width=HOUR)


@query(
    "hole_detection",
    f"WITH {EVENTS}, h AS (SELECT event_id, avg((event_type = 'error')::INT) OVER ({WIN} ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) > 0.3 AS in_hole FROM e) SELECT * FROM h",
)
def hole_detection(spark, sf_dir):
    return windows.hole_flags(events(spark, sf_dir), KEY, ORDER, F.col("event_type") == "error", share=0.3).select("event_id", "in_hole")


@query(
    "take_while_prefix",
    f"WITH {EVENTS}, p AS (SELECT *, min((event_type <> 'purchase')::INT) OVER ({WIN} ROWS UNBOUNDED PRECEDING) AS ok FROM e) SELECT user_id, count(*) AS n_prefix FROM p WHERE ok = 1 GROUP BY user_id",
)
def take_while_prefix(spark, sf_dir):
    return windows.take_while(events(spark, sf_dir), KEY, ORDER, F.col("event_type") != "purchase").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_prefix"))


@query(
    "open_close_state",
    f"""WITH {EVENTS}, s AS (SELECT event_id, user_id, us, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER ({WIN}) AS depth FROM e) SELECT event_id, depth::BIGINT AS depth FROM s""",
)
def open_close_state(spark, sf_dir):
    step = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return events(spark, sf_dir).select("event_id", F.sum(step).over(W.partitionBy(*KEY).orderBy(*ORDER)).alias("depth"))


@query(
    "extension_rows_pending",
    f"""WITH {EVENTS}, g AS (SELECT *, coalesce(sum((event_type <> 'error')::INT) OVER ({WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM e)
SELECT user_id, part::BIGINT AS part, sum((event_type = 'error')::INT)::BIGINT AS n_pending, max(CASE WHEN event_type <> 'error' THEN event_id END) AS event_id FROM g GROUP BY user_id, part""",
)
def extension_rows_pending(spark, sf_dir):
    before = W.partitionBy(*KEY).orderBy(*ORDER).rowsBetween(W.unboundedPreceding, -1)
    plain = F.col("event_type") != "error"
    parted = events(spark, sf_dir).withColumn("part", F.coalesce(F.sum(plain.cast("long")).over(before), F.lit(0)))
    return parted.groupBy("user_id", "part").agg(F.sum((~plain).cast("long")).alias("n_pending"), F.max(F.when(plain, F.col("event_id"))).alias("event_id"))


@query(
    "sliding_offset_match",
    f"""WITH {EVENTS}, r AS (SELECT user_id, event_type, row_number() OVER ({WIN}) AS pos FROM e), a AS (SELECT user_id // 2 AS pair, * FROM r WHERE user_id % 2 = 0), b AS (SELECT user_id // 2 AS pair, * FROM r WHERE user_id % 2 = 1),
s AS (SELECT a.pair, o.o AS off, sum((a.event_type = b.event_type)::INT) AS score FROM a, (SELECT unnest(range(-4, 5)) AS o) o JOIN b ON b.pair = a.pair AND b.pos = a.pos + o.o GROUP BY ALL)
SELECT pair, arg_min(off, row(-score, off))::INTEGER AS "offset", max(score)::BIGINT AS score FROM s GROUP BY pair""",
)
def sliding_offset_match(spark, sf_dir):
    ranked = events(spark, sf_dir).select(F.expr("user_id div 2").alias("pair"), (F.col("user_id") % 2).alias("side"), "event_type", F.row_number().over(W.partitionBy(*KEY).orderBy(*ORDER)).alias("pos"))
    return joins.sliding_offset_match(ranked.where("side = 0"), ranked.where("side = 1"), ["pair"], "pos", "event_type", range(-4, 5))


@query(
    "sliding_map_with_wrap",
    f"""WITH {EVENTS}, r AS (SELECT user_id, event_type, row_number() OVER ({WIN}) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM e), a AS (SELECT user_id // 2 AS pair, * FROM r WHERE user_id % 2 = 0), b AS (SELECT user_id // 2 AS pair, * FROM r WHERE user_id % 2 = 1),
s AS (SELECT a.pair, o.o AS off, sum((a.event_type = b.event_type)::INT) AS score FROM a, (SELECT unnest(range(-4, 5)) AS o) o JOIN b ON b.pair = a.pair AND b.pos = ((a.pos + o.o) % b.n + b.n) % b.n GROUP BY ALL),
k AS (SELECT pair, arg_min(off, row(-score, off)) AS off FROM s GROUP BY pair)
SELECT a.pair, a.pos AS left_pos, b.pos AS right_pos, a.event_type = b.event_type AS equal FROM a JOIN k USING (pair) JOIN b ON b.pair = a.pair AND b.pos = ((a.pos + off) % b.n + b.n) % b.n""",
)
def sliding_map_with_wrap(spark, sf_dir):
    """Each place of a sequence mapped to the other one at the best offset, going round where that ends."""
    place = F.row_number().over(W.partitionBy(*KEY).orderBy(*ORDER)).cast("long") - 1
    ranked = events(spark, sf_dir).select(F.expr("user_id div 2").alias("pair"), (F.col("user_id") % 2).alias("side"), "event_type", place.alias("pos"))
    left, right = ranked.where("side = 0"), ranked.where("side = 1")
    return joins.wrapped_map(left, right, ["pair"], "pos", "event_type", range(-4, 5)).select("pair", "left_pos", "right_pos", (F.col("left_value") == F.col("right_value")).alias("equal"))


@query("event_type_coverage", "SELECT event_type, count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM events) AS coverage, count(*) AS n FROM events GROUP BY event_type")
def event_type_coverage(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    users = e.agg(F.countDistinct("user_id").alias("u")).first()["u"]  # one number
    return e.groupBy("event_type").agg((F.countDistinct("user_id") / F.lit(users)).alias("coverage"), F.count(F.lit(1)).alias("n"))


@query("json_props_extract", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), -1) % 7 AS k_mod FROM events")
def json_props_extract(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), (F.coalesce(k, F.lit(-1)) % 7).alias("k_mod"))


@query(
    "histogram_128",
    "WITH p AS (SELECT event_type, (floor(value)::BIGINT % 128) AS bin FROM events WHERE value IS NOT NULL) SELECT event_type, bin, count(*) AS n FROM p GROUP BY ALL",
)
def histogram_128(spark, sf_dir):
    return table(spark, sf_dir, "events").where("value IS NOT NULL").groupBy("event_type", (F.floor("value") % 128).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "distance_to_neighbour_boundary",
    f"""WITH {EVENTS}, s AS (SELECT user_id, us // 86400000000 AS day, min(us) AS a, max(us) AS b FROM e GROUP BY ALL)
SELECT user_id, day, a, coalesce((b + lead(a) OVER (PARTITION BY user_id ORDER BY day)) // 2, b + 100000) AS boundary FROM s""",
)
def distance_to_neighbour_boundary(spark, sf_dir):
    days = events(spark, sf_dir).groupBy("user_id", F.expr(f"us div {24 * HOUR}").alias("day")).agg(F.min("us").alias("a"), F.max("us").alias("b"))
    after = F.lead("a").over(W.partitionBy("user_id").orderBy("day"))
    return days.withColumn("_next", after).select("user_id", "day", "a", F.coalesce(F.expr("(b + _next) div 2"), F.col("b") + 100000).alias("boundary"))
