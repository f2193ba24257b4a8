"""Queries that match sequences of events with each other."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.operators import matching
from tessella.plans.catalogue import query
from tessella.plans.sequences import EVENTS, HOUR, KEY, events

#: Event types that histograms count, in this order.
TYPES = ("click", "error", "purchase", "signup", "view")
COUNTS = ", ".join(f"count(*) FILTER (event_type = '{t}')" for t in TYPES)


@query(
    "near_duplicate_sequences",
    f"""WITH RECURSIVE {EVENTS}, s AS (SELECT user_id % 5 AS piece, user_id, event_type, us - min(us) OVER (PARTITION BY user_id) AS at FROM e WHERE user_id IS NOT NULL),
n AS (SELECT piece, user_id, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT x.piece, x.user_id AS x, z.user_id AS z, x.n FROM n x JOIN n z ON x.piece = z.piece AND x.user_id <> z.user_id),
c AS (SELECT p.x, p.z FROM p WHERE (SELECT count(*) FROM s a WHERE a.user_id = p.x AND EXISTS (SELECT 1 FROM s b WHERE b.user_id = p.z AND b.event_type = a.event_type AND abs(a.at - b.at) <= {11 * HOUR})) >= 0.5 * p.n),
l AS (SELECT x, z FROM c UNION SELECT z, x FROM c),
r AS (SELECT user_id AS x, user_id AS z FROM n UNION SELECT r.x, l.z FROM r JOIN l ON l.x = r.z),
k AS (SELECT x AS user_id, min(z) AS cluster FROM r GROUP BY x)
SELECT piece, user_id, cluster, count(*) OVER (PARTITION BY cluster) AS n_members, first_value(user_id) OVER (PARTITION BY cluster ORDER BY user_id % 4, n DESC, user_id) AS lead
FROM k JOIN n USING (user_id)""",
)
def near_duplicate_sequences(spark, sf_dir):
    """Clusters of users of one piece with nearly the same events, and their leads by source, number of events and id."""
    own = events(spark, sf_dir).where("user_id IS NOT NULL").select((F.col("user_id") % 5).alias("piece"), "user_id", "event_type", "us")
    clusters = matching.near_duplicate_sequences(matching.shifted(own, ["piece", "user_id"], "us"), "piece", "user_id", "event_type", "us", 11 * HOUR)
    sizes = own.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    told = matching.with_leads(clusters.join(sizes.hint("merge"), "user_id"), ["cluster"], [F.col("user_id") % 4, -F.col("n")], "user_id")
    return told.select("piece", "user_id", "cluster", "n_members", "lead")


def features(spark, sf_dir):
    """Number, duration and sum of values of each user's events, and their histogram by type."""
    own = events(spark, sf_dir).where("user_id IS NOT NULL")
    hist = F.array(*[F.count_if(F.col("event_type") == t) for t in TYPES])
    total = F.floor(F.col("value") * 100).cast("long")
    return own.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), (F.max("us") - F.min("us")).alias("duration"), F.sum(total).alias("total"), hist.alias("hist"))


@query(
    "best_match_composite",
    f"""WITH {EVENTS}, f AS (SELECT user_id, count(*) AS n, max(us) - min(us) AS duration, sum(floor(value * 100))::BIGINT AS total, [{COUNTS}] AS hist FROM e WHERE user_id IS NOT NULL GROUP BY 1),
d AS (SELECT a.user_id, b.user_id AS match_id, round(abs(a.n - b.n) / greatest(a.n, b.n)::DOUBLE + coalesce(0.3 * abs(a.duration - b.duration) / nullif(greatest(a.duration, b.duration), 0)::DOUBLE, 0)
  + coalesce(0.5 * abs(a.total - b.total) / nullif(greatest(a.total, b.total), 0)::DOUBLE, 0) + 2.0 * list_sum(list_transform(list_zip(a.hist, b.hist), lambda z: abs(z[1] - z[2]))) / (a.n + b.n), 9) AS score
  FROM f a JOIN f b ON a.user_id <> b.user_id)
SELECT user_id, arg_min(match_id, row(score, match_id)) AS match_id, min(score) AS score FROM d GROUP BY 1""",
)
def best_match_composite(spark, sf_dir):
    """For each user the one whose events are most alike in number, duration, values and types."""
    own = features(spark, sf_dir)
    weights = {"n": 1.0, "duration": 0.3, "total": 0.5}
    return matching.best_match(own, own, "user_id", "user_id", weights, "n", "hist", 2.0, "total").select("user_id", "match_id", "score")


STEP = 12 * HOUR


@query(
    "greedy_look_ahead_match",
    f"""WITH RECURSIVE {EVENTS}, g AS (SELECT user_id, event_id % 2 AS side, us // {STEP} AS slot, [{COUNTS}] AS counts FROM e WHERE user_id IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT user_id, list(counts ORDER BY slot) AS rs FROM g WHERE side = 0 GROUP BY 1),
l AS (SELECT g.user_id, row_number() OVER (PARTITION BY g.user_id ORDER BY slot) - 1 AS pos, counts, coalesce(rs, []) AS rs FROM g LEFT JOIN r USING (user_id) WHERE side = 1),
w AS (
  SELECT user_id, -1::BIGINT AS pos, 0::BIGINT AS next, NULL::BIGINT AS taken, NULL::BIGINT AS score FROM l WHERE pos = 0
  UNION ALL
  SELECT user_id, pos, CASE WHEN best.s >= 0 THEN next - best.k + 1 ELSE next END, CASE WHEN best.s >= 0 THEN next - best.k END, CASE WHEN best.s >= 0 THEN best.s END
  FROM (SELECT l.user_id, l.pos, w.next, list_max(list_transform(range(0, least(8, len(rs) - w.next)), lambda k: {{
      's': (8 * list_sum(list_transform(list_zip(l.counts, rs[w.next + k + 1]), lambda z: least(z[1], z[2]))) - abs(list_sum(l.counts) - list_sum(rs[w.next + k + 1])) - k)::BIGINT, 'k': (-k)::BIGINT}})) AS best
    FROM w JOIN l ON l.user_id = w.user_id AND l.pos = w.pos + 1))
SELECT user_id, pos AS left_pos, taken AS right_pos, score FROM w WHERE pos >= 0""",
)
def greedy_look_ahead_match(spark, sf_dir):
    """Half-day groups of a user's odd events, each matched with one of the next eight groups of the even ones."""
    own = events(spark, sf_dir).where("user_id IS NOT NULL").withColumn("slot", F.expr(f"us div {STEP}")).withColumn("side", F.col("event_id") % 2)
    grouped = own.groupBy("user_id", "side", "slot").agg(F.array(*[F.count_if(F.col("event_type") == t) for t in TYPES]).alias("counts"))
    placed = grouped.withColumn("pos", F.row_number().over(W.partitionBy("user_id", "side").orderBy("slot")) - 1)
    return matching.greedy_match(placed.where("side = 1"), placed.where("side = 0"), KEY, "pos", "counts")
