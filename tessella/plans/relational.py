"""Queries over orders, line items, parts, suppliers, customers and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.functions import events as ev
from tessella.operators import joins, sampling, stats
from tessella.operators.ranking import running_sum
from tessella.plans.catalogue import query
from tessella.plans.corpus import table

LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
LINE_WIN = "PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"
CENTS = "round({} * 100)::BIGINT"


def cents(column):
    """A price in whole cents, so that sums are exact."""
    return F.round(F.col(column) * 100).cast("long")


def line_rank():
    return F.row_number().over(W.partitionBy("l_orderkey").orderBy(*LINE))


@query(
    "fixed_phrases_of_four",
    f"WITH r AS (SELECT *, row_number() OVER ({LINE_WIN}) AS rn FROM lineitem) SELECT l_orderkey, (rn - 1) // 4 AS phrase_id, count(*) AS n_items, sum(l_quantity::BIGINT)::BIGINT AS quantity FROM r GROUP BY ALL",
)
def fixed_phrases_of_four(spark, sf_dir):
    phrased = table(spark, sf_dir, "lineitem").withColumn("rn", line_rank()).withColumn("phrase_id", F.floor((F.col("rn") - 1) / 4))
    return phrased.groupBy("l_orderkey", "phrase_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@query(
    "phrase_segment_4_8",
    """WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER w AS pos, bool_and(o_totalprice < 100000) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pickup FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
r AS (SELECT *, sum((NOT pickup)::INT) OVER (PARTITION BY o_custkey ORDER BY pos) AS rn, sum((NOT pickup)::INT) OVER (PARTITION BY o_custkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS n_all FROM o),
p AS (SELECT *, CASE WHEN pickup THEN 0 ELSE least((rn - 1) // 4, greatest(n // 4 - 1, 0)) END::BIGINT AS phrase_id FROM r WHERE n > 0 AND (n >= 4 OR n_all >= 4))
SELECT o_custkey, phrase_id, count(*) AS n_items, sum(pickup::INT)::BIGINT AS n_pickups, min(o_orderkey) AS least_order FROM p GROUP BY ALL""",
)
def phrase_segment_4_8(spark, sf_dir):
    """Phrases of four in order, a short tail joined to the last, so none exceeds seven; pickups (leading small orders) go to the first.

    A customer with pickups alone, or with fewer than four orders, has no phrase.
    """
    own = W.partitionBy("o_custkey")
    upto = own.orderBy("o_orderdate", "o_orderkey").rowsBetween(W.unboundedPreceding, W.currentRow)
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", (F.col("o_totalprice") < 100000).alias("small"))
    led = orders.withColumn("pickup", F.bool_and("small").over(upto))
    full = (~F.col("pickup")).cast("long")
    ranked = led.withColumn("rn", F.sum(full).over(upto)).withColumn("n", F.sum(full).over(own)).withColumn("n_all", F.count(F.lit(1)).over(own)).where("n > 0 AND (n >= 4 OR n_all >= 4)")
    phrase = F.when(F.col("pickup"), 0).otherwise(F.least(F.floor((F.col("rn") - 1) / 4), F.greatest(F.floor(F.col("n") / 4) - 1, F.lit(0))))
    return ranked.groupBy("o_custkey", phrase.alias("phrase_id")).agg(F.count(F.lit(1)).alias("n_items"), F.count_if("pickup").alias("n_pickups"), F.min("o_orderkey").alias("least_order"))


@query(
    "source_enrich",
    f"""SELECT p_brand, s_nationkey, count(*) AS n, sum({CENTS.format('l_extendedprice')})::BIGINT AS cents FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL""",
)
def source_enrich(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", cents("l_extendedprice").alias("c"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    joined = items.join(parts, "l_partkey", "left").join(suppliers, "l_suppkey", "left")
    return joined.groupBy("p_brand", "s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("cents"))


@query(
    "leakage_free_work_split",
    """WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), h AS (SELECT o_custkey FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY sha256('21:' || o_custkey) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM n) WHERE held < 1000)
SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT o_custkey FROM h) THEN 'val' ELSE 'train' END AS split FROM orders""",
)
def leakage_free_work_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    held = sampling.hold_out_groups(orders, "o_custkey", "21", 1000)
    train = sampling.train_rows(orders, held, "o_custkey").select("o_orderkey", F.lit("train").alias("split"))
    return train.unionByName(orders.join(held, "o_custkey", "left_semi").select("o_orderkey", F.lit("val").alias("split")))


@query(
    "compound_candidate_filter",
    """WITH f AS (SELECT *, 2 * (p_type IN ('ECONOMY', 'SMALL'))::INT + (p_size > 25)::INT AS score FROM part WHERE regexp_matches(p_name, 'ring|widget|gear') AND p_size BETWEEN 5 AND 45),
d AS (SELECT *, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY score DESC, p_partkey) AS rn FROM f WHERE p_brand NOT IN ('Brand#1', 'Brand#2'))
SELECT p_partkey, p_name, p_brand, score FROM d WHERE rn = 1 AND score >= 2""",
)
def compound_candidate_filter(spark, sf_dir):
    score = 2 * F.col("p_type").isin("ECONOMY", "SMALL").cast("int") + (F.col("p_size") > 25).cast("int")
    kept = table(spark, sf_dir, "part").where(F.col("p_name").rlike("ring|widget|gear") & F.col("p_size").between(5, 45) & ~F.col("p_brand").isin("Brand#1", "Brand#2")).withColumn("score", score)
    best = kept.groupBy("p_name", "p_brand").agg(F.min(F.struct((-F.col("score")).alias("s"), "p_partkey")).alias("b"))
    return best.select("b.p_partkey", "p_name", "p_brand", (-F.col("b.s")).alias("score")).where("score >= 2")


@query(
    "grouping_sets_stats",
    f"""SELECT o_orderstatus, o_orderpriority, count(*) AS n, sum({CENTS.format('o_totalprice')})::BIGINT AS cents, quantile_cont({CENTS.format('o_totalprice')}, 0.5) AS p50
FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderpriority))""",
)
def grouping_sets_stats(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", cents("o_totalprice").alias("c"))
    # Rows of each set are told apart by the set's number, as its keys are null where they are not grouped.
    sets = F.array(
        *[
            F.struct(F.lit(i).alias("which"), (F.col("o_orderstatus") if i == 1 else F.lit(None).cast("string")).alias("o_orderstatus"), (F.col("o_orderpriority") if i == 2 else F.lit(None).cast("string")).alias("o_orderpriority"))
            for i in range(3)
        ]
    )
    keys = ["which", "o_orderstatus", "o_orderpriority"]
    values = orders.groupBy("o_orderstatus", "o_orderpriority", "c").agg(F.count(F.lit(1)).alias("k")).select(F.explode(sets).alias("s"), "c", "k").select("s.*", "c", "k")
    sums = values.groupBy(*keys).agg(F.sum("k").alias("n"), F.sum(F.col("c") * F.col("k")).alias("cents"))
    medians = stats.linear_percentile(values, keys, "c", 0.5, "p50", "k", 100_000)
    same = [sums[k].eqNullSafe(medians[k]) for k in keys]
    return sums.join(medians, same).select(sums["o_orderstatus"], sums["o_orderpriority"], "n", "cents", "p50")


@query(
    "mode_canonical_count",
    """WITH c AS (SELECT o_custkey, l_orderkey, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL), v AS (SELECT o_custkey, n, count(*) AS k FROM c GROUP BY ALL)
SELECT o_custkey, arg_min(n, row(-k, n)) AS mode_value, max(k) AS mode_count, count(*) AS n_variants, max(k) / sum(k) AS mode_share FROM v GROUP BY o_custkey""",
)
def mode_canonical_count(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_items"))
    return stats.mode_by_group(counts.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey"), ["o_custkey"], "n_items")


@query(
    "composer_share",
    "SELECT c_mktsegment, count(*) AS n, count(DISTINCT o_custkey) AS n_customers, count(*) / (SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey) AS share, count(*) / count(DISTINCT o_custkey) AS per_customer FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment",
)
def composer_share(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    grouped = joined.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c_custkey").alias("n_customers"))
    return grouped.select("c_mktsegment", "n", "n_customers", (F.col("n") / F.sum("n").over(W.partitionBy())).alias("share"), (F.col("n") / F.col("n_customers")).alias("per_customer"))


@query(
    "batches_of_thirty",
    """WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand), r AS (SELECT p.p_partkey, row_number() OVER (PARTITION BY p.p_brand ORDER BY p.p_partkey) - 1 AS rn, p.p_brand, c.n FROM part p JOIN c USING (p_brand))
SELECT p_partkey, p_brand, (dense_rank() OVER (ORDER BY -n, p_brand))::INTEGER AS brand_rank, rn // 30 AS batch FROM r""",
)
def batches_of_thirty(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    # Brands, not parts, are ranked in one place.
    brands = parts.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).select("p_brand", F.row_number().over(W.orderBy(F.col("n").desc(), "p_brand")).alias("brand_rank"))
    ranked = running_sum(parts, F.lit(1), ["p_partkey"], F.floor(F.col("p_partkey") / 1000), ["p_brand"], "rn")
    return ranked.join(brands, "p_brand").select("p_partkey", "p_brand", "brand_rank", F.floor(F.col("rn") / 30).alias("batch"))


@query(
    "union_except_intersect_keys",
    """SELECT 'except' AS op, count(*) AS n FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)
UNION ALL SELECT 'union', count(*) FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders)
UNION ALL SELECT 'union_all', count(*) FROM (SELECT c_custkey FROM customer UNION ALL SELECT o_custkey FROM orders)""",
)
def union_except_intersect_keys(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    both = {"except": a.subtract(b), "intersect": a.intersect(b), "union": a.union(b).distinct(), "union_all": a.union(b)}
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n") for op, df in both.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query(
    "best_match_nearest",
    """WITH m AS (SELECT s_suppkey, min(row(abs(c_acctbal - s_acctbal), c_custkey)) AS b FROM supplier JOIN customer ON c_nationkey = s_nationkey GROUP BY s_suppkey)
SELECT s_suppkey, b[2] AS match_id, round(b[1], 6) AS distance FROM m""",
)
def best_match_nearest(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    found = joins.nearest(suppliers, customers, ["nation"], "balance", "c_custkey", 100).where("match_id IS NOT NULL")
    return found.select("s_suppkey", "match_id", F.round("distance", 6).alias("distance"))


@query(
    "positional_audit",
    f"""WITH a AS (SELECT l_orderkey, row_number() OVER ({LINE_WIN}) AS ordinal, l_quantity AS left_value FROM lineitem),
b AS (SELECT l_orderkey, row_number() OVER ({LINE_WIN}) AS ordinal, CASE WHEN l_partkey % 10 = 0 THEN l_quantity + 1 ELSE l_quantity END AS right_value FROM lineitem WHERE l_suppkey % 20 <> 0)
SELECT status, count(*) AS n FROM (SELECT CASE WHEN b.l_orderkey IS NULL THEN 'missing' WHEN a.l_orderkey IS NULL THEN 'extra' WHEN left_value = right_value THEN 'ok' ELSE 'changed' END AS status
FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.ordinal = b.ordinal) GROUP BY status""",
)
def positional_audit(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    changed = items.where("l_suppkey % 20 <> 0").withColumn("l_quantity", F.when(F.col("l_partkey") % 10 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    return joins.positional_audit(items, changed, ["l_orderkey"], LINE, "l_quantity").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


NAME = "(['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'])[pitch % 12 + 1] || (pitch // 12 - 2)"


@query(
    "pitch_tokens_roundtrip",
    f"""WITH p AS (SELECT p_partkey, p_size + 40 AS pitch FROM part) SELECT p_partkey, {NAME} AS name, printf('<N%03d>', pitch) AS token, pitch AS back FROM p""",
)
def pitch_tokens_roundtrip(spark, sf_dir):
    named = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") + 40).alias("pitch")).withColumn("name", ev.pitch_name(F.col("pitch"))).withColumn("token", ev.token("N", F.col("pitch")))
    return named.select("p_partkey", "name", "token", F.when(ev.name_pitch(F.col("name")) == ev.token_value(F.col("token"), "N"), ev.name_pitch(F.col("name"))).alias("back"))


@query(
    "vocabulary_usage",
    "WITH v AS (SELECT i AS token_id, printf('<N%03d>', i) AS token FROM (SELECT unnest(range(128)) AS i)), u AS (SELECT printf('<N%03d>', p_size) AS token, count(*) AS n FROM part GROUP BY p_size) SELECT token_id::INTEGER AS token_id, token, coalesce(n, 0)::BIGINT AS n FROM v LEFT JOIN u USING (token)",
)
def vocabulary_usage(spark, sf_dir):
    used = table(spark, sf_dir, "part").groupBy(ev.token("N", F.col("p_size")).alias("token")).agg(F.count(F.lit(1)).alias("n"))
    return ev.vocabulary(spark, {"N": 127}).join(used, "token", "left").select("token_id", "token", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query(
    "index_range_expansion",
    """WITH r AS (SELECT l_orderkey, min(l_linenumber) AS a, max(l_linenumber) AS b FROM lineitem GROUP BY l_orderkey), x AS (SELECT l_orderkey, unnest(range(a, b + 1)) AS line FROM r)
SELECT x.l_orderkey, x.line::INTEGER AS line, count(l.l_linenumber) AS n FROM x LEFT JOIN lineitem l ON l.l_orderkey = x.l_orderkey AND l.l_linenumber = x.line GROUP BY ALL""",
)
def index_range_expansion(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    lines = items.groupBy("l_orderkey").agg(F.explode(F.sequence(F.min("l_linenumber"), F.max("l_linenumber"))).alias("line"))
    counts = items.groupBy("l_orderkey", F.col("l_linenumber").alias("line")).agg(F.count(F.lit(1)).alias("n"))
    return lines.join(counts, ["l_orderkey", "line"], "left").select("l_orderkey", "line", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query(
    "update_by_key",
    """WITH u AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'HOLD' ELSE c_mktsegment END AS seg FROM customer WHERE c_nationkey < 10)
SELECT coalesce(u.seg, c.c_mktsegment) AS segment, count(*) AS n, sum((u.seg IS NOT NULL AND u.seg <> c.c_mktsegment)::INT)::BIGINT AS n_changed FROM customer c LEFT JOIN u USING (c_custkey) GROUP BY 1""",
)
def update_by_key(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    updates = customers.where("c_nationkey < 10").select("c_custkey", F.when(F.col("c_acctbal") < 0, "HOLD").otherwise(F.col("c_mktsegment")).alias("seg"))
    joined = customers.join(updates, "c_custkey", "left")
    changed = F.coalesce(F.col("seg") != F.col("c_mktsegment"), F.lit(False)).cast("long")
    return joined.groupBy(F.coalesce("seg", "c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.sum(changed).alias("n_changed"))


@query(
    "multiset_intersection",
    """WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL), p AS (SELECT o_custkey // 2 AS pair, o_custkey % 2 AS side, o_orderpriority, n FROM c)
SELECT a.pair, sum(least(a.n, b.n))::BIGINT AS shared FROM p a JOIN p b ON a.pair = b.pair AND a.o_orderpriority = b.o_orderpriority WHERE a.side = 0 AND b.side = 1 GROUP BY a.pair""",
)
def multiset_intersection(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    sided = counts.groupBy(F.expr("o_custkey div 2").alias("pair"), "o_orderpriority").agg(F.max(F.when(F.col("o_custkey") % 2 == 0, F.col("n"))).alias("a"), F.max(F.when(F.col("o_custkey") % 2 == 1, F.col("n"))).alias("b"))
    return sided.where("a IS NOT NULL AND b IS NOT NULL").groupBy("pair").agg(F.sum(F.least("a", "b")).alias("shared"))


@query("top_k_by_score", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def top_k_by_score(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@query(
    "priority_pick",
    "SELECT o_custkey, arg_min(o_orderkey, row(o_orderpriority, -o_totalprice, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey",
)
def priority_pick(spark, sf_dir):
    best = F.min(F.struct("o_orderpriority", (-F.col("o_totalprice")).alias("p"), "o_orderkey")).alias("b")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(best).select("o_custkey", "b.o_orderkey")


@query(
    "ntile_rank_sharding",
    "SELECT vec_id, label, (row_number() OVER (PARTITION BY label ORDER BY sha256('31:' || vec_id)) - 1) % 4 AS shard FROM embeddings",
)
def ntile_rank_sharding(spark, sf_dir):
    from tessella.operators.ranking import hash_ranked

    return hash_ranked(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "31", "vec_id", group=["label"]).select("vec_id", "label", (F.col("hash_rank") % 4).alias("shard"))


@query(
    "weighted_mean_by_rank",
    f"SELECT n_regionkey, sum({CENTS.format('s_acctbal')} * s_suppkey)::BIGINT / sum(s_suppkey)::BIGINT AS weighted FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY n_regionkey",
)
def weighted_mean_by_rank(spark, sf_dir):
    joined = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey"), "s_nationkey")
    return joined.groupBy("n_regionkey").agg((F.sum(cents("s_acctbal") * F.col("s_suppkey")) / F.sum("s_suppkey")).alias("weighted"))
