"""Queries over selection, matching, projection and text rules on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.functions import chat_tasks, masks
from tessella.operators import joins, sampling
from tessella.operators.folds import longest_spans, ordered_fold
from tessella.operators.ranking import hash_key, running_sum
from tessella.operators.staging import staged
from tessella.plans.catalogue import query
from tessella.plans.corpus import N_WORDS, SIZED, sized_once, table
from tessella.plans.relational import LINE_WIN, line_rank


def lines(spark, sf_dir):
    """Line items with their place in the order."""
    return table(spark, sf_dir, "lineitem").withColumn("rn", line_rank().cast("long"))


LINES = f"lines AS (SELECT *, row_number() OVER ({LINE_WIN}) AS rn FROM lineitem)"
EVENTS = "PARTITION BY user_id ORDER BY ts, event_id"
ROUND = "sha256('robin:' || doc_id)"


def by_user():
    return W.partitionBy("user_id").orderBy("ts", "event_id")


@query(
    "span_choice_by_budget",
    f"""WITH {LINES}, c AS (SELECT l_orderkey, rn, sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY rn) AS upto, l_quantity::BIGINT AS cost FROM lines)
SELECT s.l_orderkey, s.rn AS first_item, max(e.rn) AS last_item, max(e.upto - s.upto + s.cost)::BIGINT AS span_cost
FROM c s JOIN c e ON e.l_orderkey = s.l_orderkey AND e.rn >= s.rn AND (e.rn = s.rn OR e.upto - s.upto + s.cost <= 100) GROUP BY ALL""",
)
def span_choice_by_budget(spark, sf_dir):
    """From each item the longest span that fits; a first item over budget stands alone."""
    costs = lines(spark, sf_dir).select("l_orderkey", "rn", F.col("l_quantity").cast("long").alias("cost"))
    return ordered_fold(costs, ["l_orderkey"], ["rn"], ["rn", "cost"], "first_item bigint, last_item bigint, span_cost bigint", longest_spans(100))


@query(
    "short_segment_merge",
    """WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus, lag(o_orderstatus) OVER w IS DISTINCT FROM o_orderstatus AS starts FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
r AS (SELECT *, sum(starts::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS run FROM o),
g AS (SELECT o_custkey, run, count(*) AS n, min(o_orderkey) AS least_order FROM r GROUP BY ALL),
m AS (SELECT *, greatest(1, sum((n >= 2)::INT) OVER (PARTITION BY o_custkey ORDER BY run)) AS segment FROM g)
SELECT o_custkey, segment::BIGINT AS segment, sum(n)::BIGINT AS n_items, count(*) AS n_runs, min(least_order) AS least_order FROM m GROUP BY ALL""",
)
def short_segment_merge(spark, sf_dir):
    own = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    starts = (~F.lag("o_orderstatus").over(own).eqNullSafe(F.col("o_orderstatus"))).cast("int")
    runs = table(spark, sf_dir, "orders").withColumn("starts", starts).withColumn("run", F.sum("starts").over(own))
    counted = runs.groupBy("o_custkey", "run").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("least_order"))
    # Runs under two items join the segment before them, leading ones the first.
    segment = F.greatest(F.lit(1), F.sum((F.col("n") >= 2).cast("int")).over(W.partitionBy("o_custkey").orderBy("run")))
    merged = counted.withColumn("segment", segment.cast("long"))
    return merged.groupBy("o_custkey", "segment").agg(F.sum("n").alias("n_items"), F.count(F.lit(1)).alias("n_runs"), F.min("least_order").alias("least_order"))


@query(
    "header_row_on_change",
    f"""WITH {LINES}, c AS (SELECT l_orderkey, rn, l_returnflag, lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY rn) IS DISTINCT FROM l_returnflag AS changes FROM lines)
SELECT l_orderkey, rn, 0::BIGINT AS part, 'H ' || l_returnflag AS line FROM c WHERE changes UNION ALL SELECT l_orderkey, rn, 1::BIGINT, 'item ' || rn FROM c""",
)
def header_row_on_change(spark, sf_dir):
    before = F.lag("l_returnflag").over(W.partitionBy("l_orderkey").orderBy("rn"))
    rows = lines(spark, sf_dir).withColumn("changes", ~before.eqNullSafe(F.col("l_returnflag")))
    header = F.struct(F.lit(0).cast("long").alias("part"), F.concat(F.lit("H "), "l_returnflag").alias("line"))
    item = F.struct(F.lit(1).cast("long").alias("part"), F.concat(F.lit("item "), F.col("rn").cast("string")).alias("line"))
    return rows.select("l_orderkey", "rn", F.explode(F.when(F.col("changes"), F.array(header, item)).otherwise(F.array(item))).alias("row")).select("l_orderkey", "rn", "row.*")


@query(
    "first_row_per_key_stop",
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders) SELECT o_custkey, o_orderkey, o_totalprice FROM r WHERE i = 1 ORDER BY o_custkey LIMIT 100",
)
def first_row_per_key_stop(spark, sf_dir):
    """The first order of each customer, for the first hundred customers: a top-k report."""
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("o"))
    return first.orderBy("o_custkey").limit(100).select("o_custkey", "o.o_orderkey", "o.o_totalprice")


@query(
    "ordered_insertion",
    f"""WITH {LINES}, u AS (SELECT l_orderkey, rn * 10 AS spot, 5 AS priority, 'item' AS kind FROM lines
  UNION ALL SELECT l_orderkey, rn * 10 - 1, 1, 'discount' FROM lines WHERE l_discount >= 0.05 UNION ALL SELECT l_orderkey, rn * 10 - 1, 2, 'large' FROM lines WHERE l_quantity >= 40
  UNION ALL SELECT l_orderkey, rn * 10 + 1, 9, 'returned' FROM lines WHERE l_returnflag = 'R')
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY spot, priority) AS place, kind FROM u""",
)
def ordered_insertion(spark, sf_dir):
    def row(offset, priority, kind, when):
        return F.when(when, F.struct((F.col("rn") * 10 + offset).alias("spot"), F.lit(priority).alias("priority"), F.lit(kind).alias("kind")))

    spots = F.array_compact(
        F.array(
            row(0, 5, "item", F.lit(True)), row(-1, 1, "discount", F.col("l_discount") >= 0.05), row(-1, 2, "large", F.col("l_quantity") >= 40), row(1, 9, "returned", F.col("l_returnflag") == "R")
        )
    )
    spread = lines(spark, sf_dir).select("l_orderkey", F.explode(spots).alias("s")).select("l_orderkey", "s.*")
    return spread.select("l_orderkey", F.row_number().over(W.partitionBy("l_orderkey").orderBy("spot", "priority")).cast("long").alias("place"), "kind")


@query(
    "common_ids_in_first_order",
    f"""WITH c AS (SELECT user_id, min(event_id) AS first_click FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT user_id, first_click, row_number() OVER (ORDER BY first_click) AS place FROM c WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'view') AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')""",
)
def common_ids_in_first_order(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    common = events.groupBy("user_id").agg(
        F.min(F.when(F.col("event_type") == "click", F.col("event_id"))).alias("first_click"), *[F.bool_or(F.col("event_type") == t).alias(t) for t in ("view", "purchase")]
    )
    kept = common.where("first_click IS NOT NULL AND view AND purchase").select("user_id", "first_click")
    return running_sum(kept, F.lit(1), ["first_click"], F.floor(F.col("first_click") / 100000), None, "before").select("user_id", "first_click", (F.col("before") + 1).alias("place"))


@query(
    "cogroup_orders_lines",
    """SELECT o_orderkey, o_orderstatus, count(*) AS n_lines, sum(l_quantity::BIGINT)::BIGINT AS quantity, max(l_quantity::BIGINT) AS largest, sum((l_shipdate > o_orderdate)::INT)::BIGINT AS shipped_after
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""",
)
def cogroup_orders_lines(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    quantity = F.col("l_quantity").cast("long")
    return joined.groupBy("o_orderkey", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(quantity).alias("quantity"), F.max(quantity).alias("largest"), F.count_if(F.col("l_shipdate") > F.col("o_orderdate")).alias("shipped_after")
    )


@query(
    "alignment_index_join",
    f"""WITH {LINES}, a AS (SELECT l_orderkey, rn AS score_idx, (rn * 3) % 8 - 1 AS perf_idx FROM lines)
SELECT a.l_orderkey, score_idx, perf_idx, s.l_partkey AS score_part, p.l_partkey AS perf_part FROM a JOIN lines s ON s.l_orderkey = a.l_orderkey AND s.rn = score_idx JOIN lines p ON p.l_orderkey = a.l_orderkey AND p.rn = perf_idx""",
)
def alignment_index_join(spark, sf_dir):
    rows = lines(spark, sf_dir).select("l_orderkey", "rn", "l_partkey")
    # The alignment holds -1 and indices out of range: both are unmatched.
    aligned = rows.select("l_orderkey", F.col("rn").alias("score_idx"), ((F.col("rn") * 3) % 8 - 1).alias("perf_idx"))
    score = rows.select("l_orderkey", F.col("rn").alias("score_idx"), F.col("l_partkey").alias("score_part"))
    performed = rows.select("l_orderkey", F.col("rn").alias("perf_idx"), F.col("l_partkey").alias("perf_part"))
    return aligned.join(score, ["l_orderkey", "score_idx"]).join(performed, ["l_orderkey", "perf_idx"]).select("l_orderkey", "score_idx", "perf_idx", "score_part", "perf_part")


@query("fan_out_join", "SELECT c_custkey, n_name, n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey")
def fan_out_join(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return nations.join(table(spark, sf_dir, "customer"), "c_nationkey").select("c_custkey", "n_name", "n_regionkey")


@query(
    "projection_with_preference",
    "SELECT l_partkey, max((l_returnflag = 'R')::INT)::BIGINT AS is_lower, arg_min(l_suppkey, row(l_orderkey, l_linenumber, l_suppkey)) AS first_supplier, count(*) AS n FROM lineitem GROUP BY 1",
)
def projection_with_preference(spark, sf_dir):
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_partkey")
    return grouped.agg(
        F.max((F.col("l_returnflag") == "R").cast("long")).alias("is_lower"), F.min_by("l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_suppkey")).alias("first_supplier"), F.count(F.lit(1)).alias("n")
    )


#: Terms and their tokens.
TERMS = {"click": "CL", "purchase": "PU", "signup": "SU", "view": "VW"}


@query("dictionary_map", "SELECT event_id, CASE event_type WHEN 'click' THEN 'CL' WHEN 'purchase' THEN 'PU' WHEN 'signup' THEN 'SU' ELSE 'VW' END AS token FROM events WHERE event_type IN ('click', 'purchase', 'signup', 'view')")
def dictionary_map(spark, sf_dir):
    tokens = F.create_map(*[F.lit(x) for pair in TERMS.items() for x in pair])
    return table(spark, sf_dir, "events").select("event_id", F.try_element_at(tokens, F.col("event_type")).alias("token")).where("token IS NOT NULL")


@query(
    "zip_by_position",
    """WITH c AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = 'click'),
v AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = 'view')
SELECT user_id, i AS place, c.event_id AS click_id, v.event_id AS view_id, c.n = v.n AS same_length FROM c JOIN v USING (user_id, i)""",
)
def zip_by_position(spark, sf_dir):
    def side(kind):
        own = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
        n = F.count(F.lit(1)).over(W.partitionBy("user_id"))
        return own.select("user_id", F.row_number().over(by_user()).cast("long").alias("place"), F.col("event_id").alias(f"{kind}_id"), n.alias(f"{kind}_n"))

    both = side("click").join(side("view"), ["user_id", "place"])
    return both.select("user_id", "place", "click_id", "view_id", (F.col("click_n") == F.col("view_n")).alias("same_length"))


@query("enrich_from_small_table", "SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def enrich_from_small_table(spark, sf_dir):
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return table(spark, sf_dir, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name", "r_name")


@query("subset_count_by_id", "SELECT source, count(DISTINCT doc_id) AS n_docs FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1")
def subset_count_by_id(spark, sf_dir):
    kept = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return kept.groupBy("source").agg(F.countDistinct("doc_id").alias("n_docs"))


@query(
    "natural_sort_of_ids",
    f"WITH {LINES}, m AS (SELECT l_orderkey, 'M' || (rn * 7) AS measure FROM lines) SELECT l_orderkey, measure, row_number() OVER (PARTITION BY l_orderkey ORDER BY substr(measure, 2)::INT) AS place FROM m",
)
def natural_sort_of_ids(spark, sf_dir):
    named = lines(spark, sf_dir).select("l_orderkey", F.concat(F.lit("M"), (F.col("rn") * 7).cast("string")).alias("measure"))
    number = F.substring("measure", 2, 20).cast("int")
    return named.select("l_orderkey", "measure", F.row_number().over(W.partitionBy("l_orderkey").orderBy(number)).cast("long").alias("place"))


@query(
    "file_order_rank",
    """WITH r AS (SELECT conv_id, turn, role, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END AS k FROM conversations)
SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY k, turn) AS place FROM r""",
)
def file_order_rank(spark, sf_dir):
    rank = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.row_number().over(W.partitionBy("conv_id").orderBy(rank, "turn")).cast("long").alias("place"))


@query(
    "balanced_allocation_one_each",
    """WITH g AS (SELECT source, count(*) AS n, sha256('one:' || source) AS h FROM documents GROUP BY source),
units AS (SELECT source, row_number() OVER (ORDER BY depth, h) AS rn FROM (SELECT source, h, unnest(range(n)) AS depth FROM g))
SELECT source, n, count(rn)::BIGINT AS granted FROM g LEFT JOIN (SELECT * FROM units WHERE rn <= 4 * (SELECT count(*) FROM documents) // 5) USING (source) GROUP BY source, n""",
)
def balanced_allocation_one_each(spark, sf_dir):
    """Four fifths of the rows, dealt one by one to the groups in hash order until each runs out; what small groups leave goes on."""
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("h", hash_key("one", "source"))
    target = 4 * counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"] // 5  # one number
    granted = sampling.equal_budgets(counts, "h", "n", target).select("h", "granted")
    return counts.join(granted, "h").select("source", "n", "granted")


#: Sizes with the mark of protected documents.
PROTECTED = "p AS (SELECT s.*, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = s.doc_id AND quality = 1) AS is_protected FROM sized s)"


def protected_sizes(spark, sf_dir):
    """Sizes of the documents and whether they are protected (labelled good), as one narrow table."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct().withColumn("good", F.lit(True))
    docs = sized_once(spark, sf_dir).select("doc_id", "source", "tokens").join(good, "doc_id", "left")
    return staged(docs.select("doc_id", "source", "tokens", F.col("good").isNotNull().alias("is_protected")), "protected")


def share_of(df, percent):
    """A share of all tokens, as one number."""
    return percent * df.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"] // 100


def walk(rows: str, start: str, fits: str) -> str:
    """CTE ``w``: rows numbered by rn from 1, one by one: what is used and whether the row is taken."""
    return f"""w AS (SELECT 0::BIGINT AS rn, {start} AS used, false AS ok UNION ALL
  SELECT o.rn, w.used + CASE WHEN {fits} THEN o.tokens ELSE 0 END, {fits} FROM w JOIN {rows} o ON o.rn = w.rn + 1)"""


@query(
    "smallest_first_soft_edge",
    f"""WITH RECURSIVE {SIZED}, {PROTECTED}, t AS (SELECT 60 * sum(tokens)::BIGINT // 100 AS target FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY tokens, sha256('edge:' || doc_id)) - 1 AS depth FROM p WHERE NOT is_protected),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY depth, sha256('edge:' || depth || ':' || source)) AS rn FROM r WHERE depth > 0),
s AS (SELECT coalesce((SELECT sum(tokens) FROM p WHERE is_protected), 0)::BIGINT + coalesce((SELECT sum(tokens) FROM r WHERE depth = 0), 0)::BIGINT AS spent),
{walk('o', '(SELECT spent FROM s)', 'w.used < (SELECT target FROM t) AND (w.used + o.tokens <= (SELECT target FROM t) OR w.used < (SELECT target FROM t) * 0.995)')}
SELECT doc_id, tokens, 'protected' AS why FROM p WHERE is_protected UNION ALL SELECT doc_id, tokens, 'first' FROM r WHERE depth = 0 UNION ALL SELECT doc_id, tokens, 'drawn' FROM w JOIN o USING (rn) WHERE ok""",
)
def smallest_first_soft_edge(spark, sf_dir):
    """Protected documents, the smallest of each source, then rounds of the next smallest up to 60 percent of all tokens.

    A document that exceeds the target is still taken while less than 99.5 percent of it is reached.
    """
    docs = protected_sizes(spark, sf_dir)
    chosen = sampling.smallest_round_robin(docs, F.col("is_protected"), "source", "doc_id", "edge", "tokens", share_of(docs, 60), 0.995)
    return chosen.select("doc_id", "tokens", "why")


@query(
    "protected_one_each_shares",
    f"""WITH {SIZED}, {PROTECTED}, t AS (SELECT 60 * sum(tokens)::BIGINT // 100 AS target, sum(tokens) FILTER (is_protected)::BIGINT AS kept, sum(tokens) FILTER (NOT is_protected)::BIGINT AS rest FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256('main:' || doc_id)) - 1 AS depth, sum(tokens) OVER (PARTITION BY source) AS source_tokens FROM p WHERE NOT is_protected),
f AS (SELECT sum(tokens)::BIGINT AS ones FROM r WHERE depth = 0),
c AS (SELECT *, floor((target - kept - ones) * source_tokens / rest) AS share, sum(tokens) OVER (PARTITION BY source ORDER BY depth) AS upto FROM r, t, f WHERE depth > 0)
SELECT doc_id, source, tokens, 'protected' AS why FROM p WHERE is_protected UNION ALL SELECT doc_id, source, tokens, 'first' FROM r WHERE depth = 0 UNION ALL SELECT doc_id, source, tokens, 'drawn' FROM c WHERE upto <= share""",
)
def protected_one_each_shares(spark, sf_dir):
    """Protected documents, one of each source, then each source's share of what 60 percent of all tokens leave."""
    docs = protected_sizes(spark, sf_dir)
    return sampling.protected_then_shares(docs, F.col("is_protected"), "source", "doc_id", "main", "tokens", share_of(docs, 60)).select("doc_id", "source", "tokens", "why")


@query(
    "proportional_targets_last_rest",
    """WITH g AS (SELECT source, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source), s AS (SELECT *, round_even(100000 * chars / sum(chars) OVER (), 0)::BIGINT AS share, source = max(source) OVER () AS is_last FROM g)
SELECT source, chars, CASE WHEN is_last THEN greatest(0, 100000 - (SELECT coalesce(sum(share), 0) FROM s WHERE NOT is_last)) ELSE share END::BIGINT AS target FROM s""",
)
def proportional_targets_last_rest(spark, sf_dir):
    """A target split by the sources' characters, half to even; the last source takes the remainder."""
    sums = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("chars"))
    return sampling.share_targets(sums, "source", "chars", 100_000)


@query(
    "keep_sources_then_round_robin",
    f"""WITH RECURSIVE {SIZED}, t AS (SELECT sum(tokens)::BIGINT // 2 AS target, coalesce(sum(tokens) FILTER (source IN ('src1', 'src2', 'src3')), 0)::BIGINT AS kept FROM sized),
d AS (SELECT *, {ROUND} AS h, row_number() OVER (PARTITION BY source ORDER BY {ROUND}) - 1 AS depth FROM sized WHERE source NOT IN ('src1', 'src2', 'src3')),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY depth, tokens, h) AS rn FROM d),
{walk('o', '0::BIGINT', 'w.used + o.tokens <= (SELECT target - kept FROM t)')}
SELECT doc_id, source, tokens, 'kept' AS why FROM sized WHERE source IN ('src1', 'src2', 'src3') UNION ALL SELECT doc_id, source, tokens, 'drawn' FROM w JOIN o USING (rn) WHERE ok""",
)
def keep_sources_then_round_robin(spark, sf_dir):
    """All of the sources to keep, then a round robin over the others up to half of all tokens, passing over what does not fit."""
    docs = sized_once(spark, sf_dir).select("doc_id", "source", "tokens")
    keep = F.coalesce(F.col("source").isin("src1", "src2", "src3"), F.lit(False))
    kept = docs.where(keep)
    left = share_of(docs, 50) - kept.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"]
    drawn = sampling.round_robin(docs.where(~keep), ["source"], "doc_id", "robin", "tokens", left)
    return kept.withColumn("why", F.lit("kept")).unionByName(drawn.select("doc_id", "source", "tokens", F.lit("drawn").alias("why")))


@query(
    "match_counts_per_group",
    f"""WITH {SIZED}, d AS (SELECT s.doc_id, s.lang, s.tokens, l.doc_id IS NOT NULL AS labeled FROM sized s LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)),
n AS (SELECT lang, count(*) FILTER (labeled) AS wanted FROM d GROUP BY 1),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY tokens, sha256('match:' || doc_id)) AS i FROM d WHERE NOT labeled)
SELECT doc_id, lang FROM r JOIN n USING (lang) WHERE i <= wanted""",
)
def match_counts_per_group(spark, sf_dir):
    """As many unlabelled documents of a language as it has labelled ones, the smallest."""
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("labeled", F.lit(True))
    docs = sized_once(spark, sf_dir).select("doc_id", "lang", "tokens").join(labels, "doc_id", "left")
    wanted = docs.where("labeled").groupBy("lang").agg(F.count(F.lit(1)).alias("wanted"))
    others = docs.where("labeled IS NULL").withColumn("tie", hash_key("match", "doc_id"))
    ranked = sampling.by_depth(others, ["lang"], ["tokens", "tie"], F.col("tokens"))
    return ranked.join(wanted, "lang").where("depth < wanted").select("doc_id", "lang")


@query(
    "protected_first_then_round_robin",
    f"""WITH RECURSIVE {SIZED}, {PROTECTED}, t AS (SELECT 40 * sum(tokens)::BIGINT // 100 AS target FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY is_protected, source ORDER BY tokens, sha256('robin:' || doc_id)) - 1 AS depth FROM p),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY NOT is_protected, CASE WHEN is_protected THEN tokens ELSE depth END,
  CASE WHEN is_protected THEN {ROUND} ELSE sha256('robin:' || depth || ':' || source) END) AS rn FROM r),
{walk('o', '0::BIGINT', 'w.used < (SELECT target FROM t) AND w.used + o.tokens <= (SELECT target FROM t)')}
SELECT doc_id, tokens, is_protected FROM w JOIN o USING (rn) WHERE ok""",
)
def protected_first_then_round_robin(spark, sf_dir):
    """Protected documents from the smallest on, then rounds over the sources, each document if it still fits 40 percent of all tokens."""
    docs = protected_sizes(spark, sf_dir)
    chosen = sampling.protected_round_robin(docs, F.col("is_protected"), "source", "doc_id", "robin", "tokens", share_of(docs, 40))
    return chosen.select("doc_id", "tokens", "is_protected")


@query("slice_by_ordinal", "WITH r AS (SELECT page_id, url, row_number() OVER (ORDER BY page_id) - 1 AS i FROM pages) SELECT page_id, url, i AS ordinal FROM r WHERE i >= 10 AND i < 40")
def slice_by_ordinal(spark, sf_dir):
    ranked = running_sum(table(spark, sf_dir, "pages").select("page_id", "url"), F.lit(1), ["page_id"], F.floor(F.col("page_id") / 10000), None, "ordinal")
    return ranked.where("ordinal >= 10 AND ordinal < 40")


@query("first_n_per_group", "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents) SELECT doc_id, source, i AS place FROM r WHERE i <= 5")
def first_n_per_group(spark, sf_dir):
    # Spark keeps the group limit before the shuffle.
    ranked = table(spark, sf_dir, "documents").select("doc_id", "source", F.row_number().over(W.partitionBy("source").orderBy("doc_id")).cast("long").alias("place"))
    return ranked.where("place <= 5")


@query(
    "percentiles_per_component",
    f"""WITH m AS (SELECT doc_id, {N_WORDS} AS words, n_chars AS chars, len(string_split(text, chr(10)))::BIGINT AS lines FROM documents),
u AS (SELECT 'words' AS component, words AS v FROM m UNION ALL SELECT 'chars', chars FROM m UNION ALL SELECT 'lines', lines FROM m),
r AS (SELECT component, v, row_number() OVER (PARTITION BY component ORDER BY v) AS i, count(*) OVER (PARTITION BY component) AS n FROM u)
SELECT component, max(n) AS n, min(CASE WHEN i >= 0.5 * n THEN v END) AS p50, min(CASE WHEN i >= 0.9 * n THEN v END) AS p90, min(CASE WHEN i >= 0.99 * n THEN v END) AS p99, max(v) AS most FROM r GROUP BY 1""",
)
def percentiles_per_component(spark, sf_dir):
    """Nearest-rank percentiles of several measures, from the counts of their distinct values."""
    text = table(spark, sf_dir, "documents")
    measured = text.select(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"), F.col("n_chars").alias("chars"), F.size(F.split("text", "\n", -1)).cast("long").alias("lines"))
    counts = measured.unpivot([], ["words", "chars", "lines"], "component", "v").groupBy("component", "v").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("component").agg(F.sum("n").alias("n_all"))
    # Values by ranges: their counts are scanned by range first, then inside each.
    before = running_sum(counts, F.col("n"), ["v"], F.floor(F.col("v") / 1000), ["component"], "before").join(totals, "component")
    upto = F.col("before") + F.col("n")

    def share(q):
        return F.min(F.when(upto >= q * F.col("n_all"), F.col("v")))

    return before.groupBy("component").agg(F.max("n_all").alias("n"), share(0.5).alias("p50"), share(0.9).alias("p90"), share(0.99).alias("p99"), F.max("v").alias("most"))


@query(
    "filtered_statistics",
    "SELECT lang, count(*) AS n, count(*) FILTER (n_chars >= 1000) AS n_long, count(*) FILTER (text LIKE '%@%') AS n_at, count(*) FILTER (n_chars < 1000 AND text NOT LIKE '%@%') AS n_neither FROM documents GROUP BY 1",
)
def filtered_statistics(spark, sf_dir):
    is_long, has_at = F.col("n_chars") >= 1000, F.contains("text", F.lit("@"))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_long).alias("n_long"), F.count_if(has_at).alias("n_at"), F.count_if(~is_long & ~has_at).alias("n_neither")
    )


@query(
    "tag_difference",
    f"WITH t AS (SELECT p_partkey, regexp_extract_all(lower(p_type), '[a-z0-9]+') AS a, regexp_extract_all(lower(p_name || ' ' || p_brand), '[a-z0-9]+') AS b FROM part) SELECT p_partkey, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ' ') AS only_type, list_has_any(a, b) AS overlaps FROM t",
)
def tag_difference(spark, sf_dir):
    """Tags of one list that the other lacks, in their order and without regard to case; whether they overlap."""

    def tags(column):
        return F.regexp_extract_all(F.lower(column), F.lit("[a-z0-9]+"), F.lit(0))

    both = table(spark, sf_dir, "part").select("p_partkey", tags(F.col("p_type")).alias("a"), tags(F.concat_ws(" ", "p_name", "p_brand")).alias("b"))
    only = F.array_join(F.filter("a", lambda x: ~F.array_contains("b", x)), " ")
    return both.select("p_partkey", only.alias("only_type"), F.arrays_overlap("a", "b").alias("overlaps"))


@query(
    "union_count_check",
    """SELECT (SELECT count(*) FROM documents WHERE lang = 'en') AS n_first, (SELECT count(*) FROM documents WHERE lang <> 'en') AS n_second, (SELECT count(*) FROM documents WHERE lang IS NOT NULL) AS n_union,
  (SELECT count(*) FROM documents WHERE lang = 'en') + (SELECT count(*) FROM documents WHERE lang <> 'en') = (SELECT count(*) FROM documents WHERE lang IS NOT NULL) AS holds""",
)
def union_count_check(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    union = docs.where("lang = 'en'").withColumn("side", F.lit(1)).unionByName(docs.where("lang <> 'en'").withColumn("side", F.lit(2)))
    counted = union.agg(F.count_if(F.col("side") == 1).alias("n_first"), F.count_if(F.col("side") == 2).alias("n_second"), F.count(F.lit(1)).alias("n_union"))
    return counted.withColumn("holds", F.col("n_first") + F.col("n_second") == F.col("n_union"))


@query(
    "either_path_present",
    """WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN '/refined/' || o_orderkey || CASE WHEN o_orderkey % 5 = 0 THEN '_mini' ELSE '' END END AS refined, CASE WHEN o_orderkey % 2 = 0 THEN '/raw/' || o_orderkey END AS raw FROM orders WHERE o_orderstatus IS NOT NULL)
SELECT o_orderkey, coalesce(refined, raw) AS path, coalesce(refined, raw) LIKE '%\\_mini' ESCAPE '\\' AS is_mini FROM p WHERE refined IS NOT NULL OR raw IS NOT NULL""",
)
def either_path_present(spark, sf_dir):
    key = F.col("o_orderkey")
    refined = F.when(key % 3 != 0, F.concat(F.lit("/refined/"), key.cast("string"), F.when(key % 5 == 0, "_mini").otherwise("")))
    raw = F.when(key % 2 == 0, F.concat(F.lit("/raw/"), key.cast("string")))
    orders = table(spark, sf_dir, "orders").dropna(subset=["o_orderstatus"])
    paths = orders.select("o_orderkey", F.coalesce(refined, raw).alias("path")).where("path IS NOT NULL")
    return paths.withColumn("is_mini", F.endswith("path", F.lit("_mini")))


#: Segments that a caller may ask for.
TIERS = {"auto": ("AUTOMOBILE",), "home": ("HOUSEHOLD", "FURNITURE"), "all": None}


@query("tier_filter", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('HOUSEHOLD', 'FURNITURE')")
def tier_filter(spark, sf_dir, tier: str = "home"):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return customers if TIERS[tier] is None else customers.where(F.col("c_mktsegment").isin(*TIERS[tier]))


@query(
    "array_membership_filter",
    "SELECT vec_id, label, len(list_filter(embedding, lambda x: x > 0.4)) > 0 AS has_large, embedding[1] > 0 AS leads_positive FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.4)) > 0 OR embedding[1] > 0",
)
def array_membership_filter(spark, sf_dir):
    """Rows of which any element, or the first, meets its condition, and which of the two did."""
    told = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.exists("embedding", lambda x: x > 0.4).alias("has_large"), (F.get("embedding", 0) > 0).alias("leads_positive"))
    return told.where("has_large OR leads_positive")


@query(
    "piece_key_from_path",
    r"SELECT page_id, regexp_replace(regexp_replace(url, '^(https?://)?(www\.)?', ''), '(\.html?|/)$', '') AS piece, url LIKE 'https://%' AS is_secure FROM pages",
)
def piece_key_from_path(spark, sf_dir):
    stripped = F.regexp_replace(F.regexp_replace("url", r"^(https?://)?(www\.)?", ""), r"(\.html?|/)$", "")
    return table(spark, sf_dir, "pages").select("page_id", stripped.alias("piece"), F.startswith("url", F.lit("https://")).alias("is_secure"))


@query(
    "domain_whitelist",
    r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages WHERE regexp_matches(regexp_extract(url, '^[a-z]+://([^/]+)', 1), '(\.edu|\.org|example\.com|[a-m][0-9]*\.[a-z]+)$')",
)
def domain_whitelist(spark, sf_dir):
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    allowed = F.array(*[F.lit(d) for d in (r"\.edu$", r"\.org$", r"example\.com$", r"[a-m][0-9]*\.[a-z]+$")])
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host")).where(F.exists(allowed, lambda d: F.rlike("host", d)))


@query(
    "structural_line_normalise",
    f"WITH {LINES}, t AS (SELECT l_orderkey, rn, CASE WHEN rn % 2 = 1 THEN 'H' || rn ELSE 'C' || rn END || chr(9) || l_linenumber || chr(9) || '0' || chr(9) || '0' AS line FROM lines) SELECT l_orderkey, rn, regexp_replace(line, '^([HM])[0-9]+(\t[^\t]*\t[^\t]*\t[^\t]*)$', '\\1\\2') AS line FROM t",
)
def structural_line_normalise(spark, sf_dir):
    head = F.when(F.col("rn") % 2 == 1, "H").otherwise("C")
    line = F.concat_ws("\t", F.concat(head, F.col("rn").cast("string")), F.col("l_linenumber").cast("string"), F.lit("0"), F.lit("0"))
    return lines(spark, sf_dir).select("l_orderkey", "rn", F.regexp_replace(line, "^([HM])[0-9]+(\t[^\t]*\t[^\t]*\t[^\t]*)$", "$1$2").alias("line"))


@query(
    "tag_validity",
    """WITH t AS (SELECT p_partkey, list_filter(list_transform(string_split(replace(p_name, ' ', ',') || ',,' || p_brand, ','), lambda x: trim(x)), lambda x: x <> '') AS a, list_filter(list_transform(string_split(replace(p_type, ' ', ', '), ','), lambda x: trim(x)), lambda x: x <> '') AS b FROM part)
SELECT p_partkey, len(a)::BIGINT AS n_first, len(b)::BIGINT AS n_second, len(a) >= 3 AND len(b) >= 3 AS valid, list_has_any(list_transform(a, lambda x: lower(x)), list_transform(b, lambda x: lower(x))) AS overlaps FROM t""",
)
def tag_validity(spark, sf_dir):
    """Two lists of tags are valid with three each; an overlap, without regard to case, is only reported."""

    def tags(listed):
        return F.filter(F.transform(F.split(listed, ",", -1), lambda x: F.trim(x)), lambda x: x != "")

    a = tags(F.concat(F.replace("p_name", F.lit(" "), F.lit(",")), F.lit(",,"), F.col("p_brand")))
    b = tags(F.replace("p_type", F.lit(" "), F.lit(", ")))
    low = [F.transform(x, lambda t: F.lower(t)) for x in (a, b)]
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.size(a).cast("long").alias("n_first"), F.size(b).cast("long").alias("n_second"), ((F.size(a) >= 3) & (F.size(b) >= 3)).alias("valid"), F.arrays_overlap(*low).alias("overlaps")
    )


@query(
    "token_estimates",
    """SELECT doc_id, CASE lang WHEN 'en' THEN 512 WHEN 'fr' THEN 384 ELSE 294 END::BIGINT AS char_budget, n_chars <= CASE lang WHEN 'en' THEN 512 WHEN 'fr' THEN 384 ELSE 294 END AS fits,
  ceil(n_chars / CASE lang WHEN 'en' THEN 2.0 WHEN 'fr' THEN 1.5 ELSE 1.15 END::DOUBLE)::BIGINT AS tokens FROM documents""",
)
def token_estimates(spark, sf_dir):
    """Tokens of a text by its characters, and whether it fits 256 of them: 2, 1.5 or 1.15 characters a token by kind."""
    ratio = F.when(F.col("lang") == "en", 2.0).when(F.col("lang") == "fr", 1.5).otherwise(1.15)
    budget = F.floor(F.lit(256) * ratio)
    return table(spark, sf_dir, "documents").select("doc_id", budget.alias("char_budget"), (F.col("n_chars") <= budget).alias("fits"), F.ceil(F.col("n_chars") / ratio).alias("tokens"))


@query(
    "round_robin_to_ratio",
    f"""WITH {SIZED}, {PROTECTED}, t AS (SELECT 55 * sum(tokens)::BIGINT // 100 AS target FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256('ratio:' || doc_id)) - 1 AS depth FROM p WHERE NOT is_protected),
s AS (SELECT coalesce((SELECT sum(tokens) FROM p WHERE is_protected), 0)::BIGINT + coalesce((SELECT sum(tokens) FROM r WHERE depth = 0), 0)::BIGINT AS spent),
c AS (SELECT doc_id, tokens, coalesce(sum(tokens) OVER (ORDER BY depth, sha256('ratio:' || depth || ':' || source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r WHERE depth > 0)
SELECT doc_id, tokens, 'protected' AS why FROM p WHERE is_protected UNION ALL SELECT doc_id, tokens, 'first' FROM r WHERE depth = 0 UNION ALL SELECT doc_id, tokens, 'drawn' FROM c WHERE before < (SELECT target FROM t) - (SELECT spent FROM s)""",
)
def round_robin_to_ratio(spark, sf_dir):
    """Protected documents, one of each source, then rounds in hash order until 55 percent of all tokens are reached; the last one may exceed it."""
    docs = protected_sizes(spark, sf_dir)
    chosen = sampling.smallest_round_robin(docs, F.col("is_protected"), "source", "doc_id", "ratio", "tokens", share_of(docs, 55), 1.0, smallest=False)
    return chosen.select("doc_id", "tokens", "why")


@query("record_text", "SELECT doc_id, coalesce(lang, '') || ' ' || coalesce(source, '') || ' ' || coalesce(text, '') AS record FROM documents")
def record_text(spark, sf_dir):
    """Fields of a record joined by a space, whole; a missing one is empty."""
    fields = [F.coalesce(c, F.lit("")) for c in ("lang", "source", "text")]
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", *fields).alias("record"))


@query(
    "hard_split_to_limit",
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, i AS piece, substr(t, (i * 500 + 1)::BIGINT, 500) AS text FROM (SELECT doc_id, t, unnest(range(0, (length(t) + 499) // 500)) AS i FROM d)",
)
def hard_split_to_limit(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    pieces = F.ceil(F.length(text) / 500)
    cut = table(spark, sf_dir, "documents").where(F.length(text) > 0).select("doc_id", text.alias("t"), F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("piece"))
    return cut.select("doc_id", "piece", F.substr(F.col("t"), (F.col("piece") * 500 + 1).cast("int"), F.lit(500)).alias("text"))


@query(
    "chunk_by_source_kind",
    """WITH d AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'lines' WHEN 'fr' THEN 'whole' ELSE 'fixed' END AS kind, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, kind, CASE kind WHEN 'lines' THEN list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '') WHEN 'whole' THEN [t]
  ELSE list_transform(range(0, (length(t) + 299) // 300), lambda i: substr(t, i * 300 + 1, 300)) END AS parts FROM d)
SELECT doc_id, kind, i AS chunk_id, parts[i + 1] AS chunk FROM (SELECT *, unnest(range(len(parts))) AS i FROM c)""",
)
def chunk_by_source_kind(spark, sf_dir):
    """Chunks by the kind of a text: its non-blank lines, the whole, or pieces of 300 characters."""
    text = F.coalesce("text", F.lit(""))
    kind = F.when(F.col("lang") == "en", "lines").when(F.col("lang") == "fr", "whole").otherwise("fixed")
    pieces = F.ceil(F.length(text) / 300)
    starts = F.when(pieces > 0, F.sequence(F.lit(0).cast("long"), pieces - 1)).otherwise(F.expr("cast(array() as array<long>)"))
    fixed = F.transform(starts, lambda i: F.substr(text, (i * 300 + 1).cast("int"), F.lit(300)))
    lines_of = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != "")
    parts = F.when(kind == "lines", lines_of).when(kind == "whole", F.array(text)).otherwise(fixed)
    cut = table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), F.posexplode(parts).alias("chunk_id", "chunk"))
    return cut.withColumn("chunk_id", F.col("chunk_id").cast("long"))


@query(
    "gist_phrases",
    r"""WITH k AS (SELECT DISTINCT w AS word, 'about ' || substr(w, 1, 4) AS phrase FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS w FROM benchmark)),
d AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS place FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]{5,}') AS w FROM documents)),
f AS (SELECT doc_id, phrase, min(place) AS place FROM d JOIN k USING (word) GROUP BY ALL),
c AS (SELECT *, sum(2) OVER (PARTITION BY doc_id ORDER BY place) AS upto FROM f)
SELECT doc_id, string_agg(phrase, ', ' ORDER BY place) AS gist, max(upto)::BIGINT AS n_words FROM c WHERE upto <= 9 GROUP BY doc_id""",
)
def gist_phrases(spark, sf_dir):
    """Phrases of the keywords that a text holds, each once, by first place, while they stay within nine words.

    The table of keywords has hundreds of entries (here the benchmark's words,
    of which those with one beginning share a phrase) and is joined.
    """

    def long_words(text):
        return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]{5,}"), F.lit(0))

    keys = table(spark, sf_dir, "benchmark").select(F.explode(long_words("text")).alias("word")).distinct()
    keys = keys.select("word", F.concat(F.lit("about "), F.substring("word", 1, 4)).alias("phrase"))
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(long_words("text")).alias("place", "word")).join(keys, "word")
    firsts = found.groupBy("doc_id", "phrase").agg(F.min("place").alias("place"))
    sized_phrases = firsts.withColumn("n", F.size(F.split("phrase", " ")))
    upto = sized_phrases.withColumn("upto", F.sum("n").over(W.partitionBy("doc_id").orderBy("place"))).where("upto <= 9")
    # Nine words at most are gathered.
    gathered = upto.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "phrase"))).alias("g"), F.max("upto").alias("n_words"))
    return gathered.select("doc_id", F.array_join("g.phrase", ", ").alias("gist"), F.col("n_words").cast("long").alias("n_words"))


@query(
    "comma_phrases",
    "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), ','), lambda x: trim(x)), lambda x: length(x) >= 12)[1:3], ' | ') AS phrases FROM documents",
)
def comma_phrases(spark, sf_dir):
    phrases = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), ",", -1), lambda x: F.trim(x)), lambda x: F.length(x) >= 12)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(phrases, 1, 3), " | ").alias("phrases"))


@query(
    "prompt_sections",
    "SELECT o_orderkey, concat_ws(chr(10), 'Order: ' || o_orderkey, 'Customer: ' || o_custkey, CASE WHEN o_orderstatus <> 'F' THEN 'Status: ' || o_orderstatus END, 'Priority: ' || o_orderpriority) AS prompt FROM orders",
)
def prompt_sections(spark, sf_dir):
    """Sections joined by line breaks; one without a value is left out."""

    def section(name, column):
        return F.concat(F.lit(f"{name}: "), F.col(column).cast("string"))

    status = F.when(F.col("o_orderstatus") != "F", section("Status", "o_orderstatus"))
    prompt = F.concat_ws("\n", section("Order", "o_orderkey"), section("Customer", "o_custkey"), status, section("Priority", "o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", prompt.alias("prompt"))


@query(
    "mask_rewrite",
    r"""WITH t AS (SELECT conv_id, turn, (conv_id + turn) % 8 AS k, ['measure', 'phrase'][(conv_id + turn) % 2 + 1] || ['_score_lang_', '_perf_lang_'][(conv_id + turn) // 2 % 2 + 1] || ['continuation', 'mask'][(conv_id + turn) // 4 % 2 + 1] AS task,
  CASE WHEN (conv_id + turn) // 2 % 2 = 0 THEN ['acc', 'treble', 'bass', 'label'] ELSE ['timing', 'velocity', 'duration', 'pedal'] END[conv_id % 4 + 1] AS mask, coalesce(text, '') AS x FROM conversations),
m AS (SELECT *, CASE WHEN task LIKE '%\_perf\_%' ESCAPE '\' THEN replace(replace(replace(replace(replace(replace(x, 'the', '[MASK_VEL]'), 'on', '[MASK_DUR]'), 'er', '[MASK_TIMING]'), '[MASK_VEL]', 'X'), '[MASK_DUR]', 'X'), '[MASK_TIMING]', 'X')
  ELSE regexp_replace(list_aggregate(list_transform(regexp_extract_all(regexp_replace(replace(replace(replace(x, 'th', 'zzz'), 'on', 'z,,'), 'er', 'z4'), 'z,+', 'X', 'g'), 'z+|[^z]+'), lambda r: CASE WHEN r LIKE 'zz%' THEN repeat('X', length(r)) ELSE r END), 'string_agg', ''), 'z([0-9]+)', 'X\1', 'g') END AS masked FROM t)
SELECT conv_id, turn, task, coalesce(masked, '') AS masked, CASE WHEN task LIKE '%continuation' THEN 'Continue the ' || CASE WHEN contains(task, '_score_') THEN 'score' ELSE 'performance' END || ' to the next ' || string_split(task, '_')[1]
  ELSE 'Reconstruct the masked ' || CASE mask WHEN 'acc' THEN 'accidentals (sharps/flats)' WHEN 'treble' THEN 'treble clef (right hand)' WHEN 'bass' THEN 'bass clef (left hand)' WHEN 'label' THEN 'expression marks'
    WHEN 'timing' THEN 'note timing' WHEN 'velocity' THEN 'note velocities' WHEN 'duration' THEN 'note durations' ELSE 'pedal events' END || ' in the ' || CASE WHEN contains(task, '_score_') THEN 'score' ELSE 'performance' END END AS instruction FROM m""",
)
def mask_rewrite(spark, sf_dir):
    """Turns with the mask signs of score and performance tasks, rewritten, and the instruction of each task and mask."""
    k = F.col("conv_id") + F.col("turn")

    def pick(names, number):
        return F.element_at(F.array(*[F.lit(n) for n in names]), (number + 1).cast("int"))

    is_score = F.expr("(conv_id + turn) div 2 % 2") == 0
    task = F.concat(pick(("measure", "phrase"), k % 2), F.when(is_score, "_score_lang_").otherwise("_perf_lang_"), pick(("continuation", "mask"), F.expr("(conv_id + turn) div 4 % 2")))
    mask = F.when(is_score, pick(tuple(masks.HIDDEN["score"]), F.col("conv_id") % 4)).otherwise(pick(tuple(masks.HIDDEN["performance"]), F.col("conv_id") % 4))
    text = F.coalesce("text", F.lit(""))

    def signs(*pairs):
        marked = text
        for said, sign in pairs:
            marked = F.replace(marked, F.lit(said), F.lit(sign))
        return marked

    masked = F.when(is_score, masks.score_masks(signs(("th", "zzz"), ("on", "z,,"), ("er", "z4")))).otherwise(masks.performance_masks(signs(("the", "[MASK_VEL]"), ("on", "[MASK_DUR]"), ("er", "[MASK_TIMING]"))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", task.alias("task"), masked.alias("masked"), masks.instruction(task, mask).alias("instruction"))


@query(
    "compact_serialisation",
    f"WITH {LINES} SELECT l_orderkey, string_agg(l_partkey || ':' || l_quantity::BIGINT || CASE WHEN l_returnflag = 'R' THEN 'L' ELSE '' END, ' ' ORDER BY rn) AS line FROM lines GROUP BY 1",
)
def compact_serialisation(spark, sf_dir):
    item = F.concat(F.col("l_partkey").cast("string"), F.lit(":"), F.col("l_quantity").cast("long").cast("string"), F.when(F.col("l_returnflag") == "R", "L").otherwise(""))
    grouped = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("rn", item.alias("item")))).alias("items"))
    return grouped.select("l_orderkey", F.array_join(F.col("items.item"), " ").alias("line"))


@query(
    "compact_context",
    """WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM conversations)
SELECT conv_id, turn, lag(w[-1]) OVER p AS previous_last, t AS target, lead(w[1]) OVER p AS next_first FROM t WINDOW p AS (PARTITION BY conv_id ORDER BY turn)""",
)
def compact_context(spark, sf_dir):
    """Last word of the turn before, the whole turn, first word of the next."""
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    cut = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.get(words, 0).alias("first"), F.try_element_at(words, F.lit(-1)).alias("last"), text.alias("target"))
    turns = W.partitionBy("conv_id").orderBy("turn")
    return cut.select("conv_id", "turn", F.lag("last").over(turns).alias("previous_last"), "target", F.lead("first").over(turns).alias("next_first"))


@query(
    "human_size",
    """WITH d AS (SELECT doc_id, n_chars, CASE WHEN n_chars < 1024 THEN 0 WHEN n_chars < 1048576 THEN 1 WHEN n_chars < 1073741824 THEN 2 WHEN n_chars < 1099511627776 THEN 3 ELSE 4 END AS k FROM (SELECT doc_id, n_chars * n_chars AS n_chars FROM documents))
SELECT doc_id, CASE WHEN k = 0 THEN n_chars || ' B' ELSE printf('%.1f', round(n_chars * 10 / pow(1024, k), 0) / 10) || ' ' || ['KB', 'MB', 'GB', 'TB'][k] END AS size FROM d""",
)
def human_size(spark, sf_dir):
    """Sizes in the largest unit that leaves one or more; squares of the lengths stand for sizes, so that several units occur."""
    n, steps = F.col("n"), (1 << 10, 1 << 20, 1 << 30, 1 << 40)
    k = F.when(n < steps[0], 0).when(n < steps[1], 1).when(n < steps[2], 2).when(n < steps[3], 3).otherwise(4)
    units = F.array(*[F.lit(u) for u in ("KB", "MB", "GB", "TB")])
    rounded = F.round(n * 10 / F.pow(F.lit(1024), k), 0) / 10
    size = F.when(k == 0, F.concat(n.cast("string"), F.lit(" B"))).otherwise(F.format_string("%.1f %s", rounded, F.get(units, F.greatest(k - 1, F.lit(0)))))
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * F.col("n_chars")).alias("n")).select("doc_id", size.alias("size"))


#: Composers that file names abbreviate.
COMPOSERS = {"bach": "Johann Sebastian Bach", "mozart": "Wolfgang Amadeus Mozart"}
#: Catalogues by the prefix of a work.
CATALOGUES = {"bwv": "BWV ", "op": "Op. ", "k": "K. ", "d": "D. "}


@query(
    "name_parts",
    r"""WITH f AS (SELECT s_suppkey, ['bach', 'Mozart', 'schubert', 'liszt'][s_suppkey % 4 + 1] || CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE '_' || ['bwv', 'k', 'd', 'op', 's'][s_suppkey % 5 + 1] || lpad(s_suppkey::VARCHAR, 5, '0') || '_' || s_nationkey END AS file FROM supplier),
p AS (SELECT *, string_split(file, '_') AS x FROM f)
SELECT s_suppkey, CASE lower(x[1]) WHEN 'bach' THEN 'Johann Sebastian Bach' WHEN 'mozart' THEN 'Wolfgang Amadeus Mozart' ELSE upper(substr(x[1], 1, 1)) || lower(substr(x[1], 2)) END AS composer,
  CASE WHEN len(x) < 2 THEN '' WHEN starts_with(x[2], 'bwv') THEN 'BWV ' || ltrim(substr(x[2], 4), '0') WHEN starts_with(x[2], 'op') THEN 'Op. ' || ltrim(substr(x[2], 3), '0') WHEN starts_with(x[2], 'k') THEN 'K. ' || ltrim(substr(x[2], 2), '0')
    WHEN starts_with(x[2], 'd') THEN 'D. ' || ltrim(substr(x[2], 2), '0') ELSE upper(x[2]) END AS work FROM p""",
)
def name_parts(spark, sf_dir):
    """Composer and catalogue number of file names ``composer_work_rest``."""

    def pick(names, n):
        return F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("s_suppkey") % n + 1).cast("int"))

    number = F.lpad(F.col("s_suppkey").cast("string"), 5, "0")
    rest = F.when(F.col("s_suppkey") % 11 == 0, "").otherwise(F.concat(F.lit("_"), pick(("bwv", "k", "d", "op", "s"), 5), number, F.lit("_"), F.col("s_nationkey").cast("string")))
    parts = F.split(F.concat(pick(("bach", "Mozart", "schubert", "liszt"), 4), rest), "_", -1)
    first, work = F.get(parts, 0), F.get(parts, 1)
    composer = F.coalesce(F.create_map(*[F.lit(x) for pair in COMPOSERS.items() for x in pair])[F.lower(first)], F.initcap(first))
    # The first prefix that fits counts, so that longer ones stand first.
    named = F.coalesce(*[F.when(F.startswith(work, F.lit(p)), F.concat(F.lit(label), F.regexp_replace(F.substring(work, len(p) + 1, 100), "^0+", ""))) for p, label in CATALOGUES.items()], F.upper(work), F.lit(""))
    return table(spark, sf_dir, "supplier").select("s_suppkey", composer.alias("composer"), named.alias("work"))


@query(
    "sampled_sequence_match",
    f"""WITH e AS (SELECT user_id, event_type, row_number() OVER ({EVENTS}) - 1 AS p FROM events WHERE user_id IS NOT NULL),
n AS (SELECT user_id, count(*) AS n FROM e GROUP BY 1), q AS (SELECT a.user_id AS u, a.n AS la, b.n AS lb, least(300, a.n, b.n) AS k FROM n a JOIN n b ON b.user_id = a.user_id + 1),
i AS (SELECT u, k, la, lb, unnest(range(k)) AS i FROM q)
SELECT u AS user_id, count(*) AS n_sampled, sum((x.event_type = y.event_type)::INT)::BIGINT AS n_equal, sum((x.event_type = y.event_type)::INT) / count(*) AS share
FROM i JOIN e x ON x.user_id = u AND x.p = i * la // k JOIN e y ON y.user_id = u + 1 AND y.p = i * lb // k GROUP BY u""",
)
def sampled_sequence_match(spark, sf_dir):
    """Share of equal types of a user and the next one at up to 300 places spread over the whole of both sequences."""
    events = table(spark, sf_dir, "events").where("user_id IS NOT NULL").select("user_id", "ts", "event_id", "event_type")
    placed = running_sum(events, F.lit(1), ["ts", "event_id"], F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600), ["user_id"], "p").select("user_id", "event_type", "p")
    n = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("la"))
    pairs = n.join(n.select((F.col("user_id") - 1).alias("user_id"), F.col("la").alias("lb")), "user_id").withColumn("k", F.least(F.lit(300), "la", "lb"))

    def sample(own, length, name):
        # A place is sampled if it is floor(i * length / k) of some i; k is at most the length, so of one i only.
        i = F.ceil(F.col("p") * F.col("k") / F.col(length)).cast("long")
        joined = own.join(pairs, "user_id").withColumn("i", i)
        return joined.where((F.col("i") < F.col("k")) & (F.floor(F.col("i") * F.col(length) / F.col("k")) == F.col("p"))).select("user_id", "i", F.col("event_type").alias(name))

    both = sample(placed, "la", "x").join(sample(placed.withColumn("user_id", F.col("user_id") - 1), "lb", "y"), ["user_id", "i"])
    counted = both.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sampled"), F.count_if(F.col("x") == F.col("y")).alias("n_equal"))
    return counted.withColumn("share", F.col("n_equal") / F.col("n_sampled"))


@query(
    "reply_parse_pivot",
    """WITH r AS (SELECT event_id, 'FILE_' || user_id || '_' || CASE WHEN event_id % 2 = 0 THEN 'alpha' ELSE 'beta' END || ': ' || event_type AS line FROM events),
p AS (SELECT event_id, regexp_extract(line, '^FILE_(\\d+)_(alpha|beta): (.*)$', 1)::BIGINT AS file, regexp_extract(line, '^FILE_(\\d+)_(alpha|beta): (.*)$', 2) AS kind, regexp_extract(line, '^FILE_(\\d+)_(alpha|beta): (.*)$', 3) AS said FROM r)
SELECT file, arg_min(said, event_id) FILTER (kind = 'alpha') AS alpha, arg_min(said, event_id) FILTER (kind = 'beta') AS beta FROM p GROUP BY 1""",
)
def reply_parse_pivot(spark, sf_dir):
    kind = F.when(F.col("event_id") % 2 == 0, "alpha").otherwise("beta")
    line = F.concat(F.lit("FILE_"), F.col("user_id").cast("string"), F.lit("_"), kind, F.lit(": "), F.col("event_type"))
    pattern = r"^FILE_(\d+)_(alpha|beta): (.*)$"
    parsed = table(spark, sf_dir, "events").select("event_id", *[F.regexp_extract(line, pattern, i).alias(n) for i, n in ((1, "file"), (2, "kind"), (3, "said"))])

    def first(name):
        return F.min(F.when(F.col("kind") == name, F.struct("event_id", "said")))["said"].alias(name)

    return parsed.groupBy(F.col("file").cast("long").alias("file")).agg(first("alpha"), first("beta"))


@query("text_card", "SELECT n_nationkey, format('Nation {} ({}) has {} customers.', n_name, n_nationkey, count(c_custkey)) AS card FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name")
def text_card(spark, sf_dir):
    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    joined = table(spark, sf_dir, "nation").join(counts, "n_nationkey", "left")
    return joined.select("n_nationkey", F.format_string("Nation %s (%d) has %d customers.", "n_name", "n_nationkey", F.coalesce("n", F.lit(0))).alias("card"))


@query(
    "split_at_marker",
    "SELECT doc_id, i AS part, s[i + 1] AS text FROM (SELECT doc_id, s, unnest(range(0, len(s))) AS i FROM (SELECT doc_id, list_filter(string_split(coalesce(text, ''), '. '), lambda x: trim(x) <> '') AS s FROM documents))",
)
def split_at_marker(spark, sf_dir):
    """Parts between markers, numbered from zero; blank ones are left out."""
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), r"\. ", -1), lambda x: F.trim(x) != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(parts).alias("part", "text")).select("doc_id", F.col("part").cast("long").alias("part"), "text")


@query(
    "candidate_pair_blocking",
    """SELECT a.s_suppkey AS a, b.s_suppkey AS b, a.s_nationkey FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey
WHERE (a.s_acctbal + 2000) / (b.s_acctbal + 2000) BETWEEN 0.75 AND 1.33""",
)
def candidate_pair_blocking(spark, sf_dir):
    """Pairs of one nation whose balances have a ratio of 0.75 to 1.33: bands as wide as the rule, so a pair's bands are neighbours."""
    own = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_acctbal") + 2000).alias("v"))
    pairs = joins.ratio_join(own, own, ["s_nationkey"], "v", 0.75, 1.33)
    return pairs.where("l.s_suppkey < r.s_suppkey").select(F.col("l.s_suppkey").alias("a"), F.col("r.s_suppkey").alias("b"), F.col("l.s_nationkey"))


@query(
    "sample_at_most_n",
    "SELECT doc_id FROM documents ORDER BY sha256('sample:' || doc_id), doc_id LIMIT 50",
)
def sample_at_most_n(spark, sf_dir):
    """Fifty documents in hash order: a sampling operator."""
    return table(spark, sf_dir, "documents").select("doc_id").orderBy(hash_key("sample", "doc_id"), "doc_id").limit(50)


@query(
    "chat_task_messages",
    r"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS x, lag(text) OVER w AS before, lead(text) OVER w AS following,
  CASE WHEN row_number() OVER w = 1 THEN 'coldstart' WHEN lead(turn) OVER w IS NULL THEN 'ending' ELSE 'main' END AS kind FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
k AS (SELECT *, ['measure_epr', 'phrase_epr', 'abcx2pm', 'sm2pm', 'measure_score_lang_continuation', 'measure_score_lang_mask', 'phrase_score_lang_continuation', 'phrase_score_lang_mask', 'measure_perf_lang_continuation', 'measure_perf_lang_mask', 'other'][(conv_id * 3 + turn) % 11 + 1] AS task,
  regexp_replace(x, '\s+$', '') AS body, regexp_replace(coalesce(before, ''), '\s+$', '') AS old FROM t),
p AS (SELECT *, CASE WHEN starts_with(task, 'phrase_') THEN 'phrase' ELSE 'measure' END AS lv, chr(10) || 'Task type: ' || kind AS tt FROM k),
u AS (SELECT *, CASE WHEN task LIKE '%epr' THEN 'Render target ' || lv || ' ' || turn || ' from aligned ABCX score into expressive compact MIDI-TSV performance. Use the previous performance context if provided. Output only the target ' || lv || '.' || tt
      || CASE WHEN body <> '' THEN chr(10) || 'Score:' || chr(10) || body ELSE '' END || CASE WHEN old <> '' THEN chr(10) || 'Previous performance:' || chr(10) || old ELSE '' END
    WHEN task IN ('abcx2pm', 'sm2pm') THEN replace(CASE WHEN kind = 'coldstart' OR coalesce(before, '') = '' THEN 'Render the provided @ into expressive performance midi. Output only the target span.'
      ELSE 'Using the provided first performance measure as a style reference, render the rest of the @ into expressive performance midi. Output only the target span.' END, '@', CASE task WHEN 'abcx2pm' THEN 'abcx score' ELSE 'score midi' END) || tt
      || CASE WHEN body <> '' THEN chr(10) || CASE task WHEN 'abcx2pm' THEN 'abcx' ELSE 'score midi' END || ':' || chr(10) || body ELSE '' END || CASE WHEN old <> '' THEN chr(10) || 'first performance measure:' || chr(10) || old ELSE '' END
    WHEN task LIKE '%score_lang_continuation' THEN 'Continue the aligned ABCX score from the given ' || lv || '. Output only the next ' || lv || '.' || CASE WHEN body <> '' THEN chr(10) || 'Score:' || chr(10) || body ELSE '' END
    WHEN task LIKE '%score_lang_mask' THEN 'Restore the acc-masked aligned ABCX score ' || lv || '. Output only the restored ' || lv || '.' || CASE WHEN body <> '' THEN chr(10) || 'Score:' || chr(10) || body ELSE '' END
    WHEN task = 'measure_perf_lang_continuation' THEN 'Continue the compact MIDI-TSV performance from the given measure. Output only the next measure.' || CASE WHEN body <> '' THEN chr(10) || 'Performance:' || chr(10) || body ELSE '' END
    WHEN task = 'measure_perf_lang_mask' THEN 'Restore the acc-masked compact MIDI-TSV performance measure. Output only the restored measure.' || CASE WHEN body <> '' THEN chr(10) || 'Performance:' || chr(10) || body ELSE '' END END AS said FROM p)
SELECT conv_id, turn, task, sha256(said) AS user_sha256, sha256(CASE WHEN said IS NOT NULL THEN coalesce(following, '') END) AS answer_sha256, CASE WHEN task LIKE '%_lang_%' THEN task WHEN task <> 'other' THEN 'unknown' END AS inferred FROM u""",
)
def chat_task_messages(spark, sf_dir):
    """Turns as samples of the ten tasks (and one that is none), as chat messages, and the task told from the prompt."""
    turns = W.partitionBy("conv_id").orderBy("turn")
    place = F.when(F.row_number().over(turns) == 1, "coldstart").when(F.lead("turn").over(turns).isNull(), "ending").otherwise("main")
    task = F.element_at(F.array(*[F.lit(t) for t in (*chat_tasks.TASKS, "other")]), ((F.col("conv_id") * 3 + F.col("turn")) % 11 + 1).cast("int"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lag("text").over(turns).alias("before"), F.lead("text").over(turns).alias("following"), place.alias("kind"), task.alias("task"))
    user = chat_tasks.user_message(F.col("task"), F.col("kind"), F.col("turn").cast("string"), F.col("before"), F.col("text"), F.col("text"), F.lit("acc"))
    said = rows.withColumn("m", chat_tasks.messages(user, F.col("following")))
    content = [F.col("m")[i]["content"] for i in (0, 1)]
    return said.select("conv_id", "turn", "task", F.sha2(content[0], 256).alias("user_sha256"), F.sha2(content[1], 256).alias("answer_sha256"), F.when(content[0].isNotNull(), chat_tasks.inferred_task(content[0])).alias("inferred"))
