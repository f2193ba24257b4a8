"""Queries over structure: chunks under headings and fences, greedy folds, maps, reports and checks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.functions import events as ev
from tessella.operators import chunking, sampling, windows
from tessella.operators.ranking import running_sum
from tessella.plans.catalogue import query
from tessella.plans.corpus import SIZED, WORDS, sized_once, table
from tessella.plans.selection import LINES, lines
from tessella.plans.sequences import EVENTS, HOUR, KEY, ORDER, WIN, events

WORD = r"[^\x20\x09-\x0D]+"
TEXT_LINES = "l AS (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))"


@query(
    "chunks_under_headings",
    rf"""WITH RECURSIVE {TEXT_LINES}, i AS (SELECT doc_id, coalesce(source, '') AS source, line, length(line) + 1 AS cost, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM l JOIN documents USING (doc_id) WHERE regexp_matches(line, '{WORD}')),
w AS (SELECT doc_id, source, rn, line, 0 AS chunk_id, length(source) + 3 + cost AS acc FROM i WHERE rn = 1
  UNION ALL SELECT i.doc_id, i.source, i.rn, i.line, CASE WHEN w.acc + i.cost > 600 THEN w.chunk_id + 1 ELSE w.chunk_id END, CASE WHEN w.acc + i.cost > 600 THEN length(i.source) + 3 + i.cost ELSE w.acc + i.cost END
  FROM w JOIN i ON i.doc_id = w.doc_id AND i.rn = w.rn + 1)
SELECT doc_id, chunk_id, count(*) AS n_lines, max(acc)::BIGINT AS num_chars, sha256('## ' || any_value(source) || chr(10) || string_agg(line, chr(10) ORDER BY rn)) AS chunk_sha256 FROM w GROUP BY doc_id, chunk_id""",
)
def chunks_under_headings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    chunks = chunking.chunk_chars(docs, "doc_id", "text", F.concat(F.lit("## "), F.coalesce("source", F.lit(""))), 600)
    return chunks.select("doc_id", "chunk_id", "n_lines", "num_chars", F.sha2("chunk", 256).alias("chunk_sha256"))


@query(
    "fenced_block_split",
    f"""WITH RECURSIVE {TEXT_LINES}, w AS (SELECT doc_id, pos, {WORDS.format('line')} AS w FROM l), u AS (SELECT doc_id, pos, unnest(range(0, len(w), 62)) AS part, w FROM w),
items AS (SELECT doc_id, array_to_string(w[part + 1:part + 62], ' ') AS unit, len(w[part + 1:part + 62])::BIGINT AS cost, row_number() OVER (PARTITION BY doc_id ORDER BY pos, part) AS rn FROM u),
walk AS (SELECT doc_id, rn, unit, 0 AS chunk_id, 2 + cost AS acc FROM items WHERE rn = 1
  UNION ALL SELECT i.doc_id, i.rn, i.unit, CASE WHEN w.acc + i.cost > 64 THEN w.chunk_id + 1 ELSE w.chunk_id END, CASE WHEN w.acc + i.cost > 64 THEN 2 + i.cost ELSE w.acc + i.cost END
  FROM walk w JOIN items i ON i.doc_id = w.doc_id AND i.rn = w.rn + 1)
SELECT doc_id, chunk_id, count(*) AS n_units, max(acc)::BIGINT AS num_tokens, sha256('```' || coalesce(any_value(lang), '') || chr(10) || string_agg(unit, chr(10) ORDER BY rn) || chr(10) || '```') AS chunk_sha256
FROM walk JOIN documents USING (doc_id) GROUP BY doc_id, chunk_id""",
)
def fenced_block_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    chunks = chunking.chunk_text(docs, "doc_id", "text", 64, F.concat(F.lit("```"), F.coalesce("lang", F.lit(""))), F.lit("```"))
    return chunks.select("doc_id", "chunk_id", "n_units", "num_tokens", F.sha2("chunk", 256).alias("chunk_sha256"))


@query(
    "hold_out_with_overshoot",
    """WITH RECURSIVE c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), g AS (SELECT *, row_number() OVER (ORDER BY sha256('val:' || o_custkey)) AS rn FROM c),
w AS (SELECT rn, o_custkey, n, n <= 37.5 AS taken, CASE WHEN n <= 37.5 THEN n ELSE 0 END AS held FROM g WHERE rn = 1
  UNION ALL SELECT g.rn, g.o_custkey, g.n, w.held < 25 AND w.held + g.n <= 37.5, CASE WHEN w.held < 25 AND w.held + g.n <= 37.5 THEN w.held + g.n ELSE w.held END FROM w JOIN g ON g.rn = w.rn + 1)
SELECT o_custkey, n FROM w WHERE taken""",
)
def hold_out_with_overshoot(spark, sf_dir):
    return sampling.hold_out_fitting(table(spark, sf_dir, "orders").select("o_custkey"), "o_custkey", "val", 25)


CARDS = {"terms": 3, "summary": 2, "question": 5}


@query(
    "expand_until_floor",
    f"""WITH {SIZED}, b AS (SELECT doc_id, tokens FROM sized WHERE lang = 'de'), t AS (SELECT sum(tokens) AS t, count(*) AS n FROM b),
r AS (SELECT doc_id, tokens, c AS cycle, tokens + CASE WHEN c = 0 THEN 0 ELSE [3, 2, 5][(c - 1) % 3 + 1] END AS cost FROM b, (SELECT unnest(range(0, 20)) AS c)),
s AS (SELECT *, coalesce(sum(cost) OVER (ORDER BY cycle, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM r)
SELECT doc_id, cycle::INTEGER AS cycle, CASE WHEN cycle = 0 THEN 'base' ELSE ['terms', 'summary', 'question'][(cycle - 1) % 3 + 1] END AS card, spent::BIGINT AS spent
FROM s WHERE cycle = 0 OR spent < (SELECT 3 * t + 10 FROM t)""",
)
def expand_until_floor(spark, sf_dir):
    base = sized_once(spark, sf_dir).where("lang = 'de'").select("doc_id", "tokens")
    total = base.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"]  # one number
    filled = sampling.fill_to_floor(base, ["doc_id"], F.floor(F.col("doc_id") / 1000), "tokens", 3 * total + 10, list(CARDS.values()))
    card = F.when(F.col("cycle") == 0, "base").otherwise(F.element_at(F.array(*[F.lit(c) for c in CARDS]), (F.col("cycle") - 1) % len(CARDS) + 1))
    return filled.select("doc_id", "cycle", card.alias("card"), "spent")


@query(
    "onset_groups_by_first",
    f"""WITH RECURSIVE {EVENTS}, r AS (SELECT user_id, us, event_id, row_number() OVER ({WIN}) AS rn FROM e),
w AS (SELECT user_id, rn, us, us AS anchor, 0 AS g FROM r WHERE rn = 1
  UNION ALL SELECT r.user_id, r.rn, r.us, CASE WHEN r.us - w.anchor > {24 * HOUR} THEN r.us ELSE w.anchor END, w.g + (r.us - w.anchor > {24 * HOUR})::INT FROM w JOIN r ON r.user_id = w.user_id AND r.rn = w.rn + 1)
SELECT user_id, g AS "group", anchor, count(*) AS n FROM w GROUP BY ALL""",
)
def onset_groups_by_first(spark, sf_dir):
    grouped = windows.onset_groups(events(spark, sf_dir), KEY, ORDER, "us", 24 * HOUR)
    return grouped.groupBy("user_id", "group", "anchor").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ranges_by_expected_count",
    f"""WITH RECURSIVE {LINES}, m AS (SELECT l_orderkey, rn, l_quantity::BIGINT % 4 AS c, count(*) OVER (PARTITION BY l_orderkey) AS total FROM lines),
w AS (SELECT l_orderkey, rn, c > 0 AND c <= total AS fits, 0::BIGINT AS place, CASE WHEN c > 0 AND c <= total THEN c ELSE 0 END AS taken FROM m WHERE rn = 1
  UNION ALL SELECT m.l_orderkey, m.rn, m.c > 0 AND w.place + w.taken + m.c <= m.total, w.place + w.taken, CASE WHEN m.c > 0 AND w.place + w.taken + m.c <= m.total THEN m.c ELSE 0 END FROM w JOIN m ON m.l_orderkey = w.l_orderkey AND m.rn = w.rn + 1)
SELECT l_orderkey, rn, CASE WHEN fits THEN place END AS first_group, CASE WHEN fits THEN place + taken - 1 END AS last_group FROM w""",
)
def ranges_by_expected_count(spark, sf_dir):
    total = F.count(F.lit(1)).over(W.partitionBy("l_orderkey"))
    measures = lines(spark, sf_dir).select("l_orderkey", "rn", (F.col("l_quantity").cast("long") % 4).alias("expected"), total.alias("total"))
    return windows.consume_counts(measures, ["l_orderkey"], ["rn"], "rn", "expected", "total")


@query(
    "measure_times_from_groups",
    f"""WITH RECURSIVE {LINES}, m AS (SELECT l_orderkey, rn, l_quantity::BIGINT % 4 AS c, count(*) OVER (PARTITION BY l_orderkey) AS total, round(l_discount * 100)::BIGINT * 5000 AS nominal,
  coalesce(sum(round(l_extendedprice)::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS tm FROM lines),
w AS (SELECT l_orderkey, rn, c > 0 AND c <= total AS fits, 0::BIGINT AS place, CASE WHEN c > 0 AND c <= total THEN c ELSE 0 END AS taken FROM m WHERE rn = 1
  UNION ALL SELECT m.l_orderkey, m.rn, m.c > 0 AND w.place + w.taken + m.c <= m.total, w.place + w.taken, CASE WHEN m.c > 0 AND w.place + w.taken + m.c <= m.total THEN m.c ELSE 0 END FROM w JOIN m ON m.l_orderkey = w.l_orderkey AND m.rn = w.rn + 1),
g AS (SELECT w.l_orderkey, w.rn, x.rn AS place, x.tm, lead(x.tm) OVER (PARTITION BY w.l_orderkey, w.rn ORDER BY x.rn) - x.tm AS step FROM w JOIN m x ON fits AND x.l_orderkey = w.l_orderkey AND x.rn - 1 BETWEEN place AND place + taken - 1),
s AS (SELECT l_orderkey, rn, max(tm) AS tm, list_sort(list(step) FILTER (step > 0)) AS steps FROM g GROUP BY ALL),
o AS (SELECT m.l_orderkey, m.rn, nominal, sum(nominal) OVER (PARTITION BY m.l_orderkey ORDER BY m.rn) AS upto, s.tm + coalesce(steps[len(steps) // 2 + 1], nominal) AS own FROM m LEFT JOIN s ON s.l_orderkey = m.l_orderkey AND s.rn = m.rn),
t AS (SELECT l_orderkey, rn, 0::BIGINT AS a, greatest(nominal, coalesce(own, upto))::BIGINT AS z FROM o WHERE rn = 1
  UNION ALL SELECT o.l_orderkey, o.rn, t.z, greatest(t.z + o.nominal, coalesce(o.own, o.upto))::BIGINT FROM t JOIN o ON o.l_orderkey = t.l_orderkey AND o.rn = t.rn + 1)
SELECT l_orderkey, rn, a AS start_time, z AS end_time FROM t""",
)
def measure_times_from_groups(spark, sf_dir):
    """Times of items that consumed groups of their order; items without groups keep their place between known times."""
    before = W.partitionBy("l_orderkey").orderBy("rn").rowsBetween(W.unboundedPreceding, -1)
    total = F.count(F.lit(1)).over(W.partitionBy("l_orderkey"))
    price = F.round("l_extendedprice").cast("long")
    measures = lines(spark, sf_dir).select(
        "l_orderkey", "rn", (F.col("l_quantity").cast("long") % 4).alias("expected"), total.alias("total"), (F.round(F.col("l_discount") * 100).cast("long") * 5000).alias("nominal"),
        F.coalesce(F.sum(price).over(before), F.lit(0)).cast("long").alias("at"),
    )
    ranges = windows.consume_counts(measures, ["l_orderkey"], ["rn"], "rn", "expected", "total", ("nominal",))
    groups = measures.select("l_orderkey", (F.col("rn") - 1).alias("place"), "at")
    refined = windows.refined_times(ranges, groups, ["l_orderkey"], "rn", "nominal", "place", "at")
    return refined.select("l_orderkey", "rn", F.col("start").alias("start_time"), F.col("end").alias("end_time"))


@query(
    "segments_near_target",
    f"""WITH RECURSIVE {EVENTS}, g AS (SELECT user_id, list((event_type = 'purchase')::INT * 10 ORDER BY us, event_id) AS b FROM e GROUP BY user_id),
w AS (SELECT user_id, b, 0::BIGINT AS segment, 0::BIGINT AS start, 0::BIGINT AS n FROM g
  UNION ALL SELECT user_id, b, segment + 1, start + n, CASE WHEN len(b) - start - n <= 3 THEN len(b) - start - n ELSE
    (list_reverse_sort(list_transform(range(3, least(8, len(b) - start - n) + 1), lambda k: {{'s': -20 * abs(2 * k - 9) - 5 * abs(k - 5.5) + 7 * b[start + n + k], 'n': k}}))[1]).n END FROM w WHERE start + n < len(b))
SELECT user_id, (segment - 1)::INTEGER AS segment, start, n FROM w WHERE segment > 0""",
)
def segments_near_target(spark, sf_dir):
    scored = events(spark, sf_dir).withColumn("bonus", (F.col("event_type") == "purchase").cast("int") * 10)
    return chunking.select_segments(scored, KEY, ORDER, "bonus", 2, 3, 8, 9, 6, 14)


@query(
    "lookup_through_range_map",
    f"""WITH {LINES}, b AS (SELECT l_orderkey, rn - 1 AS idx, round(l_extendedprice * 100)::BIGINT AS tick, CASE rn % 3 WHEN 0 THEN (rn + 1) || '-' || (rn + 2) WHEN 1 THEN (rn + 1)::VARCHAR ELSE 'x' END AS item FROM lines),
x AS (SELECT l_orderkey, idx, tick, TRY_CAST(trim(unnest(string_split(item, '-'))) AS BIGINT) AS m FROM b), p AS (SELECT l_orderkey, m, arg_min(tick, idx) AS tick FROM x WHERE m IS NOT NULL GROUP BY ALL),
o AS (SELECT l_orderkey, count(*) AS n, arg_min(tick, idx) AS a, arg_max(tick, idx) AS z FROM b GROUP BY 1), q AS (SELECT *, unnest(range(n + 3)) AS m FROM o)
SELECT q.l_orderkey, q.m AS measure, CASE WHEN q.m = 0 THEN a ELSE coalesce(p.tick, b.tick, z + 500) END AS tick FROM q LEFT JOIN p ON p.l_orderkey = q.l_orderkey AND p.m = q.m LEFT JOIN b ON b.l_orderkey = q.l_orderkey AND b.idx = q.m""",
)
def lookup_through_range_map(spark, sf_dir):
    """Times of measures through a map that may name several: mapped, else by place, else beyond the last."""
    item = F.when(F.col("rn") % 3 == 0, F.concat_ws("-", F.col("rn") + 1, F.col("rn") + 2)).when(F.col("rn") % 3 == 1, (F.col("rn") + 1).cast("string")).otherwise("x")
    beats = lines(spark, sf_dir).select("l_orderkey", (F.col("rn") - 1).alias("idx"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("tick"), item.alias("item"))
    named = beats.select("l_orderkey", "idx", "tick", F.explode(F.transform(F.split("item", "-"), lambda t: F.trim(t).try_cast("long"))).alias("measure")).where("measure IS NOT NULL")
    # Both sources of a measure's time as rows of one table: one shuffle by order and measure.
    known = named.select("l_orderkey", "measure", F.lit(0).alias("why"), "idx", "tick").unionByName(beats.select("l_orderkey", F.col("idx").alias("measure"), F.lit(1).alias("why"), "idx", "tick"))
    ends = beats.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.min_by("tick", "idx").alias("first"), F.max_by("tick", "idx").alias("last"))
    asked = ends.withColumn("measure", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") + 2)))
    best = known.groupBy("l_orderkey", "measure").agg(F.min(F.struct("why", "idx", "tick")).alias("best"))
    tick = F.when(F.col("measure") == 0, F.col("first")).otherwise(F.coalesce("best.tick", F.col("last") + 500))
    return asked.join(best, ["l_orderkey", "measure"], "left").select("l_orderkey", "measure", tick.alias("tick"))


@query(
    "measure_predicates",
    rf"""WITH {TEXT_LINES}, f AS (SELECT doc_id, regexp_replace(line, '"[^"]*"|![^!]*!|[\[\]{{}}]|[0-9]+|[:;]|[ \t\n\x0B\f\r]+|\bO\b', '', 'g') = '' AS m,
NOT regexp_matches(regexp_replace(line, '"[^"]*"|![^!]*!|\[[A-Za-z]:[^\]]*\]|%\{{[^}}]*\}}|\\[A-Za-z]+', '', 'g'), '[A-Ga-g]') AS r FROM l)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (m) AS n_marker_only, count(*) FILTER (r) AS n_rest_only FROM f GROUP BY doc_id""",
)
def measure_predicates(spark, sf_dir):
    own = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.split("text", "\n", -1).alias("x"))
    return own.select("doc_id", F.size("x").cast("long").alias("n_lines"), F.size(F.filter("x", ev.marker_only)).cast("long").alias("n_marker_only"), F.size(F.filter("x", ev.rest_only)).cast("long").alias("n_rest_only"))


@query(
    "cleaned_measures",
    r"""WITH c AS (SELECT doc_id, list_transform(string_split(text, ','), lambda m: replace(regexp_replace(m, '^[ \t:]*(?:[0-9]+[ \t]+)?|[ \t:]+$', '', 'g'), '::', ' ')) AS x FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(x)::BIGINT AS n, sha256(array_to_string(x, '|')) AS cleaned_sha256 FROM c""",
)
def cleaned_measures(spark, sf_dir):
    own = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.transform(F.split("text", ",", -1), ev.clean_measure).alias("x"))
    return own.select("doc_id", F.size("x").cast("long").alias("n"), F.sha2(F.array_join("x", "|"), 256).alias("cleaned_sha256"))


KINDS = {"click": "dynamic", "view": "articulation", "signup": "ornament", "purchase": "range_start", "error": "fermata"}


@query(
    "annotation_events",
    """SELECT event_id, CASE event_type WHEN 'click' THEN CASE WHEN user_id % 2 = 1 THEN 'DL' ELSE 'D' END WHEN 'view' THEN CASE WHEN user_id % 2 = 1 THEN 'AL' ELSE 'A' END WHEN 'signup' THEN CASE WHEN user_id % 2 = 1 THEN 'ORL' ELSE 'OR' END
  WHEN 'purchase' THEN CASE WHEN user_id % 2 = 1 THEN 'RSL' ELSE 'RS' END ELSE 'FM' END || chr(9) || CASE WHEN event_type = 'error' THEN 'NIL' ELSE props END || chr(9) || 'NIL' || chr(9) || 'NIL' AS line FROM events""",
)
def annotation_events(spark, sf_dir):
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("event_type")]
    return table(spark, sf_dir, "events").select("event_id", ev.annotation_line(kind, F.col("props"), F.col("user_id") % 2 == 1).alias("line"))


@query(
    "conversation_structure_errors",
    """WITH c AS (SELECT *, lag(turn) OVER w AS before, lag(role) OVER w AS role_before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
e AS (SELECT conv_id, turn, unnest(list_filter([CASE WHEN turn - coalesce(before, -1) <> 1 THEN 'gap' END, CASE WHEN role = 'system' AND turn > 0 OR role NOT IN ('system', 'user', 'assistant') THEN 'forbidden' END,
  CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' END, CASE WHEN role = role_before THEN 'repeated' END, CASE WHEN before IS NULL AND role = 'assistant' THEN 'no question' END, CASE WHEN role = 'user' AND length(text) < 80 THEN 'short' END], lambda x: x IS NOT NULL)) AS error FROM c)
SELECT * FROM e""",
)
def conversation_structure_errors(spark, sf_dir):
    own = W.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumn("before", F.lag("turn").over(own)).withColumn("role_before", F.lag("role").over(own))
    role = F.col("role")
    errors = F.array(
        F.when(F.col("turn") - F.coalesce("before", F.lit(-1)) != 1, "gap"),
        F.when(((role == "system") & (F.col("turn") > 0)) | ~role.isin("system", "user", "assistant"), "forbidden"),
        F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty"),
        F.when(role == F.col("role_before"), "repeated"),
        F.when(F.col("before").isNull() & (role == "assistant"), "no question"),
        F.when((role == "user") & (F.length("text") < 80), "short"),
    )
    return turns.select("conv_id", "turn", F.explode(F.array_compact(errors)).alias("error"))


@query(
    "structure_json_roundtrip",
    f"WITH {LINES} SELECT l_orderkey, rn::INTEGER AS measure, l_returnflag AS phrase, l_quantity::BIGINT AS n_notes FROM lines",
)
def structure_json_roundtrip(spark, sf_dir):
    """One JSON text per order, whose measures are keyed by number as text, written and read back."""
    measure = F.struct(F.col("rn").cast("string").alias("key"), F.struct(F.col("l_returnflag").alias("phrase"), F.col("l_quantity").cast("long").alias("n_notes")).alias("value"))
    written = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(measure)).alias("measures")).select("l_orderkey", F.to_json(F.struct("measures")).alias("json"))
    read = written.select("l_orderkey", F.explode(F.from_json("json", "measures map<string, struct<phrase: string, n_notes: bigint>>")["measures"]).alias("key", "m"))
    return read.select("l_orderkey", F.col("key").cast("int").alias("measure"), "m.phrase", "m.n_notes")


@query(
    "header_scan",
    f"WITH {TEXT_LINES} SELECT doc_id, arg_min(line, pos) FILTER (starts_with(line, 'The ')) AS first_the, arg_min(line, pos) FILTER (starts_with(line, 'A ')) AS first_a, count(*) FILTER (starts_with(line, 'The ')) AS n_the FROM l GROUP BY doc_id",
)
def header_scan(spark, sf_dir):
    """First line with each prefix; a text is one row, so nothing is shuffled."""
    own = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.split("text", "\n", -1).alias("x"))
    the, a = F.filter("x", lambda line: line.startswith("The ")), F.filter("x", lambda line: line.startswith("A "))
    return own.select("doc_id", F.get(the, F.lit(0)).alias("first_the"), F.get(a, F.lit(0)).alias("first_a"), F.size(the).cast("long").alias("n_the"))


@query(
    "rows_to_measures",
    f"WITH {TEXT_LINES}, m AS (SELECT doc_id, pos, unnest(string_split(line, ',')) AS m, unnest(range(len(string_split(line, ',')))) AS i, len(string_split(line, ',')) AS n FROM l) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, i)::INTEGER AS measure, sha256(m || CASE WHEN i = n - 1 THEN '$' ELSE '' END) AS content_sha256 FROM m",
)
def rows_to_measures(spark, sf_dir):
    """Measures of the rows of a score, numbered through the text; the last of a row carries a mark."""
    cells = F.flatten(F.transform(F.split("text", "\n", -1), lambda line: F.split(F.concat(line, F.lit("$")), ",", -1)))
    own = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(cells).alias("i", "m"))
    return own.select("doc_id", (F.col("i") + 1).alias("measure"), F.sha2("m", 256).alias("content_sha256"))


@query(
    "grouped_report",
    """WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT lang, 0::BIGINT AS place, '## ' || coalesce(lang, '') || ' (' || n || ')' AS line FROM n
UNION ALL SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id), '- ' || doc_id || ': ' || coalesce(source, '') FROM documents""",
)
def grouped_report(spark, sf_dir):
    """Report lines by group: a heading with the group's size, then its rows in order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    heads = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select("lang", F.lit(0).cast("long").alias("place"), F.concat(F.lit("## "), F.coalesce("lang", F.lit("")), F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("line"))
    placed = running_sum(docs.withColumn("lang_key", F.coalesce("lang", F.lit(""))), F.lit(1), ["doc_id"], F.floor(F.col("doc_id") / 10000), ["lang_key"], "before")
    rows = placed.select("lang", (F.col("before") + 1).alias("place"), F.concat(F.lit("- "), F.col("doc_id").cast("string"), F.lit(": "), F.coalesce("source", F.lit(""))).alias("line"))
    return heads.unionByName(rows)
