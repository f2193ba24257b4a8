"""Queries of the chunkers, boundary segmentation and repetition."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.operators import chunking, markdown
from tessella.plans.catalogue import query
from tessella.plans.corpus import SIZED, WORDS, sized_once, table
from tessella.plans.sequences import EVENTS, HOUR, KEY, ORDER, WIN, events


@query(
    "cascade_chunks",
    f"""WITH RECURSIVE l AS (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
w AS (SELECT doc_id, pos, {WORDS.format('line')} AS w FROM l), u AS (SELECT doc_id, pos, unnest(range(0, len(w), 64)) AS part, w FROM w),
items AS (SELECT doc_id, array_to_string(w[part + 1:part + 64], ' ') AS unit, len(w[part + 1:part + 64])::BIGINT AS cost, row_number() OVER (PARTITION BY doc_id ORDER BY pos, part) AS rn FROM u),
walk AS (SELECT doc_id, rn, unit, cost, 0 AS chunk_id, cost AS acc FROM items WHERE rn = 1
  UNION ALL SELECT i.doc_id, i.rn, i.unit, i.cost, CASE WHEN w.acc + i.cost > 64 THEN w.chunk_id + 1 ELSE w.chunk_id END, CASE WHEN w.acc + i.cost > 64 THEN i.cost ELSE w.acc + i.cost END
  FROM walk w JOIN items i ON i.doc_id = w.doc_id AND i.rn = w.rn + 1)
SELECT doc_id, chunk_id, count(*) AS n_units, sum(cost)::BIGINT AS num_tokens, sha256(string_agg(unit, chr(10) ORDER BY rn)) AS chunk_sha256 FROM walk GROUP BY doc_id, chunk_id""",
)
def cascade_chunks(spark, sf_dir):
    chunks = chunking.chunk_text(table(spark, sf_dir, "documents"), "doc_id", "text", 64)
    return chunks.select("doc_id", "chunk_id", "n_units", "num_tokens", F.sha2("chunk", 256).alias("chunk_sha256"))


@query(
    "adaptive_segments",
    f"""WITH RECURSIVE {EVENTS}, b AS (SELECT user_id, us, event_id, 30 * coalesce((lead(us) OVER ({WIN}) - us > {4 * HOUR})::INT, 1) + 10 * coalesce((lead(event_type) OVER ({WIN}) <> event_type)::INT, 1) + 20 * (event_type = 'purchase')::INT AS score FROM e),
g AS (SELECT user_id, list(score ORDER BY us, event_id) AS s FROM b GROUP BY user_id),
walk AS (SELECT user_id, s, 0::BIGINT AS segment, 0::BIGINT AS start, 0::BIGINT AS n FROM g
  UNION ALL SELECT user_id, s, segment + 1, start + n, CASE WHEN least(9, len(s) - start - n) < 3 THEN len(s) - start - n ELSE
    -(list_reverse_sort(list_transform(range(3, greatest(3, least(9, len(s) - start - n) - 1) + 1), lambda k: {{'s': s[start + n + k] + CASE WHEN k >= least(9, len(s) - start - n) THEN 0 WHEN k = 4 THEN 40 WHEN k = 8 THEN 35 ELSE 0 END, 'n': -k}}))[1]).n END
  FROM walk WHERE start + n < len(s))
SELECT user_id, (segment - 1)::INTEGER AS segment, start, n FROM walk WHERE segment > 0""",
)
def adaptive_segments(spark, sf_dir):
    w = W.partitionBy(*KEY).orderBy(*ORDER)
    far = F.coalesce((F.lead("us").over(w) - F.col("us") > 4 * HOUR).cast("int"), F.lit(1))
    change = F.coalesce((F.lead("event_type").over(w) != F.col("event_type")).cast("int"), F.lit(1))
    scored = events(spark, sf_dir).withColumn("score", 30 * far + 10 * change + 20 * (F.col("event_type") == "purchase").cast("int"))
    return chunking.segment_ordered(scored, KEY, ORDER, "score", 3, 9)


@query(
    "cycle_to_token_target",
    f"""WITH {SIZED}, o AS (SELECT doc_id, tokens, coalesce(sum(tokens) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(tokens) OVER () AS total FROM sized),
c AS (SELECT *, 1000000 // total + (before < 1000000 % total)::INT AS n FROM o)
SELECT doc_id, tokens, unnest(range(n::BIGINT))::INTEGER AS cycle FROM c""",
)
def cycle_to_token_target(spark, sf_dir):
    rows = sized_once(spark, sf_dir).select("doc_id", "tokens")
    return chunking.cycle_to_target(rows, ["doc_id"], F.floor(F.col("doc_id") / 1000), "tokens", 1_000_000)


@query(
    "repeat_plan",
    f"""WITH {SIZED}, t AS (SELECT sum(tokens) AS total FROM sized WHERE lang = 'es'),
r AS (SELECT arg_min(k, row(greatest(300000 - total * k, total * k - 400000, 0), k)) AS repeats FROM t, (SELECT unnest(range(1, 11)) AS k))
SELECT doc_id, unnest(range(1, (SELECT repeats FROM r) + 1))::INTEGER AS copy FROM sized WHERE lang = 'es'""",
)
def repeat_plan(spark, sf_dir):
    rows = sized_once(spark, sf_dir).where("lang = 'es'")
    total = rows.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"]  # one number
    times = chunking.repeat_count(total, range(1, 11), 300_000, 400_000)
    return rows.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("copy"))


#: A document as Markdown: lines become paragraphs, every ninth a section, others subsections, every fourth a fence.
MARKDOWN = """m AS (SELECT doc_id, '# ' || coalesce(source, '') || chr(10) || chr(10) || array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i:
  CASE (i - 1) % 9 WHEN 0 THEN '## Part ' || i || chr(10) || chr(10) WHEN 4 THEN '### Item ' || i || chr(10) WHEN 6 THEN '#### Note' || chr(10) ELSE '' END
  || CASE WHEN i % 4 = 0 THEN '```text' || chr(10) || replace(x, '. ', '.' || chr(10)) || chr(10) || '## no heading' || chr(10) || '```' ELSE x END || chr(10)), chr(10)) AS md FROM documents)"""


def as_markdown(docs):
    """Documents as Markdown texts with headings of four levels and fences."""

    def written(x, i):
        place = i + 1
        number = place.cast("string")
        head = (
            F.when(i % 9 == 0, F.concat(F.lit("## Part "), number, F.lit("\n\n")))
            .when(i % 9 == 4, F.concat(F.lit("### Item "), number, F.lit("\n")))
            .when(i % 9 == 6, F.lit("#### Note\n"))
            .otherwise("")
        )
        fenced = F.concat(F.lit("```text\n"), F.replace(x, F.lit(". "), F.lit(".\n")), F.lit("\n## no heading\n```"))
        return F.concat(head, F.when(place % 4 == 0, fenced).otherwise(x), F.lit("\n"))

    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), written)
    return docs.select("doc_id", F.concat(F.lit("# "), F.coalesce("source", F.lit("")), F.lit("\n\n"), F.array_join(lines, "\n")).alias("md"))


@query(
    "markdown_hierarchy_chunks",
    rf"""WITH RECURSIVE {MARKDOWN}, l AS (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(md, chr(10)) AS x FROM m)),
f AS (SELECT *, ltrim(line) LIKE '```%' AS fence, coalesce(sum((ltrim(line) LIKE '```%')::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM l),
k AS (SELECT *, CASE WHEN fence AND inside THEN 'close' WHEN fence THEN 'open' WHEN inside THEN 'body' WHEN regexp_matches(line, '^#{{1,6}}\s') THEN 'heading' WHEN NOT regexp_matches(line, '[^ 	-
]') THEN 'blank' ELSE 'text' END AS kind, {WORDS.format('line')} AS w FROM f),
v AS (SELECT *, len(w) AS n, CASE WHEN kind = 'heading' THEN length(regexp_extract(line, '^(#+)', 1)) ELSE 9 END AS lv, lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) AS last FROM k),
u AS (SELECT *, sum((lv <= 2)::INT) OVER o AS a, sum((lv <= 3)::INT) OVER o AS b,
  sum((kind = 'open' OR lv <= 3 OR (kind IN ('text', 'heading') AND coalesce(last IN ('blank', 'close'), true)))::INT) OVER o AS blk FROM v WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
z AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, a) AS na, sum(n) OVER (PARTITION BY doc_id, b) AS nb, sum(n) OVER (PARTITION BY doc_id, blk) AS cost, first_value(line) OVER (PARTITION BY doc_id, blk ORDER BY pos) AS head FROM u),
y AS (SELECT *, na <= 64 OR nb <= 64 AS fits, CASE WHEN na <= 64 THEN 'a' || a ELSE 'b' || b END AS unit, NOT (na <= 64 OR nb <= 64) AND cost > 64 AS large FROM z),
q AS (SELECT *, CASE WHEN large AND kind IN ('open', 'body', 'close') THEN head END AS opening, CASE WHEN large AND kind IN ('open', 'body', 'close') THEN len({WORDS.format('head')}) + 1 ELSE 0 END AS fw FROM y),
r AS (SELECT *, unnest(CASE WHEN large AND n > 64 - fw THEN list_transform(range(0, n, 64 - fw), lambda i: array_to_string(w[i + 1:i + 64 - fw], ' ')) ELSE [line] END) AS piece,
  unnest(range(CASE WHEN large AND n > 64 - fw THEN (n + 63 - fw) // (64 - fw) ELSE 1 END)) AS part FROM q WHERE opening IS NULL OR kind = 'body'),
p AS MATERIALIZED (SELECT doc_id, pos, part, kind = 'blank' AS blank, unit, fits, large, blk, cost, fw, opening, piece, len({WORDS.format('piece')})::BIGINT AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pos, part) AS rn FROM r WHERE kind <> 'blank'),
-- Line by line: a new unit, a block that no longer fits, a large block and what follows it, and what no longer fits in a large block begin a chunk.
g AS (
  SELECT doc_id, rn, 0 AS chunk_id, unit, blk, large, CASE WHEN large THEN n ELSE cost END::BIGINT AS spent FROM p WHERE rn = 1
  UNION ALL
  SELECT p.doc_id, p.rn, g.chunk_id + begins::INT, p.unit, p.blk, p.large, CASE WHEN begins THEN 0 ELSE g.spent END + CASE WHEN p.large THEN p.n WHEN p.blk <> g.blk OR p.unit <> g.unit THEN p.cost ELSE 0 END
  FROM g JOIN p ON p.doc_id = g.doc_id AND p.rn = g.rn + 1,
    LATERAL (SELECT p.unit <> g.unit OR (NOT p.fits AND CASE WHEN p.blk <> g.blk THEN p.large OR g.large OR g.spent + p.cost > 64 ELSE p.large AND g.spent + p.n > 64 - p.fw END) AS begins)),
h AS (SELECT doc_id, chunk_id, min(pos) AS low, max(pos) AS high, min(rn) AS first_rn, max(rn) AS last_rn, sum(n) + max(fw) AS num_tokens, max(opening) AS opening FROM g JOIN p USING (doc_id, rn) GROUP BY ALL),
-- A chunk's text: its pieces, and the blank lines between them.
t AS (
  SELECT doc_id, chunk_id, pos, part, piece FROM g JOIN p USING (doc_id, rn) UNION ALL
  SELECT h.doc_id, chunk_id, k.pos, 0, k.line FROM h JOIN k ON k.doc_id = h.doc_id AND k.kind = 'blank' AND k.pos > low AND k.pos < high)
SELECT t.doc_id, t.chunk_id, h.num_tokens::BIGINT AS num_tokens,
  sha256(CASE WHEN any_value(opening) IS NULL THEN regexp_replace(string_agg(piece, chr(10) ORDER BY pos, part), '^
+|[
 ]+$', '', 'g') ELSE any_value(opening) || chr(10) || string_agg(piece, chr(10) ORDER BY pos, part) || chr(10) || '```' END) AS chunk_sha256
FROM t JOIN h USING (doc_id, chunk_id) GROUP BY t.doc_id, t.chunk_id, h.num_tokens""",
)
def markdown_hierarchy_chunks(spark, sf_dir):
    """Documents written as Markdown, chunked by section, subsection, block, line and word."""
    chunks = markdown.markdown_chunks(as_markdown(table(spark, sf_dir, "documents")), "doc_id", "md", 64)
    return chunks.select("doc_id", "chunk_id", "num_tokens", F.sha2("chunk", 256).alias("chunk_sha256"))


@query(
    "markdown_sections",
    rf"""WITH {MARKDOWN}, l AS (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(md, chr(10)) AS x FROM m)),
f AS (SELECT *, ltrim(line) LIKE '```%' AS fence, coalesce(sum((ltrim(line) LIKE '```%')::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM l),
k AS (SELECT *, CASE WHEN NOT fence AND NOT inside AND regexp_matches(line, '^#{{1,6}}\s') THEN length(regexp_extract(line, '^(#+)', 1)) ELSE 9 END AS lv FROM f),
s AS (SELECT *, sum((lv <= 2)::INT) OVER o AS section, sum((lv <= 3)::INT) OVER o AS subsection FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, section::BIGINT AS section, subsection::BIGINT AS subsection, count(*) AS n_lines, count(*) FILTER (fence OR inside) AS n_fenced, sum(len({WORDS.format('line')}))::BIGINT AS n_words FROM s GROUP BY doc_id, section, subsection""",
)
def markdown_sections(spark, sf_dir):
    """Sections and subsections of documents written as Markdown; a heading inside a fence is none."""
    lines = markdown.markdown_lines(as_markdown(table(spark, sf_dir, "documents")), "doc_id", "md")
    fenced = F.col("kind").isin("open", "body", "close")
    return lines.groupBy("doc_id", "section", "subsection").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(fenced).alias("n_fenced"), F.sum("n_words").alias("n_words"))


DAY = 24 * HOUR


@query(
    "event_cascade_chunks",
    f"""WITH RECURSIVE {EVENTS}, r AS (SELECT user_id, us // {5 * DAY} AS p, us // {DAY} AS m, row_number() OVER ({WIN}) - 1 AS pos FROM e WHERE user_id IS NOT NULL),
c AS (SELECT *, count(*) OVER (PARTITION BY user_id, p, m) + 1 AS mc, count(*) OVER (PARTITION BY user_id, p) + (SELECT count(DISTINCT x.m) FROM r x WHERE x.user_id = r.user_id AND x.p = r.p) + 1 AS pc FROM r),
w AS (
  SELECT user_id, -1::BIGINT AS pos, -1 AS chunk, 0::BIGINT AS spent, NULL::BIGINT AS p, NULL::BIGINT AS m, false AS split, false AS cut FROM c WHERE pos = 0
  UNION ALL
  SELECT user_id, pos, chunk + fresh::INT, CASE WHEN pc <= 6 THEN CASE WHEN begins THEN CASE WHEN fresh THEN 0 ELSE spent END + pc ELSE spent END
      WHEN begins OR turns THEN CASE WHEN begins OR fresh THEN 1 ELSE spent END + CASE WHEN mc > 5 THEN 2 ELSE mc END
      WHEN cut THEN CASE WHEN fresh THEN 3 ELSE spent + 1 END ELSE spent END, p, m, pc > 6, CASE WHEN pc <= 6 THEN false ELSE mc > 5 END
  FROM (SELECT c.user_id, c.pos, c.pc, c.mc, c.p, c.m, w.chunk, w.spent, w.cut, w.p IS DISTINCT FROM c.p AS begins, w.m IS DISTINCT FROM c.m AS turns,
      CASE WHEN w.p IS DISTINCT FROM c.p THEN w.chunk < 0 OR c.pc > 6 OR w.split OR w.spent + c.pc > 6
           WHEN c.pc <= 6 THEN false WHEN w.m IS DISTINCT FROM c.m THEN w.spent > 1 AND (c.mc > 5 OR w.spent + c.mc > 6) ELSE w.cut AND w.spent + 1 > 6 END AS fresh
    FROM w JOIN c ON c.user_id = w.user_id AND c.pos = w.pos + 1))
SELECT user_id, chunk AS chunk_id, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n_events, max(spent)::BIGINT AS n_rows FROM w WHERE pos >= 0 GROUP BY user_id, chunk""",
)
def event_cascade_chunks(spark, sf_dir):
    """Events of a user in chunks of six rows: phrases of five days, split at days, split at events, headers repeated."""
    own = events(spark, sf_dir).where("user_id IS NOT NULL").withColumn("phrase", F.expr(f"us div {5 * DAY}")).withColumn("measure", F.expr(f"us div {DAY}"))
    return chunking.cascade_events(own, KEY, ORDER, "phrase", "measure", 6)
