"""Queries over documents, pages, conversations, labels and benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.operators import joins, packing, sampling, stats, text
from tessella.operators.ranking import hash_key, hash_ranked
from tessella.operators.staging import staged
from tessella.plans.catalogue import query

#: Phrases that a join may broadcast.
BROADCAST_PHRASES = 1_000_000

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
N_WORDS = "len(" + WORDS.format("coalesce(text, '')") + ")::BIGINT"


def table(spark, sf_dir, name):
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(spark, sf_dir):
    """Documents with their word counts, without the text."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", text.word_count(F.col("text")).alias("tokens"))


def sized_once(spark, sf_dir):
    """``sized``, written once: the texts are scanned a single time however often the sizes are read."""
    return staged(sized(spark, sf_dir), "sized")


SIZED = f"sized AS (SELECT doc_id, lang, source, n_chars, {N_WORDS} AS tokens FROM documents)"


@query(
    "cpt_pack_lines",
    f"""WITH RECURSIVE lines AS (
  SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
items AS (SELECT doc_id, pos, cost, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn
  FROM (SELECT doc_id, pos, len({WORDS.format('line')})::BIGINT AS cost FROM lines) WHERE cost > 0),
walk AS (SELECT doc_id, rn, pos, cost, 0 AS chunk_id, cost AS acc FROM items WHERE rn = 1
  UNION ALL SELECT i.doc_id, i.rn, i.pos, i.cost, CASE WHEN w.acc + i.cost > 256 THEN w.chunk_id + 1 ELSE w.chunk_id END,
    CASE WHEN w.acc + i.cost > 256 THEN i.cost ELSE w.acc + i.cost END FROM walk w JOIN items i ON i.doc_id = w.doc_id AND i.rn = w.rn + 1)
SELECT doc_id, chunk_id, min(pos)::BIGINT AS first_line, max(pos)::BIGINT AS last_line, count(*) AS n_lines, sum(cost)::BIGINT AS num_tokens, sum(cost) > 256 AS is_over_budget
FROM walk GROUP BY doc_id, chunk_id""",
)
def cpt_pack_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    packed = packing.pack_lines(docs, "doc_id", F.col("text"), 256, text.word_count)
    return packed.select("doc_id", "chunk_id", F.col("first").alias("first_line"), F.col("last").alias("last_line"), F.col("items").alias("n_lines"), F.col("tokens").alias("num_tokens"), "is_over_budget")


@query(
    "sft_pack_turns",
    f"""WITH RECURSIVE turns AS (
  SELECT conv_id, turn, role, text, {N_WORDS} AS n, lag({N_WORDS}) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),
items AS (SELECT conv_id, turn, n + coalesce(p, 0) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM turns WHERE role = 'assistant'),
walk AS (SELECT conv_id, rn, turn, cost, 0 AS c, 10 + cost AS acc, 10 + cost > 300 AS big FROM items WHERE rn = 1
  UNION ALL SELECT i.conv_id, i.rn, i.turn, i.cost,
    CASE WHEN w.big OR 10 + i.cost > 300 OR w.acc + i.cost > 300 THEN w.c + 1 ELSE w.c END,
    CASE WHEN w.big OR 10 + i.cost > 300 OR w.acc + i.cost > 300 THEN 10 + i.cost ELSE w.acc + i.cost END, 10 + i.cost > 300
  FROM walk w JOIN items i ON i.conv_id = w.conv_id AND i.rn = w.rn + 1)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY c) - 1)::INTEGER AS sample_id, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n_pairs, max(acc)::BIGINT AS num_tokens
FROM walk WHERE NOT big GROUP BY conv_id, c""",
)
def sft_pack_turns(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("n", text.word_count(F.col("text")))
    pairs = turns.withColumn("cost", F.col("n") + F.coalesce(F.lag("n").over(W.partitionBy("conv_id").orderBy("turn")), F.lit(0))).where("role = 'assistant'")
    packed = packing.greedy_pack(pairs, ["conv_id"], F.col("turn"), F.col("cost"), 300, 10, True)
    return packed.select("conv_id", F.col("chunk_id").alias("sample_id"), F.col("first").alias("first_turn"), F.col("last").alias("last_turn"), F.col("items").alias("n_pairs"), F.col("tokens").alias("num_tokens"))


@query(
    "continuation_pairs",
    "SELECT conv_id, turn, text, next_text FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM conversations) WHERE next_text IS NOT NULL",
)
def continuation_pairs(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.withColumn("next_text", F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("next_text IS NOT NULL").select("conv_id", "turn", "text", "next_text")


@query(
    "context_prev_next_role",
    """SELECT conv_id, turn, role, lag(role) OVER w AS prev_role, lead(role) OVER w AS next_role,
  CASE WHEN row_number() OVER w = 1 THEN 'coldstart' WHEN lead(turn) OVER w IS NULL THEN 'ending' ELSE 'main' END AS position
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
)
def context_prev_next_role(spark, sf_dir):
    w = W.partitionBy("conv_id").orderBy("turn")
    place = F.when(F.row_number().over(w) == 1, "coldstart").when(F.lead("turn").over(w).isNull(), "ending").otherwise("main")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("prev_role"), F.lead("role").over(w).alias("next_role"), place.alias("position"))


@query(
    "context_self_join",
    "SELECT a.conv_id, a.turn, coalesce(length(b.text), 0)::BIGINT AS context_chars FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1",
)
def context_self_join(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    return turns.join(before, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce(F.length("context"), F.lit(0)).cast("long").alias("context_chars"))


@query(
    "chat_render",
    "SELECT conv_id, count(*) AS n_turns, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id",
)
def chat_render(spark, sf_dir):
    message = F.struct("turn", F.concat_ws(": ", "role", F.coalesce("text", F.lit(""))).alias("m"))
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.array_sort(F.collect_list(message)).alias("ms"))
    return grouped.select("conv_id", "n_turns", F.array_join(F.transform("ms", lambda m: m["m"]), "\n").alias("rendered"))


@query(
    "chat_messages_by_task",
    """SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'instruction' WHEN role = 'user' AND turn = 0 THEN 'opening' WHEN role = 'user' THEN 'follow_up' ELSE 'reply' END AS task,
  CASE WHEN role = 'assistant' THEN length(coalesce(text, '')) ELSE 0 END::BIGINT AS loss_chars FROM conversations""",
)
def chat_messages_by_task(spark, sf_dir):
    role = F.col("role")
    task = F.when(role == "system", "instruction").when((role == "user") & (F.col("turn") == 0), "opening").when(role == "user", "follow_up").otherwise("reply")
    loss = F.when(role == "assistant", F.length(F.coalesce("text", F.lit("")))).otherwise(0).cast("long")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", task.alias("task"), loss.alias("loss_chars"))


@query(
    "split_left_join_default",
    "SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN 'train' WHEN l.quality = 1 THEN 'val' ELSE 'test' END AS split FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def split_left_join_default(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.select("doc_id", F.when(F.col("quality").isNull(), "train").when(F.col("quality") == 1, "val").otherwise("test").alias("split"))


@query("semi_labeled_docs", "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_labeled_docs(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(good, "doc_id", "left_semi")


@query("anti_unlabeled_docs", "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_unlabeled_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


GRAM = "SELECT {k}, unnest(list_transform(range(1, greatest(len(w) - 7, 0) + 1), lambda i: array_to_string(w[i:i+7], ' '))) AS gram FROM (SELECT {k}, " + WORDS.format("lower(text)") + " AS w FROM {t})"


@query(
    "decontaminate_benchmark",
    f"WITH b AS (SELECT DISTINCT gram FROM ({GRAM.format(k='item_id', t='benchmark')})), d AS ({GRAM.format(k='doc_id', t='documents')}) SELECT doc_id, count(DISTINCT gram) AS n_hits FROM d JOIN b USING (gram) GROUP BY doc_id",
)
def decontaminate_benchmark(spark, sf_dir):
    """Benchmark phrases of eight words in each document; the phrases themselves are compared."""

    def grams(df, key):
        return df.select(key, F.explode(text.shingles(F.col("text"), 8, short=False)).alias("gram"))

    bench = staged(grams(table(spark, sf_dir, "benchmark"), "item_id").select("gram").distinct(), "benchmark-phrases")
    found = grams(table(spark, sf_dir, "documents"), "doc_id")
    # Counted before it is broadcast; beyond that, phrases meet by their hashes and are compared there.
    if bench.count() <= BROADCAST_PHRASES:
        hits = found.join(F.broadcast(bench), "gram")
    else:
        hits = found.withColumn("h", F.xxhash64("gram")).join(bench.withColumn("h", F.xxhash64("gram")).hint("merge"), ["h", "gram"])
    return hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_hits"))


@query("exact_dedup_first_wins", "SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def exact_dedup_first_wins(spark, sf_dir):
    # Partial minima by text hash before the shuffle: a large group of copies costs a row per task.
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("h"), F.struct("doc_id", "lang", "source").alias("d"))
    return docs.groupBy("h").agg(F.min("d").alias("d")).select("d.*")


@query(
    "near_dup_pairs",
    f"""WITH t AS (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text),
w AS (SELECT doc_id, {WORDS.format('lower(text)')} AS w FROM t),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i+4], ' '))) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT a, b, shared::INTEGER AS shared, shared / (x.n + y.n - shared) AS jaccard FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE shared / (x.n + y.n - shared) >= 0.8""",
)
def near_dup_pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    first = docs.groupBy(F.sha2("text", 256)).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    hashed = F.array_distinct(F.transform(text.shingles(F.col("text"), 5), lambda s: F.xxhash64(s)))
    sets = docs.join(first.hint("merge"), "doc_id", "left_semi").select("doc_id", hashed.alias("items")).where("size(items) > 0")
    # Read three times.
    sets = staged(sets, "shingle-sets")
    return joins.similar_pairs(sets, "doc_id", "items", 0.8)


@query(
    "quality_mask",
    "SELECT d.doc_id, coalesce(l.quality = 1 AND l.toxic = 0 AND d.n_chars >= 200 AND d.lang IN ('en', 'fr'), false) AS keep FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def quality_mask(spark, sf_dir):
    mask = (F.col("quality") == 1) & (F.col("toxic") == 0) & (F.col("n_chars") >= 200) & F.col("lang").isin("en", "fr")
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.select("doc_id", F.coalesce(mask, F.lit(False)).alias("keep"))


@query(
    "token_stats_by_source",
    f"""WITH {SIZED}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY tokens) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM sized)
SELECT source, count(*) AS n_rows, sum(tokens)::BIGINT AS total_tokens, avg(tokens) AS avg_tokens, max(tokens) AS max_tokens, sum((tokens > 512)::INT)::BIGINT AS n_over,
  max(CASE WHEN i = least(n - 1, floor(n * 0.5)) THEN tokens END) AS p50, max(CASE WHEN i = least(n - 1, floor(n * 0.95)) THEN tokens END) AS p95 FROM r GROUP BY source""",
)
def token_stats_by_source(spark, sf_dir):
    return stats.token_stats(sized_once(spark, sf_dir), ["source"], "tokens", 512)


@query(
    "percentile_rules",
    """WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, max(CASE WHEN i = floor(n * 0.9) THEN n_chars END) AS p90_floor, max(CASE WHEN i = least(n - 1, floor(n * 0.9)) THEN n_chars END) AS p90_clamped,
  max(CASE WHEN i = floor(0.9 * (n - 1)) THEN n_chars END) AS p90_inner, max(CASE WHEN i = ceil(0.9 * n) - 1 THEN n_chars END) AS p90_ceil,
  round(quantile_cont(n_chars, 0.9), 6) AS p90_linear FROM r GROUP BY lang""",
)
def percentile_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "n_chars")
    ranks = stats.rank_percentiles(docs, ["lang"], "n_chars", {f"p90_{r}": (r, 0.9) for r in stats.RULES})
    linear = stats.linear_percentile(docs, ["lang"], "n_chars", 0.9, "p90_linear")
    return ranks.join(linear.select("lang", F.round("p90_linear", 6).alias("p90_linear")), "lang")


@query(
    "coverage_estimate",
    f"""WITH {SIZED}, q AS (SELECT lang, quantile_disc(tokens, 0.95) AS p95, quantile_disc(tokens, 0.99) AS p99, avg(tokens) AS mean FROM sized GROUP BY lang)
SELECT lang, p95, p99, CASE WHEN p99 <= 1024 THEN 'over 99%' WHEN p95 <= 1024 THEN '95-99%' ELSE 'under 95%' END AS coverage, round(1 - least(mean, 1024) / 1024, 9) AS padding FROM q""",
)
def coverage_estimate(spark, sf_dir):
    docs = sized_once(spark, sf_dir).select("lang", "tokens")
    ranks = stats.rank_percentiles(docs, ["lang"], "tokens", {"p95": ("ceil", 0.95), "p99": ("ceil", 0.99)})
    q = docs.groupBy("lang").agg(F.avg("tokens").alias("mean")).join(ranks, "lang")
    coverage = F.when(F.col("p99") <= 1024, "over 99%").when(F.col("p95") <= 1024, "95-99%").otherwise("under 95%")
    return q.select("lang", "p95", "p99", coverage.alias("coverage"), F.round(1 - F.least(F.col("mean"), F.lit(1024)) / 1024, 9).alias("padding"))


@query("even_rounds_ntile", "SELECT doc_id, (ntile(5) OVER (ORDER BY sha256('42:' || doc_id)) - 1)::INTEGER AS round FROM documents")
def even_rounds_ntile(spark, sf_dir):
    return sampling.even_rounds(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "42", 5).select("doc_id", "round")


@query(
    "cpt_rounds_mix",
    """WITH d AS (SELECT doc_id AS id, (ntile(3) OVER (ORDER BY sha256('7:' || doc_id)) - 1)::INTEGER AS round FROM documents),
b AS (SELECT item_id AS id, unnest(range(3))::INTEGER AS round FROM benchmark),
u AS (SELECT 'performance' AS kind, * FROM d UNION ALL SELECT 'score', * FROM b)
SELECT kind, id, round, row_number() OVER (PARTITION BY round ORDER BY sha256('mix:' || kind || ':' || id)) - 1 AS position FROM u""",
)
def cpt_rounds_mix(spark, sf_dir):
    parts = sampling.even_rounds(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), "id", "7", 3).select(F.lit("performance").alias("kind"), "id", "round")
    whole = table(spark, sf_dir, "benchmark").select(F.lit("score").alias("kind"), F.col("item_id").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("round"))
    return hash_ranked(parts.unionByName(whole), "mix", "kind", "id", group=["round"]).select("kind", "id", "round", F.col("hash_rank").alias("position"))


@query(
    "val_cap_test_train",
    """WITH s AS (SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN 'train' WHEN l.quality = 1 THEN 'val' ELSE 'test' END AS split FROM documents d LEFT JOIN labels l USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY sha256('43:' || doc_id)) AS rn FROM s)
SELECT split, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM r WHERE split <> 'val' OR rn <= 100 GROUP BY split""",
)
def val_cap_test_train(spark, sf_dir):
    ranked = hash_ranked(split_left_join_default(spark, sf_dir), "43", "doc_id", group=["split"])
    return ranked.where("split <> 'val' OR hash_rank < 100").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query(
    "hash_threshold_sample",
    """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('5:' || doc_id)) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source FROM r WHERE rn <= greatest(1, least(n, floor(n * 0.3 + 0.5)))""",
)
def hash_threshold_sample(spark, sf_dir):
    return sampling.sample_share(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], "doc_id", "5", 0.3).select("doc_id", "source")


@query(
    "ratio_resample",
    """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('6:' || doc_id)) AS rn, count(*) OVER (PARTITION BY lang) AS n,
  CASE lang WHEN 'en' THEN 0.5 WHEN 'fr' THEN 1.25 ELSE 2.75 END AS ratio FROM documents)
SELECT doc_id, lang, unnest(range(1, 1 + (floor(ratio) + (rn <= floor(n * (ratio - floor(ratio)) + 0.5))::INT)::BIGINT))::INTEGER AS copy FROM r""",
)
def ratio_resample(spark, sf_dir):
    ratio = F.when(F.col("lang") == "en", 0.5).when(F.col("lang") == "fr", 1.25).otherwise(2.75)
    return sampling.resample(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], "doc_id", "6", ratio).select("doc_id", "lang", "copy")


@query(
    "round_robin_token_budget",
    f"""WITH RECURSIVE {SIZED}, d AS (SELECT doc_id, source, tokens, row_number() OVER (PARTITION BY source ORDER BY sha256('8:' || doc_id)) - 1 AS depth, sha256('8:' || doc_id) AS h FROM sized),
o AS (SELECT *, row_number() OVER (ORDER BY depth, tokens, h) AS rn FROM d),
w AS (SELECT 0::BIGINT AS rn, 0::BIGINT AS used, false AS ok UNION ALL
  SELECT o.rn, w.used + CASE WHEN w.used + o.tokens <= 100000 THEN o.tokens ELSE 0 END, w.used + o.tokens <= 100000 FROM w JOIN o ON o.rn = w.rn + 1)
SELECT doc_id, source, tokens, depth FROM w JOIN o USING (rn) WHERE ok""",
)
def round_robin_token_budget(spark, sf_dir):
    return sampling.round_robin(sized_once(spark, sf_dir), ["source"], "doc_id", "8", "tokens", 100000).select("doc_id", "source", "tokens", "depth")


@query(
    "round_robin_skip_budget",
    """WITH RECURSIVE o AS (SELECT conv_id, turn, length(coalesce(text, ''))::BIGINT AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY sha256('9:' || conv_id || ':' || turn)) AS rn FROM conversations),
w AS (SELECT conv_id, turn, rn, cost <= 1500 AS ok, 1500 - CASE WHEN cost <= 1500 THEN cost ELSE 0 END AS rest FROM o WHERE rn = 1
  UNION ALL SELECT o.conv_id, o.turn, o.rn, o.cost <= w.rest, w.rest - CASE WHEN o.cost <= w.rest THEN o.cost ELSE 0 END FROM w JOIN o ON o.conv_id = w.conv_id AND o.rn = w.rn + 1)
SELECT conv_id, turn FROM w WHERE ok""",
)
def round_robin_skip_budget(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", hash_key("9", "conv_id", "turn").alias("h"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("cost"))
    return packing.accept_in_order(turns, ["conv_id"], ["h", "turn"], "turn", "cost", 1500)


@query(
    "keep_protected_fill_rest",
    """WITH p AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0 AND quality = 1) AS is_protected FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY is_protected ORDER BY sha256('10:' || doc_id)) AS rn FROM p)
SELECT doc_id, is_protected FROM r WHERE is_protected OR rn <= greatest(0, (SELECT count(*) FROM p) // 2 - (SELECT count(*) FROM p WHERE is_protected))""",
)
def keep_protected_fill_rest(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("toxic = 0 AND quality = 1").select("doc_id", F.lit(True).alias("good"))
    docs = table(spark, sf_dir, "documents").select("doc_id").join(good, "doc_id", "left")
    return sampling.protected_first(docs, F.coalesce("good", F.lit(False)), "doc_id", "10", docs.count() // 2).select("doc_id", "is_protected")


@query(
    "proportional_budget",
    f"""WITH {SIZED}, s AS (SELECT *, floor(50000 * sum(tokens) OVER (PARTITION BY source) / sum(tokens) OVER ()) AS share,
  sum(tokens) OVER (PARTITION BY source ORDER BY sha256('11:' || doc_id) ROWS UNBOUNDED PRECEDING) AS upto FROM sized)
SELECT doc_id, source, tokens, share::BIGINT AS share FROM s WHERE upto <= share""",
)
def proportional_budget(spark, sf_dir):
    return sampling.proportional(sized_once(spark, sf_dir), ["source"], "doc_id", "11", "tokens", 50000).select("doc_id", "source", "tokens", "share")


@query(
    "equal_budget_by_lang",
    """WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), units AS (SELECT lang, n, unnest(range(n)) AS depth FROM n),
o AS (SELECT lang, n, row_number() OVER (ORDER BY depth, lang) AS rn FROM units)
SELECT lang, n, sum((rn <= 500)::INT)::BIGINT AS granted FROM o GROUP BY lang, n""",
)
def equal_budget_by_lang(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return sampling.equal_budgets(counts, "lang", "n", 500)


@query("smallest_n", f"WITH {SIZED} SELECT doc_id, tokens FROM sized ORDER BY tokens, sha256('12:' || doc_id) LIMIT 100")
def smallest_n(spark, sf_dir):
    return sized(spark, sf_dir).withColumn("h", hash_key("12", "doc_id")).orderBy("tokens", "h").limit(100).select("doc_id", "tokens")


@query(
    "jaccard_words",
    f"""WITH d AS (SELECT doc_id, list_distinct({WORDS.format('lower(text)')}) AS w FROM documents), b AS (SELECT item_id, list_distinct({WORDS.format('lower(text)')}) AS w FROM benchmark),
p AS (SELECT doc_id, item_id, len(list_intersect(d.w, b.w)) AS shared, len(d.w) AS nd, len(b.w) AS nb FROM d, b)
SELECT doc_id, arg_min(item_id, row(-shared / (nd + nb - shared), item_id)) AS item_id, round(max(shared / (nd + nb - shared)), 9) AS jaccard FROM p WHERE shared > 0 GROUP BY doc_id""",
)
def jaccard_words(spark, sf_dir):
    def sets(name, key):
        return table(spark, sf_dir, name).select(key, F.array_distinct(text.words(F.lower("text"))).alias("own"))

    best = joins.best_overlap(sets("documents", "doc_id"), "doc_id", sets("benchmark", "item_id"), "item_id", "own")
    return best.select("doc_id", "item_id", F.round("jaccard", 9).alias("jaccard"))


@query(
    "html_to_text",
    r"""WITH t AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?s)<[^>]+>', chr(10), 'g'), chr(10)) AS l FROM pages)
SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, array_to_string(list_filter(list_transform(l, lambda x: trim(regexp_replace(x, '[ \t\r]+', ' ', 'g'))), lambda x: length(x) > 20), chr(10)) AS text FROM t""",
)
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), text.html_to_text(F.col("html")).alias("text"))


@query(
    "mood_tags",
    """SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(lower(text), 'password') OR contains(lower(text), 'secret') THEN 'private' END,
  CASE WHEN contains(lower(text), 'license') OR contains(lower(text), 'copyright') THEN 'legal' END, CASE WHEN contains(lower(text), 'http') THEN 'web' END], lambda x: x IS NOT NULL), ',') AS tags FROM documents""",
)
def mood_tags(spark, sf_dir):
    tags = {"a": ["password", "secret"], "b": ["license", "copyright"], "c": ["http"]}
    names = F.create_map(*[F.lit(x) for x in ("a", "private", "b", "legal", "c", "web")])
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(text.keyword_tags(F.col("text"), tags), lambda t: names[t]), ",").alias("tags"))


@query("source_summary", f"WITH {SIZED} SELECT source, lang, count(*) AS n_rows, sum(tokens)::BIGINT AS tokens, sum(n_chars)::BIGINT AS chars FROM sized GROUP BY ROLLUP (source, lang)")
def source_summary(spark, sf_dir):
    return sized(spark, sf_dir).rollup("source", "lang").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("tokens").alias("tokens"), F.sum("n_chars").alias("chars"))


@query(
    "max_token_filter",
    f"WITH {SIZED} SELECT lang, sum((tokens <= 512)::INT)::BIGINT AS kept, sum((tokens > 512)::INT)::BIGINT AS dropped FROM sized GROUP BY lang",
)
def max_token_filter(spark, sf_dir):
    return sized(spark, sf_dir).groupBy("lang").agg(F.sum((F.col("tokens") <= 512).cast("long")).alias("kept"), F.sum((F.col("tokens") > 512).cast("long")).alias("dropped"))


@query(
    "row_precondition_errors",
    f"""WITH {SIZED} SELECT doc_id, CASE WHEN tokens = 0 THEN 'empty' WHEN tokens < 20 THEN 'too short' WHEN tokens > 4000 THEN 'too long' WHEN lang NOT IN ('en', 'fr', 'de', 'es') THEN 'language' END AS error
FROM sized WHERE tokens < 20 OR tokens > 4000 OR lang NOT IN ('en', 'fr', 'de', 'es')""",
)
def row_precondition_errors(spark, sf_dir):
    t = F.col("tokens")
    error = F.when(t == 0, "empty").when(t < 20, "too short").when(t > 4000, "too long").when(~F.col("lang").isin("en", "fr", "de", "es"), "language")
    return sized(spark, sf_dir).select("doc_id", error.alias("error")).where("error IS NOT NULL")
