"""Whole jobs: cached token counts, budgeted subsets, span corpora and instruction sets, written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.operators import sampling, text, token_cache
from tessella.operators.folds import longest_spans, ordered_fold
from tessella.operators.ranking import hash_key
from tessella.operators.staging import shared_folder, staged
from tessella.plans.catalogue import query
from tessella.plans.corpus import N_WORDS, SIZED, WORDS, table
from tessella.plans.selection import PROTECTED, protected_sizes, walk
from tessella.sources import readers


def folder(spark, name):
    """A new folder of this name in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def read_back(df, path, keys):
    """Write ``df`` partitioned by ``keys`` as JSON lines and read it with its own schema."""
    readers.write_partitioned(df, path, keys)
    return df.sparkSession.read.schema(df.schema).json(path).select(*df.columns)


@query(
    "token_cache_refresh",
    f"""WITH e AS (SELECT doc_id, CASE WHEN lang = 'en' THEN coalesce(text, '') || ' and more' ELSE coalesce(text, '') END AS text, coalesce(text, '') AS before FROM documents)
SELECT doc_id, sha256(text) AS fingerprint, {N_WORDS} AS tokens, sha256(text) IN (SELECT sha256(before) FROM e) AS was_cached FROM e""",
)
def token_cache_refresh(spark, sf_dir):
    """Token counts of documents of which some changed: those that did not come from the cache, the others are counted and added."""
    path = folder(spark, "token-cache")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    token_cache.refresh(docs, "text", path, text.word_count)
    first = staged(token_cache.read_cache(spark, path).select("fingerprint", F.lit(True).alias("was_cached")), "token-cache-before")
    changed = docs.select("doc_id", F.when(F.col("lang") == "en", F.concat(F.coalesce("text", F.lit("")), F.lit(" and more"))).otherwise(F.coalesce("text", F.lit(""))).alias("text"))
    token_cache.refresh(changed, "text", path, text.word_count)
    told = token_cache.with_tokens(changed, "text", path).join(first, "fingerprint", "left")
    return told.select("doc_id", "fingerprint", "tokens", F.coalesce("was_cached", F.lit(False)).alias("was_cached"))


#: Shares of all tokens of the subsets, in percent.
SETTINGS = {"s20": 20, "s50": 50}


def _subsets_oracle() -> str:
    parts, rows = [], []
    for name, percent in SETTINGS.items():
        target = f"(SELECT {percent} * sum(tokens)::BIGINT // 100 FROM p)"
        parts.append(
            f"""o{name} AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY depth, sha256('{name}:' || depth || ':' || source)) AS rn FROM r{name} WHERE depth > 0),
{walk(f'o{name}', '(SELECT coalesce(sum(tokens), 0)::BIGINT FROM (SELECT tokens FROM p WHERE is_protected UNION ALL SELECT tokens FROM r' + name + ' WHERE depth = 0))', f'w.used < {target} AND (w.used + o.tokens <= {target} OR w.used < {target} * 0.995)').replace('w AS', f'w{name} AS').replace('FROM w JOIN', f'FROM w{name} w JOIN')}"""
        )
        parts.insert(-1, f"r{name} AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY tokens, sha256('{name}:' || doc_id)) - 1 AS depth FROM p WHERE NOT is_protected)")
        rows.append(
            f"SELECT '{name}' AS setting, doc_id, tokens, 'protected' AS why FROM p WHERE is_protected UNION ALL SELECT '{name}', doc_id, tokens, 'first' FROM r{name} WHERE depth = 0 UNION ALL SELECT '{name}', doc_id, tokens, 'drawn' FROM w{name} JOIN o{name} USING (rn) WHERE ok"
        )
    return f"WITH RECURSIVE {SIZED}, {PROTECTED}, " + ",\n".join(parts) + "\n" + " UNION ALL ".join(rows)


@query("token_budget_subsets", _subsets_oracle())
def token_budget_subsets(spark, sf_dir):
    """Subsets of 20 and 50 percent of all tokens: protected documents, one of each source, rounds of the smallest; written by setting."""
    docs = protected_sizes(spark, sf_dir)
    total = docs.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"]  # one number
    chosen = None
    for name, percent in SETTINGS.items():
        one = sampling.smallest_round_robin(docs, F.col("is_protected"), "source", "doc_id", name, "tokens", percent * total // 100, 0.995)
        one = one.select(F.lit(name).alias("setting"), "doc_id", "tokens", "why")
        chosen = one if chosen is None else chosen.unionByName(one)
    return read_back(chosen, folder(spark, "subsets"), ["setting"])


@query(
    "span_corpus",
    f"""WITH c AS (SELECT conv_id, turn, row_number() OVER w AS rn, {N_WORDS} AS cost, sum({N_WORDS}) OVER w AS upto FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT a.conv_id, a.turn AS first_turn, max(b.turn) AS last_turn, max(b.upto - a.upto + a.cost)::BIGINT AS n_words, count(*) AS n_turns
  FROM c a JOIN c b ON b.conv_id = a.conv_id AND b.rn >= a.rn AND (b.rn = a.rn OR b.upto - a.upto + a.cost <= 120) GROUP BY ALL)
SELECT *, CASE WHEN n_turns > 1 THEN 'dialog' ELSE 'single' END AS variant, CASE WHEN substr(sha256('span:' || conv_id), 1, 1) < '2' THEN 'val' ELSE 'train' END AS split FROM s""",
)
def span_corpus(spark, sf_dir):
    """From each turn the longest span of at most 120 words, by variant and by a split of conversations; written by both."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.word_count(F.col("text")).alias("cost"))
    spans = ordered_fold(turns, ["conv_id"], ["turn"], ["turn", "cost"], "first_turn bigint, last_turn bigint, n_words bigint", longest_spans(120))
    # Turns of a span, from the places of its ends.
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).cast("long")
    placed = turns.select("conv_id", "turn", place.alias("place"))
    ends = spans.join(placed.toDF("conv_id", "first_turn", "_a"), ["conv_id", "first_turn"]).join(placed.toDF("conv_id", "last_turn", "_z"), ["conv_id", "last_turn"])
    n = F.col("_z") - F.col("_a") + 1
    split = F.when(F.substring(hash_key("span", "conv_id"), 1, 1) < "2", "val").otherwise("train")
    rows = ends.select("conv_id", "first_turn", "last_turn", "n_words", n.alias("n_turns"), F.when(n > 1, "dialog").otherwise("single").alias("variant"), split.alias("split"))
    return read_back(rows, folder(spark, "spans"), ["variant", "split"])


@query(
    "instruction_sets",
    f"""WITH t AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS following FROM conversations),
c AS (SELECT conv_id, turn, len({WORDS.format("coalesce(text, '')")}) + len({WORDS.format('following')}) AS tokens FROM t WHERE following IS NOT NULL),
k AS (SELECT conv_id, turn, tokens::BIGINT AS tokens FROM c WHERE tokens <= 100),
m AS (SELECT conv_id, turn, {N_WORDS} AS tokens, regexp_replace(coalesce(text, ''), '[A-Z][a-z]+', '<MASK>', 'g') AS masked FROM conversations),
r AS (SELECT conv_id, turn, tokens, row_number() OVER (ORDER BY tokens, sha256('mask:' || conv_id || ':' || turn)) AS rn FROM m WHERE tokens <= 100 AND contains(masked, '<MASK>'))
SELECT 'continuation' AS task, conv_id, turn, tokens FROM k UNION ALL SELECT 'mask', conv_id, turn, tokens FROM r WHERE rn <= (SELECT count(*) FROM k) // 2""",
)
def instruction_sets(spark, sf_dir):
    """Continuations of at most 100 words, and half as many masked turns, the smallest; written by task."""
    turns = table(spark, sf_dir, "conversations")
    following = F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))
    pairs = turns.select("conv_id", "turn", text.word_count(F.col("text")).alias("_own"), following.alias("_next")).where("_next IS NOT NULL")
    kept = pairs.select("conv_id", "turn", (F.col("_own") + text.word_count(F.col("_next"))).alias("tokens")).where("tokens <= 100")
    kept = staged(kept, "continuations")
    masked = F.regexp_replace(F.coalesce("text", F.lit("")), "[A-Z][a-z]+", "<MASK>")
    rows = turns.select("conv_id", "turn", text.word_count(F.col("text")).alias("tokens"), masked.alias("_masked")).where("tokens <= 100 AND contains(_masked, '<MASK>')")
    tied = staged(rows.select("conv_id", "turn", "tokens", hash_key("mask", "conv_id", "turn").alias("tie")), "masked")
    ranked = sampling.by_depth(tied, [], ["tokens", "tie"], F.col("tokens") * 256 + F.conv(F.substring("tie", 1, 2), 16, 10).cast("long"))
    wanted = kept.count() // 2  # one number
    chosen = ranked.where(F.col("depth") < wanted).select(F.lit("mask").alias("task"), "conv_id", "turn", "tokens")
    both = kept.select(F.lit("continuation").alias("task"), "conv_id", "turn", "tokens").unionByName(chosen)
    return read_back(both, folder(spark, "instructions"), ["task"])


@query(
    "line_sink_roundtrip",
    "SELECT sha256(line) AS line_sha256, length(line)::BIGINT AS n_chars, count(*) AS n FROM (SELECT doc_id || chr(9) || replace(coalesce(text, ''), chr(10), ' ') AS line FROM documents WHERE lang = 'en') GROUP BY 1, 2",
)
def line_sink_roundtrip(spark, sf_dir):
    """Lines of a file that a filter keeps, written unchanged in their order and read back."""
    line = F.concat_ws("\t", F.col("doc_id").cast("string"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")))
    kept = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", line.alias("line"))
    path = folder(spark, "lines")
    readers.write_lines(kept, "line", ["doc_id"], path)
    back = spark.read.option("lineSep", "\n").text(path)
    return back.groupBy(F.sha2("value", 256).alias("line_sha256"), F.length("value").cast("long").alias("n_chars")).agg(F.count(F.lit(1)).alias("n"))


@query("file_inventory")
def file_inventory(spark, sf_dir):
    """Parquet files of the data directory by table, from the listing alone: files and bytes."""
    # A table is a file or a folder of part files of its name.
    found = readers.discover(spark, sf_dir, "*.parquet")
    name = F.coalesce(F.nullif(F.regexp_extract("path", r"/([^/]+)\.parquet/", 1), F.lit("")), F.col("stem"))
    return readers.inventory(found, [name.alias("table")])
