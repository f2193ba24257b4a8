"""Corpus pipeline: toxicity, near-duplicates, secrets, mixing and packing, stage by stage.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet to the
shared folder and reread as the next stage's documents.

In every stage but the last: only the columns of documents are read and
returned, so others cannot clash; a null text counts as empty; empty texts,
texts of any length and null keys are ordinary rows; an empty table gives an
empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.llm import mixing, packing, secrets, simhash, toxicity
from tessella.llm.common import WORD, documents, staged, word_count
from tessella.llm.components import components

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words that a worker remembers for the packing: it keeps them while it serves the other stages.
CACHED_WORDS = 100_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not predict toxic.

    The model learns from the labels outside the held-out fifth. A verdict
    belongs to a text, so repeated rows share it: all stay or all go.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out(F.col("doc_id")))
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id, then text hash.

    Texts are linked as ``op1_simhash`` links them, by the pigeonhole over their
    fingerprints; the exact similarity of their shingles follows and adds the
    links that fingerprints miss. A repeated row is a copy: one stays. Texts
    without words are one group.
    """
    keyed = docs.select(*COLUMNS, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("did"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    prints = simhash.near_duplicates(keyed.select(F.col("th").alias("doc_id"), "text")).select(F.col("doc_id").alias("th"), F.col("component_id").alias("print")).distinct()
    groups = staged(simhash.similar_documents(docs).join(prints, "th"), "similar")
    # Groups of similar sets that fingerprints link: few edges, as most of what they link is in one group.
    least = groups.groupBy("print").agg(F.min("component").alias("a"), F.max("component").alias("z")).where("a < z").select("print", "a")
    found = components(groups.join(least, "print").select("a", F.col("component").alias("b")).distinct()).withColumnRenamed("component", "all")
    joined = groups.join(found, F.col("component") == F.col("node"), "left").withColumn("component", F.coalesce("all", "component"))
    kept = joined.groupBy("component").agg(F.min(F.struct("did", "th")).alias("k")).select("k.did", "k.th")
    once = W.partitionBy("did", "th").orderBy("lang", "source", "n_chars")
    return keyed.join(kept, ["did", "th"], "left_semi").withColumn("_n", F.row_number().over(once)).where("_n = 1").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their secrets masked; n_chars follows the new text, where one was masked.

    Repeated rows repeat; a null text stays null.
    """
    found = secrets.scan_secrets(docs.select(*COLUMNS))
    masked = F.when(F.size("spans") > 0, secrets.redact(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return found.select("doc_id", masked.alias("text"), "lang", "source", F.when(F.size("spans") > 0, F.length(masked).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document for each pass that takes it, whole or the words that the quota leaves it, in the order of the schedule.

    The files hold the documents by the slot that takes their first word and
    their place in its block. A document without words takes no tokens of the
    mix, stays as it is and follows at the end. A repeated row is a document of
    its own.
    """
    keyed = docs.select(*COLUMNS)
    placed, pieces = mixing.mix(keyed, word_count(F.col("text")))
    turns = pieces.groupBy("row_key", "pass").agg(F.sum("words").cast("long").alias("taken"), F.min(F.struct("slot", "at")).alias("first"))
    taken = placed.select("row_key", "doc_id", "source", "size").join(turns, "row_key")
    # Rows that share doc_id, source and size take their turns by rank, so that a repeated row is not multiplied.
    same = W.partitionBy("doc_id", "source", "size")
    ranks = taken.select("doc_id", "source", "size", "row_key", "pass", "taken", "first", F.dense_rank().over(same.orderBy("row_key")).alias("nth"))
    sized = keyed.withColumn("size", word_count(F.col("text"))).withColumn("nth", F.row_number().over(same.orderBy("text")))
    on = [F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("doc_id", "source")] + [F.col(f"d.{c}") == F.col(f"t.{c}") for c in ("size", "nth")]
    joined = sized.alias("d").join(ranks.alias("t"), on, "left").where("d.size = 0 OR t.taken IS NOT NULL")
    part = F.array_join(F.slice(F.regexp_extract_all(F.col("d.text"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("t.taken").cast("int")), " ")
    whole = F.col("t.taken").isNull() | (F.col("t.taken") == F.col("d.size"))
    mixed = joined.select(
        F.col("d.doc_id"),
        F.when(whole, F.col("d.text")).otherwise(part).alias("text"),
        F.col("d.lang"),
        F.col("d.source"),
        F.when(whole, F.col("d.n_chars")).otherwise(F.length(part).cast("long")).alias("n_chars"),
        F.col("t.first.slot").alias("_slot"),
        F.col("t.first.at").alias("_at"),
    )
    return mixed.orderBy(F.col("_slot").asc_nulls_last(), "_at", "doc_id").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix in sequences of at most 2048 tokens.

    A null or empty text is the end id alone; a repeated row is packed again.
    """
    import public_tokenizers

    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), cached_words=CACHED_WORDS)
    digest = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    packed = packing.harmonic_pack(digest, ["doc_id", "start", "doc_tokens", "ids_crc32"])
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The trained model and the near-duplicate search have no SQL form; a brute-force test stands in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
