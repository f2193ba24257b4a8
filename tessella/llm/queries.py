"""Registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import centroids, chat, hilbert, mixing, ngrams, packing, passages, repair, secrets, simhash, syncmers, toxicity, transport
from tessella.llm.common import documents, staged, word_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    """Register a query under its function's name."""
    QUERIES[function.__name__] = function
    return function


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that the mix takes, the first slot that takes some (-1: none), and where in the slot's block they begin."""
    placed, pieces = mixing.mix(documents(spark, sf_dir), word_count(F.col("text")))
    taken = pieces.groupBy("row_key").agg(F.sum("words").cast("long").alias("taken"), F.min(F.struct("slot", "at")).alias("first"))
    return placed.join(taken, "row_key", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), *[F.coalesce(f"first.{c}", F.lit(-1).cast("long")).alias(n) for c, n in (("slot", "slot"), ("at", "slot_offset"))]
    )


ORACLES["op4_mixing"] = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(sha256('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 16) AS k
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS r
  FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE r % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, source_size * 2 AS cap,
         (sum(source_size) OVER () * 1.5)::DOUBLE AS total
  FROM sources),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM weighted),
opened AS (
  SELECT *, cap <= lvl * w AS is_full,
         (SELECT arg_min(lvl, row(cap / w, r)) FROM levels WHERE NOT cap <= lvl * w) AS open_level
  FROM levels),
targets AS (
  SELECT source, r, source_size, CASE WHEN is_full OR open_level IS NULL THEN cap::DOUBLE ELSE open_level * w END AS target
  FROM opened),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.r, s.k,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
-- The schedule: golden-ratio points through the cumulative targets; slot number n of a source takes its block n.
facts AS (
  SELECT *, floor("all" / block * 1.25)::BIGINT + 64 * sources AS slots
  FROM (SELECT sum(target) AS "all", count(*) AS sources, greatest(1, least({mixing.MAX_BLOCK}, floor(sum(target) / ({mixing.SLOTS_PER_SOURCE} * count(*)))))::BIGINT AS block FROM targets)),
intervals AS (
  SELECT r, coalesce(lag(high) OVER (ORDER BY r), 0) AS low, CASE WHEN lead(high) OVER (ORDER BY r) IS NULL THEN 1 ELSE high END AS high
  FROM (SELECT r, sum(target) OVER (ORDER BY r) / sum(target) OVER () AS high FROM targets WHERE target > 0)),
points AS (SELECT t AS slot, ((t + 1) * {mixing.PHI}::DOUBLE) % 1.0::DOUBLE AS u FROM (SELECT unnest(range((SELECT slots FROM facts))) AS t)),
schedule AS (SELECT slot, r, row_number() OVER (PARTITION BY r ORDER BY slot) - 1 AS n FROM points JOIN intervals ON low <= u AND u < high),
mixed AS (
  SELECT doc_id, size, source_size, target, r, place, place // block AS n, place % block AS inside, slots + place // block * sources + r AS behind, size > 0 AND place < floor(target) AS goes
  FROM placed, facts)
SELECT doc_id, size, source_size, target, CASE WHEN goes THEN coalesce(slot, behind)::BIGINT ELSE -1 END AS slot, CASE WHEN goes THEN inside::BIGINT ELSE -1 END AS slot_offset,
       (greatest(0, least(size, floor(target)::BIGINT - place)) + greatest(0, least(size, floor(target)::BIGINT - source_size - place)))::BIGINT AS taken
FROM mixed LEFT JOIN schedule USING (r, n)
"""


@query
def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of equally many rows along a Hilbert curve over length, language and source."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")
    docs = documents(spark, sf_dir).select("doc_id", "lang", "source", size.alias("size"), crc)
    docs = staged(docs, "hilbert-metadata")
    for name, value in (("length_cell", hilbert.fine_length(F.col("size"))), ("lang_cell", F.col("lang")), ("source_cell", F.col("source"))):
        docs = hilbert.add_cell(docs, value, name)
    cells = [F.col("length_cell"), F.col("lang_cell"), F.col("source_cell")]
    sharded = hilbert.hilbert_shards(docs, "doc_id", cells, F.col("size"), 16, "rows", [F.col("text_crc32"), *cells])
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve", "length_cell", "lang_cell", "source_cell"
    )


#: CTEs of the CRC-32 table; ``_crc32`` is the checksum of a text by it.
_CRC_TABLE = """steps AS (
  SELECT i AS byte, i AS v, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT byte, xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM steps WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY byte) AS tab FROM steps WHERE k = 8)"""


def _crc32(text: str) -> str:
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex({text}), '..'), lambda h: ('0x' || h)::BIGINT)),
                         lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"""


def _shards_oracle() -> str:
    """CRC-32 by its table, cells of the three dimensions, the curve turned step by step, runs of the order."""

    def cells(name: str, value: str) -> str:
        return f"""{name}_counts AS (SELECT {value} AS v, count(*) AS n FROM d GROUP BY ALL),
{name}_cells AS (
  SELECT v, CASE WHEN count(*) OVER () <= 32 THEN (row_number() OVER (ORDER BY v ASC NULLS LAST) - 1) * 32 // count(*) OVER ()
                 ELSE (sum(n) OVER (ORDER BY v ASC NULLS LAST) - n)::BIGINT * 32 // (sum(n) OVER ())::BIGINT END::INTEGER AS {name}_cell
  FROM {name}_counts)"""

    index = " + ".join(f"((({axis} >> {bit}) & 1)::BIGINT << {3 * bit + 2 - i})" for bit in range(5) for i, axis in enumerate("abc"))
    # Steps 16, 8, 4 and 2 of the last axis turn the bits below them; 15, 7, 3 and 1 are folded by exclusive or.
    turns = [f"(CASE WHEN c & {q} <> 0 THEN {q - 1} ELSE 0 END)" for q in (16, 8, 4, 2)]
    unwind = f"xor(xor({turns[0]}, {turns[1]}), xor({turns[2]}, {turns[3]}))"
    return rf"""
WITH RECURSIVE {_CRC_TABLE},
d AS (
  SELECT doc_id, lang, source, octet_length(encode(coalesce(text, ''))) + 1 AS size,
         {_crc32("coalesce(text, '')")} AS text_crc32,
         substr(sha256(coalesce(doc_id::VARCHAR, 'null')), 1, 15) AS mixed
  FROM documents, crc_table),
{cells("length", "floor(ln(size) / ln(2) * 16)::INTEGER")},
{cells("lang", "lang")},
{cells("source", "source")},
rows_ AS (
  SELECT d.*, length_cell, lang_cell, source_cell
  FROM d JOIN length_cells l ON floor(ln(d.size) / ln(2) * 16)::INTEGER = l.v
         JOIN lang_cells g ON d.lang IS NOT DISTINCT FROM g.v JOIN source_cells s ON d.source IS NOT DISTINCT FROM s.v),
turned AS (
  SELECT DISTINCT length_cell AS l, lang_cell AS g, source_cell AS s, length_cell AS a, lang_cell AS b, source_cell AS c, 0 AS step FROM rows_
  UNION ALL
  SELECT l, g, s,
         CASE WHEN hit THEN xor(a, low) WHEN axis = 1 THEN xor(a, xor(a, b) & low) WHEN axis = 2 THEN xor(a, xor(a, c) & low) ELSE a END,
         CASE WHEN NOT hit AND axis = 1 THEN xor(b, xor(a, b) & low) ELSE b END,
         CASE WHEN NOT hit AND axis = 2 THEN xor(c, xor(a, c) & low) ELSE c END,
         step + 1
  FROM (SELECT *, step % 3 AS axis, (16 >> (step // 3)) - 1 AS low,
               ((CASE step % 3 WHEN 0 THEN a WHEN 1 THEN b ELSE c END) & (16 >> (step // 3))) <> 0 AS hit FROM turned WHERE step < 12)),
gray AS (SELECT l, g, s, a, xor(a, b) AS b, xor(xor(a, b), c) AS c FROM turned WHERE step = 12),
unwound AS (SELECT l, g, s, xor(a, t) AS a, xor(b, t) AS b, xor(c, t) AS c FROM (SELECT *, {unwind} AS t FROM gray)),
curves AS (SELECT l, g, s, {index} AS curve FROM unwound),
ranked AS (
  SELECT r.*, curve, row_number() OVER (ORDER BY curve, mixed, doc_id NULLS FIRST, size) - 1 AS rank, count(*) OVER () // 16 AS low, count(*) OVER () % 16 AS more
  FROM rows_ r JOIN curves ON (l, g, s) = (length_cell, lang_cell, source_cell)),
sharded AS (
  SELECT *, (CASE WHEN rank < more * (low + 1) THEN rank // (low + 1) ELSE more + (rank - more * (low + 1)) // greatest(low, 1) END)::INTEGER AS shard FROM ranked)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, shard,
       (CASE WHEN shard <= more THEN rank - shard * (low + 1) ELSE rank - more * (low + 1) - (shard - more) * low END)::BIGINT AS slot,
       NULL::INTEGER AS grown_shard, curve, length_cell, lang_cell, source_cell
FROM sharded"""


ORACLES["op9_hilbert_shards"] = _shards_oracle()


@query
def op5_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    pieces = packing.token_pieces(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), cached_words=1_000_000)
    digest = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    packed = packing.harmonic_pack(digest, ["doc_id", "start", "doc_tokens", "ids_crc32"])
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    found = secrets.scan_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] < secrets.BASE)

    def count(kind: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{secrets.RULES[kind].kind}")

    counts = [count(kind) for kind in range(secrets.BASE)]
    return found.select("doc_id", *counts, F.sha2(secrets.span_text(base), 256).alias("base_sha256"), secrets.span_text(F.col("spans")).alias("spans"))


def _secrets_oracle() -> str:
    """Matches and the gaps before them, laid end to end, rule by rule."""
    ctes, parts = [], []
    for i, r in enumerate(secrets.RULES):
        p = r.pattern.replace("'", "''")
        ctes.append(
            f"m{i} AS (SELECT rid, t, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS h, regexp_extract_all(t, '{p}', {r.group}) AS k FROM d WHERE regexp_matches(t, '{p}'))"
        )
        parts.append(
            f"SELECT rid, {i} AS kind, '{r.kind}' AS name, list_sum(list_transform(g[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:j-1], lambda x: length(x))), 0) AS s, length(h[j]) AS n"
            f" FROM (SELECT *, unnest(range(1, len(h) + 1)) AS j FROM m{i}) WHERE length(k[j]) >= {r.least}"
        )
    return (
        "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),\n"
        + ",\n".join(ctes)
        + ",\nspans AS ("
        + "\nUNION ALL ".join(parts)
        + """),
texts AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(name || ':' || s || ':' || (s + n), ',' ORDER BY s, kind) FILTER (kind < 3) AS base,
         string_agg(name || ':' || s || ':' || (s + n), ',' ORDER BY s, kind) AS spans
  FROM (SELECT rid, kind, name, s::BIGINT AS s, n FROM spans) GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN texts USING (rid)"""
    )


ORACLES["op8_secrets"] = _secrets_oracle()


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    near = simhash.near_duplicates(documents(spark, sf_dir))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a model of the labels outside the held-out fifth."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.toxic_passages(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


@query
def op2_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    found = syncmers.fingerprints(documents(spark, sf_dir))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query
def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    own = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], own.schema)
    messages = own.unionByName(probe).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    return chat.digest_chats(chat.format_chats(messages))


def _chat_oracle() -> str:
    """Turns in their order and the length of their formatted form; the escape adds a character to each control string."""
    bodies = chat.CONTROL_BODIES.replace("'", "''")

    def formatted(column: str) -> str:
        return f"length(regexp_replace({column}, '([<\\[])(\\\\*)({bodies})', '\\1\\\\\\2\\3', 'g'))"

    marks = len(chat.TURN + chat.TEXT + chat.END)
    return f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, role IS NULL AS unnamed, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', false, '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', false, '</s>[INST] ok [/INST]')))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, unnamed DESC, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({marks} + {formatted('role')} + {formatted('text')})::BIGINT AS formatted_chars
FROM said GROUP BY conv_id"""


ORACLES["op3_chat"] = _chat_oracle()


@query
def op6_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a transport stream and read back."""
    return transport.digests(transport.read_media(transport.media_column(documents(spark, sf_dir))))


@query
def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document without passages of 35 words that occur twice."""
    left = passages.remove_repeated(documents(spark, sf_dir))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op7_repeated_passages"] = r"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT rid, unnest(ws) AS word, unnest(range(len(ws))) AS p, len(ws) AS n FROM texts),
windows AS (
  SELECT rid, p, n, word,
         CASE WHEN p + 35 <= n THEN sha256(string_agg(word, ' ') OVER (PARTITION BY rid ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) END AS w
  FROM words),
counted AS (SELECT rid, p, word, w IS NOT NULL AND count(*) OVER (PARTITION BY w) > 1 AS recurs FROM windows),
covered AS (
  SELECT rid, p, word, coalesce(max(CASE WHEN recurs THEN p END) OVER (PARTITION BY rid ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL, false) AS gone
  FROM counted),
kept AS (
  SELECT rid, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM covered GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (rid)
"""


@query
def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repair of every conversation after a reproducible damage."""
    messages = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = repair.digest_repairs(repair.repair_conversations(repair.damage(messages))).withColumnRenamed("conv_id", "_of")
    own = messages.select("conv_id").distinct()
    joined = own.join(found, F.col("conv_id").eqNullSafe(F.col("_of")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _repair_oracle() -> str:
    """Dynamic programming over the messages: for each last role put out the least "cost, audit" as one text."""

    def more(entry: str, cost: int, edit: str) -> str:
        return f"lpad((substr({entry}, 1, 6)::INT + {cost})::VARCHAR, 6, '0') || substr({entry}, 7) || '{edit}'"

    def least(*entries: str) -> str:
        return f"list_min([{', '.join(entries)}])"

    # An insertion leads from any role to user or assistant; two lead everywhere.
    user = least("a[3]", more("a[1]", 3, "I"), more("a[2]", 3, "I"), more("a[4]", 3, "I"))
    closed = f"list_transform([list_transform([a], lambda a: [a[1], a[2], {user}, a[4]])[1]], lambda b: [b[1], b[2], b[3], {least('b[4]', more('b[3]', 3, 'I'))}])[1]"

    def step(cut: int) -> str:
        gone = [more(f"a[{q}]", 4, "D") for q in (1, 2, 3, 4)]
        to_user = [more(f"a[{q}]", 3 + cut, "R") for q in (1, 2, 4)]
        stay_user = [f"CASE WHEN m[1] = 'u' THEN {more(f'a[{q}]', cut, 'K')} END" for q in (1, 2, 4)]
        system = least(gone[1], f"CASE WHEN m[1] = 's' THEN {more('a[1]', cut, 'K')} END")
        to_assistant = [more("a[3]", 3 + cut, "R"), f"CASE WHEN m[1] = 'a' THEN {more('a[3]', cut, 'K')} END"]
        return f"[{gone[0]}, {system}, {least(gone[2], *to_user, *stay_user)}, {least(gone[3], *to_assistant)}]"

    moved = f"CASE WHEN m[2] = 'x' THEN [{', '.join(more(f'a[{q}]', 4, 'D') for q in (1, 2, 3, 4))}] WHEN m[2] = 't' THEN {step(3)} ELSE {step(0)} END"
    return rf"""
WITH RECURSIVE {_CRC_TABLE},
hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS n
  FROM hit),
told AS (
  SELECT *, row_number() OVER w AS i,
         CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, n) > 1 THEN 'd'
              WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 't' ELSE 'k' END AS fault,
         lag(substr(role, 1, 1)) OVER w || substr(role, 1, 1) NOT IN ('su', 'ua', 'au') AS illegal
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, n)),
talks AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (illegal) AS illegal,
         list([substr(role, 1, 1), CASE WHEN fault IN ('b', 'd') THEN 'x' ELSE fault END] ORDER BY i) AS codes
  FROM told GROUP BY conv_id),
folded AS (
  SELECT *, list_reduce(list_prepend(['000000', NULL, NULL, NULL], codes), lambda a0, m: list_transform([list_transform([a0], lambda a: {closed})[1]], lambda a: {moved})[1]) AS a1 FROM talks),
best AS (SELECT *, list_min([e[1], e[4]]) AS best FROM (SELECT *, list_transform([a1], lambda a: {closed})[1] AS e FROM folded)),
-- The repaired messages: edits in order, each with the message it takes; an edit's role follows from the one before it.
edits AS (SELECT conv_id, unnest(string_split(substr(best, 7), '')) AS edit, unnest(range(length(best) - 6)) AS step FROM best WHERE length(best) > 6),
taken AS (SELECT *, CASE WHEN edit <> 'I' THEN count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY step) END AS i FROM edits),
put AS (
  SELECT e.conv_id, e.step, e.edit, t.role, t.text, row_number() OVER (PARTITION BY e.conv_id ORDER BY e.step) AS place,
         bool_or(e.edit = 'K' AND substr(t.role, 1, 1) = 's') OVER (PARTITION BY e.conv_id) AS has_system
  FROM taken e LEFT JOIN told t ON e.conv_id IS NOT DISTINCT FROM t.conv_id AND e.i = t.i WHERE e.edit <> 'D'),
hashed AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - has_system::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY step)) AS h
  FROM put GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(substr(best, 1, 6)::BIGINT, 0) AS cost, coalesce(substr(best, 7), '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN best b ON o.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN hashed x ON o.conv_id IS NOT DISTINCT FROM x.conv_id"""


ORACLES["op11_repair"] = _repair_oracle()


@query
def op13_laesa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all usable embeddings around forty centroids after five rounds."""
    found, final = centroids.cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return centroids.digest_clusters(found, final, "vec_id")


def _clusters_oracle() -> str:
    """Every round with all distances."""
    apart = "list_sum(list_transform(list_zip(e.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    rounds = []
    for r in range(centroids.ROUNDS + 1):
        rounds.append(f"a{r} AS MATERIALIZED (SELECT rid, min(row({apart}, c)) AS b FROM kept e, c{r} c GROUP BY rid)")
        if r < centroids.ROUNDS:
            rounds.append(
                f"""s{r} AS (SELECT b[2] AS c, i, sum(v[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT rid, v, unnest(range(1, {centroids.DIMENSIONS + 1})) AS i FROM kept) JOIN a{r} USING (rid) GROUP BY ALL),
m{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{r} o LEFT JOIN m{r} m USING (c))"""
            )
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({centroids.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {centroids.DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {centroids.DIMENSIONS}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{centroids.SEED}:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM kept QUALIFY c < {centroids.CENTROIDS}),
{(','+chr(10)).join(rounds)}
SELECT vec_id, b[2]::INTEGER AS cluster, b[1]::BIGINT AS distance, (sum(b[1]) OVER (PARTITION BY b[2]))::BIGINT AS cluster_inertia, (sum(b[1]) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(f.v, ',')) AS centroid_sha256
FROM a{centroids.ROUNDS} JOIN kept USING (rid) JOIN c{centroids.ROUNDS} f ON f.c = b[2]"""


ORACLES["op13_laesa"] = _clusters_oracle()


@query
def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document under links of 3-word shingles at a Jaccard similarity of 0.9."""
    return ngrams.jaccard_components(documents(spark, sf_dir))


ORACLES["op12_ngram_join"] = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words),
-- Equal sets are one node; nodes meet by their shingles that others have too.
nodes AS MATERIALIZED (SELECT min(doc_id) AS node, list_sort(s) AS s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY ALL),
items AS MATERIALIZED (SELECT node, n, unnest(s) AS g FROM nodes),
common AS MATERIALIZED (SELECT * FROM items QUALIFY count(*) OVER (PARTITION BY g) > 1),
links AS MATERIALIZED (
  SELECT a.node AS x, b.node AS y FROM common a JOIN common b ON a.g = b.g AND a.node < b.node AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
pairs AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x AS node, x AS hit FROM pairs UNION SELECT node, y FROM reach JOIN pairs ON hit = x),
least AS (SELECT node, min(hit) AS component FROM reach GROUP BY node)
SELECT t.doc_id, len(t.s)::BIGINT AS n_shingles, coalesce(l.component, k.node, t.doc_id) AS component_id
FROM sets t LEFT JOIN nodes k ON len(t.s) > 0 AND list_sort(t.s) = k.s LEFT JOIN least l USING (node)"""
