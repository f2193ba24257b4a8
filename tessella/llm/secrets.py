"""Secret scans through a trigram inverted index (DataFrame functions only).

Each rule's regular expression yields a Boolean query over trigrams that every
match must contain. An inverted index lists the rows of every such trigram, the
posting lists are intersected into candidate rows per rule, and only candidates
are verified with the expression itself. A rule without mandatory trigrams scans
everything.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import staged

try:
    from re import _constants as sre
    from re import _parser as sre_parser
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse as sre_parser


@dataclass(frozen=True)
class Rule:
    """A secret pattern; ``least`` is the least length of group ``group`` of a match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The three base rules, then public token formats.
RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abps]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = 3
MOST = 64
#: Rows of a block of the index, and candidates (about 24 bytes each) that may be broadcast.
BLOCK_ROWS = 4096
BROADCAST_ROWS = 1_000_000


def _spellings(item) -> set[str] | None:
    """All lower-cased strings that a parsed item matches, if they are few."""
    op, arg = item
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        if any(o is not sre.LITERAL for o, _ in arg) or len(arg) > 8:
            return None
        return {chr(c).lower() for _, c in arg}
    if op is sre.SUBPATTERN:
        return _joined(arg[-1])
    if op is sre.BRANCH:
        parts = [_joined(b) for b in arg[1]]
        return None if None in parts else set().union(*parts)
    if op is sre.MAX_REPEAT and arg[1] <= 2:
        one = _joined(arg[2])
        return None if one is None else {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(one, repeat=n)}
    return None


def _joined(items) -> set[str] | None:
    found = {""}
    for item in items:
        more = _spellings(item)
        if more is None or len(found) * len(more) > MOST:
            return None
        found = {a + b for a in found for b in more}
    return found


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Boolean query of a pattern: all clauses hold; of a clause, one set of trigrams is there whole."""
    clauses, run = [], {""}

    def close():
        if run and min(map(len, run)) >= 3:
            clauses.append(sorted({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}, key=sorted))

    for item in sre_parser.parse(pattern):
        more = _spellings(item)
        if more is None or len(run) * len(more) > MOST:
            close()
            run = more if more is not None else {""}
        else:
            run = {a + b for a in run for b in more}
    close()
    return clauses


def row_key() -> Column:
    """64-bit key of a row's doc_id and text. Rows that share it share their candidate rules, which are verified."""
    return F.xxhash64("doc_id", "text")


def inverted_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Posting lists of ``docs`` (doc_id, text): block, trigram, rows (array of row keys).

    A block holds about ``BLOCK_ROWS`` rows by their key, so no list grows with
    the table. Trigrams are of lower-cased text; null texts are in no list.
    """
    blocks = -(-docs.count() // BLOCK_ROWS) or 1
    low = docs.select(row_key().alias("key"), F.lower("text").alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in trigrams]))
    postings = low.select("key", F.explode(found).alias("trigram")).withColumn("block", F.pmod("key", F.lit(blocks)))
    return postings.repartition("block").groupBy("block", "trigram").agg(F.collect_set("key").alias("rows"))


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """Rows that satisfy a rule's Boolean query: key, rules (indices).

    The lists of an option's trigrams are intersected, the options of a clause
    united, the clauses of a rule intersected, block by block.
    """
    queries = [(i, q) for i, rule in enumerate(rules) if (q := trigram_query(rule.pattern))]
    none = F.expr("cast(array() as array<bigint>)")

    def array(items) -> Column:
        return F.lit(items) if isinstance(items, str) else F.array(*[array(i) for i in items])

    asked = F.array(*[F.struct(F.lit(i).alias("rule"), array([[sorted(o) for o in clause] for clause in q]).alias("clauses")) for i, q in queries])
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "rows"))).alias("lists"))

    def posting(trigram: Column) -> Column:
        return F.coalesce(F.element_at("lists", trigram), none)

    def of_option(option: Column) -> Column:
        return F.aggregate(option, posting(F.element_at(option, 1)), lambda held, trigram: F.array_intersect(held, posting(trigram)))

    def of_clause(clause: Column) -> Column:
        return F.aggregate(clause, none, lambda held, option: F.array_union(held, of_option(option)))

    def of_rule(clauses: Column) -> Column:
        return F.aggregate(clauses, of_clause(F.element_at(clauses, 1)), lambda held, clause: F.array_intersect(held, of_clause(clause)))

    hits = F.transform(asked, lambda query: F.struct(query["rule"].alias("rule"), of_rule(query["clauses"]).alias("keys")))
    each = lists.select(F.explode(hits).alias("hit")).select("hit.rule", F.explode("hit.keys").alias("key"))
    return each.groupBy("key").agg(F.collect_set("rule").alias("rules"))


def rule_spans(text: Column, rule: Rule, place: int) -> Column:
    """Spans of a rule in a text: array of (start, kind, end), code points.

    The gaps before the matches and the matches themselves, laid end to end,
    give the positions.
    """
    gaps = F.split(text, rule.pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    steps = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), kept.alias("kept"))
    empty = F.expr("cast(array() as array<struct<start: int, kind: int, end: int>>)")
    found = F.aggregate(
        F.filter(steps, lambda s: s["hit"].isNotNull()),
        F.struct(F.lit(0).alias("at"), empty.alias("spans")),
        lambda a, s: F.struct(
            (a["at"] + F.length(s["gap"]) + F.length(s["hit"])).alias("at"),
            F.when(
                F.length(s["kept"]) >= rule.least,
                F.array_append(
                    a["spans"],
                    F.struct(
                        (a["at"] + F.length(s["gap"])).alias("start"),
                        F.lit(place).alias("kind"),
                        (a["at"] + F.length(s["gap"]) + F.length(s["hit"])).alias("end"),
                    ),
                ),
            )
            .otherwise(a["spans"])
            .alias("spans"),
        ),
    )["spans"]
    return F.when(F.rlike(text, F.lit(rule.pattern)), found).otherwise(empty)


def scan_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """Add ``spans``: array of (start, kind, end) by start, then rule order.

    ``kind`` is the index of the rule; ends are exclusive; positions are code
    points. A null text has no span, nor has an empty one. All rows stay,
    repeated rows too, with all their columns but an older ``spans``, which the
    new one replaces; an empty table gives no row; texts are read whole.

    Only row keys are shuffled for the index. Its candidates meet the rows by a
    broadcast if they are at most ``BROADCAST_ROWS``, else by a join on the key.
    """
    indexed = {i for i, r in enumerate(rules) if trigram_query(r.pattern)}
    trigrams = sorted({t for r in rules for clause in trigram_query(r.pattern) for option in clause for t in option})
    found = candidates(inverted_index(docs.select("doc_id", "text"), trigrams), rules) if trigrams else None
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "spans"]).alias("row")
    flagged = docs.select(row, row_key().alias("key"))
    if found is None:
        flagged = flagged.withColumn("rules", F.array(F.lit(-1)))
    else:
        found = staged(found, "secret-candidates")
        few = found.count() <= BROADCAST_ROWS
        flagged = flagged.join(F.broadcast(found) if few else found, "key", "left")
    text = F.coalesce(F.col("row.text"), F.lit(""))
    nothing = F.expr("cast(array() as array<struct<start: int, kind: int, end: int>>)")
    each = [
        F.when(F.array_contains("rules", i), rule_spans(text, r, i)).otherwise(nothing) if i in indexed else rule_spans(text, r, i)
        for i, r in enumerate(rules)
    ]
    return flagged.select("row", F.array_sort(F.concat(*each)).alias("spans")).select("row.*", "spans")


def span_text(spans: Column, rules=RULES) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span replaced by ``mask``; overlapping spans share one."""
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mask))).otherwise(a["out"]).alias("out"),
        ),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


