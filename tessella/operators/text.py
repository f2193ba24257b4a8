"""Text operators: words, HTML, Markdown sections, keyword tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Array of the words of a text."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of words; tags in angle brackets count as words of their own elsewhere."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def token_count(text: Column) -> Column:
    """Tags by pattern, plus the words of what is left."""
    return (F.regexp_count(text, F.lit("<[^<> ]+>")) + F.regexp_count(F.regexp_replace(text, "<[^<> ]+>", " "), F.lit(WORD))).cast("long")


def with_value(value: Column, use) -> Column:
    """``use(value)``, with the value computed once and not where it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingles(text: Column, size: int, short: bool = True) -> Column:
    """Distinct shingles of ``size`` lower-cased words; a shorter text is one shingle, or with ``short`` off has none."""

    def cut(own: Column) -> Column:
        enough = F.size(own) >= (1 if short else size)
        starts = F.when(enough, F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(own) - (size - 1))))
        return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(own, i, size), " ")))

    return with_value(words(F.lower(text)), cut)


def html_to_text(html: Column, least: int = 20) -> Column:
    """Visible lines of more than ``least`` characters: scripts and styles go, tags break lines."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    lines = F.split(F.regexp_replace(bare, r"(?s)<[^>]+>", "\n"), "\n", -1)
    tidy = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"[ \t\r]+", " ")))
    return F.array_join(F.filter(tidy, lambda x: F.length(x) > least), "\n")


def numbered_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line: key, pos (0-based), line."""
    return docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))


def sections(lines: DataFrame, key: str, heading: Column, fence: Column) -> DataFrame:
    """Number the sections of each text: a heading outside a fence starts one (0: before the first)."""
    upto = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    fenced = F.sum(fence.cast("int")).over(upto) % 2 == 1
    return lines.withColumn("in_fence", fenced).withColumn("section", F.sum((heading & ~F.col("in_fence")).cast("int")).over(upto))


def keyword_tags(text: Column, table: dict[str, list[str]]) -> Column:
    """Sorted tags of which a keyword occurs in the lower-cased text."""
    low = F.lower(text)
    hits = [F.when(F.exists(F.array(*[F.lit(k) for k in keys]), lambda k: F.contains(low, k)), F.lit(tag)) for tag, keys in sorted(table.items())]
    return F.array_compact(F.array(*hits))
