"""Hierarchical chunks of Markdown: headings by level, blank-line blocks and fences, each split only where it is too large."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.operators.folds import ordered_fold
from tessella.operators.text import WORD, words

#: Headings of up to so many signs part sections, then subsections.
SECTION, SUBSECTION = 2, 3
CLOSING = "```"


def markdown_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of each text with what they are: key, pos, line, n_words, kind, section, subsection, block.

    ``kind``: open, body or close (of a fence), heading, blank or text. A
    heading counts outside fences only. ``section`` and ``subsection`` number
    the parts that headings begin, ``block`` the runs between blank lines, of
    which a fence is one of its own. A fence that never closes runs to the end.
    """
    upto = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    order = W.partitionBy(key).orderBy("pos")
    cut = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("pos", "line"))
    fence = F.startswith(F.ltrim("line"), F.lit(CLOSING))
    inside = F.coalesce(F.sum(fence.cast("int")).over(before), F.lit(0)) % 2 == 1
    kind = (
        F.when(fence & inside, "close").when(fence, "open").when(inside, "body")
        .when(F.rlike("line", F.lit(r"^#{1,6}\s")), "heading").when(~F.rlike("line", F.lit(WORD)), "blank").otherwise("text")
    )
    told = cut.withColumn("kind", kind).withColumn("n_words", F.size(words(F.col("line"))).cast("long"))
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract("line", "^(#+)", 1))).otherwise(9)
    last = F.lag("kind").over(order)
    starts = (F.col("kind") == "open") | ((F.col("kind") == "heading") & (level <= SUBSECTION)) | (F.col("kind").isin("text", "heading") & (last.isNull() | last.isin("blank", "close")))
    told = told.withColumn("_level", level).withColumn("_starts", starts.cast("int"))
    return told.select(
        key, "pos", "line", "n_words", "kind",
        F.sum((F.col("_level") <= SECTION).cast("int")).over(upto).alias("section"),
        F.sum((F.col("_level") <= SUBSECTION).cast("int")).over(upto).alias("subsection"),
        F.sum("_starts").over(upto).alias("block"),
    )


def pack_blocks(budget: int):
    """Fold of lines in order to their chunks (see ``markdown_chunks``)."""

    def fold(rows: Iterator[tuple]) -> Iterable[tuple]:
        chunk, unit, block, spent, large, blanks = -1, None, None, 0, False, []
        for pos, part, own, fits, blk, cost, n, blank, fence, opening, text in rows:
            if blank:
                blanks.append((pos, part, n, opening, fence, text))
                continue
            before = chunk
            if own != unit:
                chunk, unit, block, spent, large = chunk + 1, own, None, 0, False
            if not fits:
                if blk != block:
                    after, large = large, cost > budget
                    if block is not None and (large or after or spent + cost > budget):
                        chunk, spent = chunk + 1, 0
                    block, spent = blk, spent + (n if large else cost)
                elif large:
                    if spent + n > budget - fence:
                        chunk, spent = chunk + 1, 0
                    spent += n
            # Blank lines stay between lines of one chunk.
            if chunk == before:
                for line in blanks:
                    yield chunk, *line
            blanks = []
            yield chunk, pos, part, n, opening, fence, text

    return fold


def markdown_chunks(docs: DataFrame, key: str, text: str, budget: int) -> DataFrame:
    """Chunks of at most ``budget`` words: key, chunk_id, num_tokens, chunk.

    A section (``#``, ``##``) that fits is a chunk. A larger one is parted at
    ``###``; a subsection that fits is a chunk. In a larger one blocks are packed
    in order. A block that is too large alone is split at its lines, a fenced
    one with its fences around each part; a line that is too large is cut into
    runs of words. Blank lines stay only between lines of one chunk.

    Texts are read whole, line by line: a task holds a chunk's lines, not the
    text. Null and blank texts have no chunk; other columns are not read.
    """
    lines = markdown_lines(docs, key, text)
    # Blocks lie in subsections and these in sections, so all sums follow from those of the blocks, without a sort of the lines for each.
    opens = F.max(F.when(F.col("kind") == "open", F.col("line"))).alias("_first")
    blocks = lines.groupBy(F.col(key).alias("_key"), "section", "subsection", F.col("block").alias("_of")).agg(F.sum("n_words").alias("_block"), opens)
    sums = [F.sum("_block").over(W.partitionBy("_key", name)).alias(f"_{name}") for name in ("section", "subsection")]
    sized = lines.join(blocks.select("_key", "_of", "_block", "_first", *sums), F.col(key).eqNullSafe(F.col("_key")) & (F.col("block") == F.col("_of")))
    in_section = F.col("_section") <= budget
    unit = F.when(in_section, F.concat(F.lit("section "), F.col("section").cast("string"))).otherwise(F.concat(F.lit("subsection "), F.col("subsection").cast("string")))
    large = ~in_section & (F.col("_subsection") > budget) & (F.col("_block") > budget)
    opening = F.when(F.col("kind").isin("open", "body", "close") & large, F.col("_first"))
    placed = sized.withColumn("_open", opening).withColumn("_fence", F.when(F.col("_open").isNull(), 0).otherwise(F.size(words(F.col("_open"))) + 1).cast("long"))
    # A split fence is written around each part; a line that no part can hold is cut.
    body = placed.where(F.col("_open").isNull() | (F.col("kind") == "body"))
    room = F.greatest(F.lit(1), F.lit(budget) - F.col("_fence"))
    own = words(F.col("line"))
    runs = F.transform(F.sequence(F.lit(1), F.col("n_words").cast("int"), room.cast("int")), lambda i: F.array_join(F.slice(own, i, room.cast("int")), " "))
    parts = F.when(large & (F.col("n_words") > room), runs).otherwise(F.array("line"))
    pieces = body.select(
        key, "pos", (F.col("kind") == "blank").alias("blank"), unit.alias("unit"), (in_section | (F.col("_subsection") <= budget)).alias("fits"), "block", F.col("_block").alias("cost"),
        F.col("_fence").alias("fence"), F.col("_open").alias("opening"), F.posexplode(parts).alias("part", "piece"),
    )
    flat = pieces.withColumn("n", F.size(words(F.col("piece"))).cast("long"))
    fields = ["pos", "part", "unit", "fits", "block", "cost", "n", "blank", "fence", "opening", "piece"]
    chunked = ordered_fold(flat, [key], ["pos", "part"], fields, "chunk_id int, pos int, part int, n bigint, opening string, fence bigint, piece string", pack_blocks(budget))
    # A chunk holds ``budget`` words at most, so its lines are few.
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part", "piece"))), lambda x: x["piece"]), "\n")
    made = chunked.groupBy(key, "chunk_id").agg(ordered.alias("_body"), F.max("opening").alias("_open"), (F.sum("n") + F.max("fence")).alias("num_tokens"))
    chunk = F.when(F.col("_open").isNull(), F.col("_body")).otherwise(F.concat_ws("\n", "_open", "_body", F.lit(CLOSING)))
    return made.select(key, "chunk_id", "num_tokens", chunk.alias("chunk"))
