"""Harmonic packing of token sequences.

A document is cut into full sequences and a tail; the tail is cut greedily at
lengths floor(capacity / j), the largest that fits first, down to ``FINE``
tokens. Every piece then belongs to the reciprocal class of its length, whose
bins hold exactly ``capacity // length`` pieces, so a class fills its bins
independently of all others: a piece needs only its rank in the class.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import running_offset, staged

CAPACITY = 2048
FINE = 64
END_ID = 1
#: Words that a Python worker remembers; about 200 bytes each. A job of nothing but tokens can afford more.
CACHED_WORDS = 500_000
END_MARKS = ".,;:!?"
LATIN_END = "\u0250"
#: Python's split() breaks at these, the tokenizer's white space does not.
NOT_SPACE = "\x1c\x1d\x1e\x1f"


def cuts(total: int, capacity: int = CAPACITY, fine: int = FINE) -> Iterator[tuple[int, int]]:
    """Starts and lengths of the pieces of a document of ``total`` tokens."""
    start = 0
    while start < total:
        rest = total - start
        length = capacity if rest >= capacity else rest if rest <= fine else capacity // -(-capacity // rest)
        yield start, length
        start += length


def byte_letters() -> dict[int, str]:
    """Letters that byte-level vocabularies write for bytes: themselves if printable, else 256 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class WordTokenizer:
    """Token ids of whole texts, through a bounded cache of encoded words.

    The tokenizer splits at white space and drops it, so the ids of a text are
    those of its words in order. It also splits letters from the marks that
    follow them and lower-cases, so a word that is not known yet is looked up
    by its lower-cased letters and its end marks before anything is encoded.
    """

    shared: dict[str, WordTokenizer] = {}

    def __init__(self, path: str, most: int = CACHED_WORDS):
        self.most = most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.letters = byte_letters()

    @classmethod
    def of(cls, path: str, most: int = CACHED_WORDS) -> WordTokenizer:
        """The tokenizer of this Python worker, whose cache of ``most`` words serves all its tasks."""
        if path not in cls.shared:
            cls.shared[path] = cls(path)
        cls.shared[path].most = most
        return cls.shared[path]

    @staticmethod
    def parts(word: str) -> tuple[str, str]:
        """Letters and end marks of a word, where they are tokens of their own."""
        if word.isascii() and "<|" not in word:
            word = word.lower()
        core = word.rstrip(END_MARKS)
        # A letter may lower-case to a letter and a combining mark, which the tokenizer takes together with the marks.
        return (core, word[len(core) :]) if core.lower()[-1:].isalpha() else (word, "")

    def fresh(self, parts: list[str]) -> None:
        """Encode parts into the cache: Latin letters are one word of the model, the rest takes the whole way."""
        rest = []
        for part in parts:
            low = part.lower()
            if low.isalpha() and max(low) < LATIN_END:
                word = low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)
                self.known[part] = np.asarray([t.id for t in self.tokenizer.model.tokenize(word)], "<u4").tobytes()
            else:
                rest.append(part)
        for part, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            self.known[part] = np.asarray(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [None if any(c in t for c in NOT_SPACE) else (t.lower() if t.isascii() and "<|" not in t else t).split() for t in texts]
        known = self.known
        words_here = set(chain.from_iterable(words or () for words in split))
        missing = [w for w in words_here if w not in known]
        if len(known) + 2 * len(missing) > self.most:
            # The first half stays: words that came early are frequent ones.
            known = self.known = dict(islice(known.items(), self.most // 2)) if len(missing) < self.most // 8 else {}
            missing = [w for w in words_here if w not in known]
        apart = {w: self.parts(w) for w in missing}
        self.fresh(list({p for pair in apart.values() for p in pair if p and p not in known}))
        known[""] = b""
        for w, (core, marks) in apart.items():
            known[w] = known[core] + known[marks]
        look = known.__getitem__
        return [
            np.asarray(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if words is None else b"".join(map(look, words))
            for t, words in zip(texts, split)
        ]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, cached_words: int = CACHED_WORDS) -> DataFrame:
    """Tokenize ``docs`` (doc_id, text) and cut them: doc_id, start, length, ids, doc_tokens.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit numbers. A
    null or empty text is the end id alone; repeated rows are separate
    documents; texts of any length are read whole, 256 rows at a time.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        words = WordTokenizer.of(tokenizer_path, cached_words)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                row, start, length, ids, tokens = [], [], [], [], []
                for i, blob in enumerate(words.encode([t or "" for t in batch.column(1).to_pylist()])):
                    blob += end
                    for s, n in cuts(len(blob) // 4, capacity):
                        row.append(i)
                        start.append(s)
                        length.append(n)
                        ids.append(blob[4 * s : 4 * (s + n)])
                        tokens.append(len(blob) // 4)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(tokens, pa.int64())],
                    ["doc_id", "start", "length", "ids", "doc_tokens"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long")


def harmonic_pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Assign ``sequence_id`` and ``offset`` to pieces with a ``length`` column.

    The pieces keep all their columns; columns of these two names are replaced,
    names that start with ``_pack`` are taken. ``order`` names columns that rank
    the pieces of a class; rows equal in them are interchangeable. A piece of
    the whole capacity is a sequence of its own (negative ids) and has no rank.
    The pieces of the last, unfilled bin of each class are fewer than
    ``capacity`` per length, so their number has a bound that does not depend on
    the input; one group packs them first-fit decreasing.
    """
    own = staged(pieces.drop("sequence_id", "offset"), "pieces")
    whole = own.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    # Parts of a class that a task ranks alone, so that they stay small whatever a class holds.
    parts = max(64, own.where(F.col("length") < capacity).count() >> 16)
    cut = own.where(F.col("length") < capacity).withColumn("_pack_salt", F.pmod(F.xxhash64(*order), F.lit(parts)))
    ranked = running_offset(cut, ["length"], "_pack_salt", order, F.lit(1), "_pack_rank")
    totals = cut.groupBy("length").agg(F.count(F.lit(1)).alias("_pack_all")).withColumn("_pack_each", F.expr(f"{capacity} div length"))
    ranked = staged(ranked.join(totals, "length").withColumn("_pack_left", F.col("_pack_rank") >= F.expr("_pack_all div _pack_each * _pack_each")), "pieces-ranked")
    full = (
        ranked.where("NOT _pack_left")
        .withColumn("sequence_id", F.shiftleft(F.col("length"), 40) + F.expr("_pack_rank div _pack_each"))
        .withColumn("offset", F.col("_pack_rank") % F.col("_pack_each") * F.col("length"))
    )

    def first_fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "_pack_rank"], ascending=[False, True], kind="stable").reset_index(drop=True)
        free: list[int] = []
        bins, offsets = [], []
        low = 0
        for n in rows["length"]:
            while low < len(free) and free[low] == 0:
                low += 1
            b = next((i for i in range(low, len(free)) if free[i] >= n), len(free))
            if b == len(free):
                free.append(capacity)
            bins.append(b)
            offsets.append(capacity - free[b])
            free[b] -= n
        return rows.assign(sequence_id=np.asarray(bins, "int64"), offset=np.asarray(offsets, "int64"))

    rest = ranked.where("_pack_left")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema] + ["sequence_id long", "offset long"])
    tail = rest.groupBy(F.lit("left").alias("_pack_group")).applyInPandas(first_fit, schema)
    names = [*own.columns, "sequence_id", "offset"]
    return full.select(names).unionByName(tail.select(names)).unionByName(whole.select(names))


def padded_length(filled, capacity: int = CAPACITY):
    """Length of a sequence after padding: its own at a power of two, else the capacity."""
    return F.when(F.bit_count(filled) == 1, filled).otherwise(F.lit(capacity))
