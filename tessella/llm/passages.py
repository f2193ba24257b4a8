"""Substring deduplication by repeated-phrase automata.

Two equal windows of ``WINDOW`` words share the smallest hash among their
``GRAM``-word phrases. Runs of windows with one smallest hash (its anchor) are
the unit of the search: runs whose anchor recurs are sent, with their text, to
the shard of that anchor. A shard confirms there, word by word, which windows
recur, joins each once to the passages of its first run, compiles an
Aho-Corasick automaton of the passages and streams the runs of all documents
through it. The automaton alone tells where passages occur.

Equal rows within a block of a task are merged before every shuffle, so what a
frequent phrase sends grows with the blocks, not with its occurrences. Anchors
that still have very many runs are split by their windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import discard, staged

WINDOW = 35
GRAM = 8
#: Longest run of windows; longer ones (periodic text) are cut.
RUN = 64
BASE = np.uint64(0x9E3779B97F4A7C15)
CACHED_WORDS = 400_000
#: Rows that a task merges at a time, and runs that a shard compiles at a time.
BLOCK_ROWS = 300_000
BATCH_RUNS = 10_000
#: An anchor is split by windows beyond this many runs, so a shard's memory has a bound.
HOT_RUNS = 16_384
SLICE = 256


class Phrases:
    """Hashes of phrases, through a bounded cache of word hashes."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes], gram: int = GRAM) -> np.ndarray:
        """64-bit hashes of all ``gram``-word phrases of ``words``."""
        import xxhash

        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        hashed = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = len(words) - gram + 1
        out = hashed[:n].copy()
        for j in range(1, gram):
            out *= BASE
            out += hashed[j : j + n]
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return out ^ (out >> np.uint64(32))


def runs(words: list[bytes], phrases: Phrases, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, first and last window of the runs of a document, and whether a run holds its anchor twice.

    Only such a run can hold one window twice (its text is periodic).
    """
    if len(words) < window:
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, bool)
    hashed, span, width = phrases.of(words, gram), 1, window - gram + 1
    least = hashed
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    n = len(words) - window + 1
    if span < width:
        least = np.minimum(least[:n], least[width - span :][:n])
    edge = np.flatnonzero(np.diff(least)) + 1
    first = np.concatenate([[0], edge])
    last = np.concatenate([edge, [n]]) - 1
    if (last - first >= RUN).any():
        pieces = [(a, min(a + RUN - 1, z)) for f, z in zip(first.tolist(), last.tolist()) for a in range(f, z + 1, RUN)]
        first, last = np.asarray([a for a, _ in pieces]), np.asarray([z for _, z in pieces])
    twice = np.zeros(len(first), bool)
    if len(np.unique(hashed)) < len(hashed):
        for i, (f, z) in enumerate(zip(first.tolist(), last.tolist())):
            twice[i] = np.count_nonzero(hashed[f : z + width] == least[f]) > 1
    return least[first].view(np.int64), first.astype(np.int32), last.astype(np.int32), twice


def _words(text: bytes | str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with the row's key: doc_id (a null has its own value) and a text hash."""
    return docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("did"), F.xxhash64("text").alias("th"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            yield whole.slice(at, SLICE)


def recurring_runs(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Runs (anchor, did, th, first, last) whose anchor occurs in two runs or more.

    A task merges the runs of a block: of an anchor that recurs in the block one
    row asks on behalf of all, which are sure already and pass by.
    """
    names = ["anchor", "did", "th", "first", "last", "sure"]

    def find(batches):
        phrases, block, held = Phrases(), [], 0

        def flush():
            *columns, twice = [np.concatenate(c) for c in zip(*block)]
            anchor = columns[0]
            _, at, inverse, count = np.unique(anchor, return_index=True, return_inverse=True, return_counts=True)
            many = count[inverse] > 1
            # 0: alone so far; 1: asks and is sure; 2: sure, need not ask.
            sure = np.where(many, 2, twice).astype(np.int32)
            sure[at[count > 1]] = 1
            block.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, sure)], names)

        for batch in _slices(batches):
            for text, did, th in zip(*(batch.column(i).to_pylist() for i in range(3))):
                anchor, first, last, twice = runs(_words(text), phrases, window, gram)
                if len(anchor):
                    block.append((anchor, np.full(len(anchor), did), np.full(len(anchor), th), first, last, twice))
                    held += len(anchor)
            if held > BLOCK_ROWS:
                yield flush()
                held = 0
        if block:
            yield flush()

    def keep(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if last is None else [last, batch])
            anchor = table.column(0).to_numpy()
            sure = table.column(5).to_numpy()
            same = (anchor[1:] == anchor[:-1]) & (sure[1:] < 2) & (sure[:-1] < 2)
            kept = sure > 0
            kept[1:] |= same
            kept[:-1] |= same
            # The last row waits for its neighbour; that it is kept already is marked in ``sure``.
            n = len(anchor) - 1
            tail = table.slice(n).to_pylist()[0]
            if kept[n] and tail["sure"] == 0:
                tail["sure"] = 1
            last = pa.RecordBatch.from_pylist([tail], schema=batch.schema)
            yield from table.slice(0, n).filter(pa.array(kept[:n])).to_batches()
        if last is not None and last.column(5)[0].as_py() > 0:
            yield last

    schema = "anchor long, did long, th long, first int, last int, sure int"
    found = docs.select("text", "did", "th").mapInArrow(find, schema)
    asked = F.when(F.col("sure") == 2, F.xxhash64("did", "first")).otherwise(F.col("anchor"))
    return found.repartition(asked).sortWithinPartitions("anchor", "sure").mapInArrow(keep, schema).drop("sure")


def confirmed(distinct: dict[bytes, tuple[list[bytes], int]], window: int) -> set[tuple[bytes, ...]]:
    """Passages to search for, confirmed on distinct runs (words and how often each run occurs).

    A window that counts two or more is owned by the first run that holds it,
    and by that run alone. Neighbours in an owner are one passage if neither
    occurs without the other, so that whoever holds a part of a passage holds
    it whole; where runs part, passages end.
    """
    counts: dict[bytes, int] = {}
    longer: dict[bytes, int] = {}
    for words, n in distinct.values():
        for i in range(len(words) - window + 1):
            w = b" ".join(words[i : i + window])
            counts[w] = counts.get(w, 0) + n
            if i + window < len(words):
                w = b" ".join((w, words[i + window]))
                longer[w] = longer.get(w, 0) + n
    owned: set[bytes] = set()
    out: set[tuple[bytes, ...]] = set()
    for words, _ in distinct.values():
        start = end = before = None
        for i in range(len(words) - window + 1):
            w = b" ".join(words[i : i + window])
            n = counts[w]
            if n < 2 or w in owned:
                continue
            owned.add(w)
            if end == i + window - 1 and before == n and longer[b" ".join(words[i - 1 : i + window])] == n:
                end += 1
            else:
                if end:
                    out.add(tuple(words[start:end]))
                start, end = i, i + window
            before = n
        if end:
            out.add(tuple(words[start:end]))
    return out


class Automaton:
    """Aho-Corasick automaton over passages, one character per word."""

    def __init__(self, passages: set[tuple[bytes, ...]]):
        import ahocorasick

        self.letters: dict[bytes, str] = {}
        self.machine = ahocorasick.Automaton()
        for words in passages:
            for w in words:
                if w not in self.letters:
                    code = len(self.letters) + 1
                    self.letters[w] = chr(code if code < 0xD800 else code + 0x800)
            self.machine.add_word("".join(self.letters[w] for w in words), len(words))
        if passages:
            self.machine.make_automaton()

    def locate(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Stretches of ``words`` that passages cover, merged where they touch."""
        if not len(self.machine):
            return []
        get = self.letters.get
        spans = sorted((end + 1 - n, end + 1) for end, n in self.machine.iter("".join([get(w, "\0") for w in words])))
        out: list[tuple[int, int]] = []
        for a, b in spans:
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], b))
            else:
                out.append((a, b))
        return out


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot_runs: int = HOT_RUNS) -> tuple[DataFrame, DataFrame]:
    """The staged runs, and the spans (did, th, start, end in words) that windows occurring twice or more cover."""
    found = staged(recurring_runs(docs, window, gram), "passage-runs")
    hot = staged(found.groupBy("anchor").count().where(F.col("count") > hot_runs).select("anchor", F.lit(True).alias("hot")), "passage-hot")
    flagged = found.join(hot, "anchor", "left")
    per_doc = flagged.groupBy("did", "th").agg(F.collect_set(F.struct("anchor", "first", "last", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("runs"))
    joined = docs.join(per_doc, ["did", "th"]).select("text", "did", "th", "runs")
    names = ["anchor", "run", "did", "th", "first", "n"]

    def cut(batches):
        import xxhash

        block: dict[tuple[int, bytes], list] = {}
        sure: list[tuple] = []
        held = 0

        def flush():
            rows = [(a, run, did, th, first, n) for (a, run), (did, th, first, n) in block.items()] + sure
            block.clear()
            sure.clear()
            columns = list(zip(*rows))
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in _slices(batches):
            for text, did, th, own in zip(*(batch.column(i).to_pylist() for i in range(4))):
                words = _words(text)
                for r in own:
                    a, f, z = r["anchor"], r["first"], r["last"]
                    parts = [(a, f, z)] if not r["hot"] else [(None, i, i) for i in range(f, z + 1)]
                    for key, f, z in parts:
                        run = b" ".join(words[f : z + window])
                        key = (xxhash.xxh64_intdigest(run) - (1 << 63) if key is None else key, run)
                        seen = block.get(key)
                        if seen is None:
                            block[key] = [did, th, f, 1]
                            held += len(run)
                        else:
                            # Equal runs of a block: all their windows recur, the spans are sure.
                            if seen[3] == 1:
                                seen[3] = 2
                                sure.append((key[0], None, seen[0], seen[1], seen[2], z - f + window))
                            sure.append((key[0], None, did, th, f, z - f + window))
            if held > 64 * BLOCK_ROWS or len(sure) > BLOCK_ROWS:
                yield flush()
                held = 0
        if block or sure:
            yield flush()

    def shard(batches):
        anchor = None
        group: list[tuple] = []
        group_runs = 0

        def locate():
            distinct: dict[bytes, tuple[list[bytes], int]] = {}
            for run, _, _, _, n in group:
                words, seen = distinct.get(run) or (run.split(b" "), 0)
                distinct[run] = (words, seen + n)
            machine = Automaton(confirmed(distinct, window))
            where = {run: machine.locate(words) for run, (words, _) in distinct.items()}
            return [(did, th, first + a, first + b) for run, did, th, first, _ in group for a, b in where[run]]

        def flush(rows):
            columns = list(zip(*rows)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["did", "th", "start", "end"])

        for batch in batches:
            out = []
            for a, run, did, th, first, n in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if run is None:
                    out.append((did, th, first, first + n))
                    continue
                if a != anchor:
                    if group_runs > BATCH_RUNS:
                        out += locate()
                        group, group_runs = [], 0
                    anchor = a
                group.append((run, did, th, first, n))
                group_runs += 1
            if out:
                yield flush(out)
        yield flush(locate())

    sent = joined.mapInArrow(cut, "anchor long, run binary, did long, th long, first int, n int")
    to = F.when(F.col("run").isNull(), F.xxhash64("did", "first")).otherwise(F.col("anchor"))
    return found, sent.repartition(to).sortWithinPartitions("anchor").mapInArrow(shard, "did long, th long, start int, end int")


def remove_repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc_id, n_words, n_removed and kept text of every row.

    Each word that is covered by a window which occurs twice or more goes; kept
    words are joined by single spaces. All is judged on the input: every
    occurrence goes, none is left over. A null text has no words; texts shorter
    than a window keep all; a repeated row repeats all its windows; texts are
    read whole.
    """
    own = keyed(docs)
    found, sent = repeated_spans(own, window, gram, hot_runs)
    spans = staged(sent, "passage-spans")
    discard(found)
    per_doc = spans.groupBy("did", "th").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def drop(batches):
        for batch in _slices(batches):
            rows = []
            for text, spans_ in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = _words(text)
                if spans_:
                    gone = np.zeros(len(words) + 1, np.int64)
                    np.add.at(gone, [s["start"] for s in spans_], 1)
                    np.add.at(gone, [s["end"] for s in spans_], -1)
                    kept = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
                    left = [words[i] for i in kept.tolist()]
                else:
                    left = words
                rows.append((len(words), len(words) - len(left), b" ".join(left).decode("utf-8", "surrogatepass")))
            columns = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_words", "n_removed", "kept"]
            )

    joined = own.join(per_doc, ["did", "th"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(drop, f"doc_id {kind}, n_words long, n_removed long, kept string")
