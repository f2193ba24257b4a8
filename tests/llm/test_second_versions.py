"""Independent small versions of what SQL cannot say, and odd inputs of earlier operators."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import chat, hilbert, mixing, packing, toxicity, transport
from tessella.llm.common import word_count

CLEAN = "the river runs past old stone houses and the people walk along its quiet banks in the evening light".split()
RUDE = "vermin scumbag filth moron".split()


def labelled(seed=0, n=160):
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(n):
        words = rng.choice(CLEAN, int(rng.integers(5, 60))).tolist()
        toxic = int(i % 3 == 0)
        if toxic:
            at = int(rng.integers(0, len(words)))
            words[at:at] = [w + rng.choice(["", "!", "s", ","]) for w in rng.choice(RUDE, int(rng.integers(2, 6)))]
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return rows, labels


def all_segments(scores):
    """Maximal-scoring segments by their definition: the best one (first, then shortest), then left and right of it."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > 1e-12 and (best is None or s > best[0] + 1e-9):
                best = (s, i, j)
    if best is None:
        return []
    _, i, j = best
    return [(a, b, s) for a, b, s in all_segments(scores[:i])] + [(i, j, best[0])] + [(a + j, b + j, s) for a, b, s in all_segments(scores[j:])]


def test_toxicity_matches_a_version_without_buckets(spark):
    rows, labels = labelled()
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    # Units as texts: tokens without marks at their ends, and their stems.
    held = [collections.Counter(), collections.Counter()]
    for (_, text), (_, toxic) in zip(rows, labels):
        units = set()
        for token in text.lower().split():
            word = token.strip(toxicity.MARKS)
            units |= {"w:" + word, "5:" + word[:5], "4:" + word[:4]} if word else set()
        held[toxic].update(units)
    sizes = [sum(h.values()) + 1.0 for h in (held[1], held[0])]
    alphas = [toxicity.PRIOR * s / sum(sizes) for s in sizes]

    def unit_score(unit):
        parts = []
        for own, alpha, size in zip((held[1], held[0]), alphas, sizes):
            n = own[unit] + alpha
            parts.append((math.log(n / (size - 1 + alpha * toxicity.BUCKETS - n)), 1 / n))
        odds, error = parts[0][0] - parts[1][0], math.sqrt(parts[0][1] + parts[1][1])
        return abs(odds / error), math.copysign(max(abs(odds) - toxicity.CAUTION * error, 0.0), odds)

    def token_score(token):
        word = token.strip(toxicity.MARKS)
        return max(unit_score("w:" + word), unit_score("5:" + word[:5]), unit_score("4:" + word[:4]))[1] if word else 0.0

    look = toxicity.TokenScores(model.value, model.weight)
    scored = {r["doc_id"]: r for r in toxicity.toxic_passages(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, text in rows:
        wanted = [token_score(t) for t in text.lower().split()]
        assert np.allclose(look.of(text), wanted, atol=1e-4)
        moved = [s - model.drift for s in wanted]
        base = model.log_k + math.log(max(len(moved), 1))
        strong = [(a, b, model.decay * s - base) for a, b, s in all_segments(moved)]
        total = min(sum(max(0.0, s + 2) for _, _, s in strong), 100.0)
        assert abs(scored[i]["score"] - 1 / (1 + math.exp(-(model.intercept + model.slope * total)))) < 2e-3
        assert [(p["start"], p["end"]) for p in scored[i]["passages"]] == [(a, b) for a, b, s in strong if s > -2 + 1e-3] or any(abs(s + 2) < 1e-2 for *_, s in strong)
    right = [(scored[i]["predicted"], toxic) for i, toxic in labels]
    assert sum(p == t for p, t in right) > 0.95 * len(right)


def test_decay_and_logistic_solve_their_equations():
    rng = np.random.default_rng(1)
    counts = np.zeros(2 * toxicity.STEPS + 1)
    scores = np.clip(np.rint(rng.normal(-1, 0.8, 5000) / toxicity.GRID), -toxicity.STEPS, toxicity.STEPS).astype(int)
    np.add.at(counts, scores + toxicity.STEPS, 1)
    decay = toxicity.karlin_decay(counts)
    grid = np.arange(-toxicity.STEPS, toxicity.STEPS + 1) * toxicity.GRID
    assert decay > 0 and abs((counts / counts.sum() * np.exp(decay * grid)).sum() - 1) < 1e-6
    x, toxic, clean = np.array([0.0, 1.0, 2.0, 5.0]), np.array([1.0, 2.0, 6.0, 9.0]), np.array([20.0, 5.0, 3.0, 1.0])
    a, b, value = toxicity.logistic(x, toxic, clean)
    p = 1 / (1 + np.exp(-(a + b * x)))
    assert abs((toxic - (toxic + clean) * p).sum() - 0.01 * a) < 1e-5 and abs(((toxic - (toxic + clean) * p) * x).sum() - 0.1 * b) < 1e-5
    assert abs(value - (toxic * np.log(p) + clean * np.log(1 - p)).sum()) < 1e-6


def test_media_digests_match_plain_bytes(docs, rows):
    got = collections.Counter(tuple(r) for r in transport.digests(transport.read_media(transport.media_column(docs))).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256").collect())
    wanted = collections.Counter()
    for row in rows:
        own = (row[1] or "").encode()
        payload = own + b" " * (-len(own) % 192 if own else 192)
        media = transport.mux(payload)
        assert len(media) % 188 == 0 and media[::188] == b"\x47" * (len(media) // 188)
        wanted[(row[0], len(own), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest())] += 1
    assert got == wanted


def test_long_conversations_are_cut_into_segments(spark):
    turns = [(1, t, ("user", "assistant")[t % 2], chr(97 + t) * 400_000 + "<s>") for t in range(6)] + [(2, 0, "assistant", "short")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part(F.col("text")))
    done = chat.format_chats(frame)
    segments = collections.Counter(r["conv_id"] for r in done.select("conv_id").collect())
    assert segments == {1: 2, 2: 1}
    told = {r["conv_id"]: r for r in chat.digest_chats(chat.format_chats(frame)).collect()}
    own = turns[:6]
    assert told[1]["n_turns"] == 6 and told[1]["loss_chars"] == 3 * 400_003
    assert told[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in own).encode()).hexdigest()
    assert told[1]["loss_sha256"] == hashlib.sha256("".join(t for _, _, r, t in own if r == "assistant").encode()).hexdigest()


def test_segments_of_short_limits_hold_whole_turns(monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT_CHARS", 60)
    part = lambda text: [{"kind": "text", "text": text}]
    batch = pa.RecordBatch.from_pydict({"c": [1, 1, 1, 2], "r": ["user", "assistant", None, "user"], "p": [part("a" * 50), part("b" * 10), part(""), []]})
    got = list(chat._segments(iter([batch])))
    assert [(g[0], g[1]) for g in got] == [(1, 0), (1, 1), (2, 0)]
    assert [t for g in got for t in chat.read_turns(g[2])] == [("user", "a" * 50), ("assistant", "b" * 10), ("", ""), ("user", "")]
    for _, _, text, spans, *_ in got:
        assert [text[s["start"] : s["end"]] for s in spans] in ([], ["b" * 10])


def test_chats_of_an_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part(F.col("text")))
    assert chat.format_chats(none).count() == 0 and chat.digest_chats(chat.format_chats(none)).count() == 0


def test_packing_replaces_clashing_columns(spark):
    rng = np.random.default_rng(2)
    lengths = [2048] * 5 + [int(x) for x in rng.integers(1, 2048, 60)]
    frame = spark.createDataFrame([(i, n, "x", 7.5, 3) for i, n in enumerate(lengths)], "doc_id long, length long, sequence_id string, offset double, _rank int").repartition(3)
    done = packing.harmonic_pack(frame, ["doc_id"]).collect()
    assert sorted((r["doc_id"], r["length"], r["_rank"]) for r in done) == [(i, n, 3) for i, n in enumerate(lengths)]
    bins = collections.defaultdict(list)
    for r in done:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048
    assert sum(len(p) == 1 and p[0][1] == 2048 for p in bins.values()) == 5
    assert packing.harmonic_pack(frame.limit(0), ["doc_id"]).count() == 0


def test_the_schedule_decides_the_mix(docs, monkeypatch):
    def first_slots():
        placed, pieces = mixing.mix(docs, word_count(F.col("text")))
        firsts = pieces.groupBy("row_key").agg(F.min(F.struct("slot", "at")).alias("f"))
        return {r["row_key"]: tuple(r["f"]) for r in firsts.collect()}, pieces.groupBy("slot").agg(F.countDistinct("row_key"), F.sum("words").alias("n"), F.max(F.col("at") + F.col("words")).alias("m")).collect()

    before, slots = first_slots()
    assert all(r["n"] == r["m"] for r in slots)
    monkeypatch.setattr(mixing, "PHI", 0.7548776662466927)
    after, _ = first_slots()
    assert before.keys() == after.keys() and before != after


@pytest.mark.parametrize("name", ["rank", "place", "cell"])
def test_shards_keep_carried_columns(spark, name):
    frame = spark.createDataFrame([(i, i % 7, i % 3, 10 + i, i) for i in range(200)], f"doc_id long, a int, b int, size long, {name} int")
    done = hilbert.hilbert_shards(frame, "doc_id", [F.col("a"), F.col("b"), F.lit(0)], F.col("size"), 4, "rows", [F.col(name)]).collect()
    assert sorted(r[name] for r in done) == list(range(200))
