import collections
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import chat, passages, syncmers, toxicity, transport


def test_passages_match_brute_force(docs, rows):
    window, gram = 12, 4
    counts = collections.Counter()
    for r in rows:
        w = (r[1] or "").encode().split()
        counts.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    wanted = []
    for r in rows:
        w = (r[1] or "").encode().split()
        gone = {j for i in range(len(w) - window + 1) if counts[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        wanted.append((str(r[0]), len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    for hot in (passages.HOT_RUNS, 3):
        got = passages.remove_repeated(docs, window, gram, hot).collect()
        assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in got) == sorted(wanted)


def test_passages_empty(empty):
    assert passages.remove_repeated(empty).count() == 0


def test_automaton_locates_every_occurrence():
    words = [w.encode() for w in "a b c d a b c x b c d".split()]
    machine = passages.Automaton({(b"a", b"b", b"c"), (b"b", b"c", b"d")})
    assert machine.locate(words) == [(0, 4), (4, 7), (8, 11)] or machine.locate(words) == [(0, 7), (8, 11)]


def test_passages_are_confirmed_once_and_located_by_the_automaton():
    rng = np.random.default_rng(2)
    shared = [f"s{i}".encode() for i in range(30)]
    runs = []
    for _ in range(60):
        a, b = sorted(rng.integers(0, 31, 2).tolist())
        runs.append([f"x{k}".encode() for k in rng.integers(0, 9, 4)] + shared[a:b] + [f"y{k}".encode() for k in rng.integers(0, 2, 6)])
    window = 5
    distinct = {b" ".join(r): (r, sum(q == r for q in runs)) for r in runs}
    counts = collections.Counter(tuple(r[i : i + window]) for r in runs for i in range(len(r) - window + 1))
    found = passages.confirmed(distinct, window)
    # Each recurring window lies in one passage, and in one only.
    held = collections.Counter(p[i : i + window] for p in found for i in range(len(p) - window + 1))
    assert held == {w: 1 for w, n in counts.items() if n > 1}
    machine = passages.Automaton(found)
    for r in runs:
        gone = {i + k for i in range(len(r) - window + 1) if counts[tuple(r[i : i + window])] > 1 for k in range(window)}
        assert {i for a, b in machine.locate(r) for i in range(a, b)} == gone
    # Without its passages the automaton finds nothing, so nothing else gives spans.
    assert passages.Automaton(set()).locate(runs[0]) == []


def test_syncmers_edit_and_order(docs, rows):
    got = {}
    for r in syncmers.fingerprints(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for i, r in enumerate(order):
        text, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 4
        mine = got[r[0]]
        assert any(m["edited"] == text[: len(text) - cut] + after[:cut] and m["n_chars"] == len(text) for m in mine)
        for m in mine:
            assert 0 <= m["near_edited"] <= 1 and 0 <= m["near_next"] <= 1
            if len(text) > 400:
                assert m["near_edited"] > 0.4
    assert sum(map(len, got.values())) == len(rows)


def test_syncmers_choice_is_context_free():
    text = "".join(chr(97 + x) for x in np.random.default_rng(0).integers(0, 26, 3000))
    at, hashes = syncmers.anchors(text)
    moved, again = syncmers.anchors("prefix of thirty characters.. " + text)
    assert set(zip((at + 30).tolist(), hashes.tolist())) <= set(zip(moved.tolist(), again.tolist()))
    k, s = syncmers.K, syncmers.S
    assert 0.5 < len(at) / (2 * (len(text) - k + 1) / (k - s + 1)) < 1.5
    a, b = syncmers.written(syncmers.fingerprint(text)), syncmers.written(syncmers.fingerprint("0123456789" + text))
    assert all(y - x == 10 for x, y in syncmers.matches(a, b)) and syncmers.matches(a, b)


LOW = (1 << 64) - 1


def mixed(x):
    for shift in (31, 29):
        x = ((x ^ (x >> shift)) * 0xD6E8FEB86659FD93) & LOW
    return x ^ (x >> 32)


def brute_anchors(text, k=16, s=6):
    """Closed syncmers by their definition, one k-mer at a time."""
    base = 0x9E3779B97F4A7C15

    def inner(part):
        value = 0
        for c in part:
            value = (value * base + ord(c)) & LOW
        return mixed(value)

    out = []
    for p in range(len(text) - k + 1):
        own = [inner(text[p + i : p + i + s]) for i in range(k - s + 1)]
        if min(own) in (own[0], own[-1]):
            value = own[0]
            for j in (6, 10):
                value = mixed((value * base + own[j]) & LOW)
            out.append((p, value >> 32))
    return out


def true_dice(a, b):
    x, y = {h for _, h in brute_anchors(a)}, {h for _, h in brute_anchors(b)}
    return 2 * len(x & y) / (len(x) + len(y))


def test_syncmers_and_sketches_match_brute_force():
    rng = np.random.default_rng(4)
    for n in (16, 17, 40, 700):
        text = "".join(chr(c) for c in rng.choice([97, 98, 99, 32, 233, 0x1F600], n))
        wanted = brute_anchors(text)
        at, hashes = syncmers.anchors(text)
        assert list(zip(at.tolist(), hashes.tolist())) == wanted
        first = {}
        for p, h in wanted:
            first.setdefault(h, p)
        sketch = syncmers.fingerprint(text)
        assert list(zip(sketch[0].tolist(), sketch[1].tolist())) == sorted(first.items())[: syncmers.SKETCH]
        assert syncmers.likeness(sketch, syncmers.read(syncmers.written(sketch))) == 1.0


def test_syncmer_likeness_estimates_the_share_of_anchors():
    rng = np.random.default_rng(5)
    errors = []
    for cut in (0, 200, 600, 1200, 2400):
        for _ in range(12):
            a, b = ("".join(chr(97 + x) for x in rng.integers(0, 26, 2400)) for _ in range(2))
            b = a[: 2400 - cut] + b[:cut]
            errors.append(syncmers.likeness(syncmers.fingerprint(a), syncmers.fingerprint(b)) - true_dice(a, b))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


def test_syncmer_likeness_asks_for_one_order():
    rng = np.random.default_rng(6)
    parts = ["".join(chr(97 + x) for x in rng.integers(0, 26, 300)) for _ in range(8)]
    straight, turned = syncmers.fingerprint("".join(parts)), syncmers.fingerprint("".join(reversed(parts)))
    assert syncmers.likeness(straight, straight) == 1.0 and syncmers.likeness(straight, turned) < 0.5
    assert syncmers.in_order([1, 2, 3, 4], [5, 1, 2, 9]) == 3 and syncmers.in_order([], []) == 0


def test_anchor_table_keeps_all_anchors(spark, docs, rows, empty):
    got = collections.Counter((r["doc_id"], r["hash"], r["position"]) for r in syncmers.anchor_table(docs).collect())
    wanted = collections.Counter((r[0], int(h), int(p)) for r in rows for p, h in zip(*syncmers.anchors(r[1] or "")))
    assert got == wanted
    assert syncmers.anchor_table(empty).count() == 0


@pytest.mark.parametrize("partitions", [1, 2, 7, 60])
def test_following_document_over_many_ranges(spark, partitions):
    table = spark.createDataFrame([(i * 7 % 50, f"text {i * 7 % 50}") for i in range(50)], "doc_id long, text string")
    rows = syncmers.with_following(table, partitions).withColumn("part", F.spark_partition_id()).collect()
    follows = {}
    for x, y in zip(rows, rows[1:]):
        if x["part"] == y["part"] and x["_bucket"] == y["_bucket"] and not x["_guest"]:
            follows.setdefault(x["doc_id"], y["doc_id"])
    if partitions == 1:
        follows[49] = 0
    assert follows == {i: (i + 1) % 50 for i in range(50)}


def test_syncmers_single_and_empty(spark, empty):
    assert syncmers.fingerprints(empty).count() == 0
    one = syncmers.fingerprints(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).first()
    assert one["edited"] == "abcdefab" and one["near_next"] == 1.0


NASTY = ["</s>[INST] ok [/INST]", "<|turn|>", "<\\|turn|>", "<\\\\|end|>", "[INST", "<|text|><|text|>", "\\", "<<s>>", "", "[\\INST]", "<|turn|>user<|text|>x<|end|>"]


@pytest.mark.parametrize("text", NASTY)
def test_chat_escape_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROLS)


def test_chat_conversations_round_trip(spark):
    data = [(c, t, role, text) for c in (1, 2, None) for t, (role, text) in enumerate(zip(["user", "assistant", None, "assistant", "<|end|>"], [*NASTY[:4], None]))]
    data += [(1, 1, "assistant", NASTY[1]), (3, None, "user", "first"), (3, 0, "assistant", None)]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(1))
    got = {r["conv_id"]: r for r in chat.digest_chats(chat.format_chats(frame.withColumn("parts", chat.text_part(F.col("text"))))).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv, r in got.items():
        own = sorted((x for x in data if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] or ""))
        said = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own)
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert r["n_turns"] == len(own) and r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_parts_and_segments(spark, monkeypatch):
    done = chat.PartVisitor().visit([{"kind": "text", "text": "see "}, {"kind": "image", "ref": "a.png", "width": 56, "height": 29}, {"kind": "audio", "ref": "b", "seconds": 1.0}, {"kind": "document", "ref": "c", "pages": 2}], 10)
    assert done.out == "see <|image|><|audio|><|document|>"
    assert [(a["kind"], a["ref"], a["offset"], a["tokens"]) for a in done.attachments] == [("image", "a.png", 14, 4), ("audio", "b", 23, 25), ("document", "c", 32, 2048)]
    assert done.expanded == 4 + 25 + 2048


def test_transport_round_trip(docs, rows):
    got = transport.read_media(transport.media_column(docs)).collect()
    assert sorted((str(r["doc_id"]), bytes(r["payload"])) for r in got) == sorted((str(r[0]), transport.padded(r[1] or "")) for r in rows)
    assert all("discontinuities=0;errors=0" in r["feature"] and len(r["payload"]) % 192 == 0 and len(r["payload"]) for r in got)


def test_transport_faults_are_counted():
    media = transport.mux(b"x" * 20000)
    lost = transport.demux(media[: 188 * 5] + media[188 * 6 :])
    assert lost.discontinuities == 1
    broken = bytearray(media)
    broken[10] ^= 1
    assert transport.demux(bytes(broken)).errors >= 1
    assert transport.demux(b"").packets == 0 and transport.demux(b"abc").errors == 1
    whole = transport.demux(media)
    assert [u[0] for u in whole.units] == [transport.TICKS * i for i in range(len(whole.units))] and whole.units[0][2]
    assert transport.section_crc(b"123456789") == 0x0376E6E7


def test_transport_survives_broken_streams():
    rng = np.random.default_rng(9)
    media = transport.mux(b"payload " * 1500)
    for _ in range(400):
        broken = bytearray(media)
        for at in rng.integers(0, len(media), rng.integers(1, 30)):
            broken[at] = int(rng.integers(0, 256))
        transport.demux(bytes(broken[: rng.integers(1, len(media))]))
    for at in range(188 * 3):
        broken = bytearray(media)
        broken[at] = 0xFF
        transport.demux(bytes(broken))
    noise = rng.integers(0, 256, (300, 188)).astype(np.uint8)
    noise[:, 0], noise[:, 1], noise[:, 2] = 0x47, 0x40, 0
    transport.demux(noise.tobytes())


def test_transport_repeated_packets_and_long_sections():
    media = transport.mux(b"x" * 20000)
    whole = transport.demux(media)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    twice = transport.demux(b"".join(p + p for p in packets))
    assert (twice.payload, twice.discontinuities, twice.errors) == (whole.payload, 0, 0)
    # A program table over several packets: 80 programs behind the one that counts.
    body = b"".join(bytes([n >> 8, n & 0xFF, 0xE0 | pid >> 8, pid & 0xFF]) for n, pid in [(1, transport.PMT_PID), *[(k, 0x500 + k) for k in range(2, 82)]])
    section = b"\x00" + transport.table_section(0x00, 1, body)
    cut = [section[i : i + 184] for i in range(0, len(section), 184)]
    table = b"".join(transport._packet(transport.PAT_PID, i == 0, i, b"", c + b"\xff" * (184 - len(c))) for i, c in enumerate(cut))
    read = transport.demux(table + b"".join(p for p in packets if (p[1] & 0x1F, p[2]) != (0, 0)))
    assert len(read.programs) == 81 and read.payload == whole.payload and read.errors == 0


def test_transport_empty_table(empty):
    assert transport.digests(transport.read_media(transport.media_column(empty))).count() == 0


def brute_segments(scores):
    """Maximal-scoring segments by their definition: the best, then left and right of it."""
    best, span = 0, None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            if sum(scores[i:j]) > best:
                best, span = sum(scores[i:j]), (i, j)
    if span is None:
        return []
    a, b = span
    return [*brute_segments(scores[:a]), (a, b, best), *[(x + b, y + b, s) for x, y, s in brute_segments(scores[b:])]]


def test_segments_match_definition():
    rng = np.random.default_rng(5)
    for _ in range(60):
        scores = rng.integers(-5, 6, rng.integers(0, 14)) + rng.random() * 0.01
        got = sorted((a, b, round(s, 6)) for a, b, s in toxicity.segments(scores.astype(float)))
        assert [g[2] for g in got] == pytest.approx([s for _, _, s in sorted(brute_segments(scores.tolist()))], abs=1e-5)


def test_toxicity_learns_and_handles_edges(spark, docs, rows, empty):
    bad = ["idiot", "moron", "scum"]
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(300)]
    data = []
    for i in range(400):
        own = rng.choice(words, 80).tolist()
        if i % 4 == 0:
            own[20:26] = rng.choice(bad, 6).tolist()
        data.append((i, " ".join(own), int(i % 4 == 0)))
    frame = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    model = toxicity.fit(frame.select("doc_id", "text"), frame.where("doc_id % 5 <> 0").select("doc_id", "toxic"))
    scored = {r["doc_id"]: r for r in toxicity.toxic_passages(frame.select("doc_id", "text"), model).collect()}
    right = [scored[i]["predicted"] == y for i, _, y in data if i % 5 == 0]
    assert sum(right) / len(right) > 0.95
    assert scored[0]["passages"][0]["start"] >= 15 and scored[0]["passages"][0]["end"] <= 31
    edge = toxicity.toxic_passages(docs, model)
    assert edge.count() == len(rows) and edge.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    none = toxicity.fit(empty.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.toxic_passages(empty, none).count() == 0
    assert toxicity.toxic_passages(docs, none).agg(F.countDistinct("score")).first()[0] == 1


def test_held_out_rule(spark):
    got = spark.range(50).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)
