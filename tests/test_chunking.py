"""Chunkers and segmentation against plain Python."""

import random

from pyspark.sql import functions as F

from tessella.operators import chunking


def segments(scores, least, most):
    out, start = [], 0
    while start < len(scores):
        room = min(most, len(scores) - start)
        if room < least:
            out.append(room)
            break
        options = [(scores[start + n - 1] + (chunking.PREFERRED.get(n, 0) if n < room else 0), -n) for n in range(least, max(least, room - 1) + 1)]
        out.append(-max(options)[1])
        start += out[-1]
    return out


def test_adaptive_segments(spark):
    rng = random.Random(4)
    data = [(i, [rng.randint(0, 60) for _ in range(rng.randint(0, 40))]) for i in range(40)]
    got = {r["id"]: r["n"] for r in spark.createDataFrame(data, "id int, s array<int>").select("id", chunking.adaptive_segments(F.col("s"), 3, 9).alias("n")).collect()}
    for i, scores in data:
        assert got[i] == segments(scores, 3, 9)


def test_chunk_text_keeps_all_words(spark):
    rng = random.Random(6)
    texts = ["\n".join(" ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 12))) for _ in range(20)] + ["", None, " ", "x " * 100]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = chunking.chunk_text(frame, "id", "t", 16).orderBy("id", "chunk_id").collect()
    for i, t in enumerate(texts):
        own = [r for r in got if r["id"] == i]
        assert [w for r in own for w in r["chunk"].split()] == (t or "").split()
        assert all(len(r["chunk"].split()) == r["num_tokens"] <= 16 for r in own)


def test_repetition(spark):
    rows = [(i, c) for i, c in enumerate([3, 4, 5, 0, 8])]
    frame = spark.createDataFrame(rows, "id int, c int").repartition(3)
    for target in (1, 20, 45, 47, 200):
        got = chunking.cycle_to_target(frame, ["id"], F.floor(F.col("id") / 2), "c", target).collect()
        taken, total = [], 0
        while total < target:
            for i, c in rows:
                taken.append(i)
                total += c
                if total >= target:
                    break
        # A row without cost may end the last cycle or not; what is spent is the same.
        assert sum(r["c"] for r in got) == total
    assert chunking.cycle_to_target(frame.limit(0), ["id"], F.lit(0), "c", 5).count() == 0
    assert chunking.repeat_count(100, range(1, 11), 300, 400) == 3 and chunking.repeat_count(7, range(1, 3), 300, 400) == 2
