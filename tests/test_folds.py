"""Streamed folds, ranges of ranks and nearest values against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import chunking, joins, packing, ranking, sampling, stats, windows
from tessella.operators.folds import ordered_fold


def test_ordered_fold_streams_keys_larger_than_a_batch(spark):
    rows = spark.range(30000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v")).unionByName(spark.createDataFrame([(None, 5), (None, 7)], "k long, v long"))

    def fold(values):
        total = 0
        for (v,) in values:
            total += v
            yield v, total

    got = ordered_fold(rows, ["k"], ["v"], ["v"], "v bigint, upto bigint", fold)
    assert got.columns == ["k", "v", "upto"] and got.count() == 30002
    last = {r["k"]: r["m"] for r in got.groupBy("k").agg(F.max("upto").alias("m")).collect()}
    assert last == {None: 12} | {k: sum(range(k, 30000, 3)) for k in range(3)}
    assert ordered_fold(rows.limit(0), ["k"], ["v"], ["v"], "v bigint, upto bigint", fold).count() == 0


def test_streamed_segments_equal_those_of_arrays(spark):
    rng = random.Random(4)
    data = [(k, i, rng.randrange(60)) for k in range(30) for i in range(rng.choice([1, 2, 3, 8, 9, 10, 40]))]
    frame = spark.createDataFrame(data, "k int, i int, s int")
    got = {(r["k"], r["segment"]): r["n"] for r in chunking.segment_ordered(frame, ["k"], ["i"], "s", 3, 9).collect()}
    arrays = frame.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("s"))
    wanted = {(r["k"], j): n for r in arrays.select("k", chunking.adaptive_segments(F.col("s"), 3, 9).alias("n")).collect() for j, n in enumerate(r["n"])}
    assert got == wanted


def test_accept_in_order(spark):
    frame = spark.createDataFrame([("a", 1, 6), ("a", 2, 5), ("a", 3, 4), ("b", 4, 11)], "g string, id long, c long")
    assert [tuple(r) for r in packing.accept_in_order(frame, ["g"], ["id"], "id", "c", 10).orderBy("id").collect()] == [("a", 1), ("a", 3)]


def test_onset_groups_end_with_the_reach_of_the_first(spark):
    frame = spark.createDataFrame([("a", t) for t in (0, 4, 8, 12, 30)] + [("b", None)], "k string, t long")
    got = [tuple(r) for r in windows.onset_groups(frame, ["k"], ["t"], "t", 10).orderBy("k", "t").collect()]
    assert got == [("a", 0, 0, 0), ("a", 4, 0, 0), ("a", 8, 0, 0), ("a", 12, 1, 12), ("a", 30, 2, 30), ("b", None, 0, None)]


def test_consume_counts_pass_over_what_does_not_fit(spark):
    frame = spark.createDataFrame([(1, i, c, 5) for i, c in enumerate([2, 0, 4, 3, 1])], "k int, i int, c long, n long")
    got = [(r["i"], r["first_group"], r["last_group"]) for r in windows.consume_counts(frame, ["k"], ["i"], "i", "c", "n").orderBy("i").collect()]
    assert got == [(0, 0, 1), (1, None, None), (2, None, None), (3, 2, 4), (4, None, None)]


@pytest.mark.parametrize("width", [3, 50, 100000])
def test_nearest_over_ranges(spark, width):
    rng = random.Random(width)
    left = [(i, rng.choice("ab") if i % 9 else None, rng.randrange(1000) if i % 7 else None) for i in range(200)]
    right = [(1000 + i, rng.choice("abc") if i % 5 else None, rng.randrange(1000)) for i in range(80)]
    got = joins.nearest(spark.createDataFrame(left, "id int, k string, at long"), spark.createDataFrame(right, "rid int, k string, at long"), ["k"], "at", "rid", width)
    found = {r["id"]: (r["distance"], r["match_id"]) for r in got.collect()}
    assert len(found) == 200
    for i, k, at in left:
        hits = [(float(abs(v - at)), rid) for rid, own, v in right if own == k] if at is not None else []
        assert found[i] == (min(hits) if hits else (None, None)), (i, k, at)


@pytest.mark.parametrize("width", [2, 4096])
def test_percentiles_by_ranges(spark, width):
    rng = random.Random(1)
    data = {g: [rng.randrange(40) for _ in range(n)] for g, n in (("a", 1), ("b", 2), ("c", 101), (None, 50))}
    frame = spark.createDataFrame([(g, v) for g, vs in data.items() for v in [*vs, None]], "g string, v long")
    ranks = {r["g"]: r for r in stats.rank_percentiles(frame, ["g"], "v", {r: (r, 0.9) for r in stats.RULES}, width).collect()}
    linear = {r["g"]: r["p"] for r in stats.linear_percentile(frame, ["g"], "v", 0.3, "p", None, width).collect()}
    for g, vs in data.items():
        vs, n = sorted(vs), len(vs)
        assert ranks[g]["clamped"] == vs[min(n - 1, int(n * 0.9))] and ranks[g]["ceil"] == vs[-(-9 * n // 10) - 1]
        low, part = divmod(0.3 * (n - 1), 1)
        assert linear[g] == pytest.approx(vs[int(low)] + (vs[min(n - 1, int(low) + 1)] - vs[int(low)]) * part)


def test_running_sum_over_many_runs_of_blocks(spark):
    rows = spark.range(20000).select((F.col("id") * 7919 % 20000).alias("d"), F.lit(2).alias("c"))
    got = ranking.running_sum(rows, F.col("c"), ["d"], F.col("d"), None, "before")
    assert got.where("before <> 2 * d").count() == 0 and got.count() == 20000


def test_hold_out_fitting_passes_over_misfits(spark):
    sizes = {f"g{i}": n for i, n in enumerate([3, 9, 2, 30, 4, 11, 1, 6, 16, 5])}
    frame = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "g string")
    order = [r["g"] for r in frame.distinct().orderBy(ranking.hash_key("s", "g")).collect()]
    for wanted in (1, 10, 40, 1000):
        held, chosen = 0, {}
        for g in order:
            if held < wanted and held + sizes[g] <= 1.5 * wanted:
                held, chosen[g] = held + sizes[g], sizes[g]
        assert {r["g"]: r["n"] for r in sampling.hold_out_fitting(frame, "g", "s", wanted).collect()} == chosen


def test_fill_to_floor(spark):
    frame = spark.createDataFrame([(1, 5), (2, 7), (3, 0)], "id long, c long")
    for floor in (0, 12, 13, 20, 61, 200):
        wanted, spent, cycle = [], 0, 0
        while cycle == 0 or spent < floor:
            for i, c in ((1, 5), (2, 7), (3, 0)):
                if cycle and spent >= floor:
                    break
                wanted.append((cycle, i, spent))
                spent += c + (0 if cycle == 0 else [1, 4][(cycle - 1) % 2])
            cycle += 1
        got = sampling.fill_to_floor(frame, ["id"], F.col("id"), "c", floor, [1, 4]).select("cycle", "id", "spent").collect()
        assert sorted(map(tuple, got)) == wanted
    assert sampling.fill_to_floor(frame.limit(0), ["id"], F.col("id"), "c", 10, [1]).count() == 0


def test_fenced_chunks_keep_their_fences(spark):
    text = "one two three\n\nfour five\n" + " ".join(f"w{i}" for i in range(10))
    chunks = chunking.chunk_text(spark.createDataFrame([(1, text), (2, None)], "id int, t string"), "id", "t", 6, F.lit("```py"), F.lit("```")).orderBy("chunk_id").collect()
    assert [r["chunk"].split("\n")[0] for r in chunks] == ["```py"] * len(chunks) and all(r["chunk"].endswith("\n```") for r in chunks)
    assert [w for r in chunks for w in r["chunk"].split()[1:-1]] == text.split()
    assert all(r["num_tokens"] == len(r["chunk"].split()) <= 6 for r in chunks)


def test_chunk_chars_counts_what_is_rendered(spark):
    lines = ["x" * n for n in (5, 9, 40, 1, 1, 12, 3)]
    chunks = chunking.chunk_chars(spark.createDataFrame([(1, "\n\n".join(lines))], "id int, t string"), "id", "t", F.lit("# h"), 20).orderBy("chunk_id").collect()
    assert all(r["num_chars"] == len(r["chunk"]) and (len(r["chunk"]) <= 20 or r["n_lines"] == 1) for r in chunks)
    assert [line for r in chunks for line in r["chunk"].split("\n")[1:]] == lines
    # No chunk could take the next one's first line.
    assert all(len(a["chunk"]) + 1 + len(b["chunk"].split("\n")[1]) > 20 for a, b in zip(chunks, chunks[1:]))
