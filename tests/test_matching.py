import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import folds, joins, matching, packing, sampling


def greedy(costs, budget, soft=0, until_full=False):
    """Row by row: what a budget accepts."""
    used, taken = 0, []
    for i, c in enumerate(costs):
        if until_full and used >= budget:
            break
        if used + c <= budget or used < soft:
            taken.append(i)
            used += c
    return taken


@pytest.mark.parametrize("folded,soft,until_full", [(0, 0, False), (0, 0, True), (3, 0.9, True), (100_000, 0, False)])
def test_budget_passes_over_what_does_not_fit(spark, folded, soft, until_full):
    rng = random.Random(folded + until_full)
    for budget, costs in (
        (1000, [int(2 ** rng.uniform(0, 9)) for _ in range(80)] + [0, 1, 0]),
        (50, [60, 50, 1, 0]),
    ):
        frame = spark.createDataFrame([(i, c) for i, c in enumerate(costs)], "i long, cost long").repartition(3)
        got = sampling.accept_fitting(frame, ["i"], F.floor(F.col("i") / 8), "cost", budget, soft * budget, until_full, folded)
        assert sorted(r["i"] for r in got.collect()) == greedy(costs, budget, soft * budget, until_full)


def test_budget_of_an_empty_table(spark):
    frame = spark.createDataFrame([], "i long, cost long")
    assert sampling.accept_fitting(frame, ["i"], F.col("i"), "cost", 10).count() == 0
    assert sampling.accept_fitting(frame, ["i"], F.col("i"), "cost", 10, 9, True, 0).count() == 0


def test_budgets_take_null_groups_and_targets_below_the_protected(spark):
    rows = [(i, None if i % 3 else "a", 10 + i, i < 2) for i in range(9)]
    frame = spark.createDataFrame(rows, "id long, grp string, cost long, p boolean")
    for target in (15, 1000):
        drawn = sampling.smallest_round_robin(frame, F.col("p"), "grp", "id", "s", "cost", target, 0.995).collect()
        assert {r["id"] for r in drawn if r["why"] == "protected"} == {0, 1}
        assert {r["id"] for r in drawn if r["why"] == "first"} == {2, 3}
        assert len(drawn) == len({r["id"] for r in drawn}) and (target < 1000 or len(drawn) == 9)
        fits = sampling.protected_round_robin(frame, F.col("p"), "grp", "id", "s", "cost", target).collect()
        assert sum(r["cost"] for r in fits) <= target and (target < 1000 or len(fits) == 9)
        shares = sampling.protected_then_shares(frame, F.col("p"), "grp", "id", "s", "cost", target).collect()
        assert {0, 1} <= {r["id"] for r in shares}


def test_longest_spans(spark):
    rng = random.Random(3)
    costs = [rng.randint(1, 40) for _ in range(200)] + [300, 5]
    got = list(folds.longest_spans(100)(iter([(i, c) for i, c in enumerate(costs)])))
    wanted = []
    for i in range(len(costs)):
        j = i
        while j + 1 < len(costs) and sum(costs[i : j + 2]) <= 100:
            j += 1
        wanted.append((i, j, sum(costs[i : j + 1])))
    assert got == wanted


def test_ratio_join_finds_all_pairs_once(spark):
    rng = random.Random(4)
    rows = [(i, i % 3 if i % 10 else None, rng.uniform(0, 30) if i % 7 else None) for i in range(120)] + [(200, 1, -4.0), (201, 1, 0.0)]
    frame = spark.createDataFrame(rows, "i long, k long, v double")
    got = [(r["a"], r["b"]) for r in joins.ratio_join(frame, frame, ["k"], "v", 0.75, 1.33).select(F.col("l.i").alias("a"), F.col("r.i").alias("b")).collect()]
    usable = [r for r in rows if r[1] is not None and r[2] is not None and r[2] > 0]
    assert sorted(got) == sorted((x[0], y[0]) for x in usable for y in usable if x[1] == y[1] and 0.75 <= x[2] / y[2] <= 1.33)


def clusters_of(events, tolerance, share=0.5):
    """Clusters by comparing all pairs of sequences of a block."""
    seqs = {}
    for block, seq, value, at in events:
        seqs.setdefault((block, seq), []).append((value, at))
    parent = {k: k for k in seqs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, own in seqs.items():
        for z, other in seqs.items():
            if x[0] == z[0] and x != z:
                close = sum(any(v == w and abs(a - b) <= tolerance for w, b in other) for v, a in own)
                if close >= share * len(own):
                    a, b = find(x), find(z)
                    parent[max(a, b)] = min(a, b)
    return {k: find(k)[1] for k in seqs}


def test_near_duplicate_sequences_match_brute_force(spark):
    rng = random.Random(5)
    events = []
    # A large group of jittered copies, exact copies, chains of half-shared sequences, and others.
    base = sorted((rng.choice("abc"), rng.randrange(100_000)) for _ in range(20))
    for seq in range(60):
        events += [(0, seq, v, max(0, a + rng.randint(-20, 20))) for v, a in base]
    for seq in range(60, 75):
        events += [(0, seq, v, a) for v, a in base]
    for seq in range(75, 95):
        events += [(0, seq, rng.choice("abc"), rng.randrange(100_000)) for _ in range(rng.randint(1, 20))]
    chain = [(rng.choice("abc"), rng.randrange(100_000)) for _ in range(60)]
    for i in range(8):
        events += [(1, 100 + i, v, a) for v, a in chain[6 * i : 6 * i + 12]]
    frame = spark.createDataFrame(events, "block long, seq long, v string, at long").repartition(5)
    got = {(r["block"], r["seq"]): r["cluster"] for r in matching.near_duplicate_sequences(frame, "block", "seq", "v", "at", 25).collect()}
    assert got == clusters_of(events, 25)
    assert len(set(got.values())) < 40
    none = matching.near_duplicate_sequences(frame.limit(0), "block", "seq", "v", "at", 25)
    assert none.count() == 0


def test_best_match_is_exact_and_prunes(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(300):
        n = int(np.exp(rng.uniform(1, 6)))
        hist = rng.multinomial(n, rng.dirichlet([1] * 4)).tolist()
        rows.append((i, n, int(n * rng.uniform(1, 50)), int(n * rng.uniform(10, 12)), hist))
    rows.append((300, *rows[0][1:]))
    frame = spark.createDataFrame(rows, "id long, n long, total long, span long, hist array<long>")
    weights = {"n": 1.0, "total": 0.5, "span": 0.3}
    got = {r["id"]: r for r in matching.best_match(frame, frame, "id", "id", weights, "n", "hist", 2.0, "total").withColumnRenamed("match_id", "m").collect()}

    def score(a, b):
        d = sum(w * abs(a[k] - b[k]) / max(a[k], b[k]) for w, k in ((1.0, 1), (0.5, 2), (0.3, 3)))
        return round(d + 2.0 * sum(abs(x - y) for x, y in zip(a[4], b[4])) / (a[1] + b[1]), 9)

    compared = 0
    for a in rows:
        best = min((score(a, b), b[0]) for b in rows if b[0] != a[0])
        assert abs(got[a[0]]["score"] - best[0]) < 1e-8 and got[a[0]]["m"] == best[1]
        compared += got[a[0]]["n_compared"]
    assert compared < 0.5 * len(rows) ** 2
    one = frame.where("id = 0")
    assert matching.best_match(one, one, "id", "id", weights, "n", "hist", 2.0, "total").count() == 0
    assert matching.best_match(one.limit(0), one.limit(0), "id", "id", weights, "n", "hist", 2.0, "total").count() == 0


def test_look_ahead_match(spark):
    rng = random.Random(7)
    left = [[rng.randint(0, 2) for _ in range(3)] for _ in range(90)]
    right = [list(g) for g in left if rng.random() < 0.8]
    for at in range(0, 60, 9):
        right.insert(at, [rng.randint(0, 2) for _ in range(3)])
    wanted, at = [], 0
    for pos, group in enumerate(left):
        best, score = None, -1
        for j in range(at, min(len(right), at + 8)):
            now = 8 * sum(map(min, group, right[j])) - abs(sum(group) - sum(right[j])) - (j - at)
            if now > score:
                best, score = j, now
        wanted.append((pos, best, score if best is not None else None))
        at = at if best is None else best + 1
    sides = [spark.createDataFrame([("k", i, g) for i, g in enumerate(side)], "key string, pos long, counts array<long>").repartition(3) for side in (left, right)]
    got = sorted((r["left_pos"], r["right_pos"], r["score"]) for r in matching.greedy_match(*sides, ["key"], "pos", "counts").collect())
    assert got == wanted
    assert all(r["right_pos"] is None for r in matching.greedy_match(sides[0], sides[1].limit(0), ["key"], "pos", "counts").collect())


def test_texts_are_scanned_once(spark):
    """The budget samplers read the texts a single time, whatever they read the sizes for."""
    import __spark_entry__

    for name in ("token_stats_by_source", "round_robin_token_budget", "proportional_budget", "protected_first_then_round_robin", "keep_sources_then_round_robin"):
        plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "documents.parquet" not in plan, name


def test_packing_fold_still_accepts(spark):
    frame = spark.createDataFrame([(1, i, c) for i, c in enumerate((5, 9, 4, 1))], "k long, i long, c long")
    assert sorted(r["i"] for r in packing.accept_in_order(frame, ["k"], ["i"], "i", "c", 10).collect()) == [0, 2, 3]


@pytest.mark.parametrize("tile", [10, 60, 10**6])
def test_best_overlap_in_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(joins, "LEFT_ROWS", 25)
    rng = random.Random(8)
    left = [(i, [f"w{k}" for k in rng.sample(range(40), rng.randint(0, 8))]) for i in range(60)] + [(99, None)]
    right = [(i, [f"w{k}" for k in rng.sample(range(40), rng.randint(0, 8))]) for i in range(50)]
    wanted = {}
    for i, own in left:
        scores = [(-len(set(own) & set(other)) / len(set(own) | set(other)), j) for j, other in right if own and set(own) & set(other)]
        if scores:
            wanted[i] = (min(scores)[1], -min(scores)[0])
    frames = [spark.createDataFrame(rows, f"{name} long, w array<string>") for rows, name in ((left, "i"), (right, "j"))]
    assert {r["i"]: (r["j"], r["jaccard"]) for r in joins.best_overlap(frames[0], "i", frames[1], "j", "w", tile).collect()} == wanted


def test_near_duplicate_sequences_meet_leaders_and_broadcast_no_table(spark, monkeypatch):
    """Leaders join what is widely close; no staged table of events is broadcast on the size of its file."""
    monkeypatch.setattr(matching, "LEADERS", 3)
    monkeypatch.setattr(matching, "MET", 16)
    plans, kept = [], matching.staged

    def noted(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return kept(df, label)

    monkeypatch.setattr(matching, "staged", noted)
    rng = random.Random(9)
    events = [(b, 100 * b + i, rng.choice("ab") if rng.random() < 0.95 else None, rng.randrange(2000)) for b in (0, 1) for i in range(45) for _ in range(rng.randint(4, 14))]
    base = [("c", rng.randrange(50_000)) for _ in range(20)]
    events += [(1, 300 + i, v, max(0, a + rng.randint(-40, 40))) for i in range(12) for v, a in base]
    frame = spark.createDataFrame(events, "block long, seq long, v string, at long").repartition(5)
    got = {(r["block"], r["seq"]): r["cluster"] for r in matching.near_duplicate_sequences(frame, "block", "seq", "v", "at", 90).collect()}
    assert got == clusters_of(events, 90)
    assert 2 < len(set(got.values())) < 60
    assert not [label for label, plan in plans if "BroadcastExchange" in plan and label != "edges"]


@pytest.mark.parametrize("block", [16, 4096])
def test_best_match_with_nulls_negatives_copies_and_many_blocks(spark, monkeypatch, block):
    """Deltas from null are zero and those of negatives negative, as in the SQL; copies and blocks change nothing."""
    from tessella.operators import composite

    monkeypatch.setattr(composite, "BLOCK", block)
    monkeypatch.setattr(composite, "MET", 40)
    rng = random.Random(12)
    rows = []
    for i in range(260):
        hist = [rng.randint(0, 6) for _ in range(3)] + [1]
        total = rng.choice([None, 0, -rng.randint(1, 9)]) if i % 20 == 0 else rng.randint(500, 900)
        rows.append((1000 - i, sum(hist), total, None if i % 31 == 0 else rng.randint(9000, 9900), hist))
    rows += [(2000 + i, *rows[i % 3][1:]) for i in range(40)]
    # Nothing but rounding parts these, so the smallest id is the match of all.
    rows += [(3000 + i, 900, 800, 10**13 - i, [300, 300, 299, 1]) for i in range(30)]
    frame = spark.createDataFrame(rows, "id long, n long, total long, span long, hist array<long>").repartition(4)
    weights = {"n": 1.0, "total": 0.5, "span": 0.3}

    def delta(a, b):
        return 0 if a is None or b is None or not max(a, b) else abs(a - b) / max(a, b)

    def score(a, b):
        return round(sum(w * delta(a[k], b[k]) for w, k in ((1.0, 1), (0.5, 2), (0.3, 3))) + 2.0 * (sum(abs(x - y) for x, y in zip(a[4], b[4])) / (a[1] + b[1])), 9)

    got = {r["id"]: (r["score"], r["match_id"]) for r in matching.best_match(frame, frame, "id", "id", weights, "n", "hist", 2.0, "total").collect()}
    wanted = {a[0]: min((score(a, b), b[0]) for b in rows if b[0] != a[0]) for a in rows}
    assert got.keys() == wanted.keys()
    assert {i: (g, wanted[i]) for i, g in got.items() if g != wanted[i]} == {}
    # Two tables that share ids: a row is no match of its own id, whatever its columns.
    some, moved = rows[:60], [(a[0] + 1, *a[1:]) for a in rows[:60]]
    frames = [spark.createDataFrame(r, frame.schema) for r in (some, moved)]
    got = {r["id"]: (r["score"], r["match_id"]) for r in matching.best_match(*frames, "id", "id", weights, "n", "hist", 2.0, "total").collect()}
    assert got == {a[0]: min((score(a, b), b[0]) for b in moved if b[0] != a[0]) for a in some}
