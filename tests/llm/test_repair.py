import itertools
import random

import duckdb
import pandas as pd
import pytest

from tessella.llm import queries, repair


def cheapest(codes):
    """Least (cost, edits) by dynamic programming over messages and last roles."""

    def least(a, b):
        return b if a is None else a if b is None else min(a, b)

    def closed(state):
        for _ in range(3):
            new = list(state)
            for q, known in enumerate(state):
                if known:
                    new[repair.NEXT[q]] = least(new[repair.NEXT[q]], (known[0] + 3, known[1] + "I"))
            state = new
        return state

    state = [(0, ""), None, None, None]
    for code in codes:
        new = [None] * 4
        for q, known in enumerate(closed(state)):
            if known is None:
                continue
            cost, edits = known
            new[q] = least(new[q], (cost + 4, edits + "D"))
            if code == "x":
                continue
            cut = 3 if code.isupper() else 0
            new[repair.NEXT[q]] = least(new[repair.NEXT[q]], (cost + 3 + cut, edits + "R"))
            role = {"s": 1, "u": 2, "a": 3}.get(code.lower())
            if (role == 1 and q == 0) or (role == 2 and q in (0, 1, 3)) or (role == 3 and q == 2):
                new[role] = least(new[role], (cost + cut, edits + "K"))
        state = new
    state = closed(state)
    return least(state[0], state[3])


def noisy(rng, n, noise):
    codes, role = ["s"] if rng.random() < 0.3 else [], "u"
    for _ in range(n):
        codes.append(rng.choice("suaoSUAOx") if rng.random() < noise else role)
        if rng.random() > noise / 4:
            role = "a" if role == "u" else "u"
    return "".join(codes)


def test_search_is_optimal_on_all_short_conversations():
    for n in range(4):
        for codes in itertools.product("suaoSUAOx", repeat=n):
            assert repair.cheapest_edits("".join(codes)) == cheapest(codes)


@pytest.mark.parametrize("noise", [0.05, 0.2, 0.6, 1])
def test_search_and_stretches_are_optimal(noise):
    rng = random.Random(int(noise * 100))
    for n in [rng.randint(0, 60) for _ in range(80)] + [400]:
        codes = noisy(rng, n, noise)
        wanted = cheapest(codes)
        assert repair.cheapest_edits(codes) == wanted
        assert "".join(repair.settled_edits(codes)) == wanted[1]


def test_stretches_are_short_where_a_conversation_is_sound():
    longest = []

    def spy(codes, *more):
        longest.append(len(codes))
        return original(codes, *more)

    original, repair.cheapest_edits = repair.cheapest_edits, spy
    try:
        edits = "".join(repair.settled_edits("ua" * 5000 + "u" + "ua" * 5000))
    finally:
        repair.cheapest_edits = original
    assert edits.replace("K", "") == "I" and len(edits) == 20002
    assert max(longest) < 40


def test_bounds_never_exceed_the_cost():
    rng = random.Random(9)
    for _ in range(200):
        codes = noisy(rng, rng.randint(0, 12), 0.7)
        bound = repair.bounds(codes, None)
        for i in range(len(codes) + 1):
            assert bound[i][0] <= cheapest(codes[i:])[0]


ROWS = [
    (1, 0, "user", "Hello there."), (1, 1, "assistant", "Yes."), (1, 2, "user", "More?"), (1, 3, "assistant", "cut off"), (1, 3, "assistant", "cut off"),
    (2, None, "user", None), (2, 5, None, "Who is this."), (2, 5, "tool", "A tool."), (2, 9, "", ""), (2, 9, "assistant", " \t\n"),
    (None, 1, "system", "Be brief."), (None, 2, "assistant", "Odd."), (None, None, "user", "Null turn."),
    (4, None, None, None), (5, None, "assistant", "x" * 100_000 + ".  "), (5, 7, "system", "late."), (6, 2, "Été", "Ça va!"), (6, 4, "user", "ok.\x1c"),
] + [(7, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(120)] + [(8, t, "user", f"Say {t}") for t in range(40)]
SCHEMA = "conv_id long, turn long, role string, text string, fault string, step int"


def test_query_matches_its_oracle_on_odd_rows(spark, tmp_path):
    frame = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], SCHEMA).repartition(3)
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    key = ["audit", "cost", "repaired_sha256", "conv_id"]
    got = queries.op11_repair(spark, str(tmp_path)).toPandas()
    wanted = con.execute(queries.ORACLES["op11_repair"]).df()
    columns = sorted(wanted.columns)
    assert columns == sorted(got.columns) and len(got) == 8
    tidy = [d[columns].astype(object).where(d.notna(), None).map(lambda v: str(int(v)) if isinstance(v, float) else str(v)).sort_values(key).reset_index(drop=True) for d in (got, wanted)]
    pd.testing.assert_frame_equal(*tidy)


def test_edits_of_a_conversation(spark):
    frame = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "assistant", ""), (1, 2, "user", "Bye.")], "conv_id long, turn long, role string, text string")
    edits = [tuple(r) for r in repair.repair_conversations(frame).collect()]
    assert [(e[2], e[6], e[7]) for e in edits] == [("I", "user", ""), ("K", "assistant", "Hi."), ("D", None, None), ("K", "user", "Bye."), ("I", "assistant", "")]
    digest = repair.digest_repairs(repair.repair_conversations(frame)).first()
    assert (digest["cost"], digest["blank"], digest["illegal"], digest["gaps"]) == (10, 1, 1, 0)


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.digest_repairs(repair.repair_conversations(repair.damage(none))).count() == 0
