"""Library operators on small fixtures with nulls, ties and empty inputs."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import events as ev
from tessella.functions import lm_events
from tessella.operators import joins, packing, ranking, sampling, stats, text, windows
from tessella.sources import readers
from tessella.streaming import windows as streaming


def greedy(costs, budget, prefix=0, skip=False):
    out, now = [], None
    for pos, cost in enumerate(costs):
        if skip and cost + prefix > budget:
            if now:
                out.append(now)
            now = None
        elif now and now[3] + cost <= budget:
            now = (now[0], pos, now[2] + 1, now[3] + cost)
        else:
            if now:
                out.append(now)
            now = (pos, pos, 1, cost + prefix)
    return out + ([now] if now else [])


@pytest.mark.parametrize("prefix,skip", [(0, False), (3, False), (2, True)])
def test_greedy_pack(spark, prefix, skip):
    rng = random.Random(1)
    data = {g: [rng.randint(0, 14) for _ in range(rng.randint(1, 40))] for g in range(20)}
    frame = spark.createDataFrame([(g, p, c) for g, cs in data.items() for p, c in enumerate(cs)], "g int, p int, c int").repartition(4)
    got = packing.greedy_pack(frame, ["g"], F.col("p"), F.col("c"), 10, prefix, skip).collect()
    for g, costs in data.items():
        own = sorted((r["chunk_id"], (r["first"], r["last"], r["items"], r["tokens"])) for r in got if r["g"] == g)
        assert [x for _, x in own] == greedy(costs, 10, prefix, skip)


def test_accept_while_fits(spark):
    frame = spark.createDataFrame([([(1, 4), (2, 9), (3, 3), (4, 4), (5, 3)],)], "xs array<struct<id: long, cost: long>>")
    assert frame.select(packing.accept_while_fits(F.col("xs"), F.lit(10)).alias("ids")).first()["ids"] == [1, 3, 5]


def test_running_sum_does_not_depend_on_partitioning(spark):
    rows = [(i, (i * 7) % 11) for i in range(500)]
    frame = spark.createDataFrame(rows, "id int, v int").repartition(7)
    got = {r["id"]: r["before"] for r in ranking.running_sum(frame, F.col("v"), ["id"], F.floor(F.col("id") / 50)).collect()}
    total = 0
    for i, v in rows:
        assert got[i] == total
        total += v
    ranked = ranking.hash_ranked(frame, "s", "id").orderBy("hash_key").collect()
    assert [r["hash_rank"] for r in ranked] == list(range(500))


@pytest.mark.parametrize("n,parts", [(10, 3), (2, 5), (7, 7), (100, 6)])
def test_even_parts(spark, n, parts):
    got = sampling.even_rounds(spark.range(n).withColumnRenamed("id", "k"), "k", "x", parts).groupBy("round").count().collect()
    sizes = {r["round"]: r["count"] for r in got}
    assert [sizes.get(i, 0) for i in range(parts)] == [n // parts + (i < n % parts) for i in range(parts)]


def test_equal_budgets(spark):
    frame = spark.createDataFrame([("a", 1), ("b", 5), ("c", 100), ("d", 100)], "g string, n long")
    got = {r["g"]: r["granted"] for r in sampling.equal_budgets(frame, "g", "n", 47).collect()}
    assert got == {"a": 1, "b": 5, "c": 21, "d": 20}
    assert {r["g"]: r["granted"] for r in sampling.equal_budgets(frame, "g", "n", 1000).collect()} == {"a": 1, "b": 5, "c": 100, "d": 100}


def test_windows(spark):
    rows = [(1, 1, "x", 5), (1, 2, "m", 5), (1, 3, "x", 9), (1, 4, "x", 3), (1, 5, "m", 30), (2, 1, "x", None)]
    frame = spark.createDataFrame(rows, "k int, p int, e string, t int")
    assert [(r["p"], r["segment"]) for r in windows.segment_at_marker(frame, ["k"], ["p"], F.col("e") == "m").orderBy("p").collect()] == [(2, 0), (3, 0), (4, 0), (5, 1)]
    assert [r["delta"] for r in windows.delta_from_previous(frame, ["k"], ["p"], F.col("t")).orderBy("k", "p").collect()] == [0, 0, 4, 0, 27, 0]
    back = windows.asof_backward(frame, ["k"], ["p"], F.col("e") == "m", F.col("t")).orderBy("k", "p").collect()
    assert [r["anchor_value"] for r in back] == [None, 5, 5, 5, 30, None]
    ahead = windows.asof_forward(frame, ["k"], ["p"], F.col("e") == "m", F.col("t")).orderBy("k", "p").collect()
    assert [r["anchor_value"] for r in ahead] == [5, 5, 30, 30, 30, None]
    assert windows.collapse_repeats(frame, ["k"], ["p"], "e").count() == 5
    assert [r["session"] for r in windows.gap_sessions(frame, ["k"], ["p"], F.col("t"), 10).orderBy("k", "p").collect()] == [0, 0, 0, 0, 1, 0]
    sparse = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, 2.0, None, None, 8.0, None])] + [(2, 0, None)], "k int, p int, v double")
    assert [r["filled"] for r in windows.interpolate(sparse, ["k"], "p", "v").orderBy("k", "p").collect()] == [2, 2, 4, 6, 8, 8, None]
    assert windows.take_while(frame, ["k"], ["p"], F.col("e") == "x").count() == 2


def test_range_join_and_nearest(spark):
    rng = random.Random(3)
    points = [(i % 3, i, rng.randint(0, 100)) for i in range(80)]
    spans = [(i % 3, i, a, a + rng.randint(1, 40)) for i in range(20) for a in [rng.randint(0, 90)]]
    p, s = spark.createDataFrame(points, "k int, id int, at int"), spark.createDataFrame(spans, "k int, sid int, a int, b int")
    got = sorted((r["id"], r["sid"]) for r in joins.range_join(p, s, ["k"], "at", "a", "b", 7).collect())
    assert got == sorted((i, j) for k, i, at in points for q, j, a, b in spans if k == q and a <= at < b)
    right = spark.createDataFrame([(k, i + 100, at + 1) for k, i, at in points[:30] if k < 2], "k int, rid int, at int")
    near = {r["id"]: (r["distance"], r["match_id"]) for r in joins.nearest(p, right, ["k"], "at", "rid").collect()}
    other = [(k, i + 100, at + 1) for k, i, at in points[:30] if k < 2]
    for k, i, at in points:
        own = [(float(abs(at - v)), j) for q, j, v in other if q == k]
        assert near[i] == (min(own) if own else (None, None))


def test_similar_pairs_loses_none(spark):
    rng = random.Random(5)
    base = [sorted(rng.sample(range(400), 40)) for _ in range(12)]
    sets = base + [sorted(set(b[:-3]) | {401 + i, 500}) for i, b in enumerate(base)] + [[1], [1], []]
    frame = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in enumerate(sets)], "id int, items array<string>")
    got = {(r["a"], r["b"]) for r in joins.similar_pairs(frame, "id", "items", 0.8).collect()}
    own = [set(map(str, s)) for s in sets]
    assert got == {(i, j) for i in range(len(own)) for j in range(i + 1, len(own)) if own[i] | own[j] and len(own[i] & own[j]) / len(own[i] | own[j]) >= 0.8}


def test_positional_audit(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, None)], "k int, p int, v string")
    b = spark.createDataFrame([(1, 1, "x"), (1, 2, "z"), (1, 3, "w"), (2, 1, None)], "k int, p int, v string")
    got = {(r["k"], r["ordinal"]): r["status"] for r in joins.positional_audit(a, b, ["k"], ["p"], "v").collect()}
    assert got == {(1, 1): "ok", (1, 2): "changed", (1, 3): "extra", (2, 1): "ok"}


def test_rank_percentiles(spark):
    values = [5, 1, 1, 9, 7, 7, 7, 3, 2, 8]
    frame = spark.createDataFrame([("g", v) for v in values] + [("g", None), ("h", 4)], "g string, v int")
    got = {r["g"]: r for r in stats.rank_percentiles(frame, ["g"], "v", {r: (r, 0.9) for r in stats.RULES}).collect()}
    ordered = sorted(values)
    assert (got["g"]["floor"], got["g"]["clamped"], got["g"]["inner"], got["g"]["ceil"]) == (ordered[9], ordered[9], ordered[8], ordered[8])
    assert got["h"]["clamped"] == 4


def test_text(spark):
    html = "<html><script>var a='</p>';</script><p>A   long enough line of text</p><p>short</p><style>x{}</style></html>"
    frame = spark.createDataFrame([(html, "a  b\tc"), (None, None), ("", "")], "h string, t string")
    got = frame.select(text.html_to_text(F.col("h")).alias("x"), text.word_count(F.col("t")).alias("n"), text.token_count(F.lit("<N001><V002> two words")).alias("k")).collect()
    assert [(r["x"], r["n"]) for r in got] == [("A long enough line of text", 3), (None, 0), ("", 0)] and got[0]["k"] == 4


def test_pitch_names_round_trip(spark):
    got = spark.range(128).select("id", ev.pitch_name(F.col("id")).alias("n")).select("id", "n", ev.name_pitch(F.col("n")).alias("b"), ev.name_pitch(F.concat("n", F.lit("L"))).alias("l")).collect()
    assert all(r["b"] == r["id"] == r["l"] for r in got) and got[60]["n"] == "C3"
    assert spark.createDataFrame([("H3",), ("C99",), ("",)], "n string").select(ev.name_pitch(F.col("n")).alias("p")).where("p IS NOT NULL").count() == 0


def test_event_text_round_trip(spark):
    rows = [(1, 0, "H", 0, 2, 41), (1, 1, "M", 0, 0, 127), (1, 2, "F3", 50, 151, 0), (1, 3, "P", 64, 0, 300), (1, 4, "A#3", 56, 616, 1000), (1, 5, "PED_SOFT", 1, 0, 0), (1, 6, "C3", 1, 300, 2)]
    frame = spark.createDataFrame(rows, "k int, p int, event string, value int, duration int, offset int")
    pieces = lm_events.piece_text(frame.withColumn("tokens", lm_events.row_tokens(*[F.col(c) for c in ("event", "value", "duration", "offset")])), ["k"], ["p"])
    tokens = pieces.first()["text"]
    assert tokens.startswith("<MIDI><H><V000><T002><T041><M><V000><T000><T127><N065><V050><T151><T000><EXO><NIL><T001><T044><P><V064><NIL><EXT>")
    assert "<EXD><NIL><T002><T104><EXO><NIL><T003><T232><N070><V056><EXT><EXT>" in tokens
    back = lm_events.decode(pieces, ["k"], "text").orderBy("pos").collect()
    assert [(r["event"], r["value"], r["duration"], r["offset"], r["error"]) for r in back] == [(e if e != "PED_SOFT" else "P1", v, d, o, None) for _, _, e, v, d, o in rows]
    cut = spark.createDataFrame([(1, tokens[: tokens.rindex("<T")])], "k int, text string")
    assert lm_events.decode(cut, ["k"], "text").where("error = 'incomplete'").count() == 1
    assert len(lm_events.full_vocabulary()) == 524


def test_event_rows_are_validated(spark):
    lines = "# head\n\nH\t0\t2\t41\nC3\t50\tEXT\t0\nC3\t200\t1\t0\nP\t1\t5\t0\nEXD\t0\t2\t104\nZZ\t0\t0\t0\nC3\t1\t2"
    got = readers.event_rows(spark.createDataFrame([("f", lines)], "path string, t string"), ["path"], "t").orderBy("pos").collect()
    assert [r["error"] for r in got] == [None, None, "value out of range", "pedal duration must be 0", None, "unknown event", "not four columns"]


def test_readers_and_writers(spark, tmp_path):
    frame = spark.createDataFrame([("a,b", None, 3), ('q"x', "y\nz", 4)], "s string, t string, n int")
    readers.write_csv(frame, f"{tmp_path}/c", ["s", "t", "n"])
    back = readers.read_csv_strings(spark, f"{tmp_path}/c", ["s", "t", "n"])
    assert sorted((r["s"], r["t"], r["n"]) for r in back.collect()) == [("a,b", None, "3"), ('q"x', "y\nz", "4")]
    assert readers.read_csv_typed(spark, f"{tmp_path}/c", "s string, t string, n int").agg(F.sum("n")).first()[0] == 7
    assert readers.write_jsonl(frame, f"{tmp_path}/j", "n") == {"rows": 2, "tokens": 7, "max_tokens": 4}
    assert readers.read_records(spark, f"{tmp_path}/j", "s string, n int").count() == 2
    (tmp_path / "array.json").write_text('[{"s": "x"}, {"s": "y"}]')
    assert readers.read_records(spark, f"{tmp_path}/array.json", "s string").count() == 2
    readers.write_partitioned(frame.withColumn("split", F.lit("train")), f"{tmp_path}/p", ["split"])
    assert spark.read.json(f"{tmp_path}/p").count() == 2
    good, bad = readers.split_errors(spark.createDataFrame([(1, None), (2, "e")], "i int, error string"))
    assert (good.count(), bad.count()) == (1, 1)
    with pytest.raises(ValueError):
        readers.check_columns(frame, ["missing"])
    assert readers.aligned_to(frame, spark.createDataFrame([], "n long, other string, s string")).columns == ["n", "other", "s"]
    (tmp_path / "e.tsv").write_text("H\t0\t2\t41\n")
    assert readers.read_event_files(spark, f"{tmp_path}/e.tsv").first()["event"] == "H"
    tasks = spark.createDataFrame([(1, "x", "y"), (2, "z", None)], "id int, a string, b string")
    found = {r["id"]: r["resolved"] for r in readers.first_existing(tasks, "id", ["a", "b"], spark.createDataFrame([("y",)], "path string")).collect()}
    assert found == {1: "y", 2: None}


def test_streaming_windows(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:0{m}:00") for m in (0, 1, 4, 9)] + [("b", "2024-01-01 00:02:00")]
    spark.createDataFrame(rows, "k string, t string").selectExpr("k", "cast(t as timestamp) AS ts").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, ts timestamp").parquet(f"{tmp_path}/in")
    counted = streaming.windowed_counts(stream, "ts", ["k"], "1 minute", "5 minutes")
    q = counted.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["k"], r["n"]) for r in spark.table("counts").collect()) == [("a", 1), ("a", 3), ("b", 1)]


def test_repair_counts_scan_the_tokens_once(spark):
    """Counts and sums come from one pass; pieces without tokens and with a dangling part are rows."""
    from tessella.functions import lm_events

    texts = ["<EXD><NIL><T001><T002><N060><V064><EXT><T005><P><V010><NIL><EXT>", "<N060><V064>", "", None, "<N999><V001><T001><T001><M><V001><T001><T000><T001>"]
    frame = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    counted = lm_events.repair_counts(frame, ["k"], "text")
    assert counted._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {r["k"]: tuple(r)[1:] for r in counted.collect()}
    assert got[0] == (12, 0, 1, 0, 1, 1, 0, 0, 1, 258, 260)
    assert got[1] == (2, 2) + (0,) * 9 and got[2] == got[3] == (0,) * 11
    assert got[4] == (9, 1, 0, 1, 0, 0, 1, 0, 0, 256, 0)


def test_markdown_chunks_sort_the_lines_for_few_windows(spark):
    """The sums of sections and blocks need no sort of the lines each; the chunks of a null key stay."""
    from tessella.operators import markdown

    text = "# a\n\none two three\n\n```py\nx y z\nu v w\n```\n### b\nfour five\n\nsix seven eight nine ten"
    frame = spark.createDataFrame([(1, text), (None, "## t\nw1 w2"), (2, None)], "k long, md string")
    chunks = markdown.markdown_chunks(frame, "k", "md", 5)
    rows = sorted((r["k"] or 0, r["chunk_id"], r["num_tokens"], r["chunk"]) for r in chunks.collect())
    assert rows[0] == (0, 0, 4, "## t\nw1 w2")
    assert [r[3] for r in rows if "```" in r[3]] == ["```py\nx y z\n```", "```py\nu v w\n```"]
    assert all(r[2] <= 5 for r in rows)
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert "Window [first(line" not in plan and plan.count("Window [sum(n_words") == 0


def test_refined_times_join_no_groups_by_number(spark):
    """Ranges and groups of a key meet in one order; nulls and missing groups keep the nominal times."""
    from tessella.operators import windows

    ranges = spark.createDataFrame([("a", 1, 0, 1, 10), ("a", 2, None, None, 5), ("a", 3, 2, 4, 7), ("b", 1, 0, 0, 4), (None, 1, 0, 0, 3)], "k string, i long, first_group long, last_group long, nominal long")
    groups = spark.createDataFrame([("a", 0, 0), ("a", 1, 20), ("a", 2, 50), ("a", 4, 90), ("a", 5, 91), ("b", 3, 8), (None, 0, 50)], "k string, g long, at long")
    refined = windows.refined_times(ranges, groups, ["k"], "i", "nominal", "g", "at")
    assert {(r["k"], r["i"]): (r["start"], r["end"]) for r in refined.collect()} == {("a", 1): (0, 40), ("a", 2): (40, 45), ("a", 3): (45, 130), ("b", 1): (0, 4), (None, 1): (0, 3)}
    assert "Join" not in refined._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("counters", [1, 64])
def test_similar_pairs_shuffle_heads_only(spark, monkeypatch, counters):
    """Whatever the order of the items tells, no pair is lost, and fewer rows than the items are shuffled in all."""
    monkeypatch.setattr(joins, "COUNTERS", counters, raising=False)
    rng = random.Random(9)
    own = [set(rng.sample(range(100_000), 200)) | set(range(30)) for _ in range(120)]
    own += [set(list(s)[: rng.randint(150, 230)]) | {200_000 + 40 * i + k for k in range(rng.randint(0, 40))} for i, s in enumerate(own[:60])]
    own += [set(rng.sample(range(8), rng.randint(1, 6))) for _ in range(40)]
    frame = spark.createDataFrame([(i, list(s)) for i, s in enumerate(own)], "id long, items array<long>").repartition(3).cache()
    frame.count()
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = shuffled()
    got = {(r["a"], r["b"]): (r["shared"], r["jaccard"]) for r in joins.similar_pairs(frame, "id", "items", 0.8).collect()}
    pairs = [(i, j, len(own[i] & own[j])) for i in range(len(own)) for j in range(i + 1, len(own))]
    assert got == {(i, j): (n, n / len(own[i] | own[j])) for i, j, n in pairs if n / len(own[i] | own[j]) >= 0.8}
    assert any(j >= 120 for _, j in got) and shuffled() - before < sum(map(len, own))
