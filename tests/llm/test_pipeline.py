"""The corpus pipeline stage by stage against brute force."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import mixing, secrets, toxicity
from tessella.llm.common import documents, staged

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    docs = documents(spark, DATA)
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, DATA), f"test-{name}")
        out[name] = docs
    return {k: v.toPandas() for k, v in out.items()}


def test_stages_keep_the_columns_of_documents(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "secrets", "mixing", "packing"]
    for name in names[:-1]:
        assert sorted(stages[name].columns) == sorted(stages["documents"].columns)


def test_toxicity_stage(spark, stages):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").where(~toxicity.held_out(F.col("doc_id")))
    model = toxicity.fit(documents(spark, DATA), labels)
    look = toxicity.TokenScores(model.value, model.weight)
    wanted = {i for i, t in zip(stages["documents"].doc_id, stages["documents"].text) if toxicity.probability(t or "", look, model)[0] < 0.5}
    assert set(stages["toxicity"].doc_id) == wanted


def test_near_duplicate_stage(stages):
    frame = stages["toxicity"]

    def cut(t):
        w = (t or "").encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: cut(t) for i, t in zip(frame.doc_id, frame.text)}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            union = len(sets[a] | sets[b])
            if not union or len(sets[a] & sets[b]) >= 0.8 * union:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert sorted(stages["near_dedup"].doc_id) == sorted({find(i) for i in ids})


def test_near_duplicate_stage_takes_the_links_of_fingerprints(spark):
    """Texts within three bits are linked, also where their sets of shingles are too different to be similar."""
    from tessella.llm import simhash

    line = " ".join(f"w{i % 40}" for i in range(400))
    texts = [f"{line} a{k} " + " ".join(f"x{k}y{i}" for i in range(6 + 8 * k)) for k in range(4)] + ["some other text", "and one more"]
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)]
    prints = [simhash.simhash(t) for t in texts]
    parent = list(range(len(rows)))
    for b in range(len(rows)):
        for a in range(b):
            if bin(prints[a] ^ prints[b]).count("1") <= 3:
                parent = [parent[a] if p == parent[b] else p for p in parent]
    sets = [{" ".join(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts[:4]]
    assert len(sets[0] & sets[3]) < 0.8 * len(sets[0] | sets[3])
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, frame, DATA).collect()} == set(parent) == {0, 4, 5}


def test_secret_stage(stages):
    before = dict(zip(stages["near_dedup"].doc_id, stages["near_dedup"].text))
    after = dict(zip(stages["secrets"].doc_id, stages["secrets"].text))
    assert set(before) == set(after)
    for i, text in before.items():
        spans = sorted((m.start(), m.end()) for r in secrets.RULES for m in re.finditer(r.pattern, text) if len(m.group(r.group)) >= r.least)
        out, at = "", 0
        for a, b in spans:
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        assert after[i] == out + text[at:]


def test_mixing_stage(spark, stages):
    source = stages["secrets"]
    words = {i: WORD.findall(t) for i, t in zip(source.doc_id, source.text)}
    of = dict(zip(source.doc_id, source.source))
    sizes = collections.Counter()
    for i, w in words.items():
        sizes[of[i]] += len(w)
    names = sorted(sizes)
    weights = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    targets, free, rest = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        level = rest / sum(weights[s] for s in free)
        full = {s for s in free if 2 * sizes[s] <= level * weights[s]}
        if not full:
            targets |= {s: level * weights[s] for s in free}
            break
        for s in full:
            targets[s] = 2 * sizes[s]
            rest -= targets[s]
        free -= full
    got = collections.Counter()
    copies = collections.Counter()
    for i, t in zip(stages["mixing"].doc_id, stages["mixing"].text):
        own = WORD.findall(t)
        assert own == words[i][: len(own)]
        got[of[i]] += len(own)
        copies[i] += 1
    assert max(copies.values()) <= 2
    for s in names:
        assert got[s] == pytest.approx(np.floor(targets[s]), abs=1)


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in stages["mixing"].text)
    packed = stages["packing"]
    assert packed.length.sum() == wanted
    for _, g in packed.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 2048


def test_run_repeats_itself(spark, stages):
    again = corpus_pipeline.run(spark, DATA).toPandas()
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, again[key].to_numpy().tolist())) == sorted(map(tuple, stages["packing"][key].to_numpy().tolist()))


def test_stages_take_nulls_repeats_and_clashing_columns(spark, docs, rows):
    now, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = staged(stage(spark, now, DATA), f"edge-{name}")
        kept[name] = now.count()
        if name != "packing":
            assert now.columns == list(corpus_pipeline.COLUMNS)
            now = now.withColumn("spans", F.lit("clash")).withColumn("th", F.lit(1)).withColumn("size", F.lit(2)).withColumn("component", F.lit("c"))
    assert 0 < kept["near_dedup"] < kept["toxicity"] <= len(rows)
    assert kept["secrets"] == kept["near_dedup"] and kept["mixing"] > 0 and kept["packing"] > 0


def test_stages_take_an_empty_table(spark, empty):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0, name
