import numpy as np
import xxhash

from tessella.llm import simhash


def brute(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_match_brute_force(docs, rows):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    prints = {(r[0], r[1]): brute(r[1]) for r in rows}
    assert sorted(np.int64(np.uint64(v)) for v in (prints[(r[0], r[1])] for r in rows)) == sorted(r["fingerprint"] for r in got)
    nodes = sorted(set(prints.values()))
    linked = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if (a ^ b).bit_count() <= 3]
    of = groups(nodes, linked)
    least = {}
    for (doc_id, _), p in prints.items():
        if doc_id is not None:
            least[of[p]] = min(doc_id, least.get(of[p], doc_id))
    for r in got:
        assert r["component_id"] == least[of[int(np.uint64(np.int64(r["fingerprint"])))]]


def test_empty_table(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.similar_documents(empty).count() == 0


def test_every_link_of_dense_and_skewed_fingerprints_is_found(spark):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    values = {int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for c in centre for _ in range(200)}
    # A third shares the lower 40 bits.
    values |= {(int(rng.integers(0, 1 << 20)) << 40) | 0x1234567890 for _ in range(150)}
    values = sorted(values)
    signed = [int(np.int64(np.uint64(v))) for v in values]
    frame = spark.createDataFrame([(s, s) for s in signed], "id long, w0 long")
    got = groups(signed, [(r["a"], r["b"]) for r in simhash.links(frame, ["w0"]).collect()])
    real = groups(signed, [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3])
    assert got == real


def test_plan_allocates_unequal_thresholds():
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 1 << 63, (300, 1), dtype=np.uint64) & np.uint64(0xFFFFFFFF0000FFFF)
    plan = simhash.plan_join(sample, 10**9)
    assert sum(plan.thresholds) == simhash.DISTANCE - len(plan.parts) + 1
    assert sorted(b for p in plan.parts for b in p) == list(range(64))


def test_similar_documents_links_edits_and_spares_others(docs, rows):
    of = {(r["did"], r["th"]): r["component"] for r in simhash.similar_documents(docs).collect()}
    by_id = {}
    for (did, _), c in of.items():
        by_id.setdefault(did, c)
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    ids = {t: i for i, t in reversed(list(texts.items()))}

    def jaccard(a, b):
        def cut(t):
            w = t.lower().split()
            return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

        x, y = cut(a or ""), cut(b or "")
        return len(x & y) / max(1, len(x | y))

    own = [(i, t) for t, i in ids.items() if t and len(t.split()) > 30]
    hits = misses = 0
    for k, (i, a) in enumerate(own):
        for j, b in own[k + 1 :]:
            if jaccard(a, b) >= 0.85:
                hits += by_id[i] == by_id[j]
                misses += by_id[i] != by_id[j]
            elif jaccard(a, b) < 0.3:
                assert by_id[i] != by_id[j]
    assert hits and not misses


def linked_groups(texts, similarity=0.8):
    """Groups by brute force over all pairs."""

    def cut(t):
        w = t.encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [cut(t) for t in texts]
    near = []
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            shared = len(a & sets[j])
            if shared >= similarity * (len(a) + len(sets[j]) - shared):
                near.append((i, j))
    return groups(range(len(texts)), near), near


def found_groups(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    of = {r["did"]: r["component"] for r in simhash.similar_documents(frame).collect()}
    least = {}
    for i in range(len(texts)):
        least.setdefault(of[i], i)
    return {i: least[of[i]] for i in range(len(texts))}


def words(rng, n):
    return [f"w{k}" for k in rng.integers(0, 1 << 40, n)]


def test_edited_copies_of_a_dense_group_are_all_found(spark):
    rng = np.random.default_rng(5)
    texts = []
    for copies, length, edits in ((300, 200, 3), (60, 400, 6)):
        base = words(rng, length)
        texts.append(" ".join(base))
        for _ in range(copies):
            own = list(base)
            for at in rng.choice(np.arange(10, length - 10), edits, replace=False):
                own[at] = words(rng, 1)[0]
            texts.append(" ".join(own))
    texts += [" ".join(words(rng, 120)) for _ in range(20)]
    wanted, _ = linked_groups(texts)
    # Copies reach one another by their base only.
    assert sum(i == g for i, g in wanted.items()) < 30
    assert found_groups(spark, texts) == wanted


def test_contiguous_changes_near_the_threshold_are_all_found(spark):
    rng = np.random.default_rng(6)
    texts = []
    for _ in range(25):
        base = words(rng, 200)
        texts += [" ".join(base), " ".join(base + words(rng, 46))]
        base = words(rng, 246)
        texts += [" ".join(base), " ".join(base[:200])]
        base = words(rng, 200)
        texts += [" ".join(base), " ".join(base[:90] + words(rng, 17) + base[107:])]
        base = words(rng, 200)
        texts += [" ".join(base), " ".join(base + words(rng, 60))]
    # One line that many texts share, more than makes a dense bucket.
    line = words(rng, 12)
    texts += [" ".join(line + words(rng, int(n))) for n in rng.integers(1, 40, 60)]
    wanted, near = linked_groups(texts)
    assert len(near) >= 75
    assert found_groups(spark, texts) == wanted


def test_prefix_and_exact_forest_match_brute_force():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 60, 60)
    sets = [np.unique(np.concatenate([rng.choice(base, 55, replace=False), rng.integers(0, 1 << 60, rng.integers(0, 8))])) for _ in range(80)]
    common = np.sort(base)[::2]
    near = []
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            shared = len(np.intersect1d(a, sets[j]))
            if shared >= 0.8 * (len(a) + len(sets[j]) - shared):
                near.append((i, j))
                heads = [simhash.prefix(s, 0.8, common, np.arange(len(common)) % 7 + 1) for s in (a, sets[j])]
                assert len(np.intersect1d(*heads))
    assert near
    assert groups(range(80), simhash.exact_forest(sets, 0.8)) == groups(range(80), near)
