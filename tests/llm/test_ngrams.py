import numpy as np
import pytest

from tessella.llm import ngrams, setjoin

from test_simhash import groups, words


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def near(a, b):
    return 100 * len(a & b) >= 90 * len(a | b)


def brute(rows):
    """(doc_id, size, component) of rows (doc_id, text) by comparing all pairs of sets."""
    sets = [shingle_set(t) for _, t in rows]
    full = [i for i, s in enumerate(sets) if s]
    of = groups(full, [(i, j) for k, i in enumerate(full) for j in full[k + 1 :] if near(sets[i], sets[j])])
    least = {}
    for i in full:
        if rows[i][0] is not None:
            least[of[i]] = min(rows[i][0], least.get(of[i], rows[i][0]))
    return sorted(((d, len(s), least.get(of[i]) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def found(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return sorted((tuple(r) for r in ngrams.jaccard_components(frame).collect()), key=str)


def test_components_match_brute_force(docs, rows):
    got = sorted((tuple(r) for r in ngrams.jaccard_components(docs).collect()), key=str)
    assert got == brute([r[:2] for r in rows])


def texts_near_the_threshold(rng):
    texts = []
    # Pairs a little over and under 0.9: the end is changed, cut or continued by few words.
    for n in (9, 10, 11, 20, 40, 100, 300, 1000):
        for share in (0.02, 0.045, 0.05, 0.053, 0.06, 0.1, 0.111):
            base = words(rng, n)
            k = max(1, round(n * share))
            texts += [" ".join(base), " ".join(base[:-k] + words(rng, k)), " ".join(base[:-k]), " ".join(base + words(rng, k))]
    # One line in many texts, and a chain whose ends are far apart.
    line = words(rng, 30)
    texts += [" ".join(line + words(rng, int(k))) for k in rng.integers(0, 6, 60)]
    base = words(rng, 200)
    for _ in range(12):
        base = base[4:] + words(rng, 4)
        texts.append(" ".join(base))
    return texts


def test_links_near_the_threshold(spark):
    rows = list(enumerate(texts_near_the_threshold(np.random.default_rng(1))))
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("searched,filtered", [(16, 8), (1 << 13, 8)])
def test_large_groups_in_blocks(spark, monkeypatch, searched, filtered):
    """Groups that no task may hold: near copies, and others that leaders leave apart."""
    monkeypatch.setattr(setjoin, "SEARCHED", searched)
    monkeypatch.setattr(setjoin, "FILTERED", filtered)
    monkeypatch.setattr(setjoin, "LEADERS", 2)
    rng = np.random.default_rng(2)
    base, texts = words(rng, 300), []
    for _ in range(90):
        own = list(base)
        for at in rng.choice(300, int(rng.integers(1, 9)), replace=False):
            own[at] = words(rng, 1)[0]
        texts.append(" ".join(own))
    rows = list(enumerate(texts + texts_near_the_threshold(rng)[:60]))
    assert found(spark, rows) == brute(rows)


def test_tree_finds_the_groups_of_all_pairs_and_prunes():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(150):
        n = int(rng.integers(5, 400))
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        sets.append(np.unique(base))
        for _ in range(int(rng.integers(0, 4))):
            sets.append(np.unique(np.concatenate([base[: -max(1, n // 25)], rng.integers(0, 1 << 63, max(1, n // 25), dtype=np.uint64)])))
    sizes = np.array([len(s) for s in sets])
    points = ngrams.read_counts(np.stack([ngrams.count_vector(s) for s in sets]))
    assert (points.sum(axis=1) == sizes).all()
    pairs = [
        (i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
        if ngrams.near_counts(sizes[[i]], sizes[[j]], points[[i]], points[[j]], 0.9)[0]
    ]
    for i, j in pairs:
        assert np.minimum(points[i], points[j]).sum() >= len(np.intersect1d(sets[i], sets[j]))
    assert all((i, j) in set(pairs) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 10 * len(np.intersect1d(sets[i], sets[j])) >= 9 * len(np.union1d(sets[i], sets[j])))
    got = ngrams.candidate_groups(sizes, points, 0.9)
    assert sorted(sorted(g.tolist()) for g in got) == sorted(
        sorted(members) for members in _members(groups(range(len(sets)), pairs)) if len(members) > 1
    )
    tree = ngrams.CountTree(sizes, points)
    for place in range(len(sets)):
        tree.near(place, 0.9)
    assert tree.visited < 0.35 * len(sets) ** 2


def _members(of):
    found = {}
    for i, g in of.items():
        found.setdefault(g, []).append(i)
    return found.values()


def test_counts_that_were_cut_off_bound_nothing():
    rng = np.random.default_rng(4)
    one = rng.integers(0, 1 << 63, 60_000, dtype=np.uint64)
    other = np.concatenate([one[:58_000], rng.integers(0, 1 << 63, 2_000, dtype=np.uint64)])
    points = ngrams.read_counts(np.stack([ngrams.count_vector(np.unique(s)) for s in (one, other)]))
    assert ngrams.near_counts(np.array([60_000]), np.array([60_000]), points[[0]], points[[1]], 0.9)[0]


def test_empty_table(empty):
    assert ngrams.jaccard_components(empty).count() == 0
