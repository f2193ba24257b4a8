import hashlib

import numpy as np
import pytest

from tessella.llm import centroids


def brute(rows, k, rounds, dims=8, scale=256):
    kept = [(i, np.floor(np.array(v, float) * scale).astype(np.int64)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1].tolist()))[:k]
    centres = np.array([v for _, v in first])
    vectors = np.array([v for _, v in kept])

    def nearest():
        d = ((vectors[:, None] - centres[None]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        own, _ = nearest()
        for c in set(own.tolist()):
            mine = vectors[own == c]
            centres[c] = [int(s) // len(mine) for s in mine.sum(axis=0)]
    own, d = nearest()
    return sorted(zip([str(i) for i, _ in kept], own.tolist(), d.tolist())), centres


def odd_rows(seed=0, n=200):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 2, (12, 8))
    rows = [(i, (middles[i % 12] + rng.normal(0, 0.2, 8)).tolist()) for i in range(n)]
    # A third is one vector; nulls, other lengths and values that are not finite; repeated rows and ids.
    rows += [(n + i, rows[0][1]) for i in range(n // 2)]
    rows += [(1000, None), (1001, [0.5] * 7), (1002, [0.5] * 9), (1003, [0.1] * 7 + [None]), (1004, [0.1] * 7 + [float("nan")]), (1005, [float("inf")] + [0.1] * 7), (1006, [])]
    rows += [rows[3], (3, rows[4][1]), (None, rows[5][1]), (None, rows[6][1])]
    return rows


SCHEMA = "vec_id long, embedding array<double>, cluster int, d double"


def frame_of(spark, rows):
    return spark.createDataFrame([(i, v, 9, 1.0) for i, v in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("pivots", [1, 5, 100])
def test_clusters_match_brute_force(spark, pivots):
    rows = odd_rows()
    found, final = centroids.cluster_vectors(frame_of(spark, rows), "vec_id", "embedding", 8, count=15, pivots=pivots)
    wanted, centres = brute(rows, 15, 5)
    got = found.collect()
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in got) == wanted
    assert (final == centres).all()
    if pivots == 5:
        assert sum(r["asked"] for r in got) < 0.5 * len(got) * 15
    told = centroids.digest_clusters(found, final, "vec_id").collect()
    assert len(told) == len(got) and {r["inertia"] for r in told} == {sum(d for _, _, d in wanted)}
    for r in told:
        assert r["cluster_inertia"] == sum(d for _, c, d in wanted if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, final[r["cluster"]])).encode()).hexdigest()


def test_ties_take_the_smaller_number_and_empty_centroids_stay(spark):
    rows = [(i, [float(x)] * 8) for i, x in enumerate((0, 0, 0, 2, 2, 4, 1, 3))]
    for k in (1, 3, 8, 40):
        found, final = centroids.cluster_vectors(frame_of(spark, rows), "vec_id", "embedding", 8, count=k)
        wanted, centres = brute(rows, k, 5)
        assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in found.collect()) == wanted and (final == centres).all()


def test_nothing_usable_and_too_large(spark):
    for frame in (frame_of(spark, odd_rows()).limit(0), frame_of(spark, [(1, None), (2, [1.0])])):
        found, final = centroids.cluster_vectors(frame, "vec_id", "embedding", 8)
        assert found.count() == 0 and centroids.digest_clusters(found, final, "vec_id").count() == 0
    with pytest.raises(Exception, match="2\\^27"):
        centroids.cluster_vectors(frame_of(spark, [(1, [1e9] * 8)]), "vec_id", "embedding", 8)


def test_bounds_hold_for_large_values():
    rng = np.random.default_rng(1)
    rows = rng.integers(-(1 << 27), 1 << 27, (300, 64))
    rows[:50] = rows[0] + rng.integers(-2, 3, (50, 64))
    centres = np.concatenate([rows[:20], rng.integers(-(1 << 27), 1 << 27, (20, 64))])
    pivots = centroids.choose_pivots(centres, 6)
    cluster, best, asked = centroids.nearest(rows, centroids.pivot_distances(rows, pivots), centres, centroids.pivot_distances(centres, pivots))
    exact = np.array([[sum((int(x) - int(y)) ** 2 for x, y in zip(r, c)) for c in centres] for r in rows[:60]], dtype=object)
    assert cluster[:60].tolist() == [min(range(40), key=lambda c: (d[c], c)) for d in exact]
    assert best[:60].tolist() == [min(d) for d in exact] and asked <= rows.shape[0] * 40
