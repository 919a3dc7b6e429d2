import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm.embeddings import calibrated_count, collisions, near_duplicates
from attesta.llm.neighbours import search

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, score string"


def rows(n=120, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, dim))
    out = [(i, [float(x) for x in base[i % 12] + rng.normal(size=dim) * (0.1 if i % 3 else 0.6)], i % 2 if i % 11 else None) for i in range(n)]
    out += [(n, None, 0), (n + 1, [0.0] * dim, 0), (n + 2, [float("nan")] + [1.0] * (dim - 1), 0), (n + 3, [None] + [1.0] * (dim - 1), 0), (n + 4, [], 0), (None, out[0][1], 0), (n + 5, out[0][1], 0), (n + 6, out[0][1], 0), (n + 7, [float("inf")] * dim, 0), (n + 8, out[1][1][:5], 1)]
    return [(*r, "x", "y") for r in out]


def valid(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def test_links_equal_brute_force(spark):
    data = rows()
    got = {r.id: r for r in near_duplicates(spark.createDataFrame(data, SCHEMA)).collect() if r.id is not None}
    ok = [(i, np.array(np.float32(v), float), l) for i, v, l, *_ in data if i is not None and l is not None and valid(v)]
    near = {i: [j for j, w, m in ok if j != i and l == m and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93] for i, v, l in ok}
    for i, *_ in data:
        if i is None:
            continue
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in near.get(todo.pop(), []) if j not in seen]
            seen |= set(new)
            todo += new
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(near.get(i, [])), min(seen), min(seen) == i)
    assert max(len(v) for v in near.values()) > 3


def test_repeated_ids_with_different_vectors(spark):
    """Rows of one id are vectors of their own: what is near one of them isn't linked with what is near the other."""
    data = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (7, [1.0, 0.0], 1), (8, [1.0, 0.0], 1), (8, [-1.0, 0.0], 1)]
    got = sorted((r.id, r.n_links, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame([(*r, "x", "y") for r in data], SCHEMA)).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (7, 1, 7, True), (8, 0, 8, True), (8, 1, 7, False)]


def test_tiles_change_nothing(spark):
    from attesta.llm import embeddings

    df = spark.createDataFrame(rows(), SCHEMA)
    whole = sorted(map(str, near_duplicates(df).collect()))
    old = embeddings.TILE
    try:
        embeddings.cosine_links.__defaults__ = (0.93, 16)
        assert sorted(map(str, near_duplicates(df).collect())) == whole
    finally:
        embeddings.cosine_links.__defaults__ = (0.93, old)


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(df).count() == 0 and search(df, df).count() == 0


def test_window_counts():
    rng = np.random.default_rng(3)
    a, b, d = rng.normal(size=(30, 6)), rng.normal(size=(40, 6)), rng.normal(size=(6, 10))
    count = (np.abs((a @ d)[:, None, :] - (b @ d)[None, :, :]) <= 0.7).sum(axis=2)
    i, j = collisions(a, b, 0.7, 5, d)
    assert set(zip(i, j, strict=True)) == set(zip(*np.nonzero(count >= 5), strict=True))
    assert 10 < calibrated_count() < 24


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16)) * rng.uniform(0.5, 2, size=(3000, 1))
    data = [(i, [float(v) for v in x[i]], 0, "a", "b") for i in range(3000)] + [(3000, None, 0, "a", "b"), (3020, [0.0] * 16, 0, "a", "b"), (3040, [float("nan")] * 16, 0, "a", "b")]
    df = spark.createDataFrame(data, SCHEMA)
    got = {}
    for r in search(df, df.where("vec_id % 100 = 0"), 10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    assert set(got) == set(range(0, 3000, 100))
    x, hit = np.array([np.float32(r[1]) for r in data[:3000]], float), 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hit += len({i for i, _ in found} & set(np.argsort(-s)[:10]))
        assert len(found) == 10 and all(score == pytest.approx(s[i], abs=1e-12) for i, score in found) and [c for _, c in found] == sorted((c for _, c in found), reverse=True)
    assert hit / len(got) / 10 >= 0.9


def test_few_candidates_and_ties(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0], 0, "", ""), (5, [2.0, 1.0], 0, "", ""), (3, [2.0, 7.0], 0, "", ""), (3, [2.0, 7.0], 0, "", "")], SCHEMA)
    got = [tuple(r) for r in search(df, df.where("vec_id = 20")).select("query_id", "rank", "id", "score").orderBy("rank").collect()]
    assert got == [(20, 1, 3, 2.0), (20, 2, 5, 2.0)]
    assert search(df, df.where(F.lit(False))).count() == 0


def test_strays_beside_clusters_find_k(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(20, 16))
    x = centre[np.arange(4000) % 20] + rng.normal(size=(4000, 16)) * 0.01
    x[::50] = rng.normal(size=(80, 16))
    df = spark.createDataFrame([(i, [float(v) for v in r], 0, "a", "b") for i, r in enumerate(x)], SCHEMA)
    got = {}
    for r in search(df, df.where("vec_id % 25 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert set(got) == set(range(0, 4000, 25)) and all(len(ids) == len(set(ids)) == 20 for ids in got.values())


def _recall(spark, x, asks, k=20):
    """Recall of each query by what brute force finds."""
    df = spark.createDataFrame([(i, [float(v) for v in r], 0, "a", "b") for i, r in enumerate(x)], SCHEMA)
    got = {}
    for r in search(df, df.where(F.col("vec_id").isin([int(i) for i in asks])), k).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    x, out = np.array(np.asarray(x, np.float32), float), {}
    for q in asks:
        s = x @ x[q]
        s[q] = -np.inf
        assert len(got[q]) == k
        out[q] = len(got[q] & set(np.argsort(-s)[:k].tolist())) / k
    return out


def test_recall_of_strays_beside_clusters(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 32))[np.arange(4000) % 30] + rng.normal(size=(4000, 32)) * 0.2
    x[::20] = rng.normal(size=(200, 32))
    hit = _recall(spark, x, range(0, 4000, 10))
    assert np.mean([hit[q] for q in hit if q % 20 == 0]) >= 0.9 and np.mean([hit[q] for q in hit if q % 20]) >= 0.9


@pytest.mark.parametrize("kind", ["one long", "log-normal", "overflow"])
def test_recall_with_uneven_norms(spark, kind):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(25, 24))[np.arange(2500) % 25] + rng.normal(size=(2500, 24)) * 0.3
    if kind == "log-normal":
        x *= np.exp(rng.normal(size=(2500, 1)))
    else:
        x[7] *= 1000 if kind == "one long" else 1e30
    hit = _recall(spark, x, range(0, 2500, 25))
    long = np.linalg.norm(x, axis=1) > np.median(np.linalg.norm(x, axis=1))
    assert all(np.mean([hit[q] for q in hit if long[q] == side]) >= 0.9 for side in (True, False))


def test_ranges_and_chances():
    """Ranges are an octave wide at most and hold every bin once; the chance that a query meets a row so far away is what hashing shows."""
    from attesta.llm.neighbours import Index, ranges_of

    assert ranges_of([(0, 5, 1.0), (15, 2, 1.9), (16, 1, 2.1), (160, 1, 1e3)]) == [(160, 160, 1, 1e3), (15, 16, 3, 2.1), (0, 0, 5, 1.0)]  # 0 and 15 could share one, but are an octave with 16
    rng, index = np.random.default_rng(7), Index(24, 1.0, 8, 40)
    q = rng.normal(size=(300, 24))
    q /= np.linalg.norm(q, axis=1)[:, None]
    far = np.full(300, 0.8)
    other = rng.normal(size=q.shape)
    other -= (other * q).sum(axis=1)[:, None] * q
    other /= np.linalg.norm(other, axis=1)[:, None]
    y = q * (1 - 0.32) + other * np.sqrt(1 - 0.68**2)  # of length one, 0.8 away
    met = np.mean([(index.probed(q, t)[1] == index.buckets(y, t)[1][:, None]).any(axis=1) for t in range(8)])
    told = np.mean([index.odds(q, far, t).sum(axis=1) for t in range(8)])
    assert abs(met - told) < 0.03


def test_every_length_is_searched(spark):
    """Vectors of all lengths have neighbours among their like, and rows that repeat an id are one result."""
    rng = np.random.default_rng(2)
    data = [(i, [float(v) for v in rng.normal(size=4 + i % 3)], 0, "a", "b") for i in range(150)] + [(149, [9.0, 9.0, 9.0, 9.0, 9.0, 9.0], 0, "a", "b")]
    got = {}
    for r in search(spark.createDataFrame(data, SCHEMA), spark.createDataFrame(data[:30], SCHEMA), 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    assert set(got) == set(range(30))
    hit = 0
    for q, found in got.items():
        v = np.array(np.float32(data[q][1]), float)
        best = {}
        for i, w, *_ in data:
            if i != q and len(w) == len(v):
                best[i] = max(best.get(i, -np.inf), float(v @ np.array(np.float32(w), float)))
        assert len({i for _, i, _ in found}) == 5 and all(s == pytest.approx(best[i], abs=1e-12) for _, i, s in found)
        assert [(-s, i) for _, i, s in sorted(found)] == sorted((-s, i) for _, i, s in found)
        hit += len({i for _, i, _ in found} & set(sorted(best, key=lambda i: (-best[i], i))[:5]))
    assert hit / 150 >= 0.9


def test_perturbations_rise_and_differ():
    """Sequences begin with the bucket itself, cross one border of a hash at most, never repeat, and rise in the expected score."""
    from attesta.llm.neighbours import sequence

    t = sequence(5, 400)
    assert not t[0].any() and len({r.tobytes() for r in t}) == len(t) == 3**5
    assert not (t * t[:, ::-1]).any() and t[1, 0] == 1


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall_on_the_query_s_own_table(spark, size):
    import os

    from attesta.llm.neighbours import op10_nearest_neighbours

    folder = f"/root/testdata/{size}"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    got = {}
    for r in op10_nearest_neighbours(spark, folder).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    t = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").toArrow()
    ids, x = np.array(t.column("vec_id").to_pylist()), np.array(t.column("embedding").to_pylist(), float)
    hit = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        hit += len(got[ids[i]] & set(ids[np.argsort(-s)[:20]].tolist()))
    assert hit / 20 / len(got) >= 0.9


def test_work_is_less_than_all_pairs():
    """On vectors with structure, buckets hold few of all rows; probes find their like all the same."""
    from attesta.llm.neighbours import TABLES, fitted

    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(200, 32)), 20, axis=0) + rng.normal(size=(4000, 32)) * 0.3
    q = x[::100]
    near = [x[np.argsort(-(x @ v))[1:11]] for v in q]
    index = fitted(32, float(np.linalg.norm(x, axis=1).max()), len(x), q, near, x)
    seen = np.zeros((len(q), len(x)), bool)
    for t in range(TABLES):
        own, probes = index.buckets(x, t)[1], index.probed(q, t)[1]
        seen |= np.array([np.isin(own, p) for p in probes])
    found = np.mean([seen[i, np.argsort(-(x @ v))[1:11]].mean() for i, v in enumerate(q)])
    assert found >= 0.9 and seen.mean() < 0.35
