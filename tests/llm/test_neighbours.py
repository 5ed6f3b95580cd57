import numpy as np

import pyarrow as pa

from lodestrata.llm.neighbours import _compare, best_of, nearest


def frame(spark, ids, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, x)], "id string, embedding array<float>").repartition(4)


def brute(ids, x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return {(ids[i], ids[j]) for i in range(len(ids)) for j in np.argsort(-s[i], kind="stable")[:k]}


def test_recall_of_close_neighbours(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(700, 64))
    x = np.repeat(centres, 6, axis=0) + 0.12 * rng.normal(size=(4200, 64))
    x *= rng.uniform(0.4, 2.5, size=(4200, 1))
    ids = [f"v{i:05d}" for i in range(len(x))]
    want = brute(ids, x, 5)
    got = {(r.id, r.neighbour) for r in nearest(frame(spark, ids, x), "id", "embedding", 64, 5).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_small_is_exact_and_copies_are_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 64))
    x[20:45] = 3 * x[20]
    ids = [f"v{i:02d}" for i in range(60)]
    rows = nearest(frame(spark, ids, x), "id", "embedding", 64, 3).collect()
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append((r["rank"], r.neighbour, r.cosine))
    assert len(by) == 60 and all(len(v) == 3 for v in by.values())
    assert [n for _, n, _ in sorted(by["v30"])] == ["v20", "v21", "v22"]
    assert [n for _, n, _ in sorted(by["v20"])] == ["v21", "v22", "v23"]
    lone = [i for i in ids if not "v20" <= i < "v45"]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in lone:
        s = u @ u[int(i[1:])]
        s[int(i[1:])] = -2
        assert abs(sorted(by[i])[0][2] - s.max()) < 1e-5


def test_unusable_vectors(spark):
    rows = [("a", [0.0] * 64), ("b", None), ("c", []), ("d", [1.0] * 32), (None, [1.0] * 64), ("e", [float("nan")] * 64), ("f", [1.0] * 64), ("f", [1.0] * 64), ("g", [2.0] * 64), ("h", [None] + [1.0] * 63)]
    df = spark.createDataFrame(rows, "key string, vec array<float>")
    assert {(r.id, r.neighbour) for r in nearest(df, "key", "vec", 64, 5, 0.9).collect()} == {("f", "g"), ("g", "f")}
    assert nearest(df.where("false"), "key", "vec", 64).count() == 0


def test_leaves_split_again_and_in_parts(spark):
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(500, 64)), 6, axis=0) + 0.1 * rng.normal(size=(3000, 64))
    ids = [f"v{i:05d}" for i in range(len(x))]
    want = brute(ids, x, 5)
    df = frame(spark, ids, x)
    for kind in ({"leaf": 200}, {"leaf": 200, "visitors": 150}, {"leaf": 200, "block": 90, "visitors": 100}, {"leaf": 5000}):
        got = {(r.id, r.neighbour) for r in nearest(df, "id", "embedding", 64, 5, **kind).collect()}
        assert len(want & got) >= (0.9 if kind["leaf"] < 5000 else 1) * len(want), kind


def test_best_of_against_sorting_and_second_trees():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    keys = np.arange(700, dtype=np.int64) * 3
    s = x.astype(np.float64) @ x[:333].T.astype(np.float64)
    s[np.arange(333), np.arange(333)] = -2
    for least in (-1.0, 0.5):
        q, j, c = best_of(x, keys, x[:333], keys[:333], 5, least)
        want = {(r, int(m)) for r in range(700) for m in np.argsort(-s[r])[:5] if s[r, m] >= least}
        assert {(int(a), int(b)) for a, b in zip(q, j)} == want and np.allclose(c, s[q, j])
    table = pa.table({"key": keys, "vec": pa.array([r.tobytes() for r in x], pa.binary()), "own": pa.array([True] * 700), "visits": pa.array([True] * 700)})
    t = _compare(16, 5, -1.0, 8, 100)(table).to_pandas()
    found = set(zip((t.q // 3).tolist(), (t.m // 3).tolist()))
    full = x.astype(np.float64) @ x.T.astype(np.float64)
    np.fill_diagonal(full, -2)
    want = {(r, int(m)) for r in range(700) for m in np.argsort(-full[r])[:5]}
    assert len(want & found) >= 0.9 * len(want)
