from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm.packing import combinations, nnls, pack, pack_texts, plan_containers


def test_nnls_against_the_conditions_of_the_optimum():
    rng = np.random.default_rng(0)
    a, b = rng.random((20, 40)), rng.random(20)
    x = nnls(a, b)
    g = a.T @ (b - a @ x)
    assert (x >= 0).all() and (g <= 1e-6).all() and (np.abs(g[x > 1e-9]) <= 1e-6).all()


def test_combinations():
    assert sorted(combinations([1, 2, 3, 6], 6)) == [(2, 2, 2), (3, 2, 1), (3, 3), (6,)]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plans_hold_every_item_once(histogram):
    plan = plan_containers(histogram, 64, 16)
    got = Counter()
    for contents, count in plan:
        assert count > 0 and sum(n * k for n, k in contents.items()) <= 64
        for n, k in contents.items():
            got[n] += k * count
    assert got == Counter(histogram)


def test_pack(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(n), 5) for i, n in enumerate(np.minimum(rng.exponential(300, 3000).astype(int), 9000))] + [(i, 77, 5) for i in range(5000, 6500)] + [(None, 10, 1), (9, None, 1), (7, 0, 1), (7, -3, 1), (8, 2048, 1), (8, 2049, 1)]
    df = spark.createDataFrame(rows, "doc_id int, n int, length int").repartition(6)
    out = pack(df, "doc_id", "n", 2048).collect()
    room = Counter()
    for r in out:
        assert (r.container_id is None) == (r.length == 0)
        if r.length:
            room[r.container_id] += r.length
    assert max(room.values()) <= 2048
    total = sum(max(0, n or 0) for _, n, _ in rows)
    assert sum(room.values()) == total and len(room) <= 1.02 * total / 2048 + 2
    whole = Counter(r.doc_id for r in out if r.piece_no == 1)
    assert whole == Counter(i for i, _, _ in rows)
    assert sum(r.piece_no > 1 for r in out) == sum(-(-n // 2048) - 1 for _, n, _ in rows if n and n > 2048)
    assert pack(df.where("false"), "doc_id", "n", 2048).count() == 0


def test_texts(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (4, "word " * 5000)], "doc_id int, text string")
    out = pack_texts(df, "doc_id", "text", 2048).collect()
    assert {r.doc_id for r in out if r.container_id is None} == {2, 3}
    assert [r.start_at for r in sorted(out, key=lambda r: r.piece_no) if r.doc_id == 4] == [0, 2048, 4096]
