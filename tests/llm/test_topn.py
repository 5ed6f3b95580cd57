import random

from lodestrata.llm.topn import top_n_per_group


def brute(rows, n):
    best = {}
    for g, h, i, s in rows:
        if s is not None and s == s and i is not None:
            best[(g, h, i)] = max(s, best.get((g, h, i), float("-inf")))
    groups = {}
    for (g, h, i), s in best.items():
        groups.setdefault((g, h), []).append((-s, i))
    return {(g, h, i, -s, k + 1) for (g, h), v in groups.items() for k, (s, i) in enumerate(sorted(v)[:n])}


def test_against_brute_force_with_a_hot_group(spark):
    rng = random.Random(1)
    rows = [(1 if rng.random() < 0.4 else rng.choice([2, 3, 4, None]), rng.choice(["x", None]), f"i{rng.randrange(3000)}", rng.choice([None, float("nan"), -1.0, float("inf"), round(rng.random(), 2)])) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "g int, h string, i string, score double").withColumnRenamed("score", "position").repartition(7)
    for parts in ("2", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {tuple(r) for r in top_n_per_group(df.withColumnRenamed("position", "s"), ["g", "h"], "s", "i", 5).collect()}
        assert got == brute(rows, 5)
        got = {tuple(r) for r in top_n_per_group(df.withColumnRenamed("position", "s"), ["g"], "s", "i", 2000).collect()}
        assert {x[1:] for x in got if x[0] == 1} == {x[2:] for x in brute([(1, 0, i, s) for g, h, i, s in rows if g == 1], 2000)}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_empty_and_small(spark):
    df = spark.createDataFrame([], "g int, s double, i string")
    assert top_n_per_group(df, ["g"], "s", "i", 5).count() == 0
    one = spark.createDataFrame([(1, 2.0, "b"), (1, 2.0, "a"), (1, 2.0, "a")], "g int, s double, i string")
    assert [tuple(r) for r in top_n_per_group(one, ["g"], "s", "i", 1).collect()] == [(1, "a", 2.0, 1)]
