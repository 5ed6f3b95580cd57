import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import jsonx
from lodestrata.functions.labels import coerce_label
from lodestrata.functions.metrics import token_f1, token_judge
from lodestrata.functions.refs import source_ref
from lodestrata.functions.text import normalized_contains, strip_ansi, truncate_text
from lodestrata.functions.vectors import dot, hashed_embedding
from lodestrata.operators import chunking, evaluation, graph, graph_build, pages, records, retrieval
from lodestrata.operators.ranking import nearest_rank, positions
from lodestrata.plans import graph_queries


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


def test_truncate(spark):
    t = truncate_text(F.col("t"), 5)
    assert one(spark, t, t="  a \n b ") == "a b"
    assert one(spark, t, t="abcdefgh") == "abcde ..."
    assert one(spark, t, t="abc defgh") == "abc ..."


def test_source_ref_forms(spark):
    want = {"f:12:u": ("f", 12), "a:f:12:u": ("a:f", 12), "f:12": None, "7:abc": ("7", 7), "f": None, ":12:u": None}
    for ref, w in want.items():
        got = one(spark, source_ref(F.col("r")), r=ref)
        assert (tuple(got) if got else None) == w


def test_token_metrics(spark):
    m = one(spark, token_f1(F.col("p"), F.col("g")), p="the cat the dog", g="the the cat")
    assert (m.precision, m.recall, m.f1) == (0.75, 1.0, 0.8571)
    assert one(spark, token_f1(F.col("p"), F.col("g")), p="x", g="—").f1 == 0
    assert one(spark, normalized_contains(F.col("p"), F.col("g")), p="concatenate", g="cat")
    assert not one(spark, normalized_contains(F.col("p"), F.col("g")), p="x", g="—")
    assert one(spark, token_judge(F.col("p"), F.col("g")), p="42 kt CO₂e in all", g="kt co2e").label == "correct"


def test_labels(spark):
    label = coerce_label(F.col("l"), F.col("s"), F.col("r"))
    assert one(spark, label, l='"Correct."', s=None, r=None) == "correct"
    assert one(spark, label, l="no answer", s=None, r=None) == "no_answer"
    assert one(spark, label, l="correct|partial", s=0.8, r=None) == "correct"
    assert one(spark, label, l="noanswer", s=None, r=None) == "noanswer"
    for said in (None, "partial", "incorrect"):
        assert one(spark, label, l="?", s=None, r=said) == "judge_error"
    assert one(spark, label, l="?", s=0.2, r="It does-not provide it") == "no_answer" and one(spark, label, l="?", s=0.2, r="wrong") == "incorrect"
    assert one(spark, label, l="mostly partial", s=0.8, r=None) == "correct" and one(spark, label, l="partial!", s=None, r=None) == "partial"


def test_json_in_text(spark):
    got = one(spark, jsonx.first_json_object(F.col("t")), t='x {no} ```json\n{"a": {"b": 1}} {"c": 2}```')
    assert got == '{"a": {"b": 1}}'
    assert one(spark, jsonx.first_json_object(F.col("t")), t="none") is None


def test_ansi_and_vectors(spark):
    assert one(spark, strip_ansi(F.col("t")), t="\x1b[1;31mred\x1b[0m") == "red"
    assert one(spark, dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0)))) == 3.0
    v = one(spark, hashed_embedding(F.array(F.lit("a"), F.lit("b"))))
    assert len(v) == 64 and abs(sum(x * x for x in v) - 1) < 1e-6


def test_positions_and_nearest_rank(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("abc"), rng.choice([None, *range(50)])) for _ in range(5000)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(5)
    got = positions(df.where("v is not null"), ["g"], [F.col("v").asc()]).groupBy("g").agg(F.count_distinct("position").alias("d"), F.max("position").alias("m"), F.count("*").alias("n")).collect()
    assert all(r.d == r.m == r.n for r in got)
    for n, want in ((1, 0), (11, 10), (31, 28)):
        one_group = spark.range(n).select(F.lit(None).cast("string").alias("k"), F.col("id").alias("v"))
        assert [tuple(r) for r in nearest_rank(one_group, [], "v", 0.95, "p").collect()] == [(want,)]


def test_pages(spark):
    text = "x\n--- PAGE 1 START ---\n\na\n--- PAGE 1 END ---\n--- PAGE 2 START ---\nb\n--- PAGE 2 END ---\n"
    bad = {
        "n": "--- PAGE 1 START ---\n--- PAGE 2 START ---",
        "e": "--- PAGE 1 END ---",
        "m": "--- PAGE 1 START ---\n--- PAGE 2 END ---",
        "u": "--- PAGE 1 START ---\na",
    }
    df = spark.createDataFrame([("d.md", text), *[(k, v) for k, v in bad.items()]], "file string, text string")
    got = pages.split_pages(df.where("file = 'd.md'"), "file", "text").orderBy("page").collect()
    assert [(r.page, r.page_file, r.text) for r in got] == [(1, "d_page_001.md", "a"), (2, "d_page_002.md", "b")]
    empty = spark.createDataFrame([("e.md", "--- PAGE 1 START ---\nx\n--- PAGE 1 END ---\n--- PAGE 2 START ---\n--- PAGE 2 END ---")], "file string, text string")
    for keep in (False, True):
        assert [r.page for r in pages.split_pages(empty, "file", "text", keep).orderBy("page").collect()] == [1, 2]
    assert [(r.page, r.text, r.n_lines) for r in pages.split_pages(empty, "file", "text").orderBy("page").collect()] == [(1, "x", 1), (2, "", 0)]
    assert tuple(pages.page_counts(pages.split_pages(empty, "file", "text")).first()) == ("e.md", 2, 1)
    assert {r.file: r.error for r in pages.page_errors(df, "file", "text").collect()} == {"n": "nested start", "e": "end without start", "m": "mismatched end", "u": "unclosed page"}


def test_chunks(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, ""), (3, None)], "id int, t string").select("id", chunking.words(F.col("t")).alias("w"))
    got = chunking.sliding_chunks(df, "id", "w", 4, 1).orderBy("chunk_no").collect()
    assert [r.chunk for r in got] == ["a b c d", "d e f g"]


def test_records(spark):
    text = '("entity"<|>a&amp;b<|>ORG<|>d)##("relationship"<|>x<|>y<|>d<|>7>)##("relationship"<|>x<|>y<|>d)##"relationship"<|>x<|>y<|>d<|>2<|>3'
    got = records.parse_records(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").orderBy("record_no").collect()
    assert [(r.kind, r.name, r.weight) for r in got] == [("entity", "A&B", None), ("relationship", "X", 1.0), ("rejected", None, None), ("relationship", "X", 3.0)]


def test_components_and_communities(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000 + rng.randrange(50), 1000 + rng.randrange(50)) for _ in range(60)] + [(None, 5), (7, 7)]
    df = spark.createDataFrame(edges, "src int, dst int")
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    assert {r.id: r.component for r in graph.connected_components(df).collect()} == {x: find(x) for x in list(parent)}
    two = [(a, b) for g in (0, 10) for a in range(g, g + 5) for b in range(g, g + 5) if a < b] + [(4, 10)]
    got = {r.id: r.community for r in graph.communities(spark.createDataFrame(two, "src int, dst int")).collect()}
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(10, 15)}) == 1


def test_topk_against_numpy(spark):
    rng = np.random.default_rng(3)
    items = [(f"i{k}", "ab"[k % 2], [float(x) for x in rng.normal(size=8 if k % 9 else 5)] if k % 7 else None) for k in range(120)]
    asks = [(str(k), [float(x) for x in rng.normal(size=8)]) for k in range(5)]
    got = retrieval.topk_by_company(spark.createDataFrame(asks, "question_id string, embedding array<float>"), spark.createDataFrame(items, "id string, company string, embedding array<float>").repartition(5), 3)
    want = set()
    for q, v in asks:
        for c in "ab":
            scored = sorted(((-round(sum(np.float32(x) * float(np.float32(y)) for x, y in zip(v, e)), 10), i) for i, g, e in items if g == c and e), key=lambda x: (round(x[0], 6), x[1]))[:3]
            want |= {(q, c, i) for _, i in scored}
    assert {(r.question_id, r.company, r.id) for r in got.collect()} == want


def test_seed_and_relationship_quirks(spark):
    scored = spark.createDataFrame([("q", "c", "A", 0.9, "1"), ("q", "c", "A", 0.5, "2"), ("q", "c", " ", 0.4, "3"), ("q", "c", "B", -0.2, "4"), ("q", "c", "C", 0.1, "5")], "question_id string, company string, name string, score double, id string")
    seeds = retrieval.seed_entities(scored, 3)
    assert sorted((r.name, r.score) for r in seeds.collect()) == [("A", 0.5), ("A", 0.9)]
    rels = spark.createDataFrame([("r1", "c", "A", "A", 1.0, 10), ("r2", "c", "A", "B", None, None), ("r3", "c", "", "A", 9.0, 1), ("r4", "d", "A", "A", 1.0, 1)], "rel_id string, company string, source_entity string, target_entity string, weight double, combined_degree int").withColumn("source_refs", F.array(F.lit("f:1:u"), F.lit("f:1:u")))
    got = {r.rel_id: (r.hits, r.score) for r in retrieval.rank_relationships(seeds, rels, 5).collect()}
    assert got == {"r1": (2, 6.3), "r2": (1, 2.5)}


def test_summary_rates(spark):
    rows = spark.createDataFrame([("correct", 1.0, True, 0.5, 0.25, 0.5, True, 0, 1.0, "t", ""), (None, None, None, None, None, None, False, 1, None, "", "c")], "label string, score double, hallucination boolean, f1 double, precision double, recall double, contained boolean, returncode int, elapsed double, type string, company string")
    r = evaluation.summarise(rows, []).first()
    assert (r.total_questions, r.successful_queries, r.query_failures, r.correct_rate, r.average_score, r.hallucination_rate) == (2, 1, 1, 0.5, 1.0, 1.0)
    assert (r.average_token_precision, r.average_token_recall, r.average_token_f1, r.gold_substring_match_rate, r.median_elapsed_seconds, r.p95_elapsed_seconds, r.n_correct) == (0.25, 0.5, 0.5, 0.5, 1.0, 1.0, 1)
    assert {(x.level, x.key) for x in evaluation.summarise_sets(rows).collect()} == {("all", "-"), ("type", "t"), ("company", "c")}
    assert evaluation.summarise(rows.where("false"), []).first().total_questions == 0


def test_all_descriptions_of_a_hot_entity(spark):
    rows = [("Acme", "Hot", f"d{i:03d}") for i in range(300)] + [("Acme", "Hot", "d000")] + [("Acme", "Long", "x" * 600), ("Acme", "Long", "y"), (None, "Null", " z "), ("Acme", "None", None)]
    df = spark.createDataFrame(rows, "company string, entity_name string, entity_description string")
    got = {(r.company, r.name): (r.n_descriptions, r.summary) for r in graph_build.summarise_descriptions(df).collect()}
    assert got == {("acme", "HOT"): (300, " ".join(f"d{i:03d}" for i in range(300))[:500]), ("acme", "LONG"): (2, "x" * 500), (None, "NULL"): (1, "z")}


def test_bounded_communities_go_on_to_the_bound(spark):
    star = [("hub", f"leaf{i:02d}") for i in range(30)]
    clique = [(f"k{i:02d}", f"k{j:02d}") for i in range(12) for j in range(i)]
    rows = graph.bounded_communities(spark.createDataFrame(star + clique, "src string, dst string")).collect()
    last = {}
    for r in rows:
        if r.id not in last or r.level > last[r.id].level:
            last[r.id] = r
    assert set(last) == {x for e in star + clique for x in e}
    sizes = {}
    for r in last.values():
        sizes.setdefault((r.community, r.unsplittable), set()).add(r.id)
    assert all(len(ids) <= 10 for (_, stuck), ids in sizes.items() if not stuck)
    assert [ids for (_, stuck), ids in sizes.items() if stuck] == [{x for e in clique for x in e}]


def test_bounded_communities_take_no_jobs_for_their_depth(spark):
    hubs = [(f"h{i:02d}", f"h{j:02d}") for i in range(16) for j in range(i)]
    leaves = [(f"h{i:02d}", f"leaf{i:02d}{x}") for i in range(16) for x in "abc"]
    spark.sparkContext.setJobGroup("depth", "depth")
    try:
        rows = graph.bounded_communities(spark.createDataFrame(hubs + leaves, "src string, dst string")).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(r.level for r in rows) >= 8
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("depth")) < 200


def test_bounded_communities_in_a_task_equal_those_over_all(spark, monkeypatch):
    rng = random.Random(3)
    near = [(f"é{c}/{i:02d}", f"é{c}/{rng.randrange(i):02d}") for c in range(2) for i in range(1, 40) for _ in range(3)]
    far = [(f"é{rng.randrange(2)}/{rng.randrange(40):02d}", f"Z{i:02d}") for i in range(30)]
    clique = [(f"k{i:02d}", f"k{j:02d}") for i in range(12) for j in range(i)]
    rows = near + far + clique + [(None, "x"), ("self", "self"), ("k01", "k00"), ("k00", "k01"), ("é0/00", None)]
    edges = spark.createDataFrame(rows, "src string, dst string")
    alone = sorted(graph.bounded_communities(edges).select("id", "level", "community", "unsplittable").collect())
    monkeypatch.setattr(graph, "HELD", 75)
    assert sorted(graph.bounded_communities(edges).select("id", "level", "community", "unsplittable").collect()) == alone
    assert {r.id for r in alone} == {x for e in rows if None not in e and e[0] != e[1] for x in e}
    assert max(r.level for r in alone) >= 2 and any(r.unsplittable for r in alone)


def test_bounded_communities_keep_the_type_of_ids(spark):
    df = graph.bounded_communities(spark.createDataFrame([(0, i) for i in range(2, 30)] + [(10, 2)], "src int, dst bigint"))
    assert dict(df.dtypes) == {"id": "bigint", "level": "int", "community": "string", "unsplittable": "boolean"}
    assert {r.id for r in df.collect()} == {0, *range(2, 30)}
    assert graph.bounded_communities(spark.createDataFrame([], "src string, dst string")).collect() == []


def test_community_bounds_of_a_deep_hierarchy(spark, tmp_path):
    hubs = [(f"H{i:02d}", f"H{j:02d}") for i in range(16) for j in range(i)]
    rows = [("Acme", a, b) for a, b in hubs + [(f"H{i:02d}", f"LEAF{i:02d}{x}") for i in range(16) for x in "ABC"] + [("SELF", "SELF"), ("H00", " ")]]
    like = spark.read.parquet("/root/testdata/sf0.001/relationships.parquet").limit(0)
    like.unionByName(spark.createDataFrame(rows, "company string, source_entity string, target_entity string"), allowMissingColumns=True).write.parquet(f"{tmp_path}/relationships.parquet")
    spark.sparkContext.setJobGroup("bounds", "bounds")
    try:
        assert [tuple(r) for r in graph_queries.community_bounds(spark, str(tmp_path)).collect()] == [(64, 0, 0, 0)]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("bounds")) < 300


def test_topk_by_block_equals_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(5)
    items = spark.createDataFrame([(f"i{k}", "abc"[k % 3], [float(x) for x in rng.normal(size=6)]) for k in range(90)] + [("t1", "a", [1.0] * 6), ("t2", "a", [1.0] * 6)], "id string, company string, embedding array<float>").repartition(3)
    asks = spark.createDataFrame([(str(k), [float(x) for x in rng.normal(size=6)]) for k in range(25)], "question_id string, embedding array<float>")
    asked = spark.createDataFrame([(str(k), "abc"[k % 2]) for k in range(25)], "question_id string, company string")
    rows = lambda **k: {tuple(r) for r in retrieval.topk_by_company(asks, items, 4, **k).select("question_id", "company", "id", "rank").collect()}
    whole, some = rows(), rows(asked=asked)
    assert some == {r for r in whole if r[1] == "abc"[int(r[0]) % 2]} and len(whole) == 25 * 3 * 4
    monkeypatch.setattr(retrieval, "BLOCK", 10)
    monkeypatch.setattr(retrieval, "PART", 40)
    assert rows() == whole and rows(asked=asked) == some


def test_relationship_rank_against_the_definition(spark):
    rng = random.Random(8)
    names = [f"n{i}" for i in range(12)]
    rels = [(f"r{i:03d}", rng.choice("cd"), rng.choice(names), rng.choice(names), rng.choice([None, 1.0, 2.0, 5.0]), rng.choice([None, 3, 40])) for i in range(200)]
    seeds = [(q, c, n, round(rng.random(), 4)) for q in "xy" for c in "cd" for n in rng.sample(names, 3)]
    got = retrieval.rank_relationships(spark.createDataFrame(seeds, "question_id string, company string, name string, score double"), spark.createDataFrame(rels, "rel_id string, company string, source_entity string, target_entity string, weight double, combined_degree int"), 60)
    want = {}
    for q in "xy":
        for c in "cd":
            score = {n: s for a, b, n, s in seeds if (a, b) == (q, c)}
            rows = []
            for i, company, a, b, w, d in rels:
                if company == c:
                    hits = (a in score) + (b in score)
                    rows.append((-hits, -round((w or 0) + 0.03 * (d or 0) + score.get(a, 0) + score.get(b, 0) + 2 * hits, 6), i))
            want |= {(q, c, i): (k + 1, -h) for k, (h, _, i) in enumerate(sorted(rows)[:60])}
    assert {(r.question_id, r.company, r.rel_id): (r["rank"], r.hits) for r in got.collect()} == want


def test_edges_without_an_entity_at_an_end(spark):
    edges = spark.createDataFrame([("1", "c", "A", "B"), ("2", "c", "A", "Z"), ("3", "d", "A", "B"), ("4", "c", "A", "A")], "rel_id string, company string, source_entity string, target_entity string")
    nodes = spark.createDataFrame([("c", "A"), ("c", "A"), ("c", "B"), ("d", "A"), ("c", " ")], "company string, name string")
    assert {r.rel_id for r in retrieval.tied_edges(edges, nodes).collect()} == {"1", "4"}


def test_exact_ranks_in_large_and_hot_groups(spark, monkeypatch):
    from lodestrata.operators import ranking

    monkeypatch.setattr(ranking, "ACCURACY", 200)
    rng = random.Random(9)
    rows = [("hot", rng.choice([None, 7.0, rng.random(), rng.random() * 9])) for _ in range(8000)] + [("few", float(v)) for v in (3, 1, 2, 9)] + [(None, 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    by = {}
    for g, v in rows:
        if v is not None:
            by.setdefault(g, []).append(v)
    by = {g: sorted(v) for g, v in by.items()}
    for share in (0.0, 0.5, 0.95, 1.0):
        got = {r.g: r.p for r in ranking.nearest_rank(df, ["g"], "v", share, "p").collect()}
        assert got == {g: v[round((len(v) - 1) * share)] for g, v in by.items()}
    got = {r.g: r.median for r in evaluation.median_by(df, ["g"], "v").collect()}
    assert got == {g: round((v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2, 4) for g, v in by.items()}


def test_selections_and_small_functions(spark):
    from lodestrata.functions import text
    from lodestrata.operators import context

    q = spark.createDataFrame([("Q1",), ("q2",), ("q3",)], "id string")
    assert [r.id for r in evaluation.select_questions(q, "q1, Q3 ,zz").collect()] == ["Q1", "q3"]
    assert [r.id for r in evaluation.select_questions(q, " ", 2).collect()] == ["Q1", "q2"]
    for bad in (("zz", None), (None, 0)):
        with pytest.raises(ValueError):
            evaluation.select_questions(q, *bad)
    assert one(spark, evaluation.united_companies(F.split("a", ","), F.split("b", ",")), a="x,y", b="z,x") == ["x", "y", "z"]
    assert one(spark, text.run_directory_of(F.col("l")), l="done\nWrote evaluation run to /r/a b \nend") == "/r/a b" and one(spark, text.run_directory_of(F.col("l")), l="none") is None
    assert one(spark, text.valid_text(F.unhex("h")), h="61FF62") == "a\ufffdb"
    assert tuple(one(spark, text.credentials(F.col("c")), c="u/p/q")) == ("u", "p/q") and one(spark, text.credentials(F.col("c")), c="u") is None
    line = context.relationship_line(F.lit("A"), F.lit("B"), F.lit(1.5), F.lit(None).cast("int"), F.lit(2.0), F.array(F.lit("f:1:u")), F.lit(None).cast("string"))
    assert one(spark, line, x="x") == "- A -> B (weight=1.50, combined_degree=0, score=2.0000, refs=f:1:u) "
    reply = json.loads(one(spark, jsonx.embedding_envelope(F.split("t", "[|]"), F.array(F.array(F.lit(1.0)), F.array(F.lit(2.0))), "m"), t="a b|"))
    assert [d["index"] for d in reply["data"]] == [0, 1] and reply["usage"]["total_tokens"] == 3


def test_gleaned_passes(spark):
    rows = lambda text: records.parse_records(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t")
    a, b = rows('("entity"<|>a<|>ORG<|>d)##bad'), rows('("entity"<|>a<|>ORG<|>other)##("entity"<|>b<|>ORG<|>d)')
    assert {(r.name, r.pass_no) for r in records.gleaned([a, b]).where("kind = 'entity'").collect()} == {("A", 0), ("B", 1)}


def test_label_propagation_against_the_definition(spark):
    rng = random.Random(12)
    edges = [(f"n{rng.randrange(14):02d}", f"n{rng.randrange(14):02d}", rng.choice([1.0, 2.0, 0.5])) for _ in range(40)] + [("n00", None, 1.0)]
    near = {}
    for a, b, w in edges:
        if b is not None and a != b:
            near.setdefault(a, {})[b] = near.setdefault(a, {}).get(b, 0) + w
            near.setdefault(b, {})[a] = near.setdefault(b, {}).get(a, 0) + w
    labels = {n: n for n in near}
    for turn in range(10):
        stepped = dict(labels)
        for n, around in near.items():
            if ((zlib.crc32(n.encode()) >> (turn // 2)) + turn) % 2:
                continue
            votes = {labels[n]: 0.5}
            for m, w in around.items():
                votes[labels[m]] = votes.get(labels[m], 0) + w
            stepped[n] = min(votes, key=lambda x: (-round(votes[x], 6), x))
        labels = stepped
    got = {r.id: r.community for r in graph.communities(spark.createDataFrame(edges, "src string, dst string, w double"), weight="w").collect()}
    assert got == labels


def test_reports_of_communities(spark):
    from lodestrata.operators import reports

    nodes = spark.createDataFrame([("c", "A", 3, "water wells"), ("c", "B", 2, " "), ("c", "C", 1, None), ("c", "D", 1, "energy"), ("d", "A", 1, "x" * 9000), ("c", "LONE", 1, "alone")], "company string, name string, degree int, description string")
    edges = spark.createDataFrame([("c", "A", "B"), ("c", "B", "A"), ("c", "A", "C"), ("c", "D", "D"), ("d", "A", "Z")], "company string, source_entity string, target_entity string")
    rows = reports.community_reports(nodes, edges)
    got = {(r.company, r.title): (r.report, r.n_entities) for r in rows.collect()}
    assert got == {("c", "A, B, C"): ("A: water wells", 3), ("d", "A"): ("A", 1)}
    asked = spark.createDataFrame([("1", "which water wells", "c"), ("2", "nothing", "c"), ("3", "water", "none")], "question_id string, question string, company string")
    rated = reports.rate_reports(asked, rows, lambda q, t: F.when(q.contains("water") & t.contains("water"), F.lit(70.0)).otherwise(F.lit(0.0)))
    assert [(r.question_id, r.rating) for r in rated.collect()] == [("1", 70.0)]
    assert [tuple(r) for r in reports.reduce_reports(rated, 20).collect()] == [("1", "[c; rating=70.00] A:", 1)]
    seeds = spark.createDataFrame([("1", "c", "B", 0.5), ("1", "c", "LONE", 0.9)], "question_id string, company string, name string, score double")
    assert [tuple(r) for r in reports.of_entities(rows, nodes, seeds, 100).collect()] == [("1", "c", "A: water wells")]
