import sys

import pytest
from pyspark.sql import functions as F

from lodestrata.functions.text import tokens
from lodestrata.functions.vectors import hashed_embedding
from lodestrata.operators.context import NOT_FOUND
from lodestrata.operators.evaluation import SUMMARY
from lodestrata.plans.engine import METHODS, Engine
from lodestrata.plans.hooks import RESULT, Hooks, external_query
from lodestrata.session import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark):
    chunks = table(spark, SF, "chunks").withColumn("embedding", hashed_embedding(tokens(F.col("text"))))
    return Engine(spark, chunks, table(spark, SF, "entities"), table(spark, SF, "relationships"), table(spark, SF, "companies"))


@pytest.fixture(scope="module")
def asked(spark, engine):
    names = [r.company for r in engine.chunks.select("company").distinct().orderBy("company").limit(3).collect()]
    rows = [("1", "What did the company report on water and energy?", [names[0]], "t"), ("2", "Which targets are set?", [names[1], " " + names[0].upper()], "comparison"), ("3", "Who audits suppliers?", None, "u")]
    df = spark.createDataFrame(rows, "question_id string, question string, companies array<string>, type string")
    return df.withColumn("gold_answer", F.lit("water and energy")).withColumn("company", F.lit(None).cast("string"))


def test_retrieval(engine, asked):
    assert engine.health() == {"ok": True}
    assert engine.list_companies().count() == 40
    rag = engine.rag(asked, 3).collect()
    assert rag and max(r["rank"] for r in rag) <= 3
    assert {r.company for r in rag if r.question_id == "1"} == {asked.first().companies[0]}
    parts = engine.graph_rag(asked)
    assert set(parts) == {"entities", "relationships", "chunks"} and parts["entities"].count() > 0
    assert engine.compare(asked, 2).count() > 0
    assert engine.compared_companies(asked).count() == 3


def test_rows_loaded_again_and_deleted(spark):
    t = lambda d: f"2024-01-0{d} 00:00:00"
    rows = [("a", "c", "f", 1, "old", [1.0, 0.0], t(1), None), ("a", "c", "f", 1, "new", [1.0, 0.0], t(2), None), ("b", "c", "f", 2, "gone", [1.0, 0.1], t(1), t(3))]
    chunks = spark.createDataFrame(rows, "id string, company string, source_file string, page_number int, text string, embedding array<double>, loaded_at string, deleted_at string")
    hooks = Hooks(embed=lambda c: F.array(F.lit(1.0), F.length(c).cast("double")))
    e = Engine(spark, chunks, spark.createDataFrame([], "entity_id string"), spark.createDataFrame([], "rel_id string"), hooks=hooks)
    assert [(r.id, r.company) for r in e.rag(spark.createDataFrame([("1", "q")], "question_id string, question string")).collect()] == [("a", "c")]
    assert [r.text for r in e.chunks.collect()] == ["new"]


def test_ends_of_edges_are_entities(engine):
    names = {(r.company, r.name) for r in engine.nodes().select("company", "name").collect()}
    rows = engine.edges().collect()
    assert rows and all((r.company, r.source_entity) in names and (r.company, r.target_entity) in names for r in rows)


@pytest.mark.parametrize("method", METHODS)
def test_answers(engine, asked, method):
    rows = {r.question_id: r for r in engine.answer(asked, method).collect()}
    assert set(rows) == {"1", "2", "3"} and all(r.answer for r in rows.values())
    assert all((r.answer == NOT_FOUND) == (r.n_evidence == 0) for r in rows.values()) and any(r.n_evidence for r in rows.values())


def test_reports(engine):
    rows = engine.reports().collect()
    assert rows and all(len(r.report) <= 2000 and r.title for r in rows)


def test_evaluation(spark, engine, asked):
    rows = {r.question_id: r for r in engine.evaluate(asked, "rag").collect()}
    assert set(rows) == {"1", "2", "3"} and all(r.returncode == 0 and r.elapsed is not None for r in rows.values())
    assert "[" in rows["2"].answer and rows["2"].company.count(",") == 1
    matrix = engine.evaluation_matrix(asked, ["rag", "global"], run_dirs={"rag": "runs/a"})
    assert matrix.columns == ["method", "run_dir", *SUMMARY]
    got = {r.method: r for r in matrix.collect()}
    assert set(got) == {"rag", "global"} and all(r.total_questions == 3 and r.average_elapsed_seconds is not None for r in got.values()) and got["rag"].run_dir == "runs/a"
    none = engine.evaluate(asked, "rag", grading="none").collect()
    assert all(r.label == "not_judged" and r.score is None for r in none)
    model = engine.evaluate(asked, "rag", grading="model", reply=lambda prompt: F.when(prompt.contains("Gold answer: water"), F.lit('{"label": "partial", "score": 1, "hallucination": true}'))).collect()
    assert all((r.label, r.score, r.hallucination) == ("partial", 0.5, True) for r in model)


def test_external_queries(spark, engine, asked):
    script = "import sys,time\nq,root=sys.argv[1:3]\nif 'targets' in q: print('bad', file=sys.stderr); sys.exit(3)\nif 'slow' in q: time.sleep(9)\nprint('\\x1b[31m'+root+'\\x1b[0m')"
    hook = external_query(lambda q, root, method: [sys.executable, "-c", script, q, root] if method != "none" else ["/no/such/program"], 2.0)
    roots = asked.select(F.explode("companies").alias("company")).select(F.lower(F.trim("company")).alias("company"), F.concat(F.lit("/r/"), F.lower(F.trim("company"))).alias("root")).distinct()
    e = Engine(spark, engine.chunks, engine.entities, engine.relationships, engine.companies, Hooks(query=hook))
    extra = spark.createDataFrame([("4", "slow", asked.first().companies), ("5", "x", ["nobody"])], "question_id string, question string, companies array<string>")
    got = {r.question_id: r for r in e.query(asked.select("question_id", "question", "companies").where("question_id <> '3'").unionByName(extra), "basic", roots).collect()}
    assert got["1"].answer == f"/r/{asked.first().companies[0]}" and got["1"].returncode == 0
    assert (got["2"].answer, got["2"].returncode, got["2"].error) == ("", 3, "bad")
    assert got["4"].returncode == 124 and got["4"].elapsed_seconds >= 2 and got["5"].returncode == 1 and "nobody" in got["5"].error
    bad = spark.range(1).select(external_query(lambda q, r, m: ["/no/such/program"])(F.lit("q"), F.lit("r"), "basic").alias("r")).select("r.*")
    assert bad.first().returncode == 1 and bad.schema == spark.createDataFrame([], RESULT).schema
    many = e.compare_companies(asked.where("question_id = '2'"), "basic", roots).first()
    assert many.returncode == 1 and many.n_companies == 2 and "failed for" in many.error
    own = asked.where("question_id = '2'").withColumn("subquestions", F.create_map(F.lower(F.trim(F.col("companies")[1])), F.lit("own")))
    assert e.compare_companies(own, "basic", roots).first().error == f"failed for: {asked.collect()[1].companies[0]}"
    with pytest.raises(ValueError):
        e.compare_companies(asked.where("question_id = '1'"))


def test_limits(engine, asked):
    with pytest.raises(ValueError):
        engine.rag(asked, 21)
    with pytest.raises(ValueError):
        engine._check(max_new_tokens=63)
    with pytest.raises(ValueError):
        engine.answer(asked, "other")
    with pytest.raises(ValueError):
        engine.rag(asked.withColumn("question", F.lit(" \n")))
