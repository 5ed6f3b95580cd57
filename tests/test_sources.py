import json
from datetime import datetime

import pytest

from lodestrata.sources import readers, writers
from lodestrata.streaming import incremental


def test_text_and_questions(spark, tmp_path):
    (tmp_path / "a.md").write_text("x\ny", encoding="utf-8")
    assert [(r.file, r.text) for r in readers.whole_texts(spark, str(tmp_path)).collect()] == [("a.md", "x\ny")]
    rows = [{"id": "1", "type": "t", "question": "q", "gold_answer": "g", "company": " ACME "}, {"id": "2", "question": "r", "companies": ["a", "b"], "subquestions": {"a": "x"}}]
    (tmp_path / "q.json").write_text(json.dumps(rows))
    (tmp_path / "q.jsonl").write_text("\n\n".join(map(json.dumps, rows)))
    for name in ("q.json", "q.jsonl"):
        got = readers.questions(spark, str(tmp_path / name), check=False).orderBy("id").collect()
        assert [(r.id, r.company, r.companies) for r in got] == [("1", "acme", None), ("2", None, ["a", "b"])]
    (tmp_path / "bad.jsonl").write_text('{"id": "1"}\n[1]\n')
    with pytest.raises(Exception, match="no JSON object"):
        readers.questions(spark, str(tmp_path / "bad.jsonl"), check=False).collect()
    assert [tuple(r) for r in readers.jsonl_errors(spark, str(tmp_path / "bad.jsonl"), readers.QUESTION).collect()] == [("bad.jsonl", 2, "[1]")]
    for name in ("q.json", "q.jsonl"):
        with pytest.raises(ValueError, match="2: missing: type, gold_answer"):
            readers.questions(spark, str(tmp_path / name))
    full = [{"id": i, "type": "t", "question": "q", "gold_answer": "g"} for i in ("a", "A", "b")]
    (tmp_path / "twice.json").write_text(json.dumps(full))
    with pytest.raises(ValueError, match="A: given 2 times"):
        readers.questions(spark, str(tmp_path / "twice.json"))
    assert {tuple(r) for r in readers.configuration(spark, {"a": [1, 2], "b": None}).collect()} == {("a", "1,2"), ("b", "")}


def test_maps_caches_and_folders(spark, tmp_path):
    (tmp_path / "roots.json").write_text('{"a": "/x", "b": "/y"}')
    assert {tuple(r) for r in readers.string_map(spark, str(tmp_path / "roots.json")).collect()} == {("a", "/x"), ("b", "/y")}
    (tmp_path / "blank.json").write_text('{"a": " "}')
    with pytest.raises(Exception, match="blank"):
        readers.string_map(spark, str(tmp_path / "blank.json")).collect()
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache" / "h_v4").write_text(json.dumps({"result": {"response": {"choices": [{"message": {"content": "c"}}]}, "metrics": {"retries": 1}}}))
    r = readers.response_cache(spark, str(tmp_path / "cache")).first()
    assert (r.file, r.content, r.metrics.retries) == ("h_v4", "c", 1)
    (tmp_path / "emb").mkdir()
    (tmp_path / "emb" / "e").write_text(json.dumps({"result": {"response": {"data": [{"embedding": [1.0, 2.0], "index": 0}]}}}))
    assert tuple(readers.embedding_cache(spark, str(tmp_path / "emb")).first()) == ("e", 0, [1.0, 2.0])
    (tmp_path / "img").mkdir()
    for n in ("b.png", "a.png"):
        (tmp_path / "img" / n).write_bytes(b"123")
    assert [(r.file, r.ordinal, r.length) for r in readers.binary_folder(spark, str(tmp_path / "img")).orderBy("ordinal").collect()] == [("a.png", 1, 3), ("b.png", 2, 3)]


def test_graph_round_trip(spark, tmp_path):
    edges = spark.createDataFrame([("A", "B & C", 1.5), ("A", "D", 2.0)], "source string, target string, weight double")
    writers.graphml(edges, str(tmp_path / "g"))
    assert {tuple(r) for r in readers.graphml_edges(spark, str(tmp_path / "g" / "edges")).collect()} == {tuple(r) for r in edges.collect()}
    assert {r.id for r in readers.graphml_nodes(spark, str(tmp_path / "g" / "nodes")).collect()} == {"A", "B & C", "D"}
    (tmp_path / "n.graphml").write_text('<graphml><graph><node id="A"/><node id="B"/></graph></graphml>')
    assert {r.id for r in readers.graphml_nodes(spark, str(tmp_path / "n.graphml")).collect()} == {"A", "B"}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], (2.0, None))], "id int, companies array<string>, m struct<f1: double, label: string>")
    writers.jsonl(df, str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first().value) == {"id": 1, "companies": ["a", "b"], "m": {"f1": 2.0, "label": None}}
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        writers.jsonl(df, str(tmp_path / "j"))
    writers.csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).first().asDict() == {"id": "1", "companies": "a,b", "m_f1": "2.0", "m_label": None}
    writers.json_document(df, str(tmp_path / "d"))
    assert json.loads(spark.read.text(str(tmp_path / "d")).first().value)["id"] == 1
    pages = spark.createDataFrame([("d.md", 1, "d_page_001.md", "x\ny"), ("d.md", 2, "d_page_002.md", "")], "file string, page int, page_file string, text string")
    writers.page_files(pages, str(tmp_path / "p"))
    assert {f.name: f.read_bytes() for f in (tmp_path / "p").iterdir()} == {"d_page_001.md": b"x\ny\n", "d_page_002.md": b""}
    with pytest.raises(FileExistsError):
        writers.page_files(pages, str(tmp_path / "p"))
    writers.page_files(pages.where("page = 2"), str(tmp_path / "p"), "overwrite")
    assert [f.name for f in (tmp_path / "p").iterdir()] == ["d_page_002.md"]
    writers.marked_text(pages, str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m"), wholetext=True).first().value.startswith("--- PAGE 1 START ---\nx\ny\n--- PAGE 1 END ---")
    for company in ("a", "b"):
        writers.graph_tables(spark.createDataFrame([(1, company)], "v int, company string"), str(tmp_path / "t"))
    writers.graph_tables(spark.createDataFrame([(2, "a")], "v int, company string"), str(tmp_path / "t"))
    assert {(r.v, r.company) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(2, "a"), (1, "b")}
    writers.vectors(spark.createDataFrame([("x", [1.0])], "id string, embedding array<double>"), str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).schema["embedding"].dataType.simpleString() == "array<float>"
    assert writers.run_directory("/r", "x_gold_questions", datetime(2024, 1, 2, 3, 4, 5)) == "/r/x_20240102_030405"


def test_index_takes_up_only_new_texts(spark, tmp_path):
    src, out, ckp = (str(tmp_path / n) for n in ("src", "out", "ckp"))
    schema = "id int, text string"
    for batch in ([(1, "a"), (2, "b"), (3, "a"), (4, None)], [(5, "b"), (6, "c")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        q = incremental.index_new(incremental.file_stream(spark, src, schema), out, ckp)
        q.awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_streamed_metrics(spark, tmp_path):
    src = str(tmp_path / "qa")
    rows = [(datetime(2024, 1, 1, 5), "rag", "a b", "a b"), (datetime(2024, 1, 1, 6), "rag", "a b", "x"), (datetime(2024, 1, 2), "g", "q", None)]
    spark.createDataFrame(rows, "asked_at timestamp, run_method string, question string, answer string").write.parquet(src)
    stream = incremental.file_stream(spark, src, "asked_at timestamp, run_method string, question string, answer string")
    q = incremental.evaluation_metrics(stream, "asked_at").writeStream.outputMode("complete").format("memory").queryName("metrics").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.run_method, r.n, r.n_correct, r.mean_score) for r in spark.table("metrics").collect()}
    assert got == {("rag", 2, 1, 0.5), ("g", 1, 0, 0.0)}
    s = incremental.sessions(stream, "run_method", "asked_at", "2 hours").writeStream.outputMode("complete").format("memory").queryName("sessions").start()
    s.processAllAvailable()
    s.stop()
    assert sorted(r.n for r in spark.table("sessions").collect()) == [1, 2]


def test_failed_units_run_again(spark, tmp_path):
    units = spark.range(6).withColumnRenamed("id", "unit")
    target = str(tmp_path / "done")

    def work(df):
        seen = {}
        if (tmp_path / "done").exists():
            seen = {r.unit: r["count"] for r in spark.read.parquet(target).groupBy("unit").count().collect()}
        rows = [(r.unit, r.unit % 2 == 0 or (r.unit == 3 and seen.get(3, 0) == 1)) for r in df.collect()]
        return spark.createDataFrame(rows, "unit long, ok boolean")

    assert incremental.run_units(units, target, "unit", work, most=3) == 3
    tried = {r.unit: r["count"] for r in spark.read.parquet(target).groupBy("unit").count().collect()}
    assert tried == {0: 1, 1: 3, 2: 1, 3: 2, 4: 1, 5: 3}


def test_lines_are_relayed(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("one\ntwo\n")
    got = []
    q = incremental.relay_lines(spark, str(tmp_path / "logs"), str(tmp_path / "c"), lambda df: got.extend(r.value for r in df.collect()))
    q.awaitTermination()
    assert got == ["one", "two"]
