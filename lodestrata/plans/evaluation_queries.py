"""Evaluation analytics over the question log and the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.labels import coerce_label, label_score
from lodestrata.functions.metrics import judge, token_f1, token_judge
from lodestrata.functions.text import company_key, is_blank, normalized_contains
from lodestrata.operators import evaluation as ev
from lodestrata.plans.text_queries import _WS as WS
from lodestrata.session import table

_T = "regexp_extract_all(replace(lower(coalesce({c}, '')), 'co₂e', 'co2e'), '[a-z0-9]+')"
_PAIRS = f"""WITH q AS (SELECT DISTINCT qa_id, question, answer FROM qa_log),
tk AS (SELECT qa_id, question, answer, {_T.format(c='answer')} AS p, {_T.format(c='question')} AS g FROM q),
pc AS (SELECT qa_id, question, answer, t, count(*) AS n FROM (SELECT qa_id, question, answer, unnest(p) AS t FROM tk) GROUP BY 1, 2, 3, 4),
gc AS (SELECT qa_id, question, answer, t, count(*) AS n FROM (SELECT qa_id, question, answer, unnest(g) AS t FROM tk) GROUP BY 1, 2, 3, 4),
ov AS (SELECT pc.qa_id, pc.question, pc.answer, sum(least(pc.n, gc.n)) AS c FROM pc JOIN gc ON gc.qa_id = pc.qa_id AND gc.t = pc.t AND gc.question IS NOT DISTINCT FROM pc.question AND gc.answer IS NOT DISTINCT FROM pc.answer GROUP BY 1, 2, 3),
f AS (SELECT tk.qa_id, tk.question, tk.answer, p, g, coalesce(c, 0)::DOUBLE AS c FROM tk LEFT JOIN ov ON ov.qa_id = tk.qa_id AND ov.question IS NOT DISTINCT FROM tk.question AND ov.answer IS NOT DISTINCT FROM tk.answer),
m AS (SELECT qa_id, CASE WHEN c > 0 THEN round(c / len(p), 4) ELSE 0.0::DOUBLE END AS precision, CASE WHEN c > 0 THEN round(c / len(g), 4) ELSE 0.0::DOUBLE END AS recall,
    CASE WHEN c > 0 THEN round(2 * (c / len(p)) * (c / len(g)) / ((c / len(p)) + (c / len(g))), 4) ELSE 0.0::DOUBLE END AS f1,
    len(g) > 0 AND contains(array_to_string(p, ' '), array_to_string(g, ' ')) AS contained FROM f)
"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "qa_log").select("qa_id", "question", "answer").distinct()


def token_scores(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("qa_id", token_f1(F.col("answer"), F.col("question")).alias("m")).select("qa_id", "m.precision", "m.recall", "m.f1")


def gold_contains(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("qa_id", F.coalesce(normalized_contains(F.col("answer"), F.col("question")), F.lit(False)).alias("contained"))


def token_labels(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("qa_id", token_judge(F.col("answer"), F.col("question")).alias("j")).select("qa_id", "j.label", "j.score")


RAW = ['"Correct."', "no answer", "correct|partial", "noanswer", "Mostly  partial", "INCORRECT", "unknown", "", "partial!", "judge_error", "`no-answer`: yes"]
SAID = ["This is Incorrect", "The context does not provide it", "There is no answer, none at all", None]


def judge_labels(spark: SparkSession, d: str) -> DataFrame:
    """Raw labels of eleven kinds, with scores in every band or none and rationales of four kinds, over the events."""
    e = table(spark, d, "events")
    raw = F.element_at(F.array(*map(F.lit, RAW)), (F.col("event_id") % 11 + 1).cast("int"))
    score = F.when(F.col("event_id") % 5 < 4, F.element_at(F.array(*map(F.lit, [0.8, 0.3, 0.1, 0.0])), (F.col("event_id") % 5 + 1).cast("int")))
    said = F.element_at(F.array(*map(F.lit, SAID)), (F.floor(F.col("event_id") / 55) % 4 + 1).cast("int"))
    label = coerce_label(raw, score, said)
    return e.select(label.alias("label")).groupBy("label").agg(F.count("*").alias("n")).withColumn("score", label_score(F.col("label")))


def evaluation_rows(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation rows of the log: its method as type, its first company, labels and scores by fixed rules."""
    q = table(spark, d, "qa_log")
    k = F.col("qa_id") % 5
    label = F.element_at(F.array(*map(F.lit, ["correct", "partial", "incorrect", "no_answer", "judge_error"])), (k + 1).cast("int"))
    return q.select(
        "qa_id",
        F.col("run_method").alias("type"),
        F.coalesce(F.lower(F.trim(F.try_element_at("companies", F.lit(1)))), F.lit("")).alias("company"),
        "returncode",
        F.col("elapsed_seconds").alias("elapsed"),
        label.alias("label"),
        F.when(k < 4, label_score(label)).alias("score"),
        F.when(F.col("qa_id") % 3 > 0, F.col("qa_id") % 3 == 1).alias("hallucination"),
        ((F.col("qa_id") % 5) / F.lit(8.0)).alias("precision"),
        ((F.col("qa_id") % 9) / F.lit(16.0)).alias("recall"),
        ((F.col("qa_id") % 11) / F.lit(16.0)).alias("f1"),
        (F.col("qa_id") % 2 == 0).alias("contained"),
    )


_ROWS = """e AS (SELECT qa_id, run_method AS type, coalesce(lower(trim(companies[1])), '') AS company, returncode, elapsed_seconds AS elapsed,
CASE qa_id % 5 WHEN 0 THEN 'correct' WHEN 1 THEN 'partial' WHEN 2 THEN 'incorrect' WHEN 3 THEN 'no_answer' ELSE 'judge_error' END AS label,
CASE qa_id % 5 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 0.0::DOUBLE WHEN 3 THEN 0.0::DOUBLE END AS score,
CASE WHEN qa_id % 3 > 0 THEN qa_id % 3 = 1 END AS hallucination, (qa_id % 5) / 8.0::DOUBLE AS precision, (qa_id % 9) / 16.0::DOUBLE AS recall, (qa_id % 11) / 16.0::DOUBLE AS f1, qa_id % 2 = 0 AS contained FROM qa_log)"""
_SUMMARY = """count(*) AS total_questions, count(CASE WHEN returncode = 0 THEN 1 END) AS successful_queries, count(*) - count(CASE WHEN returncode = 0 THEN 1 END) AS query_failures,
round(avg(score), 4) AS average_score, round(count(CASE WHEN label = 'correct' THEN 1 END)::DOUBLE / count(*), 4) AS correct_rate, round(count(CASE WHEN label IN ('correct', 'partial') THEN 1 END)::DOUBLE / count(*), 4) AS partial_or_better_rate,
round(avg(CAST(hallucination AS INT)), 4) AS hallucination_rate, round(avg(elapsed), 4) AS average_elapsed_seconds, round(median(elapsed), 4) AS median_elapsed_seconds,
round(list_sort(list(elapsed) FILTER (WHERE elapsed IS NOT NULL))[CAST(round_even((count(elapsed) - 1) * 0.95::DOUBLE, 0) AS BIGINT) + 1], 4) AS p95_elapsed_seconds,
round(avg(precision), 4) AS average_token_precision, round(avg(recall), 4) AS average_token_recall, round(avg(f1), 4) AS average_token_f1, round(avg(CAST(contained AS INT)), 4) AS gold_substring_match_rate"""
_COUNTS = """, count(CASE WHEN label = 'correct' THEN 1 END) AS n_correct, count(CASE WHEN label = 'partial' THEN 1 END) AS n_partial, count(CASE WHEN label = 'incorrect' THEN 1 END) AS n_incorrect, count(CASE WHEN label = 'no_answer' THEN 1 END) AS n_no_answer"""


def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    return ev.summarise(evaluation_rows(spark, d), [])


def eval_by_type(spark: SparkSession, d: str) -> DataFrame:
    return ev.summarise(evaluation_rows(spark, d), ["type"])


def eval_by_company(spark: SparkSession, d: str) -> DataFrame:
    return ev.summarise(evaluation_rows(spark, d), ["company"])


def eval_sets(spark: SparkSession, d: str) -> DataFrame:
    return ev.summarise_sets(evaluation_rows(spark, d))


METHODS = ("basic", "drift", "global", "graph", "local", "rag")


def eval_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Mean elapsed seconds per company, the methods side by side."""
    rows = evaluation_rows(spark, d).where("company <> ''").withColumnRenamed("type", "method")
    return ev.matrix(rows, "method", list(METHODS), "company", F.round(F.avg("elapsed"), 4))


def method_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Every field of the summary per method, as the matrix file has it."""
    return ev.method_matrix(evaluation_rows(spark, d).withColumn("method", F.col("type")).withColumn("run_dir", F.concat(F.lit("runs/"), F.col("type")))).drop("run_dir")


def selected_questions(spark: SparkSession, d: str) -> DataFrame:
    """A selection by a list of ids, of either case, and its first rows."""
    q = table(spark, d, "qa_log").select(F.concat(F.lit("q"), F.col("qa_id").cast("string")).alias("id"), "question").distinct()
    return ev.select_questions(q, " Q3, q5,Q8 , Q13,q21,, q99999999", 4)


def subquestions(spark: SparkSession, d: str) -> DataFrame:
    """The sub-question of each company of the questions about several; every third question brings its own for its first company."""
    q = table(spark, d, "qa_log").where("size(array_distinct(companies)) > 1 and question is not null").select("qa_id", "question", "companies").distinct()
    own = F.create_map(F.col("companies")[0], F.when(F.col("qa_id") % 3 == 0, F.concat(F.lit(" own "), F.col("qa_id").cast("string"))).otherwise(F.lit(" ")))
    return q.select("qa_id", "question", own.alias("own"), F.explode(F.array_distinct("companies")).alias("company")).where("company is not null").select("qa_id", "company", ev.subquestion(F.col("question"), F.col("company"), F.col("own")).alias("asked")).distinct()


def judge_modes(spark: SparkSession, d: str) -> DataFrame:
    """Answers of the log graded by a model's reply, in every form that a reply takes."""
    q = table(spark, d, "qa_log").select("qa_id", "question", "answer").distinct()
    n = F.col("qa_id") % 6
    reply = (
        F.when(n == 0, F.lit('Here: {"label":"Correct.","score":"0.4","hallucination":false,"rationale":"ok"} {"label":"x"}'))
        .when(n == 1, F.lit('```json\n{"label":"unsure","score":0.3,"hallucination":true,"rationale":"r"}\n```'))
        .when(n == 2, F.lit('{"label":"unsure","score":0.1,"rationale":"It does not-provide the figure"}'))
        .when(n == 3, F.lit("no object"))
        .when(n == 4, F.lit('{"label":"unsure","rationale":"no answer"}'))
        .otherwise(F.lit('{"label":"mostly partial","score":0.1,"hallucination":"yes"}'))
    )
    j = judge("model", F.col("answer"), F.col("question"), reply)
    graded = q.select(n.alias("form"), is_blank(F.col("answer")).alias("blank"), j.alias("j"))
    return graded.groupBy("form", "blank", "j.label", "j.score", "j.hallucination").agg(F.count("*").alias("n"))


def p95_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return ev.percentile_by(table(spark, d, "events"), ["event_type"], "value", 0.95)


def median_values(spark: SparkSession, d: str) -> DataFrame:
    return ev.median_by(table(spark, d, "events"), ["event_type"], "value")


def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return ev.label_histogram(evaluation_rows(spark, d), ["type"], "label")


def question_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents")
    return rows.groupBy(F.coalesce("lang", F.lit("unknown")).alias("lang"), F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"))


def question_union(spark: SparkSession, d: str) -> DataFrame:
    """Questions of two logs with their columns united, first of each id kept, blank ones out."""
    q = table(spark, d, "qa_log")
    a = q.where("run_method = 'rag'").select("qa_id", "question")
    b = q.where("run_method <> 'rag' or run_method is null").select("qa_id", "question", "error")
    both = a.unionByName(b, allowMissingColumns=True).where(F.trim("question") != "")
    return both.groupBy("qa_id").agg(F.min("question").alias("question"), F.max("error").alias("error"))


def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return ev.duplicate_keys(table(spark, d, "qa_log").select(F.concat(F.when(F.col("qa_id") % 2 == 0, F.lit("q")).otherwise(F.lit("Q")), F.col("qa_id").cast("string")).alias("id")), "id")


def missing_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "qa_log").select("qa_id", "question", "answer", "run_method", "error").distinct()
    return ev.missing_fields(rows, "qa_id", ["question", "answer", "run_method", "error"])


def invalid_methods(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "events").select(F.col("event_type").alias("method")).distinct()
    valid = spark.createDataFrame([("click",), ("view",), ("basic",)], "method string")
    return asked.join(F.broadcast(valid), "method", "left_anti")


def comparison_questions(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "qa_log").select("qa_id", "companies", "run_method").distinct()
    company = F.when(F.col("qa_id") % 2 == 0, F.lit("acme"))
    eff = ev.effective_companies(F.col("companies"), company)
    kind = F.when(F.col("qa_id") % 7 == 0, F.lit("Comparison")).otherwise(F.lit("single"))
    return q.select("qa_id", F.array_join(eff, "|").alias("companies"), F.coalesce(ev.is_comparison(eff, kind), F.lit(False)).alias("is_comparison")).distinct()


def combined_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every question fanned out to its companies and brought together again."""
    q = table(spark, d, "qa_log").select("qa_id", "returncode", "elapsed_seconds", F.explode("companies").alias("company")).where("company is not null").distinct()
    parts = q.select("qa_id", "company", F.coalesce("returncode", F.lit(1)).alias("returncode"), F.coalesce("elapsed_seconds", F.lit(0.0)).alias("elapsed"))
    return ev.combine_queries(parts, ["qa_id"]).withColumn("any_failed", F.col("any_failed") == 1)


def win_rate(spark: SparkSession, d: str) -> DataFrame:
    """Mean retrieval score of two halves of the log, question by question."""
    s = table(spark, d, "retrieved_chunks").where("score is not null and not isnan(score)")
    sums = s.groupBy("question_id").agg(F.round(F.max(F.when(F.col("page_ordinal") % 2 == 0, F.col("score"))), 4).alias("score_a"), F.round(F.max(F.when(F.col("page_ordinal") % 2 == 1, F.col("score"))), 4).alias("score_b"))
    return ev.win_rates(sums)


def csv_projection(spark: SparkSession, d: str) -> DataFrame:
    """Nested log rows as the flat columns of the CSV sink."""
    q = table(spark, d, "qa_log").select("qa_id", "question", "companies", "run_method", "elapsed_seconds", "error").distinct()
    return q.select("qa_id", "question", F.array_join("companies", ",").alias("companies"), F.coalesce("run_method", F.lit("")).alias("method"), F.round("elapsed_seconds", 3).alias("elapsed"), F.coalesce("error", F.lit("")).alias("error")).distinct()


def requested_months(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "qa_log").select("qa_id", "asked_at").distinct()
    return q.groupBy(F.date_format("asked_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def company_scores(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "retrieved_chunks").where("score is not null and not isnan(score)")
    return r.groupBy(company_key("company").alias("company")).agg(F.count("*").alias("n"), F.round(F.max("score"), 4).alias("best"))


QUERIES = {
    "token_f1": token_scores,
    "gold_contains": gold_contains,
    "token_judge": token_labels,
    "judge_label_coerce": judge_labels,
    "eval_summary": eval_summary,
    "eval_by_type": eval_by_type,
    "eval_by_company": eval_by_company,
    "eval_grouping_sets": eval_sets,
    "eval_matrix": eval_matrix,
    "method_matrix": method_matrix,
    "selected_questions": selected_questions,
    "subquestions": subquestions,
    "judge_modes": judge_modes,
    "p95_nearest_rank": p95_nearest_rank,
    "median": median_values,
    "label_histogram": label_counts,
    "question_counts": question_counts,
    "question_union_dedup": question_union,
    "duplicate_ids": duplicate_ids,
    "missing_fields": missing_fields,
    "invalid_methods": invalid_methods,
    "comparison_questions": comparison_questions,
    "combined_queries": combined_queries,
    "win_rate": win_rate,
    "csv_projection": csv_projection,
    "requested_months": requested_months,
    "company_scores": company_scores,
}

SQL = {
    "token_f1": _PAIRS + "SELECT qa_id, precision, recall, f1 FROM m",
    "gold_contains": _PAIRS + "SELECT qa_id, contained FROM m",
    "token_judge": _PAIRS + "SELECT qa_id, CASE WHEN contained OR f1 >= 0.8 THEN 'correct' WHEN f1 >= 0.35 THEN 'partial' ELSE 'incorrect' END AS label, CASE WHEN contained OR f1 >= 0.8 THEN 1.0::DOUBLE WHEN f1 >= 0.35 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score FROM m",
    "judge_label_coerce": """WITH e AS (SELECT event_id % 11 AS k, CASE event_id % 5 WHEN 0 THEN 0.8 WHEN 1 THEN 0.3 WHEN 2 THEN 0.1 WHEN 3 THEN 0.0 END AS s, (event_id // 55) % 4 AS r FROM events),
l AS (SELECT CASE WHEN k = 0 THEN 'correct' WHEN k IN (1, 10) THEN 'no_answer' WHEN k = 3 THEN 'noanswer' WHEN k = 5 THEN 'incorrect' WHEN k = 8 THEN 'partial' WHEN s IS NULL THEN 'judge_error'
    WHEN s >= 0.75 THEN 'correct' WHEN s >= 0.25 THEN 'partial' WHEN r IN (1, 2) THEN 'no_answer' ELSE 'incorrect' END AS label FROM e)
SELECT label, count(*) AS n, CASE label WHEN 'correct' THEN 1.0::DOUBLE WHEN 'partial' THEN 0.5::DOUBLE WHEN 'incorrect' THEN 0.0::DOUBLE WHEN 'no_answer' THEN 0.0::DOUBLE END AS score FROM l GROUP BY 1""",
    "eval_summary": f"WITH {_ROWS} SELECT {_SUMMARY}{_COUNTS} FROM e",
    "eval_by_type": f"WITH {_ROWS} SELECT type, {_SUMMARY}{_COUNTS} FROM e WHERE coalesce(type, '') <> '' GROUP BY 1",
    "eval_by_company": f"WITH {_ROWS} SELECT company, {_SUMMARY}{_COUNTS} FROM e WHERE company <> '' GROUP BY 1",
    "eval_grouping_sets": f"WITH {_ROWS} SELECT 'all' AS level, '-' AS key, {_SUMMARY}{_COUNTS} FROM e UNION ALL SELECT 'type', type, {_SUMMARY}{_COUNTS} FROM e WHERE coalesce(type, '') <> '' GROUP BY 2 UNION ALL SELECT 'company', company, {_SUMMARY}{_COUNTS} FROM e WHERE company <> '' GROUP BY 2",
    "eval_matrix": f"WITH {_ROWS} SELECT company, " + ", ".join(f"round(avg(CASE WHEN type = '{m}' THEN elapsed END), 4) AS {m}" for m in METHODS) + " FROM e WHERE company <> '' GROUP BY 1",
    "method_matrix": f"WITH {_ROWS} SELECT type AS method, {_SUMMARY} FROM e WHERE coalesce(type, '') <> '' GROUP BY 1",
    "selected_questions": "SELECT DISTINCT 'q' || qa_id AS id, question FROM qa_log WHERE qa_id IN (3, 5, 8, 13, 21) ORDER BY 1 LIMIT 4",
    "subquestions": """SELECT DISTINCT qa_id, c AS company, CASE WHEN qa_id % 3 = 0 AND c = companies[1] THEN 'own ' || qa_id ELSE 'For ' || c || ', answer only the parts of this comparison that its report supports: ' || question END AS asked
FROM (SELECT qa_id, question, companies, unnest(companies) AS c FROM qa_log WHERE question IS NOT NULL AND len(list_distinct(companies)) + CASE WHEN len(companies) > list_count(companies) THEN 1 ELSE 0 END > 1) WHERE c IS NOT NULL""",
    "judge_modes": """WITH q AS (SELECT DISTINCT qa_id, question, answer FROM qa_log),
b AS (SELECT qa_id % 6 AS form, regexp_replace(coalesce(answer, ''), 'WS', '', 'g') = '' AS blank FROM q)
SELECT form, blank, CASE WHEN blank THEN 'no_answer' WHEN form = 0 THEN 'correct' WHEN form = 1 THEN 'partial' WHEN form = 2 THEN 'no_answer' WHEN form IN (3, 4) THEN 'judge_error' ELSE 'incorrect' END AS label,
CASE WHEN blank THEN 0.0::DOUBLE WHEN form = 0 THEN 1.0::DOUBLE WHEN form = 1 THEN 0.5::DOUBLE WHEN form IN (3, 4) THEN NULL ELSE 0.0::DOUBLE END AS score,
CASE WHEN blank THEN false WHEN form = 1 THEN true WHEN form = 3 THEN NULL WHEN form = 5 THEN true ELSE false END AS hallucination, count(*) AS n FROM b GROUP BY 1, 2, 3, 4, 5""".replace("WS", WS),
    "p95_nearest_rank": "SELECT event_type, round(list_sort(list(value))[CAST(round_even((count(value) - 1) * 0.95::DOUBLE, 0) AS BIGINT) + 1], 4) AS p FROM events WHERE value IS NOT NULL GROUP BY 1",
    "median": "SELECT event_type, round(median(value), 4) AS median FROM events WHERE value IS NOT NULL GROUP BY 1",
    "label_histogram": f"WITH {_ROWS} SELECT type, label, count(*) AS n FROM e GROUP BY 1, 2",
    "question_counts": "SELECT coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, count(*) AS n FROM documents GROUP BY 1, 2",
    "question_union_dedup": "SELECT qa_id, min(question) AS question, max(CASE WHEN run_method = 'rag' THEN NULL ELSE error END) AS error FROM qa_log WHERE trim(question) <> '' GROUP BY 1",
    "duplicate_ids": "SELECT 'Q' || qa_id AS id, count(*) AS n FROM qa_log GROUP BY 1 HAVING count(*) > 1",
    "missing_fields": f"""WITH q AS (SELECT DISTINCT qa_id AS id, question, answer, run_method, error FROM qa_log),
m AS (SELECT id, concat_ws(', ', CASE WHEN regexp_replace(coalesce(question, ''), '{WS}', '', 'g') = '' THEN 'question' END, CASE WHEN regexp_replace(coalesce(answer, ''), '{WS}', '', 'g') = '' THEN 'answer' END, CASE WHEN regexp_replace(coalesce(run_method, ''), '{WS}', '', 'g') = '' THEN 'run_method' END, CASE WHEN regexp_replace(coalesce(error, ''), '{WS}', '', 'g') = '' THEN 'error' END) AS e FROM q)
SELECT id, 'missing: ' || e AS error FROM m WHERE e <> ''""",
    "invalid_methods": "SELECT DISTINCT event_type AS method FROM events WHERE event_type NOT IN ('click', 'view', 'basic')",
    "comparison_questions": """WITH q AS (SELECT DISTINCT qa_id, companies FROM qa_log),
u AS (SELECT qa_id, companies, unnest(companies) AS c, unnest(range(1, len(companies) + 1)) AS i FROM q),
f AS (SELECT qa_id, companies, c, min(i) AS i FROM u GROUP BY 1, 2, 3),
g AS (SELECT qa_id, companies, string_agg(c, '|' ORDER BY i) AS j, count(*) AS n FROM f GROUP BY 1, 2)
SELECT DISTINCT q.qa_id, CASE WHEN len(q.companies) > 0 THEN coalesce(j, '') WHEN q.qa_id % 2 = 0 THEN 'acme' ELSE '' END AS companies, coalesce(n, 0) > 1 OR q.qa_id % 7 = 0 AS is_comparison
FROM q LEFT JOIN g ON g.qa_id = q.qa_id AND g.companies IS NOT DISTINCT FROM q.companies""",
    "combined_queries": """WITH q AS (SELECT DISTINCT qa_id, returncode, elapsed_seconds, company FROM (SELECT qa_id, returncode, elapsed_seconds, unnest(companies) AS company FROM qa_log) WHERE company IS NOT NULL)
SELECT qa_id, round(sum(coalesce(elapsed_seconds, 0.0)), 3) AS elapsed, max(CASE WHEN coalesce(returncode, 1) <> 0 THEN 1 ELSE 0 END) = 1 AS any_failed,
coalesce(string_agg(DISTINCT CASE WHEN coalesce(returncode, 1) <> 0 THEN company END, ', ' ORDER BY CASE WHEN coalesce(returncode, 1) <> 0 THEN company END), '') AS failed_companies FROM q GROUP BY 1""",
    "win_rate": """WITH s AS (SELECT question_id, round(max(CASE WHEN page_ordinal % 2 = 0 THEN score END), 4) AS a, round(max(CASE WHEN page_ordinal % 2 = 1 THEN score END), 4) AS b FROM retrieved_chunks WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY 1)
SELECT count(*) AS n, round(avg(CAST(a > b AS INT)) * 100, 2) AS win_pct, round(avg(CAST(a = b AS INT)) * 100, 2) AS tie_pct FROM s WHERE a IS NOT NULL AND b IS NOT NULL""",
    "csv_projection": "SELECT DISTINCT qa_id, question, array_to_string(companies, ',') AS companies, coalesce(run_method, '') AS method, round(elapsed_seconds, 3) AS elapsed, coalesce(error, '') AS error FROM qa_log",
    "requested_months": "SELECT strftime(asked_at, '%Y-%m') AS month, count(*) AS n FROM (SELECT DISTINCT qa_id, asked_at FROM qa_log) GROUP BY 1",
    "company_scores": r"SELECT lower(regexp_replace(company, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')) AS company, count(*) AS n, round(max(score), 4) AS best FROM retrieved_chunks WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY 1",
}
