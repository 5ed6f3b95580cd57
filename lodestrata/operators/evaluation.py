"""Evaluation analytics: validation, grouped summaries, the method matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.ranking import nearest_rank, values_at

REQUIRED = ("id", "type", "question", "gold_answer")


def effective_companies(companies: Column, company: Column) -> Column:
    """Distinct companies of a question, else its single one, else none."""
    none = F.array().cast("array<string>")
    return F.when(F.size(F.coalesce(companies, none)) > 0, F.array_distinct(companies)).when(F.coalesce(company, F.lit("")) != "", F.array(company)).otherwise(none)


def is_comparison(companies: Column, kind: Column) -> Column:
    return (F.size(F.array_distinct(companies)) > 1) | (F.lower(kind) == "comparison")


def missing_fields(df: DataFrame, id_col: str, required: list[str]) -> DataFrame:
    """(id, error) of rows in which required fields are null or blank."""
    absent = F.array_compact(F.array(*[F.when(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"(?U)\s+", "") == "", F.lit(c)) for c in required]))
    return df.select(F.col(id_col).alias("id"), absent.alias("a")).where(F.size("a") > 0).select("id", F.concat(F.lit("missing: "), F.array_join("a", ", ")).alias("error"))


def duplicate_keys(df: DataFrame, id_col: str) -> DataFrame:
    """Keys given more than once, whatever their case."""
    return df.groupBy(F.upper(F.trim(F.col(id_col))).alias("id")).agg(F.count("*").alias("n")).where("n > 1")


def _rate(condition: Column) -> Column:
    return F.round(F.try_divide(F.count_if(condition), F.count("*")), 4)


#: Fields of a summary, in the order of the matrix.
SUMMARY = (
    "total_questions", "successful_queries", "query_failures", "average_score", "correct_rate", "partial_or_better_rate", "hallucination_rate", "average_elapsed_seconds",
    "median_elapsed_seconds", "p95_elapsed_seconds", "average_token_precision", "average_token_recall", "average_token_f1", "gold_substring_match_rate",
)


def _mean(c: str) -> Column:
    return F.round(F.avg(F.col(c).cast("double")), 4)


def summary_columns() -> list[Column]:
    """Roll-up of evaluation rows (label, score, hallucination, precision, recall, f1, contained, returncode, elapsed), but for ranks.

    The rates of correct and partly correct answers are of all rows; means skip nulls and are null over none.
    """
    ok = F.count_if(F.col("returncode") == 0)
    return [
        F.count("*").alias("total_questions"),
        ok.alias("successful_queries"),
        (F.count("*") - ok).alias("query_failures"),
        _mean("score").alias("average_score"),
        _rate(F.col("label") == "correct").alias("correct_rate"),
        _rate(F.col("label").isin("correct", "partial")).alias("partial_or_better_rate"),
        F.round(F.avg(F.col("hallucination").cast("int")), 4).alias("hallucination_rate"),
        _mean("elapsed").alias("average_elapsed_seconds"),
        _mean("precision").alias("average_token_precision"),
        _mean("recall").alias("average_token_recall"),
        _mean("f1").alias("average_token_f1"),
        F.round(F.avg(F.col("contained").cast("int")), 4).alias("gold_substring_match_rate"),
        *[F.count_if(F.col("label") == x).alias(f"n_{x}") for x in ("correct", "partial", "incorrect", "no_answer")],
    ]


def summarise(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Summary by keys: ``SUMMARY`` and the counts of the labels; rows with an empty key are left out of a grouped one."""
    for k in keys:
        rows = rows.where(F.coalesce(F.col(k), F.lit("")) != "")
    sums = rows.groupBy(*keys).agg(*summary_columns()) if keys else rows.agg(*summary_columns())
    half = values_at(rows, keys, "elapsed", 0.5, {"_a": F.floor((F.col("_n") - 1) / 2), "_b": F.floor(F.col("_n") / 2)})
    half = half.select(*keys, F.round((F.col("_a") + F.col("_b")) / 2, 4).alias("median_elapsed_seconds"))
    p95 = nearest_rank(rows, keys, "elapsed", 0.95, "_p").select(*keys, F.round("_p", 4).alias("p95_elapsed_seconds"))
    joined = sums.join(half, keys, "left").join(p95, keys, "left") if keys else sums.crossJoin(F.broadcast(half)).crossJoin(F.broadcast(p95))
    return joined.select(*keys, *SUMMARY, "n_correct", "n_partial", "n_incorrect", "n_no_answer")


def summarise_sets(rows: DataFrame) -> DataFrame:
    """Overall, by type and by company in one; ``level`` names the set, ``key`` the group."""
    sets = F.array(*[F.struct(F.lit(level).alias("level"), key.alias("key")) for level, key in (("all", F.lit("-")), ("type", F.col("type")), ("company", F.col("company")))])
    return summarise(rows.withColumn("_set", F.explode(sets)).select("*", "_set.level", "_set.key"), ["level", "key"])


def percentile_by(rows: DataFrame, keys: list[str], value: str, share: float = 0.95) -> DataFrame:
    """Nearest-rank percentile, rounded to 4."""
    return nearest_rank(rows, keys, value, share, "p").withColumn("p", F.round("p", 4))


def median_by(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median as the mean of the middle values, rounded to 4."""
    both = values_at(rows, keys, value, 0.5, {"_a": F.floor((F.col("_n") - 1) / 2), "_b": F.floor(F.col("_n") / 2)})
    return both.select(*keys, F.round((F.col("_a") + F.col("_b")) / 2, 4).alias("median"))


def label_histogram(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    return rows.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("n"))


def matrix(rows: DataFrame, method: str, methods: list[str], key: str, value: Column) -> DataFrame:
    """Methods side by side: one row per key, a column per method."""
    return rows.groupBy(key).pivot(method, methods).agg(value)


def win_rates(pairs: DataFrame) -> DataFrame:
    """Share in percent of questions on which method a scores above, or equal to, method b."""
    both = pairs.where("score_a is not null and score_b is not null")
    return both.agg(F.count("*").alias("n"), F.round(F.avg((F.col("score_a") > F.col("score_b")).cast("int")) * 100, 2).alias("win_pct"), F.round(F.avg((F.col("score_a") == F.col("score_b")).cast("int")) * 100, 2).alias("tie_pct"))


def combine_queries(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sub-queries of a comparison as one: summed time, whether any failed, and which companies did."""
    failed = F.col("returncode") != 0
    return parts.groupBy(*keys).agg(
        F.round(F.sum("elapsed"), 3).alias("elapsed"), F.max(failed.cast("int")).alias("any_failed"), F.array_join(F.array_sort(F.collect_set(F.when(failed, F.col("company")))), ", ").alias("failed_companies")
    )


def select_questions(df: DataFrame, ids: str | None = None, limit: int | None = None, id_col: str = "id", order: str | None = None) -> DataFrame:
    """Questions whose id is in a comma list, whatever its case, then the first ``limit`` in the order of ``order`` (the id by default).

    Without a list, or with a blank one, all are selected. None selected is an error.
    """
    wanted = sorted({i.strip().upper() for i in (ids or "").split(",") if i.strip()})
    out = df.where(F.upper(F.col(id_col).cast("string")).isin(*wanted)) if wanted else df
    out = out.orderBy(order or id_col).limit(limit) if limit is not None else out
    if out.isEmpty():
        raise ValueError("no question is selected")
    return out


def subquestion(question: Column, company: Column, subquestions: Column | None = None) -> Column:
    """What a company is asked of a comparison: its own sub-question, else the whole for that company alone."""
    whole = F.concat(F.lit("For "), company, F.lit(", answer only the parts of this comparison that its report supports: "), question)
    if subquestions is None:
        return whole
    own = F.trim(F.try_element_at(subquestions, company))
    return F.when(F.coalesce(own, F.lit("")) != "", own).otherwise(whole)


def united_companies(first: Column, second: Column) -> Column:
    """Companies of two results in order of first occurrence, those of ``first`` before."""
    return F.array_distinct(F.concat(first, second))


def method_matrix(runs: DataFrame) -> DataFrame:
    """One row per method and run folder with the fields of ``SUMMARY``."""
    return summarise(runs.withColumn("run_dir", F.coalesce("run_dir", F.lit("-"))), ["method", "run_dir"]).select("method", "run_dir", *SUMMARY)
