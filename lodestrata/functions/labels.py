"""Labels of a judge, brought to a closed vocabulary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The labels that a judge may give, and the score of each.
LABELS = ("correct", "partial", "incorrect", "no_answer")
SCORES = {"correct": 1.0, "partial": 0.5, "incorrect": 0.0, "no_answer": 0.0}


def coerce_label(label: Column, score: Column, rationale: Column) -> Column:
    """The label itself, else the only label that it names as a word, else the band of the score.

    Bands: at least 0.75 correct, at least 0.25 partial; below, a rationale that tells of
    no answer makes it ``no_answer``, any other ``incorrect``. Without a score nothing
    decides, which is ``judge_error``. A named label stays as it is spelt.
    """
    plain = F.regexp_replace(F.lower(F.trim(F.coalesce(label, F.lit("")))), r"^[\"'`.,:; ]+|[\"'`.,:; ]+$", "")
    key = F.regexp_replace(plain, r"[\s-]+", "_")
    named = F.array_distinct(F.regexp_extract_all(key, F.lit(r"\b(correct|partial|incorrect|no[_ -]?answer)\b"), F.lit(1)))
    said = F.regexp_replace(F.lower(F.coalesce(rationale, F.lit(""))), "[- ]", "_")
    return (
        F.when(key.isin(*LABELS), key)
        .when(F.size(named) == 1, F.element_at(named, 1))
        .when(score.isNull(), F.lit("judge_error"))
        .when(score >= 0.75, F.lit("correct"))
        .when(score >= 0.25, F.lit("partial"))
        .when(said.contains("no_answer") | said.contains("does_not_provide"), F.lit("no_answer"))
        .otherwise(F.lit("incorrect"))
    )


def label_score(label: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, value in SCORES.items():
        out = F.when(label == name, F.lit(value)).otherwise(out)
    return out
