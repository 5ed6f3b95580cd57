"""Answer metrics on bags of tokens, without a shuffle: both bags are in the row."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions.text import is_blank, normalized_contains, tokens


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays, in one pass over both."""

    @F.pandas_udf("int")
    def shared(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([sum((Counter(x.split(" ")) & Counter(y.split(" "))).values()) if x and y else 0 for x, y in zip(left, right)], dtype="int32")

    return shared(F.array_join(a, " "), F.array_join(b, " "))


def token_f1(prediction: Column, gold: Column) -> Column:
    """struct(precision, recall, f1), rounded to 4; all 0 where nothing is shared."""
    p, g = tokens(prediction), tokens(gold)
    common = overlap(p, g).cast("double")
    precision, recall = common / F.size(p), common / F.size(g)
    some = common > 0
    zero = F.lit(0.0)
    return F.struct(
        F.when(some, F.round(precision, 4)).otherwise(zero).alias("precision"),
        F.when(some, F.round(recall, 4)).otherwise(zero).alias("recall"),
        F.when(some, F.round(2 * precision * recall / (precision + recall), 4)).otherwise(zero).alias("f1"),
    )


def token_judge(prediction: Column, gold: Column) -> Column:
    """struct(label, score): contained or F1 from 0.8 correct, from 0.35 partial, else incorrect."""
    f1 = token_f1(prediction, gold)["f1"]
    right = normalized_contains(prediction, gold) | (f1 >= 0.8)
    return F.struct(
        F.when(right, F.lit("correct")).when(f1 >= 0.35, F.lit("partial")).otherwise(F.lit("incorrect")).alias("label"),
        F.when(right, F.lit(1.0)).when(f1 >= 0.35, F.lit(0.5)).otherwise(F.lit(0.0)).alias("score"),
    )


def judge(mode: str, prediction: Column, gold: Column, reply: Column | None = None) -> Column:
    """struct(enabled, label, score, hallucination, rationale) of an answer by a mode of grading.

    ``none`` does not grade, ``token`` goes by ``token_judge``, ``model`` reads the JSON
    object in a model's ``reply``: a blank answer is no answer whatever the reply, and a
    reply without an object is a judge error.
    """
    from lodestrata.functions.jsonx import first_json_object
    from lodestrata.functions.labels import coerce_label, label_score

    no = F.lit(None)
    graded = lambda enabled, label, score, hallucination, rationale: F.struct(
        F.lit(enabled).alias("enabled"), label.alias("label"), score.cast("double").alias("score"), hallucination.cast("boolean").alias("hallucination"), rationale.alias("rationale")
    )
    if mode == "none":
        return graded(False, F.lit("not_judged"), no, no, F.lit(""))
    if mode == "token":
        t = token_judge(prediction, gold)
        return graded(True, t["label"], t["score"], no, F.concat(F.lit("Token grade at F1 "), token_f1(prediction, gold)["f1"].cast("string")))
    if mode != "model" or reply is None:
        raise ValueError("mode must be none, token or, with replies, model")
    told = first_json_object(reply)
    field = lambda name: F.get_json_object(told, f"$.{name}")
    score = field("score").try_cast("double")
    label = coerce_label(F.coalesce(field("label"), F.lit("judge_error")), score, F.coalesce(field("rationale"), F.lit("")))
    given = F.when(label.isin("correct", "partial", "incorrect", "no_answer"), label_score(label)).otherwise(score)
    blank = is_blank(prediction)
    said = F.lower(F.coalesce(field("hallucination"), F.lit("false")))
    return (
        F.when(blank, graded(True, F.lit("no_answer"), F.lit(0.0), F.lit(False), F.lit("No answer was returned.")))
        .when(told.isNull(), graded(True, F.lit("judge_error"), no, no, F.lit("The reply holds no JSON object.")))
        .otherwise(graded(True, label, given, ~said.isin("false", "0", "null", ""), F.trim(F.coalesce(field("rationale"), F.lit("")))))
    )
