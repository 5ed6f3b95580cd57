"""JSON expressions: completion envelopes, report objects and objects inside free text."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

REPORT = "title string, summary string, rating double, rating_explanation string, findings array<struct<summary string, explanation string>>"


def completion_text(c: Column) -> Column:
    """The message of a chat completion, or the text of a plain one."""
    return F.coalesce(F.get_json_object(c, "$.choices[0].message.content"), F.get_json_object(c, "$.choices[0].text"))


def community_report(c: Column) -> Column:
    return F.from_json(c, REPORT)


def embedding_envelope(texts: Column, vectors: Column, model: str) -> Column:
    """JSON of an embedding service's reply for an array of texts and one of vectors; words are counted as tokens, at least one a text."""
    data = F.transform(vectors, lambda v, i: F.struct(F.lit("embedding").alias("object"), i.alias("index"), v.alias("embedding")))
    n = F.aggregate(texts, F.lit(0), lambda s, t: s + F.greatest(F.lit(1), F.size(F.filter(F.split(t, r"\s+"), lambda x: x != ""))))
    return F.to_json(F.struct(F.lit("list").alias("object"), data.alias("data"), F.lit(model).alias("model"), F.struct(n.alias("prompt_tokens"), n.alias("total_tokens")).alias("usage")))


def _first_object(text: str | None) -> str | None:
    if not text:
        return None
    decoder, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            value, _ = decoder.raw_decode(text, at)
            if isinstance(value, dict):
                return json.dumps(value, ensure_ascii=False)
        except ValueError:
            pass
        at = text.find("{", at + 1)
    return None


def first_json_object(c: Column) -> Column:
    """The first decodable JSON object inside free text or fences, as JSON text; null if there is none.

    A text that is one object is taken as it is; only others go through Python.
    """

    @F.pandas_udf("string")
    def scan(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(_first_object)

    whole = F.trim(c)
    return F.when(whole.startswith("{") & F.try_parse_json(whole).isNotNull(), whole).otherwise(scan(c))
