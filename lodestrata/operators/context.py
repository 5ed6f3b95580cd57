"""Evidence contexts and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import truncate_text

NOT_FOUND = "I could not find evidence for this question in the indexed documents."


def chunk_line(rank: Column, source_file: Column, page: Column, score: Column, text: Column, budget: int) -> Column:
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] "), source_file, F.lit(" p."), F.coalesce(page.cast("string"), F.lit("-1")), F.lit(" score="), F.format_string("%.4f", score), F.lit("\n"), truncate_text(text, budget))


def entity_text(name: Column, kind: Column, description: Column, degree: Column) -> Column:
    """The text of an entity that is embedded."""
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit("Entity: "), part(name), F.lit(". Type: "), part(kind), F.lit(". Description: "), part(description), F.lit(". Degree: "), F.coalesce(degree.cast("string"), F.lit("0")), F.lit("."))


def context_blocks(ranked: DataFrame, line: str, keys: list[str], rank: str = "rank") -> DataFrame:
    """One context per group: its lines in rank order, a blank line between; groups are bounded by top-k before."""
    return ranked.groupBy(*keys).agg(F.count("*").alias("n_items"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, line))), lambda x: x[line]), "\n\n").alias("context"))


def prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("Answer the question from the evidence only.\n\nQuestion: "), question, F.lit("\n\nEvidence:\n"), F.coalesce(context, F.lit(NOT_FOUND)))


def _refs(c: Column) -> Column:
    first = F.array_join(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, 3), ", ")
    return F.when(first == "", F.lit("none")).otherwise(first)


def _number(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("0"))


def entity_line(name: Column, kind: Column, degree: Column, frequency: Column, score: Column, refs: Column, description: Column) -> Column:
    """An entity of a graph context with its first three references."""
    return F.concat(F.lit("- "), name, F.lit(" (type="), F.coalesce(kind, F.lit("")), F.lit(", degree="), _number(degree), F.lit(", freq="), _number(frequency), F.lit(", score="), F.format_string("%.4f", score), F.lit(", refs="), _refs(refs), F.lit(") "), truncate_text(description, 280))


def relationship_line(source: Column, target: Column, weight: Column, degree: Column, score: Column, refs: Column, description: Column) -> Column:
    """A relationship of a graph context with its first three references."""
    return F.concat(F.lit("- "), source, F.lit(" -> "), target, F.lit(" (weight="), F.format_string("%.2f", F.coalesce(weight, F.lit(0.0))), F.lit(", combined_degree="), _number(degree), F.lit(", score="), F.format_string("%.4f", score), F.lit(", refs="), _refs(refs), F.lit(") "), truncate_text(description, 280))


def _section(ranked: DataFrame | None, keys: list[str], name: str, between: str) -> DataFrame | None:
    if ranked is None:
        return None
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"])
    return ranked.groupBy(*keys).agg(F.array_join(lines, between).alias(name))


def graph_context(entities: DataFrame, relationships: DataFrame, chunks: DataFrame | None, keys: list[str]) -> DataFrame:
    """``keys`` and context: three sections of ranked lines (columns rank and line), ``- none`` for an empty one; groups are bounded by top-k before."""
    out = _section(entities, keys, "e", "\n").join(_section(relationships, keys, "r", "\n"), keys, "full")
    out = out.join(_section(chunks, keys, "c", "\n\n"), keys, "full") if chunks is not None else out.withColumn("c", F.lit(None).cast("string"))
    part = lambda c: F.coalesce(c, F.lit("- none"))
    return out.select(*keys, F.concat(F.lit("Entities:\n"), part("e"), F.lit("\n\nRelationships:\n"), part("r"), F.lit("\n\nSupporting Excerpts:\n"), part("c")).alias("context"))


def judge_prompt(kind: Column, companies: Column, question: Column, gold: Column, answer: Column) -> Column:
    """What a model that grades is asked; it replies with one JSON object."""
    rules = "Grade the candidate answer against the gold answer. Missing facts, wrong numbers or units and unsupported claims count against it; the form of citations does not. Reply with one JSON object with label (correct, partial, incorrect or no_answer), score (1.0, 0.5 or 0.0), hallucination (true or false) and rationale."
    return F.concat(F.lit(rules + "\n\nType: "), F.coalesce(kind, F.lit("")), F.lit("\nCompanies: "), F.coalesce(companies, F.lit("")), F.lit("\nQuestion: "), question, F.lit("\nGold answer: "), gold, F.lit("\nCandidate answer: "), F.coalesce(answer, F.lit("")))


def synthesis_prompt(question: Column, answers: Column) -> Column:
    """What a model is asked to make of the answers per company: ``answers`` is their text by company."""
    rules = "Compare the companies from their answers alone. Say of a fact that an answer lacks that it is not available. Keep names, numbers and units."
    return F.concat(F.lit(rules + "\n\nQuestion: "), question, F.lit("\n\nAnswers:\n"), answers)


def company_answers(parts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``keys`` and the answers of all companies as one text, in ``order``: (company, answer) per row."""
    block = F.concat(F.lit("["), F.col("company"), F.lit("]\n"), F.when(F.trim(F.coalesce("answer", F.lit(""))) == "", F.lit("No answer returned.")).otherwise(F.trim("answer")))
    return parts.withColumn("_b", block).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_b"))), lambda x: x["_b"]), "\n").alias("answers"))


def within_budget(df: DataFrame, keys: list[str], order: list[Column], length: Column, budget: int) -> DataFrame:
    """Rows in order for as long as their summed length stays within the budget."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(length).over(w)).where(F.col("used") <= budget)
