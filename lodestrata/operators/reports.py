"""Reports of communities of a company's graph, and answers from them: map, rate, filter, reduce."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators import context, graph

#: Characters of descriptions that a report is made of, and of the report.
INPUT, OUTPUT = 8000, 2000


def entity_communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(company, name, community) of the last level that an entity is in; one without an edge to another has none."""
    ends = edges.where("source_entity <> target_entity").select(F.concat_ws("\u0001", "company", "source_entity").alias("src"), F.concat_ws("\u0001", "company", "target_entity").alias("dst"))
    parts = graph.bounded_communities(ends)
    last = parts.groupBy("id").agg(F.max_by("community", "level").alias("community"))
    split = F.split("id", "\u0001")
    return last.select(split[0].alias("company"), split[1].alias("name"), F.sha2("community", 256).alias("community")).join(nodes.select("company", "name").distinct(), ["company", "name"], "left_semi")


def community_reports(nodes: DataFrame, edges: DataFrame, most: int = INPUT, limit: int = OUTPUT) -> DataFrame:
    """(company, community, title, report, n_entities): descriptions of the entities, most connected first, as long as ``most`` characters hold them.

    The title names the three most connected. A community without any description has a report of its title.
    """
    merged = nodes.groupBy("company", "name").agg(F.coalesce(F.max("degree"), F.lit(0)).alias("degree"), F.min(F.trim("description")).alias("description"))
    members = merged.join(entity_communities(nodes, edges), ["company", "name"])
    keys = ["company", "community"]
    order = [F.col("degree").desc(), F.col("name")]
    first = members.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    titles = first.groupBy(*keys).agg(F.count("*").alias("n_entities"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", "name")))), lambda x: x["name"]), ", ").alias("title"))
    told = first.where("description <> ''").withColumn("text", F.concat("name", F.lit(": "), "description"))
    held = context.within_budget(told, keys, [F.col("r")], F.length("text").cast("bigint") + 1, most)
    texts = held.groupBy(*keys).agg(F.left(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]), "\n"), F.lit(limit)).alias("report"))
    return titles.join(texts, keys, "left").select(*keys, "title", F.coalesce("report", "title").alias("report"), "n_entities")


def rate_reports(asked: DataFrame, reports: DataFrame, rate: Callable[[Column, Column], Column]) -> DataFrame:
    """(question_id, company, community, title, report, rating) of every report of the companies that a question is asked of; those rated 0 are out."""
    rated = asked.select("question_id", "question", "company").join(reports, "company").withColumn("rating", rate(F.col("question"), F.concat_ws(" ", "title", "report")))
    return rated.where("rating > 0").select("question_id", "company", "community", "title", "report", "rating")


def best_reports(rated: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("question_id", "company").orderBy(F.col("rating").desc(), "community")
    return rated.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def reduce_reports(rated: DataFrame, budget: int) -> DataFrame:
    """(question_id, context, n_evidence): the best rated reports in order, as long as the budget holds them; the best one in any case, cut to it."""
    order = [F.col("rating").desc(), F.col("company"), F.col("community")]
    w = Window.partitionBy("question_id").orderBy(*order)
    cells = rated.withColumn("r", F.row_number().over(w)).withColumn("line", F.left(F.concat(F.lit("["), "company", F.lit("; rating="), F.format_string("%.2f", "rating"), F.lit("] "), "report"), F.lit(budget)))
    held = context.within_budget(cells, ["question_id"], [F.col("r")], F.when(F.col("r") == 1, F.least(F.length("line"), F.lit(budget))).otherwise(F.length("line") + 2).cast("bigint"), budget)
    return held.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"]), "\n\n").alias("context"), F.count("*").alias("n_evidence"))


def of_entities(reports: DataFrame, nodes: DataFrame, seeds: DataFrame, budget: int) -> DataFrame:
    """(question_id, company, reports): reports whose title names a seed entity, by how many seeds they name, within a budget."""
    named = reports.select("company", "community", "report", F.explode(F.split("title", ", ")).alias("name"))
    hits = seeds.select("question_id", "company", "name", "score").join(named, ["company", "name"]).groupBy("question_id", "company", "community").agg(F.sum("score").alias("weight"), F.min("report").alias("report"))
    keys = ["question_id", "company"]
    held = context.within_budget(hits, keys, [F.col("weight").desc(), F.col("community")], F.length("report").cast("bigint") + 2, max(budget, OUTPUT))
    return held.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "community", "report"))), lambda x: x["report"]), "\n\n").alias("reports"))
