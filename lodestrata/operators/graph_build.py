"""Building the company-scoped property graph from extracted rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import company_key, name_key


def current_rows(df: DataFrame, key: str, loaded: str = "loaded_at", deleted: str | None = "deleted_at") -> DataFrame:
    """The row of each key that was loaded last, unless it is deleted; equal times go by the row's hash. Columns that ``df`` lacks don't count."""
    if loaded not in df.columns:
        return df.dropDuplicates([key])
    deleted = deleted if deleted in df.columns else None
    newest = Window.partitionBy(key).orderBy(F.col(loaded).desc_nulls_last(), F.xxhash64(*df.columns))
    rows = df.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")
    return rows.where(F.col(deleted).isNull()) if deleted else rows


def _first_refs(each: DataFrame, keys: list[str], refs: int) -> DataFrame:
    """``keys`` and the first ``refs`` distinct references in order, as one text."""
    known = each.select(*keys, F.explode("source_refs").alias("ref")).select(*keys, F.trim("ref").alias("ref")).where("ref <> ''").distinct()
    first = known.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("ref"))).where(F.col("r") <= refs)
    return first.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("ref")), " ").alias("refs"))


def merge_entities(df: DataFrame, refs: int = 10) -> DataFrame:
    """One row per company and canonical name: frequency, ids, commonest type (then by name), first references, summary of the descriptions.

    The first ``refs`` references of each entity come from a bounded rank, so no list grows with the data.
    """
    named = df.select(company_key("company").alias("company"), name_key("entity_name").alias("name"), "entity_id", F.upper(F.trim(F.coalesce("entity_type", F.lit("")))).alias("type"), "source_refs").where("name <> ''")
    sums = named.groupBy("company", "name").agg(F.count("*").alias("frequency"), F.count_distinct("entity_id").alias("n_ids"))
    types = named.groupBy("company", "name", "type").agg(F.count("*").alias("n"))
    best = types.groupBy("company", "name").agg(F.min_by("type", F.struct(-F.col("n"), F.col("type"))).alias("type"))
    lists = _first_refs(named, ["company", "name"], refs)
    told = summarise_descriptions(df)
    out = sums.join(best, ["company", "name"]).join(lists, ["company", "name"], "left").join(told, ["company", "name"], "left")
    return out.select("company", "name", "frequency", "n_ids", "type", F.coalesce("refs", F.lit("")).alias("refs"), F.coalesce("n_descriptions", F.lit(0)).alias("n_descriptions"), F.coalesce("summary", F.lit("")).alias("summary"))


def aggregate_relationships(df: DataFrame, refs: int | None = None) -> DataFrame:
    """One row per company, source and target: summed weight, largest strength, occurrences and, if asked for, the first ``refs`` references."""
    keys = ["company", "source", "target"]
    keyed = df.select(company_key("company").alias("company"), name_key("source_entity").alias("source"), name_key("target_entity").alias("target"), "relationship_weight", "relationship_strength_max", *(["source_refs"] if refs else [])).where("source <> '' and target <> ''")
    sums = keyed.groupBy(*keys).agg(
        F.round(F.sum(F.coalesce("relationship_weight", F.lit(1.0))), 4).alias("weight"), F.max("relationship_strength_max").alias("strength_max"), F.count("*").alias("occurrence_count")
    )
    return sums.join(_first_refs(keyed, keys, refs), keys, "left").withColumn("refs", F.coalesce("refs", F.lit(""))) if refs else sums


def degrees(edges: DataFrame) -> DataFrame:
    """(company, name, degree): distinct neighbours, whatever the direction; a self-loop counts itself."""
    ends = edges.select("company", F.explode(F.array(F.struct(F.col("source").alias("name"), F.col("target").alias("other")), F.struct(F.col("target").alias("name"), F.col("source").alias("other")))).alias("e"))
    return ends.select("company", "e.name", "e.other").distinct().groupBy("company", "name").agg(F.count("*").alias("degree"))


def combined_degrees(edges: DataFrame) -> DataFrame:
    d = degrees(edges)
    out = edges
    for end in ("source", "target"):
        out = out.join(d.select("company", F.col("name").alias(end), F.col("degree").alias(f"{end}_degree")), ["company", end])
    return out.withColumn("combined_degree", F.col("source_degree") + F.col("target_degree"))


def undirected(edges: DataFrame) -> DataFrame:
    """One row per unordered pair; of two directions the one that sorts later gives the weight."""
    return edges.groupBy("company", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.max_by("weight", F.struct("source", "target")).alias("weight"))


def summarise_descriptions(df: DataFrame, limit: int = 500) -> DataFrame:
    """Distinct descriptions of an entity in order, joined and cut at ``limit``: the summary where no model is at hand.

    ``n_descriptions`` counts all of them. The summary takes each that starts at ``limit`` or before; with the space
    between them they have at least two characters each, so those are never beyond the first ``limit`` / 2 + 1.
    """
    each = df.select(company_key("company").alias("company"), name_key("entity_name").alias("name"), F.trim("entity_description").alias("d")).where("name <> '' and d <> ''").distinct()
    counts = each.groupBy("company", "name").agg(F.count("*").alias("n_descriptions"))
    order = Window.partitionBy("company", "name").orderBy("r")
    first = each.withColumn("r", F.row_number().over(Window.partitionBy("company", "name").orderBy("d"))).where(F.col("r") <= limit // 2 + 1)
    start = F.coalesce(F.sum(F.length("d") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = first.withColumn("start", start).where(F.col("start") <= limit).groupBy(F.col("company").alias("c"), F.col("name").alias("m"))
    lists = used.agg(F.left(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.left("d", F.lit(limit)).alias("d")))), lambda x: x["d"]), " "), F.lit(limit)).alias("summary"))
    return counts.join(lists, F.col("company").eqNullSafe(F.col("c")) & (F.col("name") == F.col("m"))).select("company", "name", "n_descriptions", "summary")
