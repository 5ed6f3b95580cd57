"""References to records that do not exist (problem 3).

``orphan_cascade`` is a fixpoint over a graph of foreign keys. Depth 0 are the
references that dangle: a left anti join with a validity interval, as the target
must have been loaded at the time of the referencing row and not yet deleted.
Then rows with a reference to a row orphaned in the last round are orphaned
too, found by a semi-join with just those rows, until a round adds none. One
orphaned parent is enough, whatever other rows the reference also resolves to.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.refs import page_ref
from lodestrata.functions.text import company_key, name_key
from lodestrata.session import cut

#: Between the parts of a composite key.
_SEP = "\u0001"


def references(df: DataFrame, table: str, row_id: str, field: str, value: Column, key: Column, parent: str, at: str) -> DataFrame:
    """One row per reference with the key it points to; rows without a key are no reference."""
    return (
        df.select(
            F.lit(table).alias("ref_table"),
            F.col(row_id).cast("string").alias("row_id"),
            F.lit(field).alias("ref_field"),
            value.alias("ref_value"),
            F.lit(parent).alias("parent"),
            key.alias("key"),
            F.col(at).alias("at"),
        )
        .where(F.col("key").isNotNull())
        .distinct()
    )


def targets(df: DataFrame, key: Column, row_id: str | None, valid_from: str, valid_to: str | None) -> DataFrame:
    """Distinct validity intervals of the rows that a key names."""
    cols = [key.alias("key"), F.col(valid_from).alias("valid_from"), (F.col(valid_to) if valid_to else F.lit(None).cast("timestamp_ntz")).alias("valid_to")]
    if row_id:
        cols.append(F.col(row_id).cast("string").alias("target_id"))
    return df.select(*cols).where(F.col("key").isNotNull() & F.col("valid_from").isNotNull()).distinct()


def _exists_at(r: DataFrame, t: DataFrame) -> Column:
    return (r["key"] == t["key"]) & (t["valid_from"] <= r["at"]) & (t["valid_to"].isNull() | (t["valid_to"] > r["at"]))


@dataclass(frozen=True)
class ForeignKey:
    """References of ``child`` (as ``references`` gives them) to rows of ``parent`` (as ``targets`` gives them)."""

    child: str
    parent: str
    refs: DataFrame
    target: DataFrame

    def dangling(self) -> DataFrame:
        """References without a row to point to at their time.

        A row's own time may be null: nothing is known to exist then, and its
        references dangle. Hot keys are split by AQE, which may divide the left
        side of an anti join.
        """
        spans = self.target.select("key", "valid_from", "valid_to").distinct()
        return self.refs.join(spans, _exists_at(self.refs, spans), "left_anti").select(*REFERENCE)

    def inherited(self, orphans: DataFrame) -> DataFrame:
        """References that resolve to one of ``orphans`` (ref_table, row_id); each comes once, however many rows it resolves to."""
        lost = orphans.where(F.col("ref_table") == self.parent).select(F.col("row_id").alias("target_id"))
        spans = self.target.join(lost, "target_id", "left_semi").select("key", "valid_from", "valid_to").distinct()
        return self.refs.join(spans, _exists_at(self.refs, spans), "left_semi").select(*REFERENCE)


REFERENCE = ("ref_table", "row_id", "ref_field", "ref_value")


def orphan_cascade(keys: list[ForeignKey], max_rounds: int = 50) -> DataFrame:
    """(ref_table, row_id, ref_field, ref_value, depth): the references through which rows are orphaned, 0 directly, more inherited.

    A row has the depth at which it is first orphaned. Each round joins only the rows
    that the last one added; it ends at tables that nothing refers to, and cycles end
    as known rows are taken out. A chain deeper than ``max_rounds`` raises an error.
    """
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    found = frontier = cut(union([k.dangling() for k in keys]).distinct().withColumn("depth", F.lit(0)))
    tables = {k.child for k in keys}
    for depth in range(1, max_rounds + 2):
        above = [k for k in keys if k.parent in tables]
        if not above or frontier.isEmpty():
            return found
        new = union([k.inherited(frontier.select("ref_table", "row_id").distinct()) for k in above]).distinct()
        frontier = cut(new.join(found.select("ref_table", "row_id").distinct(), ["ref_table", "row_id"], "left_anti").select(*REFERENCE, F.lit(depth).alias("depth")))
        found = found.unionByName(frontier)
        tables = {k.child for k in above}
    raise RuntimeError(f"the foreign-key graph is deeper than {max_rounds}")


def orphan_report(orphans: DataFrame, rows: DataFrame) -> DataFrame:
    """Counts per table and calendar month: ``rows`` has ref_table, row_id and at.

    An id with several rows counts in each month in which it was loaded; rows
    without a time are in the month null.
    """
    return (
        rows.select("ref_table", "row_id", F.date_trunc("month", "at").cast("date").alias("month"))
        .distinct()
        .join(orphans.select("ref_table", "row_id", (F.col("depth") == 0).alias("is_direct")).distinct(), ["ref_table", "row_id"], "left")
        .groupBy("ref_table", "month")
        .agg(
            F.count("*").alias("n_rows"),
            F.count_if("is_direct").alias("n_direct"),
            F.count_if(~F.col("is_direct")).alias("n_inherited"),
        )
    )


def page_references(entities: DataFrame) -> DataFrame:
    """References of entities to pages, one row per array item."""
    items = entities.select("entity_id", "loaded_at", F.explode("source_refs").alias("item")).withColumn("page", page_ref(F.col("item"))).where(F.col("page").isNotNull())
    return references(items, "entities", "entity_id", "source_refs", F.col("item"), F.concat_ws(_SEP, "page.source_file", "page.page"), "chunks", "loaded_at")


def name_references(relationships: DataFrame) -> DataFrame:
    """References of relationships to entities, one row per named end."""
    ends = [F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("source_entity", "target_entity")]
    named = (
        relationships.select("rel_id", "company", "loaded_at", F.explode(F.array(*ends)).alias("end"))
        .select("rel_id", "company", "loaded_at", "end.field", "end.value")
        .where(name_key("value") != "")
    )
    return (
        named.select(
            F.lit("relationships").alias("ref_table"),
            F.col("rel_id").cast("string").alias("row_id"),
            F.col("field").alias("ref_field"),
            F.col("value").alias("ref_value"),
            F.lit("entities").alias("parent"),
            entity_key("company", "value").alias("key"),
            F.col("loaded_at").alias("at"),
        )
        .distinct()
    )


def entity_key(company: str, name: str) -> Column:
    """Company and name of an entity as one key; a null company is a company of its own."""
    return F.concat(F.coalesce(company_key(company), F.lit("")), F.lit(_SEP), name_key(name))


def evidence_keys(chunks: DataFrame, entities: DataFrame, relationships: DataFrame) -> list[ForeignKey]:
    """Entities refer to pages, relationships to entities."""
    page = F.concat_ws(_SEP, F.regexp_replace("source_file", r"^[ \t\r\n]+|[ \t\r\n]+$", ""), F.col("page_number").cast("string"))
    pages = targets(chunks.where(F.col("page_number").isNotNull() & F.col("source_file").isNotNull()), page, None, "loaded_at", "deleted_at")
    names = targets(entities.where(F.col("entity_name").isNotNull()), entity_key("company", "entity_name"), "entity_id", "loaded_at", "deleted_at")
    return [ForeignKey("entities", "chunks", page_references(entities), pages), ForeignKey("relationships", "entities", name_references(relationships), names)]


def orphaned_references(chunks: DataFrame, entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """The orphaned references of both tables: dangling ones have depth 0."""
    return orphan_cascade(evidence_keys(chunks, entities, relationships))


def monthly_report(chunks: DataFrame, entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Direct and inherited orphans of both tables per calendar month of loaded_at."""
    rows = entities.select(F.lit("entities").alias("ref_table"), F.col("entity_id").cast("string").alias("row_id"), F.col("loaded_at").alias("at")).unionByName(
        relationships.select(F.lit("relationships").alias("ref_table"), F.col("rel_id").cast("string").alias("row_id"), F.col("loaded_at").alias("at"))
    )
    return orphan_report(orphaned_references(chunks, entities, relationships), rows)
