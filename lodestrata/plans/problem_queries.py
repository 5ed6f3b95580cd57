"""Queries of the general data problems over the evidence tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import orphans
from lodestrata.session import table


_TABLES = ("chunks", "entities", "relationships")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = orphans.orphaned_references(*[table(spark, d, t) for t in _TABLES])
    return found.where("depth = 0").select("ref_table", "row_id", "ref_field", "ref_value")


def p3_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Every orphaned row of the evidence tables and the depth at which it is."""
    return orphans.orphaned_references(*[table(spark, d, t) for t in _TABLES]).select("ref_table", "row_id", F.col("depth").cast("bigint").alias("depth")).distinct()


def p3_monthly_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.monthly_report(*[table(spark, d, t) for t in _TABLES])


def p3_order_cascade(spark: SparkSession, d: str) -> DataFrame:
    """What the loss of one region's nations orphans: customers, their orders, the orders' lines, by depth."""
    always = F.lit("1900-01-01").cast("timestamp_ntz")

    def key(child: str, row_id: str, field: str, parent: str, parent_id: str, there: str = "true") -> orphans.ForeignKey:
        rows = table(spark, d, child).withColumn("at", always)
        refs = orphans.references(rows, child, row_id, field, F.col(field).cast("string"), F.col(field).cast("string"), parent, "at")
        target = orphans.targets(table(spark, d, parent).where(there).withColumn("at", always), F.col(parent_id).cast("string"), parent_id, "at", None)
        return orphans.ForeignKey(child, parent, refs, target)

    keys = [key("customer", "c_custkey", "c_nationkey", "nation", "n_nationkey", "n_regionkey <> 0"), key("orders", "o_orderkey", "o_custkey", "customer", "c_custkey"), key("lineitem", "l_orderkey", "l_orderkey", "orders", "o_orderkey")]
    return orphans.orphan_cascade(keys).groupBy("ref_table", F.col("depth").cast("bigint").alias("depth")).agg(F.count_distinct("row_id").alias("n"))


_DANGLING = r"""
WITH e AS (SELECT *, lower(regexp_replace(company, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')) || chr(1) ||
    upper(trim(regexp_replace(replace(replace(entity_name, '&amp;', '&'), '&#39;', ''''), '[ \t\r\n]+', ' ', 'g'))) AS k FROM entities),
ends AS (SELECT rel_id, loaded_at, company, 'source_entity' AS f, source_entity AS v FROM relationships
    UNION ALL SELECT rel_id, loaded_at, company, 'target_entity', target_entity FROM relationships),
named AS (SELECT *, upper(trim(regexp_replace(replace(replace(v, '&amp;', '&'), '&#39;', ''''), '[ \t\r\n]+', ' ', 'g'))) AS n FROM ends WHERE v IS NOT NULL),
nref AS (SELECT *, lower(regexp_replace(company, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')) || chr(1) || n AS k FROM named WHERE n <> ''),
items AS (SELECT entity_id, loaded_at, unnest(source_refs) AS v FROM entities),
split AS (SELECT *, regexp_replace(regexp_extract(v, '^((?:.|\n)*):([^:]*):([^:]*)$', 1), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS file,
    regexp_replace(regexp_extract(v, '^((?:.|\n)*):([^:]*):([^:]*)$', 2), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS page FROM items WHERE v IS NOT NULL),
pref AS (SELECT * FROM split WHERE file <> '' AND regexp_matches(page, '^[0-9]+$')),
dangling AS (
SELECT 'relationships' AS ref_table, rel_id AS row_id, f AS ref_field, v AS ref_value FROM nref r
WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.k = r.k AND e.loaded_at <= r.loaded_at AND (e.deleted_at IS NULL OR e.deleted_at > r.loaded_at))
UNION SELECT 'entities', entity_id, 'source_refs', v FROM pref r
WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.source_file = r.file AND CAST(c.page_number AS VARCHAR) = regexp_replace(r.page, '^0+([0-9])', '\1')
    AND c.loaded_at <= r.loaded_at AND (c.deleted_at IS NULL OR c.deleted_at > r.loaded_at)))
"""

_CASCADE = (
    _DANGLING.replace("WITH e AS", "WITH RECURSIVE e AS", 1)
    + """, links AS (SELECT DISTINCT 'relationships' AS child_table, r.rel_id AS child, 'entities' AS parent_table, e.entity_id AS parent FROM nref r JOIN e ON e.k = r.k AND e.loaded_at <= r.loaded_at AND (e.deleted_at IS NULL OR e.deleted_at > r.loaded_at)),
reached(ref_table, row_id, depth) AS (SELECT DISTINCT ref_table, row_id, 0 FROM dangling
    UNION SELECT child_table, child, depth + 1 FROM links JOIN reached ON parent_table = ref_table AND parent = row_id),
orphans AS (SELECT ref_table, row_id, min(depth) AS depth FROM reached GROUP BY 1, 2)
"""
)

SQL = {
    "p3_found": _DANGLING + "SELECT * FROM dangling",
    "p3_orphans": _CASCADE + "SELECT ref_table, row_id, CAST(depth AS BIGINT) AS depth FROM orphans",
    "p3_monthly_report": _CASCADE
    + """, months AS (SELECT DISTINCT 'entities' AS ref_table, entity_id AS row_id, CAST(date_trunc('month', loaded_at) AS DATE) AS month FROM entities
    UNION SELECT DISTINCT 'relationships', rel_id, CAST(date_trunc('month', loaded_at) AS DATE) FROM relationships)
SELECT m.ref_table, m.month, count(*) AS n_rows, count(CASE WHEN depth = 0 THEN 1 END) AS n_direct, count(CASE WHEN depth > 0 THEN 1 END) AS n_inherited
FROM months m LEFT JOIN orphans o ON o.ref_table = m.ref_table AND o.row_id = m.row_id GROUP BY 1, 2""",
    "p3_order_cascade": """WITH RECURSIVE edges(child_table, child, parent_table, parent) AS (SELECT 'orders', o_orderkey, 'customer', o_custkey FROM orders UNION ALL SELECT DISTINCT 'lineitem', l_orderkey, 'orders', l_orderkey FROM lineitem),
reached(t, id, depth) AS (SELECT 'customer', c_custkey, 0 FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 0)
    UNION ALL SELECT 'orders', o_orderkey, 0 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT DISTINCT 'lineitem', l_orderkey, 0 FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION SELECT child_table, child, depth + 1 FROM edges JOIN reached ON parent_table = t AND parent = id)
SELECT t AS ref_table, CAST(depth AS BIGINT) AS depth, count(*) AS n FROM (SELECT t, id, min(depth) AS depth FROM reached GROUP BY 1, 2) GROUP BY 1, 2""",
}

QUERIES = {"p3_found": p3_found, "p3_orphans": p3_orphans, "p3_monthly_report": p3_monthly_report, "p3_order_cascade": p3_order_cascade}
