"""Queries of the problems in this subpackage over the evidence tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import company_key
from lodestrata.llm import names, neighbours, packing, pairs, scans, splitting, subjects, tokenize, topn
from lodestrata.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "chunks"), "id", "text").select("id", "cut_level").distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "chunks"), "id", "text", file_col="source_file", ordinal_col="page_ordinal")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return names.entity_pairs(names.entity_groups(table(spark, d, "entities")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    windows = table(spark, d, "retrieved_chunks").select("question_id", company_key("company").alias("company"), "id", "score")
    return topn.top_n_per_group(windows, ["question_id", "company"], "score", "id", 5).select("question_id", "company", "id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = None
    for name, key in (("chunks", "id"), ("entity_embeddings", "entity_id")):
        near = neighbours.nearest(table(spark, d, name), key, "embedding", 64, 5, 0.9)
        pairs = near.select(F.lit(name).alias("vec_table"), F.least("id", "neighbour").alias("key_a"), F.greatest("id", "neighbour").alias("key_b")).distinct()
        found = pairs if found is None else found.unionByName(pairs)
    return found


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar vectors, however far, of every vector whose number is divisible by 100: chosen from the neighbours of all."""
    near = neighbours.nearest(table(spark, d, "entity_embeddings"), "entity_id", "embedding", 64, 5)
    return near.where(F.regexp_extract("id", "([0-9]+)$", 1).cast("bigint") % 100 == 0).select("id", "neighbour", F.round("cosine", 4).alias("cosine"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defective_pairs(table(spark, d, "qa_log"), table(spark, d, "subject_samples"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.repair_pages(table(spark, d, "chunks")).select("id", F.explode("noise").alias("noise")).distinct()


def p7_pages(spark: SparkSession, d: str) -> DataFrame:
    return scans.repair_pages(table(spark, d, "chunks"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_texts(table(spark, d, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(table(spark, d, "documents"), "doc_id", "text", 2048)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    mixture = subjects.document_subjects(table(spark, d, "documents"), table(spark, d, "subject_samples"))
    return mixture.where(F.col("share") >= 0.2).select("doc_id", "subject").distinct()


_BLANK = r"(\r?\n)[ \t]*(\r?\n)[ \t\r\n]*"

SQL = {
    "p1_found": rf"""
WITH big AS (SELECT DISTINCT id, text FROM chunks WHERE length(text) > 2000),
par AS (SELECT id, text, unnest(string_split_regex(text, '{_BLANK}')) AS p FROM big),
sen AS (SELECT id, text, p, unnest(string_split_regex(regexp_replace(p, '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'), chr(1))) AS s FROM par),
wrd AS (SELECT id, text, p, s, unnest(string_split_regex(s, '[ \t\r\n]+')) AS w FROM sen),
m AS (SELECT id, text, max(length(trim(p, chr(32) || chr(9) || chr(10) || chr(13)))) AS mp, max(length(trim(s, chr(32) || chr(9) || chr(10) || chr(13)))) AS ms, max(length(w)) AS mw FROM wrd GROUP BY id, text)
SELECT DISTINCT id, CASE WHEN mp <= 2000 THEN 'paragraph' WHEN ms <= 2000 THEN 'sentence' WHEN mw <= 2000 THEN 'word' ELSE 'forced' END AS cut_level FROM m""",
    "p5_found": """
WITH v AS (SELECT 'chunks' AS t, id AS k, any_value(embedding) AS e FROM chunks WHERE len(embedding) = 64 AND list_count(embedding) = 64 AND (list_max(embedding) > 0 OR list_min(embedding) < 0) GROUP BY id
    UNION ALL SELECT 'entity_embeddings', entity_id, any_value(embedding) FROM entity_embeddings WHERE len(embedding) = 64 AND list_count(embedding) = 64 AND (list_max(embedding) > 0 OR list_min(embedding) < 0) GROUP BY entity_id),
p AS (SELECT a.t, a.k AS ka, b.k AS kb, list_cosine_similarity(a.e::DOUBLE[], b.e::DOUBLE[]) AS c FROM v a JOIN v b ON a.t = b.t AND a.k <> b.k),
r AS (SELECT *, row_number() OVER (PARTITION BY t, ka ORDER BY c DESC, kb) AS r FROM p WHERE c >= 0.9)
SELECT DISTINCT t AS vec_table, least(ka, kb) AS key_a, greatest(ka, kb) AS key_b FROM r WHERE r <= 5""",
    "p5_neighbours": """
WITH v AS (SELECT entity_id AS k, any_value(embedding) AS e FROM entity_embeddings WHERE len(embedding) = 64 AND list_count(embedding) = 64 AND (list_max(embedding) > 0 OR list_min(embedding) < 0) GROUP BY 1),
p AS (SELECT a.k AS id, b.k AS neighbour, list_cosine_similarity(a.e::DOUBLE[], b.e::DOUBLE[]) AS c FROM v a JOIN v b ON a.k <> b.k WHERE CAST(regexp_extract(a.k, '([0-9]+)$', 1) AS BIGINT) % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, neighbour) AS r FROM p)
SELECT id, neighbour, round(c, 4) AS cosine FROM r WHERE r <= 5""",
    "p4_found": r"""
WITH w AS (SELECT question_id, lower(regexp_replace(company, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')) AS company, id, max(score) AS score
    FROM retrieved_chunks WHERE score IS NOT NULL AND NOT isnan(score) AND id IS NOT NULL GROUP BY 1, 2, 3)
SELECT question_id, company, id FROM (SELECT *, row_number() OVER (PARTITION BY question_id, company ORDER BY score DESC, id) AS r FROM w) WHERE r <= 5""",
}

QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p2_found": p2_found, "p4_found": p4_found, "p5_found": p5_found, "p5_neighbours": p5_neighbours, "p6_found": p6_found, "p7_found": p7_found, "p7_pages": p7_pages, "p8_ids": p8_ids, "p9_containers": p9_containers, "p10_found": p10_found}
