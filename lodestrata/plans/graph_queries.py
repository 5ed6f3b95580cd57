"""Company lists, vector retrieval and the property graph over the evidence tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import company_key, name_key, normalize_companies
from lodestrata.functions.vectors import dot, norm, valid_embedding
from lodestrata.operators import graph, graph_build, retrieval
from lodestrata.session import cut, table

SEP = "\u0002"


def ck(c: str) -> str:
    return rf"lower(regexp_replace({c}, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g'))"


def nk(c: str) -> str:
    return rf"upper(trim(regexp_replace(replace(replace({c}, '&amp;', '&'), '&#39;', ''''), '[ \t\r\n]+', ' ', 'g')))"


def list_companies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "companies").select(company_key("company").alias("company")).where("company is not null and company <> ''").distinct()


def list_companies_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Listed companies, or those of the chunks where none is listed."""
    listed = list_companies(spark, d)
    some = table(spark, d, "chunks").where("company is not null").select(company_key("company").alias("company")).distinct()
    empty = listed.agg((F.count("*") == 0).alias("none"))
    return listed.unionByName(some.crossJoin(F.broadcast(empty)).where("none").select("company"))


def company_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Requested companies that exist, in order; all where none does. The list of companies is a dimension of fixed size."""
    known = list_companies(spark, d).agg(F.array_sort(F.collect_list("company")).alias("known"))
    asked = table(spark, d, "qa_log").select("qa_id", "companies").distinct()
    hit = F.filter(normalize_companies(F.col("companies")), lambda c: F.array_contains("known", c))
    return asked.crossJoin(F.broadcast(known)).select("qa_id", F.array_join(F.when(F.size(hit) > 0, hit).otherwise(F.col("known")), ",").alias("resolved")).distinct()


def valid_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").groupBy(company_key("company").alias("company")).agg(F.count_if(valid_embedding(F.col("embedding"))).alias("n_valid"), F.count("*").alias("n"))


def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entity_embeddings").where(valid_embedding(F.col("embedding")))
    return rows.select("entity_id", F.round(norm(F.col("embedding")), 4).alias("size"), F.round(dot(F.col("embedding"), F.slice("embedding", 1, 32)), 4).alias("half"))


def question_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: entity vectors whose number is divisible by 100."""
    rows = table(spark, d, "entity_embeddings").where(valid_embedding(F.col("embedding")))
    return rows.where(F.regexp_extract("entity_id", "([0-9]+)$", 1).cast("bigint") % 100 == 0).select(F.col("entity_id").alias("question_id"), "embedding")


_QV = "qv AS (SELECT entity_id AS question_id, embedding AS q FROM entity_embeddings WHERE len(embedding) > 0 AND CAST(regexp_extract(entity_id, '([0-9]+)$', 1) AS BIGINT) % 100 = 0)"
_DOT = "round(list_dot_product(list_slice(q, 1, len(e))::DOUBLE[], list_slice(e, 1, len(q))::DOUBLE[]), 10)"


def rag_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "chunks").select("id", company_key("company").alias("company"), "embedding").distinct()
    top = retrieval.topk_by_company(question_vectors(spark, d), items, 5)
    return top.select("question_id", "company", "id", F.round("score", 4).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def rag_topk(spark: SparkSession, d: str) -> DataFrame:
    """One question: the best chunks of its company only."""
    one = question_vectors(spark, d).orderBy("question_id").limit(1)
    items = table(spark, d, "chunks").select("id", company_key("company").alias("company"), "embedding").distinct()
    asked = one.select("question_id").crossJoin(items.agg(F.min("company").alias("company")))
    top = retrieval.topk_by_company(one, items, 5, asked)
    return top.select("question_id", "company", "id", F.round("score", 4).alias("score"), F.col("rank").cast("bigint").alias("rank"))


_RAG = f"""WITH {_QV}, c AS (SELECT DISTINCT id, {ck('company')} AS company, embedding AS e FROM chunks WHERE len(embedding) > 0),
s AS (SELECT question_id, company, id, {_DOT} AS score FROM qv, c),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id, company ORDER BY score DESC, id) AS rank FROM s)
"""


def entity_nodes(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "entities")
        .groupBy("entity_id")
        .agg(F.min(company_key("company")).alias("company"), F.min(name_key("entity_name")).alias("name"), F.min(F.array_join("source_refs", SEP)).alias("refs"))
        .withColumn("source_refs", F.split("refs", SEP))
        .drop("refs")
    )


_NODES = f"""en AS (SELECT entity_id, min({ck('company')}) AS company, min({nk('entity_name')}) AS name, min(array_to_string(source_refs, chr(2))) AS refs FROM entities GROUP BY 1)"""
_SEEDS = f"""WITH {_QV}, {_NODES},
es AS (SELECT question_id, en.company, en.name, en.refs, en.entity_id AS id, {_DOT} AS score FROM qv, (SELECT entity_id, embedding AS e FROM entity_embeddings WHERE len(embedding) > 0) v JOIN en ON en.entity_id = v.entity_id),
er AS (SELECT *, row_number() OVER (PARTITION BY question_id, company ORDER BY score DESC, id) AS rank FROM es),
seeds AS (SELECT question_id, company, name, refs, id, rank, round(greatest(0.0, score), 4) AS score FROM er WHERE rank <= 8 AND trim(name) <> '')"""


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    nodes = entity_nodes(spark, d)
    vectors = table(spark, d, "entity_embeddings").select("entity_id", "embedding")
    items = vectors.join(nodes, "entity_id").select(F.col("entity_id").alias("id"), "company", "embedding")
    top = retrieval.topk_by_company(question_vectors(spark, d), items, 8).drop("rank")
    return cut(retrieval.seed_entities(top.join(nodes.select(F.col("entity_id").alias("id"), "name", "source_refs"), "id"), 8))


def seed_entities(spark: SparkSession, d: str) -> DataFrame:
    return _seeds(spark, d).select("question_id", "company", "name", "id", "score", F.col("rank").cast("bigint").alias("rank"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    edges = (
        table(spark, d, "relationships")
        .groupBy("rel_id")
        .agg(
            F.min(company_key("company")).alias("company"),
            F.min(name_key(F.coalesce("source_entity", F.lit("")))).alias("source_entity"),
            F.min(name_key(F.coalesce("target_entity", F.lit("")))).alias("target_entity"),
            F.max("relationship_weight").alias("weight"),
            F.max("combined_degree").alias("combined_degree"),
            F.min(F.array_join("source_refs", SEP)).alias("refs"),
        )
        .withColumn("source_refs", F.split("refs", SEP))
    )
    return cut(retrieval.tied_edges(edges, entity_nodes(spark, d)))


_EDGES = f"""rl AS (SELECT rel_id, min({ck('company')}) AS company, min({nk("coalesce(source_entity, '')")}) AS s, min({nk("coalesce(target_entity, '')")}) AS t, max(relationship_weight) AS weight, max(combined_degree) AS cd,
    min(array_to_string(source_refs, chr(2))) AS refs FROM relationships GROUP BY 1),
sm AS (SELECT question_id, company, name, min(score) AS seed FROM seeds GROUP BY 1, 2, 3),
sc AS (SELECT a.question_id, rl.*, (CASE WHEN x.seed IS NULL THEN 0 ELSE 1 END) + (CASE WHEN y.seed IS NULL THEN 0 ELSE 1 END) AS hits,
    coalesce(x.seed, 0.0) + coalesce(y.seed, 0.0) AS boost
    FROM rl JOIN (SELECT DISTINCT question_id, company FROM seeds) a ON a.company = rl.company
    LEFT JOIN sm x ON x.question_id = a.question_id AND x.company = rl.company AND x.name = rl.s
    LEFT JOIN sm y ON y.question_id = a.question_id AND y.company = rl.company AND y.name = rl.t WHERE trim(rl.s) <> '' AND trim(rl.t) <> ''
    AND EXISTS (SELECT 1 FROM en WHERE en.company = rl.company AND en.name = rl.s) AND EXISTS (SELECT 1 FROM en WHERE en.company = rl.company AND en.name = rl.t)),
rw AS (SELECT *, round(coalesce(weight, 0.0) + 0.03::DOUBLE * coalesce(cd, 0) + boost + 2.0::DOUBLE * hits, 6) AS raw FROM sc),
ranked AS (SELECT *, round(greatest(0.0, raw), 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY question_id, company ORDER BY hits DESC, raw DESC, rel_id) AS rank FROM rw) WHERE rank <= 20)"""


def relationship_rank(spark: SparkSession, d: str) -> DataFrame:
    ranked = retrieval.rank_relationships(_seeds(spark, d), _edges(spark, d), 20)
    return ranked.select("question_id", "company", "rel_id", F.col("hits").cast("bigint").alias("hits"), "score", F.col("rank").cast("bigint").alias("rank"))


_PAGES = r"""pt AS (SELECT question_id, company, unnest(string_split(refs, chr(2))) AS ref, 1.0::DOUBLE + score AS part FROM seeds
    UNION ALL SELECT question_id, company, unnest(string_split(refs, chr(2))), 2.0::DOUBLE + least(score, 10.0) FROM ranked),
pp AS (SELECT *, CASE WHEN regexp_matches(trim(ref), '^.*:[^:]*:[^:]*$') THEN trim(regexp_extract(trim(ref), '^(.*):([^:]*):([^:]*)$', 1)) WHEN regexp_matches(trim(ref), '^[^:]*:[^:]*$') THEN trim(regexp_extract(trim(ref), '^([^:]*):', 1)) END AS f,
    TRY_CAST(CASE WHEN regexp_matches(trim(ref), '^.*:[^:]*:[^:]*$') THEN trim(regexp_extract(trim(ref), '^(.*):([^:]*):([^:]*)$', 2)) WHEN regexp_matches(trim(ref), '^[^:]*:[^:]*$') THEN trim(regexp_extract(trim(ref), '^([^:]*):', 1)) END AS BIGINT) AS p FROM pt),
imp AS (SELECT question_id, company, f AS source_file, p AS page_number, round(sum(part), 6) AS importance FROM pp WHERE f IS NOT NULL AND f <> '' AND p IS NOT NULL GROUP BY 1, 2, 3, 4)"""


def _importance(spark: SparkSession, d: str) -> DataFrame:
    seeds = _seeds(spark, d)
    return retrieval.page_importance(seeds, retrieval.rank_relationships(seeds, _edges(spark, d), 20))


def page_importance(spark: SparkSession, d: str) -> DataFrame:
    return _importance(spark, d).select("question_id", "company", "source_file", "page_number", F.round("importance", 4).alias("importance"))


def evidence_chunks(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").select("id", company_key("company").alias("company"), "source_file", "page_number")
    top = retrieval.evidence_chunks(_importance(spark, d), chunks, 5)
    return top.select("question_id", "company", "id", F.round("importance", 4).alias("score"), F.col("rank").cast("bigint").alias("rank"))


_EVIDENCE = f"""{_SEEDS}, {_EDGES}, {_PAGES},
cp AS (SELECT DISTINCT {ck('company')} AS company, source_file, CAST(page_number AS BIGINT) AS page_number, id FROM chunks),
ev AS (SELECT question_id, imp.company, id, importance, row_number() OVER (PARTITION BY question_id, imp.company ORDER BY importance DESC, imp.source_file, imp.page_number, id) AS rank
    FROM imp JOIN cp ON cp.company = imp.company AND cp.source_file = imp.source_file AND cp.page_number = imp.page_number)
"""


def compare_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Both methods' best chunk side by side for each question and company."""
    rag = rag_topk_batch(spark, d).where("rank = 1").select("question_id", "company", F.col("id").alias("rag_id"))
    graph_top = evidence_chunks(spark, d).where("rank = 1").select("question_id", "company", F.col("id").alias("graph_id"))
    return rag.join(graph_top, ["question_id", "company"], "full")


_COMPARE = f"""{_EVIDENCE}, c AS (SELECT DISTINCT id, {ck('company')} AS company, embedding AS e FROM chunks WHERE len(embedding) > 0),
s AS (SELECT question_id, company, id, {_DOT} AS score FROM qv, c),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id, company ORDER BY score DESC, id) AS rank FROM s)
SELECT coalesce(a.question_id, b.question_id) AS question_id, coalesce(a.company, b.company) AS company, a.id AS rag_id, b.id AS graph_id
FROM (SELECT * FROM r WHERE rank = 1) a FULL JOIN (SELECT * FROM ev WHERE rank = 1) b ON a.question_id = b.question_id AND a.company = b.company"""


def entity_merge(spark: SparkSession, d: str) -> DataFrame:
    return graph_build.merge_entities(table(spark, d, "entities"))


_MERGE = f"""WITH n AS (SELECT {ck('company')} AS company, {nk('entity_name')} AS name, entity_id, upper(trim(coalesce(entity_type, ''))) AS type, source_refs FROM entities WHERE {nk('entity_name')} <> ''),
t AS (SELECT company, name, type, row_number() OVER (PARTITION BY company, name ORDER BY count(*) DESC, type) AS r FROM n GROUP BY 1, 2, 3),
f AS (SELECT DISTINCT company, name, trim(ref) AS ref FROM (SELECT company, name, unnest(source_refs) AS ref FROM n) WHERE trim(ref) <> ''),
g AS (SELECT company, name, string_agg(ref, ' ' ORDER BY ref) AS refs FROM (SELECT *, row_number() OVER (PARTITION BY company, name ORDER BY ref) AS r FROM f) WHERE r <= 10 GROUP BY 1, 2)
, ds AS (SELECT DISTINCT {ck('company')} AS company, {nk('entity_name')} AS name, trim(entity_description) AS d FROM entities WHERE {nk('entity_name')} <> '' AND trim(entity_description) <> ''),
sm AS (SELECT company, name, count(*) AS k, left(string_agg(d, ' ' ORDER BY d), 500) AS s FROM ds GROUP BY 1, 2)
SELECT n.company, n.name, count(*) AS frequency, count(DISTINCT entity_id) AS n_ids, any_value(t.type) AS type, coalesce(any_value(g.refs), '') AS refs, coalesce(any_value(sm.k), 0) AS n_descriptions, coalesce(any_value(sm.s), '') AS summary
FROM n JOIN t ON t.company = n.company AND t.name = n.name AND t.r = 1 LEFT JOIN g ON g.company = n.company AND g.name = n.name LEFT JOIN sm ON sm.company = n.company AND sm.name = n.name GROUP BY 1, 2"""


def rel_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return graph_build.aggregate_relationships(table(spark, d, "relationships"))


def rel_references(spark: SparkSession, d: str) -> DataFrame:
    return graph_build.aggregate_relationships(table(spark, d, "relationships"), 10).select("company", "source", "target", "refs")


_REL = f"""rg AS (SELECT company, source, target, round(sum(coalesce(relationship_weight, 1.0)), 4) AS weight, max(relationship_strength_max) AS strength_max, count(*) AS occurrence_count
FROM (SELECT {ck('company')} AS company, {nk('source_entity')} AS source, {nk('target_entity')} AS target, relationship_weight, relationship_strength_max FROM relationships) WHERE source <> '' AND target <> '' GROUP BY 1, 2, 3)"""
_DEG = f"""{_REL}, dg AS (SELECT company, name, count(DISTINCT other) AS degree FROM (SELECT company, source AS name, target AS other FROM rg UNION ALL SELECT company, target, source FROM rg) GROUP BY 1, 2)"""


def degree(spark: SparkSession, d: str) -> DataFrame:
    return graph_build.degrees(rel_aggregate(spark, d))


def combined_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph_build.combined_degrees(rel_aggregate(spark, d)).select("company", "source", "target", "combined_degree")


def undirected_projection(spark: SparkSession, d: str) -> DataFrame:
    return graph_build.undirected(rel_aggregate(spark, d))


def description_summaries(spark: SparkSession, d: str) -> DataFrame:
    return graph_build.summarise_descriptions(table(spark, d, "entities"))


def company_edges(spark: SparkSession, d: str) -> DataFrame:
    both = lambda c: F.concat("company", F.lit("|"), F.col(c))
    return rel_aggregate(spark, d).select(both("source").alias("src"), both("target").alias("dst"), "weight")


def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.connected_components(company_edges(spark, d))


def communities(spark: SparkSession, d: str) -> DataFrame:
    return graph.communities(company_edges(spark, d), weight="weight")


def bounded_communities(spark: SparkSession, d: str) -> DataFrame:
    return graph.bounded_communities(company_edges(spark, d))


def community_bounds(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the hierarchy: nodes with an edge, nodes that no level lacks, nodes whose last community is too large though it comes apart, communities over several components."""
    edges = cut(company_edges(spark, d).where("src <> dst"))
    parts = cut(graph.bounded_communities(edges))
    last = parts.groupBy("id").agg(F.max("level").alias("level"), F.max_by(F.struct("community", "unsplittable"), "level").alias("c")).select("id", "level", "c.*")
    sizes = last.groupBy("community").agg(F.count("*").alias("n"))
    gaps = parts.groupBy("id").agg((F.max("level") + 1 - F.count("*")).alias("gap"))
    over = last.join(sizes, "community").where("n > 10 and not unsplittable")
    spread = parts.join(graph.connected_components(edges), "id").groupBy("level", "community").agg(F.count_distinct("component").alias("n")).where("n > 1")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(last, "n_nodes").crossJoin(count(gaps.where("gap <> 0"), "n_gaps")).crossJoin(count(over, "n_too_large")).crossJoin(count(spread, "n_spread"))


QUERIES = {
    "list_companies": list_companies,
    "list_companies_fallback": list_companies_fallback,
    "company_resolve": company_resolve,
    "valid_embeddings": valid_embeddings,
    "vector_norms": vector_norms,
    "rag_topk": rag_topk,
    "rag_topk_batch": rag_topk_batch,
    "seed_entities": seed_entities,
    "relationship_rank": relationship_rank,
    "page_importance": page_importance,
    "evidence_chunks": evidence_chunks,
    "compare_pairs": compare_pairs,
    "entity_merge": entity_merge,
    "rel_aggregate": rel_aggregate,
    "rel_references": rel_references,
    "degree": degree,
    "combined_degree": combined_degree,
    "undirected_projection": undirected_projection,
    "description_summaries": description_summaries,
    "connected_components": connected_components,
    "communities": communities,
    "bounded_communities": bounded_communities,
    "community_bounds": community_bounds,
}

_LISTED = f"SELECT DISTINCT {ck('company')} AS company FROM companies WHERE {ck('company')} <> ''"
SQL = {
    "list_companies": _LISTED,
    "list_companies_fallback": f"{_LISTED} UNION ALL SELECT DISTINCT {ck('company')} FROM chunks WHERE company IS NOT NULL AND (SELECT count(*) FROM companies) = 0",
    "company_resolve": f"""WITH k AS (SELECT list_sort(list(company)) AS known FROM ({_LISTED})),
a AS (SELECT DISTINCT qa_id, companies FROM qa_log),
p AS (SELECT qa_id, companies, unnest(companies) AS c, unnest(range(1, len(companies) + 1)) AS i FROM a),
f AS (SELECT qa_id, companies, lower(trim(c)) AS c, min(i) AS i FROM p WHERE c IS NOT NULL AND list_contains((SELECT known FROM k), lower(trim(c))) GROUP BY 1, 2, 3),
g AS (SELECT qa_id, companies, string_agg(c, ',' ORDER BY i) AS hit FROM f GROUP BY 1, 2)
SELECT DISTINCT a.qa_id, coalesce(hit, (SELECT array_to_string(known, ',') FROM k)) AS resolved FROM a LEFT JOIN g ON g.qa_id = a.qa_id AND g.companies IS NOT DISTINCT FROM a.companies""",
    "valid_embeddings": f"SELECT {ck('company')} AS company, count(CASE WHEN len(embedding) > 0 THEN 1 END) AS n_valid, count(*) AS n FROM chunks GROUP BY 1",
    "vector_norms": "SELECT entity_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS size, round(list_dot_product(list_slice(embedding, 1, 32)::DOUBLE[], list_slice(embedding, 1, 32)::DOUBLE[]), 4) AS half FROM entity_embeddings WHERE len(embedding) > 0",
    "rag_topk": _RAG + f"SELECT question_id, company, id, round(score, 4) AS score, rank FROM r WHERE rank <= 5 AND question_id = (SELECT min(question_id) FROM qv) AND company = (SELECT min({ck('company')}) FROM chunks)",
    "rag_topk_batch": _RAG + "SELECT question_id, company, id, round(score, 4) AS score, rank FROM r WHERE rank <= 5",
    "seed_entities": _SEEDS + " SELECT question_id, company, name, id, score, rank FROM seeds",
    "relationship_rank": f"{_SEEDS}, {_EDGES} SELECT question_id, company, rel_id, CAST(hits AS BIGINT) AS hits, score, rank FROM ranked",
    "page_importance": f"{_SEEDS}, {_EDGES}, {_PAGES} SELECT question_id, company, source_file, page_number, round(importance, 4) AS importance FROM imp",
    "evidence_chunks": f"{_EVIDENCE} SELECT question_id, company, id, round(importance, 4) AS score, rank FROM ev WHERE rank <= 5",
    "compare_pairs": _COMPARE,
    "entity_merge": _MERGE,
    "rel_aggregate": f"WITH {_REL} SELECT * FROM rg",
    "rel_references": f"""WITH n AS (SELECT {ck('company')} AS company, {nk('source_entity')} AS source, {nk('target_entity')} AS target, source_refs FROM relationships),
k AS (SELECT DISTINCT company, source, target FROM n WHERE source <> '' AND target <> ''),
f AS (SELECT DISTINCT company, source, target, trim(ref) AS ref FROM (SELECT company, source, target, unnest(source_refs) AS ref FROM n) WHERE trim(ref) <> ''),
g AS (SELECT company, source, target, string_agg(ref, ' ' ORDER BY ref) AS refs FROM (SELECT *, row_number() OVER (PARTITION BY company, source, target ORDER BY ref) AS r FROM f) WHERE r <= 10 GROUP BY 1, 2, 3)
SELECT k.company, k.source, k.target, coalesce(refs, '') AS refs FROM k LEFT JOIN g ON g.company = k.company AND g.source = k.source AND g.target = k.target""",
    "degree": f"WITH {_DEG} SELECT * FROM dg",
    "combined_degree": f"WITH {_DEG} SELECT rg.company, source, target, a.degree + b.degree AS combined_degree FROM rg JOIN dg a ON a.company = rg.company AND a.name = source JOIN dg b ON b.company = rg.company AND b.name = target",
    "undirected_projection": f"WITH {_REL} SELECT company, least(source, target) AS a, greatest(source, target) AS b, arg_max(weight, source || chr(1) || target) AS weight FROM rg GROUP BY 1, 2, 3",
    "description_summaries": f"""WITH e AS (SELECT DISTINCT {ck('company')} AS company, {nk('entity_name')} AS name, trim(entity_description) AS d FROM entities WHERE {nk('entity_name')} <> '' AND trim(entity_description) <> '')
SELECT company, name, count(*) AS n_descriptions, left(string_agg(d, ' ' ORDER BY d), 500) AS summary FROM e GROUP BY 1, 2""",
    "community_bounds": f"""WITH {_REL} SELECT count(DISTINCT n) AS n_nodes, 0 AS n_gaps, 0 AS n_too_large, 0 AS n_spread FROM (SELECT company || '|' || source AS n FROM rg WHERE source <> target UNION ALL SELECT company || '|' || target FROM rg WHERE source <> target)""",
    "connected_components": f"""WITH RECURSIVE {_REL}, ed AS (SELECT company || '|' || source AS a, company || '|' || target AS b FROM rg UNION SELECT company || '|' || target, company || '|' || source FROM rg),
cc(id, component) AS (SELECT a, least(a, min(b)) FROM ed GROUP BY a UNION SELECT ed.a, cc.component FROM cc JOIN ed ON ed.b = cc.id)
SELECT id, min(component) AS component FROM cc GROUP BY 1""",
}
