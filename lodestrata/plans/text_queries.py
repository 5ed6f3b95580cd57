"""Text, page, chunk, record and context operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import jsonx
from lodestrata.functions.refs import source_ref
from lodestrata.functions.text import company_key, split_list, strip_ansi, tokens, truncate_text
from lodestrata.operators import chunking, context, pages, records, retrieval
from lodestrata.plans.graph_queries import ck, nk
from lodestrata.session import table

_WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def truncated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("text is not null").select("id", truncate_text(F.col("text"), 280).alias("short")).distinct()


_SQUEEZE = rf"trim(regexp_replace(text, '{_WS}', ' ', 'g'))"
_TRUNCATE = f"""SELECT DISTINCT id, CASE WHEN length(t) <= 280 THEN t ELSE rtrim(CASE WHEN b > 0 AND b < 280 THEN substring(h, 1, 280 - b) ELSE h END) || ' ...' END AS short
FROM (SELECT id, t, left(t, 280) AS h, instr(reverse(left(t, 280)), ' ') AS b FROM (SELECT id, {_SQUEEZE} AS t FROM chunks WHERE text IS NOT NULL))"""


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts per token of all answers."""
    rows = table(spark, d, "qa_log").select(F.explode(tokens(F.col("answer"))).alias("token"))
    return rows.groupBy("token").agg(F.count("*").alias("n"))


_TOKENS = "regexp_extract_all(replace(lower(coalesce({c}, '')), 'co₂e', 'co2e'), '[a-z0-9]+')"


def source_refs(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "entities").select(F.explode("source_refs").alias("ref")).where("ref is not null").distinct()
    extra = spark.range(1).select(F.explode(F.array(*map(F.lit, ["f:12:u", "a:f:12:u", "f:12", "7:abc", "f", ":12:u"]))).alias("ref"))
    return refs.unionByName(extra).distinct().withColumn("r", source_ref(F.col("ref"))).select("ref", "r.source_file", "r.page_number")


_THREE = "^((?:.|\\n)*):([^:]*):([^:]*)$"
_SOURCE_REF = f"""WITH r AS (SELECT DISTINCT ref, trim(ref) AS t FROM (SELECT unnest(source_refs) AS ref FROM entities UNION ALL SELECT unnest(['f:12:u', 'a:f:12:u', 'f:12', '7:abc', 'f', ':12:u'])) WHERE ref IS NOT NULL),
p AS (SELECT ref, CASE WHEN regexp_matches(t, '{_THREE}') THEN trim(regexp_extract(t, '{_THREE}', 1)) WHEN regexp_matches(t, '^[^:]*:[^:]*$') THEN trim(regexp_extract(t, '^([^:]*):', 1)) END AS f,
    TRY_CAST(CASE WHEN regexp_matches(t, '{_THREE}') THEN trim(regexp_extract(t, '{_THREE}', 2)) WHEN regexp_matches(t, '^[^:]*:[^:]*$') THEN trim(regexp_extract(t, '^([^:]*):', 1)) END AS BIGINT) AS n FROM r)
SELECT ref, CASE WHEN f <> '' AND n IS NOT NULL THEN f END AS source_file, CASE WHEN f <> '' THEN n END AS page_number FROM p"""


def marked_documents(spark: SparkSession, d: str) -> DataFrame:
    """One page-marked text per report, from its chunks in page order; every seventh page is empty."""
    rows = table(spark, d, "chunks").where("text is not null and page_ordinal is not null").groupBy("source_file", "page_ordinal").agg(F.min("text").alias("text"))
    body = F.when(F.col("page_ordinal") % 7 == 0, F.lit("")).otherwise(F.concat(F.regexp_replace("text", "\r", ""), F.lit("\n")))
    page = F.concat(F.lit("--- PAGE "), F.col("page_ordinal").cast("string"), F.lit(" START ---\n"), body, F.lit("--- PAGE "), F.col("page_ordinal").cast("string"), F.lit(" END ---"))
    return rows.select("source_file", "page_ordinal", page.alias("p")).groupBy("source_file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_ordinal", "p"))), lambda x: x["p"]), "\n").alias("text"))


def page_split(spark: SparkSession, d: str) -> DataFrame:
    out = pages.split_pages(marked_documents(spark, d), "source_file", "text")
    return out.select("file", "page", "page_file", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("hash"))


def page_counts(spark: SparkSession, d: str) -> DataFrame:
    return pages.page_counts(pages.split_pages(marked_documents(spark, d), "source_file", "text"))


_PAGE_SPLIT = r"""WITH p AS (SELECT source_file AS file, CAST(page_ordinal AS BIGINT) AS page, CASE WHEN page_ordinal % 7 = 0 THEN '' ELSE regexp_replace(replace(min(text), chr(13), ''), '^\n+|\n+$', '', 'g') END AS t
FROM chunks WHERE text IS NOT NULL AND page_ordinal IS NOT NULL GROUP BY source_file, page_ordinal)
SELECT file, page, regexp_replace(file, '\.[^.]*$', '') || '_page_' || CASE WHEN page >= 100 THEN CAST(page AS VARCHAR) ELSE lpad(CAST(page AS VARCHAR), 3, '0') END || '.md' AS page_file, length(t) AS n_chars, md5(t) AS hash FROM p"""


def page_errors(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong once the start markers of pages 3, 13, 23 and so on are gone."""
    broken = marked_documents(spark, d).withColumn("text", F.regexp_replace("text", r"--- PAGE \d*3 START ---\n", ""))
    return pages.page_errors(broken, "source_file", "text").groupBy("error").agg(F.count("*").alias("n"))


_PAGE_ERRORS = "SELECT 'end without start' AS error, count(DISTINCT source_file) AS n FROM chunks WHERE text IS NOT NULL AND page_ordinal % 10 = 3"


def page_tags(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").where("text is not null").select("id", F.array_join(pages.page_number_tags(F.col("text")), ",").alias("tags")).where("tags <> ''")
    return rows.distinct()


def page_ordinals(spark: SparkSession, d: str) -> DataFrame:
    pages_ = table(spark, d, "chunks").select("source_file", "id").distinct()
    return pages.ordinals(pages_, ["source_file"], [F.col("id").asc()])


def overlap_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").where("page_ordinal is not null").groupBy("source_file", "page_ordinal", "id").agg(F.min("text").alias("text"))
    out = chunking.overlap_pages(rows, ["source_file"], [F.col("page_ordinal"), F.col("id")], "text")
    return out.select("id", F.length("chunk").cast("bigint").alias("n_chars"), F.md5("chunk").alias("hash"))


_OVERLAP = """WITH p AS (SELECT source_file, page_ordinal, id, min(text) AS text FROM chunks WHERE page_ordinal IS NOT NULL GROUP BY 1, 2, 3),
w AS (SELECT id, text, lag(text) OVER o AS a, lead(text) OVER o AS b FROM p WINDOW o AS (PARTITION BY source_file ORDER BY page_ordinal, id)),
c AS (SELECT id, coalesce(substring(a, length(a) - length(a) // 2 + 1, length(a) // 2), '') || coalesce(text, '') || coalesce(substring(b, 1, length(b) // 2), '') AS chunk FROM w)
SELECT id, length(chunk) AS n_chars, md5(chunk) AS hash FROM c"""


def sliding_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", chunking.words(F.col("text")).alias("t"))
    out = chunking.sliding_chunks(rows, "doc_id", "t")
    return out.select(F.col("id").alias("doc_id"), F.col("chunk_no").cast("bigint").alias("chunk_no"), F.col("n_tokens").cast("bigint").alias("n_tokens"), F.md5("chunk").alias("hash"))


_SLIDING = r"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\t\n\x0B\f\r ]+'), lambda x: x <> '') AS t FROM documents),
s AS (SELECT doc_id, t, unnest(range(0, CAST(greatest(1, ceil((len(t) - 120) / 1080.0)) AS BIGINT))) AS chunk_no FROM d WHERE len(t) > 0)
SELECT doc_id, chunk_no, len(list_slice(t, chunk_no * 1080 + 1, chunk_no * 1080 + 1200)) AS n_tokens, md5(array_to_string(list_slice(t, chunk_no * 1080 + 1, chunk_no * 1080 + 1200), ' ')) AS hash FROM s"""


def text_units(spark: SparkSession, d: str) -> DataFrame:
    out = chunking.units(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", 3200)
    return out.select(F.col("id").alias("doc_id"), F.col("unit_no").cast("bigint").alias("unit_no"), F.md5("unit").alias("hash"))


_UNITS = """SELECT doc_id, unit_no, md5(substring(text, unit_no * 3200 + 1, 3200)) AS hash FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 3200.0) AS BIGINT))) AS unit_no FROM documents WHERE length(text) > 0)"""


def usage_estimate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "qa_log").select("run_method", chunking.usage(F.regexp_replace(F.coalesce("answer", F.lit("")), r"[\x{85}\x{A0}\x{200B}]", "_")).alias("n"))
    return rows.groupBy("run_method").agg(F.sum("n").alias("tokens"))



def extraction_texts(spark: SparkSession, d: str) -> DataFrame:
    """One response of delimiter records per order, made from its lines, with the usual defects."""
    weight = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.col("l_linenumber").cast("string"), F.lit(">"))).otherwise(F.col("l_linenumber").cast("string"))
    relation = F.concat(F.lit('("relationship"<|>s'), F.col("l_suppkey").cast("string"), F.lit("<|>p&amp;"), F.col("l_partkey").cast("string"), F.lit("<|>metric=quantity; value=1,0"), F.col("l_linenumber").cast("string"), F.lit("; unit=kg; period=2024<|>"), weight, F.lit(")"))
    entity = F.concat(F.lit('("entity"<|>s'), F.col("l_suppkey").cast("string"), F.lit("<|>org<|>line "), F.col("l_linenumber").cast("string"), F.lit(")##(\"relationship\"<|>a<|>b<|>short)"))
    record = F.when(F.col("l_linenumber") % 4 == 1, entity).otherwise(relation)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", record.alias("record")).groupBy("l_orderkey")
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "record"))), lambda x: x["record"]), "##").alias("text"))


def record_parse(spark: SparkSession, d: str) -> DataFrame:
    out = records.parse_records(extraction_texts(spark, d), "l_orderkey", "text")
    return out.groupBy("kind", "name", "other").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 2).alias("weight"))


_RECORDS = """SELECT kind, name, other, count(*) AS n, round(sum(w), 2) AS weight FROM (
SELECT 'entity' AS kind, 'S' || l_suppkey AS name, 'ORG' AS other, CAST(NULL AS DOUBLE) AS w FROM lineitem WHERE l_linenumber % 4 = 1
UNION ALL SELECT 'rejected', NULL, NULL, NULL FROM lineitem WHERE l_linenumber % 4 = 1
UNION ALL SELECT 'relationship', 'S' || l_suppkey, 'P&' || l_partkey, CASE WHEN l_linenumber % 3 = 0 THEN 1.0 ELSE l_linenumber END FROM lineitem WHERE l_linenumber % 4 <> 1) GROUP BY 1, 2, 3"""


def record_weights(spark: SparkSession, d: str) -> DataFrame:
    return records.record_weights(records.parse_records(extraction_texts(spark, d), "l_orderkey", "text"))


_WEIGHTS = """SELECT 'S' || l_suppkey AS source, 'P&' || l_partkey AS target, sum(CASE WHEN l_linenumber % 3 = 0 THEN 1.0::DOUBLE ELSE l_linenumber END) AS weight FROM lineitem WHERE l_linenumber % 4 <> 1 GROUP BY 1, 2"""


def attr_parse(spark: SparkSession, d: str) -> DataFrame:
    parsed = records.parse_records(extraction_texts(spark, d), "l_orderkey", "text").where("kind = 'relationship'")
    out = records.parse_attributes(parsed, "id", "description")
    return out.groupBy("metric", "unit", "period", "number").agg(F.count("*").alias("n"))


_ATTRS = "SELECT 'quantity' AS metric, 'kg' AS unit, '2024' AS period, CAST('10' || l_linenumber AS DOUBLE) AS number, count(*) AS n FROM lineitem WHERE l_linenumber % 4 <> 1 GROUP BY 1, 2, 3, 4"


def noun_phrases(spark: SparkSession, d: str) -> DataFrame:
    return records.noun_phrases(table(spark, d, "documents").where("text is not null"), "doc_id", "text").groupBy("phrase").agg(F.sum("n").alias("n"))


def json_props(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_type", F.variant_get(F.try_parse_json("props"), "$.k", "double").alias("k"))
    return rows.groupBy("event_type").agg(F.count("k").alias("n"), F.round(F.avg("k"), 4).alias("mean"))


def json_unwrap(spark: SparkSession, d: str) -> DataFrame:
    """Messages inside completion envelopes, which are built from the answers."""
    rows = table(spark, d, "qa_log").where("answer is not null").select("qa_id", "answer").distinct()
    body = rows.withColumn("body", F.when(F.col("qa_id") % 2 == 0, F.to_json(F.struct(F.array(F.struct(F.struct(F.col("answer").alias("content")).alias("message"))).alias("choices")))).otherwise(F.to_json(F.struct(F.array(F.struct(F.col("answer").alias("text"))).alias("choices")))))
    return body.select("qa_id", jsonx.completion_text(F.col("body")).alias("answer"))


def json_objects(spark: SparkSession, d: str) -> DataFrame:
    """The first object inside free text around the events' properties."""
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit("Sure {not json}: ```json\n"), "props", F.lit("\n``` {}"))).alias("t"))
    return rows.select("event_id", F.get_json_object(jsonx.first_json_object(F.col("t")), "$.k").cast("double").alias("k"))


def context_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The context and prompt of every question from its five best pages of one company."""
    from lodestrata.plans.graph_queries import rag_topk_batch

    texts = table(spark, d, "chunks").groupBy("id").agg(F.min("source_file").alias("source_file"), F.min("page_number").alias("page_number"), F.min(F.coalesce("text", F.lit(""))).alias("text"))
    ranked = rag_topk_batch(spark, d).join(texts, "id")
    lines = ranked.withColumn("line", context.chunk_line(F.col("rank"), F.col("source_file"), F.col("page_number"), F.col("score"), F.col("text"), 220))
    blocks = context.context_blocks(lines, "line", ["question_id", "company"])
    return blocks.select("question_id", "company", "n_items", F.md5(context.prompt(F.col("question_id"), F.col("context"))).alias("prompt_hash"), F.length("context").cast("bigint").alias("n_chars"))


def entity_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entities")
    return rows.select("entity_id", context.entity_text(F.col("entity_name"), F.col("entity_type"), F.col("entity_description"), F.col("degree")).alias("text")).distinct()


def report_budget(spark: SparkSession, d: str) -> DataFrame:
    """Entity descriptions per company, most connected first, for as long as 8,000 characters hold them."""
    rows = table(spark, d, "entities").groupBy("entity_id").agg(F.min(company_key("company")).alias("company"), F.max("degree").alias("degree"), F.min(F.length("entity_description")).cast("bigint").alias("n")).where("n is not null")
    out = context.within_budget(rows, ["company"], [F.col("degree").desc_nulls_last(), F.col("entity_id")], F.col("n"), 8000)
    return out.groupBy("company").agg(F.count("*").alias("n_entities"), F.max("used").alias("used"))


_BUDGET = f"""WITH e AS (SELECT entity_id, min({ck('company')}) AS company, max(degree) AS degree, min(length(entity_description)) AS n FROM entities GROUP BY 1),
u AS (SELECT company, sum(n) OVER (PARTITION BY company ORDER BY degree DESC NULLS LAST, entity_id ROWS UNBOUNDED PRECEDING) AS used FROM e WHERE n IS NOT NULL)
SELECT company, count(*) AS n_entities, CAST(max(used) AS BIGINT) AS used FROM u WHERE used <= 8000 GROUP BY 1"""


def graph_contexts(spark: SparkSession, d: str) -> DataFrame:
    """The graph context of every question and company: its entity, relationship and excerpt lines, and the prompt from all of them."""
    from lodestrata.plans import graph_queries as g

    seeds = g._seeds(spark, d)
    ranked = retrieval.rank_relationships(seeds, g._edges(spark, d), 20)
    details = table(spark, d, "entities").groupBy("entity_id").agg(F.min("entity_type").alias("type"), F.max("degree").alias("degree"), F.max("frequency").alias("frequency"), F.min("entity_description").alias("description"))
    entities = seeds.join(details, seeds["id"] == details["entity_id"]).withColumn("line", context.entity_line(F.col("name"), F.col("type"), F.col("degree"), F.col("frequency"), F.col("score"), F.col("source_refs"), F.col("description")))
    edges = ranked.withColumn("line", context.relationship_line(F.col("source_entity"), F.col("target_entity"), F.col("weight"), F.col("combined_degree"), F.col("score"), F.col("source_refs"), F.lit(None).cast("string")))
    blocks = context.graph_context(entities, edges, None, ["question_id", "company"])
    return blocks.select("question_id", "company", F.md5("context").alias("hash"), F.length("context").cast("bigint").alias("n_chars"))


def judge_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The prompt that grades each answer of the log against its question."""
    q = table(spark, d, "qa_log").where("question is not null").select("qa_id", "question", "answer", "companies", "run_method").distinct()
    return q.select("qa_id", F.md5(context.judge_prompt(F.col("run_method"), F.array_join("companies", ", "), F.col("question"), F.lit("gold"), F.col("answer"))).alias("hash")).distinct()


_JUDGE = """SELECT DISTINCT qa_id, md5('Grade the candidate answer against the gold answer. Missing facts, wrong numbers or units and unsupported claims count against it; the form of citations does not. Reply with one JSON object with label (correct, partial, incorrect or no_answer), score (1.0, 0.5 or 0.0), hallucination (true or false) and rationale.'
|| chr(10) || chr(10) || 'Type: ' || coalesce(run_method, '') || chr(10) || 'Companies: ' || coalesce(array_to_string(companies, ', '), '') || chr(10) || 'Question: ' || question || chr(10) || 'Gold answer: gold' || chr(10) || 'Candidate answer: ' || coalesce(answer, '')) AS hash FROM qa_log WHERE question IS NOT NULL"""


def company_answers(spark: SparkSession, d: str) -> DataFrame:
    """The prompt that makes one answer of those of several companies; here a company's answer is the question's, but every fifth has none."""
    q = table(spark, d, "qa_log").where("question is not null and size(companies) > 0").groupBy("qa_id").agg(F.min("question").alias("question"), F.min(F.array_join("companies", "|")).alias("c"))
    parts = q.select("qa_id", "question", F.posexplode(F.split("c", r"\|")).alias("place", "company")).withColumn("answer", F.when((F.col("qa_id") + F.col("place")) % 5 == 0, F.lit(" ")).otherwise(F.col("question")))
    texts = context.company_answers(parts, ["qa_id"], "place").join(q.select("qa_id", "question"), "qa_id")
    return texts.select("qa_id", F.md5(context.synthesis_prompt(F.col("question"), F.col("answers"))).alias("hash"))


_ANSWERS = """WITH q AS (SELECT qa_id, min(question) AS question, min(array_to_string(companies, '|')) AS c FROM qa_log WHERE question IS NOT NULL AND len(companies) > 0 GROUP BY 1),
p AS (SELECT qa_id, question, unnest(string_split(c, '|')) AS company, unnest(range(0, len(string_split(c, '|')))) AS place FROM q),
b AS (SELECT qa_id, question, string_agg('[' || company || ']' || chr(10) || CASE WHEN (qa_id + place) % 5 = 0 OR trim(question) = '' THEN 'No answer returned.' ELSE trim(question) END, chr(10) ORDER BY place) AS answers FROM p GROUP BY 1, 2)
SELECT qa_id, md5('Compare the companies from their answers alone. Say of a fact that an answer lacks that it is not available. Keep names, numbers and units.' || chr(10) || chr(10) || 'Question: ' || question || chr(10) || chr(10) || 'Answers:' || chr(10) || answers) AS hash FROM b"""


def rated_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports rated for the stated questions (ids divisible by 100) of their companies and reduced to a context; entities' descriptions stand for reports."""
    from lodestrata.operators import graph_build, reports
    from lodestrata.plans.hooks import word_overlap

    q = table(spark, d, "qa_log").where("qa_id % 100 = 0 and question is not null").select(F.col("qa_id").cast("string").alias("question_id"), "question", F.explode("companies").alias("company"))
    asked = q.select("question_id", "question", company_key("company").alias("company")).distinct()
    texts = graph_build.summarise_descriptions(table(spark, d, "entities")).select("company", F.col("name").alias("community"), F.col("name").alias("title"), F.col("summary").alias("report"))
    rated = reports.rate_reports(asked, texts, word_overlap)
    return reports.reduce_reports(rated, 2200).select("question_id", "n_evidence", F.md5("context").alias("hash"), F.length("context").cast("bigint").alias("n_chars"))


_RATED = f"""WITH a AS (SELECT DISTINCT CAST(qa_id AS VARCHAR) AS question_id, question, {ck('c')} AS company FROM (SELECT qa_id, question, unnest(companies) AS c FROM qa_log WHERE qa_id % 100 = 0 AND question IS NOT NULL)),
ds AS (SELECT DISTINCT {ck('company')} AS company, {nk('entity_name')} AS name, trim(entity_description) AS d FROM entities WHERE {nk('entity_name')} <> '' AND trim(entity_description) <> ''),
rp AS (SELECT company, name, left(string_agg(d, ' ' ORDER BY d), 500) AS report FROM ds GROUP BY 1, 2),
m AS (SELECT question_id, a.company, name, report, list_distinct({_TOKENS.format(c='question')}) AS q, list_distinct({_TOKENS.format(c="name || ' ' || report")}) AS t FROM a JOIN rp ON rp.company = a.company),
r AS (SELECT question_id, company, name, report, round(100 * len(list_intersect(q, t))::DOUBLE / len(q), 2) AS rating FROM m WHERE len(q) > 0),
o AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY rating DESC, company, name) AS r, left('[' || company || '; rating=' || printf('%.2f', rating) || '] ' || report, 2200) AS line FROM r WHERE rating > 0),
u AS (SELECT *, sum(CASE WHEN r = 1 THEN least(length(line), 2200) ELSE length(line) + 2 END) OVER (PARTITION BY question_id ORDER BY r ROWS UNBOUNDED PRECEDING) AS used FROM o)
SELECT question_id, count(*) AS n_evidence, md5(string_agg(line, chr(10) || chr(10) ORDER BY r)) AS hash, length(string_agg(line, chr(10) || chr(10) ORDER BY r)) AS n_chars FROM u WHERE used <= 2200 GROUP BY 1"""


def _cut_at(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) <= {n} THEN {c} ELSE rtrim(CASE WHEN instr(reverse(left({c}, {n})), ' ') BETWEEN 1 AND {n - 1} THEN substring({c}, 1, {n} - instr(reverse(left({c}, {n})), ' ')) ELSE left({c}, {n}) END) || ' ...' END"


def _graph_sql() -> str:
    from lodestrata.plans import graph_queries as g

    refs = "coalesce(nullif(array_to_string(list_slice(string_split(refs, chr(2)), 1, 3), ', '), ''), 'none')"
    return f"""{g._SEEDS}, {g._EDGES}, dt AS (SELECT entity_id, min(entity_type) AS type, max(degree) AS degree, max(frequency) AS frequency, trim(regexp_replace(coalesce(min(entity_description), ''), '{_WS}', ' ', 'g')) AS d FROM entities GROUP BY 1),
el AS (SELECT question_id, company, string_agg('- ' || name || ' (type=' || coalesce(type, '') || ', degree=' || coalesce(degree, 0) || ', freq=' || coalesce(frequency, 0) || ', score=' || printf('%.4f', score) || ', refs=' || {refs} || ') ' || {_cut_at('d', 280)}, chr(10) ORDER BY rank) AS e FROM seeds JOIN dt ON dt.entity_id = seeds.id GROUP BY 1, 2),
rn AS (SELECT question_id, company, string_agg('- ' || s || ' -> ' || t || ' (weight=' || printf('%.2f', coalesce(weight, 0)) || ', combined_degree=' || coalesce(cd, 0) || ', score=' || printf('%.4f', score) || ', refs=' || {refs} || ') ', chr(10) ORDER BY rank) AS r FROM ranked GROUP BY 1, 2),
c AS (SELECT coalesce(el.question_id, rn.question_id) AS question_id, coalesce(el.company, rn.company) AS company, 'Entities:' || chr(10) || coalesce(e, '- none') || chr(10) || chr(10) || 'Relationships:' || chr(10) || coalesce(r, '- none') || chr(10) || chr(10) || 'Supporting Excerpts:' || chr(10) || '- none' AS context
FROM el FULL JOIN rn ON rn.question_id = el.question_id AND rn.company = el.company)
SELECT question_id, company, md5(context) AS hash, length(context) AS n_chars FROM c"""


def top_refs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").select("entity_id", F.array_join(F.slice("source_refs", 1, 3), ", ").alias("refs")).distinct()


def ansi_and_lists(spark: SparkSession, d: str) -> DataFrame:
    """Terminal colours taken off and comma lists split: both over the events' types."""
    rows = table(spark, d, "events").select("event_id", F.concat(F.lit("\u001b[31m"), "event_type", F.lit("\u001b[0m , , x ")).alias("t"))
    return rows.select("event_id", F.array_join(split_list(strip_ansi(F.col("t"))), "|").alias("items"))


def cache_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose content hash an earlier load has not seen: what is left for an index to do."""
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", "ingested_at", F.sha2("text", 256).alias("hash"))
    seen = rows.where("ingested_at < timestamp_ntz'2024-07-01 00:00:00'").select("hash").distinct()
    return rows.where("ingested_at >= timestamp_ntz'2024-07-01 00:00:00'").join(seen, "hash", "left_anti").groupBy("hash").agg(F.min("doc_id").alias("doc_id"))


QUERIES = {
    f.__name__: f
    for f in (token_counts, source_refs, page_split, page_counts, page_errors, page_tags, page_ordinals, overlap_chunks, sliding_chunks, text_units, usage_estimate, record_parse, record_weights, attr_parse, noun_phrases, json_props, json_unwrap, json_objects, context_blocks, entity_texts, report_budget, top_refs, graph_contexts, judge_prompts, company_answers, rated_reports, ansi_and_lists, cache_dedupe)
} | {"truncate_text": truncated}

_CONTEXT = f"""WITH qv AS (SELECT entity_id AS question_id, embedding AS q FROM entity_embeddings WHERE len(embedding) > 0 AND CAST(regexp_extract(entity_id, '([0-9]+)$', 1) AS BIGINT) % 100 = 0),
c AS (SELECT DISTINCT id, {ck('company')} AS company, embedding AS e FROM chunks WHERE len(embedding) > 0),
s AS (SELECT question_id, company, id, round(list_dot_product(list_slice(q, 1, len(e))::DOUBLE[], list_slice(e, 1, len(q))::DOUBLE[]), 10) AS score FROM qv, c),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id, company ORDER BY score DESC, id) AS rank FROM s),
x AS (SELECT id, min(source_file) AS f, min(page_number) AS p, trim(regexp_replace(min(coalesce(text, '')), '{_WS}', ' ', 'g')) AS t FROM chunks GROUP BY 1),
y AS (SELECT r.question_id, r.company, rank, '[' || rank || '] ' || f || ' p.' || coalesce(CAST(p AS VARCHAR), '-1') || ' score=' || printf('%.4f', round(score, 4)) || chr(10) ||
    CASE WHEN length(t) <= 220 THEN t ELSE rtrim(CASE WHEN instr(reverse(left(t, 220)), ' ') BETWEEN 1 AND 219 THEN substring(t, 1, 220 - instr(reverse(left(t, 220)), ' ')) ELSE left(t, 220) END) || ' ...' END AS line
    FROM r JOIN x ON x.id = r.id WHERE rank <= 5),
z AS (SELECT question_id, company, count(*) AS n_items, string_agg(line, chr(10) || chr(10) ORDER BY rank) AS context FROM y GROUP BY 1, 2)
SELECT question_id, company, n_items, md5('Answer the question from the evidence only.' || chr(10) || chr(10) || 'Question: ' || question_id || chr(10) || chr(10) || 'Evidence:' || chr(10) || context) AS prompt_hash, length(context) AS n_chars FROM z"""

SQL = {
    "truncate_text": _TRUNCATE,
    "token_counts": f"SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS.format(c='answer')}) AS token FROM qa_log) GROUP BY 1",
    "source_refs": _SOURCE_REF,
    "page_split": _PAGE_SPLIT,
    "page_counts": "SELECT file, count(*) AS n_pages, count(CASE WHEN n = 0 OR page % 7 = 0 THEN 1 END) AS n_empty FROM (SELECT source_file AS file, page_ordinal AS page, length(regexp_replace(replace(min(text), chr(13), ''), '^\\n+|\\n+$', '', 'g')) AS n FROM chunks WHERE text IS NOT NULL AND page_ordinal IS NOT NULL GROUP BY 1, 2) GROUP BY 1",
    "page_errors": _PAGE_ERRORS,
    "page_tags": "SELECT DISTINCT id, array_to_string(regexp_extract_all(text, '<page_number>((?:.|\\n)*?)</page_number>', 1), ',') AS tags FROM chunks WHERE contains(text, '</page_number>')",
    "page_ordinals": "SELECT source_file, id, row_number() OVER (PARTITION BY source_file ORDER BY id) AS ordinal FROM (SELECT DISTINCT source_file, id FROM chunks)",
    "overlap_chunks": _OVERLAP,
    "sliding_chunks": _SLIDING,
    "text_units": _UNITS,
    "usage_estimate": r"SELECT run_method, CAST(sum(greatest(1, len(regexp_extract_all(coalesce(answer, ''), '[^\s\x0B]+')))) AS BIGINT) AS tokens FROM qa_log GROUP BY 1",
    "record_parse": _RECORDS,
    "record_weights": _WEIGHTS,
    "attr_parse": _ATTRS,
    "noun_phrases": r"SELECT phrase, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\b[A-Z][a-z]+(?: [A-Z][a-z]+){1,3}\b')) AS phrase FROM documents WHERE text IS NOT NULL) GROUP BY 1",
    "json_props": "SELECT event_type, count(k) AS n, round(avg(k), 4) AS mean FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events) GROUP BY 1",
    "json_unwrap": "SELECT DISTINCT qa_id, answer FROM qa_log WHERE answer IS NOT NULL",
    "json_objects": "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events",
    "context_blocks": _CONTEXT,
    "graph_contexts": _graph_sql(),
    "judge_prompts": _JUDGE,
    "company_answers": _ANSWERS,
    "rated_reports": _RATED,
    "entity_texts": "SELECT DISTINCT entity_id, 'Entity: ' || coalesce(entity_name, '') || '. Type: ' || coalesce(entity_type, '') || '. Description: ' || coalesce(entity_description, '') || '. Degree: ' || coalesce(CAST(degree AS VARCHAR), '0') || '.' AS text FROM entities",
    "report_budget": _BUDGET,
    "top_refs": "SELECT DISTINCT entity_id, array_to_string(list_slice(source_refs, 1, 3), ', ') AS refs FROM entities",
    "ansi_and_lists": "SELECT event_id, event_type || '|x' AS items FROM events",
    "cache_dedupe": "WITH r AS (SELECT doc_id, ingested_at, sha256(text) AS hash FROM documents WHERE text IS NOT NULL) SELECT hash, min(doc_id) AS doc_id FROM r WHERE ingested_at >= TIMESTAMP '2024-07-01' AND hash NOT IN (SELECT hash FROM r WHERE ingested_at < TIMESTAMP '2024-07-01') GROUP BY 1",
}
