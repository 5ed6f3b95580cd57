"""Readers: page-marked text, question files, response caches, graph snapshots, binary folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import is_blank
from lodestrata.operators import evaluation
from lodestrata.operators.ranking import positions

QUESTION = "id string, type string, question string, gold_answer string, company string, companies array<string>, subquestions map<string,string>"
EXTRACTION = "result struct<response: struct<choices: array<struct<finish_reason: string, index: bigint, message: struct<content: string>>>, model: string>, metrics: struct<prompt_tokens: bigint, completion_tokens: bigint, total_tokens: bigint, compute_duration_seconds: double, retries: bigint>>"


def whole_texts(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """(path, file, text) of whole text files."""
    rows = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path, wholetext=True)
    where = F.col("_metadata.file_path")
    return rows.select(where.alias("path"), F.element_at(F.split(where, "/"), -1).alias("file"), F.col("value").alias("text"))


def _object(value: Column, schema: str) -> Column:
    return F.when(F.trim(value).startswith("{") & F.try_parse_json(value).isNotNull(), F.from_json(value, schema))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a line-wise JSON file; blank lines are skipped and any other line that is no object is an error that names the file and the line's text.

    Files are split between tasks, so a line's number isn't known here: ``jsonl_errors`` tells it.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file")).where(~is_blank(F.col("value")))
    parsed = raw.withColumn("o", _object(F.col("value"), schema))
    where = F.concat(F.col("file"), F.lit(": no JSON object: "), F.left("value", F.lit(80)))
    checked = parsed.withColumn("o", F.when(F.col("o").isNull(), F.raise_error(where).cast(parsed.schema["o"].dataType)).otherwise(F.col("o")))
    return checked.select("o.*")


def jsonl_errors(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line_no, value) of the lines that are no object, numbered from 1; whole files are read."""
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    lines = whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("k", "value")).where(~is_blank(F.col("value")))
    return lines.where(_object(F.col("value"), schema).isNull()).select("file", (F.col("k") + 1).alias("line_no"), "value")


def questions(spark: SparkSession, path: str, schema: str = QUESTION, check: bool = True) -> DataFrame:
    """Questions of a JSON array (``.json``) or of JSON lines; companies are lower-cased.

    Unless ``check`` is off, a question without a required field and an id given twice, whatever its case, are errors.
    """
    rows = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path) if path.endswith(".json") else jsonl(spark, path, schema)
    rows = rows.withColumn("company", F.lower(F.trim("company"))) if "company" in rows.columns else rows
    if check:
        wrong = [f"{r.id}: {r.error}" for r in evaluation.missing_fields(rows, "id", [c for c in evaluation.REQUIRED if c in rows.columns]).limit(5).collect()]
        wrong += [f"{r.id}: given {r.n} times" for r in evaluation.duplicate_keys(rows, "id").limit(5).collect()]
        if wrong:
            raise ValueError(f"{path}: {'; '.join(wrong)}")
    return rows


def configuration(spark: SparkSession, settings: dict[str, object]) -> DataFrame:
    """(name, value) of settings as a dimension: lists as their items parted by commas, null as an empty value."""
    rows = [(k, ",".join(map(str, v)) if isinstance(v, (list, tuple)) else "" if v is None else str(v)) for k, v in settings.items()]
    return spark.createDataFrame(rows, "name string, value string")


def string_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a file that is one flat JSON object; blank keys or values are an error."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))
    blank = (F.trim("key") == "") | (F.trim(F.coalesce("value", F.lit(""))) == "")
    return rows.select(F.trim("key").alias("key"), F.when(blank, F.raise_error(F.lit("blank key or value")).cast("string")).otherwise(F.trim("value")).alias("value"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents of any layout, one per file."""
    return spark.read.option("multiLine", "true").json(path)


def response_cache(spark: SparkSession, path: str, schema: str = EXTRACTION) -> DataFrame:
    """(file, content, metrics) of cached model responses, one JSON object per file."""
    rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    return rows.select(F.col("_metadata.file_name").alias("file"), F.col("result.response.choices")[0]["message"]["content"].alias("content"), F.col("result.metrics").alias("metrics"))


def embedding_cache(spark: SparkSession, path: str) -> DataFrame:
    """(file, index, embedding) of cached embedding responses."""
    schema = "result struct<response: struct<data: array<struct<embedding: array<double>, index: bigint>>>>"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    return rows.select(F.col("_metadata.file_name").alias("file"), F.explode("result.response.data").alias("d")).select("file", "d.index", "d.embedding")


def graphml_nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "node").schema("_id string").load(path).select(F.col("_id").alias("id"))


def graphml_edges(spark: SparkSession, path: str) -> DataFrame:
    """(source, target, weight) of an undirected snapshot with one number per edge."""
    rows = spark.read.format("xml").option("rowTag", "edge").schema("_source string, _target string, data struct<_VALUE: double, _key: string>").load(path)
    return rows.select(F.col("_source").alias("source"), F.col("_target").alias("target"), F.col("data._VALUE").alias("weight"))


def binary_folder(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(folder, file, ordinal, length) of a folder of images or reports, numbered by name from 1."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    named = rows.select(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("folder"), F.element_at(parts, -1).alias("file"), "length")
    return positions(named, ["folder"], [F.col("file").asc()], "ordinal")


def parquet_head(spark: SparkSession, path: str, n: int = 20) -> DataFrame:
    """The first rows of a table as a look at it."""
    return spark.read.parquet(path).limit(n)
