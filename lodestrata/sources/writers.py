"""Writers: JSON lines, CSV, JSON documents, page files, graph snapshots, tables."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_directory(base: str, stem: str, now: datetime | None = None) -> str:
    """A time-stamped folder name; writers into it use ``errorifexists``."""
    return f"{base}/{stem.replace('_gold_questions', '')}_{(now or datetime.now()):%Y%m%d_%H%M%S}"


def jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """UTF-8 JSON lines; nulls are kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as dotted ones and lists as text parted by commas, for CSV."""
    cols: list[Column] = []

    def walk(prefix: str, schema) -> None:
        for f in schema.fields:
            name = f"{prefix}{f.name}"
            kind = f.dataType.simpleString()
            if kind.startswith("struct"):
                walk(f"{name}.", f.dataType)
            elif kind.startswith("array<string"):
                cols.append(F.array_join(F.col(name), ",").alias(name.replace(".", "_")))
            elif kind.startswith(("array", "map")):
                cols.append(F.to_json(F.col(name)).alias(name.replace(".", "_")))
            else:
                cols.append(F.col(name).alias(name.replace(".", "_")))

    walk("", df.schema)
    return df.select(*cols)


def csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    flat(df).write.mode(mode).option("header", "true").option("escape", '"').option("emptyValue", "").csv(path)


def json_document(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Each row as one JSON document."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def page_files(pages: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A file per page, named as in page_file; a text ends in a line feed, and an empty page is an empty file.

    Each task writes its own pages, whole or not at all, so that a task run again repeats them.
    """
    spark = pages.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        if mode == "errorifexists":
            raise FileExistsError(path)
        if mode == "overwrite":
            fs.delete(target, True)
    fs.mkdirs(target)
    uri = fs.makeQualified(target).toString()
    uri = uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri

    def put(batches):
        from pyarrow import fs as stores

        store, root = stores.FileSystem.from_uri(uri)
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = f"{root}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(text.encode() + b"\n" if text else b"")
                store.move(part, f"{root}/{name}")
            yield batch.slice(0, 0)

    pages.select("page_file", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(put, "page_file string, text string").write.format("noop").mode("overwrite").save()


def marked_text(pages: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Pages of each file between their markers, in order: (file, page, text)."""
    block = F.concat(F.lit("--- PAGE "), F.col("page").cast("string"), F.lit(" START ---\n"), "text", F.lit("\n--- PAGE "), F.col("page").cast("string"), F.lit(" END ---\n"))
    whole = pages.select("file", "page", block.alias("b")).groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "b"))), lambda x: x["b"]), "\n").alias("value"))
    whole.write.mode(mode).partitionBy("file").text(path)


def vectors(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The vector store: a table with ``array<float>``."""
    df.withColumn("embedding", F.col("embedding").cast("array<float>")).write.mode(mode).parquet(path)


def graph_tables(df: DataFrame, path: str) -> None:
    """Rows of the companies in ``df`` replace those companies' partitions, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("company").parquet(path)


def graphml(edges: DataFrame, path: str, mode: str = "errorifexists", nodes: DataFrame | None = None) -> None:
    """Nodes (id) and edges (source, target, weight) as XML, a folder each: ``nodes`` and ``edges``; without ``nodes`` those that edges have."""
    data = F.struct(F.lit("d0").alias("_key"), F.col("weight").alias("_VALUE"))
    known = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id")))
    some = (nodes.select("id").unionByName(known) if nodes is not None else known).where("id is not null").distinct()
    some.select(F.col("id").alias("_id"), F.lit("").alias("_VALUE")).write.format("xml").option("rowTag", "node").option("rootTag", "graph").mode(mode).save(f"{path}/nodes")
    edges.select(F.col("source").alias("_source"), F.col("target").alias("_target"), data.alias("data")).write.format("xml").option("rowTag", "edge").option("rootTag", "graph").mode(mode).save(f"{path}/edges")
