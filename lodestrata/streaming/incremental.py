"""Incremental counterparts: new files are taken up where the last run ended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestrata.functions.metrics import token_judge


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files: int = 8) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files).load(path)


def index_new(stream: DataFrame, target: str, checkpoint: str, text_col: str = "text", work: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Texts that no earlier batch held (by content hash), worked on and appended to ``target``.

    A batch that is run again after a failure finds its own rows there and adds none twice.
    """

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        hashed = df.where(F.col(text_col).isNotNull()).withColumn("content_hash", F.sha2(text_col, 256)).dropDuplicates(["content_hash"])
        try:
            seen = spark.read.parquet(target).select("content_hash")
            hashed = hashed.join(seen, "content_hash", "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        work(hashed).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def evaluation_metrics(stream: DataFrame, time_col: str, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Graded answers per day and method as they arrive: counts and mean score under a watermark."""
    graded = stream.withWatermark(time_col, late).withColumn("judge", token_judge(F.col("answer"), F.col("question")))
    return graded.groupBy(F.window(time_col, window), "run_method").agg(F.count("*").alias("n"), F.count_if(F.col("judge.label") == "correct").alias("n_correct"), F.avg("judge.score").alias("mean_score"))


def sessions(stream: DataFrame, key: str, time_col: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events per key with no longer pause than ``gap``."""
    return stream.withWatermark(time_col, late).groupBy(F.session_window(time_col, gap), key).agg(F.count("*").alias("n"))


def pending_units(units: DataFrame, results: DataFrame, key: str, ok: str = "ok", most: int | None = None) -> DataFrame:
    """Units that no result of theirs says are done, failed ones again; ``most`` attempts at each, all without."""
    tried = results.groupBy(key).agg(F.max(F.coalesce(F.col(ok), F.lit(False))).alias("_ok"), F.count("*").alias("_n"))
    closed = tried.where(F.col("_ok") | (F.col("_n") >= most) if most is not None else F.col("_ok")).select(key)
    return units.join(closed, key, "left_anti")


def run_units(units: DataFrame, target: str, key: str, work: Callable[[DataFrame], DataFrame], most: int = 3) -> int:
    """Works on the units that ``target`` has no good result of, round by round, and appends what comes out; ``work`` keeps the key and adds ``ok``.

    A run that breaks off goes on from what was written. Gives the number of rounds.
    """
    spark, rounds = units.sparkSession, 0
    while True:
        try:
            left = pending_units(units, spark.read.parquet(target), key, most=most)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            left = units
        if left.isEmpty():
            return rounds
        work(left).write.mode("append").parquet(target)
        rounds += 1


def relay_lines(spark: SparkSession, path: str, checkpoint: str, take: Callable[[DataFrame], None]) -> StreamingQuery:
    """Lines of growing text files, handed on as they come: (file, value), those of a file in its order."""

    def batch(df: DataFrame, _: int) -> None:
        take(df)

    lines = spark.readStream.text(path).select(F.col("_metadata.file_name").alias("file"), "value")
    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
