"""Top N items within every group (problem 4).

One global range-partitioned sort on (group, score descending, id) spreads
even a group of millions of items over many tasks. Each task numbers the rows
of a group as they pass and keeps those up to N; only the group that a task
ends with can go on in the next task, so one count per task is enough to turn
local numbers into exact positions by a prefix sum.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _numbered(n_groups: int, n: int):
    """Local positions up to ``n`` and, for the last group of the task, its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        last_key, seen, last_row, schema = None, 0, None, None
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            schema = batch.schema
            change = np.zeros(m, dtype=bool)
            for g in range(n_groups):
                codes = batch.column(g).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                change[1:] |= codes[1:] != codes[:-1]
            first_key = tuple(batch.column(g)[0].as_py() for g in range(n_groups))
            carried = last_row is not None and first_key == last_key
            change[0] = not carried
            starts = np.flatnonzero(change)
            position = np.arange(m, dtype=np.int64)
            if len(starts):
                owner = np.cumsum(change) - 1
                begun = np.where(owner >= 0, starts[np.maximum(owner, 0)], -seen)
            else:
                begun = np.full(m, -seen, dtype=np.int64)
            position = position - begun
            keep = np.flatnonzero(position < n)
            seen = int(position[-1]) + 1
            last_key = tuple(batch.column(g)[m - 1].as_py() for g in range(n_groups))
            last_row = batch.slice(m - 1, 1)
            if len(keep):
                kept = batch.take(pa.array(keep))
                yield _out(kept, pid, pa.array(position[keep] + 1), pa.nulls(len(keep), pa.int64()))
        if last_row is not None:
            yield _out(last_row, pid, pa.nulls(1, pa.int64()), pa.array([seen], pa.int64()))

    def _out(rows: pa.RecordBatch, pid: int, position: pa.Array, count: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [*rows.columns, pa.array([pid] * rows.num_rows, pa.int32()), position, count],
            names=[*rows.schema.names, "pid", "position", "n_last"],
        )

    return run


def top_n_per_group(df: DataFrame, group_cols: Sequence[str], score_col: str, id_col: str, n: int) -> DataFrame:
    """The ``n`` highest-scoring items of every group: group columns, id, score, position.

    * An id that occurs repeatedly in a group counts once, with its highest score.
    * Null and NaN scores and null ids never count; infinite and negative scores do.
    * Equal scores go by the smaller id, so the result is the same on every run.
    * Null group keys form a group of their own; smaller groups give all they have.
    * Other columns of ``df`` are ignored, whatever their names; an empty table gives no rows.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    keys = [f"g{i}" for i in range(len(group_cols))]
    best = (
        df.select(*[F.col(c).alias(k) for c, k in zip(group_cols, keys)], F.col(id_col).alias("item"), F.col(score_col).cast("double").alias("score"))
        .where(F.col("score").isNotNull() & ~F.isnan("score") & F.col("item").isNotNull())
        .groupBy(*keys, "item")
        .agg(F.max("score").alias("score"))
    )
    order = [*[F.col(k).asc_nulls_first() for k in keys], F.col("score").desc(), F.col("item").asc()]
    ordered = best.select(*keys, "score", "item").repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([*ordered.schema.fields, T.StructField("pid", T.IntegerType()), T.StructField("position", T.LongType()), T.StructField("n_last", T.LongType())])
    local = ordered.mapInArrow(_numbered(len(keys), n), schema)
    before = Window.partitionBy(*keys).orderBy("pid").rangeBetween(Window.unboundedPreceding, -1)
    return (
        local.withColumn("position", F.col("position") + F.coalesce(F.sum("n_last").over(before), F.lit(0)))
        .where(F.col("position") <= n)
        .select(*[F.col(k).alias(c) for k, c in zip(keys, group_cols)], F.col("item").alias(id_col), F.col("score").alias(score_col), F.col("position").cast("int").alias("position"))
    )
