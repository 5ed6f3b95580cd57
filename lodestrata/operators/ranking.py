"""Exact positions within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import cut


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "position") -> DataFrame:
    """``df`` with the 1-based position of each row in its group.

    A range-partitioned sort spreads a large group over many tasks; the counts of
    each (task, group) are prefix-summed over tasks, so no group is in one task.
    """
    by = [F.col(k).asc_nulls_first() for k in keys]
    ordered = cut(df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order))
    numbered = ordered.withColumn("_pid", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    counts = numbered.groupBy("_pid", *keys).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_pid").alias("_p"), "_first", "_before")
    on = (F.col("_pid") == F.col("_p")) & F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return numbered.join(starts, on).withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1).select(*df.columns, name)


def meet(rows: DataFrame, sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of ``sums``, which has one row per group; null keys meet, no key is one group."""
    if not keys:
        return rows.crossJoin(F.broadcast(sums))
    named = sums.select(*[F.col(k).alias(f"_m{i}") for i, k in enumerate(keys)], *[c for c in sums.columns if c not in keys])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_m{i}"))
    return rows.join(named, on).drop(*[f"_m{i}" for i in range(len(keys))])


#: Rows of a group beyond which only those near a rank are looked at; approximate percentiles are right to one in so many.
ACCURACY = 10_000


def values_at(df: DataFrame, keys: Sequence[str], value: str, share: float, picks: dict[str, Column]) -> DataFrame:
    """Per group the values at 0-based indexes near ``share`` of its order; nulls don't count.

    ``picks`` gives each index as an expression of ``_n``, the group's size. Groups are
    counted with an approximate percentile on either side of the rank, whose error is
    bounded. Rows below are then counted only and those above left out; of the few
    between, distinct values are counted and their counts summed up in order, which
    gives the exact value. No group is in one task but for that band.
    """
    some = df.select(*keys, F.col(value).alias("_v")).where("_v is not null")
    margin = 6 / ACCURACY
    sides = [max(0.0, share - margin), min(1.0, share + margin)]
    sums = some.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_v", sides, ACCURACY).alias("_q"))
    large = F.col("_n") > ACCURACY
    bounds = sums.select(*keys, *[i.cast("long").alias(f"_i_{n}") for n, i in picks.items()], F.when(large, F.col("_q")[0]).alias("_lo"), F.when(large, F.col("_q")[1]).alias("_hi"))
    below = F.coalesce(F.col("_v") < F.col("_lo"), F.lit(False))
    near = meet(some, bounds, keys).where(F.col("_hi").isNull() | (F.col("_v") <= F.col("_hi")))
    counted = near.groupBy(*keys, *[f"_i_{n}" for n in picks], F.when(~below, F.col("_v")).alias("_b")).agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*keys).orderBy(F.col("_b").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    summed = counted.withColumn("_s", F.sum("_c").over(upto))
    found = [F.min(F.when(F.col("_s") > F.col(f"_i_{n}"), F.col("_b"))).alias(n) for n in picks]
    return summed.groupBy(*keys).agg(*found) if keys else summed.agg(*found)


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, share: float, name: str) -> DataFrame:
    """Per group the value at index round((n - 1) * share), halves to even; nulls don't count."""
    return values_at(df, keys, value, share, {name: F.bround((F.col("_n") - 1).cast("double") * F.lit(share), 0)})
