"""Chunks of texts: overlapping pages, sliding windows of words, units of bounded length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_pages(df: DataFrame, keys: list[str], order: list[Column], text_col: str) -> DataFrame:
    """Each page between the last half of the page before and the first half of the page after.

    A file's pages are one window; files are bounded by what one document holds.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    before, after, own = F.lag(text_col).over(w), F.lead(text_col).over(w), F.coalesce(F.col(text_col), F.lit(""))
    half = lambda c: F.floor(F.length(c) / 2).cast("int")
    return df.withColumn("chunk", F.concat(F.coalesce(F.substring(before, F.length(before) - half(before) + 1, half(before)), F.lit("")), own, F.coalesce(F.substring(after, F.lit(1), half(after)), F.lit(""))))


def words(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != "")


def sliding_chunks(df: DataFrame, id_col: str, token_col: str, size: int = 1200, overlap: int = 120) -> DataFrame:
    """(id, chunk_no, n_tokens, chunk): windows of ``size`` tokens; a last window within the one before is left out."""
    step, n = size - overlap, F.size(token_col)
    last = F.greatest(F.lit(0), F.ceil((n - F.lit(overlap)) / F.lit(step)).cast("int") - 1)
    starts = df.where(n > 0).select(F.col(id_col).alias("id"), F.col(token_col).alias("t"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    piece = F.slice("t", F.col("chunk_no") * step + 1, F.lit(size))
    return starts.select("id", "chunk_no", F.size(piece).alias("n_tokens"), F.array_join(piece, " ").alias("chunk"))


def units(df: DataFrame, id_col: str, text_col: str, most: int = 3200) -> DataFrame:
    """(id, unit_no, unit): consecutive units of at most ``most`` characters."""
    n = F.ceil(F.length(text_col) / F.lit(most)).cast("int")
    each = df.where(F.length(text_col) > 0).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.explode(F.sequence(F.lit(0), n - 1)).alias("unit_no"))
    return each.select("id", "unit_no", F.substring("t", F.col("unit_no") * most + 1, F.lit(most)).alias("unit"))


def usage(c: Column) -> Column:
    """Words of a text as an estimate of its tokens, at least 1."""
    return F.greatest(F.lit(1), F.size(words(c))).cast("bigint")
