"""Splitting page-marked documents and printed page numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.ranking import positions

_START, _END = r"^--- PAGE\s+(\d+)\s+START ---\s*$", r"^--- PAGE\s+(\d+)\s+END ---\s*$"


def lines(df: DataFrame, file_col: str, text_col: str) -> DataFrame:
    """(file, line_no, line) of whole texts, line_no from 1; lines may end in CR LF."""
    return df.select(F.col(file_col).alias("file"), F.posexplode(F.split(text_col, r"\r?\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def marked_lines(text_lines: DataFrame) -> DataFrame:
    """Lines with their page markers, the number of open pages before each, and the error at it, if any."""
    start = F.regexp_extract("line", _START, 1)
    end = F.regexp_extract("line", _END, 1)
    marks = text_lines.withColumn("start_page", F.when(start != "", start).try_cast("bigint")).withColumn("end_page", F.when(end != "", end).try_cast("bigint"))
    so_far = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.coalesce(F.sum(F.col("start_page").isNotNull().cast("int") - F.col("end_page").isNotNull().cast("int")).over(so_far), F.lit(0))
    out = marks.withColumn("open", opened).withColumn("current", F.last("start_page", ignorenulls=True).over(upto))
    return out.withColumn(
        "error",
        F.when(F.col("start_page").isNotNull() & (F.col("open") > 0), F.lit("nested start"))
        .when(F.col("end_page").isNotNull() & (F.col("open") < 1), F.lit("end without start"))
        .when(F.col("end_page").isNotNull() & (F.col("end_page") != F.col("current")), F.lit("mismatched end")),
    )


def split_pages(df: DataFrame, file_col: str, text_col: str, keep_markers: bool = False, zero_pad: int = 3) -> DataFrame:
    """(file, page, page_file, text, n_lines) of each marked page; text outside pages is dropped.

    Pages come from their start markers, so that one without a line is an empty page.
    Line feeds at the ends of a page's text are stripped. ``page_errors`` tells what is wrong with a file.
    """
    inside = marked_lines(lines(df, file_col, text_col)).where((F.col("open") > 0) | F.col("start_page").isNotNull())
    kept = F.lit(True) if keep_markers else F.col("start_page").isNull() & F.col("end_page").isNull()
    pages = inside.groupBy("file", F.col("current").alias("page")).agg(F.count_if(kept).alias("n_lines"), F.array_sort(F.collect_list(F.when(kept, F.struct("line_no", "line")))).alias("ls"))
    text = F.regexp_replace(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), r"^\n+|\n+$", "")
    return pages.select("file", "page", page_file("file", "page", zero_pad).alias("page_file"), text.alias("text"), "n_lines")


def page_counts(pages: DataFrame) -> DataFrame:
    """(file, n_pages, n_empty): pages written per file."""
    return pages.groupBy("file").agg(F.count("*").alias("n_pages"), F.count_if(F.col("text") == "").alias("n_empty"))


def page_errors(df: DataFrame, file_col: str, text_col: str) -> DataFrame:
    """(file, line_no, error) of the first error of each file: nested start, end without start,
    mismatched end, or, where there is none of these, unclosed page (line_no null)."""
    marked = marked_lines(lines(df, file_col, text_col))
    per_file = marked.groupBy("file").agg(
        F.min_by(F.struct("line_no", "error"), F.when(F.col("error").isNotNull(), F.col("line_no"))).alias("first"),
        F.sum(F.col("start_page").isNotNull().cast("int") - F.col("end_page").isNotNull().cast("int")).alias("b"),
    )
    return per_file.select("file", "first.line_no", F.coalesce(F.col("first.error"), F.when(F.col("b") > 0, F.lit("unclosed page"))).alias("error")).where("error is not null")


def page_file(stem: str, page: str, zero_pad: int = 3) -> Column:
    base = F.regexp_replace(F.col(stem), r"\.[^.]*$", "")
    number = F.col(page).cast("string")
    return F.concat(base, F.lit("_page_"), F.when(F.length(number) >= zero_pad, number).otherwise(F.lpad(number, zero_pad, "0")), F.lit(".md"))


def page_number_tags(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?s)<page_number>(.*?)</page_number>"), F.lit(1))


def ordinals(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Physical ordinals from 1 of the files of each folder, also where one holds most of them."""
    return positions(df, keys, order, "ordinal")
