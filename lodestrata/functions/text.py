"""Text expressions, all built-in Spark functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def company_key(c: Column | str) -> Column:
    """Company names compare trimmed (space, tab, CR, LF) and lower-cased."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.regexp_replace(c, r"^[ \t\r\n]+|[ \t\r\n]+$", ""))


def name_key(c: Column | str) -> Column:
    """Entity names compare after two escapes, whitespace runs, trimming and upper-casing."""
    c = F.col(c) if isinstance(c, str) else c
    plain = F.replace(F.replace(c, F.lit("&amp;"), F.lit("&")), F.lit("&#39;"), F.lit("'"))
    return F.upper(F.trim(F.regexp_replace(plain, r"[ \t\r\n]+", " ")))


def squeeze(c: Column) -> Column:
    """Whitespace runs (any Unicode whitespace) become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def is_blank(c: Column) -> Column:
    """Null, or nothing but whitespace of any kind."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "") == ""


def valid_text(c: Column) -> Column:
    """Bytes as text: UTF-8 with what is invalid replaced; null is empty text."""
    return F.coalesce(F.make_valid_utf8(c.cast("string")), F.lit(""))


def truncate_text(c: Column, n: int) -> Column:
    """Squeezed text of at most ``n`` characters, cut at the last space, with `` ...`` after a cut."""
    t = squeeze(F.coalesce(c, F.lit("")))
    head = F.left(t, F.lit(n))
    back = F.instr(F.reverse(head), " ")
    cut = F.when((back > 0) & (back < n), F.substring(head, F.lit(1), F.lit(n) - back)).otherwise(head)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.rtrim(cut), F.lit(" ...")))


def tokens(c: Column) -> Column:
    """Lower-case runs of a-z and 0-9; the subscript spelling of CO2e counts as ``co2e``."""
    low = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("co₂e"), F.lit("co2e"))
    return F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))


def normalized_contains(text: Column, gold: Column) -> Column:
    """Whether the token string of ``gold`` is in that of ``text``; an empty gold never is."""
    g = tokens(gold)
    return (F.size(g) > 0) & F.contains(F.array_join(tokens(text), " "), F.array_join(g, " "))


def strip_ansi(c: Column) -> Column:
    return F.regexp_replace(c, r"\x1b\[[0-?]*[ -/]*[@-~]", "")


def split_list(c: Column, sep: str = ",") -> Column:
    return F.filter(F.transform(F.split(c, sep), lambda x: F.trim(x)), lambda x: x != "")


def clean_string_list(c: Column) -> Column:
    """Trimmed non-empty items; null is an empty list."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def normalize_companies(c: Column) -> Column:
    """Trimmed, lower-cased, first occurrences, without empties."""
    low = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(low, lambda x: x.isNotNull() & (x != "")))


def run_directory_of(c: Column) -> Column:
    """The folder that an evaluation says it wrote to, trimmed; null where it doesn't say."""
    found = F.trim(F.regexp_extract(c, r"Wrote evaluation run to (.+)", 1))
    return F.when(found != "", found)


def credentials(c: Column) -> Column:
    """struct(user, password) of a pair parted at its first slash; null without one."""
    return F.when(F.contains(c, F.lit("/")), F.struct(F.regexp_extract(c, "(?s)^([^/]*)/", 1).alias("user"), F.regexp_extract(c, "(?s)^[^/]*/(.*)$", 1).alias("password")))
