"""References of the form ``file:page:unit``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_THREE = r"(?s)^(.*):([^:]*):([^:]*)$"


def page_ref(c: Column) -> Column:
    """struct(source_file, page) of a reference split at its last two colons, else null.

    File and page are trimmed and leading zeros of the page dropped; the page stays
    a string, so numbers of any length compare. No file, or a page that is not all
    digits, is no reference.
    """
    edge = r"^[ \t\r\n]+|[ \t\r\n]+$"
    file = F.regexp_replace(F.regexp_extract(c, _THREE, 1), edge, "")
    page = F.regexp_replace(F.regexp_extract(c, _THREE, 2), edge, "")
    ok = c.rlike(_THREE) & (file != "") & page.rlike("^[0-9]+$")
    return F.when(ok, F.struct(file.alias("source_file"), F.regexp_replace(page, "^0+(?=[0-9])", "").alias("page")))


def source_ref(c: Column) -> Column:
    """struct(source_file, page_number) by the looser reader's rule.

    Split at the last two colons at most; with two parts the first is both the
    file and the page. The page must be an integer and the file non-empty.
    """
    t = F.trim(c)
    three, two = t.rlike(_THREE), t.rlike(r"(?s)^[^:]*:[^:]*$")
    file = F.trim(F.when(three, F.regexp_extract(t, _THREE, 1)).when(two, F.regexp_extract(t, "^([^:]*):", 1)))
    page = F.when(three, F.regexp_extract(t, _THREE, 2)).when(two, F.regexp_extract(t, "^([^:]*):", 1)).try_cast("bigint")
    return F.when(file.isNotNull() & (file != "") & page.isNotNull(), F.struct(file.alias("source_file"), page.alias("page_number")))
