"""Extraction records in delimiter text, and attributes inside descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ATTRIBUTES = ("metric", "value", "unit", "period", "scope")


def parse_records(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, record_no, kind, name, other, description, weight) of records parted by ``##`` with fields parted by ``<|>``.

    One opening and one closing parenthesis are dropped. Entities need four fields,
    relationships five; others have kind ``rejected``. Names are unescaped and
    upper-cased without control characters. A weight that is no number is 1.
    """
    raw = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "##")).alias("record_no", "record"))
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace("record", r"[\r\n\t]+", " ")), r"^\(", ""), r"\)$", "")
    fields = raw.withColumn("f", F.transform(F.split(bare, r"<\|>"), lambda x: F.trim(x))).where(F.trim("record") != "")
    kind = F.regexp_replace(F.lower(F.element_at("f", 1)), '["\\s]', "")
    name = lambda i: F.upper(F.trim(F.regexp_replace(F.replace(F.replace(F.replace(F.try_element_at("f", F.lit(i)), F.lit("&amp;"), F.lit("&")), F.lit("&#39;"), F.lit("'")), F.lit("&quot;"), F.lit('"')), r"\p{Cntrl}", "")))
    n = F.size("f")
    entity, relation = (kind == "entity") & (n >= 4), (kind == "relationship") & (n >= 5)
    return fields.select(
        "id",
        "record_no",
        F.when(entity, F.lit("entity")).when(relation, F.lit("relationship")).otherwise(F.lit("rejected")).alias("kind"),
        F.when(entity | relation, name(2)).alias("name"),
        F.when(entity | relation, name(3)).alias("other"),
        F.when(entity | relation, F.try_element_at("f", F.lit(4))).alias("description"),
        F.when(relation, F.coalesce(F.element_at("f", -1).try_cast("double"), F.lit(1.0))).alias("weight"),
    )


def gleaned(passes: list[DataFrame]) -> DataFrame:
    """Records of several passes over the same texts: those of the first, and of each later one what no earlier one had by kind, name and other."""
    keys = ["id", "kind", "name", "other"]
    every = None
    for n, p in enumerate(passes):
        part = p.withColumn("pass_no", F.lit(n))
        every = part if every is None else every.unionByName(part)
    first = every.groupBy(*keys).agg(F.min("pass_no").alias("_first"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return every.alias("a").join(first.alias("b"), on & (F.col("a.pass_no") == F.col("b._first"))).select("a.*")


def record_weights(records: DataFrame) -> DataFrame:
    """Summed weight per directed pair of the relationships."""
    return records.where("kind = 'relationship'").groupBy(F.col("name").alias("source"), F.col("other").alias("target")).agg(F.sum("weight").alias("weight"))


def attribute(c: Column, key: str) -> Column:
    """Values of ``key=...`` up to the next semicolon."""
    return F.regexp_extract_all(c, F.lit(rf"(?i)\b{key}=([^;]*)"), F.lit(1))


def parse_attributes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, metric, value, unit, period, scope, number) of the attribute tuples in a description, paired by position."""
    lists = df.select(F.col(id_col).alias("id"), *[attribute(F.col(text_col), a).alias(a) for a in ATTRIBUTES])
    rows = lists.select("id", F.posexplode(F.arrays_zip(*ATTRIBUTES)).alias("pos", "a")).select("id", "pos", *[F.trim(F.col("a")[a]).alias(a) for a in ATTRIBUTES])
    return rows.withColumn("number", F.replace("value", F.lit(","), F.lit("")).try_cast("double"))


def noun_phrases(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, phrase, n): runs of two to four capitalised words of English text, by ASCII word bounds."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(r"(?<![A-Za-z0-9_])[A-Z][a-z]+(?: [A-Z][a-z]+){1,3}(?![A-Za-z0-9_])"), F.lit(0))
    return df.select(F.col(id_col).alias("id"), F.explode(found).alias("phrase")).groupBy("id", "phrase").agg(F.count("*").alias("n"))
