"""Evidence rows: spans of bytes and lines with stable ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, start_byte, end_byte, content) of every line; spans leave the newline out."""
    cut = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "content")).withColumn("_size", F.octet_length("content"))  # before the window, which then moves no texts that nothing asks for
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("_size") + 1).over(before), F.lit(0)).cast("long")
    return cut.select(key, (F.col("pos") + 1).cast("long").alias("line"), start.alias("start_byte"), (start + F.col("_size")).cast("long").alias("end_byte"), "content")


def headings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Markdown headings: one to six marks, a blank, a title; closing marks go."""
    at = lines(docs, key, text)
    trimmed = F.ltrim(F.regexp_replace("content", "\r$", ""))
    marks = F.regexp_extract(trimmed, "^(#{1,6})[ \t]", 1)
    title = F.trim(F.regexp_replace(F.trim(F.substring(trimmed, F.length(marks) + 1, F.lit(1 << 30))), "#+$", ""))
    return at.withColumn("level", F.length(marks)).withColumn("title", title).where((F.col("level") > 0) & (F.col("title") != "")).drop("content")


def first_per_key(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, n) of keys on several rows."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def collisions(rows: DataFrame, name, exact: str) -> DataFrame:
    """(portable, n_names) of portable names that several exact names share."""
    return rows.groupBy(name.alias("portable")).agg(F.countDistinct(exact).alias("n_names")).where("n_names > 1")
