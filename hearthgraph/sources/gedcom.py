"""Genealogical line files: people as numbered lines, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE = "^ *([0-9]+) (?:@([^@]+)@ )?([A-Z_0-9]+) ?(.*)$"


def write(profiles: DataFrame) -> DataFrame:
    """record, seq, line for each person; null fields have no line. Within a record lines are ordered by seq."""
    name = F.concat(F.coalesce("given", F.lit("")), F.lit(" /"), F.coalesce("surname", F.lit("")), F.lit("/"))
    lines = F.array(
        F.concat(F.lit("0 @I"), F.col("id").cast("string"), F.lit("@ INDI")), F.concat(F.lit("1 NAME "), name),
        F.when(F.col("birth_raw").isNotNull(), F.lit("1 BIRT")), F.concat(F.lit("2 DATE "), F.col("birth_raw")),
    )
    return profiles.select(F.col("id").alias("record"), F.posexplode(lines).alias("seq", "line")).where("line IS NOT NULL")


def records(spark: SparkSession, path: str) -> DataFrame:
    """record, seq, line of files whose records begin with level 0; Spark splits the files between records."""
    text = spark.read.option("lineSep", "\n0 ").text(path).withColumn("record", F.monotonically_increasing_id())
    body = F.when(F.col("value").startswith("0 "), F.col("value")).otherwise(F.concat(F.lit("0 "), F.col("value")))
    return text.select("record", F.posexplode(F.split(body, "\r?\n")).alias("seq", "line")).where("trim(line) <> ''")


def tags(lines: DataFrame) -> DataFrame:
    """record, seq, level, xref, tag, value, above (the tag one level up within the record)."""
    part = lambda k: F.regexp_extract("line", LINE, k)
    t = lines.select("record", "seq", F.nullif(part(1), F.lit("")).cast("int").alias("level"), part(2).alias("xref"), part(3).alias("tag"), part(4).alias("value")).where("level IS NOT NULL")
    w = Window.partitionBy("record").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return t.withColumn("above", F.when(F.col("level") == 2, F.last(F.when(F.col("level") == 1, F.col("tag")), ignorenulls=True).over(w)))


def read(lines: DataFrame) -> DataFrame:
    """id, given, surname, birth_raw of each person; the first NAME and birth DATE count, a missing date is null."""
    t = tags(lines)
    first = lambda when, what: F.min(F.when(when, F.struct("seq", what.alias("v"))))["v"]
    one = t.groupBy("record").agg(
        F.max(F.when((F.col("level") == 0) & (F.col("tag") == "INDI"), F.col("xref"))).alias("xref"),
        first((F.col("level") == 1) & (F.col("tag") == "NAME"), F.col("value")).alias("name"),
        first((F.col("level") == 2) & (F.col("tag") == "DATE") & (F.col("above") == "BIRT"), F.col("value")).alias("birth_raw"),
    )
    people = one.where("xref IS NOT NULL")
    return people.select(F.substring("xref", 2, 20).cast("long").alias("id"), F.trim(F.regexp_extract("name", "^([^/]*)/", 1)).alias("given"), F.regexp_extract("name", "/([^/]*)/", 1).alias("surname"), "birth_raw")
