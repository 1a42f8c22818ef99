"""Lists a reader looks at: orders, filters with flags, searches over several tables, counts and suggestions.

Nulls never match a filter and stand last in an order unless a function says otherwise; empty tables give empty lists.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of a person whose absence is a gap.
FIELDS = ("given", "surname", "gender", "birth_raw", "death_raw", "birth_place", "death_place", "bio")


def by_name(people: DataFrame) -> DataFrame:
    """Ordered by surname, given name and id, people without a name last."""
    return people.orderBy(F.asc_nulls_last("surname"), F.asc_nulls_last("given"), "id")


def most_gaps_first(people: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """With n_gaps, the number of fields that are null or blank; most gaps first, then by id."""
    gap = lambda f: F.when(F.trim(F.coalesce(f, F.lit(""))) == "", 1).otherwise(0)
    return people.withColumn("n_gaps", reduce(Column.__add__, [gap(f) for f in fields])).orderBy(F.desc("n_gaps"), "id")


def chronological(rows: DataFrame, year: str, *then: str) -> DataFrame:
    """Oldest first, undated rows last, ties by the other columns."""
    return rows.orderBy(F.asc_nulls_last(year), *then)


def page_of(rows: DataFrame, keep: Column, order: list[Column], asked: int, most: int = 200) -> DataFrame:
    """The first rows in this order among those that the condition keeps: the limit, clamped to 1..most, comes last."""
    return rows.where(keep).orderBy(*order).limit(max(1, min(asked, most)))


def historical(people: DataFrame, parents: DataFrame, before: int = 1930, bio_chars: int = 50) -> DataFrame:
    """id, without_bio (null or shorter than bio_chars without outer blanks), without_parents, without_dates of people born before a year."""
    has = parents.select(F.col("to_id").alias("id")).distinct().withColumn("_has", F.lit(True))
    return people.where(F.col("bb") < before).join(has, "id", "left").select(
        "id", (F.length(F.trim(F.coalesce("bio", F.lit("")))) < bio_chars).alias("without_bio"), F.col("_has").isNull().alias("without_parents"),
        (F.col("birth_raw").isNull() | F.col("death_raw").isNull()).alias("without_dates"),
    )


def search(tables: dict[str, tuple[DataFrame, str, list[str]]], needle: str) -> DataFrame:
    """kind, id: rows of any table whose columns hold the needle, whatever the case. tables: kind to (rows, id, columns).
    A blank needle finds nothing."""
    needle = needle.strip().lower()
    parts = []
    for kind, (rows, key, columns) in tables.items():
        held = reduce(Column.__or__, [F.coalesce(F.contains(F.lower(c), F.lit(needle)), F.lit(False)) for c in columns])
        parts.append(rows.where(held if needle else F.lit(False)).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id")))
    return reduce(DataFrame.unionByName, parts)


def sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """kind, n: the number of rows of each table, 0 where it is empty."""
    return reduce(DataFrame.unionByName, [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, rows in tables.items()])


def most_frequent(values: DataFrame, column: str, n: int) -> DataFrame:
    """value, n of the n most frequent values that are not blank, ties by the value."""
    held = values.where(F.trim(column) != "").groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return held.orderBy(F.desc("n"), "value").limit(n)


def searched_in_vain(attempts: DataFrame, scored: DataFrame, keys: list[str]) -> DataFrame:
    """The keys whose every attempt ended cleanly without a find (clean, found) and that have no scored record."""
    empty = attempts.groupBy(*keys).agg(F.bool_and(F.coalesce(F.col("clean") & (F.col("found") == 0), F.lit(False))).alias("_empty"))
    return empty.where("_empty").select(*keys).join(scored.select(*keys).distinct(), keys, "left_anti")


def changes_since(branches: dict[str, DataFrame], at: str, since: Column) -> DataFrame:
    """kind and the columns of the branches: what happened after a time, latest first."""
    parts = [rows.where(F.col(at) > since).withColumn("kind", F.lit(kind)) for kind, rows in branches.items()]
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc(at), "kind")


def lead_id(name: Column, category: Column, year: Column) -> Column:
    """The same id for the same lead: name in letters and digits, category, year; null without a name."""
    slug = F.regexp_replace(F.lower(name), "[^a-z0-9]", "_")
    known = F.when(year != 0, year.cast("string")).otherwise("unknown")
    return F.concat(F.lit("lead_"), F.btrim(slug, F.lit("_")), F.lit("_"), category, F.lit("_"), known)


def quarter_of(month: Column) -> Column:
    """The registration quarter by its last month; null outside 1..12."""
    names = F.array(*[F.lit(q) for q in ("Mar", "Jun", "Sep", "Dec")])
    return F.when(month.between(1, 12), F.element_at(names, F.floor((month + 2) / 3).cast("int")))
