"""Projections, reports, windows and set operations over people and their events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def search_names(people: DataFrame, query: str) -> DataFrame:
    """People whose names hold every word of the query, in any case; an empty query finds nobody."""
    words = query.lower().split()
    name = F.lower(F.concat_ws(" ", "given", "middle", "surname", "married_surname"))
    found = F.lit(bool(words))
    for w in words:
        found = found & name.contains(w)
    return people.where(found)


def gaps(people: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """id, missing (names of null fields, joined), n_present."""
    missing = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in fields])
    present = sum([F.col(c).isNotNull().cast("int") for c in fields], F.lit(0))
    return people.select("id", missing.alias("missing"), present.alias("n_present"))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values, case and outer blanks folded; shown as the smallest spelling. Ties by spelling."""
    g = df.where(f"{column} IS NOT NULL").groupBy(F.lower(F.trim(F.col(column))).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("value"))
    return g.orderBy(F.desc("n"), "key").limit(k).select("key", "value", "n")


def lifespan(people: DataFrame, by: str) -> DataFrame:
    """Mean and median (the lower middle cut to whole years) of the years between birth and death, without negative ones."""
    d = people.select(by, (F.col("db") - F.col("bb")).alias("d")).where("d >= 0")
    return d.groupBy(by).agg(F.round(F.avg("d"), 4).alias("mean_years"), F.floor(F.percentile("d", 0.5)).cast("long").alias("median_years"), F.count(F.lit(1)).alias("n"))


def child_gaps(parents: DataFrame, people: DataFrame, years: int = 3) -> DataFrame:
    """Parents' pairs of successive births more than `years` apart: id, before, after."""
    births = parents.select(F.col("from_id").alias("id"), F.col("to_id").alias("child")).distinct().join(people.select(F.col("id").alias("child"), F.col("bb").alias("y")), "child").where("y IS NOT NULL")
    w = Window.partitionBy("id").orderBy("y", "child")
    return births.withColumn("before", F.lag("y").over(w)).where(F.col("y") - F.col("before") > years).select("id", "before", F.col("y").alias("after"))


def spouse_order(spouses: DataFrame) -> DataFrame:
    """id, other, rank: spouses in order of marriage year, undated last, then id."""
    w = Window.partitionBy("id").orderBy(F.col("year").asc_nulls_last(), "other")
    return spouses.withColumn("rank", F.row_number().over(w)).select("id", "other", "rank")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def timeline(people: DataFrame, spouses: DataFrame, life: DataFrame) -> DataFrame:
    """id, kind, year of births, deaths, marriages and life events; bag semantics, one row for each spouse of a marriage."""
    parts = [
        people.where("bb IS NOT NULL").select("id", F.lit("birth").alias("kind"), F.col("bb").alias("year")),
        people.where("db IS NOT NULL").select("id", F.lit("death").alias("kind"), F.col("db").alias("year")),
        spouses.select("id", F.lit("marriage").alias("kind"), "year"),
        life.select(F.col("profile_id").alias("id"), "kind", "year"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def valid_at(events: DataFrame, districts: DataFrame) -> DataFrame:
    """Events with the districts of their place that existed in their year; open bounds and undated events pass. The
    dimension is joined by place, so its size does not matter."""
    on = (F.col("year").isNull()) | ((F.coalesce(F.col("year") >= F.col("year_from"), F.lit(True))) & (F.coalesce(F.col("year") <= F.col("year_to"), F.lit(True))))
    return events.join(districts, "place").where(on)


def daily_budget(events: DataFrame, limit: int) -> DataFrame:
    """source, day, n, paused: events per source and day; at the limit the source rests until the next day."""
    g = events.groupBy(F.col("event_type").alias("source"), F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("source", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n", (F.col("n") >= limit).alias("paused"))


def streaks(events: DataFrame, bad: Column, least: int) -> DataFrame:
    """user_id, started, n: runs of at least `least` successive bad events of one user, in order of time and id."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = events.select("user_id", "ts", "event_id", bad.cast("int").alias("bad"))
    e = e.withColumn("island", F.sum(1 - F.col("bad")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return e.where("bad = 1").groupBy("user_id", "island").agg(F.min("event_id").alias("started"), F.count(F.lit(1)).alias("n")).where(f"n >= {least}").select("user_id", "started", "n")


def undo(changes: DataFrame, before: Column) -> DataFrame:
    """The last value of each user and event type among changes for which `before` holds: the state to go back to."""
    return latest(changes.where(before), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges; a spouse pair is one edge whichever end comes first."""
    swap = F.col("type") == "spouse"
    a, b = F.when(swap, F.least("from_id", "to_id")).otherwise(F.col("from_id")), F.when(swap, F.greatest("from_id", "to_id")).otherwise(F.col("to_id"))
    return edges.select("type", a.alias("a"), b.alias("b")).distinct()
