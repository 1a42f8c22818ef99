"""Small decisions over evidence: severities, policies, scopes, joins on derived keys, totals and marks.

Nulls never match; a result for them is stated in each function. Empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severities from the mildest on, and years of tolerance by source.
SEVERITIES = ("none", "note", "refinement", "conflict", "correction")
TOLERANCE = {"freebmd": 2, "freecen": 3}
DEATH_TOLERANCE = {"freebmd": 1}
EXACT = ("cwgc",)
HEADSTONES = ("findagrave", "find a grave")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def severity(source: Column, tier: Column, record_type: Column, delta: Column, level: Column) -> Column:
    """How badly a year differs (delta, not negative) from the known one: by the source's tolerance, else by its tier (1 to 3);
    confirmed and probable values raise it. Null where delta is null, or where neither source nor tier is known."""
    s, kind, n = F.lower(source), F.coalesce(record_type, F.lit("")), SEVERITIES.index
    banded = F.lit(None).cast("int")
    for name, years in TOLERANCE.items():
        most = F.when(kind.isin("death", "burial"), DEATH_TOLERANCE.get(name, years)).otherwise(years)
        banded = F.when(s == name, F.when(delta < most, n("none")).when(delta == most, n("refinement")).otherwise(n("conflict"))).otherwise(banded)
    by_tier = (
        F.when(tier == 1, F.when(delta == 0, n("none")).when(delta <= 2, n("refinement")).otherwise(n("correction")))
        .when(tier == 2, F.when(delta <= 1, n("none")).when(delta <= 3, n("refinement")).otherwise(n("conflict")))
        .when(tier == 3, F.when(delta <= 2, n("note")).otherwise(n("conflict")))
    )
    base = F.when(s.isin(*EXACT), F.when(delta == 0, n("none")).otherwise(n("correction"))).when(s.isin(*HEADSTONES), F.when(delta <= 2, n("note")).otherwise(n("conflict"))).otherwise(F.coalesce(banded, by_tier))
    least = F.when(level == "confirmed", n("correction")).when(level == "probable", n("conflict")).otherwise(0)
    rank = F.when(delta.isNotNull() & base.isNotNull(), F.greatest(base, least))
    return F.when(rank.isNotNull(), F.element_at(F.array(*[F.lit(x) for x in SEVERITIES]), rank + 1))


def ranked(rows: DataFrame, column: str, order: tuple[str, ...], *then: str) -> DataFrame:
    """Ordered by the place of a value in `order`, others and nulls last, ties by the columns `then`."""
    rank = reduce(lambda done, x: F.when(F.col(column) == x[1], x[0]).otherwise(done), list(enumerate(order))[::-1], F.lit(len(order)))
    return rows.orderBy(rank, *then)


def policy(chosen: Column, living: Column) -> Column:
    """full, nameOnly or omit: the chosen policy; for auto or none, by whether the person may live (unknown counts as may)."""
    return F.when(chosen.isin("full", "nameOnly", "omit"), chosen).when(F.coalesce(living, F.lit(True)), "nameOnly").otherwise("full")


def narrowest(asked: DataFrame, decisions: DataFrame) -> DataFrame:
    """asked (text, field, …) with the place decided: the decision (id, text, field, place) for its field, else one for the
    whole text (field null); of several the smallest id. Two joins on keys; asked rows without a decision have a null."""
    wide = decisions.where("field IS NULL").groupBy("text").agg(F.min_by("place", "id").alias("_wide"))
    narrow = decisions.where("field IS NOT NULL").groupBy("text", "field").agg(F.min_by("place", "id").alias("_narrow"))
    return asked.join(narrow, ["text", "field"], "left").join(wide, "text", "left").withColumn("place", F.coalesce("_narrow", "_wide")).drop("_narrow", "_wide")


def with_leads(evidence: DataFrame, leads: DataFrame, inner: bool = False) -> DataFrame:
    """Evidence (source_record_id, profile_id, …) with the status of the lead (id, profile_id, status) made from it: the
    lead's id is 'lead_' and the record's. Unmatched evidence stays, with null, unless inner is set."""
    lead = leads.select(F.col("id").alias("lead_id"), F.col("profile_id"), F.col("status").alias("lead_status"))
    own = evidence.withColumn("lead_id", F.concat(F.lit("lead_"), F.col("source_record_id").cast("string")))
    if inner:
        return own.join(lead, ["lead_id", "profile_id"])
    return own.join(lead.withColumn("has_lead", F.lit(True)), ["lead_id", "profile_id"], "left").fillna(False, ["has_lead"])


def hours(rows: DataFrame, start: str, end: str, as_of: Column) -> DataFrame:
    """One row, hours: the sum of the spans' whole seconds in hours; open spans end at as_of, reversed ones count as 0, no
    rows as 0."""
    seconds = F.unix_timestamp(F.coalesce(F.col(end), as_of)) - F.unix_timestamp(start)
    return rows.agg((F.coalesce(F.sum(F.greatest(F.lit(0), seconds)), F.lit(0)) / 3600).alias("hours"))


def long_name(name: Column, soft: int = 100, hard: int = 500) -> Column:
    """Whether a trimmed name has soft up to fewer than hard characters; null counts as short."""
    n = F.length(F.regexp_replace(F.coalesce(name, F.lit("")), r"^\s+|\s+$", ""))
    return (n >= soft) & (n < hard)


def written_date(raw: Column) -> Column:
    """DD/MM/YYYY as 'D Month YYYY'; anything else stays, empty text becomes null."""
    part = lambda k: F.regexp_extract(raw, r"^([0-9]+)/([0-9]+)/([0-9]+)$", k).try_cast("int")
    month = part(2)
    made = F.concat_ws(" ", part(1).cast("string"), F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.when(month.between(1, 12), month).otherwise(1)), part(3).cast("string"))
    return F.when(raw == "", None).when(month.between(1, 12) & part(1).isNotNull() & part(3).isNotNull(), made).otherwise(raw)


def birth_from_death(people: DataFrame, deaths: DataFrame, band: int = 2, oldest: int = 120) -> DataFrame:
    """id, birth_year, record_id for people (id, birth_year, death_year, quarter) without a year of birth: death records
    (record_id, profile_id, year, quarter, age) within a year of the death, and of its quarter where that is known, imply
    year less age. If the implied years lie within `band`, the least one, from its smallest record, is proposed."""
    who = people.where("birth_year IS NULL AND death_year IS NOT NULL").select("id", "death_year", F.col("quarter").alias("_q"))
    fits = (F.abs(F.col("year") - F.col("death_year")) <= 1) & (F.col("_q").isNull() | (F.lower(F.trim("quarter")) == F.lower("_q"))) & F.col("age").between(1, oldest)
    implied = who.join(deaths, who["id"] == deaths["profile_id"]).where(fits).select("id", (F.col("year") - F.col("age")).alias("birth_year"), "record_id")
    best = implied.groupBy("id").agg(F.min(F.struct("birth_year", "record_id")).alias("_b"), F.max("birth_year").alias("_m"))
    return best.where(F.col("_m") - F.col("_b.birth_year") <= band).select("id", "_b.birth_year", "_b.record_id")


def oldest_queued(rows: DataFrame, queue: str, at: str, key: str) -> DataFrame:
    """For each queue its oldest row's key, rows without a time first, ties by the key; combined before the shuffle."""
    return rows.groupBy(queue).agg(F.min_by(key, F.struct(at, key)).alias(key))


def newer(rows: DataFrame, at: str, mark: Column | None) -> DataFrame:
    """Rows after the mark, all where there is none yet; rows without a time never count as new after a mark."""
    return rows if mark is None else rows.where(F.col(at) > mark)
