"""Dates that are ranges of years, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Years that count as years, and what each qualifier adds on either side.
YEARS = (1000, 2100)
TOLERANCE = {"ABT": 5, "EST": 10, "CAL": 1, "BEF": 0, "AFT": 0}
#: The words of each qualifier; a blank must follow.
WORDS = {
    "ABT": ("ABT", "ABOUT", "CIRCA", "AROUND", "APPROXIMATELY", "APPROX"), "EST": ("EST", "ESTIMATED"), "CAL": ("CAL", "CALCULATED"),
    "BEF": ("BEF", "BEFORE"), "AFT": ("AFT", "AFTER"),
}


def _year(text: Column) -> Column:
    """The first number of four digits, if it counts as a year."""
    y = lambda digits: F.when(digits != "", F.when(digits.between(*map(str, YEARS)), digits.cast("int")))
    return _once(F.regexp_extract(text, r"\b([0-9]{4})\b", 1), y)


def parse(raw: Column) -> Column:
    """struct(earliest, latest, qualifier); a null bound is open, two null bounds are an unknown date.

    Reads `1887`, `1 JAN 1887`, a qualifier's word and a year, `BET y AND z`, `BETWEEN y AND z` and `1880s`; the first
    number of exactly four digits counts, and only within 1000..2100. Everything else, null and empty text included, is
    unknown; BET without AND is read as if it weren't there.
    """
    words = lambda t: F.struct(t.alias("t"), _year(t).alias("y"), F.regexp_extract(t, "^([A-Z]+) ", 1).alias("word"))
    return _once(_once(F.upper(F.trim(raw)), words), _read)


def _once(value: Column, use) -> Column:
    """use(value) with the value bound by a lambda, so that it is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _read(x: Column) -> Column:
    text, y, word = x["t"], x["y"], x["word"]
    kind, around = F.lit(""), F.lit(0)
    for q, words in WORDS.items():
        own = word.isin(*words)
        kind, around = F.when(own, q).otherwise(kind), F.when(own, TOLERANCE[q]).otherwise(around)
    parts = F.split(text, " AND ")
    between = word.isin("BET", "BETWEEN") & text.contains(" AND ")
    decade = F.when(text.rlike("^[0-9]{3}0S$"), F.substring(text, 1, 4).cast("int"))
    decade = F.when(decade.between(1000, 2090), decade)
    early = F.when(between, _year(F.element_at(parts, 1))).when(kind != "BEF", y - around)
    late = F.when(between, _year(F.element_at(parts, -1))).when(kind != "AFT", y + around)
    early, late = F.coalesce(decade, early), F.coalesce(decade + 9, late)
    kind = F.when(between | decade.isNotNull(), "BET").otherwise(kind)
    return F.struct(early.cast("int").alias("earliest"), late.cast("int").alias("latest"), F.when(early.isNotNull() | late.isNotNull(), kind).alias("qualifier"))


def best_year(earliest: Column, latest: Column) -> Column:
    """The middle of both bounds without remainder, the one bound there is, or null."""
    middle = F.floor((earliest + latest) / 2).cast("int")
    return F.coalesce(middle, earliest, latest)


def span(earliest: Column, latest: Column) -> Column:
    """Years between the bounds; null where a bound is open."""
    return latest - earliest


def overlaps_open(e1: Column, l1: Column, e2: Column, l2: Column) -> Column:
    """Whether two ranges meet; a null bound is open, so unknown dates meet everything."""
    return F.coalesce(e1 <= l2, F.lit(True)) & F.coalesce(e2 <= l1, F.lit(True))


def relation_strict(e1: Column, l1: Column, e2: Column, l2: Column) -> Column:
    """equal, within, overlap or disjoint; unknown where any bound is null. Not the convention of overlaps_open."""
    known = e1.isNotNull() & l1.isNotNull() & e2.isNotNull() & l2.isNotNull()
    within = ((e1 >= e2) & (l1 <= l2)) | ((e2 >= e1) & (l2 <= l1))
    return F.when(~known, "unknown").when((e1 == e2) & (l1 == l2), "equal").when(within, "within").when((e1 <= l2) & (e2 <= l1), "overlap").otherwise("disjoint")


def union(e1: Column, l1: Column, e2: Column, l2: Column) -> tuple[Column, Column]:
    """Range of two sources of one date: least known start to greatest known end."""
    return F.least(e1, e2), F.greatest(l1, l2)


def era_guidance(year: Column) -> Column:
    """What to search for an event of that year. The bands' first years."""
    bands = [(1538, "before parish registers"), (1837, "parish registers"), (1911, "civil registration and censuses"), (1939, "civil registration"), (1990, "civil registration and the 1939 register")]
    out = F.lit("recent records")
    for before, label in reversed(bands):
        out = F.when(year < before, label).otherwise(out)
    return F.when(year.isNotNull(), out)
