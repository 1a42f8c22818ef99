"""Scoring, corroboration and conflict of evidence records about people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, names

#: Years of tolerance by record type.
TOLERANCE = {"birth": 2, "death": 1, "marriage": 1, "probate": 2, "burial": 2, "census": 5, "parish": 3}
HOME_DISTRICTS = ("Alderby", "Braywell", "Morton")
LEVELS = ("single", "possible", "probable", "confirmed")


def _tolerance() -> Column:
    return F.create_map(*[F.lit(x) for kv in TOLERANCE.items() for x in kv])[F.col("record_type")]


def scored(records: DataFrame, people: DataFrame) -> DataFrame:
    """record_id, profile_id, name_gate, date_gate, geography_gate, verdict for each record of a known person.

    A gate is pass, soft, fail or skip (nothing to compare). A failed name or date is impossible; all passed or
    skipped is a fact, which a person without any date caps to a lead; anything else is a lead.
    """
    p = people.select(F.col("id").alias("profile_id"), F.upper("surname").alias("_s"), F.upper("married_surname").alias("_m"), F.upper("given").alias("_g"), "bb", "db", "be", "dl")
    r = records.join(p, "profile_id").withColumns({"_rs": F.upper("surname"), "_rg": F.upper("given")})
    married = F.when(F.col("record_type").isin("death", "burial", "probate", "census"), names.similarity(F.col("_rs"), F.col("_m"))).otherwise(0.0)
    surname = F.greatest(names.similarity(F.col("_rs"), F.col("_s")), married)
    given = names.similarity(F.col("_rg"), F.col("_g"))
    name = F.when(F.col("_rs").isNull() | F.col("_s").isNull() | F.col("_g").isNull(), "soft").when(surname < 0.7, "fail").when(given >= 0.7, "pass").otherwise("soft")
    implied = F.when(F.col("record_type") == "census", F.col("year") - F.col("age")).otherwise(F.col("year"))
    against = F.when(F.col("record_type").isin("birth", "parish", "census"), F.col("bb")).when(F.col("record_type").isin("death", "burial", "probate"), F.col("db"))
    off = F.abs(implied - against)
    wed = F.when((F.col("year") < F.col("be") + 14) | (F.col("year") > F.col("dl") + 1), "fail").otherwise("pass")
    date = F.when(F.col("year").isNull(), "skip").when(F.col("record_type") == "marriage", wed).when(off.isNull(), "skip").when(off <= _tolerance(), "pass").otherwise("fail")
    place = F.when(F.col("district").isNull(), "soft").when(F.col("district").isin(*HOME_DISTRICTS), "pass").otherwise("soft")
    r = r.withColumns({"name_gate": name, "date_gate": date, "geography_gate": place})
    impossible = (F.col("name_gate") == "fail") | (F.col("date_gate") == "fail")
    fact = F.col("name_gate").isin("pass", "skip") & F.col("date_gate").isin("pass", "skip") & (F.col("geography_gate") == "pass")
    thin = F.col("bb").isNull() & F.col("db").isNull()
    verdict = F.when(impossible, "impossible").when(fact & ~thin, "fact").otherwise("lead")
    return r.select("record_id", "profile_id", "record_type", "year", "volume", "page", "direct", "name_gate", "date_gate", "geography_gate", verdict.alias("verdict"))


def exclusive(facts: DataFrame) -> DataFrame:
    """record_id, verdict after one fact per slot: a slot with several registrations keeps one that alone is direct, else all become leads.

    Slots are birth, death, burial, probate and each census year; records of one registration share its key.
    """
    slot = F.when(F.col("record_type").isin("birth", "death", "burial", "probate"), F.col("record_type")).when(F.col("record_type") == "census", F.concat(F.lit("census-"), F.col("year").cast("string")))
    f = facts.where("verdict = 'fact'").withColumn("slot", slot)
    key = F.concat_ws("/", "volume", "page", F.col("year").cast("string"))
    f = f.withColumn("key", key)
    slots = f.where("slot IS NOT NULL").groupBy("profile_id", "slot").agg(F.count_distinct("key").alias("n"), F.count_distinct(F.when(F.col("direct"), F.col("key"))).alias("n_direct"), F.min(F.when(F.col("direct"), F.col("key"))).alias("winner"))
    won = F.col("n").isNull() | (F.col("n") == 1) | ((F.col("n_direct") == 1) & (F.col("key") == F.col("winner")))
    return f.join(slots, ["profile_id", "slot"], "left").select("record_id", "profile_id", "slot", F.when(won, "fact").otherwise("lead").alias("verdict"))


def convergence(records: DataFrame) -> DataFrame:
    """Per person, type and year: lineages, trust, level. Three lineages confirm; two with trust 4 are probable; two, or
    two records of one, possible; without a direct record never above possible."""
    g = records.where("year IS NOT NULL").groupBy("profile_id", "record_type", "year").agg(
        F.count(F.lit(1)).alias("n_records"), F.count_distinct("lineage").alias("n_lineages"), F.sum("tier").alias("trust"), F.bool_or("direct").alias("any_direct")
    )
    rank = F.when(F.col("n_lineages") >= 3, 3).when((F.col("n_lineages") == 2) & (F.col("trust") >= 4), 2).when((F.col("n_lineages") == 2) | (F.col("n_records") >= 2), 1).otherwise(0)
    rank = F.when(F.col("any_direct"), rank).otherwise(F.least(rank, F.lit(1)))
    return g.select("profile_id", "record_type", "year", "n_records", "n_lineages", "trust", F.element_at(F.array(*map(F.lit, LEVELS)), rank + 1).alias("level"))


def birth_consensus(records: DataFrame) -> DataFrame:
    """Per person the three-year window that most records' implied births fall in, with at least 3 records and 2 sources; the lowest year of equals."""
    implied = F.when(F.col("record_type") == "birth", F.col("year")).when(F.col("record_type") == "census", F.col("year") - F.col("age"))
    r = records.select("profile_id", "source_id", implied.alias("y")).where("y IS NOT NULL")
    spread = r.withColumn("center", F.explode(F.array(F.col("y") - 1, F.col("y"), F.col("y") + 1)))
    w = spread.groupBy("profile_id", "center").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_id").alias("n_sources"))
    best = w.groupBy("profile_id").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("center"), "n_sources", "n")).alias("x"))
    return best.select("profile_id", F.col("x.center").alias("birth_year"), F.col("x.n").alias("n"), F.col("x.n_sources").alias("n_sources")).where("n >= 3 AND n_sources >= 2").withColumn("strength", F.when(F.col("n") >= 4, "high").otherwise("low"))


def disputes(records: DataFrame) -> DataFrame:
    """Persons whose records of one type name several years, and how the ladder settles it: by a year that alone is
    direct, else by one whose best tier alone is highest, else open."""
    g = records.where("year IS NOT NULL AND record_type IN ('birth', 'death', 'burial')").groupBy("profile_id", "record_type", "year").agg(F.max(F.col("direct").cast("int")).alias("direct"), F.max("tier").alias("tier"))
    by = Window.partitionBy("profile_id", "record_type")
    g = g.withColumns({"n_years": F.count(F.lit(1)).over(by), "n_direct": F.sum("direct").over(by), "top": F.max("tier").over(by)})
    g = g.withColumn("n_top", F.sum((F.col("tier") == F.col("top")).cast("int")).over(by)).where("n_years > 1")
    return g.groupBy("profile_id", "record_type").agg(
        F.max("n_years").alias("n_years"),
        F.when(F.max("n_direct") == 1, "directness").when(F.max("n_top") == 1, "tier").otherwise("open").alias("rung"),
        F.when(F.max("n_direct") == 1, F.max(F.when(F.col("direct") == 1, F.col("year")))).when(F.max("n_top") == 1, F.max(F.when(F.col("tier") == F.col("top"), F.col("year")))).alias("settled"),
        (F.max("year") - F.min("year")).alias("spread"),
    )


def inferred_siblings(records: DataFrame, years: int = 20, band: int = 20) -> DataFrame:
    """Pairs of birth records of different persons with one surname and mother's maiden name whose years are at most `years` apart; found in neighbouring bands."""
    b = records.where("record_type = 'birth' AND year IS NOT NULL AND trim(surname) <> '' AND trim(mother_maiden) <> ''").select("record_id", "profile_id", F.upper(F.trim("surname")).alias("surname"), F.upper(F.trim("mother_maiden")).alias("mother"), "year")
    b = b.withColumn("band", F.expr(f"year div {band}"))
    a = b.select(*[F.col(c).alias(f"a_{c}") for c in b.columns]).withColumn("band", F.explode(F.expr("array(a_band - 1, a_band, a_band + 1)")))
    pairs = a.join(b, (F.col("a_surname") == F.col("surname")) & (F.col("a_mother") == F.col("mother")) & (a["band"] == b["band"]))
    return pairs.where(f"a_record_id < record_id AND a_profile_id <> profile_id AND abs(a_year - year) <= {years}").select(F.col("a_record_id").alias("a"), F.col("record_id").alias("b"))


def merge_action(e1: Column, l1: Column, e2: Column, l2: Column) -> Column:
    """What a second date does to the first: replace an unknown one, corroborate an equal one, narrow an overlapping one, dispute a disjoint one."""
    none = e1.isNull() & l1.isNull()
    other = e2.isNull() & l2.isNull()
    same = e1.eqNullSafe(e2) & l1.eqNullSafe(l2)
    return F.when(other, "keep").when(none, "replace").when(same, "corroborate").when(dates.overlaps_open(e1, l1, e2, l2), "intersect").otherwise("dispute")


def spouse_corroboration(records: DataFrame, spouses: DataFrame) -> DataFrame:
    """Couples whose marriage records share exactly one registration key: a < b, volume, page, year."""
    m = records.where("record_type = 'marriage' AND year IS NOT NULL").select("profile_id", "volume", "page", "year").distinct()
    pairs = spouses.where("id < other").select(F.col("id").alias("a"), F.col("other").alias("b")).distinct()
    left, right = m.select(F.col("profile_id").alias("a"), "volume", "page", "year"), m.select(F.col("profile_id").alias("b"), "volume", "page", F.col("year").alias("b_year"))
    both = pairs.join(left, "a").join(right, ["b", "volume", "page"]).where("abs(year - b_year) <= 30")
    return both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("page")).where("n = 1").select("a", "b", "page")


def attrition(scores: DataFrame) -> DataFrame:
    """How many records each gate turned away or weakened, by verdict."""
    gates = F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), F.col(f"{g}_gate").alias("outcome")) for g in ("name", "date", "geography")]))
    return scores.select("verdict", gates.alias("g")).groupBy("verdict", "g.gate", "g.outcome").agg(F.count(F.lit(1)).alias("n"))
