"""Queries of the deciding operators and their SQL; registered with the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import deciding
from .queries import query

_SOURCE = "CASE CAST(record_id % 5 AS INT) WHEN 0 THEN 'CWGC' WHEN 1 THEN 'freebmd' WHEN 2 THEN 'freecen' WHEN 3 THEN 'Find a Grave' ELSE source_id END"
_LEVEL = "CASE CAST(record_id % 11 AS INT) WHEN 0 THEN 'confirmed' WHEN 1 THEN 'probable' ELSE 'possible' END"


@query("R1_severity", f""", r AS (SELECT record_id, lower({_SOURCE}) AS s, tier, record_type IN ('death', 'burial') AS late, abs(r.year - p.bb) % 7 AS d, {_LEVEL} AS level FROM records r JOIN people p ON p.id = r.profile_id),
b AS (SELECT record_id, level, CASE s WHEN 'cwgc' THEN if(d = 0, 0, 4) WHEN 'find a grave' THEN if(d <= 2, 1, 3) WHEN 'freecen' THEN if(d < 3, 0, if(d = 3, 2, 3))
  WHEN 'freebmd' THEN CASE WHEN late THEN if(d < 1, 0, if(d = 1, 2, 3)) ELSE if(d < 2, 0, if(d = 2, 2, 3)) END
  ELSE CASE tier WHEN 1 THEN if(d = 0, 0, if(d <= 2, 2, 4)) WHEN 2 THEN if(d <= 1, 0, if(d <= 3, 2, 3)) ELSE if(d <= 2, 1, 3) END END AS base FROM r WHERE d IS NOT NULL)
SELECT record_id, list_extract(['none', 'note', 'refinement', 'conflict', 'correction'], 1 + greatest(base, CASE level WHEN 'confirmed' THEN 4 WHEN 'probable' THEN 3 ELSE 0 END)::INT) AS severity FROM b""")
def r1_severity(cat):
    rows = cat.records.join(cat.dated.select(F.col("id").alias("profile_id"), "bb"), "profile_id").withColumn("delta", F.abs(F.col("year") - F.col("bb")) % 7)
    made = deciding.severity(F.expr(_SOURCE), F.col("tier"), F.col("record_type"), F.col("delta"), F.expr(_LEVEL))
    return rows.where("delta IS NOT NULL").select("record_id", made.alias("severity"))


@query("T3_by_severity", "SELECT record_id, o FROM (SELECT record_id, CASE WHEN record_id % 3 = 0 THEN 'info' WHEN record_id % 3 = 1 THEN 'error' ELSE 'warning' END AS o FROM records) ORDER BY CASE o WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, record_id")
def t3_severity(cat):
    rows = cat.records.select("record_id", F.expr("CASE WHEN record_id % 3 = 0 THEN 'info' WHEN record_id % 3 = 1 THEN 'error' ELSE 'warning' END AS o"))
    return deciding.ranked(rows, "o", ("error", "warning"), "record_id")


@query("T7_by_verdict", "SELECT record_id, v FROM (SELECT record_id, CASE tier WHEN 1 THEN 'fact' WHEN 2 THEN 'impossible' ELSE 'lead' END AS v FROM records) ORDER BY CASE v WHEN 'fact' THEN 0 WHEN 'lead' THEN 1 ELSE 2 END, record_id")
def t7_verdict(cat):
    rows = cat.records.select("record_id", F.expr("CASE tier WHEN 1 THEN 'fact' WHEN 2 THEN 'impossible' ELSE 'lead' END AS v"))
    return deciding.ranked(rows, "v", ("fact", "lead", "impossible"), "record_id")


@query("P14_publish_policy", """SELECT id, CASE WHEN id % 5 = 0 THEN 'omit' WHEN id % 5 = 1 THEN 'full' WHEN id % 5 = 2 THEN 'nameOnly' WHEN living THEN 'nameOnly' ELSE 'full' END AS policy FROM people""")
def p14_policy(cat):
    chosen = F.expr("CASE CAST(id % 5 AS INT) WHEN 0 THEN 'omit' WHEN 1 THEN 'full' WHEN 2 THEN 'nameOnly' WHEN 3 THEN 'auto' END")
    return cat.dated.select("id", deciding.policy(chosen, F.col("living")).alias("policy"))


@query("J16_narrowest_decision", """, asked AS (SELECT record_id, district AS text, record_type AS field FROM records), d AS (SELECT id, birth_place AS place, CASE WHEN id % 2 = 0 THEN 'Morton' ELSE 'Alderby' END AS text, CASE id % 3 WHEN 0 THEN 'census' WHEN 1 THEN 'birth' END AS field FROM profiles WHERE birth_place IS NOT NULL)
SELECT record_id, (SELECT place FROM d WHERE d.text = asked.text AND (d.field IS NULL OR d.field = asked.field) ORDER BY d.field IS NULL, d.id LIMIT 1) AS place FROM asked""")
def j16_decision(cat):
    asked = cat.records.select("record_id", F.col("district").alias("text"), F.col("record_type").alias("field"))
    made = cat.profiles.where("birth_place IS NOT NULL").select("id", F.col("birth_place").alias("place"), F.expr("CASE WHEN id % 2 = 0 THEN 'Morton' ELSE 'Alderby' END AS text"), F.expr("CASE CAST(id % 3 AS INT) WHEN 0 THEN 'census' WHEN 1 THEN 'birth' END AS field"))
    return deciding.narrowest(asked, made).select("record_id", "place")


def _leads(cat):
    leads = cat.records.where("tier = 3").select(F.concat(F.lit("lead_"), F.col("record_id").cast("string")).alias("id"), "profile_id", F.expr("CASE WHEN direct THEN 'open' ELSE 'closed' END AS status"))
    return cat.records.select(F.col("record_id").alias("source_record_id"), "profile_id", "source_id"), leads


_LEADS = ", leads AS (SELECT 'lead_' || record_id AS id, profile_id, CASE WHEN direct THEN 'open' ELSE 'closed' END AS status FROM records WHERE tier = 3) SELECT r.record_id AS source_record_id, l.status AS lead_status FROM records r"


@query("J2_evidence_with_leads", f"{_LEADS} LEFT JOIN leads l ON l.id = 'lead_' || r.record_id AND l.profile_id = r.profile_id")
def j2_leads(cat):
    return deciding.with_leads(*_leads(cat)).select("source_record_id", "lead_status")


@query("J3_evidence_of_leads", f"{_LEADS} JOIN leads l ON l.id = 'lead_' || r.record_id AND l.profile_id = r.profile_id")
def j3_leads(cat):
    return deciding.with_leads(*_leads(cat), inner=True).select("source_record_id", "lead_status")


@query("J4_discarded_or_led", f"{_LEADS} LEFT JOIN leads l ON l.id = 'lead_' || r.record_id AND l.profile_id = r.profile_id WHERE r.source_id = 's4' OR l.id IS NOT NULL")
def j4_led(cat):
    return deciding.with_leads(*_leads(cat)).where("source_id = 's4' OR has_lead").select("source_record_id", "lead_status")


@query("A12_hours", """SELECT sum(greatest(0, epoch(coalesce(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate + to_hours((o_orderkey % 50 - 5)::INT) END, TIMESTAMP '1995-01-01')) - epoch(o_orderdate))) / 3600 AS hours FROM orders""", carriers=False)
def a12_hours(cat):
    spans = cat.table("orders").withColumn("_end", F.expr("CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate + make_interval(0, 0, 0, 0, CAST(o_orderkey % 50 - 5 AS INT)) END"))
    return deciding.hours(spans, "o_orderdate", "_end", F.lit("1995-01-01").cast("timestamp"))


@query("R27_long_names", "SELECT id, length(n) AS n_chars FROM (SELECT id, trim(repeat(coalesce(given, '') || ' ', (id % 120)::INT)) AS n FROM profiles) WHERE length(n) BETWEEN 100 AND 499")
def r27_names(cat):
    rows = cat.profiles.select("id", F.expr("repeat(coalesce(given, '') || ' ', CAST(id % 120 AS INT)) AS n"))
    return rows.where(deciding.long_name(F.col("n"))).select("id", F.length(F.trim("n")).cast("long").alias("n_chars"))


@query("F17_written_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%-d %B %Y') END AS written FROM orders", carriers=False)
def f17_dates(cat):
    raw = F.expr("CASE WHEN o_orderkey % 9 = 0 THEN date_format(o_orderdate, 'yyyy') ELSE date_format(o_orderdate, 'dd/MM/yyyy') END")
    return cat.table("orders").select("o_orderkey", deciding.written_date(raw).alias("written"))


@query("E22_birth_from_death", """, m AS (SELECT p.id, r.year - (20 + r.record_id % 3) AS birth_year, r.record_id FROM people p JOIN records r ON r.profile_id = p.id WHERE p.bb IS NULL AND abs(r.year - p.db) <= 1 AND r.record_type = 'death')
SELECT id, min(birth_year)::INT AS birth_year, arg_min(record_id, birth_year * 1000000000 + record_id) AS record_id FROM m GROUP BY id HAVING max(birth_year) - min(birth_year) <= 2""")
def e22_births(cat):
    people = cat.dated.select("id", F.col("bb").alias("birth_year"), F.col("db").alias("death_year"), F.lit(None).cast("string").alias("quarter"))
    deaths = cat.records.where("record_type = 'death'").select("record_id", "profile_id", "year", F.lit(None).cast("string").alias("quarter"), F.expr("CAST(20 + record_id % 3 AS INT) AS age"))
    return deciding.birth_from_death(people, deaths)


@query("T12_oldest_queued", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id", carriers=False)
def t12_oldest(cat):
    return deciding.oldest_queued(cat.table("events"), "user_id", "ts", "event_id")


@query("U4_rejections", "SELECT profile_id, source_id FROM records WHERE tier = 3 UNION SELECT profile_id, source_id FROM records WHERE NOT direct")
def u4_rejections(cat):
    pair = cat.records.select("profile_id", "source_id", "tier", "direct")
    return pair.where("tier = 3").select("profile_id", "source_id").union(pair.where("NOT direct").select("profile_id", "source_id")).distinct()


@query("Z6_after_mark", "SELECT event_id FROM events WHERE ts > (SELECT min(ts) + INTERVAL 1 DAY FROM events)", carriers=False)
def z6_newer(cat):
    events = cat.table("events")
    mark = events.agg((F.min("ts") + F.expr("INTERVAL 1 DAY")).alias("m"))
    return deciding.newer(events.join(F.broadcast(mark)), "ts", F.col("m")).select("event_id")
