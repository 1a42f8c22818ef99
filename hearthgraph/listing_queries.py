"""Queries of the listing operators and their SQL; registered with the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import graph, listing
from .queries import ORACLE, query, recursive

_BLANK = " + ".join(f"(trim(coalesce({f}, '')) = '')::INT" for f in ("given", "surname", "gender", "birth_raw", "death_raw", "birth_place", "death_place", "bio"))


@query("T1_by_name", "SELECT id, surname, given FROM profiles ORDER BY surname NULLS LAST, given NULLS LAST, id")
def t1_by_name(cat):
    return listing.by_name(cat.profiles.select("id", "surname", "given"))


@query("T2_most_gaps", f"SELECT id, {_BLANK} AS n_gaps FROM profiles ORDER BY n_gaps DESC, id")
def t2_gaps(cat):
    return listing.most_gaps_first(cat.profiles).select("id", "n_gaps")


@query("T8_chronology", "SELECT record_id, record_type, year FROM records ORDER BY year NULLS LAST, record_type, record_id")
def t8_chronology(cat):
    return listing.chronological(cat.records.select("record_id", "record_type", "year"), "year", "record_type", "record_id")


@query("T9_filtered_page", "SELECT record_id, year FROM records WHERE tier = 3 AND district = 'Morton' ORDER BY year DESC NULLS LAST, record_id LIMIT 200")
def t9_page(cat):
    keep = (F.col("tier") == 3) & (F.col("district") == "Morton")
    return listing.page_of(cat.records, keep, [F.desc_nulls_last("year"), F.asc("record_id")], 500).select("record_id", "year")


@query("T10_component_order")
def t10_components(cat):
    edges = cat.edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    return graph.component_sizes(graph.components(cat.profiles, edges)).orderBy(F.desc("n_people"), "component")


ORACLE["T10_component_order"] = recursive(
    ", ends AS (SELECT from_id AS a, to_id AS b FROM edges UNION SELECT to_id, from_id FROM edges), walk AS (SELECT id, id AS top FROM profiles UNION SELECT e.b, walk.top FROM walk JOIN ends e ON e.a = walk.id WHERE walk.top < e.b), "
    "found AS (SELECT id, min(top) AS component FROM walk GROUP BY id) SELECT component, count(*) AS n_people FROM found GROUP BY component ORDER BY n_people DESC, component"
)


@query("P7_historical", "SELECT id, coalesce(length(trim(bio)), 0) < 50 AS without_bio, NOT EXISTS (SELECT 1 FROM parents e WHERE e.to_id = people.id) AS without_parents, (birth_raw IS NULL OR death_raw IS NULL) AS without_dates FROM people WHERE bb < 1930")
def p7_historical(cat):
    return listing.historical(cat.dated, cat.parents)


@query("P15_search", """SELECT 'person' AS kind, id::VARCHAR AS id FROM profiles WHERE contains(lower(given), 'may') OR contains(lower(middle), 'may') OR contains(lower(surname), 'may')
UNION ALL SELECT 'record', record_id::VARCHAR FROM records WHERE contains(lower(given), 'may') OR contains(lower(mother_maiden), 'may')
UNION ALL SELECT 'event', event_id::VARCHAR FROM events WHERE contains(lower(event_type), 'may') UNION ALL SELECT 'document', doc_id::VARCHAR FROM documents WHERE contains(lower(text), 'may')""")
def p15_search(cat):
    tables = {
        "person": (cat.profiles, "id", ["given", "middle", "surname"]),
        "record": (cat.records, "record_id", ["given", "mother_maiden"]),
        "event": (cat.table("events"), "event_id", ["event_type"]),
        "document": (cat.table("documents"), "doc_id", ["text"]),
    }
    return listing.search(tables, " May ")


@query("A1_table_sizes", "SELECT 'profiles' AS kind, count(*) AS n FROM profiles UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'life', count(*) FROM life UNION ALL SELECT 'records', count(*) FROM records")
def a1_sizes(cat):
    return listing.sizes({"profiles": cat.profiles, "edges": cat.edges, "life": cat.life, "records": cat.records})


@query("A3_counts_by_kind", "SELECT record_type, count(*) AS n, min(CASE WHEN direct THEN year END) AS first_direct FROM records GROUP BY record_type")
def a3_counts(cat):
    return cat.records.groupBy("record_type").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("direct"), F.col("year"))).alias("first_direct"))


@query("A14_suggestions", """SELECT * FROM (SELECT 'surname' AS kind, surname AS value, count(*) AS n FROM profiles WHERE gender = 'female' AND trim(surname) <> '' GROUP BY 2 ORDER BY n DESC, value LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'place', v, count(*) AS n FROM (SELECT birth_place AS v FROM profiles UNION ALL SELECT death_place FROM profiles) WHERE trim(v) <> '' GROUP BY 2 ORDER BY n DESC, v LIMIT 10)""")
def a14_suggestions(cat):
    p = cat.profiles
    surnames = listing.most_frequent(p.where("gender = 'female'"), "surname", 5)
    places = listing.most_frequent(p.select(F.explode(F.array("birth_place", "death_place")).alias("place")), "place", 10)
    return surnames.withColumn("kind", F.lit("surname")).unionByName(places.withColumn("kind", F.lit("place")))


@query("A20_searched_in_vain", """SELECT profile_id, source_id, record_type FROM records GROUP BY ALL HAVING bool_and(coalesce(direct AND tier = 1, false))
EXCEPT SELECT profile_id, source_id, record_type FROM records WHERE year > 1900""")
def a20_in_vain(cat):
    attempts = cat.records.withColumns({"clean": F.col("direct"), "found": F.col("tier") - 1})
    return listing.searched_in_vain(attempts, cat.records.where("year > 1900"), ["profile_id", "source_id", "record_type"])


@query("A23_corpus_stats", "SELECT count(*) AS n, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS n_bytes FROM documents", carriers=False)
def a23_stats(cat):
    return cat.table("documents").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.coalesce("text", F.lit(""))).cast("long")).alias("n_bytes"))


@query("Z9_changes", "SELECT 'life' AS kind, profile_id, year FROM life WHERE year > 1880 UNION ALL SELECT 'record', profile_id, year FROM records WHERE year > 1880")
def z9_changes(cat):
    return listing.changes_since({"life": cat.life.select("profile_id", "year"), "record": cat.records.select("profile_id", "year")}, "year", F.lit(1880))


@query("F26_lead_ids", "SELECT record_id, 'lead_' || trim(regexp_replace(lower(given || ' ' || surname), '[^a-z0-9]', '_', 'g'), '_') || '_' || record_type || '_' || CASE WHEN year IS NULL OR year = 0 THEN 'unknown' ELSE year::VARCHAR END AS lead_id FROM records")
def f26_leads(cat):
    name = F.concat("given", F.lit(" "), "surname")
    return cat.records.select("record_id", listing.lead_id(name, F.col("record_type"), F.col("year")).alias("lead_id"))


@query("F24_quarters", "SELECT o_orderkey, CASE quarter(o_orderdate) WHEN 1 THEN 'Mar' WHEN 2 THEN 'Jun' WHEN 3 THEN 'Sep' WHEN 4 THEN 'Dec' END AS quarter FROM orders", carriers=False)
def f24_quarters(cat):
    return cat.table("orders").select("o_orderkey", listing.quarter_of(F.month("o_orderdate")).alias("quarter"))
