"""Queries of the engine's own operators over the driver's tables, and their SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .carriers import AS_OF, Catalog, oracle
from .functions import dates, names
from .operators import corpus, duplicates, evidence, graph, relational
from .plans import audit
from .sources import gedcom
from .streaming import budget

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, carriers: bool = True):
    def add(fn: Callable[[Catalog], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Catalog(spark, sf_dir))
        if sql:
            ORACLE[name] = oracle(sql) if carriers else sql
        return fn

    return add


# --- audit rules ------------------------------------------------------------------------------------------------

_SIM = names.sql("upper(a.given)", "upper(b.given)")
_PERSON = "SELECT id, upper(trim(coalesce(given, ''))) AS given, upper(trim(coalesce(surname, ''))) AS surname, be, bl, bb, coalesce(be, bl) IS NOT NULL AS born FROM people"
#: All pairs of people by the rule's own words: distinct names are rated once, then everyone meets everyone.
_DUP = f"""SELECT a, b, ca, cb, score FROM (
  SELECT a.id AS a, b.id AS b, a.c AS ca, b.c AS cb, CASE WHEN a.given <> '' AND b.given <> '' AND sg = 0 THEN 0 WHEN apart AND abs(a.bb - b.bb) > 10 THEN 0
    ELSE round(greatest(0.4 * ss + 0.3 * sg + CASE WHEN dated AND NOT apart THEN 0.3 ELSE 0 END, CASE WHEN ss >= 0.9 AND sg >= 0.7 AND NOT apart THEN 0.7 ELSE 0 END), 4) END AS score
  FROM (SELECT a, b, coalesce(x.sim, 0) AS ss, coalesce(y.sim, 0) AS sg, a.born AND b.born AS dated, a.born AND b.born AND NOT (coalesce(a.be <= b.bl, true) AND coalesce(b.be <= a.bl, true)) AS apart
    FROM (SELECT *, min(id) OVER (PARTITION BY surname, given, be, bl) AS c FROM ({_PERSON})) a
    JOIN (SELECT *, min(id) OVER (PARTITION BY surname, given, be, bl) AS c FROM ({_PERSON})) b ON a.id < b.id
    LEFT JOIN (SELECT a.surname AS v, b.surname AS w, {names.sql("a.surname", "b.surname")} AS sim FROM (SELECT DISTINCT surname FROM ({_PERSON})) a, (SELECT DISTINCT surname FROM ({_PERSON})) b) x ON x.v = a.surname AND x.w = b.surname
    LEFT JOIN (SELECT a.given AS v, b.given AS w, {names.sql("a.given", "b.given")} AS sim FROM (SELECT DISTINCT given FROM ({_PERSON})) a, (SELECT DISTINCT given FROM ({_PERSON})) b) y ON y.v = a.given AND y.w = b.given))
WHERE score >= 0.7 AND NOT EXISTS (SELECT 1 FROM parents e WHERE least(e.from_id, e.to_id) = a AND greatest(e.from_id, e.to_id) = b)"""
#: Rules that are no single condition: profile_id, severity, related.
_MADE = {
    "missingCoParent": """SELECT o.to_id AS profile_id, 'warning' AS severity, CAST(min(s.other) AS STRING) AS related
        FROM (SELECT to_id, min(from_id) AS p FROM parents GROUP BY to_id HAVING count(DISTINCT from_id) = 1) o JOIN spouses s ON s.id = o.p
        WHERE EXISTS (SELECT 1 FROM parents x JOIN parents y ON x.to_id = y.to_id WHERE x.from_id = o.p AND y.from_id = s.other AND x.to_id <> o.to_id)
        GROUP BY o.to_id HAVING count(DISTINCT s.other) = 1""",
    "datelessReadsAsLiving": f"""SELECT p.id AS profile_id, 'warning' AS severity, '' AS related FROM people p
        LEFT JOIN (SELECT x.to_id AS id, max(q.bb) AS sib FROM parents x JOIN parents y ON x.from_id = y.from_id AND y.to_id <> x.to_id JOIN people q ON q.id = y.to_id GROUP BY 1) a ON a.id = p.id
        LEFT JOIN (SELECT s.id, max(q.bb) AS mate FROM spouses s JOIN people q ON q.id = s.other GROUP BY 1) b ON b.id = p.id
        LEFT JOIN (SELECT x.from_id AS id, min(q.bb) AS child FROM parents x JOIN people q ON q.id = x.to_id GROUP BY 1) c ON c.id = p.id
        WHERE coalesce(be, bl, de, dl) IS NULL AND least(sib + 20, mate + 20, child - 14) + 100 < {AS_OF}""",
    "duplicateDetection": f"SELECT a AS profile_id, 'warning' AS severity, CAST(max(b) AS STRING) AS related FROM ({_DUP}) GROUP BY a",
    "siblingIdentityCollision": f"""SELECT a.id AS profile_id, 'warning' AS severity, CAST(b.id AS STRING) AS related
        FROM (SELECT p.*, list_sort(list(DISTINCT e.from_id)) AS ps FROM people p JOIN parents e ON e.to_id = p.id GROUP BY ALL) a
        JOIN (SELECT p.*, list_sort(list(DISTINCT e.from_id)) AS ps FROM people p JOIN parents e ON e.to_id = p.id GROUP BY ALL) b
        ON a.ps = b.ps AND len(a.ps) = 2 AND a.gender = b.gender AND a.id < b.id AND a.be <= b.bl + 1 AND b.be <= a.bl + 1
        WHERE a.given IS NOT NULL AND b.given IS NOT NULL AND ({_SIM}) < 0.7""",
    "marriedSurnameFromSpouse": """SELECT p.id AS profile_id, 'warning' AS severity, CAST(min(s.other) AS STRING) AS related FROM people p JOIN spouses s ON s.id = p.id JOIN people q ON q.id = s.other
        WHERE p.gender = 'female' AND p.married_surname IS NULL AND q.surname IS NOT NULL AND (p.surname IS NULL OR p.surname <> q.surname) GROUP BY p.id""",
    "excessParentEdges": "SELECT to_id AS profile_id, 'error' AS severity, string_agg(CAST(from_id AS STRING), ',' ORDER BY from_id) AS related FROM parents GROUP BY to_id HAVING count(*) > 2",
    "parentsPerRole": "SELECT to_id AS profile_id, 'error' AS severity, string_agg(DISTINCT CAST(from_id AS STRING), ',' ORDER BY CAST(from_id AS STRING)) AS related FROM parents WHERE role IS NOT NULL GROUP BY to_id, role HAVING count(DISTINCT from_id) >= 2",
    "recordAfterDeath": "SELECT DISTINCT p.id AS profile_id, 'error' AS severity, '' AS related FROM life l JOIN people p ON p.id = l.profile_id WHERE l.kind <> 'baptism' AND l.year > p.dl",
    "orphanStub": """SELECT p.id AS profile_id, 'warning' AS severity, CAST(min(q.id) AS STRING) AS related FROM people p JOIN people q ON upper(p.given) = upper(q.given) AND upper(p.surname) = upper(q.surname)
        WHERE p.n_parents + p.n_children + p.n_spouses = 0 AND q.n_parents + q.n_children + q.n_spouses > 0 GROUP BY p.id""",
    "phantomSpouse": "SELECT p.id AS profile_id, 'warning' AS severity, CAST(s.other AS STRING) AS related FROM people p JOIN spouses s ON s.id = p.id WHERE n_spouses = 1 AND n_parents + n_children = 0 AND coalesce(be, bl, de, dl) IS NULL",
}


def _rule_sql(r: audit.Rule) -> str:
    if r.make:
        return _MADE[r.name]
    related = f"CAST({r.related} AS STRING)" if r.related else "''"
    return f"SELECT * FROM (SELECT {r.subject} AS profile_id, CASE WHEN {r.certain} THEN '{r.severity}' WHEN {r.likely} THEN 'warning' END AS severity, {related} AS related FROM {r.over}) WHERE severity IS NOT NULL"


def _add_rule(r: audit.Rule) -> None:
    # several parents in one role are ordered as text, as the other engine can only order what it concatenates
    sort = r.name == "parentsPerRole"

    def run(cat: Catalog) -> DataFrame:
        rows = r.rows(cat)
        ids = F.transform("related", lambda x: x.cast("string"))
        return rows.select("profile_id", "severity", F.array_join(F.array_sort(ids) if sort else ids, ",").alias("related"))

    query(f"audit_{r.name}", _rule_sql(r))(run)


for _r in audit.RULES:
    _add_rule(_r)

_ALL = " UNION ALL ".join(f"SELECT '{r.name}' AS rule_id, '{r.category}' AS category, profile_id, severity FROM ({_rule_sql(r)})" for r in audit.RULES)


@query("audit_summary", f"SELECT rule_id, severity, category, count(*) AS n, count(DISTINCT profile_id) AS n_profiles FROM ({_ALL}) x WHERE (category = 'issue' OR profile_id NOT IN (SELECT id FROM profiles WHERE given IS NULL OR given = '?')) GROUP BY ALL")
def audit_summary(cat: Catalog) -> DataFrame:
    return audit.summary(audit.findings(cat))


# --- scalars ----------------------------------------------------------------------------------------------------


@query("F1_dates", "SELECT id, be, bl, bb, de, dl, db, living FROM people")
def f1_dates(cat):
    return cat.dated.select("id", "be", "bl", "bb", "de", "dl", "db", "living")


_NAMES = "SELECT x, y, {} FROM (SELECT DISTINCT upper(r.given) AS x, upper(p.given) AS y FROM records r JOIN profiles p ON p.id = r.profile_id) n"


@query("F4_name_similarity", _NAMES.format(", ".join(f"CAST({names.sql('n.x', 'n.y', k)} AS DOUBLE) AS {k}" for k in ("scoring", "audit", "simple"))))
def f4_names(cat):
    """The forenames that records and their people bear, each pair once."""
    p = cat.profiles.select(F.col("id").alias("profile_id"), F.upper("given").alias("y"))
    pairs = cat.records.select("profile_id", F.upper("given").alias("x")).join(p, "profile_id").select("x", "y").distinct()
    x, y = F.col("x"), F.col("y")
    return pairs.select("x", "y", names.similarity(x, y).alias("scoring"), names.audit_similarity(x, y).alias("audit"), names.simple_similarity(x, y).alias("simple"))


@query("F12_content_ids", r"SELECT doc_id, substr(sha256(trim(regexp_replace(coalesce(text, ''), '[ \t\r\n]+', ' ', 'g'))), 1, 16) AS content_id FROM documents", carriers=False)
def f12_ids(cat):
    return cat.table("documents").select("doc_id", corpus.content_id(F.col("text")).alias("content_id"))


@query("F23_guidance", "SELECT id, CASE WHEN bb IS NULL THEN NULL WHEN bb < 1538 THEN 'before parish registers' WHEN bb < 1837 THEN 'parish registers' WHEN bb < 1911 THEN 'civil registration and censuses' WHEN bb < 1939 THEN 'civil registration' WHEN bb < 1990 THEN 'civil registration and the 1939 register' ELSE 'recent records' END AS guidance FROM people")
def f23_guidance(cat):
    return cat.dated.select("id", dates.era_guidance(F.col("bb")).alias("guidance"))


@query("U6_date_union", "SELECT id, least(be, de) AS e, greatest(bl, dl) AS l FROM people")
def u6_union(cat):
    e, l = dates.union(F.col("be"), F.col("bl"), F.col("de"), F.col("dl"))
    return cat.dated.select("id", e.alias("e"), l.alias("l"))


_REL = "CASE WHEN a.be IS NULL OR a.bl IS NULL OR b.be IS NULL OR b.bl IS NULL THEN 'unknown' WHEN a.be = b.be AND a.bl = b.bl THEN 'equal' WHEN (a.be >= b.be AND a.bl <= b.bl) OR (b.be >= a.be AND b.bl <= a.bl) THEN 'within' WHEN a.be <= b.bl AND b.be <= a.bl THEN 'overlap' ELSE 'disjoint' END"


@query("J14_overlap", f"SELECT e.from_id, e.to_id, {_REL} AS relation, coalesce(a.be <= b.bl, true) AND coalesce(b.be <= a.bl, true) AS meets FROM edges e JOIN people a ON e.from_id = a.id JOIN people b ON e.to_id = b.id WHERE e.type = 'spouse'")
def j14_overlap(cat):
    a, b = (cat.dated.select(F.col("id").alias(k), F.col("be").alias(f"{k}e"), F.col("bl").alias(f"{k}l")) for k in ("from_id", "to_id"))
    x = cat.edges.where("type = 'spouse'").join(a, "from_id").join(b, "to_id")
    args = [F.col(c) for c in ("from_ide", "from_idl", "to_ide", "to_idl")]
    return x.select("from_id", "to_id", dates.relation_strict(*args).alias("relation"), dates.overlaps_open(*args).alias("meets"))


@query("E23_merge_action", "SELECT from_id, to_id, CASE WHEN b.be IS NULL AND b.bl IS NULL THEN 'keep' WHEN a.be IS NULL AND a.bl IS NULL THEN 'replace' WHEN a.be IS NOT DISTINCT FROM b.be AND a.bl IS NOT DISTINCT FROM b.bl THEN 'corroborate' WHEN coalesce(a.be <= b.bl, true) AND coalesce(b.be <= a.bl, true) THEN 'intersect' ELSE 'dispute' END AS action FROM edges e JOIN people a ON e.from_id = a.id JOIN people b ON e.to_id = b.id WHERE e.type = 'spouse'")
def e23_merge(cat):
    a, b = (cat.dated.select(F.col("id").alias(k), F.col("be").alias(f"{k}e"), F.col("bl").alias(f"{k}l")) for k in ("from_id", "to_id"))
    x = cat.edges.where("type = 'spouse'").join(a, "from_id").join(b, "to_id")
    return x.select("from_id", "to_id", evidence.merge_action(*[F.col(c) for c in ("from_ide", "from_idl", "to_ide", "to_idl")]).alias("action"))


# --- relational -------------------------------------------------------------------------------------------------


@query("P1_name_search", "SELECT id FROM profiles WHERE lower(concat_ws(' ', given, middle, surname, married_surname)) LIKE '%ar%' AND lower(concat_ws(' ', given, middle, surname, married_surname)) LIKE '%hol%'")
def p1_search(cat):
    return relational.search_names(cat.profiles, "ar HOL").select("id")


@query("P4_gaps", "SELECT id, concat_ws(',', CASE WHEN given IS NULL THEN 'given' END, CASE WHEN surname IS NULL THEN 'surname' END, CASE WHEN birth_raw IS NULL THEN 'birth_raw' END, CASE WHEN death_raw IS NULL THEN 'death_raw' END, CASE WHEN birth_place IS NULL THEN 'birth_place' END) AS missing, (given IS NOT NULL)::INT + (surname IS NOT NULL)::INT + (birth_raw IS NOT NULL)::INT + (death_raw IS NOT NULL)::INT + (birth_place IS NOT NULL)::INT AS n_present FROM profiles")
def p4_gaps(cat):
    return relational.gaps(cat.profiles, ("given", "surname", "birth_raw", "death_raw", "birth_place"))


@query("P5_completeness", f"SELECT id, {audit.COMPLETE} AS score, CASE WHEN living THEN 6 ELSE 7 END AS maximum FROM people")
def p5_completeness(cat):
    return cat.people.select("id", F.expr(audit.COMPLETE).alias("score"), F.expr("CASE WHEN living THEN 6 ELSE 7 END").alias("maximum"))


@query("A8_top_surnames", "SELECT lower(trim(surname)) AS key, min(surname) AS value, count(*) AS n FROM profiles WHERE surname IS NOT NULL GROUP BY 1 ORDER BY n DESC, key LIMIT 5")
def a8_top(cat):
    return relational.top_values(cat.profiles, "surname", 5)


@query("A9_lifespans", "SELECT gender, round(avg(db - bb), 4) AS mean_years, CAST(floor(median(db - bb)) AS BIGINT) AS median_years, count(*) AS n FROM people WHERE db >= bb GROUP BY gender")
def a9_lifespans(cat):
    return relational.lifespan(cat.dated, "gender")


@query("W2_child_gaps", "SELECT id, before, y AS after FROM (SELECT *, lag(y) OVER (PARTITION BY id ORDER BY y, child) AS before FROM (SELECT DISTINCT e.from_id AS id, e.to_id AS child, p.bb AS y FROM parents e JOIN people p ON p.id = e.to_id WHERE p.bb IS NOT NULL)) WHERE y - before > 3")
def w2_gaps(cat):
    return relational.child_gaps(cat.parents, cat.dated)


@query("W3_spouse_order", "SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY year ASC NULLS LAST, other) AS rank FROM spouses")
def w3_order(cat):
    return relational.spouse_order(cat.spouses)


@query("W1_latest_event", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1", carriers=False)
def w1_latest(cat):
    return relational.latest(cat.table("events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("E36_undo", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_id < 5000) WHERE r = 1", carriers=False)
def e36_undo(cat):
    return relational.undo(cat.table("events"), F.col("event_id") < 5000).select("user_id", "event_type", "event_id", "value")


@query("U3_timeline", "SELECT id, 'birth' AS kind, bb AS year FROM people WHERE bb IS NOT NULL UNION ALL SELECT id, 'death', db FROM people WHERE db IS NOT NULL UNION ALL SELECT id, 'marriage', year FROM spouses UNION ALL SELECT profile_id, kind, year FROM life")
def u3_timeline(cat):
    return relational.timeline(cat.dated, cat.spouses, cat.life)


@query("U8_canonical_edges", "SELECT DISTINCT type, CASE WHEN type = 'spouse' THEN least(from_id, to_id) ELSE from_id END AS a, CASE WHEN type = 'spouse' THEN greatest(from_id, to_id) ELSE to_id END AS b FROM edges")
def u8_edges(cat):
    return relational.canonical_edges(cat.edges)


@query("Z1_daily_budget", "SELECT event_type AS source, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, count(*) >= 20 AS paused FROM events GROUP BY 1, 2", carriers=False)
def z1_budget(cat):
    return relational.daily_budget(cat.table("events"), 20)


@query("Z1_daily_budget_stream", "SELECT event_type AS source, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2", carriers=False)
def z1_stream(cat):
    return budget.run_once(cat.spark, cat.sf_dir)


@query("Z8_error_streaks", """SELECT user_id, min(event_id) AS started, count(*) AS n FROM (
  SELECT *, sum(1 - bad) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT user_id, ts, event_id, CAST(event_type = 'error' AS INT) AS bad FROM events))
  WHERE bad = 1 GROUP BY user_id, island HAVING count(*) >= 2""", carriers=False)
def z8_streaks(cat):
    return relational.streaks(cat.table("events"), F.col("event_type") == "error", 2)


@query("Z5_trailing_activity", "SELECT user_id, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE GROUP BY user_id", carriers=False)
def z5_trailing(cat):
    events = cat.table("events")
    last = F.broadcast(events.agg(F.max("ts").alias("last")))  # one row
    return events.join(last, F.col("ts") >= F.expr("last - INTERVAL 30 MINUTES")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("A7_keep_first", "SELECT record_id, profile_id, record_type, page FROM (SELECT *, row_number() OVER (PARTITION BY profile_id, record_type, page ORDER BY record_id) AS r FROM records) WHERE r = 1")
def a7_first(cat):
    return relational.latest(cat.records, ["profile_id", "record_type", "page"], [F.asc("record_id")]).select("record_id", "profile_id", "record_type", "page")


@query("A13_sourcing", "SELECT p.id, count(r.record_id) AS n_records, coalesce(bool_and(NOT r.direct), false) AS all_indirect FROM profiles p LEFT JOIN records r ON r.profile_id = p.id GROUP BY p.id")
def a13_sourcing(cat):
    r = cat.records.groupBy(F.col("profile_id").alias("id")).agg(F.count(F.lit(1)).alias("n_records"), F.bool_and(~F.col("direct")).alias("all_indirect"))
    return cat.profiles.select("id").join(r, "id", "left").fillna(0, ["n_records"]).withColumn("all_indirect", F.coalesce("all_indirect", F.lit(False)))


_DISTRICTS = [("Alderby", 1500, 1700), ("Alderby", 1701, None), ("Morton", None, 1650), ("Braywell", 1600, 1800), ("Leedon", None, None)]


@query("J15_valid_districts", "SELECT record_id, d.k AS district_row FROM records r JOIN (VALUES ('Alderby', 1500, 1700, 0), ('Alderby', 1701, NULL, 1), ('Morton', NULL, 1650, 2), ('Braywell', 1600, 1800, 3), ('Leedon', NULL, NULL, 4)) d(place, year_from, year_to, k) ON r.district = d.place WHERE r.year IS NULL OR (coalesce(r.year >= d.year_from, true) AND coalesce(r.year <= d.year_to, true))")
def j15_valid(cat):
    dim = cat.spark.createDataFrame([(*d, k) for k, d in enumerate(_DISTRICTS)], "place string, year_from int, year_to int, k int")
    return relational.valid_at(cat.records.withColumn("place", F.col("district")), dim).select("record_id", F.col("k").alias("district_row"))


@query("J8_dangling_records", "SELECT record_id FROM records WHERE profile_id NOT IN (SELECT id FROM profiles)")
def j8_dangling(cat):
    return cat.records.join(cat.profiles.select(F.col("id").alias("profile_id")), "profile_id", "left_anti").select("record_id")


# --- graph ------------------------------------------------------------------------------------------------------


def recursive(body: str) -> str:
    """Carriers with a recursive table after them."""
    return oracle(body).replace("WITH profiles", "WITH RECURSIVE profiles", 1)


_ANC = ", walk AS (SELECT DISTINCT to_id AS id, from_id AS kin, 1 AS d FROM parents UNION SELECT w.id, e.from_id, w.d + 1 FROM walk w JOIN parents e ON e.to_id = w.kin WHERE w.d < {0}), anc AS (SELECT id, kin, min(d) AS distance FROM walk GROUP BY id, kin)"


@query("G2_ancestors")
def g2_ancestors(cat):
    return graph.closure(cat.parents, 6)


ORACLE["G2_ancestors"] = recursive(_ANC.format(6) + " SELECT id, kin, distance FROM anc")


@query("G2_descendants")
def g2_descendants(cat):
    return graph.closure(cat.parents, 4, up=False)


ORACLE["G2_descendants"] = recursive(_ANC.format(4) + " SELECT kin AS id, id AS kin, distance FROM anc")


@query("G5_components")
def g5_components(cat):
    return graph.component_sizes(graph.components(cat.profiles, cat.edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))))


# every label reaches every node of its component, so the set stays small only on the test tables
ORACLE["G5_components"] = recursive(
    ", both_ways AS (SELECT from_id AS a, to_id AS b FROM edges UNION SELECT to_id, from_id FROM edges), reach AS (SELECT id, id AS r FROM profiles UNION SELECT b.b, reach.r FROM reach JOIN both_ways b ON b.a = reach.id WHERE reach.r < b.b), "
    "low AS (SELECT id, min(r) AS component FROM reach GROUP BY id) SELECT component, count(*) AS n_people FROM low GROUP BY component"
)


@query("G6_kinship")
def g6_kinship(cat):
    pairs = cat.spouses.where("id < other").select(F.col("id").alias("a"), F.col("other").alias("b"))
    return graph.kinship(pairs, graph.closure(cat.parents, 5)).select("a", "b", "d1", "d2", "common_kin", "label")


ORACLE["G6_kinship"] = recursive(
    _ANC.format(5) + ", own AS (SELECT id, kin, distance FROM anc UNION ALL SELECT id, id, 0 FROM profiles), pairs AS (SELECT DISTINCT id AS a, other AS b FROM spouses WHERE id < other), "
    "best AS (SELECT a, b, x.kin AS common_kin, x.distance AS d1, y.distance AS d2, row_number() OVER (PARTITION BY a, b ORDER BY x.distance + y.distance, least(x.distance, y.distance) DESC, x.kin) AS r FROM pairs JOIN own x ON x.id = a JOIN own y ON y.id = b AND y.kin = x.kin) "
    "SELECT p.a, p.b, d1, d2, common_kin, CASE WHEN d1 IS NULL THEN 'none' WHEN d1 = 0 AND d2 = 0 THEN 'self' WHEN d2 = 0 AND d1 = 1 THEN 'parent' WHEN d2 = 0 THEN repeat('great-', d1 - 2) || 'grandparent' WHEN d1 = 0 AND d2 = 1 THEN 'child' WHEN d1 = 0 THEN repeat('great-', d2 - 2) || 'grandchild' WHEN d1 = 1 AND d2 = 1 THEN 'sibling' WHEN d2 = 1 THEN repeat('great-', d1 - 2) || 'uncle or aunt' WHEN d1 = 1 THEN repeat('great-', d2 - 2) || 'nephew or niece' ELSE (least(d1, d2) - 1) || ' cousin' || CASE WHEN d1 <> d2 THEN ' removed ' || abs(d1 - d2) ELSE '' END END AS label FROM pairs p LEFT JOIN best ON best.a = p.a AND best.b = p.b AND r = 1"
)


@query("G8_paths")
def g8_paths(cat):
    return graph.shortest_paths(12, cat.parents, cat.spouses, 6)


ORACLE["G8_paths"] = recursive(
    ", links AS (SELECT from_id AS a, to_id AS b FROM parents UNION SELECT to_id, from_id FROM parents UNION SELECT id, other FROM spouses), bfs AS (SELECT CAST(12 AS BIGINT) AS id, 0 AS h UNION SELECT l.b, bfs.h + 1 FROM bfs JOIN links l ON l.a = bfs.id WHERE bfs.h < 6), "
    "near AS (SELECT id, min(h) AS hops FROM bfs GROUP BY id) SELECT n.id, n.hops, (SELECT min(m.id) FROM near m JOIN links l ON l.a = m.id WHERE l.b = n.id AND m.hops = n.hops - 1) AS via FROM near n"
)


@query("G9_generations")
def g9_generations(cat):
    return graph.generational_distance(cat.profiles.where("id = 12").select("id"), cat.parents, cat.spouses, 3)


ORACLE["G9_generations"] = recursive(
    ", steps AS (SELECT from_id AS a, to_id AS b, 1 AS c FROM parents UNION SELECT to_id, from_id, 1 FROM parents UNION SELECT id, other, 0 FROM spouses), reach AS (SELECT CAST(12 AS BIGINT) AS id, 0 AS d UNION SELECT s.b, reach.d + s.c FROM reach JOIN steps s ON s.a = reach.id WHERE reach.d + s.c <= 3) "
    "SELECT id, min(d) AS distance FROM reach GROUP BY id"
)


@query("G1_siblings", "SELECT DISTINCT a.to_id AS id, b.to_id AS sib FROM parents a JOIN parents b ON a.from_id = b.from_id WHERE a.to_id <> b.to_id")
def g1_siblings(cat):
    return audit.siblings(cat)


@query("G12_pedigree")
def g12_pedigree(cat):
    return graph.pedigree(cat.profiles.select("id"), cat.parents, 4)


ORACLE["G12_pedigree"] = recursive(
    ", up AS (SELECT to_id AS id, role, min(from_id) AS p FROM parents GROUP BY to_id, role), ped AS (SELECT id AS root, CAST(1 AS BIGINT) AS slot, id FROM profiles UNION ALL SELECT root, 2 * slot + CASE WHEN role = 'mother' THEN 1 ELSE 0 END, up.p FROM ped JOIN up ON up.id = ped.id WHERE slot < 16) SELECT root, slot, id FROM ped"
)


@query("G13_families", """, pairs AS (SELECT DISTINCT least(id, other) AS a, greatest(id, other) AS b FROM spouses), shared AS (SELECT DISTINCT a, b, x.to_id FROM pairs JOIN parents x ON x.from_id = a JOIN parents y ON y.from_id = b AND x.to_id = y.to_id),
kids AS (SELECT DISTINCT from_id, to_id FROM parents)
SELECT 'couple' AS kind, p.a, p.b, (SELECT count(*) FROM shared s WHERE s.a = p.a AND s.b = p.b) AS n_children FROM pairs p
UNION ALL SELECT 'single', from_id, NULL, count(*) FROM kids k WHERE NOT EXISTS (SELECT 1 FROM shared s WHERE s.to_id = k.to_id AND k.from_id IN (s.a, s.b)) GROUP BY from_id
UNION ALL SELECT 'alone', id, NULL, 0 FROM people WHERE n_parents + n_children + n_spouses = 0""")
def g13_families(cat):
    return graph.families(cat.profiles, cat.parents, cat.spouses)


# --- evidence ---------------------------------------------------------------------------------------------------

_S = names.sql("upper(r.surname)", "upper(p.surname)", "scoring")
_M = names.sql("upper(r.surname)", "upper(p.married_surname)", "scoring")
_G = names.sql("upper(r.given)", "upper(p.given)", "scoring")
_SCORED = f"""scored AS (SELECT *, CASE WHEN name_gate = 'fail' OR date_gate = 'fail' THEN 'impossible' WHEN name_gate = 'pass' AND date_gate <> 'fail' AND geography_gate = 'pass' AND (bb IS NOT NULL OR db IS NOT NULL) THEN 'fact' ELSE 'lead' END AS verdict FROM (
  SELECT r.record_id, r.profile_id, r.record_type, r.year, r.volume, r.page, r.direct, p.bb, p.db,
    CASE WHEN r.surname IS NULL OR p.surname IS NULL OR p.given IS NULL THEN 'soft' WHEN greatest({_S}, CASE WHEN r.record_type IN ('death', 'burial', 'probate', 'census') THEN {_M} ELSE 0 END) < 0.7 THEN 'fail' WHEN ({_G}) >= 0.7 THEN 'pass' ELSE 'soft' END AS name_gate,
    CASE WHEN r.year IS NULL THEN 'skip' WHEN r.record_type = 'marriage' THEN CASE WHEN r.year < p.be + 14 OR r.year > p.dl + 1 THEN 'fail' ELSE 'pass' END
      WHEN r.record_type IN ('birth', 'parish') THEN CASE WHEN p.bb IS NULL THEN 'skip' WHEN abs(r.year - p.bb) <= CASE r.record_type WHEN 'birth' THEN 2 ELSE 3 END THEN 'pass' ELSE 'fail' END
      WHEN r.record_type = 'census' THEN CASE WHEN p.bb IS NULL OR r.age IS NULL THEN 'skip' WHEN abs(r.year - r.age - p.bb) <= 5 THEN 'pass' ELSE 'fail' END
      ELSE CASE WHEN p.db IS NULL THEN 'skip' WHEN abs(r.year - p.db) <= CASE r.record_type WHEN 'death' THEN 1 ELSE 2 END THEN 'pass' ELSE 'fail' END END AS date_gate,
    CASE WHEN r.district IN ('Alderby', 'Braywell', 'Morton') THEN 'pass' ELSE 'soft' END AS geography_gate
  FROM records r JOIN people p ON p.id = r.profile_id))"""


@query("E1_scored_records", f", {_SCORED} SELECT record_id, profile_id, name_gate, date_gate, geography_gate, verdict FROM scored")
def e1_scored(cat):
    return evidence.scored(cat.records, cat.dated).select("record_id", "profile_id", "name_gate", "date_gate", "geography_gate", "verdict")


@query("E2_exclusive_facts", f""", {_SCORED}, facts AS (SELECT *, CASE WHEN record_type IN ('birth', 'death', 'burial', 'probate') THEN record_type WHEN record_type = 'census' THEN 'census-' || CAST(year AS STRING) END AS slot, concat_ws('/', volume, page, CAST(year AS STRING)) AS key FROM scored WHERE verdict = 'fact'),
slots AS (SELECT profile_id, slot, count(DISTINCT key) AS n, count(DISTINCT CASE WHEN direct THEN key END) AS nd, min(CASE WHEN direct THEN key END) AS winner FROM facts WHERE slot IS NOT NULL GROUP BY 1, 2)
SELECT f.record_id, f.profile_id, f.slot, CASE WHEN n IS NULL OR n = 1 OR (nd = 1 AND key = winner) THEN 'fact' ELSE 'lead' END AS verdict FROM facts f LEFT JOIN slots s ON s.profile_id = f.profile_id AND s.slot = f.slot""")
def e2_exclusive(cat):
    return evidence.exclusive(evidence.scored(cat.records, cat.dated))


@query("E6_convergence", "SELECT *  EXCLUDE (d), CASE WHEN n_lineages >= 3 AND d THEN 'confirmed' WHEN n_lineages = 2 AND trust >= 4 AND d THEN 'probable' WHEN n_lineages >= 2 OR n_records >= 2 THEN 'possible' ELSE 'single' END AS level FROM (SELECT profile_id, record_type, year, count(*) AS n_records, count(DISTINCT lineage) AS n_lineages, CAST(sum(tier) AS BIGINT) AS trust, bool_or(direct) AS d FROM records WHERE year IS NOT NULL GROUP BY 1, 2, 3)")
def e6_convergence(cat):
    return evidence.convergence(cat.records)


@query("A17_birth_consensus", "SELECT profile_id, center AS birth_year, n, n_sources, CASE WHEN n >= 4 THEN 'high' ELSE 'low' END AS strength FROM (SELECT profile_id, center, count(*) AS n, count(DISTINCT source_id) AS n_sources, row_number() OVER (PARTITION BY profile_id ORDER BY count(*) DESC, center) AS r FROM (SELECT profile_id, source_id, CASE record_type WHEN 'birth' THEN year WHEN 'census' THEN year - age END + o AS center FROM records, (VALUES (-1), (0), (1)) v(o)) WHERE center IS NOT NULL GROUP BY 1, 2) WHERE r = 1 AND n >= 3 AND n_sources >= 2")
def a17_consensus(cat):
    return evidence.birth_consensus(cat.records)


@query("E10_disputes", """SELECT profile_id, record_type, max(n_years) AS n_years, CASE WHEN max(n_direct) = 1 THEN 'directness' WHEN max(n_top) = 1 THEN 'tier' ELSE 'open' END AS rung,
  CASE WHEN max(n_direct) = 1 THEN max(CASE WHEN direct = 1 THEN year END) WHEN max(n_top) = 1 THEN max(CASE WHEN tier = top THEN year END) END AS settled, max(year) - min(year) AS spread
FROM (SELECT *, sum(CAST(tier = top AS INT)) OVER (PARTITION BY profile_id, record_type) AS n_top FROM (SELECT *, count(*) OVER p AS n_years, sum(direct) OVER p AS n_direct, max(tier) OVER p AS top FROM (
  SELECT profile_id, record_type, year, max(CAST(direct AS INT)) AS direct, max(tier) AS tier FROM records WHERE year IS NOT NULL AND record_type IN ('birth', 'death', 'burial') GROUP BY 1, 2, 3) WINDOW p AS (PARTITION BY profile_id, record_type)))
WHERE n_years > 1 GROUP BY 1, 2""")
def e10_disputes(cat):
    return evidence.disputes(cat.records)


@query("E16_siblings", "SELECT a.record_id AS a, b.record_id AS b FROM records a JOIN records b ON upper(a.surname) = upper(b.surname) AND upper(a.mother_maiden) = upper(b.mother_maiden) AND a.record_id < b.record_id AND a.profile_id <> b.profile_id AND abs(a.year - b.year) <= 20 WHERE a.record_type = 'birth' AND b.record_type = 'birth'")
def e16_siblings(cat):
    return evidence.inferred_siblings(cat.records)


@query("J19_spouse_corroboration", ", m AS (SELECT DISTINCT profile_id, volume, page, year FROM records WHERE record_type = 'marriage' AND year IS NOT NULL) SELECT p.a, p.b, min(x.page) AS page FROM (SELECT DISTINCT id AS a, other AS b FROM spouses WHERE id < other) p JOIN m x ON x.profile_id = p.a JOIN m y ON y.profile_id = p.b AND x.volume = y.volume AND x.page = y.page AND abs(x.year - y.year) <= 30 GROUP BY 1, 2 HAVING count(*) = 1")
def j19_spouses(cat):
    return evidence.spouse_corroboration(cat.records, cat.spouses)


@query("A19_attrition", f", {_SCORED} SELECT verdict, gate, outcome, count(*) AS n FROM (SELECT verdict, 'name' AS gate, name_gate AS outcome FROM scored UNION ALL SELECT verdict, 'date', date_gate FROM scored UNION ALL SELECT verdict, 'geography', geography_gate FROM scored) GROUP BY 1, 2, 3")
def a19_attrition(cat):
    return evidence.attrition(evidence.scored(cat.records, cat.dated))


@query("J24_diff", "SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'inserted' WHEN b.id IS NULL THEN 'removed' WHEN a.birth_raw IS NOT DISTINCT FROM b.birth_raw THEN 'unchanged' ELSE 'updated' END AS change FROM (SELECT id, birth_raw FROM profiles WHERE id % 5 <> 1) a FULL JOIN (SELECT id, CASE WHEN id % 4 = 0 THEN given ELSE birth_raw END AS birth_raw FROM profiles WHERE id % 7 <> 2) b ON a.id = b.id")
def j24_diff(cat):
    old = cat.profiles.where("id % 5 <> 1")
    new = cat.profiles.where("id % 7 <> 2").withColumn("birth_raw", F.expr("CASE WHEN id % 4 = 0 THEN given ELSE birth_raw END"))
    return corpus.refresh(old, new, "id", "birth_raw")


@query("J13_duplicate_pairs", f"SELECT a, b, CAST(score AS DOUBLE) AS score FROM ({_DUP})")
def j13_pairs(cat):
    """All pairs of like people."""
    return duplicates.pairs(cat.dated, cat.parents)


@query("J13_duplicate_classes", f"SELECT least(ca, cb) AS a, greatest(ca, cb) AS b, CAST(max(score) AS DOUBLE) AS score, count(*) AS n_pairs FROM ({_DUP}) GROUP BY 1, 2")
def j13_classes(cat):
    """Pairs of classes of like people; J13_duplicate_members has the people."""
    return duplicates.counted(cat.dated, cat.parents)


@query("J13_duplicate_members", f"SELECT id, min(id) OVER (PARTITION BY surname, given, be, bl) AS c FROM ({_PERSON}) WHERE surname <> ''")
def j13_members(cat):
    return duplicates.members(cat.dated)


@query("J13_duplicate_apart", f"SELECT a, b FROM ({_DUP.replace('NOT EXISTS', 'EXISTS')})")
def j13_apart(cat):
    """The people that J13_duplicate_classes leaves out of its counts: with it and J13_duplicate_members, each pair of people follows."""
    return duplicates.parted(cat.dated, cat.parents)


# --- corpus -----------------------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in corpus.STOPWORDS)
_TOKENS = f"""SELECT page, t AS surname FROM (SELECT doc_id AS page, upper(regexp_replace(regexp_replace(w, '''[sS]$', ''), '''+$', '')) AS t FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z'']{{2,}}')) AS w FROM documents) WHERE regexp_matches(w, '^[A-Z]')) WHERE length(t) >= 3 AND t NOT IN ({_STOP})"""


@query("A26_surname_counts", f"SELECT page, surname, count(*) AS n FROM ({_TOKENS}) GROUP BY 1, 2", carriers=False)
def a26_surnames(cat):
    return corpus.counts(cat.table("documents"), corpus.surname_tokens(F.col("text")), "surname")


@query("A26_year_counts", r"SELECT doc_id AS page, y AS year, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b(1[5-9][0-9][0-9])\b', 1)) AS y FROM documents) GROUP BY 1, 2", carriers=False)
def a26_years(cat):
    return corpus.counts(cat.table("documents"), corpus.year_tokens(F.col("text")), "year")


@query("J6_corpus_search", rf"""SELECT s.page, s.sc * 3 + 2 * coalesce(y.yc, 0) + (regexp_matches(lower(d.text), '\bdas\b')::BIGINT + regexp_matches(lower(d.text), '\bune\b')::BIGINT) AS score
FROM (SELECT page, count(*) AS sc FROM ({_TOKENS}) WHERE surname = 'ERINER' GROUP BY page) s JOIN documents d ON d.doc_id = s.page
LEFT JOIN (SELECT doc_id, count(DISTINCT y) AS yc FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b(1[5-9][0-9][0-9])\b', 1)) AS y FROM documents) WHERE y IN ('1837', '1911') GROUP BY doc_id) y ON y.doc_id = s.page
ORDER BY score DESC, page LIMIT 25""", carriers=False)
def j6_search(cat):
    found = corpus.retrieve(cat.table("documents"), "ERINER", ["1837", "1911"], ["das", "une"])
    return found.orderBy(F.desc("score"), "page").limit(25)


@query("F13_plain_text", r"SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages", carriers=False)
def f13_plain(cat):
    return cat.table("pages").select("page_id", corpus.plain_text(F.col("html")).alias("text"))


@query("S13_links", """SELECT page_id, count(*) AS n_links, count(DISTINCT href) AS n_targets FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages) GROUP BY page_id""", carriers=False)
def s13_links(cat):
    links = cat.table("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"), F.count_distinct("href").alias("n_targets"))


# --- formats ----------------------------------------------------------------------------------------------------


@query("K1_S3_gedcom_round_trip", "SELECT id, coalesce(given, '') AS given, coalesce(surname, '') AS surname, birth_raw FROM profiles")
def gedcom_round_trip(cat):
    return gedcom.read(gedcom.write(cat.profiles))


from . import deciding_queries, listing_queries, review_queries, tree_queries  # noqa: E402, F401  (register their queries here)
