"""Queries of the review operators and their SQL; registered with the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import review
from .queries import query

_V = review.VOTES


@query("A18_district_votes", f""", b AS (SELECT profile_id AS kin, district FROM records WHERE record_type = 'birth' AND district IS NOT NULL), m AS (SELECT profile_id AS kin, district FROM records WHERE record_type = 'marriage' AND district IS NOT NULL),
up AS (SELECT DISTINCT to_id AS id, from_id AS kin FROM parents)
SELECT id, district, least(sum(v), 100) / 100.0::DOUBLE AS score FROM (SELECT kin AS id, district, {_V['own']} AS v FROM b UNION ALL SELECT kin, district, {_V['marriage']} FROM m
UNION ALL SELECT s.id, district, {_V['sibling']} FROM (SELECT DISTINCT x.id, y.id AS kin FROM up x JOIN up y ON x.kin = y.kin AND x.id <> y.id) s JOIN b USING (kin)
UNION ALL SELECT up.kin, district, {_V['child']} FROM up JOIN b ON b.kin = up.id UNION ALL SELECT up.id, district, {_V['parents']} FROM up JOIN m USING (kin)
UNION ALL SELECT s.id, district, {_V['spouse']} FROM (SELECT DISTINCT id, other AS kin FROM spouses) s JOIN b USING (kin)) GROUP BY 1, 2""")
def a18_votes(cat):
    return review.district_votes(cat.records, cat.parents, cat.spouses)


@query("A21_modal_surnames", "SELECT profile_id, string_agg(surname, ',' ORDER BY surname) AS modal, bool_or(surname IN ('Brandle', 'Holmden', 'Slatter')) AS is_common FROM (SELECT profile_id, surname, count(*) AS n, max(count(*)) OVER (PARTITION BY profile_id) AS top FROM records WHERE surname IS NOT NULL GROUP BY 1, 2) WHERE n = top GROUP BY 1")
def a21_modal(cat):
    return review.modal_surnames(cat.records, ("Brandle", "Holmden", "Slatter"))


@query("A4_record_groups", "SELECT profile_id, count(*) AS n, sum(direct::INT)::BIGINT AS n_direct, CASE WHEN count(*) = 1 THEN max(source_id) END AS only_source, string_agg(DISTINCT record_type, ',' ORDER BY record_type) AS kinds FROM records GROUP BY 1")
def a4_groups(cat):
    g = cat.records.groupBy("profile_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("direct").cast("long")).alias("n_direct"), F.max("source_id").alias("s"), F.array_join(F.array_sort(F.collect_set("record_type")), ",").alias("kinds"))
    return g.select("profile_id", "n", "n_direct", F.when(F.col("n") == 1, F.col("s")).alias("only_source"), "kinds")


@query("E8_sourcing_strength", "SELECT profile_id, record_type, count(*) AS n, count(DISTINCT source_id) AS n_sources, max(tier) AS tier FROM records GROUP BY 1, 2")
def e8_strength(cat):
    return cat.records.groupBy("profile_id", "record_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_id").alias("n_sources"), F.max("tier").alias("tier"))


@query("W4_strict_winners", "SELECT profile_id, record_type, min(record_id) AS record_id FROM (SELECT *, count(*) OVER p AS n, max(tier) OVER p AS top FROM records WINDOW p AS (PARTITION BY profile_id, record_type)) WHERE n > 1 AND tier = top GROUP BY 1, 2 HAVING count(*) = 1")
def w4_winners(cat):
    return review.strict_winners(cat.records)


@query("W6_first_seen", "SELECT user_id, string_agg(event_type, ',' ORDER BY pos) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS pos FROM events GROUP BY 1, 2) GROUP BY 1", carriers=False)
def w6_first_seen(cat):
    return review.first_seen(cat.table("events"))


@query("J17_registrations", """SELECT *, CASE WHEN n_grooms = 0 OR n_brides = 0 THEN 'none' WHEN n_grooms = 1 AND n_brides = 1 THEN 'unique' ELSE 'ambiguous' END AS status FROM (
SELECT r.year, upper(volume) AS volume, upper(page) AS page, count(DISTINCT CASE WHEN gender = 'male' THEN profile_id END) AS n_grooms, count(DISTINCT CASE WHEN gender = 'female' THEN profile_id END) AS n_brides
FROM records r JOIN profiles p ON p.id = r.profile_id WHERE record_type = 'marriage' AND r.year IS NOT NULL GROUP BY 1, 2, 3)""")
def j17_registrations(cat):
    return review.registration_matches(cat.records, cat.profiles)


@query("J20_fetch_list", ", k AS (SELECT DISTINCT profile_id AS id, volume, page, year FROM records WHERE record_type = 'marriage' AND year IS NOT NULL) SELECT s.id, volume, page, k.year FROM spouses s JOIN k ON k.id = s.other EXCEPT SELECT id, volume, page, year FROM k")
def j20_fetch(cat):
    return review.fetch_list(cat.records, cat.spouses)


@query("J10_latest_event", "SELECT id, (SELECT max(year) FROM life WHERE profile_id = p.id) AS latest FROM profiles p")
def j10_latest(cat):
    return cat.profiles.select("id").join(cat.life.groupBy(F.col("profile_id").alias("id")).agg(F.max("year").alias("latest")), "id", "left")


@query("J9_without_events", "SELECT id FROM profiles p WHERE NOT EXISTS (SELECT 1 FROM life WHERE profile_id = p.id AND kind = 'military')")
def j9_without(cat):
    return cat.profiles.select("id").join(cat.life.where("kind = 'military'").select(F.col("profile_id").alias("id")), "id", "left_anti")


@query("R3_name_consensus", "SELECT profile_id, given, n, first_year, last_year FROM (SELECT *, sum(n) OVER (PARTITION BY profile_id) AS total, lead(n) OVER w AS second, row_number() OVER w AS r FROM (SELECT profile_id, given, count(*) AS n, min(year) AS first_year, max(year) AS last_year FROM records WHERE given IS NOT NULL GROUP BY 1, 2) WINDOW w AS (PARTITION BY profile_id ORDER BY n DESC, given)) WHERE r = 1 AND total >= 5 AND n >= 0.7 * total AND coalesce(second, 0) <= 0.2 * total")
def r3_consensus(cat):
    return review.name_consensus(cat.records)


@query("P8_firewall", f"SELECT record_id, {review.FIREWALL} AS reason FROM (SELECT r.*, p.be, p.dl FROM records r JOIN people p ON p.id = r.profile_id)")
def p8_firewall(cat):
    p = cat.dated.select(F.col("id").alias("profile_id"), "be", "dl")
    return cat.records.join(p, "profile_id").select("record_id", F.expr(review.FIREWALL).alias("reason"))


_FIELDS = ("given", "surname", "birth_raw", "death_raw", "birth_place")


@query("P6_coverage", ", s AS (SELECT p.*, EXISTS (SELECT 1 FROM records r WHERE r.profile_id = p.id AND direct) AS s FROM profiles p) SELECT *, CAST(round(100.0 * n_sourced / n_valued) AS BIGINT) AS percent FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS n_valued, sum(s::INT)::BIGINT AS n_sourced FROM s WHERE {c} IS NOT NULL" for c in _FIELDS) + ")")
def p6_coverage(cat):
    some = cat.records.where("direct").select(F.col("profile_id").alias("id"), F.lit(True).alias("s")).distinct()
    return review.coverage(cat.profiles.join(some, "id", "left"), F.coalesce("s", F.lit(False)), _FIELDS)


@query("E24_narrower_date", "SELECT from_id, to_id, CASE WHEN b.bl - b.be IS NOT NULL AND (a.bl - a.be IS NULL OR b.bl - b.be < a.bl - a.be) THEN 'write' ELSE 'keep' END AS action FROM edges e JOIN people a ON e.from_id = a.id JOIN people b ON e.to_id = b.id WHERE e.type = 'spouse'")
def e24_narrower(cat):
    a, b = (cat.dated.select(F.col("id").alias(k), F.col("be").alias(f"{k}e"), F.col("bl").alias(f"{k}l")) for k in ("from_id", "to_id"))
    x = cat.edges.where("type = 'spouse'").join(a, "from_id").join(b, "to_id")
    return x.select("from_id", "to_id", review.narrower(*[F.col(c) for c in ("from_ide", "from_idl", "to_ide", "to_idl")]).alias("action"))


@query("F25_convergence_score", "SELECT profile_id, CASE n WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.75 ELSE round(least(1.0, 0.9::DOUBLE + 0.03::DOUBLE * (n - 3)), 4) END::DOUBLE AS score FROM (SELECT profile_id, count(DISTINCT lineage) AS n FROM records GROUP BY 1)")
def f25_score(cat):
    n = cat.records.groupBy("profile_id").agg(F.count_distinct("lineage").alias("n"))
    return n.select("profile_id", review.convergence_score(F.col("n")).alias("score"))


@query("F11_birth_from_age", "SELECT record_id, year - age - 1 AS earliest, year - age AS latest FROM records WHERE age IS NOT NULL AND year IS NOT NULL")
def f11_birth(cat):
    return cat.records.where("age IS NOT NULL AND year IS NOT NULL").select("record_id", F.expr("year - age - 1").alias("earliest"), F.expr("year - age").alias("latest"))


_FIRST = r"TRY_CAST(regexp_extract(coalesce(text, ''), '\b([0-9]{4})\b', 1) AS INT)"


@query("F3_years", rf"SELECT doc_id, CASE WHEN {_FIRST} BETWEEN 1000 AND 2100 THEN {_FIRST} END AS strict_year, TRY_CAST(regexp_extract(coalesce(text, ''), '(1[0-9][0-9][0-9]|20[0-2][0-9])', 1) AS INT) AS loose_year FROM documents", carriers=False)
def f3_years(cat):
    number = lambda pattern: F.nullif(F.regexp_extract(F.coalesce("text", F.lit("")), pattern, 1), F.lit("")).cast("int")
    first = number("\\b([0-9]{4})\\b")
    return cat.table("documents").select("doc_id", F.when(first.between(1000, 2100), first).alias("strict_year"), number("(1[0-9][0-9][0-9]|20[0-2][0-9])").alias("loose_year"))


_FEED = {"birth": "SELECT id, bb AS year FROM people", "marriage": "SELECT id, year FROM spouses", "event": "SELECT profile_id AS id, year FROM life"}


@query("U1_recent_feed", " UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS kind, id, year FROM ({q}) WHERE year IS NOT NULL ORDER BY year DESC, id LIMIT 50)" for k, q in _FEED.items()))
def u1_feed(cat):
    return review.recent({"birth": cat.dated.select("id", F.col("bb").alias("year")), "marriage": cat.spouses.select("id", "year"), "event": cat.life.select(F.col("profile_id").alias("id"), "year")}, 50)


@query("U5_focus_and_kin", ", f AS (SELECT id FROM profiles WHERE surname = 'Slatter') SELECT id FROM f UNION SELECT from_id FROM parents WHERE to_id IN (FROM f) UNION SELECT to_id FROM parents WHERE from_id IN (FROM f) UNION SELECT other FROM spouses WHERE id IN (FROM f)")
def u5_kin(cat):
    return review.with_kin(cat.profiles.where("surname = 'Slatter'"), cat.parents, cat.spouses)


@query("G14_children_of_couples", "SELECT DISTINCT s.id AS a, s.other AS b, x.to_id AS child FROM spouses s JOIN parents x ON x.from_id = s.id JOIN parents y ON y.from_id = s.other AND y.to_id = x.to_id WHERE s.id < s.other")
def g14_children(cat):
    kids = cat.parents.select("from_id", F.col("to_id").alias("child")).distinct()
    pairs = cat.spouses.where("id < other").select(F.col("id").alias("a"), F.col("other").alias("b")).distinct()
    return pairs.join(kids.withColumnRenamed("from_id", "a"), "a").join(kids.withColumnRenamed("from_id", "b"), ["b", "child"]).select("a", "b", "child")


def _versions(cat):
    old = cat.profiles.where("id % 5 <> 1").select("id", "given", "birth_raw")
    return old, cat.profiles.where("id % 7 <> 2").select("id", "given", F.expr("CASE WHEN id % 4 = 0 THEN given ELSE birth_raw END").alias("birth_raw"))


_OLD_NEW = ", o AS (SELECT id, given, birth_raw FROM profiles WHERE id % 5 <> 1), n AS (SELECT id, given, CASE WHEN id % 4 = 0 THEN given ELSE birth_raw END AS birth_raw FROM profiles WHERE id % 7 <> 2) "


@query("K4_upsert", _OLD_NEW + "SELECT id, coalesce(n.given, o.given) AS given, coalesce(n.birth_raw, o.birth_raw) AS birth_raw FROM o FULL JOIN n USING (id)")
def k4_upsert(cat):
    return review.upsert(*_versions(cat), "id")


@query("K5_insert_missing", _OLD_NEW + "SELECT * FROM o UNION ALL SELECT * FROM n WHERE id NOT IN (SELECT id FROM o)")
def k5_insert(cat):
    return review.insert_missing(*_versions(cat), "id")


@query("K6_cascade", ", d AS (SELECT id FROM profiles WHERE birth_raw IS NULL) SELECT type, from_id, to_id FROM edges WHERE from_id NOT IN (FROM d) AND to_id NOT IN (FROM d)")
def k6_cascade(cat):
    return review.cascade(cat.edges, cat.profiles.where("birth_raw IS NULL"), ("from_id", "to_id")).select("type", "from_id", "to_id")


_MARK = "sha256(coalesce(length(given) || ':' || given, '-') || coalesce(length(birth_raw) || ':' || birth_raw, '-'))"


@query("K7_reconcile", _OLD_NEW + f"SELECT id, CASE WHEN b.c IS NULL THEN 'insert' WHEN a.c IS NULL THEN 'delete' WHEN a.c = b.c THEN 'skip' ELSE 'update' END AS action, a.c AS checksum FROM (SELECT id, {_MARK} AS c FROM n) a FULL JOIN (SELECT id, {_MARK} AS c FROM o) b USING (id)")
def k7_reconcile(cat):
    old, new = _versions(cat)
    return review.reconcile(new, old, "id")


@query("Z2_merged_windows", "SELECT source, day, n, started FROM (SELECT source, day, max(n) AS n, min(started) AS started, row_number() OVER (PARTITION BY source ORDER BY day DESC) AS r FROM (SELECT event_type AS source, strftime(ts, '%Y-%m-%d') AS day, user_id % 3 AS reporter, count(*) AS n, min(event_id) AS started FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2) WHERE r = 1", carriers=False)
def z2_merged(cat):
    reports = cat.table("events").groupBy(F.col("event_type").alias("source"), F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("user_id") % 3).alias("reporter")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("started"))
    return review.merged_windows(reports)


@query("Z3_suppressed", "SELECT user_id, event_type, max(ts) + INTERVAL 90 DAY >= TIMESTAMP '2024-04-20 00:00:00' AS suppress FROM events GROUP BY 1, 2", carriers=False)
def z3_suppressed(cat):
    return review.suppressed(cat.table("events"), ["user_id", "event_type"], F.expr("TIMESTAMP_NTZ '2024-04-20 00:00:00'"))
