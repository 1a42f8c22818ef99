"""Deciding operators on small hand-made tables with nulls, ties and edges of the bands."""

from pyspark.sql import functions as F

from hearthgraph.operators import deciding


def test_severity_by_source_tier_and_level(spark):
    cases = [
        ("cwgc", 3, None, 0, "possible", "none"), ("CWGC", 3, None, 1, None, "correction"), ("freebmd", 1, "birth", 2, None, "refinement"), ("freebmd", 1, "death", 2, None, "conflict"),
        ("freecen", 1, None, 3, None, "refinement"), ("Find a Grave", 1, None, 2, "probable", "conflict"), ("x", 1, None, 3, "probable", "correction"), (None, 2, None, 3, "possible", "refinement"),
        ("x", 3, None, 0, "confirmed", "correction"), ("x", None, None, 1, "confirmed", None), ("x", 1, None, None, "confirmed", None),
    ]
    d = spark.createDataFrame(cases, "s string, t int, k string, d int, l string, want string")
    got = d.select(deciding.severity(*[F.col(c) for c in "stkdl"]).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_orders_and_policies(spark):
    d = spark.createDataFrame([(1, "info"), (2, None), (3, "error"), (4, "warning"), (5, "error")], "id long, s string")
    assert [r.id for r in deciding.ranked(d, "s", ("error", "warning"), "id").collect()] == [3, 5, 4, 1, 2]
    p = spark.createDataFrame([("omit", False), ("auto", False), ("auto", None), (None, True), (None, False)], "c string, l boolean")
    assert [r[0] for r in p.select(deciding.policy(F.col("c"), F.col("l"))).collect()] == ["omit", "full", "nameOnly", "nameOnly", "full"]


def test_narrowest_decision_wins(spark):
    asked = spark.createDataFrame([(1, "a", "f"), (2, "a", "g"), (3, "b", "f"), (4, None, "f"), (5, "a", None)], "n long, text string, field string")
    made = spark.createDataFrame([(9, "a", None, "wide9"), (2, "a", None, "wide2"), (5, "a", "f", "narrow"), (6, None, "f", "none")], "id long, text string, field string, place string")
    assert {r.n: r.place for r in deciding.narrowest(asked, made).collect()} == {1: "narrow", 2: "wide2", 3: None, 4: None, 5: "wide2"}
    assert deciding.narrowest(asked, made.limit(0)).where("place IS NULL").count() == 5


def test_leads_match_by_derived_id_and_profile(spark):
    e = spark.createDataFrame([(1, 7), (2, 7), (None, 7)], "source_record_id long, profile_id long")
    leads = spark.createDataFrame([("lead_1", 7, "open"), ("lead_2", 8, "open")], "id string, profile_id long, status string")
    assert sorted((r.source_record_id or 0, r.lead_status, r.has_lead) for r in deciding.with_leads(e, leads).collect()) == [(0, None, False), (1, "open", True), (2, None, False)]
    assert [r.source_record_id for r in deciding.with_leads(e, leads, inner=True).collect()] == [1]


def test_hours_dates_and_names(spark):
    t = spark.sql("SELECT * FROM VALUES (timestamp'2020-01-01 00:00', timestamp'2020-01-01 01:30'), (timestamp'2020-01-01 00:00', NULL), (timestamp'2020-01-02 00:00', timestamp'2020-01-01 00:00') AS t(a, b)")
    now = F.lit("2020-01-01 02:00").cast("timestamp")
    assert deciding.hours(t, "a", "b", now).first().hours == 3.5
    assert deciding.hours(t.limit(0), "a", "b", now).first().hours == 0
    raw = ["14/07/1918", "1/13/1900", "1900", "", None, "99999999999/01/1900"]
    d = spark.createDataFrame([(k, x) for k, x in enumerate(raw)], "k int, x string")
    assert [r[0] for r in d.orderBy("k").select(deciding.written_date(F.col("x"))).collect()] == ["14 July 1918", "1/13/1900", "1900", None, None, "99999999999/01/1900"]
    n = spark.createDataFrame([(k, "x" * k + " \n") for k in (99, 100, 499, 500)] + [(0, None)], "k int, x string")
    assert [r.k for r in n.where(deciding.long_name(F.col("x"))).collect()] == [100, 499]


def test_birth_from_death(spark):
    people = spark.createDataFrame([(1, None, 1900, "Mar"), (2, None, 1900, None), (3, 1850, 1900, None), (4, None, None, None), (5, None, 1900, None)], "id long, birth_year int, death_year int, quarter string")
    deaths = spark.createDataFrame([
        (10, 1, 1900, " mar", 50), (11, 1, 1900, None, 20), (12, 1, 1902, "Mar", 50), (20, 2, 1901, "Jun", 50), (21, 2, 1899, None, 50), (22, 2, 1899, None, 50), (23, 2, 1900, None, 121), (30, 3, 1900, None, 1),
        (50, 5, 1900, None, 50), (51, 5, 1900, None, 47), (52, None, 1900, None, 5),
    ], "record_id long, profile_id long, year int, quarter string, age int")
    assert sorted(tuple(r) for r in deciding.birth_from_death(people, deaths).collect()) == [(1, 1850, 10), (2, 1849, 21)]


def test_queues_and_marks(spark):
    q = spark.createDataFrame([("a", 2, 1), ("a", 1, 9), ("a", 1, 3), (None, 5, 4)], "q string, at int, id long")
    assert {r.q: r.id for r in deciding.oldest_queued(q, "q", "at", "id").collect()} == {"a": 3, None: 4}
    assert deciding.newer(q, "at", F.lit(1)).count() == 2 and deciding.newer(q, "at", None).count() == 4
