"""Review operators on small hand-made tables."""

from pyspark.sql import functions as F

from hearthgraph.operators import review


def test_merges_of_tables(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (4, None), (1, None)], "k long, v string")
    assert {r.k: r.v for r in review.upsert(old, new, "k").collect()} == {1: "a", 2: "c", 3: "d", 4: None}
    assert {r.k: r.v for r in review.insert_missing(old, new, "k").collect()} == {1: "a", 2: "b", 3: None, 4: None}
    assert {r.k: r.action for r in review.reconcile(new, old, "k").collect()} == {1: "update", 2: "update", 3: "update", 4: "insert"}
    assert {r.k: r.action for r in review.reconcile(old.where("k = 1"), old, "k").collect()} == {1: "skip", 2: "delete", 3: "delete"}


def test_windows_arrive_in_any_order(spark):
    reports = spark.createDataFrame([("s", "2024-01-02", 3, 9), ("s", "2024-01-01", 50, 1), ("s", "2024-01-02", 2, 4), ("t", "2024-01-01", 1, 1)], "source string, day string, n long, started long")
    assert {r.source: (r.day, r.n, r.started) for r in review.merged_windows(reports).collect()} == {"s": ("2024-01-02", 3, 4), "t": ("2024-01-01", 1, 1)}


def test_last_day_still_suppresses(spark):
    d = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP_NTZ '2024-01-01 00:00:00'), (2, TIMESTAMP_NTZ '2023-12-31 23:59:59') t(u, ts)")
    assert {r.u: r.suppress for r in review.suppressed(d, ["u"], F.expr("TIMESTAMP_NTZ '2024-03-31 00:00:00'")).collect()} == {1: True, 2: False}


def test_votes_are_capped(spark):
    r = spark.createDataFrame([(1, "birth", "D"), (1, "marriage", "D"), (2, "birth", "E"), (3, "birth", None)], "profile_id long, record_type string, district string")
    p = spark.createDataFrame([(9, 1, None), (9, 2, None)], "from_id long, to_id long, role string")
    s = spark.createDataFrame([(1, 3, None), (3, 1, None)], "id long, other long, year int")
    got = {(x.id, x.district): x.score for x in review.district_votes(r, p, s).collect()}
    assert got == {(1, "D"): 1.0, (2, "E"): 1.0, (1, "E"): 0.65, (2, "D"): 0.65, (9, "D"): 0.55, (9, "E"): 0.55, (3, "D"): 0.35}


def test_narrower_and_score(spark):
    d = spark.createDataFrame([(1800, 1810, 1805, 1806), (1800, None, 1800, 1900), (1800, 1800, 1800, 1800), (1800, 1801, None, 1801)], "a int, b int, c int, d int")
    assert [r[0] for r in d.select(review.narrower(*[F.col(c) for c in "abcd"])).collect()] == ["write", "write", "keep", "keep"]
    assert [r[0] for r in spark.range(8).select(review.convergence_score(F.col("id"))).collect()] == [0.0, 0.5, 0.75, 0.9, 0.93, 0.96, 0.99, 1.0]


def test_different_rows_have_different_checksums(spark):
    kind = "k long, v string, w string"
    a = spark.createDataFrame([(1, "a|b", "c"), (2, None, "x"), (3, "-", None)], kind)
    b = spark.createDataFrame([(1, "a", "b|c"), (2, "-", "x"), (3, "-", None)], kind)
    assert {r.k: r.action for r in review.reconcile(a, b, "k").collect()} == {1: "update", 2: "update", 3: "skip"}
