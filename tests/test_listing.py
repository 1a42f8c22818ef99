"""Listing operators on small hand-made tables with nulls, ties and blanks."""

from pyspark.sql import functions as F

from hearthgraph.operators import listing


def test_orders_and_pages(spark):
    d = spark.createDataFrame([(1, None), (2, 1900), (3, 1850), (4, 1850)], "id long, year int")
    assert [r.id for r in listing.chronological(d, "year", "id").collect()] == [3, 4, 2, 1]
    assert [r.id for r in listing.page_of(d, F.col("year") < 1900, [F.desc("id")], 0).collect()] == [4]
    assert listing.page_of(d, F.lit(True), [F.asc("id")], 9, most=3).count() == 3


def test_search_and_frequent_values(spark):
    d = spark.createDataFrame([(1, "Maynard", None), (2, None, "x may"), (3, None, None), (4, "%", " ")], "id long, a string, b string")
    hits = lambda needle: sorted(r.id for r in listing.search({"k": (d, "id", ["a", "b"])}, needle).collect())
    assert hits("MAY") == ["1", "2"] and hits("%") == ["4"] and hits("  ") == []
    v = spark.createDataFrame([("b",), ("a",), (None,), (" ",), ("c",), ("c",)], "v string")
    assert [tuple(r) for r in listing.most_frequent(v, "v", 2).collect()] == [("c", 2), ("a", 1)]


def test_searches_in_vain(spark):
    a = spark.createDataFrame([(1, True, 0), (1, True, 0), (2, True, 1), (3, False, 0), (4, None, 0), (5, True, 0)], "k long, clean boolean, found int")
    assert [r.k for r in listing.searched_in_vain(a, a.where("k = 5"), ["k"]).collect()] == [1]
    assert listing.searched_in_vain(a.limit(0), a, ["k"]).count() == 0


def test_ids_and_quarters(spark):
    d = spark.createDataFrame([("Ann O'Lee ", "birth", 1880), ("?", "x", 0), (None, "x", 1)], "n string, c string, y int")
    assert [r[0] for r in d.select(listing.lead_id(F.col("n"), F.col("c"), F.col("y"))).collect()] == ["lead_ann_o_lee_birth_1880", "lead__x_unknown", None]
    assert [r[0] for r in spark.range(14).select(listing.quarter_of(F.col("id"))).collect()] == [None, *["Mar"] * 3, *["Jun"] * 3, *["Sep"] * 3, *["Dec"] * 3, None]
