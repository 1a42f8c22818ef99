"""Households on small hand-made tables: each rung, ties, nulls and empty tables."""

from pyspark.sql import functions as F

from hearthgraph.functions import names
from hearthgraph.operators import households

ROSTER = "event long, n int, subject_id long, year int, name string, role string, age int, birth_year int, sex string, target boolean"
PEOPLE = "id long, given string, surname string, married_surname string, bb int, gender string"
PEOPLE_ROWS = [
    (1, "Tobin", "Holmden", None, 1840, "male"), (2, "Una", "Doxam", "Holmden", 1842, "female"), (3, "Sam", "Holmden", None, 1866, "male"), (4, "Ida", "Holmden", None, None, "female"),
    (5, "William Ash", "Holmden", None, 1871, "male"), (6, "Old", "Holmden", None, 1810, "male"), (7, "Edith", "Doxam", None, 1815, "female"), (8, "Rhoda", "Holmden", None, 1874, "female"), (9, "Rhoda", "Holmden", None, 1875, None), (10, None, None, None, 1880, None),
]
PARENTS = [(1, 3), (1, 4), (1, 5), (6, 1), (7, 2), (2, 3)]


def tables(spark, rows, spouses=((1, 2), (2, 1))):
    return (
        spark.createDataFrame(rows, ROSTER), spark.createDataFrame(PEOPLE_ROWS, PEOPLE), spark.createDataFrame([(a, b, "x") for a, b in PARENTS], "from_id long, to_id long, role string"),
        spark.createDataFrame(list(spouses), "id long, other long"),
    )


def test_each_rung(spark):
    rows = [
        (10, 1, 1, 1881, "Tobin Holmden", "Head", 41, None, "M", True), (10, 2, 1, 1881, "Una HOLMDEN", "Wife", 60, None, "F", False), (10, 3, 1, 1881, "Samuel Holmden", "Son", 15, None, "M", False),
        (10, 4, 1, 1881, "Ida Holmden", "Dau", 12, None, "F", False), (10, 5, 1, 1881, "Wilfred Holmden", "son", 10, None, None, False), (10, 6, 1, 1881, "Old Holmden", "Brother", None, 1811, "M", False),
        (10, 7, 1, 1881, "Edith Doxam", "Mother-in-Law", 66, None, "F", False), (10, 8, 1, 1881, "Rhoda Holmden", "daughter", 6, None, "F", False), (10, 9, 1, 1881, "New Holmden", "Daur", 1, None, "F", False),
        (10, 10, 1, 1881, "Gus Moss", "Grandson", 3, None, "M", False), (10, 11, 1, 1881, "", "Son", 3, None, "M", False), (10, 12, 1, 1881, "Jo Doxam", "Father in law", None, None, None, False), (10, 13, 1, 1881, None, None, None, None, None, False),
    ]
    got = {r.n: (r.relation, r.status, r.profile_id) for r in households.reconcile(*tables(spark, rows)).collect()}
    assert got == {
        1: (None, "subject", 1), 2: ("spouse", "in_tree", 2), 3: ("child", "in_tree", 3), 4: ("child", "in_tree", 4), 5: ("child", "near", 5), 6: ("sibling", "contradiction", 6), 7: (None, "in_tree", 7),
        8: ("child", "unlinked", 8), 9: ("child", "missing", None), 10: (None, "out_of_scope", None), 11: (None, "out_of_scope", None), 12: (None, "in_law", 2), 13: (None, "out_of_scope", None),
    }


def test_findings_and_maiden_names(spark):
    rows = [
        (10, 1, 1, 1881, "Tobin Holmden", "Head", 41, None, "M", True), (10, 2, 1, 1881, "New Holmden", "Daur", 1, None, "F", False), (10, 3, 1, 1881, "Jo Wickstead", "Mother in law", None, None, None, False),
        (11, 1, 1, 1891, "Tobin Holmden", "Hd", 51, None, "M", True), (11, 2, 1, 1891, "NEW Holmden", "Dau", 11, None, "F", False), (11, 3, 1, 1891, "Old Holmden", "son", None, 1810, "M", False),
    ]
    rosters, people, parents, spouses = tables(spark, rows)
    r = households.reconcile(rosters, people, parents, spouses)
    assert {tuple(x) for x in households.findings(r).collect()} == {(1, "missing", "child", "New Holmden", None), (1, "contradiction", "child", "Old Holmden", 6)}
    assert [tuple(x) for x in households.married_names(r, rosters).collect()] == [(2, "WICKSTEAD")]


def test_only_pairs_that_decide_a_rung_are_written(spark, monkeypatch):
    rows = [
        (10, 1, 1, 1881, "Tobin Holmden", "Head", 41, None, "M", True), (10, 2, 1, 1881, "Una HOLMDEN", "Wife", 60, None, "F", False), (10, 3, 1, 1881, "Samuel Holmden", "Son", 15, None, "M", False),
        (10, 4, 1, 1881, "Wilfred Holmden", "son", 10, None, None, False), (10, 5, 1, 1881, "New Holmden", "Daur", 1, None, "F", False),
    ]
    written = []
    monkeypatch.setattr(households, "cut", lambda df, cut=households.cut: written.append(cut(df)) or written[-1])
    assert {r.n: r.status for r in households.reconcile(*tables(spark, rows)).collect()} == {1: "subject", 2: "in_tree", 3: "in_tree", 4: "near", 5: "missing"}
    pairs = [t for t in written if "tree_relation" in t.columns]
    # four members by five relatives are 20 pairs
    assert [t.count() for t in pairs] == [3]
    assert len(written) == 4


def test_in_laws_alone_are_those_of_all_rungs(spark, monkeypatch):
    rows = [
        (10, 1, 1, 1881, "Tobin Holmden", "Head", 41, None, "M", True), (10, 2, 1, 1881, "Edith Doxam", "Mother-in-law", None, None, "F", False), (10, 3, 1, 1881, "Jo Wickstead", "Father in law", None, None, None, False), (10, 4, 1, 1881, "Sam Holmden", "Son", 15, None, "M", False),
        (11, 1, 1, 1891, "Tobin Holmden", "Hd", 20, None, "M", True), (11, 2, 1, 1891, "Jo Moss", "Mother-in-law", None, None, None, False), (12, 1, 1, 1891, "Tobin Holmden", "Head", 51, None, "M", True), (12, 2, 1, 1891, "Jo", "Fa-Law", None, None, None, False), (12, 3, 1, 1891, None, "Ma-Law", None, None, None, False),
    ]
    rosters, people, parents, spouses = tables(spark, rows)
    written = []
    monkeypatch.setattr(households, "cut", lambda df, cut=households.cut: written.append(df.columns) or cut(df))
    anchors = households.anchored(rosters.where("target"), people)
    alone = households.in_laws(rosters.join(anchors, "event"), people, parents, spouses)
    assert len(written) == 1
    columns = ["event", "n", "name", "status", "profile_id"]
    whole = households.reconcile(rosters, people, parents, spouses).where("status = 'in_law'").select(columns)
    want = {(10, 3, "Jo Wickstead", "in_law", 2), (12, 2, "Jo", "in_law", 2), (12, 3, None, "in_law", 2)}
    assert alone.columns == columns and {tuple(r) for r in alone.collect()} == want == {tuple(r) for r in whole.collect()}
    assert [tuple(r) for r in households.married_names(alone).collect()] == [(2, "WICKSTEAD")]


def test_near_rung_needs_one_free_candidate(spark):
    head = (10, 1, 1, 1881, "Tobin Holmden", "Head", 41, None, "M", True)
    rivals = [head, (10, 2, 1, 1881, "Wilfred Holmden", "son", 10, None, "M", False), (10, 3, 1, 1881, "Ansel Holmden", "son", 11, None, "M", False)]
    assert {r.n: r.status for r in households.reconcile(*tables(spark, rivals)).collect()} == {1: "subject", 2: "missing", 3: "missing"}
    taken = [head, (10, 2, 1, 1881, "Wilfred Holmden", "son", 10, None, "M", False), (10, 3, 1, 1881, "William Holmden", "son", 11, None, "M", False)]
    assert {r.n: r.status for r in households.reconcile(*tables(spark, taken)).collect()} == {1: "subject", 2: "missing", 3: "in_tree"}


def test_target_must_be_the_subject_and_single(spark):
    wrong_year = [(10, 1, 1, 1881, "Tobin Holmden", "Head", 60, None, "M", True), (10, 2, 1, 1881, "Una Holmden", "Wife", 39, None, "F", False)]
    assert households.reconcile(*tables(spark, wrong_year)).count() == 0
    other_forename = [(10, 1, 1, 1881, "T Holmden", "Head", 41, None, None, True), (10, 2, 1, 1881, "Una Holmden", "Wife", 39, None, "F", False)]
    assert {r.n: r.status for r in households.reconcile(*tables(spark, other_forename)).collect()} == {1: "subject", 2: "in_tree"}
    woman = [(10, 1, 1, 1881, "T Holmden", "Head", 41, None, "F", True)]
    assert households.reconcile(*tables(spark, woman)).count() == 0
    two = [(10, 1, 1, 1881, "Tobin Holmden", "Head", 41, None, "M", True), (10, 2, 1, 1881, "Una Holmden", "Wife", 39, None, "F", True), (10, 3, 1, 1881, "Sam Holmden", "Son", 15, None, "M", False)]
    assert {r.n: (r.relation, r.status) for r in households.reconcile(*tables(spark, two)).collect()} == {1: (None, "subject"), 2: (None, "out_of_scope"), 3: (None, "out_of_scope")}
    assert households.reconcile(*tables(spark, [])).count() == 0


def test_roles(spark):
    roles = {"Head": "head", " WIFE ": "spouse", "Dau": "child", "GDau": None, "grandson": None, "Step-son": None, "Wife's sister": None, "Lodger": None, "Fa": "parent", "sister": "sibling", "": None, "Cousin": None, "Son-in-law": None, "Housekeeper": None, None: None}
    d = spark.createDataFrame([(k,) for k in roles], "r string")
    assert {r.r: r.c for r in d.select("r", households.category(F.col("r")).alias("c")).collect()} == roles
    laws = {"Mother-in-law": "mother", "Fa-Law": "father", "Pa in Law": "father", "son in law": None, "Daur-law": None, "Bro in law": None, "Mother": None, None: None, "Law": None}
    d = spark.createDataFrame([(k,) for k in laws], "r string")
    assert {r.r: r.c for r in d.select("r", households.parent_in_law(F.col("r")).alias("c")).collect()} == laws


def test_scoring_ladder_keeps_contractions_and_pet_forms_apart(spark):
    pairs = [("WM", "BILL", 0.0), ("JNO", "JACK", 0.0), ("WM", "WILLIAM", 0.85), ("RICHD", "RICD", 0.85), ("BILL", "WILLIE", 0.85), (" JOHN", "JOHN ", 1.0), ("ROBT", "ROBERTUS", 0.85), ("RICHD", "RICHARD", 0.85), ("SAM", "SAMUEL", 0.8), ("", "JOHN", 0.0), (None, "JOHN", 0.0)]
    d = spark.createDataFrame(pairs, "a string, b string, want double")
    got = d.select("a", "b", "want", names.similarity(F.col("a"), F.col("b")).alias("got"), names.similarity(F.col("b"), F.col("a")).alias("back")).collect()
    assert [(r.a, r.b, r.got, r.back) for r in got] == [(a, b, w, w) for a, b, w in pairs]


def test_people_are_dealt_out_before_their_dates_are_parsed(spark, tmp_path):
    from hearthgraph.carriers import Catalog

    spark.range(5000).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    used = Catalog(spark, str(tmp_path)).dated.select(F.spark_partition_id().alias("p"), "be").distinct()
    assert used.select("p").distinct().count() > 4
