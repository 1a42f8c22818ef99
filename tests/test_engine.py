"""The engine's operators on small hand-made tables, where the right answer is known."""

import numpy as np
from pyspark.sql import functions as F

from hearthgraph.functions import dates, names
from hearthgraph.operators import corpus, evidence, graph, relational
from hearthgraph.sources import gedcom

PARENTS = "from_id long, to_id long, role string"


def parents(spark, pairs):
    return spark.createDataFrame([(a, b, "father") for a, b in pairs], PARENTS)


def test_dates(spark):
    want = {
        "1887": (1887, 1887), "1 JAN 1887": (1887, 1887), "ABT 1900": (1895, 1905), "EST 1850": (1840, 1860), "CAL 1887": (1886, 1888), "BEF 1890": (None, 1890),
        "AFT 1880": (1880, None), "BET 1882 AND 1909": (1882, 1909), "1880s": (1880, 1889), "?": (None, None), "9999": (None, None), "": (None, None), None: (None, None),
        "about 1900": (1895, 1905), "Circa 1900": (1895, 1905), "around 1900": (1895, 1905), "approx 1900": (1895, 1905), "Approximately 1900": (1895, 1905), "estimated 1850": (1840, 1860),
        "calculated 1887": (1886, 1888), "before 1890": (None, 1890), "after 1880": (1880, None), "between 1882 and 1909": (1882, 1909), "BET 1880": (1880, 1880), "11887": (None, None),
        "ABT1900": (None, None), "1885s": (None, None), "BET 1882 AND later": (1882, None),
    }
    got = spark.createDataFrame([(k,) for k in want], "raw string").withColumn("d", dates.parse(F.col("raw"))).collect()
    assert {r.raw: (r.d.earliest, r.d.latest) for r in got} == want


def test_two_conventions_of_open_bounds(spark):
    d = spark.createDataFrame([(None, 1800, 1790, 1795), (1800, 1800, 1801, 1801), (1800, 1810, 1805, 1820)], "a int, b int, c int, d int")
    args = [F.col(c) for c in "abcd"]
    assert [tuple(r) for r in d.select(dates.overlaps_open(*args), dates.relation_strict(*args)).collect()] == [(True, "unknown"), (False, "disjoint"), (True, "overlap")]
    assert [r[0] for r in d.select(evidence.merge_action(*args)).collect()] == ["intersect", "dispute", "intersect"]


def test_name_ladders(spark):
    rows = [("JOHN", "JOHN"), ("JACK", "JOHN"), ("ANN", "HANNAH"), ("SLACK", "SLOCK"), ("ANN", "ANNE"), ("ELLEN", "ELEN"), ("TOM", "MARY"), (None, "X"), ("", "X"), ("BALDEN", "BAULDEN"), ("COLOR", "COLOUR"), ("MAUD", "MOUD"), ("BOB", "ROBERT"), ("WM", "WILLIAM"), ("NELL", "NELLIE"), ("BETTY", "LIZZIE")]
    d = spark.createDataFrame(rows, "a string, b string")
    got = d.select(names.similarity(F.col("a"), F.col("b")), names.audit_similarity(F.col("a"), F.col("b")), names.simple_similarity(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(1, 1, 1), (0.85, 0.85, 0.85), (0.8, 0.8, 0.8), (0.7, 0.7, 0.7), (0.8, 0.8, 0.8), (0.7, 0.7, 0.0), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0.95, 0.95, 0.95), (0.95, 0.95, 0.95), (0.7, 0.7, 0.7), (0.85, 0.85, 0.0), (0.85, 0.0, 0.0), (0.8, 0.85, 0.8), (0.85, 0.85, 0.0)]


def test_closure_with_diamond_and_cycle(spark):
    edges = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (5, 1), (1, 2)]
    got = {(r.id, r.kin): r.distance for r in graph.closure(parents(spark, edges), 3).collect()}
    up = {}
    for a, b in edges:
        up.setdefault(b, set()).add(a)
    want = {}
    for start in range(1, 6):
        level, seen = {start}, {start}
        for d in range(1, 4):
            level = {p for x in level for p in up.get(x, ())} - seen
            seen |= level
            want |= {(start, k): d for k in level}
    assert got == want
    assert graph.closure(parents(spark, []), 3).count() == 0


def test_components_and_families(spark):
    nodes = spark.createDataFrame([(k,) for k in range(1, 9)], "id long")
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (6, 6)], "a long, b long")
    assert {r.id: r.component for r in graph.components(nodes, edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8}
    mates = spark.createDataFrame([(1, 2, None), (2, 1, None)], "id long, other long, year int")
    got = {(r.kind, r.a, r.b, r.n_children) for r in graph.families(nodes, parents(spark, [(1, 3), (2, 3), (1, 4)]), mates).collect()}
    assert got == {("couple", 1, 2, 1), ("single", 1, None, 1), *[("alone", k, None, 0) for k in (5, 6, 7, 8)]}


def test_components_of_a_long_line(spark):
    names = [int(x) for x in np.random.default_rng(3).permutation(600)]
    nodes = spark.createDataFrame([(k,) for k in range(601)], "id long")
    got = graph.components(nodes, spark.createDataFrame(list(zip(names, names[1:])), "a long, b long"))
    assert sorted(tuple(r) for r in graph.component_sizes(got).collect()) == [(0, 600), (600, 1)]


def test_kinship_labels(spark):
    p = parents(spark, [(1, 2), (1, 3), (2, 4), (3, 5), (4, 6), (6, 7)])
    pairs = [(4, 5), (4, 3), (3, 4), (2, 3), (4, 1), (1, 6), (6, 5), (7, 1), (4, 4), (4, 99)]
    got = {(r.a, r.b): r.label for r in graph.kinship(spark.createDataFrame(pairs, "a long, b long"), graph.closure(p, 5)).collect()}
    assert [got[x] for x in pairs] == ["1 cousin", "uncle or aunt", "nephew or niece", "sibling", "grandparent", "great-grandchild", "1 cousin removed 1", "great-great-grandparent", "self", "none"]


def test_distances(spark):
    p = parents(spark, [(1, 2), (2, 3)])
    mates = spark.createDataFrame([(3, 9, None), (9, 3, None)], "id long, other long, year int")
    seed = spark.createDataFrame([(1,)], "id long")
    assert {r.id: r.distance for r in graph.generational_distance(seed, p, mates).collect()} == {1: 0, 2: 1, 3: 2, 9: 2}
    assert {r.id: (r.hops, r.via) for r in graph.shortest_paths(1, p, mates, 2).collect()} == {1: (0, None), 2: (1, 1), 3: (2, 2)}


def test_distances_through_many_marriages(spark):
    mates = spark.createDataFrame([(k, k + 1, None) for k in range(1, 7)] + [(k + 1, k, None) for k in range(1, 7)], "id long, other long, year int")
    got = graph.generational_distance(spark.createDataFrame([(1,)], "id long"), parents(spark, [(7, 8)]), mates, 1)
    assert {r.id: r.distance for r in got.collect()} == {**{k: 0 for k in range(1, 8)}, 8: 1}


def test_search_and_refresh(spark):
    docs = spark.createDataFrame([(1, "Slack's house at Alderby 1851, Slack"), (2, "slack rope"), (3, None), (4, "SLACK 1851")], "doc_id long, text string")
    got = {r.page: r.score for r in corpus.retrieve(docs, "SLACK", ["1851"], ["Alderby"]).collect()}
    assert got == {1: 3 * 2 + 2 + 1, 4: 5}
    old, new = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, v string"), spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "k long, v string")
    assert {r.k: r.change for r in corpus.refresh(old, new, "k", "v").collect()} == {1: "removed", 2: "updated", 3: "unchanged", 4: "inserted"}


def test_line_files(spark, tmp_path):
    people = spark.createDataFrame([(1, "Ann", "Slack", "ABT 1850"), (2, None, None, None)], "id long, given string, surname string, birth_raw string")
    lines = gedcom.write(people)
    assert sorted(tuple(r) for r in gedcom.read(lines).collect()) == [(1, "Ann", "Slack", "ABT 1850"), (2, "", "", None)]
    (tmp_path / "a.ged").write_text("0 HEAD\n1 CHAR UTF-8\n0 @I7@ INDI\n1 NAME Tom /Hall/\n1 DEAT\n2 DATE 1900\n1 BIRT\n2 DATE 1820\n0 TRLR\n")
    assert [tuple(r) for r in gedcom.read(gedcom.records(spark, str(tmp_path / "a.ged"))).collect()] == [(7, "Tom", "Hall", "1820")]


def test_streaks(spark):
    e = spark.createDataFrame([(1, k, 5, t) for k, t in enumerate("xooxxo")], "u int, ts long, user_id long, event_type string").withColumn("event_id", F.col("ts"))
    assert [tuple(r) for r in relational.streaks(e, F.col("event_type") == "x", 2).collect()] == [(5, 3, 2)]


def test_surname_tokens_and_words(spark):
    text = "The Slatter's and Holmden' of March, Was BUT slatter O'Neil Ab'. St. Ives (x) St. Ives"
    row = spark.createDataFrame([(text,)], "t string").select(corpus.surname_tokens(F.col("t")), corpus.word_count(F.col("t"), "St. Ives"), corpus.word_count(F.col("t"), "(x)")).first()
    assert tuple(row) == (["SLATTER", "HOLMDEN", "WAS", "BUT", "O'NEIL", "IVES", "IVES"], 2, 1)


def test_parents_gap_needs_one_bound_only(spark):
    from hearthgraph.plans import audit

    rule = next(r for r in audit.RULES if r.name == "parentAgeGap")
    d = spark.createDataFrame([(1, 2, 1880, 1887, 1875, 1891), (3, 4, 1874, 1887, 1874, 1887), (5, 6, 1870, 1887, 1870, 1887)], "c_id long, p_id long, p_bl int, c_be int, p_bb int, c_bb int")
    assert [r[0] for r in d.select(F.expr(rule.certain)).collect()] == [True, True, False]


def test_siblings_share_the_mothers_name(spark):
    rows = [(1, 1, "birth", 1850, "Slatter", "Maid"), (2, 2, "birth", 1869, "SLATTER", "maid "), (3, 3, "birth", 1871, "Slatter", "Maid"), (4, 4, "birth", 1850, "Slatter", None), (5, 5, "birth", 1850, "Hallam", "Maid"), (6, 1, "birth", 1851, "Slatter", "Maid")]
    r = spark.createDataFrame(rows, "record_id long, profile_id long, record_type string, year int, surname string, mother_maiden string")
    assert {(x.a, x.b) for x in evidence.inferred_siblings(r).collect()} == {(1, 2), (2, 3), (2, 6), (3, 6)}
