"""Possible duplicates by classes, held against all pairs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from hearthgraph.functions import names
from hearthgraph.operators import duplicates

PEOPLE = "id long, given string, surname string, be int, bl int"
EDGES = "from_id long, to_id long"


def all_pairs(spark, people, edges=(), dismissed=()):
    """{(a, b): score} by the rule's words; the ladder's own values come from the library, as it has tests of its own."""
    words = sorted({(n or "").strip().upper() for p in people for n in p[1:3]} - {""})
    grid = spark.createDataFrame([(x, y) for x in words for y in words] or [("A", "A")], "x string, y string")
    sim = {(r.x, r.y): r.s for r in grid.withColumn("s", names.audit_similarity(F.col("x"), F.col("y"))).collect()}
    no = {frozenset(e) for e in [*edges, *dismissed]}
    middle = lambda e, l: (e + l) // 2 if None not in (e, l) else l if e is None else e  # noqa: E731, E741
    out = {}
    for x, y in itertools.combinations(sorted(people), 2):
        gx, gy, sx, sy = ((n or "").strip().upper() for n in (x[1], y[1], x[2], y[2]))
        g, s = sim.get((gx, gy), 0.0), sim.get((sx, sy), 0.0)
        dated = x[3:] != (None, None) and y[3:] != (None, None)
        low, high = (lambda v: -9999 if v is None else v), (lambda v: 9999 if v is None else v)
        meet = low(x[3]) <= high(y[4]) and low(y[3]) <= high(x[4])
        if frozenset((x[0], y[0])) in no or (gx and gy and not g) or (dated and not meet and abs(middle(*x[3:]) - middle(*y[3:])) > 10):
            continue
        score = s * 0.4 + g * 0.3 + (0.3 if dated and meet else 0)
        if s >= 0.9 and g >= 0.7 and not (dated and not meet):
            score = max(score, 0.7)
        if round(score, 4) >= 0.7:
            out[x[0], y[0]] = round(score, 4)
    return out


def check(spark, people, edges=(), dismissed=()):
    want = all_pairs(spark, people, edges, dismissed)
    p, e = spark.createDataFrame(people, PEOPLE), spark.createDataFrame(list(edges), EDGES)
    d = spark.createDataFrame(list(dismissed), "a long, b long") if dismissed else None
    of = {r.id: r.c for r in duplicates.members(p).collect()}
    links = {}
    for (a, b), score in want.items():
        key = (min(of[a], of[b]), max(of[a], of[b]))
        links[key] = (score, links.get(key, (0, 0))[1] + 1)
    got = [tuple(r) for r in duplicates.counted(p, e, d).collect()]
    assert len(got) == len({r[:2] for r in got})
    assert {r[:2]: r[2:] for r in got} == links
    greatest = {}
    for a, b in want:
        greatest[a] = max(b, greatest.get(a, 0))
    rows = [tuple(r) for r in duplicates.greatest_partners(p, e, d).collect()]
    assert len(rows) == len(greatest) and dict(rows) == greatest
    return want


def test_pairs_that_blocking_lost(spark):
    people = [
        (1, "Gladys", "Slatter", None, None), (2, " glays ", "SLATTER", 1890, 1890),  # typing error, one undated
        (3, None, "Holmden", 1850, 1860), (4, "Tom", "Holmden", 1855, 1855), (5, " ", "Holmden ", 1859, 1861),  # given name missing
        (6, "Jack", "Doxam", None, 1800), (7, "John", "Doxham", 1700, None),  # open bounds, one letter more
        (8, "Ann", "Brandle", 1800, 1800), (9, "Ann", "Brandle", 1811, 1811), (10, "Ann", "Brandle", 1806, 1806),  # disjoint births
        (11, "Dora", "Allcot", 1900, 1900), (12, "Vera", "Allcot", 1900, 1900),  # unlike given names
        (13, "Ann", None, 1900, 1900), (14, "Ann", "", 1900, 1900), (15, None, None, None, None),  # no surname
        (16, "Mary", "Baldon", None, None), (17, "Mary", "Bauldon", None, None), (18, "Maryann", "Baldonby", 1870, 1870), (19, "Mary", "Baldon", 1868, 1872),
    ]
    want = check(spark, people)
    assert {(1, 2), (3, 4), (3, 5), (6, 7), (8, 10), (9, 10), (16, 17), (18, 19)} <= set(want) and not {(8, 9), (11, 12), (13, 14), (4, 5)} & set(want)


def test_parents_children_and_dismissed_pairs_are_apart(spark):
    same = [(k, "George", "Keld", 1850, 1850) for k in range(1, 7)]
    # the greatest id is everyone's partner, but its own father and dismissed ones take the next
    want = check(spark, same, edges=[(1, 6), (6, 2), (1, 6), (3, 3)], dismissed=[(6, 3), (5, 3), (4, 3)])
    assert (1, 6) not in want and (3, 6) not in want and (1, 5) in want
    assert check(spark, same[:2], edges=[(1, 2)]) == {}


def test_no_people(spark):
    assert duplicates.counted(spark.createDataFrame([], PEOPLE), spark.createDataFrame([], EDGES)).count() == 0
    assert duplicates.greatest_partners(spark.createDataFrame([], PEOPLE), spark.createDataFrame([], EDGES)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    rnd = random.Random(seed)
    given = ["John", "Jack", "Jno", "Ann", "Anne", "Hannah", "Nan", "Mary", "Polly", "Jo", "J", "Bob", "Robert", "", None, "?"]
    surnames = ["Slatter", "Slater", "Slattar", "Late", "Baldon", "Bauldon", "Baldons", "Onsby", "Ons", "", None]
    people = []
    for k in range(1, 161):
        y, shape = rnd.randint(1840, 1875), rnd.randrange(5)
        people.append((k, rnd.choice(given), rnd.choice(surnames), *[(y, y), (y - 5, y + 5), (None, y), (y, None), (None, None)][shape]))
    edges = [(rnd.randint(1, 160), rnd.randint(1, 160)) for _ in range(150)]
    dismissed = [(rnd.randint(1, 160), rnd.randint(120, 160)) for _ in range(150)]
    assert len(check(spark, people, edges, dismissed)) > 200


def test_three_tables_give_every_pair_of_people(spark):
    people = [(k, "George" if k % 3 else "Ann", "Keld" if k % 2 else "Kelds", 1850 + k % 2, 1852) for k in range(1, 13)] + [(13, "Ivy", "Moss", None, None), (14, "Ivy", "Moss", None, None)]
    edges, dismissed = [(1, 5), (7, 1), (2, 8), (2, 5), (3, 4), (13, 14)], [(11, 5), (8, 1)]
    p, e, d = spark.createDataFrame(people, PEOPLE), spark.createDataFrame(edges, EDGES), spark.createDataFrame(dismissed, "a long, b long")
    of = {}
    for r in duplicates.members(p).collect():
        of.setdefault(r.c, []).append(r.id)
    got = {}
    for r in duplicates.counted(p, e, d).collect():
        got |= {(min(x, y), max(x, y)): r.score for x in of[r.a] for y in of[r.b] if x != y}
    for r in duplicates.parted(p, e, d).collect():
        got.pop((r.a, r.b), None)
    assert got == all_pairs(spark, people, edges, dismissed) and len(got) > 20


@pytest.mark.parametrize("few", [0, 500_000])
def test_links_of_all_classes_are_not_sorted_for_the_few_kept_apart(spark, monkeypatch, few):
    monkeypatch.setattr(duplicates, "FEW", few, raising=False)
    people = [(k, "George" if k % 3 else "Ann", "Keld" if k % 2 else "Kelds", 1850 + k % 2, 1852) for k in range(1, 13)]
    edges, dismissed = [(1, 12), (2, 11), (12, 10), (11, 9), (3, 12)], [(1, 11), (1, 10)]
    check(spark, people, edges, dismissed)
    got = duplicates.greatest_partners(spark.createDataFrame(people, PEOPLE), spark.createDataFrame(edges, EDGES), spark.createDataFrame(dismissed, "a long, b long"))
    # the links are used up by then: what is left joins only the people whose greatest partner is kept apart
    assert "top_b" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("block", [1, 3, 128])
def test_every_pair_of_people_comes_out_whatever_the_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(duplicates, "BLOCK", block)
    people = [(k, "George" if k % 3 else "Ann", "Keld" if k % 2 else "Kelds", 1850 + k % 2, 1852) for k in range(1, 25)] + [(k, "Ivy", "Moss", None, None) for k in (30, 31, 32)] + [(40, None, "Moss", None, None), (41, "Ivy", None, None, None)]
    edges, dismissed = [(1, 5), (7, 1), (2, 8), (2, 5), (3, 4), (30, 31), (31, 30), (9, 9)], [(11, 5), (8, 1), (41, 30)]
    p, e, d = spark.createDataFrame(people, PEOPLE), spark.createDataFrame(edges, EDGES), spark.createDataFrame(dismissed, "a long, b long")
    rows = [tuple(r) for r in duplicates.pairs(p, e, d).collect()]
    want = all_pairs(spark, people, edges, dismissed)
    assert {r[:2]: r[2] for r in rows} == want and len(rows) == len(want) > 100


def test_query_of_pairs_lists_people_not_classes(spark):
    import __spark_entry__

    made = {k: __spark_entry__.queries()[f"J13_duplicate_{k}"](spark, "/root/testdata/sf0.001") for k in ("pairs", "classes", "members")}
    assert made["pairs"].columns == ["a", "b", "score"]
    of = {r.id: r.c for r in made["members"].collect()}
    counts = {}
    for r in made["pairs"].collect():
        key = (*sorted((of[r.a], of[r.b])), r.score)
        assert r.a < r.b
        counts[key] = counts.get(key, 0) + 1
    assert counts and counts == {(r.a, r.b, r.score): r.n_pairs for r in made["classes"].collect()}
