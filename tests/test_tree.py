"""Whole trees in line files: a hand-made file with awkward cases, and a round trip of made rows."""

from pyspark.sql import functions as F

from hearthgraph.sources import gedcom
from hearthgraph.sources import gedcom_tree as tree

FILE = """0 HEAD
1 SOUR SOMEAPP
2 VERS 5.5.1
1 GEDC
2 VERS 7.0.1
0 @I1@ INDI
1 NAME Orla Mae  /Wickstead/
2 GIVN Orla Maeve Joan
1 SEX f
1 BIRT
2 DATE ABT 1850
2 PLAC Alderby
2 SOUR @S9@
3 QUAY 3
2 SOUR @S1@
3 PAGE folio 3, Book A, Old Chest
3 QUAY 1
2 SOUR @S2@
3 PAGE https://x.example/2
3 QUAY 1
1 DEAT
2 NOTE 2 DATE 1900
1 BAPM
2 DATE 1851
0 @I2@ INDI
1 NAME /Brandle/
1 NAME Tobin /Holmden/
2 SURN Holmdene
1 SEX M
1 DEAT
2 DATE 1890
2 DATE 1891
0 @I3@ INDI
1 SEX Q
0 @F1@ FAM
1 HUSB @I2@
1 WIFE @I1@
1 MARR
2 DATE 3 MAY 1872
2 PLAC Morton
1 CHIL @I3@
1 CHIL @I7@
1 CHIL @I3@
 0 @F2@ FAM
1 WIFE @I8@
1 CHIL @I3@
1 NOTE never the
2 CONC  end
3 CONC lost
0 @F3@ FAM
1 HUSB @I3@
1 CHIL @I1@
0 @S1@ SOUR
1 TITL A long
2 CONT title
2 CONC  on
1 ABBR Book A
1 PUBL Print
1 REPO @R1@
1 AUTH Moss
1 NOTE one
2 CONT
2 CONT two
0 @S2@ SOUR
1 REPO @R7@
1 PUBL Old Print
1 _URL https://x.example/2
0 @S3@ SOUR
1 REPO Plain name
0 @R1@ REPO
1 NAME Old Chest
1 NAME Second
not a line
0 TRLR
"""


def lines_of(spark, tmp_path, text, name):
    (tmp_path / name).write_text(text)
    return tree.nodes(gedcom.records(spark, str(tmp_path / name)))


def test_reading_a_file_with_awkward_cases(spark, tmp_path):
    for name, text in (("a.ged", FILE), ("b.ged", FILE.replace("\n", "\r\n"))):
        n = lines_of(spark, tmp_path, text, name).cache()
        assert tree.version(n).first()[0] == "7.0"
        assert {r.id: tuple(r)[1:] for r in tree.people(n).collect()} == {
            "I1": ("Orla", "Maeve Joan", "Wickstead", "female", "ABT 1850", "Alderby", None, None),
            "I2": ("Tobin", None, "Holmdene", "male", None, None, "1891", None),
            "I3": (None, None, None, "unknown", None, None, None, None),
        }
        assert {tuple(r) for r in tree.edges(n, tree.people(n)).collect()} == {
            ("spouse", "I2", "I1", None, 1872), ("parent", "I2", "I3", "father", None), ("parent", "I1", "I3", "mother", None), ("parent", "I2", "I7", "father", None), ("parent", "I1", "I7", "mother", None),
            ("parent", "I8", "I3", "mother", None), ("parent", "I3", "I1", "unspecified", None),
        }
        assert {r.id: tuple(r)[1:] for r in tree.sources(n).collect()} == {
            "S1": ("A long\ntitle on", "Book A", "Old Chest", None, "Author: Moss\none\n\ntwo"), "S2": (None, None, "Old Print", "https://x.example/2", None), "S3": (None, None, "Plain name", None, None),
        }
        assert [tuple(r) for r in tree.citations(n, tree.sources(n)).collect()] == [("I1", "BIRT", "S1", "folio 3", 1)]
        assert n.where("rtag = 'FAM' AND tag = 'NOTE'").select("value").first()[0] == "never the end"
        assert n.where("level = 0").count() == 12
    old = lines_of(spark, tmp_path, "0 HEAD\n1 GEDC\n2 VERS 5.5.1\n2 VERS 7.0\n0 TRLR\n", "c.ged")
    assert tree.version(old).first()[0] == "5.5.1" and tree.people(old).count() == 0


PEOPLE = "id string, given string, middle string, surname string, gender string, birth_raw string, birth_place string, death_raw string, death_place string, living boolean"


def test_writing_and_reading_back(spark):
    persons = spark.createDataFrame([
        ("a", "Ivo", "Lund", "Slatter", "male", "1800", None, None, "Crayle", False), ("b", "Una", None, "Doxam", "female", None, None, None, None, False), ("c", None, None, None, None, None, None, None, None, True),
        ("d", "Wren", None, None, "other", None, "Morton", None, None, None), ("e", None, None, "Allcot", "unknown", None, None, None, None, False),
    ], PEOPLE)
    kin = spark.createDataFrame([("spouse", "b", "a", None, 1825), ("spouse", "d", "e", None, None), ("spouse", "b", "d", None, 1830), ("parent", "a", "c", "father", None), ("parent", "b", "c", "mother", None), ("parent", "d", "c", "x", None), ("parent", "e", "c", "x", None)], "type string, from_id string, to_id string, role string, year int")
    long = "word " * 130 + "\n\n  tail with blanks  \n" + "x" * 400
    origins = spark.createDataFrame([("s", "T", None, "Chest", None, long), ("t", None, None, None, "https://y.example", None)], "id string, title string, collection string, repository string, url string, notes string")
    cited = spark.createDataFrame([("a", "BIRT", "s", "p. 4", 2), ("a", "DEAT", "t", None, None), ("b", "BIRT", "s", "lost: no event", 1)], "id string, event string, source string, page string, quality int")
    for version in ("5.5.1", "7.0"):
        n = tree.nodes(tree.through_text(spark, tree.export(persons, kin, origins, cited, version))).cache()
        assert tree.version(n).first()[0] == version
        assert sorted(tuple(r) for r in tree.people(n).collect()) == sorted(tuple(r)[:-1] for r in persons.collect())
        got = {tuple(r) for r in tree.edges(n, tree.people(n)).collect()}
        assert got == {("spouse", "a", "b", None, 1825), ("spouse", "d", "e", None, None), ("spouse", "b", "d", None, 1830), ("parent", "a", "c", "father", None), ("parent", "b", "c", "mother", None), ("parent", "d", "c", "unspecified", None), ("parent", "e", "c", "unspecified", None)}
        assert sorted(map(str, tree.sources(n).collect())) == sorted(map(str, origins.collect()))
        assert sorted(map(str, tree.citations(n, tree.sources(n)).collect())) == sorted(map(str, cited.where("id = 'a'").collect()))
    fams = {r.id: (r.h, r.w, r.kids) for r in tree.families(persons, kin).collect()}
    assert fams == {"Fa_b": ("a", "b", ["c"]), "Fd_e": ("d", "e", ["c"]), "Fb_d": ("b", "d", [])}
    dead = tree.export(persons, kin, origins, cited, living=F.col("living"))
    assert {r.xref for r in dead.collect()} == {"", "a", "b", "d", "e", "Fa_b", "Fd_e", "Fb_d", "s", "t"} and dead.where("exists(lines, l -> l LIKE '1 CHIL%')").count() == 0
    nothing = tree.export(persons.limit(0), kin.limit(0), origins.limit(0), cited.limit(0))
    assert [r.xref for r in nothing.collect()] == [""]


def test_folding_by_characters(spark):
    d = spark.createDataFrame([("é" * 401,), ("a\n\nb",), ("",), (None,), ("x" * 200 + "\n" + "y" * 201,)], "v string")
    got = [r[0] for r in d.select(tree.folded(1, "NOTE", F.col("v"))).collect()]
    assert got == [["1 NOTE " + "é" * 200, "2 CONC " + "é" * 200, "2 CONC é"], ["1 NOTE a", "2 CONT ", "2 CONT b"], [], [], ["1 NOTE " + "x" * 200, "2 CONT " + "y" * 200, "2 CONC y"]]
