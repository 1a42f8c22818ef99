"""People who may be one person recorded twice, without losing a pair that the rule names.

People with equal names (trimmed, in upper case) and equal bounds of birth form a class, known by its smallest id. The
score of two people depends on their classes alone, so classes are compared and counted; people meet only where a
parent and child, or a dismissed pair, must be taken out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..carriers import DEALT
from ..checkpoints import cut
from ..functions import dates, names

#: Weights of surname, given name and meeting births; from where a pair counts; a near-equal surname and
#: an alike given name that count without dates; years between disjoint births that tell people apart.
SURNAME, GIVEN, BIRTH, LEAST, NEAR, ALIKE, YEARS = 0.4, 0.3, 0.3, 0.7, 0.9, 0.7, 10

#: Up to so many rows of two numbers, or classes, are sent to every task, else joined by key. All other joins are by
#: key: the size of files, by which Spark would choose, tells too little of the rows in the driver's memory.
FEW = 500_000
FEW_CLASSES = 150_000

#: About so many people of a class stand in one row while they meet those of another.
BLOCK = 128

_KEY = ["s", "g", "e0", "l0"]


def alike(words: DataFrame) -> DataFrame:
    """x, y, sim of all pairs of the column `w` (distinct, not empty) that the audit's ladder rates above 0, both ways
    and each with itself.

    One letter other or more means that both share a form with one letter left out; full forms and plain vowels are
    keys; and what a name contains is found by its substrings, of which a name of n letters has n * n / 2."""
    left_out = F.expr("transform(sequence(1, length(w)), i -> concat('d:', substring(w, 1, i - 1), substring(w, i + 1)))")
    keyed = words.select("w", F.explode(F.array_distinct(F.concat(left_out, F.array(F.concat(F.lit("d:"), "w"), *names.keys(F.col("w")))))).alias("key"))
    near = keyed.select(F.col("w").alias("x"), "key").join(keyed.select(F.col("w").alias("y"), "key"), "key").select("x", "y")
    parts = F.expr("flatten(transform(sequence(1, length(w)), i -> transform(sequence(1, length(w) - i + 1), n -> substring(w, i, n))))")
    inside = words.select(F.col("w").alias("x"), F.explode(F.array_distinct(parts)).alias("y")).join(words.select(F.col("w").alias("y")), "y").select("x", "y")
    pairs = near.unionByName(inside).unionByName(inside.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    return pairs.withColumn("sim", names.audit_similarity(F.col("x"), F.col("y"))).where("sim > 0")


def _named(people: DataFrame) -> DataFrame:
    """Null names are empty, null bounds a year that no date has. Without a surname nobody reaches the threshold."""
    clean = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    bounds = [F.coalesce(F.col(c), F.lit(-1)).alias(k) for c, k in (("be", "e0"), ("bl", "l0"))]
    return people.select("id", clean(F.col("surname")).alias("s"), clean(F.col("given")).alias("g"), *bounds).where("s <> ''")


def _classes(named: DataFrame) -> DataFrame:
    """One row a class: its key, c (smallest id), top (greatest id), n; with the bounds and the middle of birth."""
    by = named.groupBy(*_KEY).agg(F.min("id").alias("c"), F.max("id").alias("top"), F.count(F.lit(1)).alias("n"))
    by = by.withColumns({"be": F.expr("nullif(e0, -1)"), "bl": F.expr("nullif(l0, -1)")})
    return by.withColumn("bb", dates.best_year(F.col("be"), F.col("bl")))


def members(people: DataFrame) -> DataFrame:
    """id, c: everyone with a surname, and the smallest id of the class."""
    named = _named(people)
    return named.join(_classes(named).select(*_KEY, "c").hint("merge"), _KEY).select("id", "c")


def _score(x: str, y: str) -> Column:
    """Of two classes x and y with `sim_s` and `sim_g`; a given name that one lacks has 0 and does not tell them apart."""
    col = lambda side, name: F.col(f"{side}.{name}")
    dated = F.coalesce(col(x, "be"), col(x, "bl")).isNotNull() & F.coalesce(col(y, "be"), col(y, "bl")).isNotNull()
    meet = dates.overlaps_open(col(x, "be"), col(x, "bl"), col(y, "be"), col(y, "bl"))
    total = F.col("sim_s") * SURNAME + F.col("sim_g") * GIVEN
    total = F.when(dated & meet, total + BIRTH).otherwise(total)
    strong = (F.col("sim_s") >= NEAR) & (F.col("sim_g") >= ALIKE) & ~(dated & ~meet)
    total = F.when(strong, F.greatest(total, F.lit(LEAST))).otherwise(total)
    return F.when(dated & ~meet & (F.abs(col(x, "bb") - col(y, "bb")) > YEARS), 0.0).otherwise(F.round(total, 4))


def class_links(people: DataFrame) -> DataFrame:
    """a <= b (smallest ids of two classes, or one class twice), score, n_a, n_b, top_a, top_b: all pairs of classes
    whose people reach the threshold, before anyone is taken out.

    Classes are written once. Names are compared as distinct names; classes meet by equal pairs of names, so within such a pair only distinct
    bounds of birth meet, of which the calendar has a bounded number however many people there are."""
    classes = cut(_classes(_named(people)))
    full = classes.hint("merge").select("s", "g").distinct()
    sims = {k: alike(full.where(f"{k} <> ''").select(F.col(k).alias("w")).distinct()) for k in ("s", "g")}
    as_names = lambda k: sims[k].select(F.col("x").alias(k), F.col("y").alias(f"{k}2"), F.col("sim").alias(f"sim_{k}"))
    both = full.where("g <> ''").join(as_names("s"), "s").join(as_names("g"), "g")
    # one or both given names are missing: only equal surnames reach the threshold
    bare = full.where("g = ''").select("s", F.lit("").alias("g"))
    lone = bare.join(full.select("s", F.col("g").alias("g2")), "s").select("s", "g", F.col("s").alias("s2"), "g2")
    lone = lone.unionByName(lone.where("g2 <> ''").select("s", F.col("g2").alias("g"), "s2", F.col("g").alias("g2")))
    lone = lone.withColumns({"sim_s": F.lit(1.0), "sim_g": F.lit(0.0)})
    pairs = both.select("s", "g", "s2", "g2", "sim_s", "sim_g").unionByName(lone.select("s", "g", "s2", "g2", "sim_s", "sim_g"))
    # dealt out before they multiply: pairs of names are few rows, which would end up in a few tasks
    pairs = pairs.repartition(DEALT * pairs.sparkSession.sparkContext.defaultParallelism, "s", "g", "s2", "g2")
    classes = few(classes, FEW_CLASSES)
    x, y = classes.alias("x"), classes.alias("y")
    met = pairs.alias("p").join(x, (F.col("p.s") == F.col("x.s")) & (F.col("p.g") == F.col("x.g"))).join(y, (F.col("p.s2") == F.col("y.s")) & (F.col("p.g2") == F.col("y.g")))
    met = met.where("x.c < y.c OR (x.c = y.c AND x.n > 1)").withColumn("score", _score("x", "y")).where(F.col("score") >= LEAST)
    return met.select(F.col("x.c").alias("a"), F.col("y.c").alias("b"), "score", F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b"), F.col("x.top").alias("top_a"), F.col("y.top").alias("top_b"))


def apart(parents: DataFrame, dismissed: DataFrame | None = None) -> DataFrame:
    """a < b, each once: parents and children, and pairs that someone has dismissed (a, b in any order)."""
    pairs = parents.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    if dismissed is not None:
        pairs = pairs.unionByName(dismissed.select("a", "b"))
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().hint("merge")


def counted(people: DataFrame, parents: DataFrame, dismissed: DataFrame | None = None) -> DataFrame:
    """a <= b (classes), score, n_pairs: with `members`, every pair of possible duplicates; n_pairs leaves out parents
    with their children and dismissed pairs, and links that lose all their pairs go."""
    of = members(people)
    out = apart(parents, dismissed).join(of.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(of.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b")
    out = out.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.count(F.lit(1)).alias("gone"))
    n = F.when(F.col("a") == F.col("b"), F.expr("n_a * (n_a - 1) div 2")).otherwise(F.expr("n_a * n_b"))
    links = class_links(people).join(out, ["a", "b"], "left").withColumn("n_pairs", n - F.coalesce("gone", F.lit(0)))
    return links.where("n_pairs > 0").select("a", "b", "score", "n_pairs")


def _block(n: str) -> Column:
    """Blocks of a class of n people, from 0; people are dealt into them by their ids."""
    return F.expr(f"({n} + {BLOCK - 1}) div {BLOCK}")


def pairs(people: DataFrame, parents: DataFrame, dismissed: DataFrame | None = None) -> DataFrame:
    """a < b, score: every pair of people who may be one, without parents with their children and dismissed pairs.

    Linked classes meet by blocks of people: a pair of blocks is one row until its pairs are written, and a class of any
    size is many rows, so no task holds a class. Pairs kept apart go with the pair of blocks they are in."""
    people = cut(people.select("id", "given", "surname", "be", "bl"))
    named, links = _named(people), class_links(people)
    dealt = named.join(_classes(named).select(*_KEY, "c", "n").hint("merge"), _KEY).select("c", F.pmod(F.xxhash64("id"), _block("n")).alias("k"), "id")
    blocks = cut(dealt.groupBy("c", "k").agg(F.collect_list("id").alias("ids")))
    of = blocks.select("c", "k", F.explode("ids").alias("id")).hint("merge")
    side = lambda x: of.select(F.col("id").alias(x), F.struct("c", "k").alias(f"{x}_in"))
    gone = apart(parents, dismissed).join(side("a"), "a").join(side("b"), "b").select("a", "b", F.least("a_in", "b_in").alias("x"), F.greatest("a_in", "b_in").alias("y"))
    gone = gone.groupBy(F.col("x.c").alias("ca"), F.col("x.k").alias("ka"), F.col("y.c").alias("cb"), F.col("y.k").alias("kb")).agg(F.collect_list(F.struct("a", "b")).alias("gone"))
    met = links.select(F.col("a").alias("ca"), F.col("b").alias("cb"), "score", "n_b", F.explode(F.sequence(F.lit(0), _block("n_a") - 1)).alias("ka"))
    met = met.select("ca", "cb", "score", "ka", F.explode(F.sequence(F.lit(0), _block("n_b") - 1)).alias("kb")).where("ca < cb OR ka <= kb")
    met = met.join(gone.hint("merge"), ["ca", "ka", "cb", "kb"], "left")
    for end in "ab":
        met = met.join(blocks.select(F.col("c").alias(f"c{end}"), F.col("k").alias(f"k{end}"), F.col("ids").alias(f"ids_{end}")).hint("merge"), [f"c{end}", f"k{end}"])
    met = met.select("score", "gone", "ids_b", F.expr("ca = cb AND ka = kb").alias("same"), F.explode("ids_a").alias("x")).select("score", "gone", "same", "x", F.explode("ids_b").alias("y"))
    met = met.where("NOT same OR x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score", "gone")
    return met.where("gone IS NULL OR NOT array_contains(gone, struct(a, b))").select("a", "b", "score")


def parted(people: DataFrame, parents: DataFrame, dismissed: DataFrame | None = None) -> DataFrame:
    """a < b: the pairs of people in linked classes that `counted` takes out of n_pairs.

    All pairs of people of the linked classes (`counted`, `members`) but these are every pair of possible duplicates."""
    of = members(people)
    out = apart(parents, dismissed).join(of.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(of.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b")
    links = class_links(people).select(F.col("a").alias("lo"), F.col("b").alias("hi"))
    return out.select("a", "b", F.least("ca", "cb").alias("lo"), F.greatest("ca", "cb").alias("hi")).join(links, ["lo", "hi"], "left_semi").select("a", "b")


def greatest_partners(people: DataFrame, parents: DataFrame, dismissed: DataFrame | None = None) -> DataFrame:
    """id, partner: everyone with a possible duplicate of a greater id, and the greatest of them.

    The greatest id among a class's links is the partner of all its people, but for those it must be kept apart from.
    Only these look at each linked class, and only into classes whose own greatest id they must be kept apart from."""
    of, no = members(people), apart(parents, dismissed)
    links = cut(class_links(people))
    ways = links.select(F.col("a").alias("c"), F.col("b").alias("other"), F.col("top_b").alias("top"))
    ways = ways.unionByName(links.where("a <> b").select(F.col("b").alias("c"), F.col("a").alias("other"), F.col("top_a").alias("top")))
    first = of.join(ways.groupBy("c").agg(F.max("top").alias("partner")).hint("merge"), "c").where("id < partner")
    flagged = no.select(F.col("a").alias("id"), F.col("b").alias("partner"), F.lit(True).alias("no"))
    # written once: what follows is for few people, and must not sort the links of all classes for them
    first = cut(first.join(flagged, ["id", "partner"], "left"))
    held = first.where("no").select("id", "c")
    each = few(held).join(ways, "c").select("id", "other", F.col("top").alias("partner")).where("id < partner")
    each = cut(each.join(flagged, ["id", "partner"], "left"))
    inside = few(each.where("no").select("id", "other")).join(of.select(F.col("id").alias("partner"), F.col("c").alias("other")), "other").where("id < partner")
    found = each.where("no IS NULL").select("id", "partner").unionByName(inside.select("id", "partner").join(flagged.drop("no"), ["id", "partner"], "left_anti"))
    return first.where("no IS NULL").select("id", "partner").unionByName(found.groupBy("id").agg(F.max("partner").alias("partner")))


def few(rows: DataFrame, most: int | None = None) -> DataFrame:
    """rows of two numbers, to be sent to every task where there are at most FEW (or `most`), else joined by key."""
    return F.broadcast(rows) if rows.count() <= (FEW if most is None else most) else rows.hint("merge")
