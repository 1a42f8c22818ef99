"""Kinship and graph operators as joins and level-by-level loops over edge tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut


def closure(parents: DataFrame, depth: int, up: bool = True, start: DataFrame | None = None) -> DataFrame:
    """id, kin, distance: forebears (or descendants) with their least distance, at most depth generations away.

    A level joins only the pairs that the level before found first, so cycles end and shared forebears do not
    multiply. start (id) limits whose kin is wanted. Null ends are left out, repeated edges do no harm.
    """
    a, b = ("to_id", "from_id") if up else ("from_id", "to_id")
    step = parents.where("from_id IS NOT NULL AND to_id IS NOT NULL").select(F.col(a).alias("near"), F.col(b).alias("far")).distinct()
    level = step.withColumnsRenamed({"near": "id", "far": "kin"})
    if start is not None:
        level = level.join(start.select("id").distinct(), "id", "left_semi")
    level = cut(level.where("id <> kin").withColumn("distance", F.lit(1)))
    all_ = level
    for d in range(2, depth + 1):
        more = level.select("id", F.col("kin").alias("near")).join(step, "near").where("id <> far").select("id", F.col("far").alias("kin")).distinct()
        level = cut(more.join(all_, ["id", "kin"], "left_anti").withColumn("distance", F.lit(d)))
        if level.isEmpty():
            break
        all_ = all_.unionByName(level)
    return all_


def linked(edges: DataFrame, cut: Callable = cut, snug: Callable = lambda df, rows: df) -> DataFrame:
    """edges: a, b (long). Returns node, root: the smallest node of its component, for every node with an edge.

    Each round hooks every node to its smallest neighbour. The only cycles are pairs that chose each other, whose
    smaller node is the smallest of its tree and stays as root. Trees are flattened by taking the parent three levels up until
    nothing moves, then become the nodes of the next round. A tree has two nodes at least, so nodes with edges halve
    each round, and the loop ends after at most log2 of their number, whatever the labels and the diameter. Tables are
    cut in the shared folder. Nulls are left out, loops and repeated edges do no harm.
    """
    both = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = None
    while (n := both.count()) or labels is None:
        both = snug(both, n)
        pick = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up"))
        back = pick.select(F.col("node").alias("up"), F.col("up").alias("over"))
        root = F.when(F.col("over") == F.col("node"), F.least("node", "up")).otherwise(F.col("up"))
        tree = cut(snug(pick.join(back, "up").select("node", root.alias("root")), n))
        while True:
            far = tree.select(F.col("node").alias("root"), F.col("root").alias("far"))
            top = tree.select(F.col("node").alias("far"), F.col("root").alias("top"))
            new = cut(snug(tree.join(far, "root").join(top, "far").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), n))
            tree = new.select("node", "root")
            if new.where("moved").isEmpty():
                break
        ends = both.join(tree.withColumnsRenamed({"node": "a", "root": "x"}), "a").join(tree.withColumnsRenamed({"node": "b", "root": "y"}), "b")
        both = cut(snug(ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), n))
        up = tree.select(F.col("node").alias("root"), F.col("root").alias("over"))
        labels = tree if labels is None else cut(snug(labels.join(up, "root", "left").select("node", F.coalesce("over", "root").alias("root")), labels.count()))
    return labels


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component (smallest id) for every node; edges (a, b) between nodes, singletons kept."""
    own = cut(nodes.select("id").distinct())
    inside = edges.select("a", "b").join(own.withColumnRenamed("id", "a"), "a", "left_semi").join(own.withColumnRenamed("id", "b"), "b", "left_semi")
    roots = linked(inside).withColumnsRenamed({"node": "id", "root": "component"})
    return own.join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def component_sizes(labels: DataFrame) -> DataFrame:
    """component, n_people, in order of size and smallest id."""
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("n_people"))


def generational_distance(seeds: DataFrame, parents: DataFrame, spouses: DataFrame, most: int = 10) -> DataFrame:
    """id, distance: least number of parent-child steps from any seed; a step between spouses costs nothing.

    Distances only fall and none exceeds most, so the front empties."""
    steps = parents.select(F.col("from_id").alias("id"), F.col("to_id").alias("other"), F.lit(1).alias("cost"))
    steps = steps.unionByName(parents.select(F.col("to_id").alias("id"), F.col("from_id").alias("other"), F.lit(1).alias("cost")))
    steps = cut(steps.unionByName(spouses.select("id", "other", F.lit(0).alias("cost"))).groupBy("id", "other").agg(F.min("cost").alias("cost")))
    best = cut(seeds.select("id").distinct().withColumn("distance", F.lit(0)))
    front = best
    while True:
        near = front.join(steps, "id").select(F.col("other").alias("id"), (F.col("distance") + F.col("cost")).alias("new")).where(F.col("new") <= most)
        near = near.groupBy("id").agg(F.min("new").alias("new"))
        front = cut(near.join(best, "id", "left").where("distance IS NULL OR new < distance").select("id", F.col("new").alias("distance")))
        if front.isEmpty():
            break
        best = cut(best.join(front.select("id"), "id", "left_anti").unionByName(front))
    return best


def shortest_paths(start: int, parents: DataFrame, spouses: DataFrame, hops: int) -> DataFrame:
    """id, hops, via: breadth-first over all edges from one person; via is the smallest predecessor one hop nearer."""
    links = parents.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).unionByName(parents.select(F.col("to_id").alias("a"), F.col("from_id").alias("b")))
    links = cut(links.unionByName(spouses.select(F.col("id").alias("a"), F.col("other").alias("b"))).distinct())
    seen = cut(parents.sparkSession.range(1).select(F.lit(start).cast("long").alias("id"), F.lit(0).alias("hops"), F.lit(None).cast("long").alias("via")))
    level = seen
    for h in range(1, hops + 1):
        near = level.select(F.col("id").alias("a")).join(links, "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("via"))
        level = cut(near.join(seen, "id", "left_anti").select("id", F.lit(h).alias("hops"), "via"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def ordinal(n: Column) -> Column:
    """great- repeated before a generation's name."""
    return F.repeat(F.lit("great-"), F.greatest(n - 2, F.lit(0)))


def kinship(pairs: DataFrame, forebears: DataFrame) -> DataFrame:
    """a, b, d1, d2, common_kin, label for pairs (a, b).

    The nearest common forebear has the least d1 + d2, then the greatest min(d1, d2), then the smallest id. Oneself
    counts as a forebear at distance 0. Pairs without one keep a row with null distances and label none.
    """
    own = forebears.select("id", "kin", "distance")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    own = own.unionByName(ids.select("id", F.col("id").alias("kin"), F.lit(0).alias("distance")))
    left = own.select(F.col("id").alias("a"), F.col("kin").alias("common_kin"), F.col("distance").alias("d1"))
    right = own.select(F.col("id").alias("b"), F.col("kin").alias("common_kin"), F.col("distance").alias("d2"))
    common = pairs.select("a", "b").distinct().join(left, "a").join(right, ["b", "common_kin"])
    best = common.groupBy("a", "b").agg(F.min(F.struct((F.col("d1") + F.col("d2")).alias("s"), (-F.least("d1", "d2")).alias("m"), "common_kin", "d1", "d2")).alias("x"))
    out = pairs.select("a", "b").distinct().join(best.select("a", "b", "x.common_kin", "x.d1", "x.d2"), ["a", "b"], "left")
    return out.withColumn("label", kinship_label(F.col("d1"), F.col("d2")))


def kinship_label(d1: Column, d2: Column) -> Column:
    """What b is to a, from the distances to the nearest common forebear."""
    line = lambda d, one, two: F.when(d == 1, one).when(d == 2, f"grand{two}").otherwise(F.concat(ordinal(d), F.lit(f"grand{two}")))
    removed = F.abs(d1 - d2)
    nth = F.least(d1, d2) - 1
    cousin = F.concat(nth.cast("string"), F.lit(" cousin"), F.when(removed > 0, F.concat(F.lit(" removed "), removed.cast("string"))).otherwise(""))
    return (
        F.when(d1.isNull(), "none").when((d1 == 0) & (d2 == 0), "self").when(d2 == 0, line(d1, "parent", "parent")).when(d1 == 0, line(d2, "child", "child"))
        .when((d1 == 1) & (d2 == 1), "sibling").when(d2 == 1, F.concat(F.repeat(F.lit("great-"), F.greatest(d1 - 2, F.lit(0))), F.lit("uncle or aunt")))
        .when(d1 == 1, F.concat(F.repeat(F.lit("great-"), F.greatest(d2 - 2, F.lit(0))), F.lit("nephew or niece"))).otherwise(cousin)
    )


def pedigree(root: DataFrame, parents: DataFrame, generations: int) -> DataFrame:
    """root, slot, id: numbered forebears (person n, father 2n, mother 2n + 1); the smallest id where a role repeats."""
    up = parents.where("role IN ('father', 'mother')").groupBy(F.col("to_id").alias("id"), "role").agg(F.min("from_id").alias("p"))
    up = cut(up.select("id", F.col("p"), F.when(F.col("role") == "mother", 1).otherwise(0).alias("side")))
    level = root.select(F.col("id").alias("root"), F.lit(1).cast("long").alias("slot"), "id")
    all_ = level
    for _ in range(generations):
        level = level.join(up, "id").select("root", (2 * F.col("slot") + F.col("side")).alias("slot"), F.col("p").alias("id"))
        all_ = all_.unionByName(level)
    return all_


def families(people: DataFrame, parents: DataFrame, spouses: DataFrame) -> DataFrame:
    """kind, a, b, n_children: couples with the children they share, parents whose children no couple covers, and people without edges."""
    pairs = spouses.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    kids = parents.select(F.col("from_id"), F.col("to_id")).distinct()
    shared = pairs.join(kids.withColumnRenamed("from_id", "a"), "a").join(kids.withColumnRenamed("from_id", "b"), ["b", "to_id"]).select("a", "b", "to_id")
    couples = pairs.join(shared.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_children")), ["a", "b"], "left").fillna(0, ["n_children"]).select(F.lit("couple").alias("kind"), "a", "b", "n_children")
    covered = shared.select(F.col("a").alias("from_id"), "to_id").unionByName(shared.select(F.col("b").alias("from_id"), "to_id")).distinct()
    single = kids.join(covered, ["from_id", "to_id"], "left_anti").groupBy(F.col("from_id").alias("a")).agg(F.count(F.lit(1)).alias("n_children"))
    single = single.select(F.lit("single").alias("kind"), "a", F.lit(None).cast("long").alias("b"), "n_children")
    linked = parents.select(F.col("from_id").alias("id")).unionByName(parents.select(F.col("to_id").alias("id"))).unionByName(spouses.select("id")).distinct()
    alone = people.select("id").join(linked, "id", "left_anti").select(F.lit("alone").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(0).cast("long").alias("n_children"))
    return couples.unionByName(single).unionByName(alone)
