"""Mixing sources to target weights with hierarchical budgets. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Up to so many leaves (about 100 bytes each) their budgets are broadcast; beyond, joined by key.
BROADCAST_LEAVES = 50_000



@dataclass(frozen=True)
class Mix:
    """Targets of a mixture.

    weights: per level, name of a node to its integer weight among its siblings (others: default_weight).
    budget_permille: tokens to select, in thousandths of the tokens there are. max_epochs: how often a leaf may be
    read in full. seed: of the epochs' orders.
    """

    levels: tuple[str, ...] = ("domain", "lang", "source")
    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    default_weight: int = 1
    budget_permille: int = 700
    max_epochs: int = 2
    seed: int = 17


#: Fixed values of the production mixture: sources fall into three domains by their number.
PRODUCTION = Mix(weights={"domain": {"d0": 3, "d1": 2, "d2": 1}, "lang": {"en": 5, "fr": 2, "de": 2, "es": 1}})


def token_count(text: Column) -> Column:
    """Tokens are counted as UTF-8 bytes over four, rounded up; null or empty text has none."""
    return F.shiftright(F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 3, 2)


def domain_of(source: Column) -> Column:
    number = F.regexp_extract(source, "([0-9]+)", 1)
    return F.when((number != "") & (F.length(number) < 10), F.concat(F.lit("d"), F.pmod(number.cast("long"), F.lit(3)).cast("string"))).otherwise("other")


def _share(nodes: DataFrame, parents: DataFrame | None, keys: list[str], mix: Mix, total: DataFrame | None) -> DataFrame:
    """Divide each parent's budget among its children: in proportion to weight, no child beyond its capacity.

    A child whose capacity is below its share keeps its capacity and the rest goes to its siblings; as a parent's
    capacity is the sum of its children's, only what no sibling can take is left to the parent's own siblings.
    Children are taken by capacity per weight; the first that can take its share of what remains ends the saturated
    ones. Integers throughout; the floor's remainder (under one token per child) is not handed out.
    """
    level, above = keys[-1], keys[:-1]
    known = mix.weights.get(level, {})
    weight = F.lit(mix.default_weight)
    for name, w in sorted(known.items()):
        weight = F.when(F.col(level) == name, F.lit(w)).otherwise(weight)
    nodes = nodes.withColumn("_w", weight.cast("long"))
    if parents is None:
        nodes = nodes.crossJoin(F.broadcast(total))  # one row
    else:
        nodes = nodes.join(parents, above)
    by = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("capacity") / F.col("_w"), level)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    nodes = nodes.withColumns({"_left": F.col("_b") - F.coalesce(F.sum("capacity").over(before), F.lit(0)), "_ws": F.sum("_w").over(after)})
    open_ = F.col("capacity") * F.col("_ws") > F.col("_left") * F.col("_w")
    nodes = nodes.withColumn("_open", F.max(F.when(open_, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first = F.struct("_left", "_ws")
    nodes = nodes.withColumn("_at", F.first(F.when(F.col("_open") == 1, first), ignorenulls=True).over(by.orderBy("_open", F.col("capacity") / F.col("_w"), level).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    budget = F.when(F.col("_open") == 0, F.col("capacity")).otherwise(F.expr("(greatest(_at._left, 0) * _w) div _at._ws"))
    return nodes.select(*keys, budget.cast("long").alias("_b"))


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves: the levels' columns and tokens; returns them with budget. The tree is a few rows per source."""
    keys = list(mix.levels)
    leaves = leaves.withColumn("capacity", F.col("tokens") * mix.max_epochs)
    total = leaves.agg(F.expr(f"(sum(tokens) * {mix.budget_permille}) div 1000").alias("_b"))
    parents = None
    for i in range(1, len(keys) + 1):
        nodes = leaves.groupBy(*keys[:i]).agg(F.sum("capacity").alias("capacity"))
        parents = _share(nodes, parents, keys[:i], mix, total)
    return leaves.drop("capacity").join(parents.withColumnRenamed("_b", "budget"), keys)


def select(docs: DataFrame, mix: Mix, level_cols: dict[str, Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, levels, tokens, copies): which documents each leaf contributes, and in how many epochs.

    Epoch e reads a leaf in the order of md5(seed:e:id). A leaf gets whole epochs while its budget lasts, then the
    prefix of the next epoch whose running token count stays within what is left. The running count is taken over
    buckets of the hash first, then inside the one bucket where the budget ends, so a leaf with a third of all rows
    is never sorted in one task.

    Null levels become 'none', null ids order as the text 'none', documents without tokens are part of whole
    epochs and of the prefix before its end. Rows repeated whole count each time; those with one id share a place
    in the order and are taken or left together.
    """
    keys = list(mix.levels)
    base = docs.select(
        F.col(id_col).alias("_id"), *[F.coalesce(level_cols[k].cast("string"), F.lit("none")).alias(k) for k in keys], token_count(F.col(text_col)).alias("tokens")
    )
    base = cut(base)
    leaves = cut(leaf_budgets(base.groupBy(*keys).agg(F.sum("tokens").alias("tokens")), mix))
    plan = leaves.select(
        *keys,
        F.expr("CASE WHEN tokens > 0 THEN budget div tokens ELSE 0 END").alias("_full"),
        F.expr("CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END").alias("_rest"),
    )
    placed = base.join(F.broadcast(plan) if leaves.count() <= BROADCAST_LEAVES else plan, keys)
    digest = F.md5(F.concat(F.lit(f"{mix.seed}:"), F.col("_full").cast("string"), F.lit(":"), F.coalesce(F.col("_id").cast("string"), F.lit("none"))).cast("binary"))
    placed = placed.withColumn("_d", digest).withColumn("_bucket", F.substring("_d", 1, 4))
    buckets = placed.groupBy(*keys, "_bucket").agg(F.sum("tokens").alias("_bt"))
    running = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_before", F.coalesce(F.sum("_bt").over(running), F.lit(0)))
    in_bucket = Window.partitionBy(*keys, "_bucket").orderBy("_d").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = placed.join(buckets, [*keys, "_bucket"]).withColumn("_part", F.col("_before") + F.sum("tokens").over(in_bucket) <= F.col("_rest"))
    rows = rows.withColumn("copies", (F.col("_full") + F.when(F.col("_part"), 1).otherwise(0)).cast("long"))
    return rows.where("copies > 0").select(F.col("_id").alias(id_col), *keys, "tokens", "copies")


def mixed(docs: DataFrame, mix: Mix, level_cols: dict[str, Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents themselves, each as often as its leaf's epochs take it. Columns of any name stay as they are."""
    cols = docs.columns
    # names that no column of the documents has
    prefix = "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in cols), default=0))
    mix_id, copies, copy = (prefix + n for n in ("mix_id", "copies", "copy"))
    chosen = select(docs, mix, level_cols, id_col, text_col).groupBy(F.col(id_col).alias(mix_id)).agg(F.max("copies").alias(copies))
    out = docs.join(chosen, docs[id_col].eqNullSafe(chosen[mix_id]))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(*[F.col(f"`{c}`") for c in cols])


def production(docs: DataFrame, mix: Mix = PRODUCTION) -> DataFrame:
    return select(docs, mix, levels_of_documents())


def levels_of_documents() -> dict[str, Column]:
    return {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}


__all__ = ["Mix", "PRODUCTION", "leaf_budgets", "mixed", "production", "select"]
