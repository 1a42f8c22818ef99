"""Exact deduplication by 128-bit content hash, with the bytes of each group compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed by the contract: white space that does not count.
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def content_hash(norm: Column) -> Column:
    return F.md5(norm.cast("binary"))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_fn=content_hash) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by a 128-bit hash of the normalised text, and inside each hash group the aggregation's key is
    the text itself, so bytes are compared and a collision splits the group. Copies collapse before the shuffle, so
    a text that a third of all rows hold costs one row per task. Members find their class by hash and SHA-256, in a
    plain join whose hot keys adaptive execution splits.

    Null text counts as empty. The row with the most code points stays, then the smallest id; null ids come last
    (a kept row without id has keep_id null). Rows repeated whole: each is returned, all of them marked like the
    first. Other columns are ignored, so their names cannot clash.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    base = base.select("_id", F.char_length(F.coalesce("_t", F.lit(""))).alias("_cp"), normalised(F.col("_t")).alias("_n"))
    base = base.withColumns({"_h": hash_fn(F.col("_n")), "_sha": F.sha2(F.col("_n").cast("binary"), 256)})
    # one decimal holds length and id: a fixed-width value keeps the aggregation in hash tables
    order = F.expr("CAST(_cp AS DECIMAL(10,0)) * 100000000000000000000BD - coalesce(CAST(_id AS DECIMAL(20,0)), 9300000000000000000BD)")
    texts = base.groupBy("_h", "_n").agg(F.max(order).alias("_best"), F.count(F.lit(1)).alias("group_size"), F.max("_cp").alias("_top"))
    kept_id = F.expr("CAST(_top AS DECIMAL(10,0)) * 100000000000000000000BD - _best")
    classes = texts.select(
        "_h", F.sha2(F.col("_n").cast("binary"), 256).alias("_sha"), "group_size",
        F.when(kept_id < F.expr("9300000000000000000BD"), kept_id.cast("long")).alias("keep_id"),
    )
    return base.select("_id", "_h", "_sha").join(classes, ["_h", "_sha"]).select(
        F.col("_id").alias(id_col), "keep_id", "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_sha").alias("text_sha256"),
    )


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. A row repeated whole with its id stays as often as it came."""
    kept = classify(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("_kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_kept_id"]), "left_semi")
