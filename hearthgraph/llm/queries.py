"""Queries of the thirteen operators over the driver's tables, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, exact_dedup, html_blocks, jaccard_join, language, media, minhash, mixing, negatives, segment, suffix_dedup, toxicity, transcripts
from .common import crc_mod, cut, documents


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_mod("doc_id", 3) == 1
    model = language.fit(docs.where(~held_out))
    return language.predict(docs, model).withColumn("held_out", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.production(documents(spark, sf_dir))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(documents(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir)).drop("kept")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(documents(spark, sf_dir))


def toxic_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_mod("doc_id", 5) != 0).select("doc_id", "toxic")
    return toxicity.fit(documents(spark, sf_dir).select("doc_id", "text").join(labels, "doc_id"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(documents(spark, sf_dir), toxic_model(spark, sf_dir))
    return scored.withColumn("held_out", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)))


#: Where the vocabulary of pieces lies on every executor.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op7_segmentation(spark: SparkSession, sf_dir: str, model_file: str = PIECE_MODEL) -> DataFrame:
    return segment.encode(documents(spark, sf_dir), model_file)


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts are made from the turns, every role is recovered from the raw lines, and held against the table."""
    chunks = cut(transcripts.from_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    held_out = F.pmod(F.crc32(F.col("key").cast("binary")), F.lit(3)) == 1
    model = transcripts.fit(chunks.where(~held_out))
    found = transcripts.parse(chunks, model).withColumnRenamed("states", "found")
    right = F.size(F.filter(F.arrays_zip("states", "found"), lambda x: F.floor(x["states"] / 2) == F.floor(x["found"] / 2)))
    return found.join(chunks, ["key", "chunk"]).select(
        F.when(F.col("key") != "none", F.col("key")).cast("long").alias("conv_id"), "chunk", held_out.alias("held_out"), "n_lines", "n_turns", right.cast("long").alias("n_right"), "canonical"
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classify(documents(spark, sf_dir))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.dedup(documents(spark, sf_dir))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Where the byte-level vocabulary lies on every executor.
BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"


def op13_alignment(spark: SparkSession, sf_dir: str, a_file: str = BYTE_LEVEL, b_file: str = PIECE_MODEL) -> DataFrame:
    return align.align(documents(spark, sf_dir), a_file, b_file)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        op1_language, op2_mixing, op3_media, op4_suffix_dedup, op5_jaccard_join, op6_toxicity, op7_segmentation, op8_main_text, op9_transcripts, op10_exact_dedup,
        op11_minhash, op12_negatives, op13_alignment,
    )
    return {f.__name__: f for f in made}


def _level(name: str, above: list[str], source: str, weight: str) -> str:
    """SQL of one level's shares: a child is saturated while its capacity is within its share of what is left."""
    keys = ", ".join([*above, name])
    part = f"PARTITION BY {', '.join(above)}" if above else ""
    parent = f"JOIN {source} p USING ({', '.join(above)})" if above else f"CROSS JOIN {source} p"
    return f"""
      {name}_n AS (SELECT {keys}, sum(tokens) * 2 AS capacity, {weight} AS w FROM leaves GROUP BY {keys}),
      {name}_o AS (
        SELECT n.*, p.b - coalesce(sum(n.capacity) OVER before, 0) AS rest, sum(n.w) OVER after AS ws, n.capacity / n.w AS ratio
        FROM {name}_n n {parent}
        WINDOW before AS ({part} ORDER BY n.capacity / n.w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
               after AS ({part} ORDER BY n.capacity / n.w, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
      {name}_c AS (
        SELECT *, max(CASE WHEN capacity * ws > rest * w THEN 1 ELSE 0 END) OVER ({part} ORDER BY ratio, {name} ROWS UNBOUNDED PRECEDING) AS open
        FROM {name}_o),
      {name}_f AS (
        SELECT {", ".join(above) + "," if above else ""} arg_min(rest, (ratio, {name})) AS rest0, arg_min(ws, (ratio, {name})) AS ws0
        FROM {name}_c WHERE open = 1 {"GROUP BY " + ", ".join(above) if above else ""}),
      {name}_b AS (
        SELECT {", ".join("c." + k for k in [*above, name])},
               CAST(CASE WHEN open = 0 THEN capacity ELSE (greatest(rest0, 0) * w) // ws0 END AS BIGINT) AS b
        FROM {name}_c c LEFT JOIN {name}_f f {"USING (" + ", ".join(above) + ")" if above else "ON true"})"""


OP2_SQL = f"""
WITH base AS (
  SELECT doc_id,
    CASE WHEN length(regexp_extract(source, '([0-9]+)', 1)) BETWEEN 1 AND 9
         THEN 'd' || CAST(CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT) % 3 AS VARCHAR) ELSE 'other' END AS domain,
    coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
    CAST((coalesce(strlen(text), 0) + 3) // 4 AS BIGINT) AS tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM base GROUP BY ALL),
total AS (SELECT CAST((sum(tokens) * 700) // 1000 AS BIGINT) AS b FROM leaves),
{_level("domain", [], "total", "CASE domain WHEN 'd0' THEN 3 WHEN 'd1' THEN 2 WHEN 'd2' THEN 1 ELSE 1 END")},
{_level("lang", ["domain"], "domain_b", "CASE lang WHEN 'en' THEN 5 WHEN 'fr' THEN 2 WHEN 'de' THEN 2 WHEN 'es' THEN 1 ELSE 1 END")},
{_level("source", ["domain", "lang"], "lang_b", "1")},
plan AS (
  SELECT domain, lang, source, CASE WHEN tokens > 0 THEN b // tokens ELSE 0 END AS full_, CASE WHEN tokens > 0 THEN b % tokens ELSE 0 END AS rest_
  FROM leaves JOIN source_b USING (domain, lang, source)),
placed AS (
  SELECT base.*, full_, rest_, sum(tokens) OVER (
    PARTITION BY domain, lang, source ORDER BY md5('17:' || full_ || ':' || coalesce(CAST(doc_id AS VARCHAR), 'none'))
    RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
  FROM base JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, tokens, CAST(full_ + CASE WHEN running <= rest_ THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM placed WHERE full_ > 0 OR running <= rest_
"""

OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents),
k AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY cp DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT vec_id, label, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM v),
p AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(sum(a.x * b.x) AS BIGINT) AS score
  FROM c a JOIN c b USING (k) WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL),
pos AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN p USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": OP2_SQL, "op10_exact_dedup": OP10_SQL, "op12_negatives": OP12_SQL}
