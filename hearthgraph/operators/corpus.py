"""Retrieval from prose: token tables of a corpus and weighted search over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Capitalised words that are no surnames - months, days, common words, kin, places and titles.
STOPWORDS = tuple("""
JANUARY FEBRUARY MARCH APRIL MAY JUNE JULY AUGUST SEPTEMBER OCTOBER NOVEMBER DECEMBER
JAN FEB MAR APR JUN JUL AUG SEP SEPT OCT NOV DEC
MONDAY TUESDAY WEDNESDAY THURSDAY FRIDAY SATURDAY SUNDAY
THE AND FOR WITH FROM INTO OUT OUR HIS HER THEY THEIR WHO WHOM WHICH WHEN WHERE WHAT WHILE AFTER BEFORE
BORN DIED MARRIED BURIED BAPTISED BAPTIZED CHRISTENED AGED DAUGHTER SON WIFE HUSBAND FATHER MOTHER BROTHER SISTER CHILD
PARISH CHURCH CHAPEL VILLAGE TOWN COUNTY STREET ROAD LANE ENGLAND BRITAIN GREAT UNITED KINGDOM
MISTER MRS MISS REV REVEREND GENERATION PAGE PEDIGREE
""".split())
#: Fixed value: what a surname token looks like.
TOKEN = "[A-Za-z][A-Za-z']{2,}"


def surname_tokens(text: Column) -> Column:
    """Capitalised words of at least three letters, without 's or apostrophes at the end, in upper case, stop words left out."""
    words = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    upper = F.transform(F.filter(words, lambda w: w.rlike("^[A-Z]")), lambda w: F.upper(F.regexp_replace(F.regexp_replace(w, "'[sS]$", ""), "'+$", "")))
    return F.filter(upper, lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS))


def year_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("\\b(1[5-9][0-9][0-9])\\b"), F.lit(1))


def counts(docs: DataFrame, tokens: Column, name: str, id_col: str = "doc_id") -> DataFrame:
    """page, token, n: one row for each token of each page."""
    return docs.select(F.col(id_col).alias("page"), F.explode(tokens).alias(name)).groupBy("page", name).agg(F.count(F.lit(1)).alias("n"))


def word_count(text: Column, word: str) -> Column:
    """How often a word occurs as a whole word, in any case."""
    return F.regexp_count(F.coalesce(F.lower(text), F.lit("")), F.lit(f"(?<!\\w)\\Q{word.lower()}\\E(?!\\w)")).cast("long")


def retrieve(docs: DataFrame, surname: str, years: list[str], places: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """page, score: 3 for each mention of the surname, 2 for each wanted year, 1 for each wanted place; pages without the surname are out."""
    t = F.col(text_col)
    gate = docs.where(F.upper(t).contains(surname)).select(F.col(id_col).alias("page"), t.alias("_t"))
    hits = gate.select(
        "page",
        F.size(F.filter(surname_tokens(F.col("_t")), lambda w: w == surname)).cast("long").alias("sc"),
        F.size(F.array_intersect(F.array_distinct(year_tokens(F.col("_t"))), F.array(*map(F.lit, years)))).cast("long").alias("yc"),
        sum([(word_count(F.col("_t"), p) > 0).cast("long") for p in places], F.lit(0).cast("long")).alias("pc"),
    )
    return hits.where("sc > 0").select("page", (F.col("sc") * 3 + F.col("yc") * 2 + F.col("pc")).alias("score"))


def content_id(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the text without repeated white space; null counts as empty."""
    return F.substring(F.sha2(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t\\r\\n]+", " ")).cast("binary"), 256), 1, 16)


def plain_text(html: Column) -> Column:
    """Tags become spaces, the five common entities characters; white space is collapsed."""
    t = F.regexp_replace(html, "<[^>]*>", " ")
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(c))
    return F.trim(F.regexp_replace(t, "[ \\t\\r\\n]+", " "))


def refresh(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, change: inserted, updated, unchanged or removed between two versions of a table."""
    a, b = old.select(F.col(key), F.col(value).alias("_a"), F.lit(1).alias("_in_a")), new.select(F.col(key), F.col(value).alias("_b"), F.lit(1).alias("_in_b"))
    change = F.when(F.col("_in_a").isNull(), "inserted").when(F.col("_in_b").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("updated")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))
