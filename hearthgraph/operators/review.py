"""Review of evidence and people: votes, strict winners, work lists, merges of tables and feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..carriers import AS_OF

#: Hundredths of a vote for a district by where it comes from.
VOTES = {"own": 100, "marriage": 75, "sibling": 65, "child": 55, "parents": 50, "spouse": 35}
#: The first reason that holds turns a record away; shared text, as both engines read it.
FIREWALL = f"""CASE WHEN year < 1500 OR year > {AS_OF} THEN 'year out of range' WHEN record_type IN ('death', 'burial', 'probate') AND year < be THEN 'death before birth'
    WHEN record_type = 'marriage' AND year < be + 14 THEN 'marriage too early' WHEN record_type = 'birth' AND year > dl THEN 'birth after death'
    WHEN regexp_like(coalesce(surname, ''), '[^A-Za-z -]') OR regexp_like(coalesce(given, ''), '[^A-Za-z -]') THEN 'name' WHEN length(coalesce(surname, '') || coalesce(given, '')) > 100 THEN 'name too long' ELSE 'ok' END"""


def district_votes(records: DataFrame, parents: DataFrame, spouses: DataFrame) -> DataFrame:
    """id, district, score: summed votes of own and kin's births and marriages, at most 1. Records without district have no vote."""
    own = records.where("district IS NOT NULL")
    births, weddings = (own.where(F.col("record_type") == t).select(F.col("profile_id").alias("kin"), "district") for t in ("birth", "marriage"))
    up = parents.select(F.col("to_id").alias("id"), F.col("from_id").alias("kin")).distinct()
    mates = spouses.select("id", F.col("other").alias("kin")).distinct()
    sibs = up.join(up.select(F.col("id").alias("sib"), "kin"), "kin").where("id <> sib").select("id", F.col("sib").alias("kin")).distinct()
    vote = lambda df, how: df.select("id", "district", F.lit(VOTES[how]).alias("v"))
    self_ = lambda df: df.withColumnRenamed("kin", "id")
    down = up.select(F.col("kin").alias("id"), F.col("id").alias("kin"))
    parts = [
        vote(self_(births), "own"), vote(self_(weddings), "marriage"), vote(sibs.join(births, "kin"), "sibling"),
        vote(down.join(births, "kin"), "child"), vote(up.join(weddings, "kin"), "parents"), vote(mates.join(births, "kin"), "spouse"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("id", "district").agg((F.least(F.sum("v"), F.lit(100)) / 100.0).alias("score"))


def modal_surnames(records: DataFrame, common: tuple[str, ...]) -> DataFrame:
    """profile_id, modal (the most frequent surnames, joined in order), is_common: whether one of them is common."""
    n = records.where("surname IS NOT NULL").groupBy("profile_id", "surname").agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("top", F.max("n").over(Window.partitionBy("profile_id"))).where("n = top")
    return n.groupBy("profile_id").agg(F.array_join(F.array_sort(F.collect_list("surname")), ",").alias("modal"), F.bool_or(F.col("surname").isin(*common)).alias("is_common"))


def strict_winners(records: DataFrame) -> DataFrame:
    """profile_id, record_type, record_id: of two or more records the one whose tier alone is highest."""
    by = Window.partitionBy("profile_id", "record_type")
    r = records.withColumns({"n": F.count(F.lit(1)).over(by), "top": F.max("tier").over(by)}).where("n > 1 AND tier = top")
    return r.groupBy("profile_id", "record_type").agg(F.count(F.lit(1)).alias("k"), F.min("record_id").alias("record_id")).where("k = 1").drop("k")


def registration_matches(records: DataFrame, people: DataFrame) -> DataFrame:
    """year, volume, page, n_grooms, n_brides, status of each marriage registration: counted, so a crowded page makes no pairs."""
    m = records.where("record_type = 'marriage' AND year IS NOT NULL").join(people.select(F.col("id").alias("profile_id"), "gender"), "profile_id")
    side = lambda g: F.count_distinct(F.when(F.col("gender") == g, F.col("profile_id")))
    k = m.groupBy("year", F.upper("volume").alias("volume"), F.upper("page").alias("page")).agg(side("male").alias("n_grooms"), side("female").alias("n_brides"))
    return k.withColumn("status", F.when((F.col("n_grooms") == 0) | (F.col("n_brides") == 0), "none").when((F.col("n_grooms") == 1) & (F.col("n_brides") == 1), "unique").otherwise("ambiguous"))


def fetch_list(records: DataFrame, spouses: DataFrame) -> DataFrame:
    """id, volume, page, year: marriage registrations that a spouse holds and the person does not."""
    keys = records.where("record_type = 'marriage' AND year IS NOT NULL").select(F.col("profile_id").alias("id"), "volume", "page", "year").distinct()
    theirs = spouses.select("id", "other").join(keys.withColumnRenamed("id", "other"), "other").select("id", "volume", "page", "year").distinct()
    return theirs.join(keys, ["id", "volume", "page", "year"], "left_anti")


def name_consensus(records: DataFrame, least: int = 5, share: float = 0.7, runner_up: float = 0.2) -> DataFrame:
    """profile_id, given, n, first_year, last_year: the given name that most of a person's records bear, if clearly so."""
    g = records.where("given IS NOT NULL").groupBy("profile_id", "given").agg(F.count(F.lit(1)).alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    by, ranked = Window.partitionBy("profile_id"), Window.partitionBy("profile_id").orderBy(F.desc("n"), "given")
    g = g.withColumns({"total": F.sum("n").over(by), "second": F.lead("n").over(ranked), "r": F.row_number().over(ranked)})
    good = (F.col("total") >= least) & (F.col("n") >= share * F.col("total")) & (F.coalesce("second", F.lit(0)) <= runner_up * F.col("total"))
    return g.where(good & (F.col("r") == 1)).select("profile_id", "given", "n", "first_year", "last_year")


def narrower(e1: Column, l1: Column, e2: Column, l2: Column) -> Column:
    """write if the second range is strictly narrower than the first, else keep; an open range is infinitely wide."""
    return F.when((l2 - e2).isNotNull() & ((l1 - e1).isNull() | (l2 - e2 < l1 - e1)), "write").otherwise("keep")


def convergence_score(n: Column) -> Column:
    """0, 0.5, 0.75 for none, one, two lineages; 0.9 for three and 0.03 more for each further one, up to 1."""
    return F.when(n <= 0, 0.0).when(n == 1, 0.5).when(n == 2, 0.75).otherwise(F.round(F.least(F.lit(1.0), 0.9 + 0.03 * (n - 3)), 4))


def coverage(people: DataFrame, sourced: Column, fields: tuple[str, ...]) -> DataFrame:
    """field, n_valued, n_sourced, percent: how many people's values of a field have a source; one pass over the people."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).isNotNull().alias("valued")) for c in fields]))
    g = people.select(sourced.alias("s"), each.alias("x")).where("x.valued").groupBy("x.field").agg(F.count(F.lit(1)).alias("n_valued"), F.sum(F.col("s").cast("long")).alias("n_sourced"))
    return g.withColumn("percent", F.round(100.0 * F.col("n_sourced") / F.col("n_valued")).cast("long"))


def recent(branches: dict[str, DataFrame], limit: int) -> DataFrame:
    """kind, id, year: the latest `limit` rows of each branch (id, year), undated ones left out; ties by id."""
    out = None
    for kind, df in branches.items():
        part = df.where("year IS NOT NULL").orderBy(F.desc("year"), "id").limit(limit).select(F.lit(kind).alias("kind"), "id", "year")
        out = part if out is None else out.unionByName(part)
    return out


def with_kin(focus: DataFrame, parents: DataFrame, spouses: DataFrame) -> DataFrame:
    """The given people and their parents, children and spouses, each once."""
    steps = [parents.select(F.col("to_id").alias("id"), F.col("from_id").alias("kin")), parents.select(F.col("from_id").alias("id"), F.col("to_id").alias("kin")), spouses.select("id", F.col("other").alias("kin"))]
    out = focus.select("id")
    for s in steps:
        out = out.unionByName(s.join(focus.select("id"), "id", "left_semi").select(F.col("kin").alias("id")))
    return out.distinct()


def upsert(target: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Rows of both tables by key; an update's value wins where it is not null. Both have the same columns."""
    cols = [c for c in target.columns if c != key]
    new = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols])
    return target.join(new, key, "full_outer").select(key, *[F.coalesce(f"_new_{c}", c).alias(c) for c in cols])


def insert_missing(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The target and those rows whose key it lacks."""
    return target.unionByName(rows.join(target.select(key), key, "left_anti").select(*target.columns))


def cascade(rows: DataFrame, removed: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows none of whose keys is among the removed ids."""
    for k in keys:
        rows = rows.join(removed.select(F.col("id").alias(k)), k, "left_anti")
    return rows


def reconcile(source: DataFrame, published: DataFrame, key: str) -> DataFrame:
    """key, action, checksum that make the published table equal the source: insert, update, skip or delete, by
    row checksum. Values are hashed with their lengths before them, nulls as -, so different rows have different ones."""
    cols = [c for c in source.columns if c != key]
    mark = lambda df: F.sha2(F.concat_ws("", *[F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in cols]).cast("binary"), 256)
    a, b = source.select(key, mark(source).alias("checksum")), published.select(key, mark(published).alias("_old"))
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("checksum").isNull(), "delete").when(F.col("_old") == F.col("checksum"), "skip").otherwise("update")
    return a.join(b, key, "full_outer").select(key, action.alias("action"), "checksum")


def merged_windows(reports: DataFrame) -> DataFrame:
    """source, day, n, started from reports (source, day, n, started) in any order: a newer day replaces, one day keeps the highest count and earliest start."""
    per_day = reports.groupBy("source", "day").agg(F.max("n").alias("n"), F.min("started").alias("started"))
    return per_day.groupBy("source").agg(F.max(F.struct("day", "n", "started")).alias("x")).select("source", "x.day", "x.n", "x.started")


def suppressed(searches: DataFrame, keys: list[str], at: Column, days: int = 90) -> DataFrame:
    """keys, suppress: whether the last search is at most `days` old, the last day included."""
    last = searches.groupBy(*keys).agg(F.max("ts").alias("last"))
    return last.select(*keys, (F.col("last") + F.make_dt_interval(F.lit(days)) >= at).alias("suppress"))


def first_seen(events: DataFrame) -> DataFrame:
    """user_id, kinds: each user's event types in the order of their first event."""
    g = events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("pos"))
    g = g.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("pos", "event_type"))).alias("x"))
    return g.select("user_id", F.array_join(F.transform("x", lambda s: s["event_type"]), ",").alias("kinds"))
