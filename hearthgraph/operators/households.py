"""Census households: what a roster says of the subject's family, held against the edges of the tree.

Rosters are rows of members: event, n (place in the schedule), subject_id, year, name, role (towards the head), age,
birth_year, sex, target. A household lists each person once and everything below stays within one household and one
subject's nearest relatives, so each pair of a member and a relative is looked at once and the rungs are aggregates over
those pairs. Only the search of the whole tree joins by keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import names

#: Ages on schedules are approximate.
YEARS = 3
#: Roles of people who live in a household without belonging to the family.
NON_FAMILY = ("servant", "boarder", "lodger", "visitor", "nurse", "employee", "apprentice", "governess", "housekeeper", "assistant", "worker", "inmate")
#: Written short forms of roles, read only as a whole.
SHORT = {
    "head": ("hd",), "spouse": ("wf", "hus", "husb"), "child": ("dau", "daur", "daug", "daughtr"),
    "parent": ("fa", "fathr", "mo", "mothr"), "sibling": ("bro", "brothr", "sis", "sistr"),
}
#: Words of roles, the first that is found counts.
WORDS = {"head": ("head",), "spouse": ("wife", "husband"), "child": ("son", "daughter"), "parent": ("father", "mother"), "sibling": ("brother", "sister")}
#: Words that make a role something else than the relation it holds.
FURTHER = ("'", "in law", "in-law", "grand", "step", "foster", "adopt")
#: The member's relation to the subject, by the relation of both to the head.
MATRIX = {
    ("head", "spouse"): "spouse", ("head", "child"): "child", ("head", "parent"): "parent", ("head", "sibling"): "sibling",
    ("spouse", "head"): "spouse", ("spouse", "child"): "child",
    ("child", "head"): "parent", ("child", "spouse"): "parent", ("child", "child"): "sibling",
}
#: What is known of a household by its target row.
ANCHOR = ("n_targets", "target_n", "subject_category", "is_head")
#: Relatives are looked through in this order.
ORDER = ("parent", "child", "spouse", "sibling")


def category(role: Column) -> Column:
    """head, spouse, child, parent or sibling; null for other kin, people outside the family and empty roles."""
    return _category(F.lower(F.trim(role)))


def _category(r: Column) -> Column:
    # one pattern for all words: a test for each makes code that is too long to be compiled
    has = lambda words: r.rlike("|".join(words))
    out = F.when((r == "") | has(FURTHER + NON_FAMILY), None)
    for name, forms in SHORT.items():
        out = out.when(r.isin(*forms), name)
    for name, words in WORDS.items():
        out = out.when(has(words), name)
    return out


def relation(subject: Column, member: Column) -> Column:
    """What a member of one category is to a subject of another; null beyond the nearest family."""
    out = F.lit(None).cast("string")
    for (s, m), r in MATRIX.items():
        out = F.when((subject == s) & (member == m), r).otherwise(out)
    return out


def parent_in_law(role: Column) -> Column:
    """mother or father, of the head's spouse; null for other roles."""
    r = F.regexp_replace(F.lower(role), r"[^\p{L}]", "")
    return F.when(~r.endswith("law") | r.rlike("^(son|dau|bro|sis)"), None).when(r.rlike("^(mother|ma)"), "mother").when(r.rlike("^(father|fa|pa)"), "father")


def _words(name: Column) -> Column:
    return F.array_remove(F.split(F.upper(F.coalesce(name, F.lit(""))), "[ ,]+"), "")


def _persons(people: DataFrame) -> DataFrame:
    """pid, first (given name) with its keys, known (surnames), born, gender."""
    first = F.get(F.array_remove(F.split(F.upper("given"), " "), ""), F.lit(0))
    known = F.array_distinct(F.array_remove(F.array(*[F.upper(F.trim(F.coalesce(c, F.lit("")))) for c in ("surname", "married_surname")]), ""))
    got = people.select(F.col("id").alias("pid"), first.alias("first"), known.alias("known"), F.col("bb").alias("born"), "gender")
    return got.withColumns(_keyed("", "first"))


_SEX_BAD = "coalesce((gender = 'male' AND sex = 'F') OR (gender = 'female' AND sex = 'M'), false)"
_NEAR_YEARS = f"coalesce(abs(born_by_roster - born) <= {YEARS}, false)"


def _keyed(prefix: str, first: str) -> dict[str, Column]:
    """The columns by which forenames that the audit's ladder rates 0.85 or more are equal, worked out once a row and not once a pair."""
    return dict(zip((f"{prefix}vowels", f"{prefix}full"), names.keys(F.col(first)), strict=True))


def _same_name() -> Column:
    return F.coalesce(F.expr("array_contains(known, m_surname) AND (m_vowels = vowels OR m_full = full)"), F.lit(False))


def members(rosters: DataFrame, *more: str) -> DataFrame:
    """Rosters with m_first, its keys and m_surname (none for a name of one word), born_by_roster, sex (first letter),
    category, and the columns `more`.

    What is read often comes out of a generator of one row, so nothing copies what rosters are made by."""
    once = F.struct("name", "role", _words(F.col("name")).alias("w"), F.lower(F.trim("role")).alias("r"), F.coalesce("birth_year", F.col("year") - F.col("age")).alias("born_by_roster"), F.upper(F.substring(F.trim("sex"), 1, 1)).alias("sex"))
    x = rosters.select("event", "n", "subject_id", "year", "target", *more, F.explode(F.array(once)).alias("x")).select("event", "n", "subject_id", "year", "target", *more, "x.*")
    own = x.withColumns({"m_first": F.get("w", F.lit(0)), "m_surname": F.when(F.size("w") > 1, F.element_at("w", -1)), "category": _category(F.col("r"))}).drop("w", "r")
    return own.withColumns(_keyed("m_", "m_first"))


def relatives(parents: DataFrame, spouses: DataFrame) -> DataFrame:
    """subject_id, pid, tree_relation (each kind once): parents, children, spouses and those who share a parent."""
    p = parents.select("from_id", "to_id").distinct()
    sib = p.withColumnRenamed("to_id", "subject_id").join(p.withColumnRenamed("to_id", "pid"), "from_id").where("subject_id <> pid").select("subject_id", "pid")
    parts = [p.select(F.col("to_id").alias("subject_id"), F.col("from_id").alias("pid")), p.select(F.col("from_id").alias("subject_id"), F.col("to_id").alias("pid")), spouses.select(F.col("id").alias("subject_id"), F.col("other").alias("pid")), sib]
    out = None
    for part, kind in zip(parts, ORDER, strict=True):
        one = part.select("subject_id", "pid", F.lit(kind).alias("tree_relation"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def reconcile(rosters: DataFrame, people: DataFrame, parents: DataFrame, spouses: DataFrame) -> DataFrame:
    """event, n, subject_id, name, relation, status, profile_id for each member of a household whose target row is its subject.

    The target row counts as its subject if its surname is one of the subject's, the years of birth lie within YEARS and
    the sex does not contradict, or if name and years agree. Relations need exactly one target row. Each member takes the
    first rung that holds; of several people on a rung, the one of the first kind in ORDER, then of the smallest id:

    subject; in_tree or contradiction (a relative of equal name and near years, in this or another relation); in_tree (a
    relative of equal name in this relation, if it is parent or spouse or either year is unknown); unlinked (someone else
    of equal name and near years); near (the only relative in this relation by sex and years, of equal surname but
    another forename, whom no other row takes or could be); missing. Members without relation: in_tree or in_law
    (parents-in-law of a head with one spouse), else out_of_scope.
    """
    who = cut(_persons(people))
    anchors = _anchored(rosters.where("target"), who)
    # the names and roles of households without a subject are not looked at
    return _rungs(rosters.join(anchors, "event"), who, parents, spouses)


def anchored(heads: DataFrame, people: DataFrame) -> DataFrame:
    """event and the columns ANCHOR of the households whose target row is its subject; `heads` are the target rows of rosters."""
    return _anchored(heads, _persons(people))


def reconcile_anchored(rosters: DataFrame, people: DataFrame, parents: DataFrame, spouses: DataFrame) -> DataFrame:
    """reconcile() for rosters of anchored households that have the columns ANCHOR already."""
    return _rungs(rosters, cut(_persons(people)), parents, spouses)


def in_laws(rosters: DataFrame, people: DataFrame, parents: DataFrame, spouses: DataFrame) -> DataFrame:
    """The rows of reconcile_anchored() with status in_law: event, n, name, status, profile_id.

    No rung for relatives decides these, so none is worked out."""
    m = _placed(rosters).where("relation IS NULL AND is_head")
    asked = cut(_asked_in_laws(m, "name"))
    names_ = asked.select("event", "n", "name")
    found = _in_laws(asked, _persons(people), parents, spouses).where("in_law IS NULL")
    return found.join(names_, ["event", "n"]).select("event", "n", "name", F.lit("in_law").alias("status"), F.col("spouse_id").alias("profile_id"))


def _anchored(heads: DataFrame, who: DataFrame) -> DataFrame:
    heads = members(heads).groupBy("event").agg(F.count(F.lit(1)).alias("n_targets"), F.min(F.struct("n", "m_first", "m_surname", "born_by_roster", "sex", "category", "role", "subject_id", "m_vowels", "m_full")).alias("t"))
    heads = heads.select("event", "n_targets", F.col("t.n").alias("target_n"), "t.m_vowels", "t.m_full", "t.m_surname", "t.born_by_roster", "t.sex", F.col("t.category").alias("subject_category"), F.lower("t.role").contains("head").alias("is_head"), F.col("t.subject_id").alias("pid"))
    known = heads.join(who, "pid").withColumn("same", _same_name()).where(f"{_NEAR_YEARS} AND (same OR (array_contains(known, m_surname) AND NOT {_SEX_BAD}))")
    return known.select("event", *ANCHOR)


def _placed(rosters: DataFrame) -> DataFrame:
    """Members of anchored households with their relation to the subject."""
    m = members(rosters, *ANCHOR)
    return m.withColumn("relation", F.when((F.col("n_targets") == 1) & F.col("m_first").isNotNull() & ~F.col("target"), relation(F.col("subject_category"), F.col("category"))))


def _rungs(rosters: DataFrame, who: DataFrame, parents: DataFrame, spouses: DataFrame) -> DataFrame:
    # written once: all rungs read them
    m, kin = cut(_placed(rosters).drop("subject_category", "category", "n_targets")), relatives(parents, spouses)
    own = m.where("relation IS NOT NULL").select("event", "n", "subject_id", "relation", "m_surname", "m_vowels", "m_full", "born_by_roster", "sex")
    pairs = own.join(kin.join(who.drop("first"), "pid"), "subject_id")
    pairs = pairs.withColumns({"same": _same_name(), "near_years": F.expr(_NEAR_YEARS), "in_role": F.col("relation") == F.col("tree_relation")})
    fits = f"in_role AND near_years AND NOT {_SEX_BAD}"
    # a pair of other names that does not fit either decides no rung
    pairs = pairs.select(
        "event", "n", "relation", "tree_relation", "pid", "same", "near_years", "in_role", F.expr(fits).alias("fits"), F.expr("born_by_roster IS NULL OR born IS NULL").alias("undated"),
        F.expr("NOT same AND coalesce(array_contains(known, m_surname), false)").alias("other_forename"),
    ).where("same OR fits")
    pairs = cut(pairs)
    rank = F.expr("CASE tree_relation " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(ORDER)) + " END")
    best = pairs.groupBy("event", "n").agg(
        F.min(F.when(F.col("same") & F.col("near_years"), F.struct(rank.alias("o"), "pid", "in_role"))).alias("exact"),
        F.min(F.expr("CASE WHEN same AND in_role AND (relation IN ('parent', 'spouse') OR undated) THEN pid END")).alias("by_role"),
        F.count(F.expr("CASE WHEN fits THEN 1 END")).alias("n_fit"), F.min(F.expr("CASE WHEN fits THEN struct(pid, other_forename, relation) END")).alias("fit"),
    )
    best = cut(best.withColumn("resolved", F.coalesce("exact.pid", "by_role")))
    # a candidate of the near rung falls to nobody if another row has it, or could have it as well
    taken = best.where("resolved IS NOT NULL").select("event", F.col("resolved").alias("pid")).distinct().withColumn("taken", F.lit(True))
    could = pairs.where("fits").join(best.where("resolved IS NULL").select("event", "n"), ["event", "n"]).groupBy("event", "pid", "relation").agg(F.count(F.lit(1)).alias("n_rivals"))
    near = best.where("resolved IS NULL AND n_fit = 1 AND fit.other_forename").select("event", "n", F.col("fit.pid").alias("pid"), F.col("fit.relation").alias("relation"))
    near = near.join(taken, ["event", "pid"], "left_anti").join(could.where("n_rivals = 1"), ["event", "pid", "relation"])
    known = best.where("resolved IS NOT NULL")
    elsewhere = _elsewhere(m.where("relation IS NOT NULL").join(known.select("event", "n"), ["event", "n"], "left_anti"), who)
    laws = _in_laws(_asked_in_laws(m.where("relation IS NULL AND is_head")), who, parents, spouses)
    # what the rungs found meets the members once
    found = (
        _rung(known, 0, "CASE WHEN NOT exact.in_role THEN 'contradiction' ELSE 'in_tree' END", "resolved").unionByName(_rung(laws.where("spouse_id IS NOT NULL"), 0, "CASE WHEN in_law IS NOT NULL THEN 'in_tree' ELSE 'in_law' END", "coalesce(in_law, spouse_id)"))
        .unionByName(_rung(elsewhere.where("elsewhere IS NOT NULL"), 1, "'unlinked'", "elsewhere")).unionByName(_rung(near, 2, "'near'", "pid"))
    )
    found = found.groupBy("event", "n").agg(F.min("found").alias("found"))
    rows = m.select("event", "n", "subject_id", "name", "year", "relation", "target", "target_n").join(found, ["event", "n"], "left")
    is_subject = F.col("target") & (F.col("n") == F.col("target_n"))
    status = F.when(is_subject, "subject").otherwise(F.coalesce("found.status", F.when(F.col("relation").isNull(), "out_of_scope").otherwise("missing")))
    whom = F.when(is_subject, F.col("subject_id")).otherwise(F.col("found.pid"))
    return rows.select("event", "n", "subject_id", "name", "year", F.when(~is_subject, F.col("relation")).alias("relation"), status.alias("status"), whom.alias("profile_id"))


def _rung(rows: DataFrame, rung: int, status: str, pid: str) -> DataFrame:
    return rows.select("event", "n", F.struct(F.lit(rung).alias("rung"), F.expr(status).alias("status"), F.expr(pid).alias("pid")).alias("found"))


def _elsewhere(open_: DataFrame, who: DataFrame) -> DataFrame:
    """event, n, elsewhere: the smallest id but the subject's of equal name and near years.

    Names are equal by the ladder's upper rungs if they share a key: plain vowels or the full form of a pet form. Each key keeps its two smallest ids."""
    keys = lambda c: F.array_distinct(F.array(*names.keys(F.col(c))))
    table = who.where("born IS NOT NULL AND first IS NOT NULL").select("pid", F.explode("known").alias("surname"), "born", F.explode(keys("first")).alias("key"))
    least = table.groupBy("surname", "key", "born").agg(F.min("pid").alias("lo"))
    next_ = table.join(least, ["surname", "key", "born"]).where("pid > lo").groupBy("surname", "key", "born").agg(F.min("pid").alias("next"))
    both = least.join(next_, ["surname", "key", "born"], "left")
    asked = open_.where("born_by_roster IS NOT NULL AND m_first IS NOT NULL").select("event", "n", "subject_id", F.col("m_surname").alias("surname"), F.explode(F.sequence(F.col("born_by_roster") - YEARS, F.col("born_by_roster") + YEARS)).alias("born"), keys("m_first").alias("ks"))
    asked = asked.select("event", "n", "subject_id", "surname", "born", F.explode("ks").alias("key"))
    return asked.join(both, ["surname", "born", "key"]).groupBy("event", "n").agg(F.min(F.expr("CASE WHEN lo <> subject_id THEN lo ELSE next END")).alias("elsewhere"))


def _asked_in_laws(rows: DataFrame, *more: str) -> DataFrame:
    return rows.where(parent_in_law(F.col("role")).isNotNull() & ~F.col("target")).select("event", "n", "subject_id", "m_vowels", "m_full", "m_surname", *more)


def _in_laws(asked: DataFrame, who: DataFrame, parents: DataFrame, spouses: DataFrame) -> DataFrame:
    """event, n, spouse_id, in_law: the head's only spouse and that spouse's parent of equal name, if there is one."""
    lone = spouses.select(F.col("id").alias("subject_id"), "other").distinct().groupBy("subject_id").agg(F.min("other").alias("spouse_id"), F.count(F.lit(1)).alias("c")).where("c = 1").drop("c")
    up = parents.select(F.col("to_id").alias("spouse_id"), F.col("from_id").alias("pid")).distinct().join(who, "pid")
    both = asked.join(lone, "subject_id").join(up, "spouse_id", "left").withColumn("same", _same_name())
    return both.groupBy("event", "n", "spouse_id").agg(F.min(F.when(F.col("same"), F.col("pid"))).alias("in_law"))


def findings(reconciled: DataFrame) -> DataFrame:
    """subject_id, kind, relation, name, profile_id: what is missing or contradicted, each name and relation once, by its first row."""
    rows = reconciled.where("relation IS NOT NULL")
    key = F.lower("name")
    first = rows.groupBy("subject_id", key.alias("who"), "relation").agg(F.min(F.struct("event", "n", "status", "name", "profile_id")).alias("x"))
    return first.where("x.status IN ('missing', 'contradiction')").select("subject_id", F.col("x.status").alias("kind"), "relation", "x.name", "x.profile_id")


def married_names(reconciled: DataFrame, rosters: DataFrame | None = None) -> DataFrame:
    """profile_id, maiden: a spouse's name at birth by the surname of a parent-in-law on the head's schedule, if all schedules agree.

    The rows have the names, so rosters are not read again; the argument is left for callers that give it."""
    w = _words(F.col("name"))
    found = reconciled.where("status = 'in_law'").select("profile_id", F.when(F.size(w) > 1, F.element_at(w, -1)).alias("m_surname")).where("m_surname IS NOT NULL")
    return found.groupBy("profile_id").agg(F.min("m_surname").alias("maiden"), F.max("m_surname").alias("_hi")).where("maiden = _hi").drop("_hi")
