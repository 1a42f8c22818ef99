"""Audit of a family graph: rules over people, parent edges, marriages and events, and the engine that runs them.

Every rule gives rows (profile_id, severity, related array<long>). A date rule is certain: it is an error when every
year within both ranges violates it, and a warning when only the ranges' middles do. Nulls never violate.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..carriers import AS_OF, DEALT, Catalog
from ..functions import names
from ..operators import duplicates

SEVERITIES = ("error", "warning", "info")


def _none() -> Column:
    return F.array().cast("array<long>")


@dataclass(frozen=True)
class Rule:
    """over: people, parent_pairs, marriages or edges. certain gives `severity`, likely gives a warning."""

    name: str
    category: str
    over: str = "people"
    certain: str = "false"
    likely: str = "false"
    severity: str = "error"
    subject: str = "id"
    related: str | None = None
    make: Callable[[Catalog], DataFrame] | None = None

    def rows(self, cat: Catalog) -> DataFrame:
        if self.make:
            return self.make(cat).select("profile_id", "severity", "related")
        found = F.when(F.expr(self.certain), self.severity).when(F.expr(self.likely), "warning")
        related = F.array(F.col(self.related)).cast("array<long>") if self.related else _none()
        return getattr(cat, self.over).select(F.col(self.subject).alias("profile_id"), found.alias("severity"), related.alias("related")).where("severity IS NOT NULL")


def _flag(df: DataFrame, severity: str, related: Column | None = None, subject: str = "id") -> DataFrame:
    related = _none() if related is None else related
    return df.select(F.col(subject).alias("profile_id"), F.lit(severity).alias("severity"), related.alias("related"))


def _parents_per_role(cat: Catalog) -> DataFrame:
    per = cat.parents.where("role IS NOT NULL").groupBy("to_id", "role").agg(F.array_sort(F.collect_set("from_id")).alias("ps"))
    return _flag(per.where("size(ps) >= 2"), "error", F.col("ps"), "to_id")


def _excess_parents(cat: Catalog) -> DataFrame:
    per = cat.parents.groupBy("to_id").agg(F.array_sort(F.collect_list("from_id")).alias("ps"))
    return _flag(per.where("size(ps) > 2"), "error", F.col("ps"), "to_id")


def _record_after_death(cat: Catalog) -> DataFrame:
    late = cat.life.where("kind <> 'baptism'").join(cat.people.where("dl IS NOT NULL").select("id", "dl"), F.col("profile_id") == F.col("id")).where("year > dl")
    return _flag(late.groupBy("id").agg(F.count(F.lit(1))), "error")


def _missing_co_parent(cat: Catalog) -> DataFrame:
    """One parent is known; the parent's spouse that also has another of its children is the only candidate."""
    one = cat.parents.groupBy("to_id").agg(F.min("from_id").alias("p"), F.max("from_id").alias("last")).where("p = last").select("to_id", "p")
    mates = cat.spouses.select(F.col("id").alias("p"), F.col("other").alias("mate")).distinct()
    sibs = cat.parents.select(F.col("from_id").alias("p"), F.col("to_id").alias("sib")).distinct()
    of_mate = cat.parents.select(F.col("from_id").alias("mate"), F.col("to_id").alias("sib")).distinct()
    got = one.join(mates, "p").join(sibs, "p").where("sib <> to_id").join(of_mate, ["mate", "sib"])
    got = got.groupBy("to_id").agg(F.min("mate").alias("mate"), F.max("mate").alias("last")).where("mate = last")
    return _flag(got, "warning", F.array("mate"), "to_id")


def _dateless(cat: Catalog) -> DataFrame:
    """No date of its own, but the kin's years put the birth over a hundred years back."""
    who = cat.people.where("coalesce(be, bl, de, dl) IS NULL").select("id")
    years = cat.people.select(F.col("id").alias("kin"), F.col("bb").alias("y")).where("y IS NOT NULL")
    kids = cat.parents.select(F.col("from_id").alias("id"), F.col("to_id").alias("kin"), F.lit("child").alias("how"))
    mates = cat.spouses.select("id", F.col("other").alias("kin"), F.lit("spouse").alias("how"))
    sibs = siblings(cat).select("id", F.col("sib").alias("kin"), F.lit("sibling").alias("how"))
    kin = who.join(kids.unionByName(mates).unionByName(sibs), "id").join(years, "kin")
    by = kin.groupBy("id").agg(*[f(F.when(F.col("how") == h, F.col("y"))).alias(h) for h, f in (("child", F.min), ("spouse", F.max), ("sibling", F.max))])
    return _flag(by.where(f"least(sibling + 20, spouse + 20, child - 14) + 100 < {AS_OF}"), "warning")


def siblings(cat: Catalog) -> DataFrame:
    """id, sib: people with a common parent, both ways."""
    a, b = cat.parents.select("from_id", F.col("to_id").alias("id")), cat.parents.select("from_id", F.col("to_id").alias("sib"))
    return a.join(b, "from_id").where("id <> sib").select("id", "sib").distinct()


def _duplicates(cat: Catalog) -> DataFrame:
    """One row for everyone with a possible duplicate of a greater id, naming the greatest; the others are in J13's tables."""
    return _flag(duplicates.greatest_partners(cat.dated, cat.parents), "warning", F.array("partner"), "id")


def _sibling_collision(cat: Catalog) -> DataFrame:
    """Siblings with the same parents and sex whose births collide while their forenames differ."""
    sets = cat.parents.groupBy(F.col("to_id").alias("id")).agg(F.array_sort(F.collect_set("from_id")).alias("ps")).where("size(ps) = 2")
    own = cat.people.where("given IS NOT NULL AND gender IS NOT NULL AND be IS NOT NULL AND bl IS NOT NULL").select("id", F.upper("given").alias("g"), "gender", "be", "bl").join(sets, "id")
    other = own.select(F.col("id").alias("o"), F.col("g").alias("o_g"), "gender", F.col("be").alias("o_be"), F.col("bl").alias("o_bl"), "ps")
    pairs = own.join(other.hint("merge"), ["ps", "gender"]).where("id < o AND be <= o_bl + 1 AND o_be <= bl + 1")
    return _flag(pairs.where(names.audit_similarity(F.col("g"), F.col("o_g")) < 0.7), "warning", F.array("o"))


def _orphan_stub(cat: Catalog) -> DataFrame:
    """A person without edges whose name someone with edges bears."""
    p = cat.people.where("given IS NOT NULL AND surname IS NOT NULL").select("id", F.upper("given").alias("g"), F.upper("surname").alias("s"), (F.col("n_parents") + F.col("n_children") + F.col("n_spouses")).alias("k"))
    linked = p.where("k > 0").groupBy("g", "s").agg(F.min("id").alias("first"))
    return _flag(p.where("k = 0").join(linked, ["g", "s"]), "warning", F.array("first"))


def _phantom_spouse(cat: Catalog) -> DataFrame:
    """A single edge, to a spouse, and neither dates nor places."""
    bare = cat.people.where("n_spouses = 1 AND n_parents + n_children = 0 AND coalesce(be, bl, de, dl) IS NULL").select("id")
    return _flag(bare.join(cat.spouses, "id"), "warning", F.array("other"))


def _married_surname(cat: Catalog) -> DataFrame:
    w = cat.people.where("gender = 'female' AND married_surname IS NULL").select("id", "surname")
    mates = cat.people.select(F.col("id").alias("other"), F.col("surname").alias("theirs")).where("theirs IS NOT NULL")
    got = w.join(cat.spouses.select("id", "other"), "id").join(mates, "other").where("surname IS NULL OR surname <> theirs").groupBy("id").agg(F.min("other").alias("other"))
    return _flag(got, "warning", F.array("other"))


#: Completeness counts six fields, and the death of those that do not live.
COMPLETE = "CASE WHEN given IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN surname IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN coalesce(be, bl) IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN birth_place IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN n_parents > 0 THEN 1 ELSE 0 END + CASE WHEN coalesce(length(bio), 0) > 0 THEN 1 ELSE 0 END + CASE WHEN NOT living AND coalesce(de, dl) IS NOT NULL THEN 1 ELSE 0 END"

RULES: tuple[Rule, ...] = (
    Rule("missingCoParent", "issue", make=_missing_co_parent),
    Rule("junkInName", "issue", certain="regexp_like(coalesce(given, '') || ' ' || coalesce(surname, ''), '[?()]')", severity="warning"),
    Rule("incompleteName", "research", certain="(given IS NULL) <> (surname IS NULL) OR length(given) = 1", severity="info"),
    Rule("datelessReadsAsLiving", "gap", make=_dateless),
    Rule("suspectLocation", "issue", certain="regexp_like(birth_place, '[?]') OR regexp_like(birth_place, ',$') OR birth_place = upper(birth_place) OR birth_place = lower(birth_place)", severity="info"),
    Rule("givenNameContainsMiddle", "issue", certain="regexp_like(trim(given), '[^ ] +[^ ]') AND middle IS NULL", severity="info"),
    Rule("completenessScore", "research", certain=f"{COMPLETE} < CASE WHEN living THEN 6 ELSE 7 END", severity="info"),
    Rule("birthBeforeDeath", "issue", certain="be > dl", likely="bb > db"),
    Rule("parentAgeGap", "issue", "parent_pairs", "p_bl + 14 > c_be", "p_bb + 14 > c_bb", subject="c_id", related="p_id"),
    Rule("impossibleParentage", "issue", "parent_pairs", "p_be + 12 > c_bl OR (role = 'father' AND p_gender = 'female') OR (role = 'mother' AND p_gender = 'male')", subject="c_id", related="p_id"),
    Rule("marriageAge", "issue", "marriages", "year - be < 16", "year - bb < 16", related="other"),
    Rule("muddledIdentity", "issue", certain="bl - be > 15 OR dl - de > 15", severity="warning"),
    Rule("lifespan", "issue", certain="de - bl > 110", likely="db - bb > 110"),
    Rule("noMarriageAfterDeath", "issue", "marriages", "year > dl", "year > db", related="other"),
    Rule("missingParents", "research", certain="n_parents = 0", severity="warning"),
    Rule("missingBirthDate", "research", certain="coalesce(be, bl) IS NULL", severity="warning"),
    Rule("missingDeathDate", "research", certain="coalesce(de, dl) IS NULL AND NOT living", severity="info"),
    Rule("missingBirthLocation", "research", certain="birth_place IS NULL", severity="warning"),
    Rule("missingBio", "research", certain="coalesce(bio, '') = ''", severity="info"),
    Rule("invalidDate", "issue", certain="(birth_raw IS NOT NULL AND birth_raw <> '?' AND coalesce(be, bl) IS NULL) OR (death_raw IS NOT NULL AND death_raw <> '?' AND coalesce(de, dl) IS NULL)"
         f" OR be > {AS_OF + 1} OR regexp_like(upper(coalesce(death_raw, '')), '^3[01] FEB|^31 (APR|JUN|SEP|NOV)')", severity="warning"),
    Rule("duplicateDetection", "issue", make=_duplicates),
    Rule("siblingIdentityCollision", "issue", make=_sibling_collision),
    Rule("parentDiedBeforeChild", "issue", "parent_pairs", "p_dl < c_be - 1", "p_db < c_bb - 1", subject="c_id", related="p_id"),
    Rule("parentSuspiciouslyOld", "issue", "parent_pairs", "c_be - p_bl > 55 OR c_bb - p_bb > 55", severity="warning", subject="c_id", related="p_id"),
    Rule("selfSpouse", "issue", "edges", "type = 'spouse' AND from_id = to_id", subject="from_id"),
    Rule("unsourcedBio", "issue", certain="length(bio) > 50 AND NOT regexp_like(bio, '<ref|[Ss]ources')", severity="warning"),
    Rule("missingDeathLocation", "research", certain="coalesce(de, dl) IS NOT NULL AND death_place IS NULL", severity="warning"),
    Rule("ancestorExtension", "research", certain="n_parents = 0 AND bb < 1920 AND lower(coalesce(given, '')) NOT IN ('unknown', 'private', 'testdebug', '')", severity="info"),
    Rule("unlinkedSpouseForFemaleSubject", "gap", certain="gender = 'female' AND married_surname IS NOT NULL AND n_spouses = 0", severity="warning"),
    Rule("marriedSurnameFromSpouse", "issue", make=_married_surname),
    Rule("excessParentEdges", "issue", make=_excess_parents),
    Rule("emptyProfile", "issue", certain="given IS NULL AND middle IS NULL AND coalesce(be, bl, de, dl) IS NULL AND n_parents + n_children + n_spouses = 0", severity="warning"),
    Rule("parentsPerRole", "issue", make=_parents_per_role),
    Rule("recordAfterDeath", "issue", make=_record_after_death),
    Rule("orphanStub", "issue", make=_orphan_stub),
    Rule("phantomSpouse", "issue", make=_phantom_spouse),
)


#: People without a name, who get issues only.
_NAMELESS = "given IS NULL OR given = '?'"


def _whole(r: Rule) -> bool:
    """Nobody is left to be barred for a missing name: an issue, or a rule over people, who are barred as they are read."""
    return r.category == "issue" or (not r.make and r.over == "people" and r.subject == "id")


def _one_pass(cat: Catalog, rules: list[Rule]) -> DataFrame:
    """The rows of all rules over one table, from one scan of it; over people, without those that a missing name bars."""
    found = []
    for r in rules:
        severity = F.when(F.expr(r.certain), r.severity).when(F.expr(r.likely), "warning")
        if r.category != "issue" and _whole(r):
            severity = F.when(~F.expr(_NAMELESS), severity)
        related = F.array(F.col(r.related)).cast("array<long>") if r.related else _none()
        found.append(F.struct(F.lit(r.name).alias("rule_id"), F.col(r.subject).cast("long").alias("profile_id"), severity.alias("severity"), F.lit(r.category).alias("category"), related.alias("related")))
    return getattr(cat, rules[0].over).select(F.explode(F.filter(F.array(*found), lambda x: x["severity"].isNotNull())).alias("x")).select("x.*")


def findings(cat: Catalog, rules: tuple[Rule, ...] = RULES, mutes: DataFrame | None = None) -> DataFrame:
    """All rules' rows: rule_id, profile_id, severity, category, related.

    mutes (rule_id, profile_id; null profile_id mutes the rule for everyone) are left out. People without a name get
    issues only. People and edges are written once for all rules.
    """
    cat, out = cat.written(), None
    plain = [r for r in rules if not r.make]
    parts = [(_one_pass(cat, [r for r in plain if (r.over, _whole(r)) == k]), k[1]) for k in dict.fromkeys((r.over, _whole(r)) for r in plain)]
    parts += [(r.rows(cat).select(F.lit(r.name).alias("rule_id"), "profile_id", "severity", F.lit(r.category).alias("category"), "related"), _whole(r)) for r in rules if r.make]
    nameless = cat.people.where(_NAMELESS).select(F.col("id").alias("profile_id"))
    for part, whole in parts:
        part = part if whole else part.join(nameless, "profile_id", "left_anti")
        out = part if out is None else out.unionByName(part)
    if mutes is not None:
        out = out.join(mutes.where("profile_id IS NULL").select("rule_id"), "rule_id", "left_anti").join(mutes.where("profile_id IS NOT NULL"), ["rule_id", "profile_id"], "left_anti")
    return out.select("rule_id", "profile_id", "severity", "category", "related")


def summary(found: DataFrame) -> DataFrame:
    """Findings per rule and severity.

    Dealt out by person before anything is gathered: nearly every row is a person's only one of its rule, so gathering
    them where they were found spares none and takes a task memory for all its rows."""
    found = found.repartition(DEALT * found.sparkSession.sparkContext.defaultParallelism, "profile_id")
    return found.groupBy("rule_id", "severity", "category").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("profile_id").alias("n_profiles"))
