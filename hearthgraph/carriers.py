"""The engine's generic tables, derived from the driver's star schema.

The operators work on people, edges, life events and evidence records. The driver's tables hold none of these, so each
is derived from keys by arithmetic that Spark SQL and ANSI SQL state alike. A result over carriers is a test of an
operator, never a statement about families.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .checkpoints import cut
from .functions import dates

#: The year that counts as now.
AS_OF = 2024
#: People are dealt out to so many tasks for each core before their dates are parsed.
DEALT = 4

GIVEN = "John,Mary,William,Elizabeth,Thomas,Ann,James,Sarah,George,Hannah,Samuel,Ellen"
SURNAMES = "Brandle,Holmden,Slatter,Landry,Whitting,Spenlow,Doxam,Allcot,Pottinger,Hallam"
PLACES = "Alderby|Morton, Northshire|KESTWICK|Crayle, Northshire, England|Ashmere?|Tarnock,"

#: Year of birth by generation: the key's length in bits.
_BASE = "1520 + 28 * least(length(bin({k})), 15) + ({k} * 7) % 23 - CASE WHEN {k} % 67 = 12 THEN 45 ELSE 0 END"


def _base(k: str) -> str:
    return _BASE.format(k=k)


def _pick(values: str, index: str, sep: str = ",") -> str:
    return f"split_part('{values}', '{sep}', CAST(1 + {index} AS INT))"


_Y = f"CAST({_base('c_custkey')} AS STRING)"
_D = f"({_base('c_custkey')} + (c_custkey * 13) % 118 - 3)"
PROFILES = {
    "id": "c_custkey",
    "given": f"CASE WHEN c_custkey % 37 = 5 OR c_custkey % 202 = 50 THEN NULL WHEN c_custkey % 41 = 7 THEN '?' WHEN c_custkey % 43 = 9 THEN 'J' WHEN c_custkey % 17 = 3 THEN {_pick(GIVEN, 'c_custkey % 12')} || ' Lee' ELSE {_pick(GIVEN, 'c_custkey % 12')} END",
    "middle": "CASE WHEN c_custkey % 5 = 0 THEN 'May' END",
    "surname": f"CASE WHEN c_custkey % 53 = 11 THEN NULL ELSE {_pick(SURNAMES, '((c_custkey - c_custkey % 8) / 8) % 10')} END",
    "married_surname": f"CASE WHEN c_custkey % 6 = 1 THEN {_pick(SURNAMES, 'c_custkey % 10')} END",
    "gender": "CASE WHEN c_custkey % 47 = 13 THEN NULL WHEN c_custkey % 2 = 0 OR c_custkey % 16 = 15 THEN 'male' ELSE 'female' END",
    "birth_raw": f"""CASE WHEN c_custkey % 202 = 50 THEN NULL ELSE CASE CAST(c_custkey % 11 AS INT) WHEN 0 THEN 'ABT ' || {_Y} WHEN 1 THEN 'EST ' || {_Y} WHEN 2 THEN 'CAL ' || {_Y} WHEN 3 THEN 'BEF ' || {_Y} WHEN 4 THEN 'AFT ' || {_Y}
        WHEN 5 THEN 'BET ' || CAST({_base('c_custkey')} - c_custkey % 20 AS STRING) || ' AND ' || {_Y} WHEN 6 THEN substr({_Y}, 1, 3) || '0s' WHEN 7 THEN CASE WHEN c_custkey % 2 = 0 THEN '?' END ELSE {_Y} END END""",
    "death_raw": f"CASE WHEN c_custkey % 4 = 1 OR c_custkey % 202 = 50 THEN NULL WHEN c_custkey % 59 = 20 THEN 'soon' WHEN c_custkey % 61 = 21 THEN '31 FEB 1850' WHEN c_custkey % 7 = 2 THEN 'ABT ' || CAST({_D} AS STRING) ELSE CAST({_D} AS STRING) END",
    "birth_place": f"CASE WHEN c_custkey % 7 = 6 THEN NULL ELSE {_pick(PLACES, 'c_custkey % 6', '|')} END",
    "death_place": f"CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE {_pick(PLACES, '(c_custkey * 5) % 6', '|')} END",
    "bio": "CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN 'Short note' ELSE 'A long account of a life with many words' || CASE WHEN c_custkey % 2 = 0 THEN ' <ref>1</ref> and more' ELSE ' that cites nothing at all' END END",
    "is_deleted": "c_custkey % 71 = 30",
}
ORDERS = {
    "life": {
        "profile_id": "o_custkey",
        "kind": _pick("census,residence,occupation,military,religion,baptism", "o_orderkey % 6"),
        "year": f"CAST({_base('o_custkey')} + (o_orderkey * 11) % 100 AS INT)",
    },
    "records": {
        "record_id": "o_orderkey",
        "profile_id": "o_custkey",
        "source_id": "'s' || CAST(o_orderkey * 7 % 9 AS STRING)",
        "lineage": "'L' || CAST(o_orderkey % 5 AS STRING)",
        "tier": "CAST(1 + o_orderkey % 3 AS INT)",
        "direct": "o_orderkey % 4 <> 0",
        "record_type": _pick("birth,death,marriage,census,burial,parish,probate", "o_orderkey % 7"),
        "surname": f"CASE WHEN o_orderkey % 13 = 4 THEN NULL ELSE {_pick(SURNAMES, '((o_custkey - o_custkey % 8) / 8 + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END) % 10')} END",
        "given": f"CASE WHEN o_orderkey % 9 = 2 THEN 'Jno' ELSE {_pick(GIVEN, '(o_custkey + CASE WHEN o_orderkey % 8 = 0 THEN 2 ELSE 0 END) % 12')} END",
        "year": f"CASE WHEN o_orderkey % 19 = 6 THEN NULL ELSE CAST({_base('o_custkey')} + CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN o_orderkey % 5 - 2 WHEN 1 THEN (o_custkey * 13) % 118 - 3 + o_orderkey % 3 - 1 ELSE 20 + o_orderkey % 30 END AS INT) END",
        "age": "CASE WHEN o_orderkey % 7 = 3 THEN CAST(20 + o_orderkey % 30 + o_orderkey % 3 - 1 AS INT) END",
        "district": f"CASE WHEN o_orderkey % 5 = 1 THEN NULL ELSE {_pick('Alderby,Braywell,Morton,Leedon', 'o_orderkey % 4')} END",
        "mother_maiden": "CASE WHEN o_orderkey % 11 = 5 THEN NULL ELSE 'Maid' || CAST(o_custkey % 331 AS STRING) END",
        "volume": "'7b'",
        "page": "CAST(1 + o_orderkey % 40 AS STRING)",
    },
}
EDGES = {
    "father_or_mother": ("c_custkey > 1", "CAST((c_custkey - c_custkey % 2) / 2 AS BIGINT)"),
    "other_parent": ("c_custkey > 3 AND c_custkey % 3 <> 0", "CAST((c_custkey - c_custkey % 2) / 2 AS BIGINT) + 1"),
    "third_parent": ("c_custkey > 20 AND c_custkey % 83 = 0", "CAST((c_custkey - c_custkey % 2) / 2 AS BIGINT) + 2"),
}
_ROLE = "CASE WHEN (from_id + CASE WHEN to_id % 29 = 0 THEN 1 ELSE 0 END) % 2 = 0 THEN 'father' ELSE 'mother' END"
SPOUSES = "c_custkey % 4 <> 3 AND c_custkey % 44 <> 28"
#: Some people stay without edges, and some without parents.
LINKED = "from_id % 101 <> 50 AND to_id % 101 <> 50 AND NOT (type = 'parent' AND to_id % 44 = 29)"
_MARRIED = f"CASE WHEN c_custkey % 9 = 8 THEN NULL ELSE CAST({_base('c_custkey')} + (c_custkey * 3) % 60 + 8 AS INT) END"


def _cols(spec: dict[str, str]) -> list[Column]:
    return [F.expr(v).alias(k) for k, v in spec.items()]


def _sql(spec: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in spec.items())


@dataclass(frozen=True)
class Catalog:
    """The generic tables of one data folder, each a lazy DataFrame."""

    spark: SparkSession
    sf_dir: str

    def written(self) -> Catalog:
        """The same tables with people and edges written to the shared folder once, for jobs that read them many times.

        All are joined by key: their files are a small part of their rows' size in memory, and Spark, which goes by the
        files, would gather millions of rows in the driver and send them to every task."""
        out = Catalog(self.spark, self.sf_dir)
        out.__dict__.update(edges=cut(self.edges).hint("merge"))
        out.__dict__.update(people=cut(out.people).hint("merge"))
        out.__dict__.update(dated=out.people.drop("n_parents", "n_children", "n_spouses"), spouses=out.spouses.hint("merge"))
        return out

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def profiles(self) -> DataFrame:
        return self._profiles(self.table("customer"))

    @staticmethod
    def _profiles(customer: DataFrame) -> DataFrame:
        return customer.select(*_cols(PROFILES)).where("NOT is_deleted").drop("is_deleted")

    @cached_property
    def edges(self) -> DataFrame:
        """type, from_id, to_id, role, year: parent edges run from parent to child, spouse edges once."""
        c = self.table("customer").select("c_custkey")
        ids = self.profiles.select("id")
        out = None
        for when, parent in EDGES.values():
            part = c.where(when).select(F.expr(parent).alias("from_id"), F.col("c_custkey").alias("to_id"))
            out = part if out is None else out.unionByName(part)
        parents = out.select(F.lit("parent").alias("type"), "from_id", "to_id", F.expr(_ROLE).alias("role"), F.lit(None).cast("int").alias("year"))
        spouses = c.where(SPOUSES).select(
            F.lit("spouse").alias("type"), F.col("c_custkey").alias("from_id"), F.expr("CASE WHEN c_custkey % 211 = 40 THEN c_custkey ELSE c_custkey + 1 END").alias("to_id"),
            F.lit(None).cast("string").alias("role"), F.expr(_MARRIED).alias("year"),
        )
        # only edges between people that are there, whose ids are too many for the driver
        ids = ids.hint("merge")
        both = parents.unionByName(spouses).where(LINKED)
        return both.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")

    @cached_property
    def parents(self) -> DataFrame:
        return self.edges.where("type = 'parent'").select("from_id", "to_id", "role")

    @cached_property
    def spouses(self) -> DataFrame:
        """Both directions of each spouse edge: id, other, year."""
        s = self.edges.where("type = 'spouse' AND from_id <> to_id").select(F.col("from_id").alias("id"), F.col("to_id").alias("other"), "year")
        return s.unionByName(s.select(F.col("other").alias("id"), F.col("id").alias("other"), "year"))

    @cached_property
    def dated(self) -> DataFrame:
        """Profiles with parsed dates (e earliest, l latest, b best) and living."""
        return self._parsed("birth", "death").withColumn("living", F.expr(f"de IS NULL AND dl IS NULL AND (bl IS NULL OR bl + 100 >= {AS_OF})"))

    @cached_property
    def born(self) -> DataFrame:
        """Profiles with parsed births only."""
        return self._parsed("birth")

    def _parsed(self, *fields: str) -> DataFrame:
        """A row's dates come out of a generator of one row: filters on them stay above it, and nothing copies the parser.

        Keys are dealt out before: a file of millions of people can be one or two row groups, and no more tasks would parse."""
        n = DEALT * self.spark.sparkContext.defaultParallelism
        p = self._profiles(self.table("customer").select("c_custkey").repartition(n, "c_custkey"))
        once = F.struct(*[dates.parse(F.col(f"{f}_raw")).alias(f) for f in fields])
        p = p.select("*", F.explode(F.array(once)).alias("_d"))
        for f in fields:
            e, l = F.col(f"_d.{f}.earliest"), F.col(f"_d.{f}.latest")  # noqa: E741
            p = p.withColumns({f"{f[0]}e": e, f"{f[0]}l": l, f"{f[0]}b": dates.best_year(e, l)})
        return p.drop("_d")

    @cached_property
    def people(self) -> DataFrame:
        """Dated profiles with the number of their edges, counted in one pass over both ends of all edges."""
        parent = F.col("type") == "parent"
        ends = F.array(F.struct(F.col("to_id").alias("id"), F.when(parent, "p").otherwise("s").alias("k")), F.struct(F.col("from_id").alias("id"), F.when(parent, "c").otherwise("s").alias("k")))
        stacked = self.edges.where("type = 'parent' OR from_id <> to_id").select(F.explode(ends).alias("x")).select("x.*")
        counts = stacked.groupBy("id").agg(*[F.count(F.when(F.col("k") == k, 1)).alias(n) for k, n in (("p", "n_parents"), ("c", "n_children"), ("s", "n_spouses"))])
        return self.dated.join(counts.hint("merge"), "id", "left").fillna(0, ["n_parents", "n_children", "n_spouses"])

    @cached_property
    def parent_pairs(self) -> DataFrame:
        """Each parent edge with the child's columns (c_) and the parent's (p_)."""
        own = self.dated.select("id", "given", "surname", "gender", "be", "bl", "bb", "de", "dl", "db").hint("merge")
        c = own.select(*[F.col(x).alias(f"c_{x}") for x in own.columns])
        p = own.select(*[F.col(x).alias(f"p_{x}") for x in own.columns])
        return self.parents.join(c, F.col("to_id") == F.col("c_id")).join(p, F.col("from_id") == F.col("p_id"))

    @cached_property
    def marriages(self) -> DataFrame:
        """Each spouse of each marriage with its own columns: id, other, year, …"""
        return self.spouses.join(self.dated.hint("merge"), "id")

    @cached_property
    def life(self) -> DataFrame:
        return self.table("orders").select(*_cols(ORDERS["life"]))

    @cached_property
    def records(self) -> DataFrame:
        return self.table("orders").select(*_cols(ORDERS["records"]))


def duck(text: str) -> str:
    """Expressions that both engines share, in the other's spelling."""
    return text.replace(" div ", " // ").replace("regexp_like(", "regexp_matches(")


def _parse_sql(f: str) -> str:
    r, x = f"upper(trim({f}_raw))", f[0]
    year = lambda t: f"(SELECT CASE WHEN y BETWEEN 1000 AND 2100 THEN y END FROM (SELECT TRY_CAST(regexp_extract({t}, '\\b(\\d\\d\\d\\d)\\b', 1) AS INT) AS y))"
    word = lambda *names: "(" + " OR ".join(f"starts_with({r}, '{n} ')" for n in names) + ")"
    about, est, cal = word("ABT", "ABOUT", "CIRCA", "AROUND", "APPROX", "APPROXIMATELY"), word("EST", "ESTIMATED"), word("CAL", "CALCULATED")
    decade = f"regexp_full_match({r}, '(1[0-9][0-9]|20[0-9])0S')"
    between = f"({word('BET', 'BETWEEN')} AND {r} LIKE '% AND %')"
    off = f"CASE WHEN {about} THEN 5 WHEN {est} THEN 10 WHEN {cal} THEN 1 ELSE 0 END"
    early = f"CASE WHEN {decade} THEN left({r}, 4)::INT WHEN {between} THEN {year(f'split_part({r}, {chr(39)} AND {chr(39)}, 1)')} WHEN {word('BEF', 'BEFORE')} THEN NULL ELSE {year(r)} - {off} END"
    late = f"CASE WHEN {decade} THEN left({r}, 4)::INT + 9 WHEN {between} THEN {year(f'split_part({r}, {chr(39)} AND {chr(39)}, -1)')} WHEN {word('AFT', 'AFTER')} THEN NULL ELSE {year(r)} + {off} END"
    return f"{early} AS {x}e, {late} AS {x}l"


_OWN = "id given surname gender be bl bb de dl db".split()
#: Common table expressions of the carriers for the other engine.
PREFIX = f"""WITH profiles AS MATERIALIZED (SELECT * EXCLUDE (is_deleted) FROM (SELECT {_sql(PROFILES)} FROM customer) WHERE NOT is_deleted),
all_edges AS ({" UNION ALL ".join(f"SELECT 'parent' AS type, from_id, to_id, {_ROLE} AS role, CAST(NULL AS INT) AS year FROM (SELECT {parent} AS from_id, c_custkey AS to_id FROM customer WHERE {when})" for when, parent in EDGES.values())}
  UNION ALL SELECT 'spouse', c_custkey, CASE WHEN c_custkey % 211 = 40 THEN c_custkey ELSE c_custkey + 1 END, CAST(NULL AS STRING), {_MARRIED} FROM customer WHERE {SPOUSES}),
edges AS MATERIALIZED (SELECT * FROM all_edges WHERE {LINKED} AND from_id IN (SELECT id FROM profiles) AND to_id IN (SELECT id FROM profiles)),
parents AS MATERIALIZED (SELECT from_id, to_id, role FROM edges WHERE type = 'parent'),
spouses AS MATERIALIZED (SELECT from_id AS id, to_id AS other, year FROM edges WHERE type = 'spouse' AND from_id <> to_id UNION ALL SELECT to_id, from_id, year FROM edges WHERE type = 'spouse' AND from_id <> to_id),
dated AS (SELECT *, {_parse_sql('birth')}, {_parse_sql('death')} FROM profiles),
people AS MATERIALIZED (SELECT d.*, CASE WHEN be IS NULL THEN bl WHEN bl IS NULL THEN be ELSE (be + bl) // 2 END AS bb, CASE WHEN de IS NULL THEN dl WHEN dl IS NULL THEN de ELSE (de + dl) // 2 END AS db,
  coalesce(np, 0) AS n_parents, coalesce(nc, 0) AS n_children, coalesce(ns, 0) AS n_spouses,
  de IS NULL AND dl IS NULL AND (bl IS NULL OR bl + 100 >= {AS_OF}) AS living FROM dated d
  LEFT JOIN (SELECT to_id AS id, count(*) AS np FROM parents GROUP BY 1) a ON a.id = d.id LEFT JOIN (SELECT from_id AS id, count(*) AS nc FROM parents GROUP BY 1) b ON b.id = d.id LEFT JOIN (SELECT id, count(*) AS ns FROM spouses GROUP BY 1) c ON c.id = d.id),
parent_pairs AS (SELECT e.*, {", ".join(f"c.{x} AS c_{x}, p.{x} AS p_{x}" for x in _OWN)} FROM parents e JOIN people c ON e.to_id = c.id JOIN people p ON e.from_id = p.id),
marriages AS (SELECT s.other, s.year, p.* FROM spouses s JOIN people p ON s.id = p.id),
life AS MATERIALIZED (SELECT {_sql(ORDERS['life'])} FROM orders),
records AS MATERIALIZED (SELECT {_sql(ORDERS['records'])} FROM orders)
"""


def oracle(body: str) -> str:
    return PREFIX + duck(body)
