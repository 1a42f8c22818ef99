"""Whole trees as level-numbered line files, and back: people, families, marriages, events, sources and citations.

A file is read in parallel: Spark splits it before every level-0 line, so a record is a row. Within a record the line
above a line is the last one of a lower level, found by a window over the record. Pointers between records are joins.

Tables (ids are record names without their @):
people    id, given, middle, surname, gender, birth_raw, birth_place, death_raw, death_place
edges     type (parent, spouse), from_id, to_id, role, year: parent edges run from parent to child
sources   id, title, collection, repository, url, notes
citations id (of a person), event (BIRT, DEAT), source, page, quality
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import shared_folder
from . import gedcom

#: Characters of a value in one line; the rest follows in CONC lines.
FOLD = 200
#: Lines at deeper levels hang on the last line of this level or above.
DEEPEST = 5
_GENDER = "CASE upper({0}) WHEN 'M' THEN 'male' WHEN 'F' THEN 'female' WHEN 'X' THEN 'other' WHEN '' THEN NULL ELSE 'unknown' END"


# --- reading ------------------------------------------------------------------------------------------------------


def nodes(lines: DataFrame) -> DataFrame:
    """record, rtag, xref, seq, level, tag, value, event, event_tag, above, above_tag of every line.

    lines: record, seq, line. A record that holds further level-0 lines (indented ones, which the reader does not split at)
    becomes several. event: the last level-1 line; above: the last line of a lower level. CONC and CONT lines are folded
    into the value of the line above, one level up; they do not come out themselves. Lines without a level number and a tag are left out.
    """
    part = lambda k: F.regexp_extract("line", gedcom.LINE, k)
    t = lines.select("record", "seq", F.nullif(part(1), F.lit("")).cast("int").alias("level"), part(2).alias("xref"), part(3).alias("tag"), F.regexp_replace(part(4), "[\r\n]+$", "").alias("value")).where("level IS NOT NULL")
    by = Window.partitionBy("record").orderBy("seq")
    until, before = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("head", F.last(F.when(F.col("level") == 0, F.struct("seq", "xref", "tag")), ignorenulls=True).over(until)).where("head IS NOT NULL")
    at = lambda k: F.last(F.when(F.col("level") == k, F.col("seq")), ignorenulls=True).over(before)
    t = t.withColumns({f"a{k}": at(k) for k in range(DEEPEST + 1)})
    above = F.greatest(*[F.when(F.col("level") > k, F.col(f"a{k}")) for k in range(DEEPEST + 1)])
    t = t.select("record", F.col("head.seq").alias("part"), F.col("head.xref").alias("xref"), F.col("head.tag").alias("rtag"), "seq", "level", "tag", "value", F.when(F.col("level") > 0, above).alias("above"),
                 F.when(F.col("level") == 1, F.col("seq")).when(F.col("a1") > F.col("head.seq"), F.col("a1")).alias("event"))
    # the record as one array in the order of its lines; continuations go into their own line's value
    one = t.groupBy("record", "part", "xref", "rtag").agg(F.array_sort(F.collect_list(F.struct("seq", "level", "tag", "value", "above", "event"))).alias("ls"))
    full = one.select("record", "part", "xref", "rtag", "ls", F.expr("filter(ls, l -> l.tag IN ('CONC', 'CONT'))").alias("more"), F.expr("map_from_entries(transform(ls, l -> struct(l.seq, l)))").alias("at"))
    folded = F.expr("""transform(filter(ls, l -> l.tag NOT IN ('CONC', 'CONT') OR l.level = 0), l -> struct(l.seq AS seq, l.level AS level, l.tag AS tag,
        concat(l.value, CASE WHEN size(more) = 0 THEN '' ELSE array_join(transform(filter(more, c -> c.above = l.seq AND c.level = l.level + 1), c -> CASE c.tag WHEN 'CONT' THEN concat('\n', c.value) ELSE c.value END), '') END) AS value,
        l.event AS event, at[l.event].tag AS event_tag, l.above AS above, at[l.above].tag AS above_tag))""")
    return full.select("record", "part", "xref", "rtag", F.explode(folded).alias("l")).select("record", "part", "xref", "rtag", "l.*")


def _last(when: str, value: str = "value") -> Column:
    """The value of the last such line."""
    return F.max_by(F.expr(f"CASE WHEN {when} THEN {value} END"), F.expr(f"CASE WHEN {when} THEN seq END"))


def _empty_null(c: str) -> Column:
    return F.nullif(F.col(c), F.lit("")).alias(c)


def version(n: DataFrame) -> DataFrame:
    """version: 7.0 if the header's first VERS below GEDC begins with 7., else 5.5.1, without a header too."""
    said = n.where("rtag = 'HEAD' AND tag = 'VERS' AND event_tag = 'GEDC'").agg(F.min_by("value", F.struct("record", "seq")).alias("v"))
    return said.select(F.when(F.trim("v").startswith("7."), "7.0").otherwise("5.5.1").alias("version"))


def people(n: DataFrame) -> DataFrame:
    """The last NAME, SEX and dates and places of BIRT and DEAT count; GIVN and SURN below a NAME go before its text.

    The first of several forenames is the given name, the others are middle names."""
    rows = n.where("rtag = 'INDI' AND xref <> ''")
    got = rows.groupBy("record", "part", "xref").agg(
        F.max(F.expr("CASE WHEN level = 1 AND tag = 'NAME' THEN struct(seq, value) END")).alias("name"),
        F.max(F.expr("CASE WHEN event_tag = 'NAME' AND tag = 'GIVN' AND value <> '' THEN struct(event, seq, value) END")).alias("givn"),
        F.max(F.expr("CASE WHEN event_tag = 'NAME' AND tag = 'SURN' AND value <> '' THEN struct(event, seq, value) END")).alias("surn"),
        _last("level = 1 AND tag = 'SEX' AND value <> ''").alias("sex"),
        *[_last(f"event_tag = '{e}' AND level = 2 AND tag = '{t}' AND value <> ''").alias(f"{f}_{c}") for e, f in (("BIRT", "birth"), ("DEAT", "death")) for t, c in (("DATE", "raw"), ("PLAC", "place"))],
    )
    given = F.expr("coalesce(CASE WHEN givn.event = name.seq THEN givn.value END, trim(split(name.value, '/')[0]))")
    surname = F.expr("coalesce(CASE WHEN surn.event = name.seq THEN surn.value END, trim(split(name.value, '/')[1]))")
    words = F.filter(F.split("_g", " +"), lambda w: w != "")
    cut_ = got.withColumns({"_g": given, "surname": surname}).withColumn("_w", words)
    return cut_.select(
        F.col("xref").alias("id"), F.get("_w", F.lit(0)).alias("given"), F.nullif(F.array_join(F.slice("_w", 2, 1000), " "), F.lit("")).alias("middle"), _empty_null("surname"),
        F.expr(_GENDER.format("coalesce(sex, '')")).alias("gender"), "birth_raw", "birth_place", "death_raw", "death_place",
    )


def edges(n: DataFrame, persons: DataFrame) -> DataFrame:
    """The edges of all families, each once. The last HUSB, WIFE and marriage date of a family count.

    A parent's role follows the parent's gender; unspecified where it says neither; father and mother by place where the person is not in the file.
    """
    fam = n.where("rtag = 'FAM'").groupBy("record", "part").agg(
        _last("level = 1 AND tag = 'HUSB' AND value <> ''").alias("h"), _last("level = 1 AND tag = 'WIFE' AND value <> ''").alias("w"),
        _last("event_tag = 'MARR' AND tag = 'DATE' AND value <> ''").alias("married"), F.collect_set(F.expr("CASE WHEN level = 1 AND tag = 'CHIL' AND value <> '' THEN value END")).alias("kids"),
    )
    bare = lambda c: F.regexp_replace(c, "^@|@$", "")
    spouses = fam.where("h IS NOT NULL AND w IS NOT NULL").select(F.lit("spouse").alias("type"), bare("h").alias("from_id"), bare("w").alias("to_id"), F.lit(None).cast("string").alias("role"), F.regexp_extract("married", r"\b(\d{4})\b", 1).try_cast("int").alias("year"))
    ends = F.array(F.struct(F.col("h").alias("p"), F.lit("father").alias("place")), F.struct(F.col("w").alias("p"), F.lit("mother").alias("place")))
    parents = fam.select(F.explode(ends).alias("x"), "kids").where("x.p IS NOT NULL").select(bare("x.p").alias("from_id"), "x.place", F.explode("kids").alias("kid"))
    known = persons.select(F.col("id").alias("from_id"), "gender", F.lit(True).alias("there"))
    role = F.expr("CASE WHEN there IS NULL THEN place WHEN gender = 'male' THEN 'father' WHEN gender = 'female' THEN 'mother' ELSE 'unspecified' END")
    kin = parents.join(known, "from_id", "left").select(F.lit("parent").alias("type"), "from_id", bare("kid").alias("to_id"), role.alias("role"), F.lit(None).cast("int").alias("year"))
    return spouses.unionByName(kin).distinct()


def sources(n: DataFrame) -> DataFrame:
    """REPO is a pointer to a repository record, whose first NAME counts, or a name itself; PUBL is taken where it gives none.

    Authors and notes are joined in the order of their lines."""
    rows = n.where("rtag = 'SOUR' AND xref <> ''")
    note = F.expr("CASE WHEN level = 1 AND tag = 'AUTH' AND value <> '' THEN struct(seq, concat('Author: ', value) AS v) WHEN level = 1 AND tag = 'NOTE' THEN struct(seq, value AS v) END")
    got = rows.groupBy("record", "part", "xref").agg(
        *[_last(f"level = 1 AND tag = '{t}' AND value <> ''").alias(c) for t, c in (("TITL", "title"), ("ABBR", "collection"), ("REPO", "repo"), ("_URL", "url"))],
        F.min_by(F.expr("CASE WHEN level = 1 AND tag = 'PUBL' AND value <> '' THEN value END"), F.expr("CASE WHEN level = 1 AND tag = 'PUBL' AND value <> '' THEN seq END")).alias("publ"),
        F.array_join(F.transform(F.array_sort(F.collect_list(note)), lambda x: x["v"]), "\n").alias("notes"),
    )
    repos = n.where("rtag = 'REPO' AND level = 1 AND tag = 'NAME' AND value <> ''").groupBy(F.concat(F.lit("@"), "xref", F.lit("@")).alias("repo")).agg(F.min_by("value", "seq").alias("name"))
    pointer = F.col("repo").startswith("@") & F.col("repo").endswith("@")
    return got.join(repos, "repo", "left").select(F.col("xref").alias("id"), "title", "collection", F.coalesce(F.when(pointer, F.col("name")).otherwise(F.col("repo")), "publ").alias("repository"), "url", _empty_null("notes"))


def citations(n: DataFrame, known: DataFrame) -> DataFrame:
    """The best citation of each birth and death: the highest QUAY (0 to 3; none is lowest), then the first. Pointers to no source are passed over.

    Trailing parts of PAGE that repeat the source's collection or repository are taken off; a PAGE that is its address is none.
    """
    rows = n.where("rtag = 'INDI' AND xref <> '' AND event_tag IN ('BIRT', 'DEAT') AND level >= 2")
    below = rows.where("level = 3 AND above_tag = 'SOUR'").groupBy("record", "part", F.col("above").alias("seq")).agg(_last("tag = 'PAGE' AND value <> ''").alias("page"), _last("tag = 'QUAY' AND value RLIKE '^[0-3]$'").cast("int").alias("quality"))
    refs = rows.where("level = 2 AND tag = 'SOUR' AND value LIKE '@%@'").select("record", "part", "xref", "seq", "event_tag", F.regexp_replace("value", "^@|@$", "").alias("source"))
    refs = refs.join(below, ["record", "part", "seq"], "left").join(known.select(F.col("id").alias("source"), "collection", "repository", "url"), "source")
    best = refs.groupBy("xref", F.col("event_tag").alias("event")).agg(F.max_by(F.struct("source", "page", "quality", "collection", "repository", "url"), F.struct(F.coalesce("quality", F.lit(-1)), -F.col("record"), -F.col("seq"))).alias("b"))
    # parts from the end, up to the first that says something new
    kept = F.expr("""aggregate(reverse(split(b.page, ', ')), CAST(array() AS array<string>), (a, x) -> CASE WHEN size(a) = 0 AND (x <=> b.collection OR x <=> b.repository) THEN a ELSE concat(array(x), a) END)""")
    page = F.nullif(F.array_join(kept, ", "), F.lit(""))
    return best.select(F.col("xref").alias("id"), "event", "b.source", F.when(~page.eqNullSafe(F.col("b.url")), page).alias("page"), "b.quality")


# --- writing ------------------------------------------------------------------------------------------------------


def folded(level: int, tag: str, value: Column) -> Column:
    """The lines of a value: a CONT line for each line break, CONC lines after every FOLD characters. None for a null or empty value."""
    chunks = lambda s: F.when(F.length(s) == 0, F.array(F.lit(""))).otherwise(
        F.transform(F.sequence(F.lit(0), F.ceil(F.length(s) / FOLD).cast("int") - 1), lambda k: F.substr(s, k * FOLD + 1, F.lit(FOLD)))
    )
    line = lambda i, j: F.when((i == 0) & (j == 0), f"{level} {tag} ").when(j == 0, f"{level + 1} CONT ").otherwise(f"{level + 1} CONC ")
    made = F.flatten(F.transform(F.split(value, "\n"), lambda s, i: F.transform(chunks(s), lambda c, j: F.concat(line(i, j), c))))
    return F.when(F.length(value) > 0, made).otherwise(F.array().cast("array<string>"))


def _line(prefix: str, value: Column) -> Column:
    return F.when(F.length(value) > 0, F.array(F.concat(F.lit(prefix), value))).otherwise(F.array().cast("array<string>"))


def individual_lines(persons: DataFrame, cited: DataFrame, origins: DataFrame) -> DataFrame:
    """xref, lines of each person."""
    given = F.concat_ws(" ", *[F.when(F.length(F.trim(c)) > 0, F.trim(c)) for c in ("given", "middle")])
    surname = F.coalesce("surname", F.lit(""))
    page = F.expr("nullif(concat_ws(', ', nullif(c.page, ''), nullif(o.collection, ''), nullif(o.repository, '')), '')")
    refs = cited.alias("c").join(origins.alias("o"), F.col("c.source") == F.col("o.id")).select(F.col("c.id").alias("id"), "c.event", "c.source", F.coalesce(page, "o.url").alias("page"), "c.quality")
    refs = refs.groupBy("id").pivot("event", ["BIRT", "DEAT"]).agg(F.max(F.struct("source", "page", "quality")))
    rows = persons.withColumns({"_given": given, "_surname": surname}).join(refs, "id", "left")

    def event(tag: str, f: str) -> Column:
        there = F.col(f"{f}_raw").isNotNull() | F.col(f"{f}_place").isNotNull()
        ref = F.concat(_line("2 SOUR @", F.concat(F.col(f"{tag}.source"), F.lit("@"))), folded(3, "PAGE", F.col(f"{tag}.page")), _line("3 QUAY ", F.col(f"{tag}.quality").cast("string")))
        made = F.concat(F.array(F.lit(f"1 {tag}")), _line("2 DATE ", F.col(f"{f}_raw")), _line("2 PLAC ", F.col(f"{f}_place")), ref)
        return F.when(there, made).otherwise(F.array().cast("array<string>"))

    named = F.when((F.length("_given") > 0) | (F.length("_surname") > 0), F.array(F.concat(F.lit("1 NAME "), "_given", F.lit(" /"), "_surname", F.lit("/")))).otherwise(F.array().cast("array<string>"))
    sex = F.expr("CASE gender WHEN 'male' THEN 'M' WHEN 'female' THEN 'F' WHEN 'other' THEN 'X' WHEN 'unknown' THEN 'U' END")
    head = F.array(F.concat(F.lit("0 @"), F.col("id"), F.lit("@ INDI")))
    return rows.select(F.col("id").alias("xref"), F.concat(head, named, _line("2 GIVN ", F.col("_given")), _line("2 SURN ", F.col("_surname")), _line("1 SEX ", sex), event("BIRT", "birth"), event("DEAT", "death")).alias("lines"))


def families(persons: DataFrame, kin: DataFrame) -> DataFrame:
    """id, h, w, year, kids (in order of their names): a family for each couple, and one for each parent whose child no couple covers.

    A child's parents are taken by name: one that no couple has taken yet joins all couples with later, free ones. The
    husband of a couple is the man, else the first partner.
    """
    gender = persons.select("id", "gender")
    pairs = kin.where("type = 'spouse'").groupBy(F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b")).agg(F.min(F.struct("year", "from_id", "to_id")).alias("e"))
    couples = pairs.join(gender.select(F.col("id").alias("a"), F.col("gender").alias("ga")), "a", "left").join(gender.select(F.col("id").alias("b"), F.col("gender").alias("gb")), "b", "left")
    first_male = F.expr("CASE WHEN e.from_id = a THEN ga ELSE gb END <=> 'male'")
    second_male = F.expr("CASE WHEN e.to_id = a THEN ga ELSE gb END <=> 'male'")
    swap = ~first_male & second_male
    couples = couples.select("a", "b", "e.year", F.when(swap, F.col("e.to_id")).otherwise(F.col("e.from_id")).alias("h"), F.when(swap, F.col("e.from_id")).otherwise(F.col("e.to_id")).alias("w"))
    up = kin.where("type = 'parent'").select("from_id", F.col("to_id").alias("kid")).distinct()
    both = up.withColumnRenamed("from_id", "a").join(up.withColumnRenamed("from_id", "b"), "kid").where("a < b").join(couples.select("a", "b"), ["a", "b"], "left_semi")
    own = up.groupBy("kid").agg(F.array_sort(F.collect_set("from_id")).alias("ps")).join(both.groupBy("kid").agg(F.collect_list(F.struct("a", "b")).alias("pairs")), "kid", "left")
    # state: who is taken, and which couples took the child
    took = F.expr("""aggregate(ps, struct(CAST(array() AS array<string>) AS taken, CAST(array() AS array<struct<a:string,b:string>>) AS into), (s, p) ->
        CASE WHEN array_contains(s.taken, p) THEN s ELSE struct(
          concat(s.taken, flatten(transform(filter(coalesce(pairs, array()), x -> x.a = p AND NOT array_contains(s.taken, x.b)), x -> array(x.a, x.b)))) AS taken,
          concat(s.into, filter(coalesce(pairs, array()), x -> x.a = p AND NOT array_contains(s.taken, x.b))) AS into) END)""")
    dealt = own.withColumn("t", took)
    in_couples = dealt.select("kid", F.explode("t.into").alias("x")).groupBy("x.a", "x.b").agg(F.array_sort(F.collect_set("kid")).alias("kids"))
    none = F.array().cast("array<string>")
    two = couples.join(in_couples, ["a", "b"], "left").select(F.concat(F.lit("F"), "a", F.lit("_"), "b").alias("id"), "h", "w", "year", F.coalesce("kids", none).alias("kids"))
    alone = dealt.select("kid", F.explode(F.array_except("ps", "t.taken")).alias("p")).groupBy("p").agg(F.array_sort(F.collect_set("kid")).alias("kids")).join(gender.withColumnRenamed("id", "p"), "p", "left")
    wife = F.expr("gender <=> 'female'")
    one = alone.select(F.concat(F.lit("F"), "p").alias("id"), F.when(~wife, F.col("p")).alias("h"), F.when(wife, F.col("p")).alias("w"), F.lit(None).cast("int").alias("year"), "kids")
    return two.unionByName(one)


def family_lines(fams: DataFrame) -> DataFrame:
    at = lambda tag, c: F.when(F.col(c).isNotNull(), F.array(F.concat(F.lit(f"1 {tag} @"), F.col(c), F.lit("@")))).otherwise(F.array().cast("array<string>"))
    kids = F.transform("kids", lambda k: F.concat(F.lit("1 CHIL @"), k, F.lit("@")))
    married = F.when(F.col("year").isNotNull(), F.array(F.lit("1 MARR"), F.concat(F.lit("2 DATE "), F.col("year").cast("string")))).otherwise(F.array().cast("array<string>"))
    return fams.select(F.col("id").alias("xref"), F.concat(F.array(F.concat(F.lit("0 @"), "id", F.lit("@ FAM"))), at("HUSB", "h"), at("WIFE", "w"), kids, married).alias("lines"))


def source_lines(origins: DataFrame) -> DataFrame:
    parts = [folded(1, t, F.col(c)) for t, c in (("TITL", "title"), ("ABBR", "collection"), ("PUBL", "repository"), ("_URL", "url"), ("NOTE", "notes"))]
    return origins.select(F.col("id").alias("xref"), F.concat(F.array(F.concat(F.lit("0 @"), "id", F.lit("@ SOUR"))), *parts).alias("lines"))


def export(persons: DataFrame, kin: DataFrame, origins: DataFrame, cited: DataFrame, version: str = "5.5.1", living: Column | None = None) -> DataFrame:
    """xref, lines of all records, the header first by name (empty). living leaves out those people, their edges and citations."""
    if living is not None:
        persons = persons.where(~F.coalesce(living, F.lit(False)))
        there = persons.select("id")
        kin = kin.join(there.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(there.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
        cited = cited.join(there, "id", "left_semi")
    head = ["0 HEAD", "1 SOUR HEARTHGRAPH", "1 GEDC", f"2 VERS {version}"] + ([] if version.startswith("7.") else ["2 FORM LINEAGE-LINKED", "1 CHAR UTF-8"])
    first = persons.sparkSession.range(1).select(F.lit("").alias("xref"), F.array(*[F.lit(x) for x in head]).alias("lines"))
    return first.unionByName(individual_lines(persons, cited, origins)).unionByName(family_lines(families(persons, kin))).unionByName(source_lines(origins))


def save(records: DataFrame, path: str) -> None:
    """One text file of records for each partition, a record's lines together."""
    records.select(F.array_join("lines", "\n").alias("value")).write.text(path)


def through_text(spark: SparkSession, records: DataFrame) -> DataFrame:
    """record, seq, line after writing the records as text into the shared folder and reading the files."""
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    save(records, path)
    return gedcom.records(spark, path)
