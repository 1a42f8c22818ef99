"""Similarity of personal names, as column expressions over upper-case names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pet forms and the name each stands for.
NICKNAMES = {
    "JACK": "JOHN", "HARRY": "HENRY", "BILL": "WILLIAM", "WILLIE": "WILLIAM", "TED": "EDWARD", "DICK": "RICHARD", "POLLY": "MARY", "MOLLY": "MARY",
    "PEGGY": "MARGARET", "BETTY": "ELIZABETH", "LIZZIE": "ELIZABETH", "ELSIE": "ELIZABETH", "SALLY": "SARAH", "NANCY": "ANN", "NELL": "ELLEN",
    "NELLIE": "ELLEN", "JOE": "JOSEPH", "SAM": "SAMUEL", "KATE": "CATHERINE", "KATHLEEN": "CATHERINE", "FLORRIE": "FLORENCE", "GEOFF": "GEOFFREY",
    "ADELAIDE": "ADA", "ADELINE": "ADA", "ADELA": "ADA", "ADELINA": "ADA", "BOB": "ROBERT",
}
#: Pet forms that the audit's ladder lacks, and those that the older ladder has.
NOT_AUDITED = ("ELSIE", "GEOFF")
OLDER = ("JACK", "HARRY", "BILL", "TED", "DICK", "POLLY", "PEGGY", "BETTY", "NELL", "JOE", "KATE", "WILLIE", "NELLIE", "LIZZIE", "FLORRIE")
#: Written contractions and the name each stands for.
CONTRACTIONS = {
    "WM": "WILLIAM", "WILLM": "WILLIAM", "JNO": "JOHN", "THOS": "THOMAS", "CHAS": "CHARLES", "JAS": "JAMES", "RICHD": "RICHARD", "RICD": "RICHARD", "ROBT": "ROBERT",
    "EDWD": "EDWARD", "SAML": "SAMUEL", "BENJ": "BENJAMIN", "DANL": "DANIEL", "MARGT": "MARGARET", "FREDK": "FREDERICK", "ALEXR": "ALEXANDER", "HENY": "HENRY",
    "GULIELMUS": "WILLIAM", "GUILIELMUS": "WILLIAM", "JOHANNES": "JOHN", "JOHANNIS": "JOHN", "JACOBUS": "JAMES", "CAROLUS": "CHARLES", "GEORGIUS": "GEORGE",
    "HENRICUS": "HENRY", "RICARDUS": "RICHARD", "ROBERTUS": "ROBERT", "EDWARDUS": "EDWARD", "RADULPHUS": "RALPH", "GALFRIDUS": "GEOFFREY", "ELIZABETHA": "ELIZABETH", "MARGARETA": "MARGARET",
}


def _mapped(name: Column, table: dict[str, str]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[name], name)


def _plain_vowels(name: Column) -> Column:
    """AU written A and OU written O."""
    return F.replace(F.replace(name, F.lit("AU"), F.lit("A")), F.lit("OU"), F.lit("O"))


def _au_ou(a: Column, b: Column) -> Column:
    return _plain_vowels(a) == _plain_vowels(b)


def _contains(a: Column, b: Column) -> Column:
    return a.contains(b) | b.contains(a)


def _one_other(a: Column, b: Column) -> Column:
    return (F.length(a) == F.length(b)) & (F.levenshtein(a, b) == 1)


def _one_more(a: Column, b: Column) -> Column:
    return (F.abs(F.length(a) - F.length(b)) == 1) & (F.levenshtein(a, b) == 1)


def _ladder(a: Column, b: Column, rungs: list[tuple[Column, float]]) -> Column:
    """The first rung that holds; null or empty names have similarity 0."""
    first = reduce(lambda w, r: w.when(r[0], r[1]), rungs[1:], F.when(rungs[0][0], rungs[0][1])).otherwise(0.0)
    return F.when((F.length(a) > 0) & (F.length(b) > 0), first).otherwise(0.0)


def similarity(a: Column, b: Column, learned: Column | None = None) -> Column:
    """Scoring ladder: equal, learned pair, AU/OU spelling, containment, same full form of two pet forms or of two
    contractions (a pet form and a contraction do not meet), one letter other or more."""
    a, b = F.trim(a), F.trim(b)
    same = (_mapped(a, NICKNAMES) == _mapped(b, NICKNAMES)) | (_mapped(a, CONTRACTIONS) == _mapped(b, CONTRACTIONS))
    rungs = [(a == b, 1.0), (learned if learned is not None else F.lit(False), 0.9), (_au_ou(a, b), 0.95), (_contains(a, b), 0.8), (same, 0.85), (_one_other(a, b), 0.7), (_one_more(a, b), 0.7)]
    return _ladder(a, b, rungs)


def audit_similarity(a: Column, b: Column) -> Column:
    """The audit's ladder: no contractions, full forms come before containment, one letter more only among names of four letters."""
    a, b = F.trim(a), F.trim(b)
    long = F.least(F.length(a), F.length(b)) >= 4
    known = {k: v for k, v in NICKNAMES.items() if k not in NOT_AUDITED}
    return _ladder(a, b, [(a == b, 1.0), (_au_ou(a, b), 0.95), (_mapped(a, known) == _mapped(b, known), 0.85), (_contains(a, b), 0.8), (_one_other(a, b), 0.7), (long & _one_more(a, b), 0.7)])


def keys(name: Column) -> tuple[Column, Column]:
    """Two names that the audit's ladder rates 0.85 or more are equal in one of these: plain vowels, or the full form of a pet form."""
    known = {k: v for k, v in NICKNAMES.items() if k not in NOT_AUDITED}
    return F.concat(F.lit("v:"), _plain_vowels(name)), F.concat(F.lit("f:"), _mapped(name, known))


def simple_similarity(a: Column, b: Column) -> Column:
    """The older ladder: no learned pairs, contractions or inserted letter, few pet forms, and two pet forms of one name
    are not alike."""
    a, b = F.trim(a), F.trim(b)
    known = {k: NICKNAMES[k] for k in OLDER}
    pet = (_mapped(a, known) == b) | (_mapped(b, known) == a)
    return _ladder(a, b, [(a == b, 1.0), (_au_ou(a, b), 0.95), (_contains(a, b), 0.8), (pet, 0.85), (_one_other(a, b), 0.7)])


def sql(a: str, b: str, ladder: str = "audit") -> str:
    """The same ladders as ANSI SQL text."""
    a, b = f"trim({a})", f"trim({b})"
    table = lambda names: "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in names.items()) + ") t(pet, name)"
    full = lambda x, names: f"coalesce((SELECT min(name) FROM {table(names)} WHERE pet = {x}), {x})"
    audited, older = {k: v for k, v in NICKNAMES.items() if k not in NOT_AUDITED}, {k: NICKNAMES[k] for k in OLDER}
    pets, written, audit_same = (f"{full(a, n)} = {full(b, n)}" for n in (NICKNAMES, CONTRACTIONS, audited))
    same = f"({pets} OR {written})"
    pair = f"({full(a, older)} = {b} OR {full(b, older)} = {a})"
    au = f"regexp_replace(regexp_replace({a}, 'AU', 'A', 'g'), 'OU', 'O', 'g') = regexp_replace(regexp_replace({b}, 'AU', 'A', 'g'), 'OU', 'O', 'g')"
    inside = f"(contains({a}, {b}) OR contains({b}, {a}))"
    one = f"length({a}) = length({b}) AND levenshtein({a}, {b}) = 1"
    more = f"abs(length({a}) - length({b})) = 1 AND levenshtein({a}, {b}) = 1"
    rungs = {
        "audit": [(au, 0.95), (audit_same, 0.85), (inside, 0.8), (one, 0.7), (f"least(length({a}), length({b})) >= 4 AND {more}", 0.7)],
        "scoring": [(au, 0.95), (inside, 0.8), (same, 0.85), (one, 0.7), (more, 0.7)],
        "simple": [(au, 0.95), (inside, 0.8), (pair, 0.85), (one, 0.7)],
    }[ladder]
    return f"CASE WHEN coalesce(length({a}), 0) = 0 OR coalesce(length({b}), 0) = 0 THEN 0.0 WHEN {a} = {b} THEN 1.0 " + " ".join(f"WHEN {c} THEN {v}" for c, v in rungs) + " ELSE 0.0 END"
