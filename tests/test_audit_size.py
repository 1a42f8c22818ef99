"""What the audit does however large the tree is, held on a small one."""

import pytest
from pyspark.sql import functions as F

from hearthgraph.carriers import Catalog
from hearthgraph.plans import audit


@pytest.fixture(scope="module")
def cat(spark):
    return Catalog(spark, "/root/testdata/sf0.001")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_table_of_the_tree_goes_through_the_driver(cat):
    for table in (cat.edges, cat.people, cat.parent_pairs, cat.marriages):
        assert "Broadcast" not in plan(table)
    written = cat.written()
    for rule in audit.RULES:
        if rule.name != "duplicateDetection":  # sends counted, bounded tables
            assert "Broadcast" not in plan(rule.rows(written)), rule.name
    assert "Broadcast" not in plan(audit.summary(audit.findings(cat, tuple(r for r in audit.RULES if r.name != "duplicateDetection"))))


def test_duplicates_send_counted_tables_only(cat):
    left = plan(audit.summary(audit.findings(cat, tuple(r for r in audit.RULES if r.name == "duplicateDetection"))))
    assert left.count("BroadcastExchange") <= 1


def test_nameless_people_get_issues_only(cat):
    rules = tuple(audit.Rule(f"{over}-{category}-{subject}", category, over, certain="true", severity="info", subject=subject)
                  for category in ("issue", "research", "gap") for over, subject in (("people", "id"), ("people", "n_parents"), ("parent_pairs", "c_id"), ("marriages", "other")))
    made = tuple(audit.Rule(f"made-{c}", c, make=lambda t: t.people.select(F.col("id").alias("profile_id"), F.lit("info").alias("severity"), F.array().cast("array<long>").alias("related"))) for c in ("issue", "gap"))
    nameless = {r.id for r in cat.profiles.where("given IS NULL OR given = '?'").collect()}
    want = sorted((r.name, x.profile_id) for r in rules + made for x in r.rows(cat).collect() if r.category == "issue" or x.profile_id not in nameless)
    got = audit.findings(cat, rules + made).collect()
    assert sorted((r.rule_id, r.profile_id) for r in got) == want and nameless and len({r.rule_id for r in got}) == 14
