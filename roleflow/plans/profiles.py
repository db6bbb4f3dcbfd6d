"""Queries of what profiles say of employers: a profile for each supplier, written by a rule over its row."""

from __future__ import annotations

from pyspark.sql import functions as F

from roleflow.operators import profile as P
from roleflow.plans.bindings import Registry
from roleflow.session import table

REGISTRY = Registry()
q = REGISTRY.add


def _rules(spark, sf: str) -> P.EmployerRules:
    key = F.col("s_suppkey")
    text = F.concat(
        F.lit(f"About me\n## {P.TITLES}\n<!-- - hidden :: x\n-->\n- "), "s_name", F.lit(" :: Alpha, desc: beta "), (key % 3).cast("string"), F.lit(", none\n"),
        F.when(key % 5 == 0, "- broken").otherwise(F.concat(F.lit("* N"), F.col("s_nationkey").cast("string"), F.lit(" :: gamma,GAMMA"))), F.lit(f"\n\n## {P.NEVER}\n"),
        F.when(key % 4 == 0, "prose only").otherwise(F.concat(F.lit("- B"), (key % 7).cast("string"))), F.lit("\n## OTHER\n- nobody"),
    )
    return P.employer_rules(table(spark, sf, "supplier").select(key.alias("profile"), text.alias("text")))


@q(
    """SELECT s_suppkey AS profile, s_name AS name, 'title' AS scope, 'alpha' AS pattern FROM supplier
UNION ALL SELECT s_suppkey, s_name, 'desc', 'beta ' || s_suppkey % 3 FROM supplier
UNION ALL SELECT s_suppkey, 'N' || s_nationkey, 'title', 'gamma' FROM supplier WHERE s_suppkey % 5 > 0"""
)
def profile_includes(spark, sf):
    return _rules(spark, sf).includes


@q("SELECT s_suppkey AS profile, 'B' || s_suppkey % 7 AS name FROM supplier WHERE s_suppkey % 4 > 0")
def profile_bans(spark, sf):
    return _rules(spark, sf).never


@q(
    """SELECT s_suppkey AS profile, 'COMPANY_TITLE_FILTERS' AS section, '- broken' AS line, 'no patterns after ::' AS reason FROM supplier WHERE s_suppkey % 5 = 0
UNION ALL SELECT s_suppkey, 'COMPANY_NEVER_FETCH', 'prose only', 'no entry, so inactive' FROM supplier WHERE s_suppkey % 4 = 0"""
)
def profile_warnings(spark, sf):
    return _rules(spark, sf).warnings.drop("at")
