"""Queries that are SQL text over the session's functions; each gives what its counterpart in the DataFrame API gives."""

from __future__ import annotations

from pyspark.sql import DataFrame

from roleflow.functions import in_sql
from roleflow.plans import analytics, rules, texts
from roleflow.plans.bindings import AS_OF, Registry, bound
from roleflow.plans.cards import _ITEMS as _CARDS
from roleflow.plans.cards import _listing
from roleflow.session import table

REGISTRY = Registry()


def _same(registry: Registry, name: str, columns: str):
    """Register a query whose check is that of ``name``, of which it gives some columns."""

    def put(f):
        REGISTRY.queries[f.__name__] = f
        REGISTRY.sql[f.__name__] = f"SELECT {columns} FROM ({registry.sql[name]})"
        return f

    return put


def _run(spark, text: str, **views: DataFrame) -> DataFrame:
    in_sql.register(spark)
    return spark.sql(text, **views)


@_same(texts.REGISTRY, "exact_title_keys", "*")
def title_keys_in_sql(spark, sf):
    return _run(spark, "SELECT exact_key(org, title) AS key, min(id) AS first_id, count(*) AS n FROM {role} GROUP BY 1", role=bound(spark, sf, "role"))


@_same(rules.REGISTRY, "link_keys", "id, k, req")
def requisitions_in_sql(spark, sf):
    links = table(spark, sf, "lineitem").selectExpr("l_orderkey AS id", "l_linenumber AS k", f"{rules._LINKS} AS url")
    return _run(spark, "SELECT id, k, requisition_key(url) AS req FROM {links}", links=links)


@_same(analytics.REGISTRY, "company_tier", "*")
def tiers_in_sql(spark, sf):
    return _run(spark, "SELECT company_key, company_tier(company_key % 101, company_key * 7 % 101) AS tier FROM {company}", company=bound(spark, sf, "company"))


@_same(texts.REGISTRY, "date_facts", "*")
def date_facts_in_sql(spark, sf):
    text = f"SELECT id, days_since(first_seen, {AS_OF}) AS age, is_expired(deadline, {AS_OF}) AS expired, is_stale(last_seen, {AS_OF}) AS stale, is_gone(deadline, last_seen, {AS_OF}) AS gone FROM {{vacancy}}"
    return _run(spark, text, vacancy=bound(spark, sf, "vacancy"))


@REGISTRY.add(f"WITH {_CARDS} SELECT page_id, count(*) AS n FROM card WHERE n < 3 AND r = 1 GROUP BY page_id")
def cards_in_sql(spark, sf):
    """The table function beside each page; of pages of marketing prose there are none among the given ones."""
    return _run(spark, "SELECT p.page_id, count(*) AS n FROM {pages} p, LATERAL job_cards(p.html, p.url) c GROUP BY p.page_id", pages=_listing(table(spark, sf, "pages")))
