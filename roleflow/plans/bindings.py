"""Postings, employers, boards and events read from the given tables: the same expressions for Spark and for the check in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from roleflow.session import table

AS_OF = "DATE '2001-08-10'"

#: Name: table and expressions, all of which both engines read alike.
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "vacancy": (
        "orders",
        (
            "o_orderkey AS id",
            "o_custkey AS company_id",
            "CASE o_orderpriority WHEN '1-URGENT' THEN 'liked' WHEN '2-HIGH' THEN 'applied' WHEN '3-MEDIUM' THEN 'unseen' WHEN '4-NOT SPECIFIED' THEN 'passed' "
            "ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'archived' WHEN o_orderkey % 3 = 1 THEN 'unseen' ELSE 'expiring' END END AS status",
            "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) % 101 END AS score",
            "CAST(o_orderdate AS DATE) AS first_seen",
            "CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INT) AS last_seen",
            "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INT) END AS deadline",
            "concat('board', o_custkey % 12) AS board",
        ),
    ),
    "company": (
        "customer",
        ("c_custkey AS company_key", "c_name AS company", "c_nationkey AS nation", "c_acctbal AS balance", "c_mktsegment AS segment", "CAST(c_custkey % 4 AS INT) AS rank"),
    ),
    "posting": (
        "documents",
        ("doc_id AS id", "source AS org", "lang", "split_part(text, chr(10), 1) AS title", "text AS description", "least(100, CAST(floor(n_chars / 50) AS BIGINT)) AS score"),
    ),
    "role": ("part", ("p_partkey AS id", "p_brand AS org", "p_name AS title", "CAST(p_size * 2 AS BIGINT) AS score", "p_type AS kind")),
    "seen": (
        "events",
        ("event_id AS id", "user_id AS source", "event_type AS status", "value", "ts", "CAST(ts AS DATE) AS day"),
    ),
}


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, expressions = VIEWS[name]
    return table(spark, sf_dir, source).selectExpr(*expressions)


def sql(body: str, *names: str) -> str:
    """``body`` over the named views."""
    views = ", ".join(f"{n} AS (SELECT {', '.join(VIEWS[n][1])} FROM {VIEWS[n][0]})" for n in names)
    return f"WITH {views}{', ' if body.lstrip().startswith('+') else ' '}{body.lstrip().removeprefix('+')}" if names else body


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, body: str | None = None, *views: str):
        """Register a query under its function's name, with the SQL that must give the same rows."""

        def put(f):
            self.queries[f.__name__] = f
            if body:
                self.sql[f.__name__] = sql(body, *views)
            return f

        return put
