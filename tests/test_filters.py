import datetime as dt

from pyspark.sql import functions as F

from roleflow.operators import filters as X


def test_company_rules(spark):
    rows = spark.createDataFrame([(1, "WFP ", "Product Manager", "innovation lab"), (2, "wfp", "Product Manager", None), (3, "Banned", "x", ""), (4, "Free", "x", "")], "id long, org string, title string, description string")
    includes = spark.createDataFrame([("WFP", "desc", "innovation"), ("WFP", "title", "driver")], "name string, scope string, pattern string")
    out = X.company_reasons(rows, includes, spark.createDataFrame([("banned",)], "name string"))
    assert {r["id"]: r["reason"] for r in out.collect()} == {1: None, 2: "company_title_filter", 3: "company_never_fetch", 4: None}
    assert {r["reason"]: r["n"] for r in X.dropped(out).collect()} == {"company_title_filter": 1, "company_never_fetch": 1}


def test_keywords_and_mail(spark):
    rows = spark.createDataFrame([(1, "Data Lead", ["Oslo, NO"]), (2, "Data Intern", ["Oslo"]), (3, "Cook", ["Oslo"]), (4, "Data Lead", [])], "id long, t string, tags array<string>")
    kept = rows.where(X.keyword_filter(F.col("t"), F.col("tags"), include=["data"], exclude=["intern"], places=["oslo"]))
    assert [r["id"] for r in kept.collect()] == [1]
    mails = spark.createDataFrame([(1, "Me <me@x.org>", "Offer"), (2, "a@jobs.acme.com", "hi"), (3, "b@z.io", "Your interview"), (4, "c@spam.com", "interview"), (5, "d@mail.ats.com", "x"), (6, "e@q.org", "x")], "id long, f string, s string")
    rule = X.mail_reason(F.col("f"), F.col("s"), own=["me@x.org"], excluded=["spam.com"], platforms=["ats.com"], employers=["acme.com"], phrases={"interview": "invite"})
    assert [r["y"] for r in mails.select("id", rule.alias("y")).orderBy("id").collect()] == [None, "employer", "invite", None, "platform", None]


def test_reports_about_rules(spark):
    boards = spark.createDataFrame([("a", ["climate", "c++"]), ("b", ["health"]), ("c", ["climate policy"])], "board string, tags array<string>")
    assert [r["board"] for r in X.board_matches(boards, "Work on climate and healthcare").collect()] == ["a"]
    words = spark.createDataFrame([("sales", 5, 0), ("cold", 9, 1), ("quota", 7, 0)], "word string, hits long, good long")
    factors = spark.createDataFrame([("selling", "Sales"), ("selling", "quota"), ("cold", "cold")], "factor string, keyword string")
    assert [tuple(r) for r in X.factor_keywords(words, factors).collect()] == [("selling", "quota", 7)]
    companies = spark.createDataFrame([("A", None, ["B"]), ("B", "ats", ["Zed"])], "name string, strategy string, aliases array<string>")
    assert sorted(tuple(r) for r in X.registry_faults(companies, companies).collect()) == [("dangling_alias", "Zed"), ("missing_field", "A")]
    reports = spark.createDataFrame([("s1", "grant", dt.date(2026, 1, 1)), ("s2", "grant", dt.date(2026, 2, 1)), ("s3", "odd", dt.date(2026, 1, 1))], "slug string, kind string, updated date")
    assert {r["slug"]: (r["group_place"], r["place"]) for r in X.grouped_reports(reports).collect()} == {"s2": (2, 1), "s1": (2, 2), "s3": (5, 1)}
