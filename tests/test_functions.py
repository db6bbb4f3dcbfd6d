"""Column functions against small invented rows."""

import pytest
from pyspark.sql import functions as F

from roleflow.functions import keys as K
from roleflow.functions import places as P
from roleflow.functions import text as T
from roleflow.functions import values as D


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


LONG = "You will build reliable tools with a small team. " * 30


def test_clean_description(spark):
    texts = [
        None,
        "  ",
        "We use cookies to improve. Accept all cookies. Consent settings. ",
        "404 not found. Sorry.",
        "Home About us Contact us Menu Login Careers Subscribe",
        "Featured insights and latest news. " * 10,
        "Short but real text.",
        LONG,
        "We use cookies. Accept cookies now.\n" + LONG,
        LONG + " This website uses cookies and more.",
        "<p>" + LONG + "</p><li>item</li>",
    ]
    got = column(spark, texts, T.clean_description)
    assert [g["verdict"] for g in got] == ["empty", "empty", "cookie_wall", "error_page", "nav_junk", "marketing_page", "too_short", "ok", "ok", "ok", "ok"]
    assert got[8]["text"].startswith("You will") and "website uses" not in got[9]["text"] and "- item" in got[10]["text"]
    assert got[3]["text"] is None


def test_blacklist_edges(spark):
    titles = ["C++ Developers", "c++", "abc++", "Fellows", "Fellowship", "Sales Coach", "superintern", None]
    got = column(spark, titles, lambda c: T.blacklist_term(c, ["c++", "fellow", "coach"], ["intern"]))
    assert got == ["c++", "c++", None, "fellows", None, "coach", "intern", None]


def test_not_a_vacancy(spark):
    rows = [("US TEST JOB - DO NOT APPLY", ""), ("Impact Accelerator Program", ""), ("Program Manager", ""), ("Strategic Programs", "Requirements: a. How to apply: b"), ("", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, d string")
    got = [r["y"] for r in df.select("i", T.not_a_vacancy_reason(F.col("t"), F.col("d")).alias("y")).orderBy("i").collect()]
    assert got == ["test posting, not a real job", "a program or grant to apply to, not a job", None, None, None]


def test_titles(spark):
    same = ["Heads of Community, London", "Head of Community (Remote)", "Senior Head of Community - Remote", "head of community (3 openings)", "Head, of Community #REQ-12"]
    keys = column(spark, same, lambda c: K.strong_title(c, ("London",)))
    assert set(keys) == {"head of community"}
    other = column(spark, ["CEO", "Chief Executive Officer", "Senior", "Program Officer, Climate", "Médecins"], K.strong_title)
    assert other == ["chief executive officer", "chief executive officer", "senior", "program officer climate", "médecin"]
    assert column(spark, ["Remote", "Remote, Remote"], K.strip_places) == ["Remote", "Remote"]
    segments = column(spark, ["Founder — Charity Entrepreneurship Incubation Program"], lambda c: F.size(K.segment_keys(F.lit("x"), c)))
    assert segments == [1]


def test_urls(spark):
    urls = ["HTTPS://Ex.ORG/Jobs/1/?utm_source=a&id=3&ref=z#top", "https://e.org/?jid=9utm_source=PG", "", None, "https://e.org/a?source=x"]
    assert column(spark, urls, K.apply_url) == ["https://ex.org/Jobs/1?id=3", "https://e.org?jid=9", "", "", "https://e.org/a"]
    ids = ["https://boards.greenhouse.io/acme/jobs/123?x=1", "https://x.org/?gh_jid=77", "https://jobs.lever.co/a/01234567-89ab-cdef-0123-456789abcdef", "https://e.org/1"]
    assert column(spark, ids, K.requisition_key) == ["greenhouse:123", "greenhouse:77", "lever:01234567-89ab-cdef-0123-456789abcdef", None]


def test_names(spark):
    got = column(spark, ["The Médecins of Ü Foundation", "Acme Inc", "Co", "A & B Ltd 2"], K.name_tokens)
    assert got == [["medecins", "u"], ["acme"], ["co"], ["b"]]


def test_dates_and_scores(spark):
    dates = column(spark, ["Deadline: 2026-02-30", "Apply by 3 March 2026", "closing date: March 4, 2026", "2026-01-01", None], D.deadline_of)
    assert [str(d) if d else None for d in dates] == [None, "2026-03-03", "2026-03-04", None, None]
    assert column(spark, ["7", "101", "x", None, "-1"], D.score_of) == [7, None, None, None, None]
    pay = column(spark, ["Salary: $60,000 - $84,000 a year", "budget: pay for $1,000,000 portfolio", "none"], D.pay)
    assert (pay[0]["low"], pay[0]["high"]) == (5000.0, 7000.0) and pay[1]["low"] is None and pay[2]["text"] is None


@pytest.mark.parametrize(
    "places, gone",
    [([], False), ([("onsite", "Xland", "R")], True), ([("onsite", "Xland", "R"), ("remote", None, None)], False), ([("onsite", None, "R")], False), ([("onsite", "Keepland", "Z")], False), ([("onsite", "Other", "Z")], True)],
)
def test_exclusion(spark, places, gone):
    df = spark.createDataFrame([(places,)], "l array<struct<work_mode:string,country:string,region:string>>")
    assert df.select(P.all_excluded(F.col("l"), ["Keepland"], ["Xland"], ["Z"]).alias("y")).first()["y"] is gone


def test_modes_and_countries(spark):
    assert column(spark, ["Remote, US", "hybrid / remote", "On-site", "Paris"], P.work_mode) == ["remote", "hybrid", "onsite", None]
    got = column(spark, ["Berlin", None], lambda c: P.canonical_country(F.lit(None).cast("string"), c, F.lit("somewhere in uk"), {"berlin": "Germany"}, {"uk": "United Kingdom"}))
    assert got == ["Germany", "United Kingdom"]


def test_a_long_consent_text(spark):
    """The banner goes on over tens of thousands of words; the gap, the paragraph's end and a wide gap stop it."""
    wall = "we use cookies. " + "cookie policy and consent text here " * 20_000
    gap = "x" * 701
    texts = [wall, wall + gap + " " + LONG, "We use cookies. Accept cookies\nsoon.\n\n" + LONG, "We use cookies. " + gap + " consent " + LONG]
    assert column(spark, texts, T.is_cookie_boilerplate) == [True, False, False, False]
    got = column(spark, texts, T.strip_cookie_boilerplate)
    assert got[0] == "text here" and got[1].startswith("text here xxx") and got[2] == LONG.strip() and got[3].startswith(". xxx")


def test_costly_parts_of_keys_are_named_once(spark):
    """Before, a lambda made the whole title anew for each of its segments, and each link for each other one."""
    row = spark.createDataFrame([("Org", "Senior VP of Ops, Data Engineers of Health, Remote")], "org string, title string")
    plan = row.select(K.segment_keys(F.col("org"), F.col("title")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("chief executive officer") <= 4
    assert row.select(K.strong_title(F.col("title"))).first()[0] == "vice president of operation data engineer of health"
    assert row.select(K.segment_keys(F.col("org"), F.lit("One segment only"))).first()[0] == []


def test_a_gate_judges_a_text_once_and_stems_spare_only_what_cannot_match(spark):
    row = spark.createDataFrame([("t", "d", "", "")], "title string, text string, snippet string, url string")
    plan = row.select(T.gate_reason(*[F.col(c) for c in row.columns], ("w",)))._jdf.queryExecution().analyzed().toString()
    assert plan.count("RLIKE(lambda") and plan.count("(?i)tap to unmute") <= 2
    shown = ["FUNCTION x() { jQuery( Window.Location", "TYPEOF a == 1 DOCUMENT.write document.cookie", "quiet text"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(shown)], "id long, t string")
    assert [r[0] for r in rows.orderBy("id").select(T.is_script_junk(F.col("t"))).collect()] == [True, True, False]
    label = ["Home", "ABOUT US", "about", "Terms Of Service", "News Center", "skip to MAIN content", "Who we are"]
    long = spark.createDataFrame([(i, " ".join(label[i : i + 4]) + " prose" * 200) for i in range(4)] + [(9, " ".join(label[:3]) + " prose" * 200)], "id long, t string")
    assert [r[0] for r in long.orderBy("id").select(T.is_navigation_junk(F.col("t"))).collect()] == [True] * 4 + [False]
    market = spark.createDataFrame([("LATEST NEWS. Funding Partners.",), ("Grants range from 1. We're funding it.",), ("Full story",)], "t string")
    assert [r[0] for r in market.select(T.is_marketing_page(F.col("t"))).collect()] == [True, True, False]
