"""Lifecycle, resolution, joins, screening and graph on small invented rows: boundaries and idempotence."""

import datetime as dt
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from roleflow.operators import identity as I
from roleflow.operators import joins as J
from roleflow.operators import lifecycle as L
from roleflow.operators import ranking as K
from roleflow.operators import resolve as R
from roleflow.operators import rollups as G
from roleflow.operators import screening as S
from roleflow.operators.graph import connected_components

DAY = dt.date(2026, 6, 23)
as_of = lambda: F.lit(DAY)
ago = lambda n: DAY - dt.timedelta(days=n)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 3), (5, 6), (6, 5)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(3, None), (None, None), (4, 9)]])
def test_components(spark, edges):
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert got == {x: root(x) for x in parent}


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, v string, w string")
    change = spark.createDataFrame([(2, "c", "z"), (3, "d", "q")], "id long, v string, w string")
    once = L.upsert(base, change, ["id"], keep=["w"])
    assert sorted(once.collect()) == [(1, "a", "x"), (2, "c", "y"), (3, "d", "q")]
    assert sorted(L.upsert(once, change, ["id"], keep=["w"]).collect()) == sorted(once.collect())


def test_expiry_and_staleness_boundaries(spark):
    rows = spark.createDataFrame(
        [(1, "unseen", 60, DAY, "b", ago(14)), (2, "unseen", 60, ago(1), "b", ago(15)), (3, "unseen", 59, ago(1), "b", ago(15)), (4, "liked", 10, ago(1), "b", ago(30)), (5, "unseen", None, None, "c", ago(30))],
        "id long, status string, score int, deadline date, board string, last_seen date",
    )
    got = {r["id"]: r["new_status"] for r in L.expire(rows, as_of()).collect()}
    assert got == {1: "unseen", 2: "expiring", 3: "passed", 4: "liked", 5: "unseen"}
    assert {r["id"] for r in L.stale(rows, spark.createDataFrame([("b",)], "board string"), as_of()).collect()} == {2, 3}


def test_gone_and_tombstones(spark):
    rows = spark.createDataFrame([(1, 7, "unseen", 60, "k1", "n1"), (2, 7, "unseen", 59, "k2", "n2"), (3, 7, "unseen", 1, "k3", "n3"), (4, 8, "unseen", 1, "k4", "n4"), (5, 7, "liked", 1, "k5", "n5")], "id long, company_id long, status string, score int, key string, norm string")
    listing = spark.createDataFrame([(7, "n3")], "company_id long, key string")
    gone = L.gone_from_source(rows, listing)
    assert {r["id"]: r["new_status"] for r in gone.collect()} == {1: "expiring", 2: "archived"}
    assert {r["key"] for r in L.tombstones(gone, "gone_from_source", as_of()).collect()} == {"k2", "n2"}


def test_tombstone_reasons(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "key string")
    stones = spark.createDataFrame([("a", "gone_from_source", ago(1)), ("b", None, ago(1)), ("c", "low", ago(91))], "key string, reason string, archived_at date")
    keep = lambda gone: {r["key"] for r in J.without_tombstones(rows, stones, as_of(), include_gone=gone).collect()}
    assert keep(False) == {"a", "c", "d"} and keep(True) == {"c", "d"}


def test_status_rules(spark):
    rows = spark.createDataFrame([(1, "applied", ago(9)), (2, "unseen", None)], "id long, status string, applied_at date")
    got = L.set_status(rows, F.lit("archived"), as_of()).orderBy("id").collect()
    assert [(r["new_status"], r["refused"]) for r in got] == [("applied", True), ("archived", False)]
    sent = L.set_status(rows, F.lit("interview"), as_of()).orderBy("id").collect()
    assert [r["new_applied_at"] for r in sent] == [ago(9), DAY]


def test_decisions(spark):
    asked = spark.createDataFrame([(1, "Ten years of  travel needed"), (2, "text"), (3, "text"), (4, "text"), (5, "text")], "id long, text string")
    said = spark.createDataFrame([(1, "KILL", 5, "years of travel", 1), (2, "KILL", 5, "absent", 1), (3, "KILL", 4, "text", 1), (4, "KEEP", None, None, 1), (4, "MAYBE", 1, "", 2), (9, "KEEP", 1, "", 1)], "id long, verdict string, confidence int, quote string, seq int")
    assert {r["id"]: r["outcome"] for r in L.decide(said, asked).collect()} == {1: "killed", 2: "held", 3: "held", 4: "kept", 5: "missing"}


def test_bulk_decision_is_all_or_nothing(spark):
    rows = spark.createDataFrame([(1, "unseen", 1, None), (2, "unseen", 2, None)], "id long, status string, revision int, applied_at date")
    ask = lambda rev: spark.createDataFrame([("a", 1, "unseen", 1, "applied"), ("a", 2, "unseen", rev, "applied")], "op string, id long, expected_status string, expected_revision int, new_status string")
    good = L.bulk_decision(rows, ask(2), as_of()).orderBy("id").collect()
    assert [(r["outcome"], r["status"], r["applied_at"]) for r in good] == [("applied", "applied", DAY)] * 2
    bad = L.bulk_decision(rows, ask(9), as_of()).orderBy("id").collect()
    assert [(r["outcome"], r["status"]) for r in bad] == [("held", "unseen"), ("conflict", "unseen")]


def test_compare_and_set_routes(spark):
    rows = spark.createDataFrame([(1, "unseen", None, "h"), (2, "liked", None, "h"), (3, "unseen", 40, "h"), (4, "unseen", 39, "h"), (5, "unseen", None, "h")], "id long, status string, score int, text_hash string")
    results = spark.createDataFrame([(1, "h", None, 5), (2, "h", None, 5), (3, "h", 40, 5), (4, "h", 39, None), (5, "other", None, 5), (6, "h", None, 5), (7, "h", None, 1), (7, "h", None, 1)], "id long, text_hash string, old_score int, score int")
    got = sorted((r["id"], r["outcome"]) for r in L.compare_and_set(rows, results).collect())
    assert got == [(1, "scored"), (2, "skipped"), (3, "skipped"), (4, "prepared"), (5, "skipped"), (6, "error"), (7, "error"), (7, "error")]


def test_quotes_and_maps(spark):
    row = spark.createDataFrame([(["Two  Words"], [], ["two words", "no"], "Has two words.", {"a": "1", "b": "2"}, {"b": "3"})], "a array<string>, b array<string>, c array<string>, t string, m map<string,string>, n map<string,string>")
    got = row.select(*[L.quotes_hold(F.col(c), F.col("t")).alias(c) for c in "abc"], L.merge_artifacts(F.col("m"), F.col("n")).alias("m")).first()
    assert (got["a"], got["b"], got["c"], got["m"]) == (True, True, False, {"a": "1", "b": "3"})


def test_title_pairs_match_the_measure(spark):
    titles = ["data analyst", "data analysts", "senior data analyst", "head of policy", "policy head", "data engineer", "", "x"]
    rows = spark.createDataFrame([(i, "org", t) for i, t in enumerate(titles)] + [(50, "else", "data analyst")], "id long, org string, title string")
    got = {(r["left_id"], r["right_id"]) for r in R.title_pairs(rows).where("not same").collect()}
    want = {(i, j) for i in range(len(titles)) for j in range(i + 1, len(titles)) if titles[i] and titles[j] and SequenceMatcher(None, titles[i], titles[j]).ratio() >= 0.85}
    same = {(r["left_id"], r["right_id"]) for r in R.title_pairs(rows).where("same").collect()}
    assert want <= got | same and (0, 2) in same


def test_company_names_meet(spark):
    companies = spark.createDataFrame([(1, "World Food Programme", ["WFP"], 0), (2, "Acme, Inc.", [], 1), (3, "Blue Ocean Lab", [], 2)], "company_key long, company string, aliases array<string>, rank int")
    names = spark.createDataFrame([("wfp",), ("Programme (Food World)",), ("ACME",), ("blueoceanlab",), ("BOL",), ("Unknown",)], "name string")
    got = {r["name"]: r["company_key"] for r in J.matching_companies(names, companies).collect()}
    assert got["wfp"] == 1 and got["ACME"] == 2 and got["blueoceanlab"] == 3 and got["BOL"] == 3 and "Unknown" not in got
    canonical = {r["name"]: r["canonical"] for r in J.resolve_names(names, companies).collect()}
    assert canonical["wfp"] == "World Food Programme" and canonical["Unknown"] == "Unknown"


def test_index_and_resolution(spark):
    schema = "id long, company_id long, org string, title string, description string, urls array<string>, status string, first_seen date"
    stored = spark.createDataFrame([(1, 1, "o", "Head of Data, London", None, ["https://x.org/1?utm_source=a"], "liked", ago(5)), (2, 1, "o", "Head of Data", None, [], "unseen", ago(9))], schema)
    index = J.key_index(stored)
    fresh = spark.createDataFrame([(10, 1, "o", "Heads of Data", None, [], "unseen", DAY), (11, 1, "o", "Other", None, ["https://x.org/1"], "unseen", DAY), (12, 1, "o", "New Role", None, [], "unseen", DAY)], schema)
    batch = J.key_index(fresh)
    got = {r["id"]: (r["match"], r["kind"]) for r in R.resolve(batch, index).collect()}
    assert got[11] == (1, "url") and got[12] == (None, None) and got[10][0] in (2, None)


def test_clusters_and_disposition(spark):
    members = spark.createDataFrame([(1, 1, "applied", ago(1), ["u"]), (1, 2, "applied", ago(1), ["u"]), (2, 3, "unseen", ago(1), ["a"]), (2, 4, "liked", ago(1), ["b"]), (3, 5, "unseen", ago(1), ["c", "d"]), (3, 6, "unseen", ago(1), ["c"]), (4, 7, "unseen", ago(1), ["z"])], "cluster long, id long, status string, last_seen date, urls array<string>")
    assert {r["cluster"]: r["disposition"] for r in R.review_disposition(members, as_of()).collect()} == {1: "manual", 2: "manual", 3: "merge"}


def test_folding_and_merging(spark):
    row = spark.createDataFrame([([("https://a.org/1?ref=x", None, None), ("https://a.org/1", "Paris", "FR"), ("https://a.org/2", None, None)],)], "p array<struct<url:string,city:string,country:string>>")
    assert [(x["url"], x["city"]) for x in row.select(R.fold_places(F.col("p")).alias("p")).first()["p"]] == [("https://a.org/1", "Paris"), ("https://a.org/2", None)]
    companies = spark.createDataFrame([(1, "A", ["x"]), (2, "B", ["X", "y"]), (3, "C", None)], "id long, name string, aliases array<string>")
    moved = spark.createDataFrame([(2, 1)], "loser long, survivor long")
    assert {r["id"]: r["aliases"] for r in R.merge_companies(companies, moved).collect()} == {1: ["b", "x", "y"], 3: []}
    children = spark.createDataFrame([(10, 2), (11, 3)], "child long, company long")
    assert sorted(R.repoint(children, moved, "company").collect()) == [(10, 1), (11, 3)]


def test_triage_inherits(spark):
    rows = spark.createDataFrame([(1, "k", "unseen", ago(9), "r"), (2, "k", "liked", ago(1), None), (3, "j", "odd", ago(2), None)], "id long, key string, status string, last_seen date, review string")
    got = {r["key"]: (r["id"], r["last_seen"], r["review"]) for r in R.triage(rows, ["liked", "unseen"]).collect()}
    assert got == {"k": (2, ago(1), "r"), "j": (3, ago(2), None)}


def test_requirements_need_one_element(spark):
    row = spark.createDataFrame([([("skill", "must"), ("language", "nice")], [(1, "gap")])], "r array<struct<kind:string,strength:string>>, c array<struct<requirement:int,finding:string>>")
    ask = lambda **k: row.select(S.requirement_matches(F.col("r"), F.col("c"), **k).alias("x")).first()["x"]
    assert ask(kind="language", finding="gap") and not ask(kind="skill", finding="gap") and not ask(kind="skill", strength="nice")


def test_message_parts_keep_order_and_limit(spark):
    rows = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate([4, 4, 30, 1, 9])], "g long, o int, t string")
    parts = [r["text"] for r in K.pack(rows, "g", "o", "t", 10).orderBy("part").collect()]
    assert parts == ["xxxx\nxxxx", "x" * 10, "x", "x" * 9]


def test_rollup_of_no_rows(spark):
    none = spark.createDataFrame([], "id long, status string, score int, deadline date, company_id long, first_seen date, board string")
    assert G.company_rollup(none).collect() == [] and G.application_counts(none).first()["sent"] == 0
    assert G.confusion(none, F.col("score") > 1, F.col("score") > 2).first()["f1"] is None


def test_of_judgements_with_one_seq_the_most_careful_counts(spark):
    asked = spark.createDataFrame([(i, "years of travel") for i in range(1, 5)], "id long, text string")
    said = [(1, "KILL", 5, "travel", 1), (1, "KEEP", 5, "travel", 1), (2, "KILL", 5, "travel", 1), (2, "KILL", 4, "travel", 1), (3, "KILL", 5, "travel", 1), (3, "KILL", 5, "absent", 1), (4, "KILL", 4, "travel", 1), (4, "KILL", 5, "travel", 2)]
    for rows in (said, said[::-1]):
        got = L.decide(spark.createDataFrame(rows, "id long, verdict string, confidence int, quote string, seq int"), asked)
        assert {r["id"]: r["outcome"] for r in got.collect()} == {1: "kept", 2: "held", 3: "held", 4: "killed"}


def produced(frame):
    """Rows that each join of the executed plan made."""
    frame.collect()
    seen, todo = [], [frame._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if "Join" in node.getClass().getSimpleName() and node.metrics().contains("numOutputRows"):
            seen.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return seen


def test_titles_of_a_link_meet_once_each(spark):
    day = dt.date(2026, 1, 1)
    rows = spark.range(400).select("id", F.date_sub(F.lit(day), (F.col("id") % 7).cast("int")).alias("first_seen"), F.when(F.col("id") % 2 == 0, "data lead").otherwise("cook").alias("title"), F.array(F.lit("u"), F.lit("")).alias("urls"))
    asked = spark.range(400).select(F.col("id").alias("ask"), F.lit("lead").alias("title"), F.array(F.lit("u"), F.lit("")).alias("urls"))
    found = I.by_posting_url(rows, asked)
    assert {(r["ask"], r["id"]) for r in found.collect()} == {(i, 6) for i in range(400)}
    assert max(produced(found)) <= 400


def test_first_holders_are_summed_by_parts(spark):
    rows = spark.createDataFrame([(1, 7, "url", "a", False, DAY), (2, 7, "url", "a", True, DAY), (3, 7, "url", "a", True, ago(2)), (4, 7, "url", "b", None, ago(9)), (5, 7, "url", "b", False, DAY), (6, 8, "url", "a", False, DAY)], "id long, company_id long, kind string, key string, decided boolean, first_seen date")
    first = J.first_of_keys(rows)
    assert {(r["company_id"], r["key"], r["id"]) for r in first.collect()} == {(7, "a", 3), (7, "b", 5), (8, "a", 6)}
    assert "Window" not in first._jdf.queryExecution().optimizedPlan().toString()
