"""The similarity join of titles against all pairs by the measure."""

import random
from difflib import SequenceMatcher

import pytest

from roleflow.operators import lookalike as A


@pytest.fixture(autouse=True, scope="module")
def one_partition(spark):
    """Small rows: a state store or a task each for every partition would be most of the time."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def ratio(x, y):
    return SequenceMatcher(None, x, y, autojunk=False).ratio()


def test_matching_blocks_are_those_of_the_measure():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcé 𝄞") for _ in range(rng.randint(0, n)))
    x, y = [text(40) for _ in range(1500)], [text(40) for _ in range(1500)]
    x += ["", "a", "same text", "x" * 700, "ab" * 400]
    y += ["b", "", "same text", "x" * 300 + "y" + "x" * 399, "ba" * 400]
    want = [sum(b.size for b in SequenceMatcher(None, p, q, autojunk=False).get_matching_blocks()) for p, q in zip(x, y)]
    assert A.matched(x, y).tolist() == want
    assert A.matched([], []).tolist() == []


@pytest.mark.parametrize("least", [0.7, 0.85, 0.9])
def test_pairs_are_those_of_brute_force(spark, least):
    rng = random.Random(7)
    words = ["data", "analyst", "senior", "policy", "lead", "a", "of", "officer", "programme", "ab", "b"]
    titles = []
    for _ in range(260):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(t) + 1)
            t = t[:i] + rng.choice(["", "x", "-"]) + t[i + rng.randint(0, 1) :]
        titles.append(t)
    titles += ["a", "ab", "abc", "b", "", " ", "aaaa", "aaaaa", "aab"]
    rows = [(i, "ab"[i % 7 == 0], t) for i, t in enumerate(titles)] + [(1000, "a", None), (1001, None, "data"), (1002, None, "data"), (1003, "a", titles[1]), (1004, "a", titles[1])]
    df = spark.createDataFrame(rows, "id long, org string, title string")
    got = {(r["left_id"], r["right_id"]): (r["ratio"], r["same"]) for r in A.title_pairs(df, least, compared=df["title"], same=df["title"]).collect()}
    first = {}
    for i, org, t in rows:
        if org and t:
            first.setdefault((org, t), i)
    kinds = sorted((i, org, t) for (org, t), i in first.items())
    want = {(i, j): (round(ratio(x, y), 4), False) for n, (i, o, x) in enumerate(kinds) for j, p, y in kinds[n + 1 :] if o == p and ratio(x, y) >= least}
    assert got == want and len(want) > 9


def test_titles_of_one_class_are_a_star(spark):
    rows = spark.createDataFrame([(3, "o", "Senior Data Analyst"), (5, "o", "Data Analyst"), (9, "o", "Data Analysts"), (4, "o", "data analyst"), (7, "p", "Data Analyst")], "id long, org string, title string")
    got = {(r["left_id"], r["right_id"], r["same"]) for r in A.title_pairs(rows).collect()}
    assert got == {(3, 4, True), (3, 9, True)}


def test_a_bound_must_follow(spark):
    with pytest.raises(ValueError):
        A.title_pairs(spark.createDataFrame([(1, "o", "a")], "id long, org string, title string"), 0.6)


def test_candidates_stay_few(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 9)))
    vocabulary = [word() for _ in range(800)]
    rows = spark.createDataFrame([(i, "one", " ".join(rng.choice(vocabulary) for _ in range(4))) for i in range(1500)], "id long, org string, title string")
    kinds = A._bags(rows.selectExpr("org", "title as text", "title as same", "id"))
    assert A.candidates(kinds, 0.85).count() < 1500
