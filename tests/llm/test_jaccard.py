"""The join against brute force, also where many sets share signatures and where buckets are crowded."""

import random

import pytest

from roleflow.llm import jaccard


def brute(texts, size, percent):
    sets = {}
    for i, t in texts:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def sample():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    line = prose(14)
    texts = []
    bases = [prose(n) for n in (1, 2, 4, 8, 12, 20, 40, 80, 150, 300, 600)]
    for base in bases:
        for edits in [0, 0, 1, 1, 1, 2, 2, 3, 4, 6, 8, 10, 15]:
            t = list(base)
            for _ in range(edits):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    texts += [" ".join(prose(rng.randint(5, 60)) + line + prose(rng.randint(5, 60))) for _ in range(60)]
    texts += [" ".join(line), " ".join(line).upper(), None, "", " "]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("size, percent, cells, hot", [(3, 90, 3, 16), (3, 90, 3, 2), (5, 80, 2, 16), (5, 80, 2, 1)])
def test_matches_brute_force(spark, size, percent, cells, hot):
    texts = sample()
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.groups(docs, jaccard.Settings(size, percent, cells, hot)).collect()}
    want = brute(texts, size, percent)
    assert got == want
    assert len({c for _, c in want.values()}) < len(texts) - 30


def test_small_sets_around_the_threshold(spark):
    """Many small sets with empty cells, some of them crowded: of a pair one side may leave out empty and the other crowded signatures."""
    rng = random.Random(23)
    common = [f"c{k}" for k in range(9)]
    texts = []
    for _ in range(60):
        base = [f"u{rng.randrange(10_000)}" for _ in range(rng.randint(4, 30))]
        for _ in range(6):
            t = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 2, 3])):
                t[rng.randrange(len(t))] = f"x{rng.randrange(10_000)}"
            at = rng.randrange(len(t) + 1)
            texts.append(" ".join(t[:at] + (common if rng.random() < 0.5 else []) + t[at:]))
    texts = list(enumerate(texts))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for hot in (1, 3):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.groups(docs, jaccard.Settings(5, 80, 2, hot)).collect()}
        assert got == brute(texts, 5, 80)


def test_one_large_group_of_near_copies(spark):
    """Copies that all share signatures, some linked by way of others only."""
    rng = random.Random(31)
    words = [f"w{k}" for k in range(3000)]
    base = [rng.choice(words) for _ in range(120)]
    texts = []
    for _ in range(400):
        t = list(base)
        for _ in range(rng.randint(0, 7)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    texts = list(enumerate(texts))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.groups(docs, jaccard.Settings(5, 80, 2)).collect()}
    want = brute(texts, 5, 80)
    assert got == want
    kept = {r["doc_id"] for r in jaccard.deduplicate(docs).collect()}
    assert kept == {c for _, c in want.values()}


def test_one_doc_id_with_different_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(3, a), (7, a), (7, b), (9, b), (9, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in jaccard.groups(docs, jaccard.Settings(5, 80, 2)).collect()} == {(3, 3), (7, 3), (9, 3)}
    assert sorted(tuple(r) for r in jaccard.deduplicate(docs).collect()) == [(3, a), (7, b)]
