"""Runs of words against every period of every stretch."""

import random
import zlib

import numpy as np

from roleflow.llm import periodic, queries

SCHEMA = "doc_id long, text string, runs string, collapsed string, words string, g string, n string, a string, p string"


def brute(words, least=6, times=4):
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, times * q):
                found.setdefault((start, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


def texts():
    rng = random.Random(9)
    out = [None, "", "  \n\t ", "one", "a " * 5, "a " * 6, "a b " * 4, "a b " * 3 + "a", "x " + "a b c " * 6 + "y", "a a b " * 5 + "a a", "\x85a\x85  b " * 4]
    for _ in range(250):
        alphabet = "abcdefghij"[: rng.choice([1, 2, 2, 3, 5, 10])]
        words = [rng.choice(alphabet) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            at, piece = rng.randint(0, len(words)), [rng.choice(alphabet) for _ in range(rng.randint(1, 9))]
            words[at:at] = (piece * rng.randint(2, 9))[: rng.randint(1, 70)]
        out.append(" ".join(words))
    nested = ("a a a a a a b " * 5 + "c ") * 6
    fibonacci = ["a", "a b"]
    while len(fibonacci[-1]) < 1200:
        fibonacci.append(fibonacci[-1] + " " + fibonacci[-2])
    out += [nested, fibonacci[-1], "w " * 3000, "p q r s t u v " * 400 + "end", " ".join(f"u{i}" for i in range(5000)), "start " + " ".join(f"u{i % 700}" for i in range(4000))]
    return out


def test_runs_match_brute_force(spark):
    rows = [(i, t, *["x"] * 7) for i, t in enumerate(texts())] + [(None, "a " * 9, *["x"] * 7), (4, "a " * 5, *["x"] * 7)]
    got = periodic.collapse(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect()
    assert len(got) == len(rows)
    want = {}
    for doc, text, *_ in rows:
        runs = brute(split(text))
        want[doc] = (runs, collapsed(split(text), runs))
    for r in got:
        assert ([(x["start"], x["length"], x["period"]) for x in r["runs"]], r["collapsed"]) == want[r["doc_id"]]
    assert sum(len(r["runs"]) for r in got) > 200
    assert periodic.collapse(spark.createDataFrame([], SCHEMA)).collect() == []


def test_other_limits_and_texts_together():
    rng = random.Random(1)
    for settings in (periodic.Settings(), periodic.Settings(words=4, times=3), periodic.Settings(words=2, times=2), periodic.Settings(words=20, times=5)):
        many = [[rng.choice("ab" if i % 2 else "abcd") for _ in range(rng.randint(0, 50))] for i in range(80)]
        numbers = np.array(["abcd".index(w) for own in many for w in own], np.int64)
        off = np.r_[0, np.cumsum([len(x) for x in many])]
        doc, runs = periodic.runs_of(numbers, off, settings)
        got = [sorted((int(s - off[i]), int(e - s), int(q)) for s, e, q in runs[doc == i]) for i in range(80)]
        assert got == [brute(x, settings.words, settings.times) for x in many]


def test_runs_of_exactly_two_periods():
    """Such a run may hold no third word a period apart on either side of a boundary."""
    rng = random.Random(5)
    for words, text in ((2, "aa"), (4, "abab"), (2, "bacdacde"), *((rng.choice((2, 4, 7)), "".join(rng.choice("abc") for _ in range(rng.randint(2, 40)))) for _ in range(60))):
        _, runs = periodic.runs_of(np.array(["abcde".index(w) for w in text], np.int64), np.array([0, len(text)]), periodic.Settings(words=words, times=2))
        assert sorted((int(s), int(e - s), int(q)) for s, e, q in runs) == brute(list(text), words, 2), text


def test_the_grammar_derives_the_text():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 3, 500)
    glued = np.r_[rng.random(499) < 0.97, False]
    g = periodic.re_pair(words, np.arange(500), glued)

    def spell(s):
        return [int(s)] if g.left[s] < 0 else spell(g.left[s]) + spell(g.right[s])

    assert [w for s in g.roots for w in spell(s)] == words.tolist()
    inner = np.flatnonzero(g.left >= 0)
    assert all(spell(s) == words[g.first[s] : g.first[s] + g.length[s]].tolist() for s in inner)
    assert len({(a, b) for a, b in zip(g.left[inner], g.right[inner])}) == len(inner) < 400


def test_the_query_plants_periods_by_the_rule(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 90)))) for i in range(300)] + [(None, "a b c"), (300, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    made = {r["doc_id"]: r for r in queries.op13_periodic(spark, str(tmp_path)).collect()}
    planted = {r["doc_id"]: r["text"] for r in periodic.planted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    changed = 0
    for doc, text in rows:
        words = split(text)
        if doc is not None and (h := zlib.crc32(str(doc).encode())) % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            changed += 1
            assert planted[doc].split() == words
        runs = brute(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        r = made[doc]
        assert r["n_runs"] == len(runs) and (r["start"], r["length"], r["period"]) == (best or (None, None, None))
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
    assert changed > 15
