"""Line deduplication against a plain count of lines, with resident and with sharded keys."""

import random
from collections import defaultdict

import numpy as np
import pytest

from roleflow.llm import lines

SCHEMA = "doc_id long, text string, n_lines string, kept string, hi string, doc string, lost string"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows, least=3, chars=20):
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= chars:
                held[key(line)].add(-(1 << 63) if doc is None else doc)
    out = []
    for doc, text, *_ in rows:
        own = (text or "").split("\n")
        me = -(1 << 63) if doc is None else doc
        kept = [x for x in own if not (len(held[key(x)]) >= least and max(held[key(x)]) != me)]
        out.append((doc, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def rows():
    rng = random.Random(2)
    common = [f"line number {i} that many documents share" for i in range(60)] + ["ÄÖÜ äöü ÉÉÉ éé ÀÀ ßß ñ", "x" * 19, "y" * 20, "é" * 19, "é" * 20]
    out = []
    for i in range(150):
        own = [rng.choice(common) for _ in range(rng.randint(0, 9))] + [f"only here {i} {j} and nowhere else" for j in range(rng.randint(0, 3))]
        own = [rng.choice(["", " ", "\t\r", "\x0b"]) + (x.upper() if x.isascii() and rng.random() < 0.3 else x) + rng.choice(["", "\r", "  "]) for x in own]
        rng.shuffle(own)
        out.append((i, "\n".join(own)))
    out += [(150, None), (151, ""), (None, common[0] + "\n" + common[1]), (None, common[0]), (152, "\n\n\n"), (153, "z" * 100_000), (154, "\n".join(common * 50)), (-5, common[2])]
    out += [out[3], out[3], out[4], (155, "held by one id only but thrice"), (155, "held by one id only but thrice"), (155, "held by one id only but thrice")]
    return [(a, b, "x", "x", "x", "x", "x") for a, b in out]


@pytest.mark.parametrize("settings", [lines.Settings(), lines.Settings(resident=8, shard=7), lines.Settings(resident=1, shard=1000), lines.Settings(shard=3)])
def test_lines_match_brute_force(spark, settings):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in lines.remove_lines(docs, settings).collect()), key=str)
    assert got == brute(rows())


def test_distinct_ids_take_one_shuffle_and_agree(spark):
    own = [r for r in {r[0]: r for r in rows() if r[0] is not None}.values()]
    docs = spark.createDataFrame(own, SCHEMA)
    assert sorted((tuple(r) for r in lines.remove_lines(docs).collect()), key=str) == brute(own)
    none = spark.createDataFrame([], SCHEMA)
    assert lines.remove_lines(none).collect() == [] and lines.remove_lines(none, digest=True).collect() == []


def test_the_hash_is_perfect_and_minimal_and_strangers_are_told():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 64, 5000, 70_000):
        hi, lo = rng.integers(-(1 << 63), 1 << 63, (2, n))
        if n:
            hashed = lines.PerfectHash.build(hi, lo)
            assert sorted(hashed.slots(hi, lo).tolist()) == list(range(n))
            assert hashed.sizes.sum() < 6 * max(n, 64)
    import pyarrow as pa

    table = lines._build(pa.table({"shard": np.zeros(n, np.int32), "hi": hi, "lo": lo, "n": np.arange(n) + 3, "last": np.arange(n)}))
    shard = lines.Shard(table.to_pylist()[0])
    known, last = shard.probe(hi, lo, 3)
    assert known.all() and (last == np.arange(n)).all() and (shard.probe(hi, lo, 1003)[0] == (np.arange(n) >= 1000)).all()
    other = rng.integers(-(1 << 63), 1 << 63, (2, 100_000))
    assert not shard.probe(other[0], other[1], 3)[0].any()
    # Keys that agree in one half only are different.
    assert not shard.probe(hi, lo ^ 1, 3)[0].any()
    same = lines.PerfectHash.build(np.zeros(100, np.int64), np.arange(100))
    assert sorted(same.slots(np.zeros(100, np.int64), np.arange(100)).tolist()) == list(range(100))
