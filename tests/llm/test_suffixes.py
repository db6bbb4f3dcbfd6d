import hashlib
import random

import numpy as np
import pytest

from roleflow.llm import suffixes


def brute(texts, least):
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for t in raw:
        for i in range(len(t) - least + 1):
            seen[t[i : i + least]] = seen.get(t[i : i + least], 0) + 1
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - least + 1):
            if seen[t[i : i + least]] > 1:
                gone[i : i + least] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def sample():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéß ") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(120), prose(400)
    texts = [None, "", "short", base, base, passage, "x" * 1500, prose(30) + passage + prose(50), prose(10) + passage, prose(300) + passage[:700], "ab" * 600 + prose(20)]
    for _ in range(12):
        i = rng.randint(100, len(base) - 200)
        texts.append(base[:i] + prose(2) + base[i + 20 :])
    twice = prose(90)
    return [*texts, prose(20) + twice + prose(30) + twice, *[prose(rng.randint(1, 300)) for _ in range(20)]]


@pytest.mark.parametrize("crowd", [2 << 20, 1500])
def test_matches_brute_force(spark, crowd):
    texts = sample()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffixes.remove_repeats(docs, suffixes.Settings(crowd=crowd, block=4000), digest=True).orderBy("doc_id").collect()
    want = brute(texts, 400)
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"]) for r in got] == want
    assert sum(w[1] > 0 for w in want) > 15


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.remove_repeats(docs).collect() == []


def test_long_prefixes_small():
    texts = [b"banana", b"bandana", b"an"]
    flags = suffixes.repeated_starts(texts, 3)
    for t, f in zip(texts, flags, strict=True):
        for i in range(len(t) - 2):
            n = sum(u[j : j + 3] == t[i : i + 3] for u in texts for j in range(len(u) - 2))
            assert f[i] == (n > 1), (t, i)
