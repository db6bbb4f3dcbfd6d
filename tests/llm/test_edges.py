"""Nulls, empty tables, repeated rows and clashing columns in every operator and stage."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from roleflow.llm import decontaminate, jaccard, langid, language_model, mixing, neighbours, quality, secrets, suffixes, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, row string, _t string, own string, size long, n_words string, words string, mark string, label string"


def rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioustrn") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    out = []
    for i in range(60):
        text = prose(rng.randint(1, 80)) + (" you idiot" if i % 6 == 0 else "")
        out.append((i, text, ("en", "de")[i % 2], f"s{i % 3}"))
    out += [(60, None, None, None), (61, "", "en", "s1"), (None, "no id here", "en", "s1"), (None, None, None, None), (62, "  \n\t ", "de", None), (63, "!!! ???", None, "s2"), (64, "x" * 200_000, "en", "s0")]
    out += [out[3], out[3], out[60]]
    return [(a, b, c, d, len(b or ""), 0.5, "x", "x", "x", "x", 1, "x", "x", "x", "x") for a, b, c, d in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 5 > 0), int(i % 6 == 0)) for i in range(60)] + [(None, 1, 1), (1, None, None), (2, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark, docs):
    text = docs.where("doc_id = 7").first()["text"]
    return spark.createDataFrame([(1, text), (2, None), (3, ""), (None, "alpha beta"), (1, text)], "item_id long, text string")


def same_rows(a, b, *keys):
    return sorted(map(str, a.select(*keys).collect())) == sorted(map(str, b.select(*keys).collect()))


def test_toxicity(docs, none, labels):
    sample = toxicity.labelled_sample(docs, labels, "toxic", F.lit(True), 1000)
    model = toxicity.fit(sample)
    out = toxicity.score(docs, model, "doc_id")
    assert same_rows(out, docs, "doc_id") and out.where("score is null or score < 0 or score > 1").isEmpty()
    assert {r["doc_id"] for r in out.where("predicted = 1").collect()} == {i for i in range(0, 60, 6)}
    assert toxicity.score(none, model, "doc_id").collect() == []
    empty = toxicity.fit(toxicity.labelled_sample(docs, labels.where("false"), "toxic", F.lit(True), 1000))
    assert toxicity.score(docs, empty, "doc_id").select("score").distinct().count() == 1


def test_toxicity_keeps_rare_words_of_a_wide_vocabulary(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    plain, bad = [word(6) for _ in range(40)], [word(10) for _ in range(400)]
    prose = lambda: [rng.choice(plain) for _ in range(25)]
    learn = [(" ".join([*prose(), bad[i % 400], *prose()]), 1) for i in range(1200)] + [(" ".join(prose() + prose()), 0) for _ in range(1200)]
    model = toxicity.fit(spark.createDataFrame(learn, "text string, label int"))
    given = [(i, " ".join([*prose(), bad[i], *prose()])) for i in range(400)] + [(400 + i, " ".join(prose() + prose())) for i in range(400)]
    found = {r["doc_id"] for r in toxicity.score(spark.createDataFrame(given, "doc_id long, text string"), model, "doc_id").where("predicted = 1").collect()}
    assert len([i for i in found if i < 400]) >= 380 and not [i for i in found if i >= 400]
    assert 3 in toxicity.ORDERS


def test_quality(docs, none, labels):
    sample = toxicity.labelled_sample(docs, labels, "quality", F.lit(True), 1000)
    small = quality.Settings(steps=20)
    out = quality.score(docs, quality.fit(docs, sample, small), "doc_id")
    assert same_rows(out, docs, "doc_id") and out.where("score is null or score < 0 or score > 1").isEmpty()
    assert quality.score(none, quality.fit(none, sample.where("false"), small), "doc_id").collect() == []


def test_language(docs, none):
    out = langid.predict(docs, langid.fit(docs), "doc_id", "text").collect()
    assert len(out) == docs.count()
    for r in out:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] in ("en", "de")) == letters and (r["lang_pred"] == "und") != letters and 0 <= r["score"] <= 1
    assert langid.predict(none, langid.fit(none), "doc_id").collect() == []
    assert {r["lang_pred"] for r in langid.predict(docs, {}, "doc_id").collect()} == {"und"}


def test_decontaminate(docs, none, benchmark):
    out = decontaminate.contamination(docs, benchmark)
    assert out.count() == docs.count() and [r["doc_id"] for r in out.where("contaminated").collect()] == [7]
    assert out.where("doc_id = 7").first()["items"] == [1]
    assert decontaminate.contamination(none, benchmark).collect() == []
    assert decontaminate.contamination(docs, benchmark.where("false")).where("n_hit > 0").isEmpty()
    kept = decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1
    blocks = decontaminate.contamination(docs, benchmark, decontaminate.Settings(block_bytes=300))
    assert [r["doc_id"] for r in blocks.where("contaminated").collect()] == [7]
    stripped = decontaminate.strip(docs, benchmark).where("doc_id in (7, 8)").orderBy("doc_id").collect()
    assert stripped[0]["kept"] == "" and stripped[1]["kept"].split() == stripped[1]["text"].split()


def test_jaccard(docs, none):
    out = jaccard.groups(docs).collect()
    assert len(out) == docs.count()
    for r in out:
        assert r["component_id"] == r["doc_id"]
    assert jaccard.groups(none).collect() == []
    kept = jaccard.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for i, r in enumerate(rows()) if i not in (67, 68))


def test_secrets(docs, none):
    ratios = secrets.train(docs)
    assert secrets.find(docs, ratios).count() == docs.count()
    assert secrets.find(none, secrets.train(none)).collect() == []
    out = secrets.redact(docs, ratios)
    assert out.columns == docs.columns and same_rows(out, docs, *docs.columns)


def test_mixing(docs, none):
    out = mixing.mix(docs)
    assert out.count() == docs.count() and out.where("taken > 3 * size or taken < 0").isEmpty()
    assert mixing.mix(none).collect() == []
    silent = mixing.mix(docs.withColumn("text", F.lit("  ")))
    assert silent.count() == docs.count() and silent.where("taken <> 0 or target <> 0").isEmpty()
    mixed = mixing.mixed(docs)
    assert {"doc_id", "text", "taken"} <= set(mixed.columns) and len(mixed.columns) == len(set(mixed.columns))
    assert mixed.where("taken <= 0").isEmpty()


def test_suffixes(docs):
    out = suffixes.remove_repeats(docs).collect()
    assert len(out) == docs.count()
    assert [r["n_removed"] for r in out if r["n_bytes"] == 200_000] == [200_000]


def test_language_model(docs, none):
    out = language_model.score(docs, F.col("doc_id") % 5 != 1)
    assert same_rows(out, docs, "doc_id")
    assert out.where("score is null or score > 0 or isnan(score)").isEmpty()
    assert language_model.score(none, F.lit(True)).collect() == []
    untrained = language_model.score(docs, F.lit(False))
    assert untrained.where("abs(base_score) > 1e-9 or n_known <> 0").isEmpty()


def test_neighbours(spark):
    inf, nan = float("inf"), float("nan")
    good = [(i, [float(i % 7 - 3), 1.0, float(i % 3)]) for i in range(40)]
    bad = [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, None, 2.0]), (103, [nan, 1.0, 1.0]), (104, [inf, 1.0, 1.0]), (105, [1.0]), (None, [1.0, 1.0, 1.0]), (106, [])]
    vectors = spark.createDataFrame(good + bad + [good[4]], "vec_id long, embedding array<float>")
    found = neighbours.search(vectors, vectors.where("vec_id % 20 = 0"))
    for query in (0, 20):
        got = [(r["vec_id"], r["score"]) for r in found.where(f"query_id = {query}").orderBy("rank").collect()]
        want = sorted(((-sum(a * b for a, b in zip(v, good[query][1])), i) for i, v in good if i != query))[:20]
        assert got == [(i, -s) for s, i in want]
    empty = vectors.where("false")
    assert neighbours.search(empty, empty).collect() == []


def test_pipeline_stages(spark, docs, none, labels, benchmark, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    current = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, str(tmp_path))
        assert current.columns == docs.columns, name
        assert stage(spark, none, str(tmp_path)).collect() == [], name
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = {r["doc_id"] for r in out.collect()}
    assert 7 not in ids and not ids & set(range(0, 60, 6)) and len(ids) > 20


def test_language_model_base_matches_brute_force(spark):
    import math
    import re
    from collections import Counter

    texts = [(i, t) for i, t in enumerate(["a b a", "B c", None, "", "d d\td a", "ünï a\x0bb", "A", "zz " * 50])] * 2
    texts += [(20, "a b a"), (21, "q")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["<end>"]
    train = [t for i, t in texts if i % 5 != 1]
    count = Counter(w for t in train for w in words(t))
    total, kinds = sum(count.values()), len(count)
    # Few common tokens, so most take the way of the rare ones.
    settings = language_model.Settings(common=4, sample=1)
    got = language_model.score(docs, F.col("doc_id") % 5 != 1, settings).collect()
    want = sorted((i, len(words(t)), sum(count[w] > 0 for w in words(t)), round(sum(math.log10((count[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in words(t)), 6)) for i, t in texts)
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {total}


def test_language_model_trains_on_every_position():
    import numpy as np
    import pyarrow as pa

    settings = language_model.Settings()
    texts = [" ".join(f"w{i}x{j}" for j in range(20)) for i in range(5)]
    zero, offsets = np.zeros((settings.buckets, settings.classes + settings.cells), np.float32), np.zeros((settings.classes, settings.cells), np.float32)
    run = language_model._updates((zero, zero, offsets, offsets), np.zeros(language_model.ENDINGS, np.int64), settings)
    for parts in ([texts], [texts[:2], texts[2:]]):
        given = [pa.RecordBatch.from_pydict({"text": p}) for p in parts]
        (out,) = run(iter(given))
        touched = np.frombuffer(out.column("v")[0].as_py(), np.float32)[-settings.buckets - settings.classes : -settings.classes] > 0
        want = np.zeros(settings.buckets, bool)
        for batch in given:
            for *_, codes, rows in language_model._chunks(batch):
                want[language_model._features(codes, rows, settings.buckets)] = True
        assert (touched == want).all()


def test_language_model_probabilities_sum_to_one():
    """Over all classes and cells after any context; inside a cell all counted words and the unseen ones share what the counts say."""
    import numpy as np

    s, rng = language_model.Settings(), np.random.default_rng(3)
    weights, offsets = rng.normal(0, 4, (s.buckets, s.classes + s.cells)).astype(np.float32), rng.normal(0, 9, (s.classes, s.cells)).astype(np.float32)
    features = np.stack([rng.integers(0, s.buckets, 50) for _ in range(5)])
    total = np.zeros(50)
    for y in range(s.classes):
        of_class, of_cell = language_model._logs(weights, offsets, features, np.full(50, y))
        total += np.exp(of_class[:, y].astype(float)) * np.exp(of_cell.astype(float)).sum(axis=1)
    assert np.allclose(total, 1, atol=1e-5) and np.isfinite(of_cell).all()
    counts = rng.integers(1, 9, 40)
    share = counts.sum() + 0.5 * (len(counts) + 1)
    assert abs(((counts + 0.5) / share).sum() + 0.5 / share - 1) < 1e-12


def test_mix_follows_its_sql_and_reruns_agree(spark, docs):
    plain = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    one, two = mixing.mix(plain), mixing.mix(plain.repartition(7))
    keys = ("doc_id", "size", "source_size", "target", "taken")
    assert same_rows(one, two, *keys)
    sums = one.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("size").alias("m")).collect()
    assert all(abs(r["t"] - r["g"]) <= 2 * max(x["m"] for x in sums) for r in sums)
