"""The queries of this subpackage: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roleflow.llm import decontaminate, jaccard, langid, language_model, lexical, lines, mixing, neighbours, periodic, quality, secrets, suffixes, toxicity
from roleflow.llm._common import split_of
from roleflow.session import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    settings = quality.Settings()
    sample = toxicity.labelled_sample(docs, labels, "quality", split_of("doc_id", 5) != 0, settings.sample)
    model = quality.fit(docs, sample, settings)
    scored = quality.score(docs, model, "doc_id")
    return scored.select("doc_id", (split_of("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    n_items = F.coalesce(F.when(F.col("items").isNotNull(), F.size("items")), F.lit(0)).cast("long")
    digest = F.sha2(F.coalesce(F.array_join(names, ","), F.lit("")), 256)
    return found.select("doc_id", "n_words", "n_hit", n_items.alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = langid.fit(docs.where(split_of("doc_id", 4) != 2))
    found = langid.predict(docs, prototypes, "doc_id")
    return found.select("doc_id", (split_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"))


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents"), digest=True)
    return found.withColumnRenamed("kept", "kept_sha256").withColumn("repeats", F.col("n_removed") > 0)


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.search(vectors, vectors.where("vec_id % 20 = 0"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = language_model.score(table(spark, sf_dir, "documents"), split_of("doc_id", 5) != 1)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    settings = toxicity.Settings()
    sample = toxicity.labelled_sample(docs, labels, "toxic", split_of("doc_id", 3) != 1, settings.sample)
    scored = toxicity.score(docs, toxicity.fit(sample, settings), "doc_id")
    return scored.select("doc_id", (split_of("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.find(docs.select("doc_id", "text"), secrets.train(docs))
    of = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    fixed = secrets.listed(F.filter("spans", lambda x: x["kind"] < 3))
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(fixed, 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.remove_lines(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.collapse(periodic.planted(table(spark, sf_dir, "documents")), digest=True)
    best = F.expr("array_max(transform(runs, r -> struct(r.length, -r.start as start, -r.period as period)))")
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n")
    named = found.select("doc_id", "runs", "collapsed", best.alias("best"), F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("").alias("listed"))
    return named.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"),
        F.col("collapsed").alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_decontaminate, op3_language, op4_jaccard, op5_suffixes, op6_nearest, op7_mix, op8_lm, op9_toxicity, op10_secrets, op11_lines, op12_lexical, op13_periodic)}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": decontaminate.SQL, "op4_jaccard": jaccard.SQL, "op7_mix": mixing.SQL, "op11_lines": lines.SQL, "op12_lexical": lexical.SQL, "op13_periodic": periodic.SQL}
