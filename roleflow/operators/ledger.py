"""What source runs brought: observations with their outcomes, one account a run and source, and names that are no employers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OBSERVATION = ("run_id", "source_key", "external_id")
RUN = ("run_id", "source_key")
# The statuses of a screening's lists.
BASKETS = {
    "to screen": ("unseen", "expiring"),
    "kept": ("liked", "to_apply", "to_research", "to_network", "applied", "test_task", "interview", "accepted", "declined"),
    "put aside": ("passed", "skipped"),
}


def record(ledger: DataFrame, rows: DataFrame, key: tuple[str, ...], order: str) -> DataFrame:
    """The ledger after a batch: an entry's newest row by ``order`` stands for it; a batch that is recorded again changes nothing.

    Columns that a batch lacks keep what the ledger has.
    """
    for c in ledger.columns:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(ledger.schema[c].dataType))
    both = ledger.withColumn("_new", F.lit(0)).unionByName(rows.select(*ledger.columns).withColumn("_new", F.lit(1)))
    facts = [c for c in ledger.columns if c not in key]
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("_new", order))).alias(c) for c in facts]
    return both.groupBy(*key).agg(*latest).select(*ledger.columns)


def run_accounts(observations: DataFrame, advertised: DataFrame, failures: DataFrame) -> DataFrame:
    """One account for each run and source: ``run_id, source_key, advertised, observed, accepted, rejected, reasons, complete, status``.

    ``observations`` has ``run_id, source_key, external_id, outcome, reason``; ``advertised`` what the source said it has, ``failures`` why it failed (``run_id,
    source_key, reason``). ``status`` is ``error: ...`` for a failure, ``incomplete`` where less was seen than advertised, ``empty`` for an honest zero, else ``ok``;
    a source that failed and one that brought nothing have an account too.
    """
    seen = observations.groupBy(*RUN).agg(
        F.count_distinct("external_id").alias("observed"),
        F.count_if(F.col("outcome").isin("existing", "new")).alias("accepted"),
        F.count_if(~F.col("outcome").isin("existing", "new")).alias("rejected"),
        F.array_sort(F.collect_set("reason")).alias("reasons"),
    )
    said = advertised.groupBy(*RUN).agg(F.max("advertised").alias("advertised"))
    failed = failures.groupBy(*RUN).agg(F.min("reason").alias("failure"))
    joined = seen.join(said, list(RUN), "full").join(failed, list(RUN), "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    complete = F.coalesce(F.coalesce("observed", F.lit(0)) >= F.col("advertised"), F.lit(True)) & F.col("failure").isNull()
    status = (
        F.when(F.col("failure").isNotNull(), F.concat(F.lit("error: "), "failure"))
        .when(F.coalesce("observed", F.lit(0)) < F.col("advertised"), "incomplete")
        .when(F.coalesce("observed", F.lit(0)) == 0, "empty")
        .otherwise("ok")
    )
    none = F.array().cast("array<string>")
    return joined.select(*RUN, "advertised", zero("observed"), zero("accepted"), zero("rejected"), F.coalesce("reasons", none).alias("reasons"), complete.alias("complete"), status.alias("status"))


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """``name``: strings of board pages that are no employers, from a file of decisions."""
    rows = spark.read.schema("parsing_artifacts array<string>").option("multiLine", True).json(path)
    return rows.select(F.explode("parsing_artifacts").alias("name")).distinct()


def plain_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " "))


def without_artifacts(rows: DataFrame, names: DataFrame, column: str = "org") -> DataFrame:
    """Rows whose employer is none of the known artifacts, white space aside."""
    known = names.select(plain_name(F.col("name")).alias("_artifact")).distinct()
    return rows.join(known, plain_name(rows[column]) == F.col("_artifact"), "left_anti")


def screen_lists(rows: DataFrame) -> DataFrame:
    """``list, id``: the three lists of a screening, which share no row: what is to be screened, what was kept, what was put aside.

    A row without a status is to be screened; rows of other baskets are in none.
    """
    name = F.lit(None).cast("string")
    for basket, statuses in BASKETS.items():
        name = F.when(F.coalesce("status", F.lit("unseen")).isin(*statuses), basket).otherwise(name)
    return rows.select(name.alias("list"), "id").where("list is not null").distinct()
