"""Session settings that the library relies on, read from the cluster where it sets them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the cluster's own, or a temporary one where none is set on a single machine (tests).

    A cluster without ``spark.checkpoint.dir`` is an error: executors do not see a folder that the driver makes for itself.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="roleflow-")
    sc.setCheckpointDir(folder)
    return folder


def small_batches(spark: SparkSession) -> None:
    """Rows that go to Python at once, unless the session sets its own number: texts are long, and workers small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there: no recomputation, and a lost executor costs nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    small_batches(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store, whatever kind of store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by ``keys`` before costly columns are made of them: a small file comes in few splits, however many rows it has."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


class Scratch:
    """Compressed tables in the checkpoint folder, for many narrow rows: they take a fraction of a checkpoint's space.

    They are there as long as the ``with`` block lasts, so a frame that leaves it must have been :func:`cut` from them.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, []

    def __enter__(self) -> "Scratch":
        return self

    def put(self, df: DataFrame) -> DataFrame:
        folder = f"{ensure_checkpoint_dir(self.spark)}/table-{uuid.uuid4().hex}"
        self.folders.append(folder)
        df.write.parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def __exit__(self, *_: object) -> None:
        for folder in self.folders:
            remove(self.spark, folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
