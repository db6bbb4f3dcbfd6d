"""Runs of several stages that go on where they were killed: a ledger of committed outputs in the shared store."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from roleflow.session import remove


class Run:
    """The stages of one run below ``<folder>/<run_id>``.

    A stage's rows are written to a folder of the attempt; then a file with the stage's name is created in the ledger, which only one attempt can do. What has no such
    file was never done, so a killed attempt leaves nothing that is read, and the next run of the job starts at the first stage without one. A stage's ``version`` (its
    settings, the day's batch) is part of its entry: a stage of another version is done anew, and so are all behind it.
    """

    def __init__(self, spark: SparkSession, folder: str, run_id: str):
        self.spark, self.folder, self.stale = spark, f"{folder.rstrip('/')}/{run_id}", False
        self.done: list[str] = []

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _entry(self, name: str) -> dict | None:
        path, store = self._path(f"ledger/{name}.json")
        if not store.exists(path):
            return None
        return json.loads("".join(r["value"] for r in self.spark.read.text(f"{self.folder}/ledger/{name}.json", wholetext=True).collect()))

    def _commit(self, name: str, entry: dict) -> bool:
        """Whether this attempt is the one that counts."""
        path, store = self._path(f"ledger/{name}.json")
        try:
            out = store.create(path, False)
        except Exception as error:
            if "exist" in str(error).lower():
                return False
            raise
        try:
            out.write(bytearray(json.dumps(entry).encode()))
        finally:
            out.close()
        return True

    def stage(self, name: str, make: Callable[[], DataFrame], version: str = "") -> DataFrame:
        """The committed rows of a stage, made only where the ledger has none."""
        entry = self._entry(name)
        if entry and (self.stale or entry["version"] != version):
            path, store = self._path(f"ledger/{name}.json")
            store.delete(path, False)
            remove(self.spark, f"{self.folder}/{entry['attempt']}")
            entry = None
        if entry is None:
            self.stale = True
            attempt, began = f"{name}-{uuid.uuid4().hex}", dt.datetime.now(dt.timezone.utc).isoformat()
            make().write.parquet(f"{self.folder}/{attempt}")
            entry = {"stage": name, "attempt": attempt, "version": version, "began": began, "ended": dt.datetime.now(dt.timezone.utc).isoformat()}
            if self._commit(name, entry):
                self.done.append(name)
            else:
                remove(self.spark, f"{self.folder}/{attempt}")
                entry = self._entry(name)
        return self.spark.read.parquet(f"{self.folder}/{entry['attempt']}")

    def ledger(self) -> DataFrame:
        """``stage, attempt, version, began, ended`` of the committed stages."""
        return self.spark.read.schema("stage string, attempt string, version string, began timestamp, ended timestamp").json(f"{self.folder}/ledger")

    def clear(self) -> None:
        """The run with all its outputs is over."""
        remove(self.spark, self.folder)
