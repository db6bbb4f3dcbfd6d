"""Landed payloads as one table: a data source with a reason for each file that brought nothing, and postings of all JSON vendors in one pass.

Fetched payloads lie in ``<root>/source=<vendor>/day=<yyyy-mm-dd>/<employer>.<ext>``. The data source ``landed_payloads`` gives a row a file; what its
format or its shape makes unreadable has a ``reason`` and no payload, so that a broken source never looks like one without postings.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from roleflow.functions import text as T

SCHEMA = "source string, day date, org string, file string, payload string, reason string"


@dataclass(frozen=True)
class Vendor:
    """Where a vendor's payload has its list of postings and, in each of these, the columns of a posting; the first path that has something counts."""

    items: str
    title: tuple[str, ...]
    url: tuple[str, ...] = ()
    external_id: tuple[str, ...] = ()
    location: tuple[str, ...] = ()
    department: tuple[str, ...] = ()
    description: tuple[str, ...] = ()
    html: bool = True


# Paths of the vendors' payloads.
VENDORS = {
    "greenhouse": Vendor("$.jobs", ("title",), ("absolute_url",), ("id",), ("location.name",), ("departments[0].name",), ("content",)),
    "lever": Vendor("$", ("text",), ("hostedUrl",), ("id",), ("categories.location",), ("categories.department", "categories.team"), ("descriptionPlain", "description")),
    "ashby": Vendor("$.jobs", ("title",), ("jobUrl",), (), ("location",), ("department", "team"), ("descriptionPlain", "descriptionHtml")),
    "smartrecruiters": Vendor("$.content", ("name",), (), ("id",), ("location.fullLocation", "location.city"), ("department.label",)),
    "recruitee": Vendor("$.offers", ("title",), ("careers_url",), ("id",), ("location",), ("department",), ("description",)),
    "workable": Vendor("$.jobs", ("title",), ("url",), ("shortcode",), ("city", "country"), ("department",), ("description",)),
    "pinpoint": Vendor("$.data", ("title",), ("url",), ("id",), ("location.name", "location.city"), ("job.department.name",), ("description",)),
    "oracle_hcm": Vendor("$.items[0].requisitionList", ("Title",), (), ("Id",), ("PrimaryLocation",), (), ("ShortDescriptionStr",)),
    "arbeitnow": Vendor("$.data", ("title",), ("url",), ("slug",), ("location",), (), ("description",)),
    "remotive": Vendor("$.jobs", ("title",), ("url",), ("id",), ("candidate_required_location",), ("category",), ("description",)),
}
#: Formats other than JSON, by the file's extension.
FEEDS, PAGES = ("xml", "rss"), ("html", "htm", "md")


def fault(source: str, extension: str, payload: str) -> str | None:
    """Why a payload cannot be read as its source's; null if it can."""
    if not payload.strip():
        return "empty"
    if extension in PAGES:
        return None
    if extension in FEEDS:
        try:
            ElementTree.fromstring(payload)
            return None
        except ElementTree.ParseError as error:
            return f"no XML: {error}"
    try:
        value = json.loads(payload)
    except ValueError as error:
        return f"no JSON: {error}"
    if isinstance(value, dict) and isinstance(value.get("status"), int) and value["status"] >= 400:
        return f"http_{value['status']}"
    if vendor := VENDORS.get(source):
        for name, index in re.findall(r"\.(\w+)|\[(\d+)\]", vendor.items):
            try:
                value = value[name] if name else value[int(index)]
            except (KeyError, IndexError, TypeError):
                return f"no list at {vendor.items}"
        if not isinstance(value, list):
            return f"no list at {vendor.items}"
    return None


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, str, str]]):
        self.files = files


class LandedReader(DataSourceReader):
    """Lists the store once; filters on source and day keep folders from being listed; files go together up to ``bytes`` or ``files`` a partition."""

    def __init__(self, root: str, most_bytes: int, most_files: int):
        self.root, self.most_bytes, self.most_files = root, most_bytes, most_files
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("source",), ("day",)):
                self._keep(f.attribute[0], [f.value])
            elif isinstance(f, In) and f.attribute in (("source",), ("day",)):
                self._keep(f.attribute[0], f.value)
            else:
                yield f

    def _keep(self, column: str, values: Iterable[object]) -> None:
        named = {str(v) for v in values if v is not None}
        self.wanted[column] = self.wanted.get(column, named) & named

    def _store(self):
        from pyarrow.fs import FileSystem, LocalFileSystem

        return FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (LocalFileSystem(), self.root)

    def _folders(self, store, parent: str, column: str) -> Iterator[tuple[str, str]]:
        from pyarrow.fs import FileSelector, FileType

        for info in store.get_file_info(FileSelector(parent, allow_not_found=True)):
            name, _, value = info.base_name.partition("=")
            value = unquote(value)
            if info.type == FileType.Directory and name == column and (column not in self.wanted or value in self.wanted[column]):
                yield info.path, value

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow.fs import FileSelector, FileType

        store, root = self._store()
        out, size = [[]], 0
        for folder, source in self._folders(store, root, "source"):
            for inner, day in self._folders(store, folder, "day"):
                for info in store.get_file_info(FileSelector(inner)):
                    if info.type != FileType.File or info.base_name.startswith((".", "_")):
                        continue
                    if out[-1] and (size + info.size > self.most_bytes or len(out[-1]) >= self.most_files):
                        out.append([])
                        size = 0
                    out[-1].append((info.path, source, day))
                    size += info.size
        return [Files(x) for x in out if x]

    def read(self, partition: Files) -> Iterator[tuple]:
        import datetime as dt

        store, _ = self._store()
        for path, source, day in partition.files:
            name = path.rpartition("/")[2]
            org, _, extension = name.rpartition(".")
            try:
                when = dt.date.fromisoformat(day)
            except ValueError:
                when = None
            try:
                with store.open_input_stream(path, compression=None) as stream:
                    payload = stream.read().decode("utf-8-sig")
                reason = fault(source, extension.lower(), payload)
            except (OSError, UnicodeDecodeError) as error:
                payload, reason = "", f"unreadable: {type(error).__name__}"
            yield source, when, unquote(org or name), path, None if reason else payload, reason


class LandedPayloads(DataSource):
    """``spark.read.format("landed_payloads").load(root)``; options ``files`` (64) and ``bytes`` (16 MB) bound a partition.

    A file is read whole by one task. The root is a path or an address that Arrow's file systems know.
    """

    @classmethod
    def name(cls) -> str:
        return "landed_payloads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        if not self.options.get("path"):
            raise ValueError("load() needs the root of the landed payloads")
        return LandedReader(self.options["path"].rstrip("/"), int(self.options.get("bytes", 16 << 20)), int(self.options.get("files", 64)))


def register(spark: SparkSession) -> None:
    """The data source for this session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedPayloads)


def landed(spark: SparkSession, root: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("landed_payloads").options(**options).load(root)


def failures(payloads: DataFrame) -> DataFrame:
    """``source, day, files, failed, reasons`` for the run report: a source of whose files all failed has no honest zero."""
    reasons = F.array_sort(F.collect_set("reason"))
    return payloads.groupBy("source", "day").agg(F.count(F.lit(1)).alias("files"), F.count("reason").alias("failed"), reasons.alias("reasons"))


def _text(paths: tuple[str, ...]) -> Column:
    """The first of several paths that holds a scalar with something in it; a value of another type is its text, an object or a list nothing."""
    none = F.lit(None).cast("string")

    def one(path: str) -> Column:
        part = F.try_variant_get("value", f"$.{path}", "variant")
        scalar = ~F.schema_of_variant(part).rlike("^(OBJECT|ARRAY|VOID)")
        return F.nullif(F.trim(F.when(scalar, F.try_variant_get("value", f"$.{path}", "string"))), F.lit(""))

    return F.coalesce(*[one(p) for p in paths], none)


def postings(payloads: DataFrame) -> DataFrame:
    """Postings of payloads ``source, org, payload`` of the vendors in :data:`VENDORS`, all in one pass.

    Columns ``source, org, external_id, title, url, location, department, description``. Payloads are read as VARIANT: a field that a vendor renames or gives
    another type costs this field, not the posting and not the payload; a posting without a title goes, one without an id has the start of a digest of link or title.
    Payloads that don't parse give no rows; :func:`failures` tells of them.
    """
    at = F.lit(None).cast("variant")
    read = F.try_parse_json("payload")
    for name, vendor in VENDORS.items():
        at = F.when(F.col("source") == name, F.try_variant_get(read, vendor.items, "variant")).otherwise(at)
    rows = payloads.where(F.col("payload").isNotNull() & F.col("source").isin(*VENDORS)).select("source", "org", at.alias("items"))
    spread = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("items").outer()).select("pos", "value"))

    def column(name: str) -> Column:
        found = F.lit(None).cast("string")
        for source, vendor in VENDORS.items():
            if paths := getattr(vendor, name):
                found = F.when(F.col("source") == source, _text(paths)).otherwise(found)
        return found

    made = spread.select("source", "org", "pos", *[column(c).alias(c) for c in ("external_id", "title", "url", "location", "department", "description")]).where("title is not null")
    key = F.coalesce("external_id", F.substring(F.md5(F.coalesce("url", F.concat_ws(":", "org", "title"))), 1, 12))
    body = F.when(F.col("source") == "greenhouse", T.html_to_text(T.html_to_text(F.col("description")))).otherwise(T.html_to_text(F.col("description")))
    return made.select("source", "org", key.alias("external_id"), "title", "url", "location", "department", F.nullif(body, F.lit("")).alias("description"))
