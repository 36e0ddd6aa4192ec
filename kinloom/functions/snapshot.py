"""Indexes as snapshots: tables are written beside the old ones and count from the moment a manifest names them.

A manifest is a small numbered file that maps names of tables to folders and says how they are stored. It is written under another name and renamed last, so a
build that fails leaves the index as it was; readers take the manifest with the highest number. Folders that no kept manifest names can be deleted.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from kinloom.functions import buckets as buckets_
from kinloom.functions.scratch import delete, listed

#: Where manifests are, under an index.
MANIFESTS = "manifests"


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, root: str) -> dict | None:
    """The newest manifest of an index: {number, tables: {name: {path, ...}}}; None where there is none."""
    numbers = sorted(int(n.removesuffix(".json")) for n, _, folder in listed(spark, f"{root}/{MANIFESTS}") if not folder and n.endswith(".json"))
    if not numbers:
        return None
    return json.loads("\n".join(r.value for r in spark.read.text(f"{root}/{MANIFESTS}/{numbers[-1]:010d}.json", wholetext=True).collect()))


def tables(spark: SparkSession, root: str) -> dict[str, str]:
    """Folders of the tables of an index, by name."""
    found = manifest(spark, root)
    return {n: f"{root}/{t['path']}" for n, t in (found["tables"] if found else {}).items()}


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    where = tables(spark, root).get(name)
    if where is None:
        raise KeyError(f"no table {name} in {root}")
    return spark.read.parquet(where)


class Snapshot:
    """A build of an index. Tables of the snapshot before it stay part of it where keep says so. Used as a context, it is published if nothing failed."""

    def __init__(self, spark: SparkSession, root: str, force: bool = False, keep: bool = False):
        self.spark, self.root = spark, root.rstrip("/")
        self.before = manifest(spark, self.root)
        if self.before and not force:
            raise FileExistsError(f"{self.root} exists already")
        self.folder = f"data/{uuid.uuid4().hex}"
        self.tables: dict[str, dict] = dict(self.before["tables"]) if self.before and keep else {}

    def __enter__(self) -> Snapshot:
        return self

    def __exit__(self, kind, value, trace) -> None:
        if kind is None:
            self.publish()
        else:
            delete(self.spark, f"{self.root}/{self.folder}")

    def path(self, name: str) -> str:
        return f"{self.root}/{self.folder}/{name}"

    def write(self, df: DataFrame, name: str, by: tuple[str, ...] = (), order: tuple[str, ...] = (), dealt: bool = False, bloom: tuple[str, ...] = (), options: dict[str, str] | None = None) -> DataFrame:
        """Parquet: folders for the values of `by`, sorted by `order` inside each file; dealt: files hold ranges of that order. Columns in
        bloom get Bloom filters, so that an equality reads those row groups only that can have the value, whatever the order."""
        if dealt:
            df = df.repartitionByRange(*by, *order)
        if order:
            df = df.sortWithinPartitions(*by, *order)
        out = df.write.mode("errorifexists").option("compression", "zstd").partitionBy(*by)
        for c in bloom:
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
        if bloom:
            out = out.option("parquet.bloom.filter.adaptive.enabled", "true")
        for k, v in (options or {}).items():
            out = out.option(k, v)
        out.parquet(self.path(name))
        self.tables[name] = {"path": f"{self.folder}/{name}"}
        return self.spark.read.parquet(self.path(name))

    def write_bucketed(self, df: DataFrame, name: str, keys: tuple[str, ...], buckets: int, options: dict[str, str] | None = None) -> None:
        """Parquet in buckets of the keys, sorted by them, one file a bucket: tables that are bucketed alike join and group by the keys without a shuffle."""
        buckets_.write(df, self.path(name), keys, buckets, options)
        self.tables[name] = {"path": f"{self.folder}/{name}", "schema": df.schema.jsonValue(), "keys": list(keys), "buckets": buckets}

    def publish(self) -> None:
        """From here on readers see these tables. Another build that published meanwhile is an error."""
        number = (self.before["number"] if self.before else 0) + 1
        text = json.dumps({"number": number, "tables": self.tables}, sort_keys=True)
        final, store = _path(self.spark, f"{self.root}/{MANIFESTS}/{number:010d}.json")
        draft, _ = _path(self.spark, f"{self.root}/{MANIFESTS}/.{uuid.uuid4().hex}")
        with_ = store.create(draft, False)
        with_.write(bytearray(text.encode()))
        with_.close()
        if store.exists(final) or not store.rename(draft, final):
            raise FileExistsError(f"{self.root}: another build has published snapshot {number}")


def bucketed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A bucketed table of an index with its buckets, which a plain read of its files would not know."""
    entry = (manifest(spark, root) or {"tables": {}})["tables"].get(name)
    if entry is None or "buckets" not in entry:
        raise KeyError(f"no bucketed table {name} in {root}")
    return buckets_.read(spark, f"{root}/{entry['path']}", StructType.fromJson(entry["schema"]), tuple(entry["keys"]), entry["buckets"])


def expire(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Deletes all but the newest `keep` manifests, and the folders that none of those names; how many folders went. Builds that run meanwhile must have ended."""
    names = sorted(n for n, _, folder in listed(spark, f"{root}/{MANIFESTS}") if not folder)
    for n in names[:-keep]:
        delete(spark, f"{root}/{MANIFESTS}/{n}")
    used = set()
    for n in names[-keep:]:
        text = spark.read.text(f"{root}/{MANIFESTS}/{n}", wholetext=True).first().value
        used |= {t["path"].split("/")[1] for t in json.loads(text)["tables"].values()}
    gone = [p for n, p, _ in listed(spark, f"{root}/data") if n not in used]
    for p in gone:
        delete(spark, p)
    return len(gone)
