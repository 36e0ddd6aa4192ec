"""Tables of SQLite files as a Spark source, and existing indexes in SQLite as snapshots.

A file is cut into ranges of rowid, each a partition that opens the file for itself, in a folder that all executors share. Comparisons of columns with numbers and texts are
handed to SQLite, which answers them from its indexes. Compressed columns come as bytes, and are inflated where they are read.
"""

from __future__ import annotations

import re
import sqlite3
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from kinloom.functions.snapshot import Snapshot
from kinloom.operators import lookup

#: Partitions without a number given, and rows that are fetched at a time.
PARTITIONS, ROWS = 8, 10_000
_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def opened(path: str) -> sqlite3.Connection:
    """For reading only; a path with or without file:."""
    return sqlite3.connect(f"file:{quote(re.sub('^file:/*', '/', path))}?mode=ro", uri=True)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def schema_of(con: sqlite3.Connection, table: str, inflated: Sequence[str], arrays: Sequence[str] = ()) -> StructType:
    """By the affinity of the declared types; columns of numbers that hold texts are an error when they are read."""

    def kind(declared: str, name: str):
        d = declared.upper()
        if name in inflated or name in arrays:
            return StringType() if name in inflated else ArrayType(IntegerType())
        return LongType() if "INT" in d else BinaryType() if "BLOB" in d or not d else StringType() if re.search("CHAR|CLOB|TEXT", d) else DoubleType()

    columns = con.execute(f"PRAGMA table_info({quoted(table)})").fetchall()
    if not columns:
        raise ValueError(f"no table {table}")
    return StructType([StructField(c[1], kind(c[2] or "", c[1])) for c in columns])


@dataclass
class Range(InputPartition):
    path: str
    first: int
    last: int


class SqliteSource(DataSource):
    """Options: path (or several, separated by line feeds), table, partitions (in all), inflate and arrays (names of compressed
    texts, and of compressed 16-bit numbers with the low byte first, separated by commas)."""

    @classmethod
    def name(cls) -> str:
        return "kinloom_sqlite"

    def _paths(self) -> list[str]:
        return self.options["path"].split("\n")

    def _names(self, option: str) -> list[str]:
        return [c for c in self.options.get(option, "").split(",") if c]

    def schema(self) -> StructType:
        con = opened(self._paths()[0])
        try:
            return schema_of(con, self.options["table"], self._names("inflate"), self._names("arrays"))
        finally:
            con.close()

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(self._paths(), self.options["table"], int(self.options.get("partitions", PARTITIONS)), self._names("inflate"), schema)


class SqliteReader(DataSourceReader):
    def __init__(self, paths: list[str], table: str, parts: int, inflated: list[str], schema: StructType):
        self.paths, self.table, self.parts, self.inflated, self.schema = paths, table, parts, set(inflated), schema
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what SQLite compares as Spark does: whole numbers and texts of columns of their type. The rest stays with Spark."""
        for f in filters:
            name, kind = f.attribute[0], {c.name: c.dataType for c in self.schema.fields}.get(f.attribute[0]) if len(f.attribute) == 1 else None
            fits = lambda v: isinstance(kind, LongType) and isinstance(v, int) and not isinstance(v, bool) or isinstance(kind, StringType) and name not in self.inflated and isinstance(v, str) and "\x00" not in v  # noqa: B023, E731
            if type(f) in _SIGNS and fits(f.value):
                self.where.append(f"{quoted(name)} {_SIGNS[type(f)]} ?")
                self.values.append(f.value)
            elif isinstance(f, In) and f.value and all(map(fits, f.value)):
                self.where.append(f"{quoted(name)} IN ({', '.join('?' * len(f.value))})")
                self.values += f.value
            elif isinstance(f, IsNotNull) and kind is not None:
                self.where.append(f"{quoted(name)} IS NOT NULL")
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Ranges of rowid of equal width: a few for each file, in one look at its ends."""
        each, out = max(1, -(-self.parts // len(self.paths))), []
        for path in self.paths:
            con = opened(path)
            try:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
            finally:
                con.close()
            if low is not None:
                width = -(-(high - low + 1) // each)
                out += [Range(path, a, min(a + width - 1, high)) for a in range(low, high + 1, width)]
        return out or [Range(self.paths[0], 0, -1)]

    def read(self, partition: Range) -> Iterator[tuple]:
        con = opened(partition.path)
        try:
            con.text_factory = lambda b: b.decode("utf-8", "replace")
            names = [c.name for c in self.schema.fields]
            kinds = [c.dataType for c in self.schema.fields]
            where = " AND ".join(["rowid BETWEEN ? AND ?", *self.where])
            cursor = con.execute(f"SELECT {', '.join(map(quoted, names))} FROM {quoted(self.table)} WHERE {where}", [partition.first, partition.last, *self.values])
            while rows := cursor.fetchmany(ROWS):
                for row in rows:
                    yield tuple(self._value(n, k, v) for n, k, v in zip(names, kinds, row, strict=True))
        finally:
            con.close()

    def _value(self, name: str, kind, v):
        if v is None:
            return None
        if name in self.inflated:
            return zlib.decompress(v).decode("utf-8", "replace")
        if isinstance(kind, ArrayType):
            return np.frombuffer(zlib.decompress(v), "<u2").tolist()
        if isinstance(kind, BinaryType):
            return bytes(v, "utf-8") if isinstance(v, str) else bytes(v)
        if isinstance(kind, DoubleType):
            return float(v)
        return str(v) if isinstance(kind, StringType) else v


def read(spark: SparkSession, path: str | list[str], table: str, partitions: int = PARTITIONS, inflate: tuple[str, ...] = (), arrays: tuple[str, ...] = ()) -> DataFrame:
    """A table of one or several SQLite files of the same layout."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("kinloom_sqlite").option("table", table).option("partitions", partitions).option("inflate", ",".join(inflate)).option("arrays", ",".join(arrays))
    return reader.option("path", path if isinstance(path, str) else "\n".join(path)).load()


def tables(path: str) -> list[str]:
    con = opened(path)
    try:
        return sorted(r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table'"))
    finally:
        con.close()


def expression_arrays(spark: SparkSession, path: str, partitions: int = PARTITIONS) -> DataFrame:
    """(dataset_id, gene, codes): the stored numbers of each gene in order of the samples, as an index of expression holds them."""
    return read(spark, path, "cpm", partitions, arrays=("cpm_blob",)).select("dataset_id", F.col("gene_id").alias("gene"), F.col("cpm_blob").alias("codes"))


def import_genomes(spark: SparkSession, path: str, out: str, force: bool = False, partitions: int = PARTITIONS) -> None:
    """An index of one species in SQLite as a snapshot that the engine reads: genes, clusters, places, sequences and their maps, structures, trigrams."""
    there = tables(path)
    table = lambda name, **options: read(spark, path, name, partitions, **options)
    with Snapshot(spark, out, force) as snap:
        genes = snap.write(lookup.keyed(table("genes").select("gene_id", "pangene", "accession")), "genes", order=("pangene", "accession", "gene_id"), dealt=True, bloom=("gene_id", "gene_key"))
        posts = snap.write(lookup.postings(genes), "trigrams", order=("term",))
        snap.write(lookup.frequencies(posts), "trigram_counts", order=("term",), dealt=True)
        places = table("gene_coords").withColumnsRenamed({"start": "begin_pos", "end": "end_pos"}).withColumn("chrom_index", F.col("chrom_index").cast("int"))
        places = snap.write(places, "gene_coords", order=("accession", "chr", "chrom_index"), dealt=True, bloom=("gene_id",))
        snap.write(table("pangene_info").select("pangene", "gene_count"), "clusters", order=("pangene",), dealt=True)
        plain = genes.select("gene_id", "pangene", "accession")
        for name, df, keys in (("genes_by_place", plain, ("gene_id", "accession")), ("coords_by_place", places, ("gene_id", "accession")), ("genes_by_id", plain, ("gene_id",))):
            snap.write_bucketed(df, name, keys, partitions)
        for kind, name in (("prot", "protein"), ("cds", "cds")):
            if f"{name}_seq_map" in there:
                uniq = table(f"{name}_seq_uniq", inflate=("seq_comp",)).select(F.col("uniq_id").cast("string").alias("uniq_id"), F.col("seq_comp").alias("seq"))
                uniq = snap.write(uniq, f"{kind}_sequences", order=("uniq_id",), dealt=True, bloom=("uniq_id",))
                mapping = table(f"{name}_seq_map").select(F.col("gene_id").alias("id"), F.col("uniq_id").cast("string").alias("uniq_id"))
                mapping = snap.write(mapping, f"{kind}_map", order=("id",), dealt=True, bloom=("id",))
                snap.write_bucketed(mapping.join(uniq, "uniq_id").select(F.col("id").alias("gene_id"), "seq"), f"{kind}_by_id", ("gene_id",), partitions)
        if "porter6_map" in there:
            snap.write(table("porter6_map").join(table("porter6_uniq"), "uniq_id").select("gene_id", "q3", "q8"), "structures", order=("gene_id",), dealt=True, bloom=("gene_id",))
