"""Writers. Each takes a DataFrame and a path; a table that exists is an error unless it may be overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions import text
from kinloom.functions.scratch import Workspace
from kinloom.operators.pick import ranked

#: Layout of an index; a reader refuses older ones. Fixed value.
SCHEMA_VERSION = 3
#: Bytes that one value cannot hold.
LARGEST_FILE = 2**31 - 1_024


def table(df: DataFrame, path: str, force: bool = False, by: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> None:
    """Parquet, dealt into folders and sorted inside each file, so that later filters skip files and row groups."""
    df = df.sortWithinPartitions(*by, *order) if order else df
    df.write.mode("overwrite" if force else "errorifexists").option("compression", "zstd").partitionBy(*by).parquet(path)


def tsv(df: DataFrame, path: str, force: bool = False) -> None:
    df.write.mode("overwrite" if force else "errorifexists").csv(path, sep="\t", header=True, quote='"')


def lines(df: DataFrame, path: str, force: bool = False) -> None:
    """A DataFrame of one text column as lines."""
    df.write.mode("overwrite" if force else "errorifexists").text(path)


def fasta(df: DataFrame, path: str, name: str = "gene_id", seq: str = "seq", width: int = 80, force: bool = False) -> None:
    lines(df.select(text.fasta(F.col(name), F.col(seq), width).alias("value")), path, force)


def chunked_fasta(df: DataFrame, path: str, name: str, seq: str, size: int = 100_000, force: bool = False) -> None:
    """Records in files of at most `size`, stars removed. Chunks are cut inside each part of the data, not over a global order, and all in one folder: a folder each would cost a listing each."""
    rows = df.select(text.fasta(F.col(name), text.protein(F.col(seq)), 60).alias("value"))
    rows.write.mode("overwrite" if force else "errorifexists").option("maxRecordsPerFile", size).text(path)


def per_genome(df: DataFrame, path: str, genome: str, force: bool = False) -> None:
    df.write.mode("overwrite" if force else "errorifexists").partitionBy(genome).csv(path, header=True)


def merged_statistics(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows, and old ones of species that are not among them, by species."""
    return old.join(new.select("species"), "species", "left_anti").unionByName(new).orderBy("species")


def checksums(spark: SparkSession, path: str) -> dict[str, str]:
    """The sha1 of each file of a folder, however deep, or of a file, by path; files are hashed where they are read, each as one value, so one of 2 GB or more is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter("length > 0")
    large = files.filter(F.col("length") >= LARGEST_FILE).select("path").first()
    if large:
        raise ValueError(f"{large.path}: too large for a checksum")
    return {r.path: r.sha1 for r in files.select("path", F.sha1("content").alias("sha1")).orderBy("path").collect()}


def metadata(spark: SparkSession, path: str, values: dict[str, object], force: bool = False) -> None:
    """(k, v) of an index: version, counts, checksums of its sources."""
    rows = [(k, str(v)) for k, v in sorted(values.items())]
    spark.createDataFrame(rows, "k string, v string").coalesce(1).write.mode("overwrite" if force else "errorifexists").parquet(path)


def numbered(df: DataFrame, order: list[str], size: int, workspace: Workspace) -> DataFrame:
    """Job lists in batches of `size`, by one order over all."""
    return ranked(df, order, workspace, "jobs").withColumn("batch", F.floor((F.col("rank") - 1) / size)).drop("rank")


def round_robin(df: DataFrame, order: list[str], batches: int, workspace: Workspace) -> DataFrame:
    """Rows dealt in turn to so many batches, by one order over all."""
    return ranked(df, order, workspace, "turns").withColumn("batch", ((F.col("rank") - 1) % batches).cast("int")).drop("rank")
