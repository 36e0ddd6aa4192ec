"""Lines of text files, with their file and an order inside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str | list[str], sep: str | None = None) -> DataFrame:
    """(line, file, src): src orders the rows of all files by file, place of the split and row; gzip is read as it is.

    Invalid UTF-8 becomes replacement characters. Blank lines are kept; carriage returns at line ends are not.
    """
    reader = spark.read.option("lineSep", sep) if sep else spark.read
    rows = reader.text(path)
    return rows.select(F.regexp_replace("value", r"\r$", "").alias("line"), F.col("_metadata.file_name").alias("file"), source_order().alias("src"))


def source_order() -> Column:
    """Orders rows by file, place of the split and row; for columns of a read itself, before anything is shuffled."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def content(rows: DataFrame) -> DataFrame:
    """Lines that are neither blank nor comments."""
    return rows.filter((F.trim("line") != "") & ~F.startswith(F.ltrim("line"), F.lit("#")))


def stem(file: Column, suffixes: tuple[str, ...]) -> Column:
    """A file's name without the first of the suffixes, longest first, that it ends with."""
    out = file
    for s in sorted(suffixes, key=len):
        out = F.when(F.endswith(file, F.lit(s)), F.substring(file, F.lit(1), F.length(file) - len(s))).otherwise(out)
    return out


def fields(line: Column, pattern: str = "\t") -> Column:
    return F.split(line, pattern, -1)


def whitespace_fields(line: Column) -> Column:
    """Fields between tabs if there is one, else between blanks."""
    return F.when(F.contains(line, F.lit("\t")), F.split(line, "\t", -1)).otherwise(F.split(F.trim(line), r"\s+"))


def required(df: DataFrame, columns: tuple[str, ...], what: str) -> DataFrame:
    """df if it has the columns; an error that names the missing ones otherwise."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {', '.join(missing)}")
    return df


def renamed(df: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Columns under their own names, whichever alias, in any case, the file uses."""
    lower = {c.strip().lower(): c for c in df.columns}
    for name, others in aliases.items():
        found = next((lower[a] for a in (name, *others) if a in lower), None)
        if found and found != name:
            df = df.withColumnRenamed(found, name)
    return df


def table(spark: SparkSession, path: str | list[str], sep: str = "\t") -> DataFrame:
    return spark.read.csv(path, sep=sep, header=True, quote='"', mode="PERMISSIVE")


def delimiter(path: str) -> str:
    return "," if path.removesuffix(".gz").endswith(".csv") else "\t"
