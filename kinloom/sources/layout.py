"""Which files of a folder are an index's inputs."""

from __future__ import annotations

from pyspark.sql import SparkSession

from kinloom.functions.scratch import listed

#: Names that a file of a data set may have, and its suffixes. Fixed values.
SAMPLES, VALUES, RECORDS = ("meta", "samples_meta", "samples"), ("cpm",), ("deg",)
TABLE_SUFFIXES = (".tsv", ".tsv.gz", ".csv", ".csv.gz")


def cluster_file(names: list[str]) -> str | None:
    """The clusters of a folder: the first file in wide form, those of leftovers last and those of counts never; else the first in long form."""
    wide = [n for n in names if n.endswith(".clust.tsv") and "count" not in n.lower()]
    if wide:
        return min(wide, key=lambda n: ("leftover" in n.lower(), n))
    return min((n for n in names if "hsh" in n.lower() and n.endswith(".tsv")), default=None)


def requested(have: dict[str, str], only: list[str] | None) -> dict[str, str]:
    """What is asked of what there is, by name; a name that is not there is an error, nothing asked means all."""
    want = {w.strip().lower() for w in only or () if w.strip()}
    missing = sorted(want - set(have))
    if missing:
        raise ValueError(f"not among the inputs: {', '.join(missing)} (there are: {', '.join(sorted(have)) or 'none'})")
    return {n: have[n] for n in sorted(want or have)}


def species_folders(spark: SparkSession, root: str) -> dict[str, str]:
    return {n.strip().lower(): p for n, p, folder in listed(spark, root) if folder}


def hit_folders(spark: SparkSession, root: str) -> list[str]:
    """Folders `mmseqs_*`, else the one folder `mmseqs` of old."""
    folders = [(n, p) for n, p, folder in listed(spark, root) if folder]
    return [p for n, p in folders if n.startswith("mmseqs_")] or [p for n, p in folders if n == "mmseqs"]


def table_file(spark: SparkSession, folder: str, names: tuple[str, ...]) -> str | None:
    """The first of the names with the first of the suffixes."""
    have = {n: p for n, p, is_folder in listed(spark, folder) if not is_folder}
    return next((have[n + s] for n in names for s in TABLE_SUFFIXES if n + s in have), None)


def data_sets(spark: SparkSession, root: str) -> dict[str, str]:
    """Folders that hold samples and values."""
    return {n: p for n, p, folder in listed(spark, root) if folder and table_file(spark, p, SAMPLES) and table_file(spark, p, VALUES)}


def files(spark: SparkSession, folder: str, suffixes: tuple[str, ...]) -> list[str]:
    return [p for n, p, is_folder in listed(spark, folder) if not is_folder and n.endswith(suffixes)]
