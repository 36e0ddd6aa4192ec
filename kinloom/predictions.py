"""Predictions for distinct sequences: sequences of a folder of genomes once each, and what was predicted for them back for every genome."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions import snapshot, text
from kinloom.functions.scratch import Workspace, listed
from kinloom.functions.snapshot import Snapshot
from kinloom.operators import dedup, sinks
from kinloom.operators.pick import pick, ranked
from kinloom.sources import genomes
from kinloom.sources.lines import required, source_order, stem

#: Suffixes of sequence files, and how files of predictions are named. Fixed values.
FASTA, PREDICTED = (".fa", ".faa", ".fasta", ".FA", ".FAA", ".FASTA"), "*_predictions_merged.csv"


def unique_sequences(spark: SparkSession, folder: str | list[str], out: str, chunk: int = 100_000, force: bool = False) -> DataFrame:
    """A snapshot of the distinct sequences of all files of a folder, or of the files listed; returns the mapping (orig_idx, source_file, header_id, uniq_id, seq_hash).

    Sequences count as equal in upper case without blanks; empty ones are left out and not numbered. Rows are numbered from 1 over all files, by name and place. The tables
    are mapping and sequences (uniq_id, seq, first_idx); unique and map are the same as text, chunks the sequences in files of at most `chunk` records. Only
    (place, name, hash) is sorted over everything; sequences move once, by their hash. No files are an error.
    """
    paths = [p for n, p, d in listed(spark, folder) if not d and n.endswith(FASTA)] if isinstance(folder, str) else folder
    if not paths:
        raise FileNotFoundError(f"no sequence files in {folder}")
    work = Workspace(spark, "unique")
    rows = genomes.fasta(spark, paths).select("src", F.col("name").alias("header_id"), text.hashable(F.col("seq")).alias("seq")).filter("seq <> ''")
    rows = work.write(rows.select("*", F.substring_index("src.file", "/", -1).alias("source_file"), text.content_id(F.col("seq")).alias("uniq_id")), "rows")
    order = rows.select(F.col("src.file").alias("f"), F.col("src.block").alias("b"), F.col("src.row").alias("r"), "source_file", "header_id", "uniq_id")
    mapping = work.write(ranked(order, ["f", "b", "r"], work, "order").select(F.col("rank").cast("long").alias("orig_idx"), "source_file", "header_id", "uniq_id", F.substring("uniq_id", 2, 16).alias("seq_hash")), "mapping")
    first = mapping.groupBy("uniq_id").agg(F.min("orig_idx").alias("first_idx"))
    distinct = pick(rows.select("uniq_id", "seq", "src"), ["uniq_id"], [F.col("src")]).select("uniq_id", "seq").join(first, "uniq_id")
    with Snapshot(spark, out, force) as snap:
        snap.write(mapping, "mapping", order=("orig_idx",), dealt=True, bloom=("header_id",))
        stored = snap.write(distinct, "sequences", order=("first_idx",), dealt=True)
        sinks.fasta(stored.orderBy("first_idx"), snap.path("unique"), "uniq_id", "seq", 60)
        sinks.tsv(mapping.orderBy("orig_idx"), snap.path("map"))
        sinks.chunked_fasta(stored, snap.path("chunks"), "uniq_id", "seq", chunk)
        for name in ("unique", "map", "chunks"):
            snap.tables[name] = {"path": f"{snap.folder}/{name}"}
    return snapshot.read(spark, out, "mapping")


def predictions(spark: SparkSession, folder: str, pattern: str = PREDICTED) -> DataFrame:
    """(uniq_id, q3, q8, src) of all files of predictions in a folder, however deep; files may have further columns, but all the same ones. None are an error."""
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).csv(folder, header=True, quote='"', enforceSchema=False)
    return required(t, ("id", "q3", "q8"), "predictions").select(F.trim("id").alias("uniq_id"), "q3", "q8", source_order().alias("src"))


def recombined(spark: SparkSession, mapping: DataFrame, predicted: DataFrame, out: str, force: bool = False) -> DataFrame:
    """Predictions for every row of the mapping, the first of several by file and place, as a snapshot by genome; returns (rows, missing).

    The table is structures (id, q3_decoded, q8_decoded, genome); q3 and q8 are the same as text with a folder for each genome. Rows without a prediction stay, with nulls.
    """
    required(mapping, ("uniq_id", "header_id", "source_file"), "mapping")
    both = dedup.recombined(mapping.select("uniq_id", "header_id", "source_file"), predicted, [F.col("src")])
    rows = both.select(F.col("header_id").alias("id"), F.col("q3").alias("q3_decoded"), F.col("q8").alias("q8_decoded"), stem(F.col("source_file"), FASTA).alias("genome"))
    with Snapshot(spark, out, force) as snap:
        stored = snap.write(rows, "structures", by=("genome",), order=("id",))
        for name in ("q3", "q8"):
            sinks.per_genome(stored.select("id", f"{name}_decoded", "genome"), snap.path(name), "genome")
            snap.tables[name] = {"path": f"{snap.folder}/{name}"}
    return dedup.missing(snapshot.read(spark, out, "structures"), "q3_decoded")
