"""Distinct sequences and predictions for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.functions import text
from kinloom.operators.pick import pick


def distinct_sequences(rows: DataFrame, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(uniq_id, seq) of each distinct normalised sequence as its first row has it, and (id, uniq_id) of every row."""
    keyed = rows.withColumn("uniq_id", text.content_id(F.col("seq")))
    uniq = pick(keyed.select("uniq_id", "seq", *[o.alias(f"k{i}") for i, o in enumerate(order)]), ["uniq_id"], [F.col(f"k{i}") for i in range(len(order))])
    return uniq.select("uniq_id", "seq"), keyed.select("id", "uniq_id")


def stored(mapping: DataFrame, uniq: DataFrame) -> DataFrame:
    """(id, uniq_id, seq): each row's sequence as it is stored, that of the first row with the same normalised one."""
    return mapping.join(uniq, "uniq_id").select("id", "uniq_id", "seq")


def recombined(mapping: DataFrame, predictions: DataFrame, order: list[Column]) -> DataFrame:
    """Every original row with the prediction of its sequence, the first of several; null without."""
    return mapping.join(pick(predictions, ["uniq_id"], order), "uniq_id", "left")


def missing(joined: DataFrame, col: str) -> DataFrame:
    return joined.agg(F.count("*").alias("rows"), F.count_if(F.col(col).isNull()).alias("missing"))


def orthogroups(cells: DataFrame, least: int = 2) -> DataFrame:
    """(cluster, genes, n) from (cluster, genome, cell): genes between commas, transcript numbers stripped, each once, by genome; clusters of `least` or more."""
    genes = cells.select("cluster", "genome", F.posexplode(F.split(F.coalesce("cell", F.lit("")), ",")).alias("pos", "gene"))
    genes = genes.withColumn("gene", F.regexp_replace(F.trim("gene"), r"\.\d+$", "")).filter("gene <> ''")
    first = genes.groupBy("cluster", "gene").agg(F.min(F.struct("genome", "pos")).alias("at"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "gene"))), lambda x: x["gene"])
    return first.groupBy("cluster").agg(F.array_join(listed, "|").alias("genes"), F.count("*").alias("n")).filter(F.col("n") >= least)


def matrix_summary(cells: DataFrame) -> DataFrame:
    """Accessions, clusters and genes of an orthogroup matrix in long form."""
    n = F.size(F.filter(F.split(F.coalesce("cell", F.lit("")), ", "), lambda x: F.trim(x) != ""))
    return cells.agg(F.count_distinct("genome").alias("accessions"), F.count_distinct("cluster").alias("clusters"), F.sum(n).cast("long").alias("genes"))


def id_overlap(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """How many distinct ids are in both, only in the first, only in the second; what a caller warns about follows from that."""
    both = a.select(col).distinct().withColumn("in_a", F.lit(True)).join(b.select(col).distinct().withColumn("in_b", F.lit(True)), col, "full")
    return both.agg(F.count_if(F.col("in_a") & F.col("in_b")).alias("shared"), F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"))
