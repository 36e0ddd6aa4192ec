"""The corpus pipeline: quality rules, near-dedup, pseudonyms, mixing, byte-level BPE; each stage on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm import bpe, mixing, neardup, private, quality
from kinloom.llm.common import Scratch

#: Key of the pseudonyms; a real corpus needs one that is kept secret.
KEY = "kinloom-test-key"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base test or the learned rules reject. Rules are learned from the labelled documents among docs."""
    judged, _ = quality.judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), Scratch(spark, "stage-quality"))
    return judged.filter("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays: that of the smallest id.
    Rows that repeat the id of one that stays are one document, of which the first text in order stays; rows without an id all stay."""
    scratch = Scratch(spark, "stage-neardup")
    found = scratch.write(neardup.linked(docs, scratch, k=5, threshold=80), "linked")
    marks = found.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("mark_id")).agg(F.bool_and("kept").alias("stays"), F.count("*").alias("n"))
    marks = scratch.write(marks.filter("NOT stays OR n > 1"), "marks")
    base = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    once = base.join(marks, base["id"] == marks["mark_id"], "left_anti").select("row.*")
    again = base.join(marks.filter("stays"), base["id"] == marks["mark_id"])
    order = F.struct(F.col("row.text").isNull(), F.col("row.text"), F.xxhash64("row"))
    first = again.groupBy("id").agg(F.min_by("row", order).alias("row")).select("row.*")
    return once if marks.filter("stays").isEmpty() else once.unionByName(first)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and identifiers become pseudonyms of the same format; n_chars follows the text."""
    out = private.pseudonymised(docs, KEY)
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("row.text") == F.col("text"), F.col("row.n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(row.alias("row")).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says."""
    return mixing.emit(mixing.copies(docs, Scratch(spark, "stage-mix")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, to train on, and the hashes of its round trip."""
    return bpe.round_trip(docs, bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality", quality_rules), ("near_dedup", near_dedup), ("pii", pseudonyms), ("mixing", mix), ("bpe", encode)]

#: Learned rules, signatures and merges have no SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
