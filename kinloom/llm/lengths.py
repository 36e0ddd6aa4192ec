"""Exact length histogram: documents by encoded length, and suffix sums that answer every context limit."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder, read_ranks
from .common import Scratch, documents

#: Lengths are summed in blocks of so many, so that no task ever orders all lengths.
BLOCK = 1_024
#: Texts of up to so many characters are encoded at once; only their lengths matter here.
LEAF_CHARS = 16_384


def length_histogram(docs: DataFrame, rank_file: bytes, pattern: str, text_col: str = "text") -> DataFrame:
    """(n_tokens, n_docs): how many documents have each encoded length.

    Each task counts what it has read, so the shuffle carries a row for each length and task. A null or empty text has
    length 0; repeated rows count each; an empty table gives no row. Other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(rank_file, pattern, LEAF_CHARS), Counter()
        for batch in batches:
            seen.update(len(enc.encode(t.as_py() or "")) for t in batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["n_tokens", "n_docs"])

    return docs.select(text_col).mapInArrow(work, "n_tokens bigint, n_docs bigint").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length that occurs: documents and tokens of that length or more, the tokens left if every document is cut
    there, the documents and tokens in all, and the share of documents of that length or less.

    Sums run within blocks of lengths and over the blocks' totals, which are BLOCK times fewer. The histogram is read twice, so
    give one that is written, not one that would count all texts again.
    """
    block = F.floor(F.col("n_tokens") / BLOCK)
    h = histogram.withColumn("block", block).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t")).select(
        F.col("block"),
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("docs_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("d").over(every).alias("all_docs"), F.sum("t").over(every).alias("all_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sums = h.withColumn("d", F.sum("n_docs").over(within)).withColumn("t", F.sum("tokens").over(within)).join(blocks, "block")
    docs_ge, tokens_ge = F.col("d") + F.col("docs_after"), F.col("t") + F.col("tokens_after")
    return sums.select(
        "n_tokens", "n_docs", docs_ge.alias("docs_ge"), tokens_ge.alias("tokens_ge"),
        (F.col("all_tokens") - tokens_ge + F.col("n_tokens") * docs_ge).alias("truncated_tokens"),
        "all_docs", "all_tokens", ((F.col("all_docs") - docs_ge + F.col("n_docs")) / F.col("all_docs")).alias("share_le"),
    )


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Tokens left if every document is cut to limit: all of the shorter ones, and limit of each document of more."""
    if limit <= 0:
        return 0
    longer = sums.filter(F.col("n_tokens") >= limit)
    row = longer.orderBy("n_tokens").select("docs_ge", "tokens_ge", "all_tokens").first()
    if row is None:
        return int((sums.select("all_tokens").first() or [0])[0])
    return int(row[2] - row[1] + limit * row[0])


def quantile(sums: DataFrame, q: float) -> int | None:
    """The least length such that a share q of the documents is no longer; null without documents."""
    return (sums.filter(F.col("share_le") >= q).agg(F.min("n_tokens")).first() or [None])[0]


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram, a row a length, is written once; texts are encoded once."""
    import public_tokenizers

    histogram = length_histogram(documents(spark, sf_dir), read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    return suffix_sums(Scratch(spark, "lengths").write(histogram, "histogram"))
