"""What the operators of this subpackage share: words, scratch tables, sizes of inputs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions.scratch import Workspace as Scratch
from kinloom.functions.scratch import delete as drop

__all__ = ["RUN_BYTES", "SPACES", "WORD", "Scratch", "documents", "drop", "finite_components", "run_count", "sliced", "text_bytes", "words"]

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: The six characters themselves, for translate().
SPACES = " \t\n\x0b\x0c\r"
#: A run of documents is about so many bytes of text.
RUN_BYTES = 10_000_000
#: Rows that a worker answers at a time where it gives more than a few numbers for each.
SLICE_ROWS = 256


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def text_bytes(df: DataFrame, text: str) -> int:
    """Bytes of all texts: counted, so that the same rows give the same whatever plan or files they come from."""
    return int(df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0)


def run_count(size: int, least: int = 12) -> int:
    """How many runs texts of so many bytes are dealt into."""
    return max(least, -(-size // RUN_BYTES))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many: Spark sends 10,000 texts at a time, and what comes of all of them would be held at once, by the worker and by the task."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def finite_components(v: Column) -> Column:
    """Whether a vector of doubles is there, is not empty, and has finite components only."""
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
