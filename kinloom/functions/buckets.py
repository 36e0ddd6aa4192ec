"""Tables in buckets, by path: Spark uses buckets of catalogue tables only, so a table is named in the catalogue of the session while it is written or read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write(df: DataFrame, path: str, keys: tuple[str, ...], buckets: int, options: dict[str, str] | None = None) -> None:
    """Parquet in buckets of the keys, sorted by them, one file a bucket."""
    out = df.repartition(buckets, *[F.col(k) for k in keys]).write.mode("errorifexists").option("compression", "zstd").option("path", path)
    for k, v in (options or {}).items():
        out = out.option(k, v)
    temporary = f"kinloom_{uuid.uuid4().hex}"
    out.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(temporary)
    df.sparkSession.sql(f"DROP TABLE {temporary}")  # external: its files stay


def read(spark: SparkSession, path: str, schema: StructType, keys: tuple[str, ...], buckets: int) -> DataFrame:
    """The table with its buckets, which a plain read of its files would not know: it joins and groups by all of its keys without a shuffle."""
    view = f"kinloom_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    listed = ", ".join(f"`{k}`" for k in keys)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {view} ({columns}) USING parquet OPTIONS (path '{path}') CLUSTERED BY ({listed}) SORTED BY ({listed}) INTO {buckets} BUCKETS")
    return spark.table(view)


def forget(spark: SparkSession, path: str) -> None:
    """Takes the table's name out of the session's catalogue; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS kinloom_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}")
