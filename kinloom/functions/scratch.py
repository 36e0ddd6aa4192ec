"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of our own, which only a local session can share with its tasks."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kinloom-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def listed(spark: SparkSession, path: str) -> list[tuple[str, str, bool]]:
    """(name, path, is a folder) of what a folder holds, by name; nothing for what is no folder. Hidden names are left out."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(where) or not store.getFileStatus(where).isDirectory():
        return []
    found = [(s.getPath().getName(), s.getPath().toString(), s.isDirectory()) for s in store.listStatus(where)]
    return sorted(f for f in found if not f[0].startswith((".", "_")))


class Workspace:
    """A folder for tables that cut lineage and survive lost executors. It goes when the driver ends, or before by close(), once
    nothing reads its tables any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/kinloom-{name}-{uuid.uuid4().hex}"
        atexit.register(self._end)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        delete(self.spark, self.path(name))

    def close(self) -> None:
        atexit.unregister(self._end)
        self._end()

    def _end(self) -> None:
        try:
            delete(self.spark, self.root)
        except Exception:  # noqa: BLE001 - the session may have ended; the folder is scratch
            pass
