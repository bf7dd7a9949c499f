"""Tables that outlive a query: the shared folder they go to, and a log of generations that says which of them hold."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where that is unset and the master is this machine, as in tests, a local one; on a cluster such a folder would be each executor's own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/fathom-checkpoints"


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """df as a table at this place, and read from there."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def content_key(tables: DataFrame) -> str:
    """A name for the present content of the files that a scan reads: their paths, sizes and times."""
    files = tables.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    row = files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)"))).first()
    return f"{row[0]}-{int(row[1] or 0) & (1 << 64) - 1:016x}"


class Log:
    """Generations of a kept structure, one small file each, written after the tables that it names; tables without an entry do not count. One writer at a time."""

    schema = "generation long, kind string, folder string, rows long, amount double"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def entries(self) -> list[tuple[int, str, str, int, float]]:
        """In order, from the last rebuild on: what came before it is replaced by it."""
        try:
            rows = self.spark.read.schema(self.schema).json(f"{self.path}/log/*").orderBy("generation").collect()
        except Exception as e:  # no folder yet: nothing kept
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise
        found = [tuple(r) for r in rows]
        last = max((k for k, r in enumerate(found) if r[1] == "base"), default=0)
        return found[last:]

    def add(self, generation: int, kind: str, folder: str, rows: int, amount: float = 0.0) -> None:
        one = self.spark.createDataFrame([(generation, kind, folder, rows, float(amount))], self.schema)
        one.coalesce(1).write.mode("overwrite").json(f"{self.path}/log/{generation:09d}")


class Rounds:
    """Tables of a loop: each round's table ends the lineage, and the one that it replaces is deleted when asked to."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.path, self.n = spark, new_folder(spark, what), 0

    def put(self, df: DataFrame) -> tuple[DataFrame, str]:
        self.n += 1
        path = f"{self.path}/{self.n:05d}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
