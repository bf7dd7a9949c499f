"""Where intermediate tables go, and small helpers every operator of this package uses."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

#: The white space of every word rule here: space and \t \n \v \f \r.
WORD_RE = "[^\\x20\\x09-\\x0D]+"


#: Bytes of rows that go to a Python worker at once: texts differ much in size, so a batch is bounded by these and not only by its rows.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH_BYTES; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    found = re.fullmatch(r"(\d+)\s*([kmg]?)b?", spark.conf.get(key).strip().lower())
    now = int(found[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[found[2]] if found else BATCH_BYTES + 1
    if now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder path under spark.checkpoint.dir. Only where that is unset and the master is this machine (tests), under a local temporary folder; on a cluster such
    a folder would be each executor's own, so there it is an error."""
    small_batches(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/fathom-shared"
    return f"{root.rstrip('/')}/fathom-{uuid.uuid4().hex}"


def quoted(column: str) -> str:
    """A column's name as it is, dots and ticks included."""
    return "`" + column.replace("`", "``") + "`"


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], more: str | None = None) -> DataFrame:
    """mapInArrow over whole rows, whatever their columns are called: run sees columns c0, c1, ... in df's order and may append one binary column, named `more`."""
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    schema = StructType(plain.schema.fields + ([StructField("more", BinaryType())] if more else []))
    return plain.mapInArrow(run, schema).toDF(*df.columns, *([more] if more else []))


def unused(columns: list[str], *names: str) -> list[str]:
    """Names for columns of one's own, lengthened until no given column has them."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows that a file of a small table may have.
FILE_ROWS = 100_000


def compact(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Fewer, larger tasks for a write, where many small partitions would each make a file. rows: about how many there are, if that is known and they are cheap to make. No
    rows move, and a task takes its partitions one after another, so its memory is that of the largest."""
    spark = df.sparkSession
    most = max(32, 4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
    return df.coalesce(most if rows is None else min(most, 1 + rows // FILE_ROWS))


def materialise(df: DataFrame, path: str, rows: int | None = None) -> DataFrame:
    """Cuts lineage: writes df as a table in the shared folder and reads it back with the same schema."""
    compact(df, rows).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(text: Column) -> Column:
    """UTF-8 length of a text, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def id_text(doc_id: Column) -> Column:
    """doc_id as text; null counts as the empty text."""
    return F.coalesce(doc_id.cast("string"), F.lit(""))
