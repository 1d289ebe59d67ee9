"""What the text operators share: reading tables, cutting lineage, mapping text in Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Text bytes that one Python step holds at a time; a longer single text is a step of its own.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, else the context's own, else (tests) a new one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sampleloom-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no one uses yet; it goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def saved_in(df: DataFrame, label: str, codec: str = "snappy", options: dict[str, str] | None = None) -> tuple[DataFrame, str]:
    """Cuts the lineage: writes df to the shared folder and reads it back, so lost executors cost no recomputation. `options` are Parquet's.

    The second result is the folder, for drop_folder() once nothing reads it any more.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.option("compression", codec).options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def saved(df: DataFrame, label: str) -> DataFrame:
    """saved_in() for a table that is read until the session ends."""
    return saved_in(df, label)[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of a batch that hold about `most` bytes of `column`."""
    at = batch.schema.get_field_index(column)
    n, per_row = batch.num_rows, batch.column(at).nbytes / max(1, batch.num_rows)
    step = max(1, int(most / max(per_row, 1)))
    for start in range(0, n, step):
        yield batch.slice(start, step)


def small_batches(spark: SparkSession) -> None:
    """Rows carry whole texts: unless the session says otherwise, Arrow batches hold 1000 of them, not 10000."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def fields(ddl: str) -> list[T.StructField]:
    return T.StructType.fromDDL(ddl).fields


def map_text(df: DataFrame, text_col: str, added: str, make: Callable[[], Callable[[list], list]], keep: list[str] | None = None, most: int = SLICE_BYTES) -> DataFrame:
    """Adds the columns of the DDL string `added`, computed in Python from one text column.

    `make` runs once a task on the executor and returns f(texts) -> one list or Arrow array for
    each added column; it gets about `most` bytes of text at a time. `keep` names the columns that stay beside them (default: all). A column
    of df with an added column's name is replaced.
    """
    small_batches(df.sparkSession)
    new = fields(added)
    names = {f.name.lower() for f in new}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias("__text__"))
    out = T.StructType([*source.drop("__text__").schema.fields, *new])
    arrow = to_arrow_schema(T.StructType(new))

    def run(batches):
        f = make()
        for whole in batches:
            for part in slices(whole, "__text__", most):
                got = f(part.column("__text__").to_pylist())
                cols = [a if isinstance(a, (pa.Array, pa.ChunkedArray)) else pa.array(a, type=field.type) for a, field in zip(got, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *cols], names=[*kept, *[x.name for x in new]])

    return source.mapInArrow(run, out)
