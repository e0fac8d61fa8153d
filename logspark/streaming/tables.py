"""Tables that micro-batches write below one folder, safe when a batch runs twice.

Every batch writes ``name/batch=N`` (or ``name/event_date=D/batch=N``) and replaces what an earlier attempt of the
same batch left there. A reader that must not depend on later batches names the batches it wants.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logspark.session import scratch_path


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below ``path`` on any Hadoop file system; none if it doesn't exist."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return []
    return sorted(s.getPath().getName() for s in store.listStatus(folder) if s.isDirectory())


def exists(spark: SparkSession, path: str) -> bool:
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark._jsc.hadoopConfiguration()).exists(name)


def drop_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def write_daily_batch(rows: DataFrame, path: str, batch_id: int, ts: str = "timestamp") -> None:
    """Rows below ``event_date=D/batch=N``; only the partitions of this batch are replaced."""
    table = rows.withColumns({"event_date": F.to_date(ts), "batch": F.lit(batch_id).cast("bigint")})
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date", "batch").parquet(path)


def batches(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(name.removeprefix("batch=")) for name in folders(spark, path) if name.startswith("batch="))


def read_batches(spark: SparkSession, path: str, schema: T.StructType | str, *, before: int | None = None, after: int | None = None) -> DataFrame:
    """The rows of all batches, or of those ``before`` and ``after`` the given numbers, with ``batch``."""
    known = [b for b in batches(spark, path) if (before is None or b < before) and (after is None or b > after)]
    empty = spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("bigint"))
    if not known:
        return empty
    full = T.StructType([*empty.schema.fields])
    return spark.read.schema(full).option("basePath", path).parquet(*[f"{path}/batch={b}" for b in known])


def read_daily(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table of ``event_date=D/batch=N`` folders with both as columns; empty if nothing was written yet."""
    if not folders(spark, path):
        return spark.createDataFrame([], schema).withColumns({"event_date": F.lit(None).cast("date"), "batch": F.lit(None).cast("bigint")})
    full = T.StructType([*schema.fields, T.StructField("event_date", T.DateType()), T.StructField("batch", T.LongType())])
    return spark.read.schema(full).parquet(path)


def advance(spark: SparkSession, path: str, batch_id: int, rows: DataFrame, fold: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """State as versions: ``batch=N`` is ``fold`` of the version before N and of this batch's rows.

    A batch that runs again starts from the same earlier version. The version before the last is kept, older ones go.
    Returns the new version.
    """
    known = [b for b in batches(spark, path) if b < batch_id]
    if known:
        rows = spark.read.schema(rows.schema).parquet(f"{path}/batch={known[-1]}").unionByName(rows)
    new = fold(rows)
    write_batch(new, path, batch_id)
    for old in known[:-1]:
        drop_folder(spark, f"{path}/batch={old}")
    return spark.read.schema(new.schema).parquet(f"{path}/batch={batch_id}")


def latest(spark: SparkSession, path: str, schema: T.StructType | str, *, before: int | None = None) -> DataFrame:
    """The newest version of a state table."""
    known = [b for b in batches(spark, path) if before is None or b < before]
    return spark.read.schema(schema).parquet(f"{path}/batch={known[-1]}") if known else spark.createDataFrame([], schema)


def in_runs(spark: SparkSession, pieces: Iterable[DataFrame], start: Callable[[DataFrame], object], *, name: str = "pieces") -> None:
    """Land each piece as files and run the stream over what is new, restarting from its checkpoint every time."""
    folder = scratch_path(spark, name)
    for piece in pieces:
        piece.write.mode("append").parquet(folder)
        start(spark.readStream.schema(piece.schema).parquet(folder)).awaitTermination()
