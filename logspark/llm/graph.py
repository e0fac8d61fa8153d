"""Written intermediate tables and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.session import scratch_path

#: Settings while a scratch folder is in use: shuffle files go as soon as a table is written, and Python workers get texts in small batches.
LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder for tables that nothing reads afterwards: it is deleted at the end; meanwhile LEAN holds."""
    folder, before = scratch_path(spark, name), {key: spark.conf.get(key) for key in LEAN}
    for key, value in LEAN.items():
        spark.conf.set(key, value)
    try:
        yield folder
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write to the shared scratch folder, or to one of ``scratch``, and read back: cuts lineage and survives lost executors."""
    path = f"{folder}/{name}-{uuid.uuid4().hex}" if folder else scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(links: DataFrame) -> DataFrame:
    """``(id, root)`` for every id of the links ``(a, b)``; root is the smallest id that can be reached.

    Large-star and small-star rounds (Kiveris et al., "Connected components in MapReduce and beyond"): the
    larger end of a link moves to the smallest neighbour of the smaller end, then the smaller neighbours of
    an id move to the smallest of them. Links only get fewer; the rounds end when each component is one star
    around its root. Nulls and self-links are left out.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    links = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _stars_only(links):
        tops = links.groupBy(F.col("a").alias("top")).agg(F.min("b").alias("low"))
        moved = links.join(tops, links["b"] == tops["top"], "left").select("a", F.coalesce("low", "b").alias("b"))
        moved = stored(moved.distinct(), "links")
        least = moved.groupBy(F.col("a").alias("top")).agg(F.min("b").alias("low"))
        ends = F.inline(F.array(F.struct(F.col("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b"))))
        links = stored(moved.join(least, moved["a"] == least["top"]).select(ends).where("a <> b").distinct(), "links")
    roots = links.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("id"), F.col("b").alias("root")).union(roots)


def _stars_only(links: DataFrame) -> bool:
    """Whether each larger end has one link and is no smaller end of another."""
    ends = F.inline(F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("up")), F.struct(F.col("b").alias("id"), F.lit(0).alias("up"))))
    seen = links.select(ends).groupBy("id").agg(F.sum("up").alias("up"), F.min("up").alias("low"))
    return seen.where("up > 1 OR (up = 1 AND low = 0)").isEmpty()
