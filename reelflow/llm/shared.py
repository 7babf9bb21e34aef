"""Small helpers of the operators: tables in the shared folder, files by URL, Arrow batches."""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelflow.session import checkpoint_root, scratch_path, ship_package


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark frees the shuffle files of a query at its end, where a setting asks for it.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder: cuts lineage, survives lost executors.

    The shuffle files behind the table go when it is written, so a chain of tables holds one table's shuffles.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, f"llm-{name}"), spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and that nothing reads any more: the tables after them hold all that is needed."""
    for table in tables:
        spark = table.sparkSession
        root = checkpoint_root(spark)
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            if path.getName().startswith("llm-") and path.toUri().getPath().startswith(path_of(spark, root) + "/"):
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def path_of(spark: SparkSession, url: str) -> str:
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(url).toUri().getPath()


def shared_folder(spark: SparkSession, name: str) -> str:
    """URL of a fresh shared folder that tasks may write files to."""
    path = scratch_path(spark, f"llm-{name}")
    if "://" not in path and not path.startswith("file:"):
        path = "file://" + os.path.abspath(path)
    fs, p = filesystem(path)
    fs.create_dir(p, recursive=True)
    return path


def filesystem(url: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URL (file, hdfs, s3, gs); ``file:/x`` counts as ``file:///x``."""
    if url.startswith("file:") and not url.startswith("file://"):
        url = "file://" + url.removeprefix("file:")
    return pafs.FileSystem.from_uri(url)


def publish(url: str, name: str, data_writer) -> str:
    """Write a file through a private name and move it to ``name`` plus a fresh suffix.

    Each attempt of a task makes a file of its own.  Only the manifest rows of
    the attempt that Spark commits name a file, so a retried or speculative
    attempt leaves at most an unnamed file and never a torn one.
    """
    fs, root = filesystem(url)
    final = f"{root}/{name}-{uuid.uuid4().hex[:12]}"
    with fs.open_output_stream(final + ".part") as out:
        data_writer(out)
    fs.move(final + ".part", final)
    return final.rsplit("/", 1)[1]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows, so that a task holds few texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def partitions_for(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names; other columns cannot clash."""
    ship_package(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def ceil_div(n: int, d: int) -> int:
    return math.ceil(n / d) if n else 0


__all__ = ["read", "written", "discard", "shared_folder", "filesystem", "publish", "slices", "partitions_for",
           "id_and_text", "ceil_div", "checkpoint_root"]
