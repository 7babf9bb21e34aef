"""Stage outputs written once as tables in the shared checkpoint folder.

A pipeline stage (transcript segments, sections) feeds many downstream
operators; re-deriving it inside every plan repeats scans and shuffles and
keeps a long lineage. ``stage_table`` writes it once per session and input
version under ``spark.checkpoint.dir`` and returns a fresh scan of the written
table, which also cuts lineage: a lost executor re-reads the table instead of
recomputing the stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reelflow.session import scratch_path

_WRITTEN: dict[tuple, str] = {}


def _version(spark: SparkSession, paths: list[str]) -> tuple:
    """Path, length and modification time of every file under the inputs, through the Hadoop file system."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        fs = hp.getFileSystem(conf)
        if not fs.exists(hp):
            out.append((p, None, None))             # a missing input fails later, in the read itself
        elif fs.getFileStatus(hp).isFile():
            st = fs.getFileStatus(hp)
            out.append((p, st.getLen(), st.getModificationTime()))
        else:
            files = fs.listFiles(hp, True)
            while files.hasNext():
                st = files.next()
                out.append((st.getPath().toString(), st.getLen(), st.getModificationTime()))
    return tuple(sorted(out, key=str))


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hp = jvm.org.apache.hadoop.fs.Path(path)
    return bool(hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hp))


def children(spark: SparkSession, path: str) -> list[str]:
    """Paths directly under a folder (none where it is missing)."""
    jvm = spark.sparkContext._jvm
    hp = jvm.org.apache.hadoop.fs.Path(path)
    fs = hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [st.getPath().toString() for st in fs.listStatus(hp)] if fs.exists(hp) else []


def stage_path(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], DataFrame]) -> str:
    """Folder holding ``build()``'s output, written once for this session and these input files."""
    key = (spark.sparkContext.applicationId, name, _version(spark, inputs))
    path = _WRITTEN.get(key)
    if path is not None and not exists(spark, path):
        path = None                                   # the shared folder was cleaned: write it again
    if path is None:
        path = scratch_path(spark, f"stage-{name}")
        build().write.mode("overwrite").parquet(path)
        _WRITTEN[key] = path
    return path


def stage_table(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """Materialise ``build()`` once for this session and these input files; read it back."""
    return spark.read.parquet(stage_path(spark, name, inputs, build))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: computed once, whatever reads it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
