"""Files under names of their own: a Python data source for rows (name, body), committed in two phases.

Spark's file writers choose their files' names, and later steps look for theirs
(``<video>.aligned.json``, ``<video>_prompts.json``, ``metadata.json``).

1. Tasks, as many as the shuffle has partitions, write under ``<path>/_staged-<job>/<attempt>/``,
   one folder without others in it, and list what they wrote there. Readers skip
   names that start with an underscore.
2. Once every task is done, the writer's commit notes the attempts that count, one
   a task; a failed job removes its folder, a failed attempt is never noted (a task
   that outlives its job may leave parts in the hidden folder, which nothing reads).
3. ``write_files`` then moves the noted files to their names, in a Spark job over
   the lists, so the driver handles no file by itself. A move replaces a file of
   that name as a whole (SNK-8), and one that a lost task has done already is
   passed over, so the job can be retried at any point.

Bodies are written as they are (text as UTF-8). Names are relative, unique in a
run, and hold no line break. Any file system that Arrow reaches by its URL will do.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from reelflow.session import ship_package


def filesystem(url: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URL or a local path."""
    if url.startswith("file:") and not url.startswith("file://"):
        url = "file://" + url.removeprefix("file:")
    if "://" not in url:
        return pafs.LocalFileSystem(), os.path.abspath(url)
    return pafs.FileSystem.from_uri(url.replace("s3a://", "s3://", 1))


def staged(name: str) -> str:
    """A file's name in its task's folder: its own, or one without folders in their place."""
    return hashlib.sha256(name.encode()).hexdigest() if "/" in name else name


def checked(name: str | None) -> str:
    if not name or name.startswith("/") or "\n" in name or any(p in ("", ".", "..") or p.startswith("_staged-") for p in name.split("/")):
        raise ValueError(f"not a relative file name: {name!r}")
    return name


@dataclass
class Staged(WriterCommitMessage):
    attempt: str


class NamedFiles(DataSource):
    """Write-only source ``named_files``: option ``path``, and ``job``, the name of the run."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, body string"

    def writer(self, schema, overwrite: bool) -> NamedWriter:
        return NamedWriter(self.options["path"], self.options["job"])


class NamedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, job: str):
        self.path, self.job = path, job

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        fs, root = filesystem(self.path)
        context = TaskContext.get()
        attempt = f"{context.partitionId()}-{context.taskAttemptId()}"
        folder, names = f"{root}/_staged-{self.job}/{attempt}", set()
        fs.create_dir(folder, recursive=True)
        for batch in iterator:
            for name, body in zip(batch.column(0), batch.column(1)):
                name, body = checked(name.as_py()), body.as_py() or b""
                if name in names:
                    raise ValueError(f"a file name comes twice: {name}")
                names.add(name)
                with fs.open_output_stream(f"{folder}/{staged(name)}") as out:
                    out.write(body.encode() if isinstance(body, str) else body)
        with fs.open_output_stream(f"{root}/_staged-{self.job}/{attempt}.list") as out:
            out.write("".join(n + "\n" for n in sorted(names)).encode())
        return Staged(attempt)

    def commit(self, messages: list) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(f"{root}/_staged-{self.job}", recursive=True)
        with fs.open_output_stream(f"{root}/_staged-{self.job}/committed") as out:
            out.write("".join(m.attempt + "\n" for m in messages if m is not None).encode())

    def abort(self, messages: list) -> None:
        fs, root = filesystem(self.path)
        if fs.get_file_info(f"{root}/_staged-{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/_staged-{self.job}")


def _moves(path: str, job: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(path)
        made: set[str] = set()
        for batch in batches:
            for attempt, name in zip(batch.column("attempt").to_pylist(), batch.column("name").to_pylist()):
                parent = os.path.dirname(f"{root}/{name}")
                if parent not in made:
                    fs.create_dir(parent, recursive=True)
                    made.add(parent)
                source = f"{root}/_staged-{job}/{attempt}/{staged(name)}"
                if fs.get_file_info(source).type == pafs.FileType.NotFound:       # moved by an attempt that was lost
                    if fs.get_file_info(f"{root}/{name}").type == pafs.FileType.NotFound:
                        raise FileNotFoundError(source)
                    continue
                fs.move(source, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column("name")], names=["name"])

    return run


def write_files(files: DataFrame, path: str) -> None:
    """Write each row (name, body) as the file ``<path>/<name>``; files of other names stay."""
    spark, job = files.sparkSession, uuid.uuid4().hex[:12]
    ship_package(spark)
    spark.dataSource.register(NamedFiles)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # files are many and small: left to the bytes of their bodies, a few tasks would write them all
    files.select("name", "body").repartition(width, "name").write.format("named_files").mode("append").option("job", job).save(path)
    fs, root = filesystem(path)
    below = f"{path.rstrip('/')}/_staged-{job}"
    with fs.open_input_stream(f"{root}/_staged-{job}/committed") as f:
        attempts = f.read().decode().split()                                      # one a task
    lists = spark.read.text([f"{below}/{a}.list" for a in attempts]) if attempts else None
    if lists is not None:
        named = lists.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.list$", 1).alias("attempt"), F.col("value").alias("name"))
        moved = named.repartition(width, "name").mapInArrow(_moves(path, job), "name string")
        moved.write.format("noop").mode("overwrite").save()
    fs.delete_dir(f"{root}/_staged-{job}")
