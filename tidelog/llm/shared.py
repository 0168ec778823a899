"""Folders and written tables that every executor and the driver can see.

Intermediate results that are read more than once, or that cut a long lineage, are written as
Parquet under the folder named by ``spark.checkpoint.dir``.  An executor that dies afterwards costs
a re-read, never a recomputation, and nothing is kept in an executor's own folder.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as ``spark.checkpoint.dir`` or the set checkpoint folder names it."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def _held(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shuffles_removed(spark: SparkSession):
    """Queries run inside leave no shuffle files behind: for those whose result is written out."""
    return _held(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def plain_arithmetic(spark: SparkSession):
    """Arithmetic of DataFrames made inside wraps around."""
    return _held(spark, "spark.sql.ansi.enabled", "false")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read back: one evaluation, no lineage, survives lost executors."""
    path = new_folder(df.sparkSession, label)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    if _scratch.get() is not None:
        _scratch.get().append(out)
    return out


_scratch: ContextVar[list | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch():
    """Tables written inside are removed at the end, but for those given to ``keep``, what ``with`` names: the surrounding one has these."""
    outer, kept = _scratch.get(), []
    mark = _scratch.set([])

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.written_to)
        return df

    try:
        yield keep
    finally:
        mine = _scratch.get()
        _scratch.reset(mark)
        discard(*(df for df in mine if df.written_to not in kept))
        if outer is not None:
            outer += [df for df in mine if df.written_to in kept]


def discard(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def one_task_each(manifest: DataFrame) -> DataFrame:
    """A written manifest of files, dealt so that each file is read by a task of its own."""
    return manifest.repartition(max(1, manifest.count()))


def open_shared(path: str):
    """(file system, path) of a shared folder or file, usable on executors; any URI pyarrow knows."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path[len("file:") :]
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def replace_file(path: str, attempt: str):
    """A writer for ``path`` that appears under its name only when closed; retries are harmless."""
    return _Replacing(path, attempt)


class _Replacing:
    def __init__(self, path: str, attempt: str):
        self.fs, self.path = open_shared(path)
        self.temp = f"{self.path}.{attempt}.part"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)

    def __enter__(self):
        self.out = self.fs.open_output_stream(self.temp)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind:
            self.fs.delete_file(self.temp)
        else:
            self.fs.move(self.temp, self.path)


_remembered: dict = {}


def remembered(key, make):
    """What a worker process keeps for its next tasks: ``make()`` of one key, that asked for last."""
    if key not in _remembered:
        _remembered.clear()  # an operator's tables go before the next one fills its own
        _remembered[key] = make()
    return _remembered[key]


def task_label() -> tuple[int, str]:
    """(partition, a name for this attempt)."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId(), f"{context.taskAttemptId()}"
