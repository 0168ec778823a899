"""Files of benchmark runs: results, goals, run folders, baselines."""

from __future__ import annotations

import tomllib
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..schema import RUN_SCHEMA


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Runs of a result file, a JSON object with ``results`` (S34), in file order as ``run_no``; an empty file has none."""
    row = StructType.fromDDL(RUN_SCHEMA)
    raw = spark.read.schema(StructType().add("results", ArrayType(row)))
    raw = raw.option("multiLine", True).json(path)
    return raw.select(F.posexplode("results").alias("run_no", "r")).select("run_no", "r.*")


def goals(spark: SparkSession, text: str | None) -> DataFrame:
    """(scope, metric, goal) from TOML sections per workload and ``aggregate``; none for no text."""
    rows = [(scope, metric, float(goal)) for scope, each in tomllib.loads(text or "").items() for metric, goal in each.items()]
    return spark.createDataFrame(rows, "scope string, metric string, goal double")


def classify_run_files(files: DataFrame) -> DataFrame:
    """(path, run, kind) of files of run folders: meta, result, mem, log, prof or other."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    kind = (
        F.when(name.startswith("meta"), "meta").when(name.rlike(r"^(result|bench).*\.json$"), "result").when(name.startswith("mem"), "mem")
        .when(name.rlike(r"\.log$"), "log").when(name.rlike(r"(?i)(prof|flame|\.folded$|\.svg$)"), "prof").otherwise("other")
    )
    return files.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("run"), kind.alias("kind"))


def run_folder(stamp: str, tag: str) -> str:
    """Name of a run's folder."""
    return str(PurePosixPath(f"{stamp}__{tag}" if tag else stamp))
