"""Exact duplicates by a tree-merge of sorted digest runs (DataFrame operations only).

Every input partition is one run: its distinct digests, sorted, each with the identifier to keep and
a count.  In each round ``fan_in`` neighbouring runs meet, are sorted together and merged, and only
the kept identifier and the summed count of a digest go on.  So however often a text occurs, a merge
sees at most ``fan_in`` rows for it.  The decision then goes down the same tree, again at most
``fan_in`` rows to a key, until each run knows what its rows' digests came to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written


def exact_dedup(
    df: DataFrame, content: str | Column = "text", id_col: str = "doc_id", keep: str = "smallest", fan_in: int = 16
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row per row of ``df``.

    Equal means: the same SHA-256 and the same number of bytes; both are compared at every level.
    ``keep`` is "smallest" or "largest" identifier.  A null text counts as empty.  A null identifier
    never wins against another; repeated rows of one identifier share their result.  An empty table
    gives an empty result; other columns of ``df`` are not read.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    text = F.coalesce(F.col(content) if isinstance(content, str) else content, F.lit(""))
    rows = df.select(
        F.col(id_col).alias("id"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.octet_length(text).alias("size"),
        F.spark_partition_id().alias("run"),
    )
    rows = written(rows, "digests")
    n_runs = (rows.agg(F.max("run")).first()[0] or 0) + 1

    key = ["digest", "size"]
    level = rows.groupBy("run", *key).agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    levels = [written(level, "run")]
    while n_runs > 1:
        n_runs = -(-n_runs // fan_in)
        merged = (
            levels[-1]
            .withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .repartition("run", *key)
            .sortWithinPartitions("run", *key)
            .groupBy("run", *key)
            .agg(best("keep_id").alias("keep_id"), F.sum("n").alias("n"))
        )
        levels.append(written(merged, "run"))

    # Down again, with the digests of more than one row only: a text that occurs once keeps itself.
    final = levels[-1].where("n > 1").select("run", *key, "keep_id", "n")
    for level in reversed(levels[:-1]):
        up = final.withColumnRenamed("run", "parent")
        final = (
            level.select("run", *key)
            .withColumn("parent", F.floor(F.col("run") / fan_in).cast("int"))
            .join(up, ["parent", *key])
            .select("run", *key, "keep_id", "n")
        )
    keep_id = F.coalesce("keep_id", "id")
    return rows.join(final, ["run", *key], "left").select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
