"""Tables as canonical log rows.  An adapter is any function DataFrame -> log rows; ``register`` adds one.

``at`` carries the stored timestamp of tables that have one, so that time bounds can reach the scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import micros

Adapter = Callable[[DataFrame], DataFrame]
ADAPTERS: dict[str, Adapter] = {}


def register(name: str) -> Callable[[Adapter], Adapter]:
    def add(f: Adapter) -> Adapter:
        ADAPTERS[name] = f
        return f

    return add


def _labels(**pairs):
    return F.create_map(*[x for k, c in pairs.items() for x in (F.lit(k), F.col(c).cast("string") if isinstance(c, str) else c.cast("string"))])


@register("events")
def events(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("user_id").alias("source_id"), micros("ts").alias("ts"), F.col("event_id").alias("seq"), F.col("event_type").alias("key"),
        F.col("props").alias("value"), _labels(event_type="event_type", shard=F.col("user_id") % 4).alias("labels"), F.col("ts").alias("at"), F.col("value").alias("measure"),
    )


@register("documents")
def documents(df: DataFrame) -> DataFrame:
    return df.select(
        (F.col("doc_id") % 16).alias("source_id"), F.col("doc_id").alias("ts"), F.col("doc_id").alias("seq"), F.col("source").alias("key"),
        F.col("text").alias("value"), _labels(lang="lang", source="source").alias("labels"),
    )


@register("conversations")
def conversations(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("conv_id").alias("source_id"), F.col("turn").alias("ts"), F.col("turn").alias("seq"), F.col("role").alias("key"),
        F.col("text").alias("value"), _labels(role="role").alias("labels"),
    )


@register("lineitem")
def lineitem(df: DataFrame) -> DataFrame:
    """No natural sequence number: ``seq`` is null until one is assigned."""
    return df.select(
        F.col("l_suppkey").alias("source_id"), micros("l_shipdate").alias("ts"), F.lit(None).cast("long").alias("seq"), F.col("l_returnflag").alias("key"),
        F.col("l_linestatus").alias("value"), _labels(l_returnflag="l_returnflag", l_linestatus="l_linestatus").alias("labels"), F.col("l_shipdate").alias("at"),
    )


@register("orders")
def orders(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("o_custkey").alias("source_id"), micros("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("key"),
        F.col("o_orderstatus").alias("value"), _labels(status="o_orderstatus", priority="o_orderpriority").alias("labels"), F.col("o_orderdate").alias("at"),
    )


def logs(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ADAPTERS[name](spark.read.parquet(f"{folder}/{name}.parquet"))


def json_batch(spark: SparkSession, path: str) -> DataFrame:
    """Inserts from a JSON list of {source_id, ts, key, value}."""
    return spark.read.schema("source_id long, ts long, key string, value string").option("multiLine", True).option("mode", "FAILFAST").json(path)
