"""Label streams: the registry, its inverted index, and range scans over all streams that match."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import fingerprint, has_labels, labels_text
from ..schema import STREAM_KEY
from .series import check_range, in_time

#: A registry up to this many rows is sent to every task; a larger one is joined by a shuffle.
BROADCAST_STREAMS = 100_000


def build_registry(records: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(stream_id, fingerprint, labels, first_seq): a row per distinct label map.

    Ids go on from those of ``known``, in the order in which the maps were first seen.  Maps are
    compared as text of their sorted pairs, so a collision of fingerprints joins nothing.
    """
    seen = records.groupBy(labels_text("labels").alias("_text")).agg(F.min("seq").alias("first_seq"), F.first("labels").alias("labels"))
    start = 0
    if known is not None:
        seen = seen.join(known.select(labels_text("labels").alias("_text")), "_text", "left_anti")
        last = known.agg(F.max("stream_id")).first()[0]
        start = 0 if last is None else last + 1
    # One row per stream, not per record.
    order = Window.orderBy("first_seq", "_text")
    new = seen.select(
        (F.row_number().over(order) - 1 + F.lit(start)).cast("long").alias("stream_id"), fingerprint("labels").alias("fingerprint"), "labels", "first_seq"
    )
    return new if known is None else known.unionByName(new)


def _sized(small: DataFrame, rows: int) -> DataFrame:
    """Broadcast only what has been counted and is small."""
    return F.broadcast(small) if rows <= BROADCAST_STREAMS else small


def resolve_streams(records: DataFrame, registry: DataFrame) -> DataFrame:
    """Records with their ``stream_id`` (J3); null where the registry does not know the labels."""
    r = registry.select("stream_id", fingerprint("labels").alias("_f"), labels_text("labels").alias("_t"))
    keyed = records.withColumn("_f", fingerprint("labels")).withColumn("_t", labels_text("labels"))
    return keyed.join(_sized(r, registry.count()), ["_f", "_t"], "left").drop("_f", "_t")


def inverted_index(registry: DataFrame) -> DataFrame:
    """(label_key, label_value, n_streams, streams): the streams that carry a pair."""
    pairs = registry.select("stream_id", F.explode("labels").alias("label_key", "label_value"))
    return pairs.groupBy("label_key", "label_value").agg(
        F.count_distinct("stream_id").alias("n_streams"), F.array_sort(F.collect_set("stream_id")).alias("streams")
    )


def match_streams(registry: DataFrame, labels: dict[str, str], strict: bool = True) -> DataFrame:
    """Streams that carry all of ``labels`` (U3, J2, P8); no labels match nothing.

    ``strict``: a pair that no stream carries makes the result empty.  Otherwise such pairs are left
    out of the condition, and if none is left the result is empty.
    """
    if not strict and labels:
        known = registry.agg(*(F.max(has_labels("labels", {k: v}).cast("int")).alias(f"_{i}") for i, (k, v) in enumerate(labels.items()))).first()
        labels = {k: v for i, (k, v) in enumerate(labels.items()) if known[i]}
    return registry.where(has_labels("labels", labels))


def attach_labels(records: DataFrame, registry: DataFrame) -> DataFrame:
    """Left join: records of streams that the registry lacks keep null labels."""
    return records.join(_sized(registry.select("stream_id", "labels"), registry.count()), "stream_id", "left")


def label_range(
    records: DataFrame, registry: DataFrame, labels: dict[str, str], start: int | None = None, end: int | None = None,
    strict: bool = True, raw: str | None = None, dedup: bool = True,
) -> DataFrame:
    """Records of all matching streams with ``start <= ts <= end``, labels attached, in stream order.

    ``records`` has stream_id.  The time bounds go to the scan; the matching streams are a semi join.
    """
    check_range(start, end)
    matching = match_streams(registry, labels, strict)
    rows = matching.count()
    found = records.where(in_time(start, end, closed=True, raw=raw)).drop("labels")
    found = found.join(_sized(matching.select("stream_id", "labels"), rows), "stream_id")
    if dedup:
        found = found.dropDuplicates(list(STREAM_KEY))
    return found.orderBy(*STREAM_KEY)


def cardinality(records: DataFrame, registry: DataFrame) -> DataFrame:
    """(label_key, n_values, n_streams, n_records) per label key."""
    pairs = registry.select("stream_id", F.explode("labels").alias("label_key", "label_value"))
    per_stream = records.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        pairs.join(per_stream, "stream_id", "left")
        .groupBy("label_key")
        .agg(
            F.count_distinct("label_value").alias("n_values"),
            F.count_distinct("stream_id").alias("n_streams"),
            F.sum(F.coalesce("n", F.lit(0))).alias("n_records"),
        )
    )
