"""Limits on records; what breaks them is kept apart with a reason, never dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import MAX_LABEL_BYTES, MAX_LABELS, MAX_PAYLOAD_BYTES, MIN_PAYLOAD_BYTES


def payload_status(payload: Column | str, labels: Column | str | None = None) -> Column:
    """accepted, too_small or too_large (P11); with labels, they and the body share the upper limit."""
    size = F.octet_length(payload if isinstance(payload, Column) else F.col(payload))
    whole = size if labels is None else size + label_bytes(labels)
    return F.when(size.isNull() | (size < MIN_PAYLOAD_BYTES), "too_small").when(whole > MAX_PAYLOAD_BYTES, "too_large").otherwise("accepted")


def label_bytes(labels: Column | str) -> Column:
    """Bytes of a map on the wire: a count, and a length before each string."""
    m = F.col(labels) if isinstance(labels, str) else labels
    return F.lit(1) + F.aggregate(F.map_entries(m), F.lit(0), lambda s, e: s + 2 + F.octet_length(e["key"]) + F.octet_length(e["value"]))


def label_status(labels: Column | str) -> Column:
    """accepted, no_labels, too_many or bad_label: 1 to 255 pairs of strings of 1 to 255 bytes."""
    m = F.col(labels) if isinstance(labels, str) else labels
    fits = lambda s: F.octet_length(s).between(1, MAX_LABEL_BYTES)
    good = F.forall(F.map_entries(m), lambda e: F.coalesce(fits(e["key"]) & fits(e["value"]), F.lit(False)))
    return F.when(m.isNull() | (F.size(m) == 0), "no_labels").when(F.size(m) > MAX_LABELS, "too_many").when(~good, "bad_label").otherwise("accepted")


def split_valid(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined with ``reason``) of a batch of log rows."""
    reason = (
        F.when(F.col("ts").isNull() | (F.col("ts") < 0), "bad_ts")
        .when(F.col("source_id").isNull(), "bad_source")
        .when(label_status("labels") != "accepted", label_status("labels"))
        .when(payload_status("value", "labels") != "accepted", payload_status("value", "labels"))
        .when(~F.is_valid_utf8("value"), "bad_utf8")
    )
    marked = batch.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")
