"""Keyed series: range scans, tiers, latest points, sequence numbers."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SERIES_KEY


def check_range(start: int | None, end: int | None) -> None:
    """The same complaints for every kind of range, before any plan is built."""
    if start is not None and end is not None and start > end:
        raise ValueError(f"the range ends ({end}) before it begins ({start})")
    if start is not None and start < 0:
        raise ValueError(f"a range begins at 0 or later, not at {start}")


def in_time(start: int | None, end: int | None, closed: bool = False, ts: str = "ts", raw: str | None = None) -> Column:
    """``start <= ts < end``, or ``<= end`` if closed; an absent bound is no predicate.

    ``raw`` names the timestamp column that ``ts`` was computed from.  The same bounds are put on it as
    literals, since only predicates on stored columns reach the Parquet scan.
    """
    out = F.lit(True)

    def literal(us: int) -> Column:
        return F.lit(datetime.fromtimestamp(us // 1_000_000, timezone.utc).strftime("%Y-%m-%d %H:%M:%S") + f".{us % 1_000_000:06d}").cast("timestamp_ntz")

    for bound, ok in ((start, lambda c, b: c >= b), (end, (lambda c, b: c <= b) if closed else (lambda c, b: c < b))):
        if bound is not None:
            out = out & ok(F.col(ts), F.lit(bound))
            if raw:
                out = out & ok(F.col(raw), literal(bound))
    return out


def range_scan(
    logs: DataFrame, source_id: int, key: str, start: int, end: int, contains: str = "", raw: str | None = None, dedup: bool = True
) -> DataFrame:
    """Records of one series with ``start <= ts < end``, in (ts, seq) order.

    ``contains`` keeps values with that substring, case-sensitive; the empty string keeps all.  Records
    of equal keys are one.  The sort and the duplicates' shuffle see only what the scan lets through.
    """
    check_range(start, end)
    found = logs.where((F.col("source_id") == source_id) & (F.col("key") == key) & in_time(start, end, raw=raw))
    if contains:
        found = found.where(F.contains("value", F.lit(contains)))
    if dedup:
        found = found.dropDuplicates(list(SERIES_KEY))
    return found.orderBy("ts", "seq")


def multi_range(logs: DataFrame, requests: DataFrame) -> DataFrame:
    """Many range requests at once: (req_id, source_id, key, start_ts, end_ts, contains) joined with the records.

    An equality join on the series with the bounds as residual predicates.  Requests that start after
    their end, or before 0, are refused.
    """
    wrong = requests.where("start_ts > end_ts or start_ts < 0")
    if not wrong.isEmpty():
        raise ValueError("a request has start_ts > end_ts or start_ts < 0")
    r = requests.select("req_id", F.col("source_id").alias("r_source"), F.col("key").alias("r_key"), "start_ts", "end_ts", "contains")
    on = (
        (F.col("source_id") == F.col("r_source"))
        & (F.col("key") == F.col("r_key"))
        & (F.col("ts") >= F.col("start_ts"))
        & (F.col("ts") < F.col("end_ts"))
        & ((F.col("contains") == "") | F.contains("value", F.col("contains")))
    )
    return logs.join(r, on).drop("r_source", "r_key", "start_ts", "end_ts", "contains")


def merge_tiers(*tiers: DataFrame, key: Sequence[str] = SERIES_KEY, dedup: bool = True) -> DataFrame:
    """Union of tiers, newest first; of records with equal keys the first tier's stays.

    An aggregation with one kept row per key: duplicates are dropped before the shuffle too.
    """
    numbered = [t.withColumn("_tier", F.lit(i)) for i, t in enumerate(tiers)]
    both = numbered[0]
    for t in numbered[1:]:
        both = both.unionByName(t)
    if not dedup:
        return both.drop("_tier")
    rest = [c for c in both.columns if c not in key]
    kept = both.groupBy(*key).agg(F.min_by(F.struct(*rest), "_tier").alias("_row")) if rest != ["_tier"] else both.select(*key).distinct()
    return kept.select(*key, *(F.col(f"_row.{c}").alias(c) for c in rest if c != "_tier")) if rest != ["_tier"] else kept


def latest_point(logs: DataFrame, by: Sequence[str] = ("source_id", "ts", "key")) -> DataFrame:
    """The record of the highest sequence number of each point (S8); ties by value, the greatest."""
    rest = [c for c in logs.columns if c not in by and c != "labels"]
    ordered = ["seq", *(c for c in rest if c != "seq")]
    return logs.groupBy(*by).agg(F.max(F.struct(*ordered)).alias("_r")).select(*by, *(F.col(f"_r.{c}").alias(c) for c in ordered))


def next_sequence(*stored: DataFrame) -> int:
    """One more than the highest stored sequence number; 0 with nothing stored."""
    found = [d.agg(F.max("seq")).first()[0] for d in stored]
    return max((x for x in found if x is not None), default=-1) + 1


def assign_sequence(batch: DataFrame, order: str, start: int = 0, name: str = "seq", slices: int | None = None) -> DataFrame:
    """Consecutive numbers in ``order``'s order from ``start`` (W1), without one task for all rows.

    ``order`` is a unique number.  Its approximate quantiles cut the rows into slices; a slice numbers
    its rows on its own and starts after the rows of the slices before, of which there is one count each.
    """
    n = slices or max(1, batch.sparkSession.sparkContext.defaultParallelism)
    cuts = sorted(set(batch.approxQuantile(order, [i / n for i in range(1, n)], 0.01))) if n > 1 else []
    slice_of = F.lit(0)
    for c in cuts:
        slice_of = slice_of + (F.col(order) > F.lit(c)).cast("int")
    placed = batch.withColumn("_slice", slice_of)
    counts = placed.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    counts = counts.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_slice").orderBy(order))
    numbered = placed.withColumn("_own", own).join(counts, "_slice")
    return numbered.withColumn(name, F.col("_before") + F.col("_own") - 1 + F.lit(start)).drop("_slice", "_own", "_before")


def tail(logs: DataFrame, window_us: int) -> DataFrame:
    """Records of the last ``window_us`` before the newest one of all (W13): [newest - window, newest), from 0 on.

    The newest time is looked up first, so that the bounds are literals and reach the scan.
    """
    newest = logs.agg(F.max("ts")).first()[0]
    if newest is None:
        return logs.limit(0)
    return logs.where((F.col("ts") >= max(newest - window_us, 0)) & (F.col("ts") < newest))
