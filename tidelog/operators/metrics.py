"""Operational analytics: latency summaries, counters, throughput, memory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the longest latency that is told apart, in microseconds.
MAX_LATENCY_US = 3_600_000_000
QUANTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p99_9": 0.999}


def latency_us(us: Column | str) -> Column:
    """Clamped and cut to whole microseconds (A3)."""
    c = F.col(us) if isinstance(us, str) else us
    return F.greatest(F.lit(0.0), F.least(F.lit(float(MAX_LATENCY_US)), c)).cast("long")


def latency_summary(samples: DataFrame, by: Sequence[str], us: str = "us", exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """min, quantiles, max, mean, stddev, n per group (A4, F23); an empty input has no row.

    Exact quantiles keep a count per distinct value of a group; ``exact=False`` gives t-digest-like
    sketches of fixed size instead, which is what very many distinct values want.
    """
    v = latency_us(us)
    if exact:
        marks = [F.expr(f"percentile_disc({q}) within group (order by _v)").cast("long").alias(n) for n, q in QUANTILES.items()]
    else:
        marks = [F.percentile_approx("_v", q, accuracy).alias(n) for n, q in QUANTILES.items()]
    return (
        samples.withColumn("_v", v)
        .groupBy(*by)
        .agg(F.min("_v").alias("min"), *marks, F.max("_v").alias("max"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("stddev"), F.count("_v").alias("n"))
    )


def counter(changes: DataFrame, by: Sequence[str], amount: str = "amount") -> DataFrame:
    """Monotone sums (A1)."""
    return changes.groupBy(*by).agg(F.sum(amount).alias("total"), F.count(F.lit(1)).alias("events"))


def gauge(changes: DataFrame, by: Sequence[str], order: str = "seq") -> DataFrame:
    """The value of a gauge after its changes (A2): the last ``set``, plus the ``add``s and minus the ``sub``s after it.

    ``changes`` has (op, amount) and a unique order per gauge.
    """
    last = changes.groupBy(*by).agg(F.max(F.when(F.col("op") == "set", F.struct(order, "amount"))).alias("_set"))
    both = changes.join(last, list(by))
    after = F.col("_set").isNull() | (F.col(order) > F.col(f"_set.{order}"))
    signed = F.when(F.col("op") == "add", F.col("amount")).when(F.col("op") == "sub", -F.col("amount")).otherwise(F.lit(0))
    return both.groupBy(*by).agg((F.coalesce(F.max("_set.amount"), F.lit(0)) + F.sum(F.when(after, signed).otherwise(F.lit(0)))).alias("value"))


def throughput(events: DataFrame, by: Sequence[str], ts: str = "ts") -> DataFrame:
    """Events per second over each group's own span (A9, A10); null where it has no span."""
    span = (F.max(ts) - F.min(ts)) / F.lit(1e6)
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), span.alias("seconds")).withColumn("ops_per_sec", F.try_divide("n", "seconds"))


def records_per_range(ranges: DataFrame, by: Sequence[str]) -> DataFrame:
    """Average records per range query (A6, A10) from (records) rows."""
    return ranges.groupBy(*by).agg(F.try_divide(F.sum("records"), F.count(F.lit(1))).alias("avg_records_per_range"))


def saturation(rates: DataFrame) -> DataFrame:
    """Highest throughput of a workload and the concurrency that reached it, the lowest if several."""
    best = F.max(F.struct("ops_per_sec", (-F.col("concurrency")).alias("c")))
    return rates.groupBy("workload").agg(best.alias("_b")).select(
        "workload", F.col("_b.ops_per_sec").alias("max_throughput"), (-F.col("_b.c")).alias("max_concurrency")
    )


def memory_report(samples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """min, max, whole-number average, sum, last and growth per second of ``rss_kb`` over ``elapsed_secs``."""
    first, last = F.min_by("rss_kb", "elapsed_secs"), F.max_by("rss_kb", "elapsed_secs")
    span = F.max("elapsed_secs") - F.min("elapsed_secs")
    growth = F.when(span > 0, (last - first) / F.nullif(span, F.lit(0.0))).otherwise(F.lit(0.0))
    out = samples.groupBy(*by).agg(
        F.min("rss_kb").alias("rss_min"), F.max("rss_kb").alias("rss_max"), F.expr("sum(rss_kb) div count(rss_kb)").alias("rss_avg"),
        F.sum("rss_kb").alias("rss_sum"), last.alias("rss_last"), growth.alias("growth"), F.count(F.lit(1)).alias("n"),
    )
    return out.where("n > 0")


def downsample(samples: DataFrame, order: str, by: Sequence[str], rows: int = 20) -> DataFrame:
    """Every k-th row of a group, k = n // rows or 1, and its last; ``i`` is the place in the group."""
    w = Window.partitionBy(*by).orderBy(order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    placed = samples.withColumn("i", F.row_number().over(w) - 1).withColumn("_n", n)
    every = F.greatest(F.lit(1), F.floor(F.col("_n") / rows).cast("int"))
    return placed.where((F.col("i") % every == 0) | (F.col("i") == F.col("_n") - 1)).drop("_n")


def run_delta(samples: DataFrame, order: str, by: Sequence[str], value: str) -> DataFrame:
    """Difference to the row before in the group; 0 for the first."""
    return samples.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(Window.partitionBy(*by).orderBy(order)), F.col(value)))


def band_join(left: DataFrame, right: DataFrame, left_t: str, right_t: str, width: float, take: Sequence[str]) -> DataFrame:
    """Each left row with the first right row, in ``right_t`` order, less than ``width`` away; nulls if none.

    Times are cut into bins of ``width``; a right row goes to its bin and both neighbours, so the join
    is one of equal bins with the band as residual, not a comparison of all with all.
    """
    l = left.withColumn("_id", F.monotonically_increasing_id()).withColumn("_bin", F.floor(F.col(left_t) / F.lit(width)))
    r = right.select(F.col(right_t).alias("_rt"), F.struct(*take).alias("_take"), F.floor(F.col(right_t) / F.lit(width)).alias("_b"))
    r = r.withColumn("_bin", F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1))).drop("_b")
    pairs = l.join(r, (l["_bin"] == r["_bin"]) & (F.abs(l[left_t] - F.col("_rt")) < width), "left").drop("_bin")
    rest = [c for c in left.columns]
    found = pairs.groupBy("_id", *rest).agg(F.min_by("_take", "_rt").alias("_m"))
    return found.select(*rest, *(F.col(f"_m.{c}").alias(c) for c in take))


def metrics_snapshot(counters: DataFrame, latencies: DataFrame) -> DataFrame:
    """One row of nested counters and latency summaries, with its JSON text."""
    names = F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "total")))).alias("counters")
    lat = F.array_sort(F.collect_list(F.struct("workload", "min", "p50", "p90", "p95", "p99", "p99_9", "max", "mean", "stddev", "n"))).alias("latencies")
    both = counters.agg(names).crossJoin(latencies.agg(lat))  # one row each
    return both.withColumn("json", F.to_json(F.struct("counters", "latencies")))
