"""Baseline against target: fields, changes, regressions, goals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import HIGHER, LOWER, NEUTRAL, delta_pct, goal_met, regressed

#: Order of workloads in reports, compared fields, and the short list of them.
WORKLOADS = ("write", "read", "mixed", "tail", "bulk")
THROUGHPUT_FIELDS = {
    "inserts/s": ("insert_ops_per_sec", HIGHER),
    "ranges/s": ("range_ops_per_sec", HIGHER),
    "records/range": ("avg_records_per_range", HIGHER),
    "SSTs": ("sstable_count", NEUTRAL),
}
LATENCY_MARKS = ("min", "p50", "p90", "p99", "max")
CORE_FIELDS = ("inserts/s", "ranges/s", "insert_latency p50", "insert_latency p99", "range_latency p50", "range_latency p99")
MEMORY_FIELDS = {
    "mem_rss_min_kb": ("rss_min", LOWER),
    "mem_rss_max_kb": ("rss_max", LOWER),
    "mem_rss_avg_kb": ("rss_avg", LOWER),
    "mem_rss_sum_kb": ("rss_sum", LOWER),
    "mem_rss_end_kb": ("rss_last", LOWER),
    "mem_growth_kbs": ("growth", LOWER),
    "mem_sample_size": ("n", NEUTRAL),
}


def workload_rank(workload: Column | str = "workload") -> Column:
    """Place of a workload in reports."""
    out = F.lit(len(WORKLOADS))
    for i, w in reversed(list(enumerate(WORKLOADS))):
        out = F.when(F.lower(workload) == w, i).otherwise(out)
    return out


def latest_runs(runs: DataFrame, order: str = "run_no") -> DataFrame:
    """One run per (workload, concurrency): the last."""
    rest = [c for c in runs.columns if c not in ("workload", "concurrency")]
    last = F.max_by(F.struct(*rest), order)
    return runs.groupBy("workload", "concurrency").agg(last.alias("_r")).select("workload", "concurrency", *(F.col(f"_r.{c}").alias(c) for c in rest))


def changed(df: DataFrame) -> DataFrame:
    """(…, delta, delta_pct, is_new, regressed) from (prev, new, direction)."""
    return df.select(
        "*",
        (F.col("new") - F.col("prev")).alias("delta"),
        delta_pct("prev", "new").alias("delta_pct"),
        ((F.col("prev") == 0) & (F.col("new") != 0)).alias("is_new"),
        regressed("prev", "new", "direction").alias("regressed"),
    )


def _long(df: DataFrame, keys: list[str], fields: dict[str, tuple[str, str, str]]) -> DataFrame:
    """A row per field: {name: (prev expression, new expression, direction)}."""
    rows = F.array(
        *(F.struct(F.lit(n).alias("field"), F.expr(p).cast("double").alias("prev"), F.expr(q).cast("double").alias("new"), F.lit(w).alias("direction")) for n, (p, q, w) in fields.items())
    )
    return df.select(*keys, F.inline(rows))


def compare_runs(baseline: DataFrame, target: DataFrame) -> DataFrame:
    """Long form over the runs that both have: (workload, concurrency, field, prev, new, …)."""
    fields = {n: (f"b.{c}", f"t.{c}", w) for n, (c, w) in THROUGHPUT_FIELDS.items()}
    for kind in ("insert", "range"):
        fields |= {f"{kind}_latency {m}": (f"b.{kind}_latency.{m}", f"t.{kind}_latency.{m}", LOWER) for m in LATENCY_MARKS}
    both = baseline.alias("b").join(target.alias("t"), ["workload", "concurrency"])
    return changed(_long(both, ["workload", "concurrency"], fields))


def compare_many(baseline: DataFrame, targets: list[DataFrame]) -> DataFrame:
    """``compare_runs`` of each target, with ``target_idx`` (Z3)."""
    parts = [compare_runs(baseline, t).withColumn("target_idx", F.lit(i)) for i, t in enumerate(targets)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compare_saturation(baseline: DataFrame, target: DataFrame) -> DataFrame:
    """Throughput and concurrency at saturation, per workload that both have."""
    both = baseline.dropDuplicates(["workload"]).alias("b").join(target.dropDuplicates(["workload"]).alias("t"), "workload")
    fields = {"throughput": ("b.max_throughput", "t.max_throughput", HIGHER), "conc_peak": ("b.max_concurrency", "t.max_concurrency", HIGHER)}
    long = _long(both, ["workload"], fields).withColumn("field", F.concat(F.lit("sat_"), F.lower("workload"), F.lit("_"), "field"))
    return changed(long)


def compare_memory(baseline: DataFrame, target: DataFrame) -> DataFrame:
    """Two one-row memory reports (J9); empty if either is."""
    both = baseline.alias("b").crossJoin(target.alias("t"))
    return changed(_long(both, [], {n: (f"b.{c}", f"t.{c}", w) for n, (c, w) in MEMORY_FIELDS.items()}))


def compare_snapshots(baseline: DataFrame, target: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Two one-row metric snapshots, {column: direction} (J8); empty if either is."""
    both = baseline.alias("b").crossJoin(target.alias("t"))
    return changed(_long(both, [], {c: (f"b.{c}", f"t.{c}", w) for c, w in fields.items()}))


def regressions(*compared: DataFrame) -> DataFrame:
    """All regressed fields."""
    keep = ("field", "prev", "new", "delta", "delta_pct")
    out = None
    for c in compared:
        rows = c.where("regressed").select(*keep)
        out = rows if out is None else out.unionByName(rows)
    return out


def has_regression(*compared: DataFrame) -> bool:
    return not regressions(*compared).isEmpty()


def shown(compared: DataFrame, condensed: bool = False) -> DataFrame:
    """Without rows that are 0 on both sides; condensed, the core fields only (P17, P18), in report order."""
    rows = compared.where(~((F.col("prev") == 0) & (F.col("new") == 0)))
    if condensed:
        rows = rows.where(F.col("field").isin(*CORE_FIELDS))
    return rows.orderBy(workload_rank(), "concurrency", "field")


def with_goals(compared: DataFrame, goals: DataFrame) -> DataFrame:
    """Left lookup of (scope, metric) -> goal, with whether it is met."""
    g = goals.select(F.col("scope").alias("workload"), F.col("metric").alias("field"), "goal")
    return compared.join(g, ["workload", "field"], "left").withColumn("met", goal_met("new", "goal", "direction"))


def concurrency_sweep(workloads: DataFrame, low: int, high: int, step: int) -> DataFrame:
    """(workload, concurrency): from ``low`` to ``high``, by one after 1 and by ``step`` else."""
    steps, c = [], low
    while c <= high:
        steps.append(c)
        c += 1 if c == 1 else step
    return workloads.select("workload", F.explode(F.array(*map(F.lit, steps))).alias("concurrency"))


def next_run_id(names: DataFrame) -> Column:
    """One more than the highest numeric name."""
    return names.agg((F.coalesce(F.max(F.col("name").try_cast("int")), F.lit(0)) + 1).alias("next_id"))


