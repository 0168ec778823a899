import math
import statistics

import pytest
from pyspark.sql import functions as F

from tidelog.functions import columns as C
from tidelog.operators import compare, metrics
from tidelog.sources import runs
from tidelog.schema import RUN_SCHEMA


def test_latency_summary(spark):
    values = [3.9, -5.0, 4e9, 10.0, 20.0]
    df = spark.createDataFrame([("w", v) for v in values], "workload string, us double")
    r = metrics.latency_summary(df, ["workload"]).first()
    cut = [3, 0, 3_600_000_000, 10, 20]
    assert (r["min"], r["max"], r["p50"], r["n"]) == (0, 3_600_000_000, 10, 5)
    assert math.isclose(r["mean"], statistics.mean(cut)) and math.isclose(r["stddev"], statistics.pstdev(cut))
    assert metrics.latency_summary(df.limit(0), ["workload"]).count() == 0
    assert metrics.latency_summary(df, ["workload"], exact=False).first()["p50"] == 10


def test_counters_and_gauges(spark):
    df = spark.createDataFrame([("a", 0, "add", 5), ("a", 1, "set", 10), ("a", 2, "add", 3), ("a", 3, "sub", 1), ("b", 0, "sub", 2)], "name string, seq int, op string, amount long")
    got = {r["name"]: r["value"] for r in metrics.gauge(df, ["name"]).collect()}
    assert got == {"a": 12, "b": -2}
    assert metrics.counter(df, ["name"]).where("name = 'a'").first()["total"] == 19


def test_saturation_takes_the_lowest_of_equals(spark):
    df = spark.createDataFrame([("w", 1, 5.0), ("w", 4, 9.0), ("w", 2, 9.0)], "workload string, concurrency int, ops_per_sec double")
    assert tuple(metrics.saturation(df).first()) == ("w", 9.0, 2)


def test_memory(spark):
    rows = [(0.0, 100), (1.0, 105), (2.0, 101), (4.0, 120)]
    df = spark.createDataFrame(rows, "elapsed_secs double, rss_kb long")
    r = metrics.memory_report(df).first()
    assert tuple(r)[:6] == (100, 120, 106, 426, 120, 5.0)
    assert metrics.memory_report(df.limit(0)).count() == 0
    assert metrics.memory_report(df.limit(1)).first()["growth"] == 0.0


def test_downsample_and_delta(spark):
    df = spark.createDataFrame([("g", i, i * i) for i in range(45)], "g string, t int, v long")
    assert [r["i"] for r in metrics.downsample(df, "t", ["g"]).orderBy("i").collect()] == list(range(0, 45, 2))
    assert [r["delta"] for r in metrics.run_delta(df, "t", ["g"], "v").orderBy("t").limit(3).collect()] == [0, 1, 3]


def test_band_join_is_first_within(spark):
    left = spark.createDataFrame([(1, 0.0), (2, 10.0), (3, 99.0), (4, 0.5)], "id int, t double")
    right = spark.createDataFrame([(0.3, 7), (0.4, 8), (10.49, 9), (10.5, 10)], "u double, m int")
    got = {r["id"]: r["m"] for r in metrics.band_join(left, right, "t", "u", 0.5, ["m"]).collect()}
    assert got == {1: 7, 2: 9, 3: None, 4: 7}


def test_change_rules(spark):
    rows = [(100.0, 94.0, "higher"), (100.0, 95.0, "higher"), (100.0, 121.0, "lower"), (100.0, 120.0, "lower"), (0.0, 1.0, "lower"), (0.0, 0.0, "lower"), (1.0, 9.0, "neutral")]
    df = compare.changed(spark.createDataFrame(rows, "prev double, new double, direction string"))
    assert [r["regressed"] for r in df.collect()] == [True, False, True, False, True, False, False]
    assert [r["delta_pct"] for r in df.collect()][4:6] == [None, 0.0]
    tol = spark.createDataFrame([("range_per_second", 10.0, 20.0), ("insert_latency_p50", 100.0, 112.0), ("insert_latency_p50", 100.0, 113.0), ("range_per_second", 100.0, 95.0)], "m string, p double, n double")
    assert [r[0] for r in tol.select(C.regressed_beyond("m", "p", "n", 3.0)).collect()] == [False, False, True, True]
    assert tol.select(C.regressed_beyond("m", "p", "n", 3.0, as_coded=True)).first()[0]


def _run(spark, rate, p50, workload="write", concurrency=1):
    lat = {"min": 1, "p50": p50, "p90": 3, "p95": 4, "p99": 5, "p99_9": 6, "max": 7, "mean": 2.0, "stddev": 1.0, "sample_count": 9}
    return spark.createDataFrame([(workload, concurrency, rate, 1.0, 2.0, 3, lat, lat)], RUN_SCHEMA)


def test_compare_runs(spark):
    base, worse = _run(spark, 100.0, 10), _run(spark, 80.0, 20)
    found = compare.compare_runs(base, worse)
    assert found.count() == 14
    assert {r["field"] for r in compare.regressions(found).collect()} == {"inserts/s", "insert_latency p50", "range_latency p50"}
    assert compare.has_regression(found) and not compare.has_regression(compare.compare_runs(base, base))
    assert compare.compare_runs(base, _run(spark, 1.0, 1, "read")).count() == 0
    assert compare.compare_many(base, [worse, base]).select("target_idx").distinct().count() == 2
    both = base.withColumn("run_no", F.lit(0)).unionByName(worse.withColumn("run_no", F.lit(1)))
    assert compare.latest_runs(both).first()["insert_ops_per_sec"] == 80.0
    goals = runs.goals(spark, '[write]\n"inserts/s" = 90\n')
    met = {r["field"]: r["met"] for r in compare.with_goals(found, goals).where("goal is not null").collect()}
    assert met == {"inserts/s": False}
    assert runs.goals(spark, None).count() == 0
    assert compare.shown(found, condensed=True).count() == 6
    memory = metrics.memory_report(spark.createDataFrame([(0.0, 1), (1.0, 2)], "elapsed_secs double, rss_kb long"))
    assert compare.compare_memory(memory, memory).where("delta = 0").count() == 7
    sat = spark.createDataFrame([("w", 5.0, 2)], "workload string, max_throughput double, max_concurrency int")
    assert sorted(r["field"] for r in compare.compare_saturation(sat, sat).collect()) == ["sat_w_conc_peak", "sat_w_throughput"]
    assert compare.compare_snapshots(memory, memory.limit(0), {"rss_max": "lower"}).count() == 0


def test_run_files(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"results": [{"workload": "write", "concurrency": 4, "insert_ops_per_sec": 5.5, "insert_latency": {"p50": 3}}]}')
    (tmp_path / "empty.json").write_text("")
    r = runs.read_results(spark, str(tmp_path / "r.json")).first()
    assert (r["run_no"], r["workload"], r["concurrency"], r["insert_latency"]["p50"]) == (0, "write", 4, 3)
    assert runs.read_results(spark, str(tmp_path / "empty.json")).count() == 0
    files = spark.createDataFrame([("a/r1/meta.json",), ("a/r1/result.json",), ("a/r1/mem.json",), ("a/r1/x.log",), ("a/r1/flame.svg",), ("a/r1/z",)], "path string")
    assert [r["kind"] for r in runs.classify_run_files(files).collect()] == ["meta", "result", "mem", "log", "prof", "other"]
    names = spark.createDataFrame([("3",), ("x",), ("12",)], "name string")
    assert compare.next_run_id(names).first()[0] == 13 and runs.run_folder("2024", "fast") == "2024__fast"


def test_texts(spark):
    df = spark.createDataFrame([(1, "Write", 2.5, -1500.0, "x")], "c int, w string, pct double, us double, t string")
    r = df.select(C.context_text("w", "c"), C.percent_text("pct"), C.latency_text("us"), C.percent_text(F.lit(None).cast("double")), C.set_name(F.lit(7))).first()
    assert tuple(r) == ("write, 1 client", "+2.5%", "-1.50ms", "  N/A", "0" * 19 + "7")
    assert spark.range(1).select(C.timestamp_literal(F.lit("rubbish"))).first()[0] is None
    assert spark.range(1).select(C.payload_text(F.lit(bytearray(b"\xff\xfe"))), C.payload_text(F.lit(bytearray(b"ok")))).first()[:] == ("ERR:", "ok")
    snapshot = metrics.metrics_snapshot(
        spark.createDataFrame([("a", 1)], "name string, total long"),
        metrics.latency_summary(spark.createDataFrame([("w", 1.0)], "workload string, us double"), ["workload"]),
    ).first()
    assert '"a":1' in snapshot["json"]


@pytest.mark.parametrize(("low", "high", "step", "want"), [(1, 7, 2, [1, 2, 4, 6]), (2, 6, 3, [2, 5]), (3, 2, 1, [])])
def test_sweep(spark, low, high, step, want):
    df = spark.createDataFrame([("w",)], "workload string")
    assert [r["concurrency"] for r in compare.concurrency_sweep(df, low, high, step).collect()] == want
