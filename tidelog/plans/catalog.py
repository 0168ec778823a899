"""Registered queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import compare, metrics, series, streams, validation
from ..sources import adapters, frames, journal, sorted_files
from ..sources.store import LogStore, file_stats, fold_changes, merge_snapshots, oldest_sets
from ..streaming import ingest as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

JAN_5, JAN_19 = 1_704_412_800_000_000, 1_705_622_400_000_000
DAY = 86_400_000_000

#: Events as log rows, in SQL.
_LOGS = """logs AS (SELECT user_id AS source_id, epoch_us(ts) AS ts, event_id AS seq, event_type AS key, props AS value,
    'event_type=' || event_type || ',shard=' || (user_id % 4) AS labels_txt FROM events)"""
_REGISTRY = """first_seen AS (SELECT labels_txt, min(seq) AS first_seq FROM logs GROUP BY labels_txt),
    registry AS (SELECT row_number() OVER (ORDER BY first_seq, labels_txt) - 1 AS stream_id, labels_txt, first_seq FROM first_seen)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.logs(spark, sf_dir, "events")


def _work_folder(spark: SparkSession, label: str) -> str:
    """A folder all executors see, in the cluster's shared one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _rounded(name: str):
    """Six digits; the little that is added keeps halves, which means have, from going either way."""
    return F.round(F.col(name) + 1e-9, 6).alias(name)


# ---- keyed series


@query(f"WITH {_LOGS} SELECT source_id, ts, seq, key, value FROM logs WHERE source_id = 7 AND key = 'click' AND ts >= {JAN_5} AND ts < {JAN_19}")
def g1_range(spark, sf_dir):
    return series.range_scan(_events(spark, sf_dir), 7, "click", JAN_5, JAN_19, raw="at").select("source_id", "ts", "seq", "key", "value")


@query(f"WITH {_LOGS} SELECT source_id, ts, seq, key, value FROM logs WHERE source_id = 7 AND key = 'click' AND ts >= {JAN_5} AND ts < {JAN_19} AND contains(value, '5')")
def g1_range_filter(spark, sf_dir):
    return series.range_scan(_events(spark, sf_dir), 7, "click", JAN_5, JAN_19, "5", raw="at").select("source_id", "ts", "seq", "key", "value")


@query(f"""WITH {_LOGS}, one AS (SELECT * FROM logs WHERE source_id = 3 AND key = 'view')
    SELECT source_id, ts, seq, key, value FROM one WHERE ts >= (SELECT min(ts) FROM one) AND ts < (SELECT max(ts) FROM one)""")
def g1_range_edges(spark, sf_dir):
    logs = _events(spark, sf_dir)
    lo, hi = logs.where("source_id = 3 and key = 'view'").agg(F.min("ts"), F.max("ts")).first()
    return series.range_scan(logs, 3, "view", lo, hi, raw="at").select("source_id", "ts", "seq", "key", "value")


@query(f"""WITH {_LOGS}, req AS (SELECT i AS req_id, i % 15 AS source_id, ['click','view','error','signup','purchase'][1 + i % 5] AS key,
    1704067200000000 + i * 21600000000 AS start_ts, 1704067200000000 + i * 21600000000 + 864000000000 AS end_ts,
    CASE WHEN i % 3 = 0 THEN '1' ELSE '' END AS f FROM range(24) t(i))
    SELECT req_id, l.source_id, l.ts, l.seq FROM logs l JOIN req r ON l.source_id = r.source_id AND l.key = r.key
    AND l.ts >= r.start_ts AND l.ts < r.end_ts AND (f = '' OR contains(l.value, f))""")
def g1_multi_range(spark, sf_dir):
    i = F.col("id")
    kinds = F.array(*map(F.lit, ("click", "view", "error", "signup", "purchase")))
    start = F.lit(1_704_067_200_000_000) + i * 21_600_000_000
    requests = spark.range(24).select(
        i.alias("req_id"), (i % 15).alias("source_id"), F.get(kinds, (i % 5).cast("int")).alias("key"), start.alias("start_ts"),
        (start + 864_000_000_000).alias("end_ts"), F.when(i % 3 == 0, "1").otherwise("").alias("contains"),
    )
    return series.multi_range(_events(spark, sf_dir).select("source_id", "ts", "seq", "key", "value"), requests).select("req_id", "source_id", "ts", "seq")


@query(f"WITH {_LOGS}, now AS (SELECT max(ts) AS t FROM logs) SELECT source_id, key, count(*) AS n FROM logs, now WHERE ts >= greatest(t - {DAY}, 0) AND ts < t GROUP BY 1, 2")
def g1_tail(spark, sf_dir):
    return series.tail(_events(spark, sf_dir), DAY).groupBy("source_id", "key").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LOGS} SELECT source_id, ts, seq, key, value FROM logs")
def g1_merge_dedup(spark, sf_dir):
    logs = _events(spark, sf_dir).select("source_id", "ts", "seq", "key", "value")
    tiers = [logs.where(F.col("seq") % 3 != i) for i in range(3)]
    return series.merge_tiers(*tiers)


@query(f"WITH {_LOGS} SELECT source_id, key, max(seq) AS seq, arg_max(value, seq) AS value FROM logs GROUP BY 1, 2")
def g1_latest_point(spark, sf_dir):
    return series.latest_point(_events(spark, sf_dir).select("source_id", "key", "seq", "value"), by=("source_id", "key"))


@query("SELECT max(event_id) + 1 AS next_seq FROM events")
def g1_next_seq(spark, sf_dir):
    return spark.range(1).select(F.lit(series.next_sequence(_events(spark, sf_dir))).cast("long").alias("next_seq"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 + 1000 AS seq FROM orders")
def g1_assign_seq(spark, sf_dir):
    return series.assign_sequence(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), "o_orderkey", 1000, slices=8)


# ---- label streams


def _registry(spark, sf_dir):
    logs = _events(spark, sf_dir)
    return logs, streams.build_registry(logs)


def _placed(spark, sf_dir):
    logs, registry = _registry(spark, sf_dir)
    return streams.resolve_streams(logs, registry), registry


@query(f"WITH {_LOGS}, {_REGISTRY} SELECT stream_id, labels_txt, first_seq FROM registry")
def g2_registry(spark, sf_dir):
    return _registry(spark, sf_dir)[1].select("stream_id", C.labels_text("labels").alias("labels_txt"), "first_seq")


@query(f"""WITH {_LOGS}, {_REGISTRY}, pairs AS (SELECT stream_id, unnest(string_split(labels_txt, ',')) AS kv FROM registry)
    SELECT split_part(kv, '=', 1) AS label_key, split_part(kv, '=', 2) AS label_value, count(*) AS n_streams,
    string_agg(stream_id::VARCHAR, ',' ORDER BY stream_id) AS stream_ids FROM pairs GROUP BY 1, 2""")
def g2_inverted_index(spark, sf_dir):
    found = streams.inverted_index(_registry(spark, sf_dir)[1])
    return found.select("label_key", "label_value", "n_streams", F.array_join(F.col("streams").cast("array<string>"), ",").alias("stream_ids"))


@query(f"WITH {_LOGS}, {_REGISTRY} SELECT stream_id, labels_txt FROM registry WHERE labels_txt = 'event_type=click,shard=1'")
def g2_match(spark, sf_dir):
    found = streams.match_streams(_registry(spark, sf_dir)[1], {"event_type": "click", "shard": "1"})
    return found.select("stream_id", C.labels_text("labels").alias("labels_txt"))


@query("SELECT 0 AS n")
def g2_match_unknown_strict(spark, sf_dir):
    return streams.match_streams(_registry(spark, sf_dir)[1], {"event_type": "click", "zone": "x"}).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LOGS} SELECT count(DISTINCT labels_txt) AS n FROM logs WHERE key = 'click'")
def g2_match_unknown_lenient(spark, sf_dir):
    return streams.match_streams(_registry(spark, sf_dir)[1], {"event_type": "click", "zone": "x"}, strict=False).agg(F.count(F.lit(1)).alias("n"))


_RANGE = f"""WITH {_LOGS}, {_REGISTRY} SELECT stream_id, labels_txt, ts, seq, source_id, value AS body FROM logs JOIN registry USING (labels_txt)
    WHERE {{where}}"""


def _label_range(spark, sf_dir, labels, start, end):
    placed, registry = _placed(spark, sf_dir)
    found = streams.label_range(placed, registry, labels, start, end, raw="at")
    return found.select("stream_id", C.labels_text("labels").alias("labels_txt"), "ts", "seq", "source_id", F.col("value").alias("body"))


@query(_RANGE.format(where=f"labels_txt = 'event_type=view,shard=2' AND ts BETWEEN {JAN_5} AND {JAN_19}"))
def g2_label_range(spark, sf_dir):
    return _label_range(spark, sf_dir, {"event_type": "view", "shard": "2"}, JAN_5, JAN_19)


@query(_RANGE.format(where=f"labels_txt LIKE '%shard=3' AND ts >= {JAN_19}"))
def g2_label_range_from(spark, sf_dir):
    return _label_range(spark, sf_dir, {"shard": "3"}, JAN_19, None)


@query(_RANGE.format(where=f"labels_txt LIKE 'event_type=error,%' AND ts <= {JAN_5}"))
def g2_label_range_until(spark, sf_dir):
    return _label_range(spark, sf_dir, {"event_type": "error"}, None, JAN_5)


@query(f"WITH {_LOGS}, {_REGISTRY} SELECT stream_id, count(*) AS n FROM logs JOIN registry USING (labels_txt) WHERE stream_id % 3 = 0 GROUP BY 1")
def g2_orphans(spark, sf_dir):
    placed, registry = _placed(spark, sf_dir)
    found = streams.attach_labels(placed.drop("labels"), registry.where("stream_id % 3 != 0"))
    return found.where("labels is null").groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_LOGS}, {_REGISTRY} SELECT 'event_type' AS label_key, count(DISTINCT key) AS n_values, (SELECT count(*) FROM registry) AS n_streams, count(*) AS n_records FROM logs
    UNION ALL SELECT 'shard', count(DISTINCT source_id % 4), (SELECT count(*) FROM registry), count(*) FROM logs""")
def g2_cardinality(spark, sf_dir):
    return streams.cardinality(*_placed(spark, sf_dir))


# ---- validation and storage


@query("""SELECT CASE WHEN text IS NULL OR strlen(text) < 2 THEN 'too_small' WHEN strlen(text) > 4096 THEN 'too_large' ELSE 'accepted' END AS status,
    count(*) AS n FROM documents GROUP BY 1""")
def v_payload_limits(spark, sf_dir):
    docs = adapters.logs(spark, sf_dir, "documents")
    return docs.select(validation.payload_status("value").alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN doc_id % 5 = 0 THEN 'bad_label' WHEN doc_id % 5 = 1 THEN 'no_labels' WHEN doc_id % 5 = 2 THEN 'too_many' ELSE 'accepted' END AS status,
    count(*) AS n FROM documents GROUP BY 1""")
def v_label_limits(spark, sf_dir):
    docs = adapters.logs(spark, sf_dir, "documents")
    kind = F.col("seq") % 5
    many = F.map_from_entries(F.transform(F.sequence(F.lit(1), F.lit(256)), lambda i: F.struct(i.cast("string"), F.lit("v"))))
    long = F.create_map(F.lit("k"), F.repeat(F.lit("x"), 256))
    labels = F.when(kind == 0, long).when(kind == 1, F.create_map().cast("map<string,string>")).when(kind == 2, many).otherwise(F.col("labels"))
    return docs.select(validation.label_status(labels).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, strftime(ts, '%Y-%m-%d') >= '2024-01-16' AS keep FROM events GROUP BY 1, 3")
def st_day_layout(spark, sf_dir):
    days = _events(spark, sf_dir).groupBy(C.day_of("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.withColumn("keep", F.col("day") >= "2024-01-16")


def _changes(spark, sf_dir):
    """A change log made of events: flushes, and compactions of the three sets before."""
    e = _events(spark, sf_dir).select("seq", "ts")
    compaction = F.col("seq") % 4 == 3
    none = F.lit(None).cast("long")
    return e.select(
        F.col("seq").alias("op_seq"), F.when(compaction, "compaction").otherwise("flush").alias("kind"), F.col("seq").alias("set_id"),
        F.when(compaction, F.array(F.col("seq") - 3, F.col("seq") - 2)).alias("removed"), none.alias("stream_id"),
        F.col("ts").alias("min_ts"), F.col("ts").alias("max_ts"), F.lit(1).cast("long").alias("n"), F.col("seq").alias("max_seq"),
    )


_FOLD = """(SELECT event_id AS set_id, CASE WHEN event_id % 4 < 2 AND event_id + 3 - event_id % 4 <= (SELECT max(event_id) FROM events) THEN 'removed' ELSE 'live' END AS state FROM events)"""


@query(f"SELECT set_id, state FROM {_FOLD}")
def st_snapshot_fold(spark, sf_dir):
    return fold_changes(_changes(spark, sf_dir)).select("set_id", "state")


@query(f"""WITH f AS {_FOLD}, old AS (SELECT set_id FROM f WHERE state = 'live' AND set_id < 600),
    new AS (SELECT set_id, CASE WHEN set_id % 7 = 0 THEN 'removed' ELSE state END AS state FROM f WHERE set_id >= 500)
    SELECT coalesce(old.set_id, new.set_id) AS set_id, 'live' AS state FROM old FULL JOIN new ON old.set_id = new.set_id
    WHERE coalesce(new.state, 'live') = 'live'""")
def st_snapshot_merge(spark, sf_dir):
    f = fold_changes(_changes(spark, sf_dir)).select("set_id", "state")
    newer = f.where("set_id >= 500").withColumn("state", F.when(F.col("set_id") % 7 == 0, "removed").otherwise(F.col("state")))
    return merge_snapshots(f.where("set_id < 600"), newer)


@query("""WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS set_id, count(*) AS n FROM events GROUP BY 1)
    SELECT set_id, n FROM d WHERE set_id NOT IN ('2024-01-02', '2024-01-04') ORDER BY set_id LIMIT 4""")
def st_compaction_pick(spark, sf_dir):
    """The oldest four sets that are not being compacted."""
    days = _events(spark, sf_dir).groupBy(C.day_of("ts").alias("set_id")).agg(F.count(F.lit(1)).alias("n"))
    busy = spark.createDataFrame([("2024-01-02",), ("2024-01-04",)], "set_id string")
    return oldest_sets(days, 4, busy)


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, min(epoch_us(ts)) AS min_ts, max(epoch_us(ts)) AS max_ts, count(*) AS n FROM events GROUP BY 1")
def st_file_stats(spark, sf_dir):
    return file_stats(_events(spark, sf_dir), C.day_of("ts").alias("day")).drop("max_seq")


@query("""WITH r AS (SELECT user_id, strlen(props) + 48 AS size, coalesce(sum(strlen(props) + 48) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events)
    SELECT user_id AS source_id, (before // 1024)::BIGINT AS bucket, count(*) AS n, sum(size)::BIGINT AS bytes FROM r GROUP BY 1, 2""")
def st_freeze_windows(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("size", F.octet_length("value") + 48)
    placed = streaming.freeze_windows(rows, 1024, "source_id", "seq", "size")
    return placed.groupBy("source_id", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").cast("long").alias("bytes"))


# ---- metrics

_QUANTILES = ", ".join(f"quantile_disc(us, {q}) AS {n}" for n, q in metrics.QUANTILES.items())
_LAT = "trunc(least(3.6e9, greatest(0.0, value * 1000)))::BIGINT"


@query(f"""SELECT workload, min(us) AS min, {_QUANTILES}, max(us) AS max, round(avg(us) + 1e-9, 6) AS mean, round(stddev_pop(us) + 1e-9, 6) AS stddev, count(*) AS n
    FROM (SELECT event_type AS workload, {_LAT} AS us FROM events) GROUP BY 1""")
def m_latency(spark, sf_dir):
    samples = _events(spark, sf_dir).select(F.col("key").alias("workload"), (F.col("measure") * 1000).alias("us"))
    found = metrics.latency_summary(samples, ["workload"])
    return found.withColumn("mean", _rounded("mean")).withColumn("stddev", _rounded("stddev"))


_RATES = """SELECT event_type AS workload, user_id % 4 + 1 AS concurrency, count(*) AS n, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS seconds FROM events GROUP BY 1, 2"""


def _rates(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.col("key").alias("workload"), (F.col("source_id") % 4 + 1).alias("concurrency"), "ts")
    return metrics.throughput(rows, ["workload", "concurrency"])


@query(f"SELECT workload, concurrency, round(n / nullif(seconds, 0), 9) AS ops_per_sec FROM ({_RATES})")
def m_throughput(spark, sf_dir):
    return _rates(spark, sf_dir).select("workload", "concurrency", F.round("ops_per_sec", 9).alias("ops_per_sec"))


@query(f"""WITH r AS (SELECT workload, concurrency, n / nullif(seconds, 0) AS t FROM ({_RATES}))
    SELECT workload, round(max(t), 9) AS max_throughput, arg_max(concurrency, struct_pack(t := t, c := -concurrency)) AS max_concurrency FROM r GROUP BY 1""")
def m_saturation(spark, sf_dir):
    return metrics.saturation(_rates(spark, sf_dir)).withColumn("max_throughput", F.round("max_throughput", 9))


_WORKLOAD_OF = {"click": "write", "view": "read", "purchase": "mixed", "signup": "tail", "error": "bulk"}
_HALF_SECONDS = 15 * 86400
_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _WORKLOAD_OF.items()) + " END"


def _runs(spark, sf_dir, first_half: bool):
    """Runs made of half a month of events, a run per (workload, concurrency)."""
    e = _events(spark, sf_dir)
    e = e.where(F.col("ts") < JAN_5 + 11 * DAY if first_half else F.col("ts") >= JAN_5 + 11 * DAY)
    name = F.create_map(*[F.lit(x) for kv in _WORKLOAD_OF.items() for x in kv])[F.col("key")]
    rows = e.select(name.alias("workload"), (F.col("source_id") % 4 + 1).cast("int").alias("concurrency"), (F.col("measure") * 1000).alias("us"), "measure", "ts")
    lat = metrics.latency_summary(rows, ["workload", "concurrency"])
    summary = F.struct(*(F.col(c) for c in ("min", "p50", "p90", "p95", "p99", "p99_9", "max", "mean", "stddev")), F.col("n").alias("sample_count"))
    tail = metrics.latency_summary(rows.where("measure > 50"), ["workload", "concurrency"]).select("workload", "concurrency", summary.alias("range_latency"))
    ops = rows.groupBy("workload", "concurrency").agg(
        (F.count(F.lit(1)) / F.lit(float(_HALF_SECONDS))).alias("insert_ops_per_sec"),
        (F.sum((F.col("measure") > 50).cast("int")) / F.lit(float(_HALF_SECONDS))).alias("range_ops_per_sec"),
        F.avg("measure").alias("avg_records_per_range"),
        F.count_distinct(C.day_of("ts")).alias("sstable_count"),
    )
    insert = lat.select("workload", "concurrency", summary.alias("insert_latency"))
    return ops.join(insert, ["workload", "concurrency"]).join(tail, ["workload", "concurrency"])


_MARKS = {"min": "min(us)", "p50": "quantile_disc(us, 0.5)", "p90": "quantile_disc(us, 0.9)", "p99": "quantile_disc(us, 0.99)", "max": "max(us)"}
_RUN_FIELDS = (
    [("inserts/s", f"count(*) / {_HALF_SECONDS}.0", "higher"), ("ranges/s", f"sum((value > 50)::INT) / {_HALF_SECONDS}.0", "higher"),
     ("records/range", "avg(value)", "higher"), ("SSTs", "count(DISTINCT strftime(ts, '%Y-%m-%d'))", "neutral")]
    + [(f"insert_latency {m}", s, "lower") for m, s in _MARKS.items()]
    + [(f"range_latency {m}", s.replace("us", "CASE WHEN value > 50 THEN us END"), "lower") for m, s in _MARKS.items()]
)
_GROUPED = ", ".join(f"({s})::DOUBLE" for _, s, _ in _RUN_FIELDS)
_NAMES = ", ".join(f"'{n}'" for n, _, _ in _RUN_FIELDS)
_WAYS = ", ".join(f"'{w}'" for _, _, w in _RUN_FIELDS)
_COMPARE = f"""e AS (SELECT {_CASE} AS workload, user_id % 4 + 1 AS concurrency, {_LAT} AS us, value, ts, epoch_us(ts) < {JAN_5 + 11 * DAY} AS first FROM events),
    wide AS MATERIALIZED (SELECT workload, concurrency, first, [{_GROUPED}] AS vs FROM e GROUP BY workload, concurrency, first),
    long AS MATERIALIZED (SELECT workload, concurrency, first, unnest([{_NAMES}]) AS field, unnest([{_WAYS}]) AS way, unnest(vs) AS v FROM wide),
    cmp AS (SELECT b.workload, b.concurrency, b.field, b.way, b.v AS prev, t.v AS new FROM long b JOIN long t ON b.workload = t.workload AND b.concurrency = t.concurrency AND b.field = t.field WHERE b.first AND NOT t.first),
    pct AS (SELECT *, CASE WHEN prev <> 0 THEN (new - prev) / abs(prev) * 100 WHEN new = prev THEN 0.0 END AS p FROM cmp)"""


def _compared(spark, sf_dir):
    return compare.compare_runs(_runs(spark, sf_dir, True), _runs(spark, sf_dir, False))


@query(f"""WITH {_COMPARE} SELECT workload, concurrency, field, round(prev + 1e-9, 6) AS prev, round(new + 1e-9, 6) AS new, round(new - prev + 1e-9, 6) AS delta, round(p + 1e-9, 6) AS delta_pct,
    CASE way WHEN 'higher' THEN coalesce(p < -5, false) WHEN 'lower' THEN coalesce(p > 20, prev = 0 AND new > 0) ELSE false END AS regressed FROM pct""")
def m_compare(spark, sf_dir):
    return _compared(spark, sf_dir).select("workload", "concurrency", "field", *(_rounded(c) for c in ("prev", "new", "delta", "delta_pct")), "regressed")


@query(f"""WITH {_COMPARE} SELECT field, count(*) AS n FROM pct WHERE
    CASE way WHEN 'higher' THEN coalesce(p < -5, false) WHEN 'lower' THEN coalesce(p > 20, prev = 0 AND new > 0) ELSE false END GROUP BY 1""")
def m_regressions(spark, sf_dir):
    return compare.regressions(_compared(spark, sf_dir)).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_COMPARE} SELECT workload, concurrency, field FROM pct WHERE field IN ('inserts/s', 'ranges/s', 'insert_latency p50', 'insert_latency p99', 'range_latency p50', 'range_latency p99')
    AND NOT (prev = 0 AND new = 0)""")
def m_compare_core(spark, sf_dir):
    return compare.shown(_compared(spark, sf_dir), condensed=True).select("workload", "concurrency", "field")


_TOLERANCE = " ".join(f"WHEN '{m}' THEN {t}" for m, (t, _) in C.TOLERANCE.items())
_HIGHER = ", ".join(f"'{m}'" for m, (_, w) in C.TOLERANCE.items() if w == C.HIGHER)
_METRIC_OF = {"inserts/s": "insert_per_second", "ranges/s": "range_per_second", "insert_latency p50": "insert_latency_p50", "range_latency p50": "range_latency_p50", "insert_latency p99": "insert_latency_p99", "range_latency p99": "range_latency_p99"}
_METRIC_CASE = "CASE field " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _METRIC_OF.items()) + " END"


@query(f"""WITH {_COMPARE}, m AS (SELECT *, {_METRIC_CASE} AS metric FROM pct), k AS (SELECT *, 3.0 * CASE metric {_TOLERANCE} END AS allowed FROM m WHERE metric IS NOT NULL)
    SELECT workload, concurrency, metric, round(p, 6) AS delta_pct,
    CASE WHEN metric IN ({_HIGHER}) THEN coalesce(p < -allowed, false) ELSE coalesce(p > allowed, prev = 0 AND new > 0) END AS regressed FROM k""")
def m_regression_tol(spark, sf_dir):
    name = F.create_map(*[F.lit(x) for kv in _METRIC_OF.items() for x in kv])[F.col("field")]
    rows = _compared(spark, sf_dir).withColumn("metric", name).where("metric is not null")
    return rows.select("workload", "concurrency", "metric", F.round("delta_pct", 6).alias("delta_pct"), C.regressed_beyond("metric", "prev", "new", 3.0).alias("regressed"))


@query(f"""WITH {_COMPARE} SELECT workload, concurrency, field, goal::DOUBLE AS goal, CASE way WHEN 'higher' THEN new >= goal WHEN 'lower' THEN new <= goal ELSE true END AS met
    FROM pct LEFT JOIN (VALUES ('write', 'inserts/s', 0.0001), ('read', 'insert_latency p99', 300000.0), ('bulk', 'SSTs', 3.0)) g(scope, metric, goal) ON workload = scope AND field = metric""")
def m_goals(spark, sf_dir):
    goals = spark.createDataFrame([("write", "inserts/s", 0.0001), ("read", "insert_latency p99", 300000.0), ("bulk", "SSTs", 3.0)], "scope string, metric string, goal double")
    return compare.with_goals(_compared(spark, sf_dir), goals).select("workload", "concurrency", "field", "goal", "met")


def _memory(spark, sf_dir):
    return _events(spark, sf_dir).select("source_id", ((F.col("ts") - 1_704_067_200_000_000) / F.lit(1e6)).alias("elapsed_secs"), (F.col("measure") * 100).cast("long").alias("rss_kb"))


_MEM = "SELECT user_id AS source_id, (epoch_us(ts) - 1704067200000000) / 1e6 AS t, trunc(value * 100)::BIGINT AS rss FROM events"


@query(f"""SELECT source_id, min(rss) AS rss_min, max(rss) AS rss_max, (sum(rss) // count(*))::BIGINT AS rss_avg, sum(rss)::BIGINT AS rss_sum, arg_max(rss, t) AS rss_last,
    CASE WHEN max(t) > min(t) THEN round((arg_max(rss, t) - arg_min(rss, t)) / (max(t) - min(t)), 9) ELSE 0.0 END AS growth, count(*) AS n FROM ({_MEM}) GROUP BY 1""")
def m_mem_report(spark, sf_dir):
    return metrics.memory_report(_memory(spark, sf_dir), ["source_id"]).withColumn("growth", F.round("growth", 9))


@query(f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY source_id) AS c FROM ({_MEM}))
    SELECT source_id, i, round(t, 6) AS t, rss AS v FROM m WHERE i % greatest(1, c // 20) = 0 OR i = c - 1""")
def m_downsample(spark, sf_dir):
    found = metrics.downsample(_memory(spark, sf_dir), "elapsed_secs", ["source_id"])
    return found.select("source_id", "i", F.round("elapsed_secs", 6).alias("t"), F.col("rss_kb").alias("v"))


@query(f"SELECT source_id, round(t, 6) AS t, rss - coalesce(lag(rss) OVER (PARTITION BY source_id ORDER BY t), rss) AS delta FROM ({_MEM})")
def m_run_delta(spark, sf_dir):
    found = metrics.run_delta(_memory(spark, sf_dir), "elapsed_secs", ["source_id"], "rss_kb")
    return found.select("source_id", F.round("elapsed_secs", 6).alias("t"), "delta")


@query("""WITH a AS (SELECT event_id AS id, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = 'click'), b AS (SELECT event_id AS m, epoch_us(ts) / 1e6 AS u FROM events WHERE event_type = 'view')
    SELECT id, arg_min(m, u) AS matched_id FROM a LEFT JOIN b ON abs(t - u) < 600 GROUP BY 1""")
def m_band_join(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("t", F.col("ts") / F.lit(1e6))
    left = e.where("key = 'click'").select(F.col("seq").alias("id"), "t")
    right = e.where("key = 'view'").select(F.col("seq").alias("matched_id"), F.col("t").alias("u"))
    return metrics.band_join(left, right, "t", "u", 600.0, ["matched_id"]).select("id", "matched_id")


@query("SELECT event_type AS name, sum(event_id)::BIGINT AS total, count(*) AS events FROM events GROUP BY 1")
def m_counter(spark, sf_dir):
    return metrics.counter(_events(spark, sf_dir).select(F.col("key").alias("name"), F.col("seq").alias("amount")), ["name"])


@query("""WITH c AS (SELECT user_id, event_id, CASE WHEN event_type = 'signup' THEN 'set' WHEN event_type = 'error' THEN 'sub' ELSE 'add' END AS op, event_id % 10 AS a FROM events),
    s AS (SELECT user_id, max(event_id) AS last, arg_max(a, event_id) AS base FROM c WHERE op = 'set' GROUP BY 1)
    SELECT c.user_id AS source_id, (coalesce(max(base), 0) + sum(CASE WHEN op <> 'set' AND (last IS NULL OR event_id > last) THEN CASE op WHEN 'add' THEN a ELSE -a END ELSE 0 END))::BIGINT AS value
    FROM c LEFT JOIN s ON c.user_id = s.user_id GROUP BY 1""")
def m_gauge(spark, sf_dir):
    op = F.when(F.col("key") == "signup", "set").when(F.col("key") == "error", "sub").otherwise("add")
    rows = _events(spark, sf_dir).select("source_id", "seq", op.alias("op"), (F.col("seq") % 10).alias("amount"))
    return metrics.gauge(rows, ["source_id"]).select("source_id", F.col("value").cast("long").alias("value"))


# ---- functions


@query("SELECT event_id AS seq, 'k' AS label_key, json_extract_string(props, '$.k') AS label_value FROM events")
def f_label_parse(spark, sf_dir):
    parsed = F.from_json("value", "map<string,string>")
    return _events(spark, sf_dir).select("seq", F.explode(parsed).alias("label_key", "label_value"))


@query("""SELECT * FROM (VALUES ('0', 0), ('1704067200', 1704067200), ('2024-01-01T00:00:00Z', 1704067200), ('2024-01-01T01:30:00+01:00', 1704069000), ('-5', -5)) t(literal, unix_s)""")
def f_ts_literal(spark, sf_dir):
    rows = spark.createDataFrame([("0",), ("1704067200",), ("2024-01-01T00:00:00Z",), ("2024-01-01T01:30:00+01:00",), ("-5",)], "literal string")
    return rows.select("literal", C.timestamp_literal("literal").alias("unix_s"))


@query("""SELECT * FROM (VALUES ('bench/runs/2024__fast/r.json', 'fast'), ('bench/runs/2024/r.json', '2024'), ('r.json', 'r'), ('a/b__x__y/r.json', 'x'), ('z/q.json', 'given')) t(path, tag)""")
def f_tag(spark, sf_dir):
    rows = [("bench/runs/2024__fast/r.json", ""), ("bench/runs/2024/r.json", None), ("r.json", ""), ("a/b__x__y/r.json", None), ("z/q.json", "given")]
    return spark.createDataFrame(rows, "path string, given string").select("path", C.run_tag("given", "path").alias("tag"))


@query("""SELECT * FROM (VALUES (12.0, '12', '+0.012ms', '12KB'), (1234.0, '1.2K', '+1.23ms', '1.2MB'), (1234567.0, '1.23M', '+1234.57ms', '1.2GB'), (1.5, '1.50', '+0.002ms', '2KB'), (0.0, '0', ' 0.000ms', '0KB'),
    (25000000.0, '25.00M', '+25.00s', '23.8GB')) t(v, count_txt, latency_txt, size_txt)""")
def f_human(spark, sf_dir):
    rows = spark.createDataFrame([(x,) for x in (12.0, 1234.0, 1234567.0, 1.5, 0.0, 25000000.0)], "v double")
    return rows.select("v", C.count_text("v").alias("count_txt"), C.latency_text("v").alias("latency_txt"), C.size_text("v").alias("size_txt"))


@query("SELECT event_id AS seq, 'source=' || user_id || ', ts=' || epoch_us(ts) || ', seq=' || event_id || ': key=' || event_type || ' value=' || props AS txt FROM events")
def f_record_text(spark, sf_dir):
    return _events(spark, sf_dir).select("seq", C.text_record().alias("txt"))


@query("""SELECT n, greatest(ceil(-n * ln(0.01) / (ln(2) * ln(2))), 1)::BIGINT AS bits, greatest(floor(greatest(ceil(-n * ln(0.01) / (ln(2) * ln(2))), 1) / n * ln(2)), 1)::BIGINT AS hashes
    FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)""")
def f_bloom_size(spark, sf_dir):
    rows = _events(spark, sf_dir).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    bits, hashes = C.bloom_size("n", F.lit(0.01))
    return rows.select("n", bits.cast("long").alias("bits"), hashes.cast("long").alias("hashes"))


@query("""SELECT workload, c AS concurrency FROM (VALUES ('write'), ('read'), ('mixed'), ('tail'), ('bulk')) w(workload), (VALUES (1), (2), (4), (6), (8), (10), (12), (14), (16)) s(c)""")
def sweep(spark, sf_dir):
    return compare.concurrency_sweep(spark.createDataFrame([(w,) for w in compare.WORKLOADS], "workload string"), 1, 16, 2)


# ---- end to end


def _canonical(spark, sf_dir):
    return _events(spark, sf_dir).select("source_id", "ts", "seq", "key", "value", "labels")


@query(f"WITH {_LOGS} SELECT source_id, ts, seq, key, value, labels_txt FROM logs")
def stream_append_replay(spark, sf_dir):
    """Slices of all events go through a stream into the store, twice; each record is there once."""
    root = _work_folder(spark, "stream")
    rows = _canonical(spark, sf_dir)
    schema = rows.schema
    rows.withColumn("slice", F.col("seq") % 3).write.partitionBy("slice").parquet(f"{root}/in1")
    store = LogStore(spark, f"{root}/store")
    for turn in (1, 2):  # the second run is a replay under a new checkpoint
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 8).parquet(f"{root}/in1")
        streaming.ingest(stream, store, f"{root}/checkpoint-{turn}").awaitTermination()
    found = streams.attach_labels(store.read().drop("labels"), store.streams())
    return found.select("source_id", "ts", "seq", "key", "value", C.labels_text("labels").alias("labels_txt"))


@query(f"WITH {_LOGS} SELECT source_id, ts, seq, key, value FROM logs WHERE source_id = 7 AND key = 'click' AND ts >= {JAN_5} AND ts < {JAN_19}")
def store_range(spark, sf_dir):
    """Two overlapping sets, compacted; then a range over what is live."""
    store = LogStore(spark, _work_folder(spark, "store"))
    logs = _events(spark, sf_dir)
    placed = streams.resolve_streams(logs, streams.build_registry(logs)).drop("at", "measure")
    store.append(placed.where("seq % 3 != 0"))
    store.append(placed.where("seq % 3 != 1"))
    store.compact(force=True)
    return series.range_scan(store.read(JAN_5, JAN_19), 7, "click", JAN_5, JAN_19).select("source_id", "ts", "seq", "key", "value")


@query(f"WITH {_LOGS} SELECT source_id, ts, seq, key, value FROM logs")
def codec_roundtrip(spark, sf_dir):
    """Records written as frames, a file per partition, and read by the data source."""
    folder = _work_folder(spark, "frames")

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        place, at = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        place.create_dir(at, recursive=True)
        name, n = f"{at}/part-{TaskContext.get().partitionId():05d}", 0
        temp = f"{at}/.part-{TaskContext.get().taskAttemptId()}"
        with place.open_output_stream(temp) as out:
            for batch in batches:
                for row in batch.to_pylist():
                    out.write(frames.encode(frames.RECORD, row))
                    n += 1
        place.move(temp, name)
        yield pa.RecordBatch.from_pydict({"n": [n]})

    rows = _canonical(spark, sf_dir).drop("labels")
    rows.mapInArrow(write, "n long").agg(F.sum("n")).collect()
    found = frames.read_frames(spark, folder)
    return found.select("source_id", "ts", F.col("seq").cast("long").alias("seq"), "key", "value")



@query(f"WITH {_LOGS} SELECT source_id, ts, seq, key, value FROM logs")
def journal_recover(spark, sf_dir):
    """All events as record frames in journals, a third of them in two, one journal torn; recovered once each."""
    folder = _work_folder(spark, "journals")

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        place, at = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        place.create_dir(at, recursive=True)
        part, n, torn = TaskContext.get().partitionId(), 0, b""
        with place.open_output_stream(f"{at}/.{part}-{TaskContext.get().taskAttemptId()}") as out:
            for batch in batches:
                for row in batch.to_pylist():
                    torn = frames.encode(frames.RECORD, row)
                    out.write(torn)
                    n += 1
            out.write(torn[:-1])
        place.move(f"{at}/.{part}-{TaskContext.get().taskAttemptId()}", f"{at}/inactive-{part:06d}.log")
        yield pa.RecordBatch.from_pydict({"n": [n]})

    rows = _canonical(spark, sf_dir).drop("labels")
    again = rows.where("seq % 3 = 0")
    rows.unionByName(again).mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return journal.recover_series(spark, folder)


@query(f"""WITH {_LOGS}, {_REGISTRY} SELECT stream_id, ts, seq, source_id, value FROM logs JOIN registry USING (labels_txt)
    WHERE stream_id IN (1, 4, 7) AND ts BETWEEN {JAN_5} AND {JAN_19}""")
def sorted_files_streams(spark, sf_dir):
    """All events as sorted record files; of three streams the records of two weeks, by filter and sparse index."""
    logs = _events(spark, sf_dir)
    placed = streams.resolve_streams(logs, streams.build_registry(logs))
    manifest = sorted_files.write_sorted_files(placed.withColumnRenamed("value", "payload"), _work_folder(spark, "sorted"))
    found = sorted_files.read_sorted_files(manifest, [1, 4, 7], JAN_5, JAN_19)
    return found.select("stream_id", "ts", "seq", "source_id", F.col("payload").cast("string").alias("value"))


@query(f"WITH {_LOGS}, limits AS (SELECT max(ts) - 7 * {DAY} AS lim FROM logs) SELECT source_id, ts, seq, key, value FROM logs, limits WHERE ts >= lim")
def store_retain(spark, sf_dir):
    """A set per week, compacted in part, then retention by age, and the rows of a week that are left."""
    store = LogStore(spark, _work_folder(spark, "retain"))
    logs = _events(spark, sf_dir)
    placed = streams.resolve_streams(logs, streams.build_registry(logs)).drop("at", "measure")
    newest = placed.agg(F.max("ts")).first()[0]
    store.append(placed.where(F.col("ts") < newest - 7 * DAY))
    store.append(placed.where(F.col("ts") >= newest - 7 * DAY))
    store.retain(newest, 7)
    store.vacuum()
    return store.read().select("source_id", "ts", "seq", "key", "value")


@query(f"""WITH r AS (SELECT workload, concurrency, n / nullif(seconds, 0) AS t, n FROM ({_RATES})),
    s AS (SELECT workload, max(t) AS thr, arg_max(concurrency, struct_pack(t := t, c := -concurrency)) AS peak FROM r GROUP BY 1)
    SELECT 'sat_' || lower(workload) || '_' || field AS field, round(v + 1e-9, 6) AS prev, round(w + 1e-9, 6) AS new, round(w - v + 1e-9, 6) AS delta
    FROM (SELECT workload, 'throughput' AS field, thr AS v, thr * 2 AS w FROM s UNION ALL SELECT workload, 'conc_peak', peak::DOUBLE, peak::DOUBLE FROM s)""")
def m_saturation_compare(spark, sf_dir):
    """Saturation against that of a run twice as fast."""
    base = metrics.saturation(_rates(spark, sf_dir))
    found = compare.compare_saturation(base, base.withColumn("max_throughput", F.col("max_throughput") * 2))
    return found.select("field", *(_rounded(c) for c in ("prev", "new", "delta")))


@query("""WITH m AS (SELECT trunc(value * 100)::BIGINT AS rss, ts < TIMESTAMP '2024-01-16' AS first FROM events),
    r AS (SELECT first, min(rss) AS mem_rss_min_kb, max(rss) AS mem_rss_max_kb, sum(rss) // count(*) AS mem_rss_avg_kb, sum(rss) AS mem_rss_sum_kb, count(*) AS mem_sample_size FROM m GROUP BY 1),
    t AS (SELECT first, unnest(['mem_rss_min_kb', 'mem_rss_max_kb', 'mem_rss_avg_kb', 'mem_rss_sum_kb', 'mem_sample_size']) AS field,
        unnest([mem_rss_min_kb::DOUBLE, mem_rss_max_kb::DOUBLE, mem_rss_avg_kb::DOUBLE, mem_rss_sum_kb::DOUBLE, mem_sample_size::DOUBLE]) AS v FROM r)
    SELECT a.field, a.v AS prev, b.v AS new, b.v - a.v AS delta FROM t a JOIN t b ON a.field = b.field WHERE a.first AND NOT b.first""")
def m_memory_compare(spark, sf_dir):
    """Memory reports of the two halves of a month."""
    m, half = _memory(spark, sf_dir), (JAN_5 + 11 * DAY - 1_704_067_200_000_000) / 1e6
    found = compare.compare_memory(metrics.memory_report(m.where(F.col("elapsed_secs") < half)), metrics.memory_report(m.where(F.col("elapsed_secs") >= half)))
    return found.where(~F.col("field").isin("mem_rss_end_kb", "mem_growth_kbs")).select("field", "prev", "new", "delta")


@query(f"""WITH {_COMPARE}, g(scope, metric, goal) AS (VALUES ('write', 'inserts/s', 0.0001), ('read', 'insert_latency p99', 300000.0))
    SELECT workload, concurrency, field, goal::DOUBLE AS goal, CASE way WHEN 'higher' THEN new >= goal ELSE new <= goal END AS met FROM pct JOIN g ON workload = scope AND field = metric""")
def m_goals_of_a_file(spark, sf_dir):
    """Goals as a file states them, and whether they are met."""
    from ..sources import runs

    text = '[write]\n"inserts/s" = 0.0001\n[read]\n"insert_latency p99" = 300000\n'
    return compare.with_goals(_compared(spark, sf_dir), runs.goals(spark, text)).where("goal is not null").select("workload", "concurrency", "field", "goal", "met")
