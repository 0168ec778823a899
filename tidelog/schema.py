"""Canonical rows, limits and settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: A log record.  ``ts`` is microseconds since the epoch, ``seq`` the order of arrival.
LOG_SCHEMA = T.StructType(
    [
        T.StructField("source_id", T.LongType()),
        T.StructField("ts", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
    ]
)
#: What identifies a record of a keyed series, and one of a label stream.
SERIES_KEY = ("source_id", "ts", "seq", "key")
STREAM_KEY = ("stream_id", "ts", "seq", "source_id")

# Sizes that records must keep to.
MIN_PAYLOAD_BYTES = 2
MAX_PAYLOAD_BYTES = 4096
MAX_LABELS = 255
MAX_LABEL_BYTES = 255
RECORD_OVERHEAD_BYTES = 48

STREAM_SCHEMA = "stream_id long, fingerprint long, labels map<string,string>, first_seq long"
LATENCY = "struct<min:bigint,p50:bigint,p90:bigint,p95:bigint,p99:bigint,p99_9:bigint,max:bigint,mean:double,stddev:double,sample_count:bigint>"
RUN_SCHEMA = (
    "workload string, concurrency int, insert_ops_per_sec double, range_ops_per_sec double, avg_records_per_range double, "
    f"sstable_count bigint, insert_latency {LATENCY}, range_latency {LATENCY}"
)
MEMORY_SCHEMA = "elapsed_secs double, rss_kb long, vms_kb long, data_kb long"


@dataclass(frozen=True)
class Settings:
    """Limits of ingestion and upkeep, with the defaults that operators are used to."""

    memory_mb: int = 32
    command_batch: int = 512
    range_batch: int = 1024
    max_files: int = 8
    compaction_factor: int = 8
    retention_days: int | None = None
    snapshot_every: int = 64
    strict_labels: bool = True

    @property
    def compaction_bytes(self) -> int:
        return self.compaction_factor * self.memory_mb * 1024 * 1024

    @property
    def compaction_inputs(self) -> int:
        return max(self.max_files // 2, 2)
