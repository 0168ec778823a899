"""The calls of a log client over a session: insert, batch insert, range, label range, metrics, ping."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .operators.series import range_scan
from .operators.streams import label_range
from .schema import LOG_SCHEMA, Settings
from .sources.store import LogStore
from .streaming.ingest import append_batch


class Client:
    """What is appended is seen by the next query."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None):
        self.spark, self.store, self.settings = spark, LogStore(spark, root, settings), settings or Settings()
        self.counts = {"inserts": 0, "ranges": 0, "records": 0, "refused": 0}

    def ping(self) -> bool:
        return self.spark.range(1).count() == 1

    def insert(self, source_id: int, ts: int, key: str, value: str, labels: dict[str, str] | None = None) -> int:
        return self.batch_insert([{"source_id": source_id, "ts": ts, "key": key, "value": value, "labels": labels}])

    def batch_insert(self, records: list[dict]) -> int:
        """Rows get consecutive sequence numbers in the given order; returns how many were taken."""
        rows = [{"labels": {"key": r["key"]}} | {k: v for k, v in r.items() if v is not None} | {"seq": i} for i, r in enumerate(records)]
        n = append_batch(self.store, self.spark.createDataFrame(rows, LOG_SCHEMA))
        self.counts["inserts"] += n
        self.counts["refused"] += len(records) - n
        return n

    def range(self, source_id: int, key: str, start: int, end: int, contains: str = "") -> DataFrame:
        self.counts["ranges"] += 1
        found = range_scan(self.store.read(max(start, 0), end) if 0 <= start <= end else self.store.read(), source_id, key, start, end, contains)
        return found.select("source_id", "ts", "seq", "key", "value")

    def rows(self, found: DataFrame) -> Iterator[Row]:
        """Rows of a result, a partition at a time."""
        for row in found.toLocalIterator(prefetchPartitions=True):
            self.counts["records"] += 1
            yield row

    def label_range(self, labels: dict[str, str], start: int | None = None, end: int | None = None) -> DataFrame:
        registry = self.store.streams()
        return label_range(self.store.read(start, end, closed=True), registry, labels, start, end, self.settings.strict_labels)

    def metrics(self) -> str:
        """Counters and store sizes as JSON."""
        sets, rows = self.store.live().agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        return json.dumps({"client": self.counts, "store": {"sets": sets, "rows": rows, "bytes": self.store.bytes(), "next_sequence": self.store.next_sequence()}})
