"""Micro-batch ingestion into the store: validate, resolve streams, number, append; exactly once.

Late rows are always taken: there is no watermark, and order is made by the queries.  A batch that
comes again, after a failure or from a replayed source, adds only records that are not there yet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.series import assign_sequence
from ..operators.streams import build_registry, resolve_streams
from ..operators.validation import split_valid
from ..schema import SERIES_KEY, Settings
from ..sources.store import LogStore


def append_batch(store: LogStore, batch: DataFrame, arrival: str = "seq", keep_sequence: bool = False, quarantine: Callable[[DataFrame], None] | None = None) -> int:
    """Appends a batch of log rows (T1-T3, T7-T9); returns the number of rows added.

    All rows are checked first; bad ones go to ``quarantine`` with a reason and never hold up good ones.
    ``arrival`` is a unique number that orders the batch.  With ``keep_sequence`` the rows' own numbers
    stand and rows that the store has already are left out (T11); else numbers go on from the store's.
    """
    good, bad = split_valid(batch)
    if quarantine is not None:
        quarantine(bad)
    good, registry = good.persist(), None
    try:
        if keep_sequence:
            good = good.dropDuplicates(list(SERIES_KEY))
            span = good.agg(F.min("ts"), F.max("ts")).first()
            if span[0] is None:
                return 0
            stored = store.read(span[0], span[1], closed=True).select(*SERIES_KEY)
            good = good.join(stored, list(SERIES_KEY), "left_anti")
        n = good.count()
        if not n:
            return 0
        if not keep_sequence:
            good = assign_sequence(good.withColumn("_arrival", F.col(arrival)).drop("seq"), "_arrival", store.next_sequence()).drop("_arrival")
        known = store.streams().select(
            "stream_id", F.lit(0).cast("long").alias("fingerprint"), "labels", F.lit(-1).cast("long").alias("first_seq")
        )
        registry = build_registry(good, known).persist()
        new = registry.where("first_seq >= 0").orderBy("stream_id").collect()  # new label maps of this batch
        rows = resolve_streams(good, registry)
        store.append(rows, [(r["stream_id"], r["labels"]) for r in new])
        return n
    finally:
        good.unpersist()
        if registry is not None:
            registry.unpersist()


def ingest(stream: DataFrame, store: LogStore, checkpoint: str, available_now: bool = True, **options) -> StreamingQuery:
    """Starts ingestion of a stream of log rows; the sink is idempotent, so restarts repeat nothing."""

    def each(batch: DataFrame, _: int) -> None:
        append_batch(store, batch, keep_sequence=True, **options)
        store.compact()  # if the store has grown enough

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def bounded_stream(spark: SparkSession, schema: StructType, folder: str, settings: Settings) -> DataFrame:
    """A stream of Parquet log files whose micro-batches hold at most the settings' memory (T6, T14): what is
    beyond waits in the folder, as a batch is one set of the store."""
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", f"{settings.memory_mb}m").parquet(folder)


def freeze_windows(rows: DataFrame, limit_bytes: int, by: str, order: str, size: str) -> DataFrame:
    """Rows with the number of the size window they fall in (T6): running bytes before the row, in units of the limit.

    ``by`` keeps the running sum within a group, so that no task gets all rows.
    """
    from pyspark.sql import Window

    before = F.coalesce(F.sum(size).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("bucket", F.floor(before / F.lit(limit_bytes)))
