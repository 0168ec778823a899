"""The log store: immutable sets of day-partitioned, sorted Parquet files and an append-only change log.

    <root>/sets/set=<20 digits>/day=YYYY-MM-DD/*.parquet
    <root>/changes/<20 digits>.json        one commit each: flush, compaction, retention or stream updates
    <root>/snapshots/<20 digits>/*.json    the changes up to that commit, folded

A set counts once its change is there, and until a later change removes it; readers fold the change
log once per query, so they see a consistent state while writers go on.  Changes have consecutive
numbers, and a number can be taken only once.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import day_of
from ..operators.series import in_time
from ..schema import SERIES_KEY, Settings

CHANGE_SCHEMA = (
    "op_seq long, kind string, set_id long, removed array<long>, stream_id long, labels map<string,string>, min_ts long, max_ts long, n long, max_seq long"
)
ROW_SCHEMA = "source_id long, ts long, seq long, key string, value string, labels map<string,string>, stream_id long, day string"


def fold_changes(changes: DataFrame) -> DataFrame:
    """(set_id, state, …): the last word on every set, live or removed."""
    added = changes.where("set_id is not null").select("set_id", "op_seq", F.lit("live").alias("state"), "min_ts", "max_ts", "n", "max_seq")
    gone = changes.select(F.explode("removed").alias("set_id"), "op_seq").select(
        "set_id", "op_seq", F.lit("removed").alias("state"), *(F.lit(None).cast("long").alias(c) for c in ("min_ts", "max_ts", "n", "max_seq"))
    )
    return added.unionByName(gone).groupBy("set_id").agg(F.max_by(F.struct("state", "min_ts", "max_ts", "n", "max_seq"), "op_seq").alias("s")).select("set_id", "s.*")


def merge_snapshots(older: DataFrame, newer: DataFrame) -> DataFrame:
    """(set_id, state): the older one's live sets, with the newer one's words over them; removed ones go."""
    o = older.where("state = 'live'").select("set_id", F.col("state").alias("old"))
    n = newer.select("set_id", F.col("state").alias("new"))
    both = o.join(n, "set_id", "full_outer").select("set_id", F.coalesce("new", "old").alias("state"))
    return both.where("state = 'live'")


def fold_streams(changes: DataFrame) -> DataFrame:
    """(stream_id, labels): the last update of every stream."""
    updates = changes.where("kind = 'stream'")
    return updates.groupBy("stream_id").agg(F.max_by("labels", "op_seq").alias("labels"))


def oldest_sets(sets: DataFrame, n: int, busy: DataFrame | None = None) -> DataFrame:
    """The ``n`` sets of the smallest set_id that are not being compacted."""
    free = sets if busy is None else sets.join(busy.select("set_id"), "set_id", "left_anti")
    return free.orderBy("set_id").limit(n)


def file_stats(rows: DataFrame, *by) -> DataFrame:
    """(…, min_ts, max_ts, n, max_seq): first and last key, number of records and highest number."""
    said = (F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.count(F.lit(1)).alias("n"), F.max("seq").alias("max_seq"))
    return rows.groupBy(*by).agg(*said)


class LogStore:
    """A store under ``root``; one writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None):
        self.spark, self.root, self.settings = spark, root.rstrip("/"), settings or Settings()

    # ---- files

    def _path(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, name: str) -> list[str]:
        path, fs = self._path(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def changes(self) -> DataFrame:
        """The last snapshot and the changes after it, as change rows."""
        last, paths = self._snapshot()
        paths = [*paths, *(f"{self.root}/changes/{n}" for n in self._names("changes") if int(n.partition(".")[0]) > last)]
        if not paths:
            return self.spark.createDataFrame([], CHANGE_SCHEMA)
        return self.spark.read.schema(CHANGE_SCHEMA).json(paths)

    def _snapshot(self) -> tuple[int, list[str]]:
        """(number, paths) of the last whole snapshot; -1 if there is none."""
        for name in reversed(self._names("snapshots")):
            if "_SUCCESS" in self._names(f"snapshots/{name}"):
                return int(name), [f"{self.root}/snapshots/{name}"]
        return -1, []

    def _commit(self, rows: list[dict]) -> None:
        """Appends changes under the next number; fails if another writer has taken it.

        The file is created only if it is not there, which the file system decides for one writer.
        """
        taken = self._names("changes")
        number = int(taken[-1].partition(".")[0]) + 1 if taken else 0
        lines = [json.dumps(r | {"op_seq": number * 1_000_000 + i}) for i, r in enumerate(rows)]
        path, fs = self._path(f"changes/{number:020d}.json")
        out = fs.create(path, False)
        out.write(("\n".join(lines) + "\n").encode())
        out.close()
        if number - self._snapshot()[0] >= self.settings.snapshot_every:
            self.snapshot(number)

    def snapshot(self, number: int) -> None:
        """Folds the changes up to a commit: a row per live set and per stream, and the highest sequence number."""
        changes = self.changes().where(F.col("op_seq") < (number + 1) * 1_000_000)
        names = [f.split()[0] for f in CHANGE_SCHEMA.split(", ")]
        full = lambda df: df.select(*(F.col(n) if n in df.columns else F.lit(None).alias(n) for n in names))
        live = changes.join(fold_changes(changes).where("state = 'live'").select("set_id"), "set_id").where("kind != 'stream'").withColumn("removed", F.lit(None))
        last = changes.groupBy("stream_id").agg(F.max("op_seq").alias("op_seq")).where("stream_id is not null")
        streams = changes.where("kind = 'stream'").join(last, ["stream_id", "op_seq"])
        mark = changes.agg(F.max("max_seq").alias("max_seq"), F.max("op_seq").alias("op_seq")).withColumn("kind", F.lit("mark"))
        out = full(live).unionByName(full(streams)).unionByName(full(mark))
        out.select(*(F.col(f.split()[0]).cast(f.split(" ", 1)[1]) for f in CHANGE_SCHEMA.split(", "))).coalesce(1).write.mode("overwrite").json(f"{self.root}/snapshots/{number:020d}")

    def live(self) -> DataFrame:
        return fold_changes(self.changes()).where("state = 'live'")

    def _next_set(self) -> int:
        names = self._names("sets")
        return int(names[-1].partition("=")[2]) + 1 if names else 0

    def _write(self, rows: DataFrame, number: int) -> dict:
        """A set: a few sorted files per day, with Bloom filters on the series and stream columns."""
        out = rows.withColumn("day", day_of("ts")).select(*(f.split()[0] for f in ROW_SCHEMA.split(", ")))
        # By day and series, in as many ranges as adaptive execution makes of the bytes; a busy series is split by time.
        (
            out.repartitionByRange("day", "source_id", "key", "ts", "seq")
            .sortWithinPartitions("day", "source_id", "key", "ts", "seq")
            .write.partitionBy("day")
            .option("parquet.bloom.filter.enabled#source_id", "true")
            .option("parquet.bloom.filter.enabled#key", "true")
            .option("parquet.bloom.filter.enabled#stream_id", "true")
            .mode("overwrite")  # what a failed attempt left under this number
            .parquet(f"{self.root}/sets/set={number:020d}")
        )
        back = self.spark.read.schema(ROW_SCHEMA).parquet(f"{self.root}/sets/set={number:020d}")
        return file_stats(back).first().asDict()

    # ---- writing

    def append(self, rows: DataFrame, streams: list[tuple[int, dict[str, str]]] = ()) -> int:
        """Flushes rows with all canonical columns and stream_id as a new set (S29, S31, S32); returns its number."""
        number = self._next_set()
        said = self._write(rows, number)
        updates = [{"kind": "stream", "stream_id": i, "labels": labels} for i, labels in streams]
        self._commit([*updates, {"kind": "flush", "set_id": number, **said}])
        return number

    def compact(self, force: bool = False) -> int | None:
        """Merges the oldest sets into one, dropping repeated records (U5, U6, W6); None if there is no need.

        The need: all live sets together reach the settings' size, and there are two at least.
        """
        oldest = [r["set_id"] for r in oldest_sets(self.live(), self.settings.compaction_inputs).collect()]
        if len(oldest) < 2 or not (force or self.bytes() >= self.settings.compaction_bytes):
            return None
        number = self._next_set()
        said = self._write(self._rows(oldest).dropDuplicates(list(SERIES_KEY)), number)
        self._commit([{"kind": "compaction", "set_id": number, "removed": oldest, **said}])
        return number

    def retain(self, now_us: int, days: int | None = None) -> list[int]:
        """Removes the sets whose newest record is older than ``days`` (U8); returns them.

        A set goes as a whole: one that compaction made of many days goes with its youngest row.
        """
        days = self.settings.retention_days if days is None else days
        if days is None:
            return []
        limit = now_us - days * 86_400_000_000
        old = [r["set_id"] for r in self.live().where(F.col("max_ts") < limit).orderBy("set_id").collect()]
        if old:
            self._commit([{"kind": "retention", "removed": old}])
        return old

    def vacuum(self) -> list[int]:
        """Deletes the files of sets that no change keeps alive; not while readers of older states run."""
        live = {r["set_id"] for r in self.live().collect()}
        gone = [n for n in self._names("sets") if int(n.partition("=")[2]) not in live]
        for name in gone:
            path, fs = self._path(f"sets/{name}")
            fs.delete(path, True)
        return [int(n.partition("=")[2]) for n in gone]

    # ---- reading

    def _rows(self, sets: list[int]) -> DataFrame:
        if not sets:
            return self.spark.createDataFrame([], ROW_SCHEMA)
        return self.spark.read.schema(ROW_SCHEMA).option("basePath", f"{self.root}/sets").parquet(*(f"{self.root}/sets/set={i:020d}" for i in sets)).drop("set")

    def read(self, start: int | None = None, end: int | None = None, closed: bool = False) -> DataFrame:
        """Rows of the live sets within the bounds: sets are chosen by their ranges, folders by day, row groups by ts."""
        live = self.live()
        if start is not None:
            live = live.where(F.col("max_ts") >= start)
        if end is not None:
            live = live.where(F.col("min_ts") <= end)
        rows = self._rows([r["set_id"] for r in live.select("set_id").orderBy("set_id").collect()])
        if start is not None:
            rows = rows.where(F.col("day") >= day_of(F.lit(start)))
        if end is not None:
            rows = rows.where(F.col("day") <= day_of(F.lit(end)))
        return rows.where(in_time(start, end, closed))

    def streams(self) -> DataFrame:
        return fold_streams(self.changes())

    def next_sequence(self) -> int:
        """One more than the highest number in any set, removed ones included."""
        last = self.changes().agg(F.max("max_seq")).first()[0]
        return 0 if last is None else last + 1

    def bytes(self) -> int:
        """Size of the live sets' files."""
        total = 0
        for r in self.live().select("set_id").collect():
            path, fs = self._path(f"sets/set={r['set_id']:020d}")
            total += fs.getContentSummary(path).getLength()
        return total
