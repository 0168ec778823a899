"""Sorted record files of label streams: checked blocks, a sparse index and a Bloom filter of the streams.

A file ``<number>.sst`` is, in this order: blocks; the index, an entry per block (first and last key,
place, size, records); the Bloom filter; and a tail with the places and sizes of both, their CRC-32 and a
magic.  A block is a u16 number of records, a u32 offset each, the records, and a CRC-32 of all that.
A record is as in ``frames``: key (source, time, sequence, stream), u32 length, payload.  Records are in
the order (stream, time, sequence, source), so that a stream's records lie together.

Spark's own files serve the store; these are for exchange with programs that read records by position.
"""

from __future__ import annotations

import bisect
import math
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames

MAGIC = b"TIDESST1"
_KEY, _TAIL = struct.Struct(">QQQQ"), struct.Struct(">QIQII8s")
_ENTRY = struct.Struct(">32s32sQII")
_U64 = (1 << 64) - 1
#: Most records or bytes that a block's u16 counts may say.
MAX_BLOCK_RECORDS = 65_535
# The two salts of the filter's double hashing, and the parameters of 64-bit FNV-1a.
SALTS = (b"bloom_salt_1", b"bloom_salt_2")
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def wrapping_add(a: int, b: int) -> int:
    """Addition of unsigned 64-bit integers."""
    return (a + b) & _U64


def fnv1a(data: bytes, salt: bytes = b"") -> int:
    """64-bit FNV-1a of the data and the salt after it."""
    h = FNV_START
    for b in data + salt:
        h = (h ^ b) * FNV_PRIME & _U64
    return h


class Bloom:
    """May a file hold a stream?  No false "no" (Z24, P9, P10)."""

    def __init__(self, n_bits: int, n_hashes: int, data: bytes | None = None):
        self.n_bits, self.n_hashes = n_bits, n_hashes
        self._bytes = bytearray(data if data is not None else -(-n_bits // 8))

    @classmethod
    def sized(cls, n: int, rate: float = 0.01) -> Bloom:
        """For ``n`` streams and a share of false "yes" (F4)."""
        n = max(n, 1)
        bits = max(1, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
        return cls(bits, max(1, int(bits / n * math.log(2))))

    def _places(self, stream_id: int) -> list[int]:
        one, two = (fnv1a((stream_id & _U64).to_bytes(8, "big"), s) for s in SALTS)
        return [wrapping_add(one, i * two & _U64) % self.n_bits for i in range(self.n_hashes)]

    def add(self, stream_id: int) -> None:
        for p in self._places(stream_id):
            self._bytes[p >> 3] |= 1 << (p & 7)

    def may_hold(self, stream_id: int) -> bool:
        return all(self._bytes[p >> 3] >> (p & 7) & 1 for p in self._places(stream_id))

    def may_hold_any(self, stream_ids: Iterable[int]) -> bool:
        return any(map(self.may_hold, stream_ids))

    def encode(self) -> bytes:
        return struct.pack(">QQI", self.n_bits, self.n_hashes, len(self._bytes)) + bytes(self._bytes)

    @classmethod
    def decode(cls, data: bytes) -> Bloom:
        if len(data) < 20:
            raise frames.FrameError("truncated Bloom filter")
        bits, hashes, n = struct.unpack_from(">QQI", data)
        if len(data) != 20 + n or n != -(-bits // 8) or not bits or not hashes:
            raise frames.FrameError("a Bloom filter of the wrong size")
        return cls(bits, hashes, data[20:])


def order_of(record: dict) -> bytes:
    """A key that sorts as (stream, time, sequence, source)."""
    return _KEY.pack(record["stream_id"], record["ts"], record["seq"], record["source_id"])


def block_limit(n: int) -> int:
    """A usable number of records per block."""
    if not 1 <= n <= MAX_BLOCK_RECORDS:
        raise ValueError(f"a block has 1 to {MAX_BLOCK_RECORDS} records")
    return n


def encode_block(records: list[dict]) -> bytes:
    block_limit(len(records))
    parts = [frames.encode_record(**r) for r in records]
    offsets, at = [], 0
    for p in parts:
        offsets.append(at)
        at += len(p)
    body = struct.pack(f">H{len(parts)}I", len(parts), *offsets) + b"".join(parts)
    return body + struct.pack(">I", zlib.crc32(body))


class Block:
    """A decoded block and a cursor in it."""

    def __init__(self, data: bytes):
        if len(data) < 6 or struct.unpack(">I", data[-4:])[0] != zlib.crc32(data[:-4]):
            raise frames.FrameError("a block does not have its checksum")
        (n,) = struct.unpack_from(">H", data)
        offsets = struct.unpack_from(f">{n}I", data, 2)
        if list(offsets) != sorted(set(offsets)):
            raise frames.FrameError("a block's offsets do not ascend")
        self.records = list(frames.decode_records(data[2 + 4 * n : -4]))
        if len(self.records) != n:
            raise frames.FrameError("a block does not have its records")
        self._keys, self._at = [order_of(r) for r in self.records], 0

    def seek(self, key: bytes) -> None:
        """To the record of that key, or the next one."""
        self._at = bisect.bisect_left(self._keys, key)

    def seek_to_first(self) -> None:
        self._at = 0

    def peek(self) -> dict | None:
        return self.records[self._at] if self._at < len(self.records) else None

    def next(self) -> dict | None:
        found = self.peek()
        self._at += found is not None
        return found


class _Positions:
    """A view of a shared file with a position of its own."""

    def __init__(self, source):
        self._source = source

    def read_at(self, size: int, place: int) -> bytes:
        data = self._source.read_at(size, place) if hasattr(self._source, "read_at") else self._slice(size, place)
        if len(data) != size:
            raise frames.FrameError("the file is cut off")
        return data

    def _slice(self, size: int, place: int) -> bytes:
        return bytes(self._source[place : place + size])


def file_number(name: str) -> int:
    """The number in ``<number>.sst``."""
    m = re.fullmatch(r"(\d+)\.sst", name.rpartition("/")[2])
    if not m or int(m[1]) > _U64:
        raise ValueError(f"no file of sorted records: {name}")
    return int(m[1])


def write_file(out, records: Iterable[dict], block_records: int = 256) -> dict:
    """Writes records that are in order; returns n, first and last time, and the number of blocks."""
    limit, at, index, streams, waiting, last = block_limit(block_records), 0, [], set(), [], b""
    n, low, high = 0, None, None

    def flush() -> None:
        nonlocal at, waiting
        data = encode_block(waiting)
        index.append(_ENTRY.pack(order_of(waiting[0]), order_of(waiting[-1]), at, len(data), len(waiting)))
        out.write(data)
        at, waiting = at + len(data), []

    for r in records:
        key = order_of(r)
        if key < last:
            raise ValueError("records are not in order")
        last, n = key, n + 1
        low, high = (r["ts"] if low is None else min(low, r["ts"])), (r["ts"] if high is None else max(high, r["ts"]))
        streams.add(r["stream_id"])
        waiting.append(r)
        if len(waiting) == limit:
            flush()
    if waiting:
        flush()
    bloom = Bloom.sized(len(streams))
    for s in streams:
        bloom.add(s)
    table, filter_ = b"".join(index), bloom.encode()
    out.write(table + filter_ + _TAIL.pack(at, len(table), at + len(table), len(filter_), zlib.crc32(table + filter_), MAGIC))
    return {"n": n, "min_ts": low, "max_ts": high, "n_blocks": len(index)}


class SortedFile:
    """Reads a file by its index (S15, W12, Z27); ``source`` is bytes or has ``size()`` and ``read_at``."""

    def __init__(self, source):
        size = source.size() if hasattr(source, "size") else len(source)
        self._at = _Positions(source)
        if size < _TAIL.size:
            raise frames.FrameError("no file of sorted records")
        place, n, bloom_place, bloom_n, crc, magic = _TAIL.unpack(self._at.read_at(_TAIL.size, size - _TAIL.size))
        if magic != MAGIC:
            raise frames.FrameError("no file of sorted records")
        table, bloom = self._at.read_at(n, place), self._at.read_at(bloom_n, bloom_place)
        if zlib.crc32(table + bloom) != crc:
            raise frames.FrameError("the index does not have its checksum")
        self.index = [_ENTRY.unpack_from(table, i) for i in range(0, len(table), _ENTRY.size)]
        self.bloom, self.blocks_read = Bloom.decode(bloom), 0

    def read_block(self, i: int) -> Block:
        if not 0 <= i < len(self.index):
            raise IndexError(f"block {i} of {len(self.index)}")
        self.blocks_read += 1
        return Block(self._at.read_at(self.index[i][3], self.index[i][2]))

    def scan(self, low: bytes = b"", high: bytes = b"\xff" * 33) -> Iterator[dict]:
        """Records with low <= key <= high; of the blocks only those that can have some are read."""
        i = bisect.bisect_left([e[1] for e in self.index], low)
        while i < len(self.index) and self.index[i][0] <= high:
            block = self.read_block(i)
            block.seek(low)
            while (r := block.next()) is not None and order_of(r) <= high:
                yield r
            i += 1

    def streams(self, stream_ids: Iterable[int], start: int = 0, end: int = _U64) -> Iterator[dict]:
        """Records of the streams with start <= ts <= end; streams that the filter excludes cost nothing."""
        for s in sorted(set(stream_ids)):
            if self.bloom.may_hold(s):
                yield from self.scan(_KEY.pack(s, start, 0, 0), _KEY.pack(s, end, _U64, _U64))


def write_sorted_files(rows: DataFrame, folder: str, block_records: int = 256) -> DataFrame:
    """Writes (stream_id, ts, seq, source_id, payload) as files in one order; returns (path, n, min_ts, max_ts, n_blocks), written.

    The numbers are not negative.  Files are made by tasks, whole or not at all.
    """
    import pyarrow as pa

    names = ("stream_id", "ts", "seq", "source_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        place, at = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        def records(batch):
            while batch is not None:
                for start in range(0, batch.num_rows, 5000):
                    yield from batch.slice(start, 5000).to_pylist()
                batch = next(batches, None)

        place.create_dir(at, recursive=True)
        with place.open_output_stream(f"{at}/.{part}-{attempt}") as out:
            said = write_file(out, records(first), block_records)
        place.move(f"{at}/.{part}-{attempt}", f"{at}/{part}.sst")
        yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{part}.sst", **said}])

    ordered = rows.select(*(F.col(c).cast("long").alias(c) for c in names), F.col("payload").cast("binary").alias("payload"))
    ordered = ordered.repartitionByRange(*names).sortWithinPartitions(*names)
    manifest = ordered.mapInArrow(write, "path string, n long, min_ts long, max_ts long, n_blocks long")
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return rows.sparkSession.read.parquet(f"{folder}/manifest")


def read_sorted_files(manifest: DataFrame, stream_ids: list[int] | None = None, start: int = 0, end: int = (1 << 63) - 1) -> DataFrame:
    """(stream_id, ts, seq, source_id, payload) with start <= ts <= end, of some streams or of all.

    Files out of the time range are not opened; of the others only blocks that can have such records are read.
    """
    import pyarrow as pa

    wanted = None if stream_ids is None else sorted(set(stream_ids))
    schema = pa.schema([*((n, pa.int64()) for n in ("stream_id", "ts", "seq", "source_id")), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import islice

        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                place, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                with place.open_input_file(at) as source:
                    file = SortedFile(source)
                    found = (r for r in file.scan() if start <= r["ts"] <= end) if wanted is None else file.streams(wanted, start, end)
                    while some := list(islice(found, 5000)):
                        yield pa.RecordBatch.from_pylist(some, schema=schema)

    files = manifest.where((F.col("max_ts") >= start) & (F.col("min_ts") <= end)).select("path")
    return files.repartition(max(1, files.count())).mapInArrow(read, "stream_id long, ts long, seq long, source_id long, payload binary")


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of a folder of sorted files."""
    return spark.read.parquet(f"{folder}/manifest")
