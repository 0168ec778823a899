"""Wire frames: a batch codec, and a Python data source over files of frames.

A frame is a big-endian u32 length, a type byte and a payload.  Integers are big-endian; strings have
a u32 length before them.  Decoding stops quietly at a torn last frame and complains about anything
else that does not fit.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Message types.
INSERT, RANGE, BATCH_INSERT, METRICS, PING = 0x01, 0x02, 0x03, 0x04, 0x05
INSERT_OK, RECORD, RANGE_END, METRICS_REPLY, PONG, ERROR = 0x81, 0x82, 0x83, 0x84, 0x85, 0xFF
#: Layouts: q and Q are 64-bit integers, s a string; BATCH_INSERT is a u32 count and that many inserts.
LAYOUTS = {
    INSERT: (("source_id", "q"), ("ts", "q"), ("key", "s"), ("value", "s")),
    RANGE: (("source_id", "q"), ("key", "s"), ("start_ts", "q"), ("end_ts", "q"), ("contains", "s")),
    RECORD: (("source_id", "q"), ("ts", "q"), ("seq", "Q"), ("key", "s"), ("value", "s")),
    METRICS: (), PING: (), INSERT_OK: (), RANGE_END: (), PONG: (),
    METRICS_REPLY: (("json", "s"),),
    ERROR: (("error", "s"),),
}


class FrameError(ValueError):
    pass


def _pack(layout, row: dict) -> bytes:
    out = []
    for name, kind in layout:
        if kind == "s":
            data = row[name].encode()
            out.append(struct.pack(">I", len(data)) + data)
        else:
            out.append(struct.pack(">" + kind, row[name]))
    return b"".join(out)


def _unpack(layout, data: bytes, at: int) -> tuple[dict, int]:
    row = {}
    try:
        for name, kind in layout:
            if kind == "s":
                (n,) = struct.unpack_from(">I", data, at)
                if at + 4 + n > len(data):
                    raise FrameError("truncated frame")
                row[name] = data[at + 4 : at + 4 + n].decode()
                at += 4 + n
            else:
                (row[name],) = struct.unpack_from(">" + kind, data, at)
                at += 8
    except struct.error as e:
        raise FrameError("truncated frame") from e
    except UnicodeDecodeError as e:
        raise FrameError("invalid UTF-8 in a frame") from e
    return row, at


def encode(kind: int, row: dict | None = None) -> bytes:
    """One frame; BATCH_INSERT takes {"records": [...]}."""
    if kind == BATCH_INSERT:
        body = struct.pack(">I", len(row["records"])) + b"".join(_pack(LAYOUTS[INSERT], r) for r in row["records"])
    else:
        body = _pack(LAYOUTS[kind], row or {})
    return struct.pack(">IB", len(body) + 1, kind) + body


def decode(data: bytes) -> Iterator[tuple[int, dict]]:
    """(type, fields) of each whole frame; a torn last frame ends the stream."""
    at = 0
    while at + 4 <= len(data):
        (n,) = struct.unpack_from(">I", data, at)
        if at + 4 + n > len(data):
            return
        if n == 0:
            raise FrameError("empty frame")
        kind, body = data[at + 4], data[at + 5 : at + 4 + n]
        if kind == BATCH_INSERT:
            if len(body) < 4:
                raise FrameError("truncated frame")
            (count,), place, rows = struct.unpack_from(">I", body, 0), 4, []
            for _ in range(count):
                row, place = _unpack(LAYOUTS[INSERT], body, place)
                rows.append(row)
            yield kind, {"records": rows}
        elif kind in LAYOUTS:
            yield kind, _unpack(LAYOUTS[kind], body, 0)[0]
        else:
            raise FrameError(f"unknown message type: {kind:#04x}")
        at += 4 + n


# ---- label maps and label-stream records, as bytes


def encode_labels(labels: dict[str, str]) -> bytes:
    """u8 count, then u8 length and bytes of each key and value, in key order."""
    out = [bytes([len(labels)])]
    for k, v in sorted(labels.items()):
        for s in (k, v):
            data = s.encode()
            if not 1 <= len(data) <= 255:
                raise FrameError("label strings have 1 to 255 bytes")
            out.append(bytes([len(data)]) + data)
    return b"".join(out)


def decode_labels(data: bytes) -> tuple[dict[str, str], int]:
    """(labels, bytes used); a later pair replaces an earlier one of the same key."""
    if not data:
        raise FrameError("truncated labels")
    at, out = 1, {}
    for _ in range(data[0]):
        pair = []
        for _ in range(2):
            if at >= len(data) or at + 1 + data[at] > len(data) or not data[at]:
                raise FrameError("truncated labels")
            pair.append(data[at + 1 : at + 1 + data[at]].decode())
            at += 1 + data[at]
        out[pair[0]] = pair[1]
    return out, at


_KEY = struct.Struct(">QQQQ")


def encode_record(stream_id: int, ts: int, seq: int, source_id: int, payload: bytes) -> bytes:
    """Key (source, time, sequence, stream), u32 length, payload."""
    return _KEY.pack(source_id, ts, seq, stream_id) + struct.pack(">I", len(payload)) + payload


def decode_records(data: bytes) -> Iterator[dict]:
    """Records one after another; a torn last one ends the stream."""
    at = 0
    while at + _KEY.size + 4 <= len(data):
        source, ts, seq, stream = _KEY.unpack_from(data, at)
        (n,) = struct.unpack_from(">I", data, at + _KEY.size)
        end = at + _KEY.size + 4 + n
        if end > len(data):
            return
        yield {"stream_id": stream, "ts": ts, "seq": seq, "source_id": source, "payload": data[end - n : end]}
        at = end


def encode_journal(records: list[dict]) -> bytes:
    """A frozen journal: tag 0 and a record each, then tag 1 and the CRC-32 of all before."""
    body = b"".join(b"\0" + encode_record(**r) for r in records)
    return body + b"\1" + struct.pack(">I", zlib.crc32(body))


def decode_journal(data: bytes, frozen: bool = True) -> list[dict]:
    """Entries of a journal, checked: one checksum at most, last, matching; a frozen journal has one."""
    at, rows, sealed = 0, [], False
    while at < len(data):
        if sealed:
            raise FrameError("entry after the checksum")
        if data[at] == 0:
            found = next(decode_records(data[at + 1 :]), None)
            if found is None:
                if frozen:
                    raise FrameError("torn record in a frozen journal")
                break
            rows.append(found)
            at += 1 + _KEY.size + 4 + len(found["payload"])
        elif data[at] == 1:
            if at + 5 > len(data) or struct.unpack_from(">I", data, at + 1)[0] != zlib.crc32(data[:at]):
                raise FrameError("checksum does not match")
            sealed, at = True, at + 5
        else:
            raise FrameError(f"unknown journal tag: {data[at]}")
    if frozen and not sealed:
        raise FrameError("a frozen journal needs its checksum")
    return rows


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FrameSource(DataSource):
    """``spark.read.format("tideframes").load(folder)``: one row per message, inserts of a batch each."""

    @classmethod
    def name(cls) -> str:
        return "tideframes"

    def schema(self) -> str:
        return "file string, pos int, type int, source_id long, ts long, seq decimal(20,0), key string, value string, start_ts long, end_ts long, contains string, text string"

    def reader(self, schema):
        return _FrameReader(self.options)


class _FrameReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.skip = options["path"], options.get("broken", "fail") == "skip"

    def partitions(self):
        from pyarrow import fs

        place, at = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        found = place.get_file_info(fs.FileSelector(at, recursive=True)) if place.get_file_info(at).type == fs.FileType.Directory else [place.get_file_info(at)]
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]

    def read(self, partition):
        from decimal import Decimal

        from pyarrow import fs

        place = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        with place.open_input_file(partition.path) as f:
            data = f.read()
        pos, messages = 0, decode(data)
        while True:
            try:
                kind, row = next(messages)
            except StopIteration:
                return
            except FrameError:
                if self.skip:
                    return
                raise
            for r in row.get("records", [row]):
                seq = Decimal(r["seq"]) if "seq" in r else None
                yield (
                    partition.path, pos, kind, r.get("source_id"), r.get("ts"), seq, r.get("key"), r.get("value"),
                    r.get("start_ts"), r.get("end_ts"), r.get("contains"), r.get("json", r.get("error")),
                )
                pos += 1


def read_frames(spark: SparkSession, path: str, broken: str = "fail") -> DataFrame:
    """``broken``: "fail", or "skip" to leave out a file from where it cannot be read."""
    spark.dataSource.register(FrameSource)
    return spark.read.format("tideframes").option("broken", broken).load(path)
