"""Token-ID files: blocks of ids transposed into planes, each compressed on its own.

A file is, in this order:

    magic "TIDEPLN1"
    blocks      each: the block's planes, one zstandard frame per plane, end to end
    documents   a zstandard frame of the doc_ids (little-endian int64), one of the lengths, and one of
                a byte per document that is 1 where it has no doc_id
    index       a zstandard frame of JSON: plane kind, ids per block, for each block its place in the
                file, its number of ids and its planes' sizes, and the sizes of the document frames
    the index frame's size (little-endian uint64), magic

An id is 32 bits.  "byte" planes hold the n-th byte of every id of a block; "bit" planes the n-th bit
of every id, eight to a byte.  High planes are mostly zero and cost almost nothing.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_folder, one_task_each, open_shared, replace_file, task_label, written

MAGIC = b"TIDEPLN1"


def planes_of(ids, kind: str) -> list[bytes]:
    import numpy as np

    as_bytes = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(as_bytes[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(as_bytes, axis=1, bitorder="little")
    return [np.packbits(np.ascontiguousarray(bits[:, k]), bitorder="little").tobytes() for k in range(32)]


def ids_of(planes: list[bytes], n: int, kind: str):
    import numpy as np

    if kind == "byte":
        rows = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        rows = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(rows).view("<u4").reshape(-1)


def write_file(out, documents: Iterable[tuple[int | None, bytes]], block_ids: int = 65_536, kind: str = "byte", level: int = 3) -> tuple[int, int]:
    """Writes (doc_id, ids in bytes) in the given order; returns the numbers of documents and ids.

    Holds one block, the document table and one document at a time.
    """
    import numpy as np
    import zstandard

    pack = zstandard.ZstdCompressor(level=level).compress
    out.write(MAGIC)
    at, blocks, doc_ids, lengths, waiting = len(MAGIC), [], [], [], bytearray()

    def flush(part: bytes) -> None:
        nonlocal at
        frames = [pack(p) for p in planes_of(np.frombuffer(part, "<u4"), kind)]
        blocks.append([at, len(part) // 4, [len(f) for f in frames]])
        for frame in frames:
            out.write(frame)
            at += len(frame)

    for doc_id, ids in documents:
        doc_ids.append(doc_id)
        lengths.append(len(ids) // 4)
        waiting += ids
        while len(waiting) >= 4 * block_ids:
            flush(bytes(waiting[: 4 * block_ids]))
            del waiting[: 4 * block_ids]
    if waiting:
        flush(bytes(waiting))
    columns = ([i or 0 for i in doc_ids], lengths)
    tables = [*(pack(np.asarray(x, "<i8").tobytes()) for x in columns), pack(bytes(i is None for i in doc_ids))]
    head = {"planes": kind, "block_ids": block_ids, "blocks": blocks, "documents": [at, len(doc_ids), [len(t) for t in tables]]}
    index = pack(json.dumps(head).encode())
    for part in (*tables, index, len(index).to_bytes(8, "little"), MAGIC):
        out.write(part)
    return len(doc_ids), sum(lengths)


class TokenFile:
    """Reads a file through its chunk index; any block can be read alone."""

    def __init__(self, source):
        import numpy as np
        import zstandard

        self._source, self._open = source, zstandard.ZstdDecompressor().decompress
        size = source.size()
        tail = source.read_at(16, size - 16)
        if tail[8:] != MAGIC or source.read_at(8, 0) != MAGIC:
            raise ValueError("not a token file")
        n = int.from_bytes(tail[:8], "little")
        self.index = json.loads(self._open(source.read_at(n, size - 16 - n)))
        at, _, (a, b, c) = self.index["documents"]
        ids = np.frombuffer(self._open(source.read_at(a, at)), "<i8").tolist()
        self.lengths = np.frombuffer(self._open(source.read_at(b, at + a)), "<i8")
        self.doc_ids = [None if gone else i for i, gone in zip(ids, self._open(source.read_at(c, at + a + b)))]

    def block(self, k: int):
        at, n, sizes = self.index["blocks"][k]
        planes = []
        for size in sizes:
            planes.append(self._open(self._source.read_at(size, at)))
            at += size
        return ids_of(planes, n, self.index["planes"])

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        """(doc_id, ids in bytes), in file order; holds one block and one document."""
        waiting, k = bytearray(), 0
        for doc_id, n in zip(self.doc_ids, self.lengths.tolist()):
            while len(waiting) < 4 * n:
                waiting += self.block(k).tobytes()
                k += 1
            yield doc_id, bytes(waiting[: 4 * n])
            del waiting[: 4 * n]


def write_token_files(df: DataFrame, vocabulary: str, end_id: int, kind: str = "byte", block_ids: int = 65_536) -> DataFrame:
    """Encodes ``text`` and writes files in ascending doc_id order; returns their manifest.

    Manifest: (path, shard, n_docs, n_ids, start), a row per file, ``start`` counting the ids of all
    files before.  A null text is encoded as empty; documents without a doc_id come first
    and have none in the file either.
    Rows of one doc_id stay together, in the order of their texts.  An empty table gives no file.
    """
    import pyarrow as pa

    folder = new_folder(df.sparkSession, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .encoding import encoder_for

        shard, attempt = task_label()
        encoder, end = encoder_for(vocabulary), end_id.to_bytes(4, "little")

        def documents(first):
            while first is not None:
                for start in range(0, first.num_rows, 1000):
                    part = first.slice(start, 1000)
                    texts = part.column(1).to_pylist()
                    for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode_batch(texts)):
                        yield doc_id, ids + end
                first = next(batches, None)

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        path = f"{folder}/shard-{shard:06d}.tide"
        with replace_file(path, attempt) as out:
            n_docs, n_ids = write_file(out, documents(first), block_ids, kind)
        yield pa.RecordBatch.from_pydict({"path": [path], "shard": [shard], "n_docs": [n_docs], "n_ids": [n_ids]})

    ordered = (
        df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    files = written(ordered.mapInArrow(write, "path string, shard long, n_docs long, n_ids long"), "manifest")
    from pyspark.sql import Window

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard) per document, read back from the files."""
    import pyarrow as pa

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = open_shared(row["path"])
                start, rows = row["start"], {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": [], "shard": []}
                with fs.open_input_file(path) as source:
                    for doc_id, ids in TokenFile(source).documents():
                        for name, value in zip(rows, (doc_id, start, len(ids) // 4, zlib.crc32(ids), row["shard"])):
                            rows[name].append(value)
                        start += len(ids) // 4
                yield pa.RecordBatch.from_pydict(rows, schema=out)

    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int64())])
    files = one_task_each(manifest.select("path", "shard", "start"))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")
