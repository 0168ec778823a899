"""WARC archives: written from pages, read back, records assembled into transactions.

A capture is written as three records: the response (or, where an earlier-chosen capture has the same
payload, a revisit that refers to it), the request and a metadata record; request and metadata name
the response in WARC-Concurrent-To.  Each record is a gzip member of its own.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exact_dedup import exact_dedup
from .shared import new_folder, one_task_each, open_shared, replace_file, task_label, written

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_RECORD_FIELDS = (
    "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, date string, "
    "payload_digest string, payload_bytes long, http_head string, fields map<string,string>, archive string, place long"
)


def record_id(page_id, digest: str, repeat: int, kind: str) -> str:
    h = hashlib.md5(f"{page_id}/{digest}/{repeat}/{kind}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(kind: str, own_id: str, uri: str, date: str, block: bytes, content_type: str, extra: dict[str, str]) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": own_id, "WARC-Date": date, "WARC-Target-URI": uri} | extra
    head |= {"Content-Type": content_type, "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def member(record: bytes, level: int = 5) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(record) + pack.flush()


def capture_records(page_id, repeat: int, url: str | None, payload: bytes, keep_id, date: str) -> list[bytes]:
    """The response or revisit, the request and the metadata record of one capture."""
    uri = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url or "") or "about:blank"
    digest = digest_of(payload)
    response = record_id(page_id, digest, repeat, "response")
    with_it = {"WARC-Concurrent-To": response}
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    said = {"WARC-Payload-Digest": f"sha1:{digest}"}
    rest = re.sub(r"^\w+://", "", uri)
    host, _, path = rest.partition("/")
    get = f"GET /{path.partition('#')[0]} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    fields = f"page-id: {page_id}\r\n".encode()
    if keep_id == page_id and not repeat:
        first = record_bytes("response", response, uri, date, http + payload, "application/http;msgtype=response", said)
    else:
        said |= {"WARC-Refers-To": record_id(keep_id, digest, 0, "response"), "WARC-Profile": _PROFILE}
        first = record_bytes("revisit", response, uri, date, http, "application/http;msgtype=response", said)
    return [
        first,
        record_bytes("request", record_id(page_id, digest, repeat, "request"), uri, date, get, "application/http;msgtype=request", with_it),
        record_bytes("metadata", record_id(page_id, digest, repeat, "metadata"), uri, date, fields, "application/warc-fields", with_it),
    ]


def write_archives(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One archive per partition; returns the manifest (path, n_captures, n_bytes).

    Of captures with equal payloads (null: empty, which is a payload too) the one of the largest
    page_id is written in full and the others as revisits.  A page_id that comes again with an equal
    payload revisits its first row.  An empty table gives no archive.  Null page_ids are written as -1.
    """
    import pyarrow as pa

    folder = new_folder(pages.sparkSession, "warc")
    rows = pages.select(
        F.coalesce("page_id", F.lit(-1)).cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce("html", F.lit("")).cast("binary").alias("payload"),
    )
    chosen = exact_dedup(rows, content="payload", id_col="page_id", keep="largest")
    chosen = chosen.select("page_id", F.unhex("text_sha256").alias("digest"), "keep_id").dropDuplicates(["page_id", "digest"])
    # The payloads are dealt once, for the join and for the archives.
    both = rows.withColumn("digest", F.unhex(F.sha2("payload", 256))).repartition("page_id", "digest").join(chosen, ["page_id", "digest"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = task_label()
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        path = f"{folder}/captures-{part:06d}.warc.gz"
        n_captures = n_bytes = 0
        before, repeat = None, 0
        with replace_file(path, attempt) as out:
            info = record_bytes("warcinfo", record_id(part, "", 0, "warcinfo"), "about:blank", date, b"format: WARC File Format 1.1\r\n", "application/warc-fields", {})
            out.write(member(info))
            batch = first
            while batch is not None:
                for begin in range(0, batch.num_rows, 200):
                    for row in batch.slice(begin, 200).to_pylist():
                        repeat = repeat + 1 if before == (row["page_id"], row["digest"]) else 0
                        before = (row["page_id"], row["digest"])
                        for record in capture_records(row["page_id"], repeat, row["url"], row["payload"], row["keep_id"], date):
                            n_bytes += out.write(member(record)) or 0
                        n_captures += 1
                batch = next(batches, None)
        yield pa.RecordBatch.from_pydict({"path": [path], "n_captures": [n_captures], "n_bytes": [n_bytes]})

    ordered = both.sortWithinPartitions("page_id", "digest", "url")
    return written(ordered.mapInArrow(write, "path string, n_captures long, n_bytes long"), "archives")


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a WARC stream, gzipped or not; holds one record."""
    import gzip
    import io

    buffered = io.BufferedReader(stream) if not isinstance(stream, io.BufferedReader) else stream
    if buffered.peek(2)[:2] == b"\x1f\x8b":
        buffered = io.BufferedReader(gzip.GzipFile(fileobj=buffered), 1 << 16)
    while line := buffered.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := buffered.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            head[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        block = buffered.read(int(head.get("content-length", 0)))
        if len(block) < int(head.get("content-length", 0)):
            raise ValueError("a record is cut off")
        yield head, block


def read_records(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives of the manifest's ``path`` column.

    The digest and the size of a response are those of its payload as read, and the digest must agree
    with its header; a revisit, which has no payload, has those that its headers state.
    """
    import pyarrow as pa

    kinds = {"fields": pa.map_(pa.string(), pa.string()), "payload_bytes": pa.int64(), "place": pa.int64(), "payload": pa.binary()}
    declared = _RECORD_FIELDS + (", payload binary" if with_payload else "")
    names = [x.split()[0] for x in declared.split(", ")]
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])

    def row_of(head: dict[str, str], block: bytes, archive: str, place: int) -> dict:
        kind = head.get("warc-type", "")
        digest, size, http, fields, payload = head.get("warc-payload-digest", "").rpartition(":")[2] or None, None, None, None, None
        if kind in ("response", "revisit", "request"):
            start, _, payload = block.partition(b"\r\n\r\n")
            http = start.decode("utf-8", "replace")
        if kind == "response":
            size = len(payload)
            if digest not in (None, found := digest_of(payload)):
                raise ValueError(f"{head.get('warc-record-id')}: payload does not have its digest")
            digest = found
        elif kind == "revisit" and (m := re.search(r"(?im)^content-length:\s*(\d+)", http)):
            size = int(m[1])
        elif kind in ("metadata", "warcinfo"):
            lines = (x.partition(":") for x in block.decode("utf-8", "replace").splitlines() if ":" in x)
            fields = list({k.strip(): v.strip() for k, _, v in lines}.items())
        values = (
            head.get("warc-record-id"), kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"),
            head.get("warc-date"), digest, size, http, fields, archive, place, payload,
        )
        return dict(zip([*names, *(() if with_payload else ("payload",))], values))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = open_shared(path)
                rows, held = [], 0
                with fs.open_input_file(name) as source:
                    for place, (head, block) in enumerate(records_of(source)):
                        rows.append({n: v for n, v in row_of(head, block, path, place).items() if n in schema.names})
                        held += len(block) if with_payload else 200
                        if held > 4_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return one_task_each(archives.select("path")).mapInArrow(read, declared)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, response, request, metadata).

    Records belong together if they are concurrent to the same record, or are that record.  A capture
    may lack any of the three (null, or an empty list for metadata); of several responses or requests
    under one identifier the one first in its archive stands, and all metadata records are kept.
    """
    kept = [f.name for f in records.schema.fields if f.name not in ("concurrent_to", "record_type")]
    record = F.struct(F.col("archive").alias("_a"), F.col("place").alias("_p"), "record_type", *kept)
    kind = F.col("record_type")
    return (
        records.where(kind.isin("response", "revisit", "request", "metadata"))
        .withColumn("capture_id", F.coalesce("concurrent_to", "record_id"))
        .drop("fields" if "fields" not in kept else "")
        .groupBy("capture_id")
        .agg(
            F.min_by(F.when(kind.isin("response", "revisit"), record), F.when(kind.isin("response", "revisit"), F.struct("archive", "place"))).alias("response"),
            F.min_by(F.when(kind == "request", record), F.when(kind == "request", F.struct("archive", "place"))).alias("request"),
            F.collect_list(F.when(kind == "metadata", F.struct("record_id", "fields"))).alias("metadata"),
        )
        .withColumn("response", F.when(F.col("response").isNotNull(), F.col("response").dropFields("_a", "_p")))
        .withColumn("request", F.when(F.col("request").isNotNull(), F.col("request").dropFields("_a", "_p")))
    )


def capture_table(captures: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): what the captures of pages say."""
    page = captures.select(
        F.col("metadata")[0]["fields"]["page-id"].cast("long").alias("page_id"),
        F.col("response.record_id").alias("response_id"),
        F.col("response.refers_to").alias("target"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
    )
    page = written(page, "captures")
    full = page.where("record_type = 'response'").select(F.col("response_id").alias("target"), F.col("page_id").alias("refers_to"))
    return page.join(full, "target", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
