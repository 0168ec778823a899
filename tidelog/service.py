"""A log service over TCP: frames in, the client's calls, frames out; a client for it, and both as commands.

    python -m tidelog.service serve ROOT [--port 7700] [--memory-mb 32] [--command-batch 512] [--range-batch 1024]
    python -m tidelog.service ping|insert|range|metrics --port 7700 ...

Inserts of all connections meet in one bounded queue.  One worker takes up to ``command_batch`` of them at
a time, appends them to the store in one set and then answers; a full queue makes connections wait.  The
same worker compacts when the store has grown enough.  Ranges run in their connection's thread and are
sent ``range_batch`` records at a time, as the socket takes them.
"""

from __future__ import annotations

import argparse
import json
import logging
import queue
import socket
import socketserver
import struct
import threading
from collections.abc import Callable, Iterator
from concurrent.futures import Future

from .client import Client
from .schema import Settings
from .sources import frames

log = logging.getLogger("tidelog.service")
#: Longest frame that is taken from a connection.
MAX_FRAME_BYTES = 64 << 20


def read_frames(receive: Callable[[int], bytes]) -> Iterator[tuple[int, dict]]:
    """Messages of a connection; a connection that ends inside a frame has ended."""
    while len(head := receive(4)) == 4:
        (n,) = struct.unpack(">I", head)
        if n > MAX_FRAME_BYTES:
            raise frames.FrameError(f"a frame of {n} bytes")
        body = receive(n)
        if len(body) < n:
            return
        yield from frames.decode(head + body)


class Worker(threading.Thread):
    """Appends what is queued, in groups, and compacts."""

    def __init__(self, client: Client, settings: Settings, waiting: int = 8192):
        super().__init__(daemon=True)
        self.client, self.settings = client, settings
        self.queue: queue.Queue = queue.Queue(maxsize=waiting)

    def submit(self, records: list[dict]) -> Future:
        """Waits while the queue is full; the result is the number of records taken."""
        done: Future = Future()
        self.queue.put((records, done))
        return done

    def stop(self) -> None:
        self.queue.put(None)
        self.join()

    def run(self) -> None:
        going = True
        while going:
            group = [self.queue.get()]
            while len(group) < self.settings.command_batch:
                try:
                    group.append(self.queue.get_nowait())
                except queue.Empty:
                    break
            going = None not in group
            group = [g for g in group if g is not None]
            if not group:
                continue
            try:
                self.client.batch_insert([r for records, _ in group for r in records])
                for records, done in group:
                    done.set_result(len(records))
                self.client.store.compact()
            except Exception as e:  # the callers are told; the worker goes on
                log.exception("appending failed")
                for _, done in group:
                    if not done.done():
                        done.set_exception(e)


class Handler(socketserver.StreamRequestHandler):
    """One connection: dispatches the five commands."""

    def handle(self) -> None:
        server, counts = self.server, self.server.counts
        counts["connections"] += 1
        try:
            for kind, row in read_frames(self.rfile.read):
                counts["frames_read"] += 1
                try:
                    for reply in self._answer(kind, row):
                        self.wfile.write(reply)
                        counts["frames_written"] += 1
                except (ConnectionError, BrokenPipeError):
                    return
                except Exception as e:
                    self.wfile.write(frames.encode(frames.ERROR, {"error": f"{type(e).__name__}: {e}"}))
                    counts["frames_written"] += 1
        except frames.FrameError as e:
            self.wfile.write(frames.encode(frames.ERROR, {"error": str(e)}))
        finally:
            counts["connections"] -= 1

    def _answer(self, kind: int, row: dict) -> Iterator[bytes]:
        server = self.server
        if kind in (frames.INSERT, frames.BATCH_INSERT):
            server.worker.submit(row.get("records", [row])).result()
            yield frames.encode(frames.INSERT_OK)
        elif kind == frames.RANGE:
            found = server.client.range(row["source_id"], row["key"], row["start_ts"], row["end_ts"], row["contains"])
            held = []
            for r in server.client.rows(found.orderBy("ts", "seq")):
                held.append(frames.encode(frames.RECORD, r.asDict()))
                if len(held) >= server.client.settings.range_batch:
                    yield b"".join(held)
                    held = []
            yield b"".join([*held, frames.encode(frames.RANGE_END)])
        elif kind == frames.METRICS:
            yield frames.encode(frames.METRICS_REPLY, {"json": json.dumps(json.loads(server.client.metrics()) | {"server": dict(server.counts)})})
        elif kind == frames.PING:
            yield frames.encode(frames.PONG)
        else:
            raise ValueError(f"no request: {kind:#04x}")


class Server(socketserver.ThreadingTCPServer):
    """Serves a client's store until ``shutdown``."""

    allow_reuse_address = daemon_threads = True

    def __init__(self, client: Client, host: str = "127.0.0.1", port: int = 0):
        self.client, self.worker = client, Worker(client, client.settings)
        self.counts = {"connections": 0, "frames_read": 0, "frames_written": 0}
        super().__init__((host, port), Handler)
        self.worker.start()

    def server_close(self) -> None:
        super().server_close()
        self.worker.stop()


def answer_label_requests(client: Client, requests: queue.Queue, most: int = 64) -> int:
    """Takes what is queued, up to ``most`` (labels, start, end, Future) at a time, until None; each result is an iterator."""
    answered, going = 0, True
    while going:
        group = [requests.get()]
        while len(group) < most and not requests.empty():
            group.append(requests.get())
        going = None not in group
        for labels, start, end, done in (g for g in group if g is not None):
            try:
                done.set_result(client.rows(client.label_range(labels, start, end)))
            except Exception as e:
                done.set_exception(e)
            answered += 1
    return answered


def parse_labels(text: str) -> dict[str, str]:
    """``a=b,c=d`` as labels."""
    out = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        name, eq, value = part.partition("=")
        if not eq or not name or not value:
            raise ValueError(f"no label: {part!r}")
        out[name] = value
    return out


class RemoteClient:
    """The calls of a client over a connection; tries to connect for ``patience`` seconds."""

    def __init__(self, host: str, port: int, patience: float = 30.0):
        import time

        end = time.monotonic() + patience
        while True:
            try:
                self._socket = socket.create_connection((host, port), timeout=600)
                break
            except OSError:
                if time.monotonic() > end:
                    raise
                time.sleep(0.2)
        self._file = self._socket.makefile("rb")
        self._frames = read_frames(self._file.read)

    def _ask(self, kind: int, row: dict | None = None) -> tuple[int, dict]:
        self._socket.sendall(frames.encode(kind, row))
        return self._reply()

    def _reply(self) -> tuple[int, dict]:
        kind, row = next(self._frames)
        if kind == frames.ERROR:
            raise RuntimeError(row["error"])
        return kind, row

    def ping(self) -> bool:
        return self._ask(frames.PING)[0] == frames.PONG

    def insert(self, source_id: int, ts: int, key: str, value: str) -> None:
        self._ask(frames.INSERT, {"source_id": source_id, "ts": ts, "key": key, "value": value})

    def batch_insert(self, records: list[dict]) -> None:
        self._ask(frames.BATCH_INSERT, {"records": records})

    def range(self, source_id: int, key: str, start: int, end: int, contains: str = "") -> Iterator[dict]:
        kind, row = self._ask(frames.RANGE, {"source_id": source_id, "key": key, "start_ts": start, "end_ts": end, "contains": contains})
        while kind == frames.RECORD:
            yield row
            kind, row = self._reply()

    def metrics(self) -> dict:
        return json.loads(self._ask(frames.METRICS)[1]["json"])

    def close(self) -> None:
        self._file.close()
        self._socket.close()


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidelog.service")
    parser.add_argument("--host", default="127.0.0.1")
    parser.add_argument("--port", type=int, default=7700)
    parser.add_argument("--verbose", action="store_true")
    commands = parser.add_subparsers(dest="command", required=True)
    serve = commands.add_parser("serve")
    serve.add_argument("root")
    for name, default in (("memory-mb", 32), ("command-batch", 512), ("range-batch", 1024), ("max-files", 8)):
        serve.add_argument(f"--{name}", type=int, default=default)
    commands.add_parser("ping")
    commands.add_parser("metrics")
    insert, ranged = commands.add_parser("insert"), commands.add_parser("range")
    for p, names in ((insert, ("source_id", "ts", "key", "value")), (ranged, ("source_id", "key", "start", "end"))):
        for n in names:
            p.add_argument(n, type=str if n in ("key", "value") else int)
    ranged.add_argument("--contains", default="")
    said = parser.parse_args(args)
    logging.basicConfig(level=logging.DEBUG if said.verbose else logging.INFO)
    if said.command == "serve":
        from .session import session

        settings = Settings(memory_mb=said.memory_mb, command_batch=said.command_batch, range_batch=said.range_batch, max_files=said.max_files)
        with Server(Client(session(), said.root, settings), said.host, said.port) as server:
            server.serve_forever()
        return 0
    client = RemoteClient(said.host, said.port)
    if said.command == "ping":
        print("pong" if client.ping() else "no answer")
    elif said.command == "metrics":
        print(json.dumps(client.metrics(), indent=1))
    elif said.command == "insert":
        client.insert(said.source_id, said.ts, said.key, said.value)
    else:
        for r in client.range(said.source_id, said.key, said.start, said.end, said.contains):
            print(f"source={r['source_id']}, ts={r['ts']}, seq={r['seq']}: key={r['key']} value={r['value']}")
    client.close()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
