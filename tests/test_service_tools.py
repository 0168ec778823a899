"""The service, journals, sorted files and tools around runs."""

import json
import threading

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog import tools
from tidelog.client import Client
from tidelog.schema import Settings
from tidelog.service import RemoteClient, Server, answer_label_requests, parse_labels
from tidelog.sources import frames, journal, sorted_files
from tidelog.sources.store import LogStore


def test_service(spark, tmp_path):
    with Server(Client(spark, str(tmp_path / "s"), Settings(range_batch=2))) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        c = RemoteClient(*server.server_address)
        assert c.ping()
        c.insert(3, 5, "disk", "first one")
        c.batch_insert([{"source_id": 3, "ts": 10 * i, "key": "disk", "value": f"read {i}"} for i in range(1, 6)])
        got = list(c.range(3, "disk", 0, 45))
        assert [(r["ts"], r["value"]) for r in got] == [(5, "first one"), (10, "read 1"), (20, "read 2"), (30, "read 3"), (40, "read 4")]
        assert [r["ts"] for r in c.range(3, "disk", 0, 100, "5")] == [50]
        with pytest.raises(RuntimeError):
            list(c.range(3, "disk", 9, 1))
        assert c.ping() and c.metrics()["server"]["connections"] == 1
        server.shutdown()


def test_label_requests(spark, tmp_path):
    import queue
    from concurrent.futures import Future

    c = Client(spark, str(tmp_path / "s"))
    c.batch_insert([{"source_id": 1, "ts": t, "key": "k", "value": f"value {t}", "labels": {"app": "web"}} for t in (1, 2, 3)])
    asked, one, two = queue.Queue(), Future(), Future()
    for x in ((parse_labels("app=web"), 2, 3, one), ({"app": "web"}, 5, 1, two), None):
        asked.put(x)
    assert answer_label_requests(c, asked) == 2 and sorted(r["ts"] for r in one.result()) == [2, 3]
    assert two.exception() is not None or list(two.result()) == []
    with pytest.raises(ValueError):
        parse_labels("app")


def test_series_journal(spark, tmp_path):
    rows = [{"source_id": 1, "ts": t, "seq": t, "key": "k", "value": f"v{t}"} for t in range(6)]
    j = journal.SeriesJournal(str(tmp_path), sync_every=2)
    assert j.append(rows[:3]) == 3 and j.rotate().endswith("inactive-000000.log")
    j.append(rows[2:5])
    j.rotate()
    j.append(rows[5:])
    j.close()
    (tmp_path / "note.txt").write_text("no journal")
    (tmp_path / "inactive-000009.log").write_bytes(frames.encode(frames.RECORD, rows[0]) + b"\0\0\0\x01\x77" + b"rest")
    assert sorted(r["seq"] for r in journal.recover_series(spark, str(tmp_path)).collect()) == [0, 1, 2, 3, 4, 5]
    j = journal.SeriesJournal(str(tmp_path))
    assert j.forget() == 3 and sorted(r["seq"] for r in journal.recover_series(spark, str(tmp_path)).collect()) == [5]


def test_stream_journal(spark, tmp_path):
    folder = str(tmp_path)
    rows = [{"stream_id": i, "ts": i, "seq": i, "source_id": 2**64 - 1, "payload": bytes([i])} for i in range(5)]
    assert journal.active_stream_journal(folder) is None
    j = journal.StreamJournal(folder)
    assert j.id == 0 and j.append(rows[:2]) == 2 and j.freeze().endswith("0.frozen.wal")
    j = journal.StreamJournal(folder)
    j.append(rows[2:4])
    with open(j.path, "ab") as f:
        f.write(b"\0torn")
    j = journal.StreamJournal(folder)
    assert j.id == 1 and j.records == rows[2:4] and j.append(rows[4:]) == 1
    got = journal.recover_streams(spark, folder).orderBy("stream_id").collect()
    assert [(r["journal"], int(r["stream_id"]), int(r["source_id"]), bytes(r["payload"])) for r in got] == [(0 if i < 2 else 1, i, 2**64 - 1, bytes([i])) for i in range(5)]
    (tmp_path / "7.active.wal").write_bytes(b"")
    with pytest.raises(frames.FrameError):
        journal.StreamJournal(folder)
    entries = spark.createDataFrame([(1, 0, False, True), (1, 1, True, True), (2, 0, True, False), (2, 1, False, False), (3, 0, False, True), (4, 0, True, True), (4, 1, True, True)], "journal long, pos int, is_checksum boolean, frozen boolean")
    assert {r["journal"]: r["fault"] for r in journal.journal_faults(entries).collect()} == {2: "entry after the checksum", 3: "no checksum", 4: "two checksums"}


def test_fnv_and_counter():
    assert sorted_files.fnv1a(b"") == 0xCBF29CE484222325 and sorted_files.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    assert sorted_files.fnv1a(b"foo", b"bar") == 0x85944171F73967E8 and sorted_files.wrapping_add(2**64 - 1, 2) == 1


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=200))
def test_bloom_never_says_no_wrongly(ids):
    b = sorted_files.Bloom.sized(len(ids))
    for i in ids:
        b.add(i)
    again = sorted_files.Bloom.decode(b.encode())
    assert all(map(again.may_hold, ids)) and again.may_hold_any([next(iter(ids)), 5])
    with pytest.raises(frames.FrameError):
        sorted_files.Bloom.decode(b.encode()[:-1])


def test_blocks():
    rows = [{"stream_id": 1, "ts": t, "seq": t, "source_id": 0, "payload": b"x" * t} for t in range(0, 20, 2)]
    data = sorted_files.encode_block(rows)
    block = sorted_files.Block(data)
    block.seek(sorted_files.order_of(rows[0] | {"ts": 7, "seq": 0}))
    assert block.peek()["ts"] == 8 and block.next()["ts"] == 8 and block.next()["ts"] == 10
    block.seek_to_first()
    assert [block.next() for _ in range(11)] == [*rows, None]
    for broken in (data[:-1], b"\1" + data[1:], b""):
        with pytest.raises(frames.FrameError):
            sorted_files.Block(broken)
    with pytest.raises(ValueError):
        sorted_files.block_limit(65_536)
    assert sorted_files.file_number("a/b/17.sst") == 17
    with pytest.raises(ValueError):
        sorted_files.file_number("17.txt")


def test_sorted_files_read_only_what_they_must(spark, tmp_path):
    import io

    rows = [{"stream_id": s, "ts": t, "seq": t, "source_id": 0, "payload": b"p"} for s in range(0, 100, 2) for t in range(50)]
    out = io.BytesIO()
    assert sorted_files.write_file(out, rows, block_records=16) == {"n": 2500, "min_ts": 0, "max_ts": 49, "n_blocks": 157}
    f = sorted_files.SortedFile(out.getvalue())
    assert list(f.scan()) == rows and f.blocks_read == 157
    f.blocks_read = 0
    assert [r["ts"] for r in f.streams([10], 20, 24)] == [20, 21, 22, 23, 24] and f.blocks_read <= 2
    f.blocks_read = 0
    missing = [i for i in range(1, 100, 2) if not f.bloom.may_hold(i)]
    assert len(missing) > 40 and list(f.streams(missing)) == [] and f.blocks_read == 0
    with pytest.raises(IndexError):
        f.read_block(157)
    with pytest.raises(ValueError):
        sorted_files.write_file(io.BytesIO(), rows[::-1])
    table = spark.createDataFrame([(r["stream_id"], r["ts"], r["seq"], 0, b"p") for r in rows], "stream_id long, ts long, seq long, source_id long, payload binary")
    manifest = sorted_files.write_sorted_files(table, str(tmp_path / "f"), 16)
    assert manifest.agg({"n": "sum"}).first()[0] == 2500
    got = sorted_files.read_sorted_files(sorted_files.read_folder(spark, str(tmp_path / "f")), [4, 5, 96], 10, 12).collect()
    assert sorted((r["stream_id"], r["ts"]) for r in got) == [(s, t) for s in (4, 96) for t in (10, 11, 12)]
    assert sorted_files.read_sorted_files(manifest).count() == 2500 and sorted_files.read_sorted_files(manifest, start=60).count() == 0


def test_snapshots_and_one_commit_per_number(spark, tmp_path):
    schema = "source_id long, ts long, seq long, key string, value string, labels map<string,string>, stream_id long"
    store = LogStore(spark, str(tmp_path / "s"), Settings(snapshot_every=2))
    for i in range(4):
        store.append(spark.createDataFrame([(1, i, i, "k", "v", {"a": "b"}, i)], schema), [(i, {"a": str(i)})])
    store.compact(force=True)
    assert store._snapshot()[0] >= 2 and store.read().count() == 4 and store.next_sequence() == 4
    assert sorted((r["stream_id"], r["labels"]["a"]) for r in store.streams().collect()) == [(i, str(i)) for i in range(4)]
    number = int(store._names("changes")[-1].partition(".")[0])
    store._names = lambda name, found=store._names: found(name)[:-1] if name == "changes" else found(name)
    with pytest.raises(Exception, match="(?i)exist"):
        store._commit([{"kind": "retention", "removed": []}])
    assert number == 4


def test_workloads(spark, tmp_path):
    ops = tools.operations(spark, "mixed", 2000, 4, 3, 8, seed=1, range_fraction=0.3)
    n = ops.where("is_range").count()
    assert 500 < n < 700 and ops.where("not is_range and length(value) != 8").count() == 0
    assert ops.repartition(7).orderBy("op_no").collect() == ops.orderBy("op_no").collect()
    assert tools.operations(spark, "write", 50, 1, 1, 1, 1).where("is_range").count() == 0 and tools.operations(spark, "read", 50, 1, 1, 1, 1).where("not is_range").count() == 0
    c = Client(spark, str(tmp_path / "s"))
    assert tools.prefill(c, spark, 30, 2, 2, 5) == 30
    said = tools.run_workload(c, tools.operations(spark, "tail", 20, 2, 2, 5, seed=3), batch=8)
    assert sum(said["counts"].values()) == 20 and sum(said["failed"].values()) == 0 and said["seconds"] > 0


def test_memory_and_metrics_text(spark):
    sampler = tools.MemorySampler(every=0.02)
    import time

    time.sleep(0.2)
    table = sampler.table(spark)
    assert table.count() >= 3 and table.where("rss_kb > 0").count() == table.count()
    text = tools.memory_text(table)
    assert "samples, growth" in text and text.count("#") > 0
    assert tools.memory_text(table.limit(0)) == "no memory samples\n"
    assert tools.metrics_text('{"a": 1, "b": {"c": 2}}').splitlines() == [f"{'a':<24} 1", "b", f"  {'c':<24} 2"]


def test_compare_and_baselines(spark, tmp_path):
    mark = {"min": 1, "p50": 2, "p90": 3, "p95": 3, "p99": 4, "p99_9": 4, "max": 5, "mean": 2.0, "stddev": 1.0, "sample_count": 9}
    run = {"workload": "write", "concurrency": 1, "insert_ops_per_sec": 100.0, "range_ops_per_sec": 0.0, "avg_records_per_range": 0.0, "sstable_count": 1, "insert_latency": mark, "range_latency": mark}
    for name, ops in (("one__old", 100.0), ("two__new", 50.0)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "benchmark_result.json").write_text(json.dumps({"results": [run | {"insert_ops_per_sec": ops}]}))
    (tmp_path / "goals.toml").write_text('[write]\n"inserts/s" = 60\n')
    old, new = (str(tmp_path / n / "benchmark_result.json") for n in ("one__old", "two__new"))
    said = []
    code = tools.compare_command(spark, old, [new], str(tmp_path / "goals.toml"), None, str(tmp_path / "cmp"), False, True, said.append)
    assert code == 1 and any("inserts/s" in x and "REGRESSED" in x and "missed" in x for x in said)
    assert any(r["regressed"] for r in json.loads((tmp_path / "cmp" / "new__vs__old.json").read_text()))
    assert tools.compare_command(spark, old, [old], None, str(tmp_path / "x.json"), "", True, True, said.append) == 0
    home = str(tmp_path / "base")
    assert tools.baseline_current(home, str(tmp_path / "one__old"), "first") == "01__first" and tools.baseline_current(home, new) == "02__baseline"
    assert tools.baseline_list(home) == [("01", "01__first", False), ("02", "02__baseline", True)]
    assert tools.baseline_switch(home, "1") == "01__first" and tools.baseline_pointer(home) == "01__first"
    assert tools.baseline_set(home, str(tmp_path / "two__new"), "first") == "01__first"
    assert '"insert_ops_per_sec": 50.0' in (tmp_path / "base" / "01__first" / "benchmark_result.json").read_text()
    with pytest.raises(LookupError):
        tools.baseline_switch(home, "nine")
    with pytest.raises(FileNotFoundError):
        tools.baseline_current(home, str(tmp_path / "none"))
    assert "tag" in tools.describe(str(tmp_path / "one__old"))
