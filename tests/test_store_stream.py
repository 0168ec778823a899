import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.client import Client
from tidelog.operators import validation
from tidelog.schema import Settings
from tidelog.sources import adapters, frames
from tidelog.sources.store import LogStore
from tidelog.streaming.ingest import append_batch, ingest

ROWS = "source_id long, ts long, seq long, key string, value string, labels map<string,string>"
DAY = 86_400_000_000


def batch(spark, rows):
    return spark.createDataFrame([(s, t, q, k, v, {"app": k}) for s, t, q, k, v in rows], ROWS)


def test_append_compact_retain(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "s"), Settings(max_files=4))
    assert store.read().count() == 0 and store.next_sequence() == 0
    for day in range(3):
        append_batch(store, batch(spark, [(1, day * DAY + i, i, "k", f"v{i}") for i in range(5)]))
    assert store.read().count() == 15 and store.next_sequence() == 15
    assert sorted(r["seq"] for r in store.read().collect()) == list(range(15))
    assert store.compact() is None and store.compact(force=True) is not None
    assert store.read().count() == 15 and store.live().count() == 2
    assert store.read(DAY, 2 * DAY).count() == 5
    assert "PartitionFilters: [" in store.read(DAY, 2 * DAY)._jdf.queryExecution().executedPlan().toString()
    assert store.retain(now_us=2 * DAY, days=1) == []  # the oldest set's last record is of the second day
    assert store.retain(now_us=9 * DAY, days=7) != [] and store.read().count() == 5
    assert store.vacuum() != [] and store.read().count() == 5
    assert [(r["stream_id"], r["labels"]) for r in store.streams().collect()] == [(0, {"app": "k"})]
    assert store.next_sequence() == 15 and store.bytes() > 0


def test_replays_and_bad_rows(spark, tmp_path):
    store, kept = LogStore(spark, str(tmp_path / "s")), []
    rows = batch(spark, [(1, 5, 0, "k", "ok"), (1, -5, 1, "k", "bad time"), (1, 6, 2, "k", "x"), (1, 7, 3, "k", "y" * 5000)])
    take = lambda bad: kept.extend(r["reason"] for r in bad.collect())
    assert append_batch(store, rows, keep_sequence=True, quarantine=take) == 1
    assert sorted(kept) == ["bad_ts", "too_large", "too_small"]
    assert append_batch(store, rows, keep_sequence=True) == 0 and store.read().count() == 1


def test_stream_restarts(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "s"))
    rows = batch(spark, [(1, t, i, "k", "value") for i, t in enumerate((15, 25, 20, 45))])
    for n in range(2):
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        ingest(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "c")).awaitTermination()
    assert sorted(r["ts"] for r in store.read().collect()) == [15, 20, 25, 45]


def test_client(spark, tmp_path):
    c = Client(spark, str(tmp_path / "c"))
    assert c.ping() and c.insert(1, 10, "sys", "first") == 1
    assert c.batch_insert([{"source_id": 1, "ts": 10 * i, "key": "sys", "value": f"value {i}", "labels": {"app": "a"}} for i in range(2, 10)]) == 8
    got = [(r["ts"], r["seq"]) for r in c.rows(c.range(1, "sys", 20, 60))]
    assert got == [(20, 1), (30, 2), (40, 3), (50, 4)]
    assert c.range(1, "sys", 0, 100, "first").count() == 1 and c.label_range({"app": "a"}, 20, 40).count() == 3
    with pytest.raises(ValueError):
        c.range(1, "sys", 10, 5)
    assert '"inserts": 9' in c.metrics()


def test_json_batch(spark, tmp_path):
    (tmp_path / "b.json").write_text('[{"source_id": 1, "ts": 2, "key": "k", "value": "v"}]')
    assert tuple(adapters.json_batch(spark, str(tmp_path / "b.json")).first()) == (1, 2, "k", "v")


def test_adapters(spark, sf):
    for name in adapters.ADAPTERS:
        df = adapters.logs(spark, sf, name)
        assert df.columns[:6] == ["source_id", "ts", "seq", "key", "value", "labels"] and df.count() > 0


def test_limits(spark):
    df = spark.createDataFrame([("a", {"k": "v" * 255}), ("ab", {"k": ""}), ("é", {"k": "v" * 256}), ("x" * 4097, {})], "p string, labels map<string,string>")
    got = df.select(validation.payload_status("p"), validation.label_status("labels")).collect()
    assert [tuple(r) for r in got] == [("too_small", "accepted"), ("accepted", "bad_label"), ("accepted", "bad_label"), ("too_large", "no_labels")]


def test_frames_by_data_source(spark, tmp_path):
    data = frames.encode(frames.INSERT, {"source_id": -1, "ts": 5, "key": "k", "value": "é"})
    data += frames.encode(frames.BATCH_INSERT, {"records": [{"source_id": i, "ts": i, "key": "b", "value": ""} for i in range(3)]})
    data += frames.encode(frames.RANGE, {"source_id": 1, "key": "k", "start_ts": 1, "end_ts": 2, "contains": "x"}) + frames.encode(frames.ERROR, {"error": "no"})
    (tmp_path / "f.bin").write_bytes(data + b"\0\0\0\x10\x01")
    rows = frames.read_frames(spark, str(tmp_path)).orderBy("pos").collect()
    assert [r["type"] for r in rows] == [1, 3, 3, 3, 2, 255] and rows[0]["value"] == "é" and rows[4]["contains"] == "x" and rows[5]["text"] == "no"


text = st.text(max_size=20)
i64 = st.integers(-(2**63), 2**63 - 1)
u64 = st.integers(0, 2**64 - 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.fixed_dictionaries({"source_id": i64, "ts": i64, "seq": u64, "key": text, "value": text}), max_size=5), st.integers(0, 30))
def test_frames_round_trip_and_torn_tails(rows, cut):
    whole = [frames.encode(frames.RECORD, r) for r in rows]
    data = b"".join(whole)
    assert [r for _, r in frames.decode(data)] == rows
    if whole and cut:
        torn = data[: -min(cut, len(whole[-1]) - 1)]
        assert [r for _, r in frames.decode(torn)] == rows[:-1]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=60))
def test_decoding_never_does_anything_but_complain(data):
    for f in (lambda d: list(frames.decode(d)), lambda d: list(frames.decode_records(d)), frames.decode_labels, frames.decode_journal):
        try:
            f(data)
        except (frames.FrameError, UnicodeDecodeError):
            pass


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.text(min_size=1, max_size=20), st.text(min_size=1, max_size=20), max_size=6))
def test_labels_round_trip(labels):
    data = frames.encode_labels(labels)
    assert frames.decode_labels(data + b"body") == (labels, len(data))


def test_journals():
    rows = [{"stream_id": i, "ts": i, "seq": i, "source_id": 2**64 - 1, "payload": bytes(i)} for i in range(4)]
    data = frames.encode_journal(rows)
    assert frames.decode_journal(data) == rows and list(frames.decode_records(frames.encode_record(**rows[3])[:-1])) == []
    open_part = data[:-5]
    assert frames.decode_journal(open_part, frozen=False) == rows
    for broken in (open_part, data + b"\0", data[:-1] + b"x", b"\2" + data):
        with pytest.raises(frames.FrameError):
            frames.decode_journal(broken)
    with pytest.raises(frames.FrameError):
        frames.encode_labels({"k": "v" * 256})
    with pytest.raises(frames.FrameError):
        list(frames.decode(frames.encode(frames.PING)[:4] + b"\x77"))
