import pytest
from pyspark.sql import functions as F

from tidelog.functions.columns import labels_text
from tidelog.operators import streams

RECORDS = "source_id long, ts long, seq long, key string, value string, labels map<string,string>"


@pytest.fixture(scope="module")
def records(spark):
    a, b, c = {"app": "x", "env": "p"}, {"env": "q", "app": "x"}, {"app": "y"}
    rows = [(1, 10 * i, i, "k", f"v{i}", m) for i, m in enumerate((b, a, b, c, a, b))]
    return spark.createDataFrame(rows, RECORDS)


@pytest.fixture(scope="module")
def registry(records):
    return streams.build_registry(records).cache()


def test_ids_are_in_order_of_first_sight(registry):
    got = {r["t"]: r["stream_id"] for r in registry.select("stream_id", labels_text("labels").alias("t")).collect()}
    assert got == {"app=x,env=q": 0, "app=x,env=p": 1, "app=y": 2}


def test_known_streams_keep_their_ids(records, registry):
    more = streams.build_registry(records, registry.where("stream_id = 2"))
    got = {r["t"]: r["stream_id"] for r in more.select("stream_id", labels_text("labels").alias("t")).collect()}
    assert got == {"app=y": 2, "app=x,env=q": 3, "app=x,env=p": 4}


def test_index_and_matching(registry):
    index = {(r["label_key"], r["label_value"]): r["streams"] for r in streams.inverted_index(registry).collect()}
    assert index == {("app", "x"): [0, 1], ("app", "y"): [2], ("env", "p"): [1], ("env", "q"): [0]}
    match = lambda labels, **k: sorted(r["stream_id"] for r in streams.match_streams(registry, labels, **k).collect())
    assert match({"app": "x"}) == [0, 1] and match({"app": "x", "env": "q"}) == [0] and match({}) == []
    assert match({"app": "x", "zone": "z"}) == [] and match({"app": "x", "zone": "z"}, strict=False) == [0, 1]
    assert match({"zone": "z"}, strict=False) == [] and match({}, strict=False) == []


def test_label_range(records, registry):
    placed = streams.resolve_streams(records, registry)
    seqs = lambda labels, *b: [r["seq"] for r in streams.label_range(placed, registry, labels, *b).collect()]
    assert seqs({"app": "x"}) == [0, 2, 5, 1, 4]
    assert seqs({"app": "x"}, 10, 40) == [2, 1, 4] and seqs({"app": "x"}, 20, None) == [2, 5, 4] and seqs({"app": "x"}, None, 0) == [0]
    with pytest.raises(ValueError):
        streams.label_range(placed, registry, {"app": "x"}, 5, 1)
    repeated = placed.unionByName(placed)
    assert streams.label_range(repeated, registry, {"app": "y"}).count() == 1
    assert streams.label_range(repeated, registry, {"app": "y"}, dedup=False).count() == 2


def test_orphans_keep_null_labels(records, registry):
    placed = streams.resolve_streams(records, registry).drop("labels")
    found = streams.attach_labels(placed, registry.where("stream_id != 1"))
    assert found.where("labels is null").count() == 2 and found.count() == 6


def test_large_registries_are_not_broadcast(records, registry, monkeypatch):
    monkeypatch.setattr(streams, "BROADCAST_STREAMS", 1)
    placed = streams.resolve_streams(records, registry)
    assert "hint" not in placed._jdf.queryExecution().logical().toString().lower()
    assert placed.where("stream_id is null").count() == 0
    assert streams.cardinality(placed, registry).where("label_key = 'app'").select(F.sum("n_records")).first()[0] == 6
