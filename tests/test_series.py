"""Keyed series, tiers, sequence numbers: table-driven cases and a model of a sorted set."""

import random

import pytest

from tidelog.operators import series

COLUMNS = "source_id long, ts long, seq long, key string, value string"


def logs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def ts(df):
    return [r["ts"] for r in df.collect()]


def test_half_open_bounds(spark):
    df = logs(spark, [(1, 10, 0, "sys", "a"), (1, 20, 0, "sys", "b"), (1, 30, 0, "sys", "c"), (2, 10, 0, "sys", "d"), (1, 20, 0, "db", "e")])
    for start, end, want in ((10, 31, [10, 20, 30]), (5, 20, [10]), (9, 21, [10, 20]), (20, 20, []), (21, 30, []), (0, 77, [10, 20, 30])):
        assert ts(series.range_scan(df, 1, "sys", start, end)) == want
    assert ts(series.range_scan(df, 9, "sys", 0, 100)) == []


@pytest.mark.parametrize(("start", "end", "text"), [(70, 3, "before it begins"), (-4, 60, "0 or later")])
def test_bad_ranges(spark, start, end, text):
    with pytest.raises(ValueError, match=text):
        series.range_scan(logs(spark, []), 1, "sys", start, end)


def test_substring(spark):
    texts = ["tide 3.1 m, rising", "gate shut", "50% of pumps on", "a_b", "Tide out", ""]
    df = logs(spark, [(4, 7 * i, i, "harbour", t) for i, t in enumerate(texts)])
    found = lambda f: ts(series.range_scan(df, 4, "harbour", 0, 99, f))
    assert (found("tide"), found("e"), found("%"), found("_"), found("zz"), found("")) == ([0], [0, 7, 28], [14], [21], [], [0, 7, 14, 21, 28, 35])


def test_late_rows_and_duplicates(spark):
    df = logs(spark, [(2, t, i, "k", "") for i, t in enumerate((61, 84, 72, 99))] + [(2, 84, 1, "k", "")])
    assert ts(series.range_scan(df, 2, "k", 70, 90)) == [72, 84]
    assert ts(series.range_scan(df, 2, "k", 70, 90, dedup=False)) == [72, 84, 84]


def test_merge_keeps_the_newest_tier(spark):
    a, b = logs(spark, [(1, 10, 0, "k", "new"), (1, 30, 0, "k", "x")]), logs(spark, [(1, 10, 0, "k", "old"), (1, 20, 0, "k", "y")])
    got = {r["ts"]: r["value"] for r in series.merge_tiers(a, b).collect()}
    assert got == {10: "new", 20: "y", 30: "x"} and series.merge_tiers(a, b, dedup=False).count() == 4


def test_latest_point(spark):
    df = logs(spark, [(1, 100, 0, "m", "cpu: 45%"), (1, 100, 1, "m", "cpu: 45%, mem: 80%"), (1, 101, 0, "m", "z")])
    got = {r["ts"]: (r["seq"], r["value"]) for r in series.latest_point(df).collect()}
    assert got == {100: (1, "cpu: 45%, mem: 80%"), 101: (0, "z")}


def test_requests(spark):
    df = logs(spark, [(1, t, t, "k", f"v{t}") for t in range(10)])
    req = spark.createDataFrame([(1, 1, "k", 2, 5, ""), (2, 1, "k", 0, 10, "7"), (3, 1, "x", 0, 10, "")], "req_id int, source_id long, key string, start_ts long, end_ts long, contains string")
    got = sorted((r["req_id"], r["ts"]) for r in series.multi_range(df, req).collect())
    assert got == [(1, 2), (1, 3), (1, 4), (2, 7)]
    with pytest.raises(ValueError):
        series.multi_range(df, spark.createDataFrame([(1, 1, "k", 5, 2, "")], req.schema))


def test_sequence_numbers(spark):
    df = spark.createDataFrame([(x,) for x in random.Random(1).sample(range(10**6), 997)], "o long").repartition(7)
    got = sorted((r["o"], r["seq"]) for r in series.assign_sequence(df, "o", 50, slices=5).collect())
    assert [s for _, s in got] == list(range(50, 50 + 997))
    assert series.next_sequence(logs(spark, [])) == 0 and series.next_sequence(logs(spark, [(1, 1, 41, "k", "")]), logs(spark, [])) == 42


def test_ranges_agree_with_a_model(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(3), rng.randrange(50), rng.randrange(2), rng.choice("ab"), rng.choice(("foo", "bar", "foobar"))) for _ in range(300)]
    seen = {}
    for r in rows:
        seen.setdefault(r[:4], r)
    df = logs(spark, list(seen.values())).repartition(3)
    for _ in range(8):
        s, k, a, f = rng.randrange(3), rng.choice("ab"), rng.randrange(40), rng.choice(("", "oob", "bar"))
        b = a + rng.randrange(20)
        want = sorted((x[1], x[2]) for x in seen.values() if x[0] == s and x[3] == k and a <= x[1] < b and f in x[4])
        assert [(r["ts"], r["seq"]) for r in series.range_scan(df, s, k, a, b, f).collect()] == want


def test_bounds_reach_the_scan(spark, sf):
    from tidelog.plans.catalog import QUERIES

    plan = QUERIES["g1_range_filter"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("]")[0]
    assert "EqualTo(event_type,click)" in pushed and "EqualTo(user_id,7)" in pushed and "StringContains(props,5)" in pushed
    assert "GreaterThanOrEqual(ts," in pushed and "LessThan(ts," in pushed
