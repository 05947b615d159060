import datetime as dt
import math
import random

import duckdb
import pytest

from loomline.llm import rolling

SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, event string, us double, series int, part string"
T0 = dt.datetime(2024, 3, 31, 1, 30)


def table(spark, rows):
    return spark.createDataFrame([(i, t, t, 1, k, v, "{}", "e", 0.5, 3, "p") for i, t, k, v in rows], SCHEMA).repartition(3)


def brute(rows):
    """Every id once, windows by scanning all of the series."""
    one = {}
    for i, t, k, v in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or 0)):
        one.setdefault(i, (t, k, None if v is None or not math.isfinite(v) or abs(100 * v) >= 2**58 else math.floor(100 * v + 0.5)))
    out = []
    double = lambda s: s[(len(s) - 1) // 2] + s[len(s) // 2]
    for i, (t, k, c) in one.items():
        w = sorted(x for u, kk, x in one.values() if kk == k and x is not None and t - dt.timedelta(minutes=60) <= u <= t)
        m = d = far = None
        if len(w) >= 2:
            m = double(w)
            d = double(sorted(abs(2 * x - m) for x in w))
            far = None if c is None else 2 * abs(2 * c - m) > 3 * d
        out.append((i, k, c, len(w), m, d, far))
    return sorted(out, key=str)


def events(seed=3, n=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        t = T0 + dt.timedelta(microseconds=rng.choice([rng.randrange(4 * 3600 * 10**6), 3600 * 10**6, 7200 * 10**6, 7200 * 10**6 - 1, 0]))
        v = rng.choice([None, 0.0, -0.005, 1.005, rng.uniform(-5, 5), rng.expovariate(0.01), float("nan"), float("inf"), 1e300])
        out.append((i, None if rng.random() < 0.05 else t, rng.choice(["view", "view", "view", "click", None, ""]), v))
    out += out[:30] + [(None, T0, "view", 3.0), (None, T0, "view", 3.0), (7000, dt.datetime(1969, 12, 31, 23, 59, 59, 999999), "old", 1.0), (7001, dt.datetime(1970, 1, 1), "old", 2.0), (7002, dt.datetime(2200, 1, 1), "old", 2.0)]
    return out


@pytest.mark.parametrize("most", [500_000, 20, 3])
def test_against_brute_force(spark, most):
    """With few events a block allowed, blocks are cut into parts: the same rows."""
    rows = events()
    found = rolling.rolling_medians(table(spark, rows), 60, most=most)
    assert found.columns == ["click_id", "kind", "cents", "n", "median2", "mad4", "far"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)


def test_one_microsecond_holds_all(spark):
    rows = [(i, T0, "view", float(i % 7)) for i in range(300)]
    assert sorted(map(tuple, rolling.rolling_medians(table(spark, rows), 60, most=50).collect()), key=str) == brute(rows)


def test_conflicting_rows_of_an_id_and_no_rows(spark):
    rows = [(1, T0, "b", 2.0), (1, T0, "a", 9.0), (1, None, "a", 1.0), (2, T0, "a", 1.0)]
    assert sorted(map(tuple, rolling.rolling_medians(table(spark, rows)).collect()), key=str) == brute(rows)
    assert rolling.rolling_medians(table(spark, [])).collect() == []


def test_session_zone_is_no_matter(spark):
    rows = events(5, 80)
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # T0 lies within the hour that its clocks skip
        assert sorted(map(tuple, rolling.rolling_medians(table(spark, rows)).collect()), key=str) == brute(rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_groups_larger_than_a_batch(spark, monkeypatch):
    rows = events(9, 200)
    monkeypatch.setattr(rolling, "AT_ONCE", 7)
    length = 3600 * 10**6
    import numpy as np
    import pyarrow as pa

    t = sorted({(0, (r[1] - T0) // dt.timedelta(microseconds=1), i) for i, r in enumerate(rows) if r[1] is not None and T0 <= r[1] < T0 + dt.timedelta(hours=1)})
    batch = pa.RecordBatch.from_pydict({"series": ["x"] * len(t), "block": [5 + i // 8 for i in range(len(t))], "part": [0] * len(t), "at": [a + length for _, a, _ in t], "cents": [i for *_, i in t], "weight": [1] * len(t), "event": [i for *_, i in t], "asks": [True] * len(t)})
    whole = [b.to_pylist() for b in rolling._medians(length)(iter([batch]))]
    split = [b.to_pylist() for b in rolling._medians(length)(iter([batch.slice(i, 5) for i in range(0, len(t), 5)]))]
    assert sum(whole, []) == sum(split, []) and len(split) > 1 and np.unique([r["us"] for r in sum(whole, [])]).size


def test_sql_on_odd_rows(spark):
    rows = [r for r in events() if r[3] is None or abs(r[3]) < 1e6]
    con = duckdb.connect()
    con.register("clicks", table(spark, rows).toArrow())
    assert sorted(con.sql(rolling.ORACLE_SQL).fetchall(), key=str) == brute(rows)
