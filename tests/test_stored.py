"""Stored keyed tables and seasonal least squares."""

import datetime as dt
import uuid

import numpy as np

from basketry.operators import forecasting, upserts
from basketry.session import scratch_path
from basketry.sources.keyed_table import KeyedTable

SCHEMA = "k bigint, name string, at bigint, n bigint"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_batches_merge_once_and_readers_see_whole_versions(spark):
    table = KeyedTable(spark, scratch_path(spark, f"keyed-{uuid.uuid4().hex[:8]}"), ["k"], SCHEMA, buckets=8)
    assert rows(table.read()) == []
    count = lambda old, new: upserts.merge_counter(old, new, ["k"], "at", "n")
    change = lambda *r: spark.createDataFrame(r, SCHEMA)
    assert table.merge(change((1, "a", 1, 2), (2, "b", 1, 1)), 0, count)
    first = table._version()
    assert table.merge(change((1, "A", 5, 3), (3, "c", 2, 1)), 1, count)
    want = [(1, "A", 5, 5), (2, "b", 1, 1), (3, "c", 2, 1)]
    assert rows(table.read()) == want
    # sent again: nothing; a later batch goes on; untouched buckets stay where they were
    assert not table.merge(change((1, "A", 5, 3), (3, "c", 2, 1)), 1, count) and rows(table.read()) == want
    assert set(first[1].values()) - set(table._version()[1].values()) == {first[1][str(b)] for b in _buckets(spark, table, [1])}

    def broken(old, new):
        raise RuntimeError("lost")

    try:
        table.merge(change((2, "x", 9, 9)), 2, broken)
    except RuntimeError:
        pass
    assert rows(table.read()) == want
    assert table.merge(change((2, "B", 9, 9)), 2, count) and rows(table.read())[1] == (2, "B", 9, 10)


def _buckets(spark, table, ids):
    from pyspark.sql import functions as F
    return [r[0] for r in spark.createDataFrame([(i,) for i in ids], "k bigint").select(F.pmod(F.xxhash64("k"), F.lit(table.buckets)).cast("int")).collect()]


def test_last_write_and_insert_once(spark):
    old, new = (spark.createDataFrame(r, SCHEMA) for r in ([(1, "a", 5, 1), (2, "b", 7, 7)], [(1, "z", 4, 4), (2, "c", 9, 9), (3, "d", 1, 1)]))
    assert rows(upserts.merge_last_write(old, new, ["k"], "at")) == [(1, "a", 5, 1), (2, "c", 9, 9), (3, "d", 1, 1)]
    # payload and ``at`` of the first, ``n`` as the last touch
    assert rows(upserts.merge_insert_once(old, new, ["k"], "at", "n")) == [(1, "z", 4, 4), (2, "b", 7, 9), (3, "d", 1, 1)]


def least_squares(points, step, seasons, later):
    """Levels per season and a slope by the general solver."""
    labels = sorted(set(seasons(d) for d, _ in points))
    a = np.array([[float(seasons(d) == s) for s in labels] + [step(d)] for d, _ in points])
    y = np.array([v for _, v in points])
    beta = np.linalg.lstsq(a, y, rcond=None)[0]
    return {d: beta[labels.index(seasons(d))] + beta[-1] * step(d) for d in later if seasons(d) in labels}


def test_seasonal_forecast_is_least_squares(spark):
    pick = np.random.default_rng(8)
    start = dt.date(2024, 1, 3)
    days = [(start + dt.timedelta(days=int(i)), round(float(40 + 0.3 * i + 9 * ((i + 2) % 7) + pick.normal()), 2)) for i in range(60) if i % 5]
    history = spark.createDataFrame([("s", d, v) for d, v in days], "series_id string, day date, value double")
    got = {r.ds: r for r in forecasting.seasonal_forecast(history, 7).collect()}
    want = least_squares(days, lambda d: (d - start).days, dt.date.weekday, [days[-1][0] + dt.timedelta(days=h) for h in range(1, 8)])
    assert got.keys() == want.keys() and all(abs(got[d].yhat - want[d]) < 0.006 and got[d].yhat_lower < got[d].yhat < got[d].yhat_upper for d in want)

    ends = {"W": lambda d: d + dt.timedelta(days=6 - d.weekday()), "M": lambda d: (d.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1)}
    steps = {"W": lambda d: (d - dt.date(1970, 1, 4)).days // 7, "M": lambda d: d.year * 12 + d.month}
    for frequency, later in (("W", [dt.date(2024, 3, 10), dt.date(2024, 3, 17)]), ("M", [dt.date(2024, 4, 30), dt.date(2024, 5, 31)])):
        long = days if frequency == "W" else [*days, (dt.date(2024, 3, 31), 50.0)]
        totals = {}
        for d, v in long:
            totals[ends[frequency](d)] = totals.get(ends[frequency](d), 0) + v
        data = spark.createDataFrame([("s", d, v) for d, v in long], "series_id string, day date, value double")
        told = {r.ds: r.yhat for r in forecasting.seasonal_forecast(data, 2, frequency).collect()}
        want = least_squares(sorted(totals.items()), steps[frequency], lambda d: 0, sorted(told))
        assert all(abs(told[d] - want[d]) < 0.006 for d in told) and len(told) == 2
        if frequency == "M":
            assert sorted(told) == later


def test_short_and_single_season_series(spark):
    three = [("s", dt.date(2024, 1, 1 + i), 10.0 + i) for i in range(3)]  # no weekday twice: one level
    got = forecasting.seasonal_forecast(spark.createDataFrame(three, "series_id string, day date, value double"), 2).orderBy("ds").collect()
    assert [r.yhat for r in got] == [13.0, 14.0] and got[0].yhat_lower == 13.0
