"""Calendar, samples, models, streams and the registry."""

import datetime as dt
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from tapeloom.config import Allocation, Stops
from tapeloom.operators import calendar as C
from tapeloom.operators import stops as X
from tapeloom.operators.allocation import weight_path
from tapeloom.operators.samples import tail_windows
from tapeloom.session import shared_dir
from tapeloom.streaming import live


def dates(spark, *iso):
    return spark.createDataFrame([(dt.date.fromisoformat(d),) for d in iso], "date date")


def listed(df, column="date"):
    return sorted(str(r[column]) for r in df.collect())


def test_midweek_holiday_splits_gap_weeks_only(spark):
    cal = dates(spark, "2024-05-06", "2024-05-07", "2024-05-09", "2024-05-10", "2024-05-13")
    assert listed(C.week_ends(cal)) == ["2024-05-10", "2024-05-13"]
    assert listed(C.gap_week_ends(cal)) == ["2024-05-07", "2024-05-10"]
    assert listed(C.gap_week_ends(cal, include_last=True)) == ["2024-05-07", "2024-05-10", "2024-05-13"]


def test_next_day_past_the_end_is_null(spark):
    cal = dates(spark, "2024-05-06", "2024-05-09")
    got = {str(r.date): r.next_trading_day for r in C.next_trading_day(dates(spark, "2024-05-01", "2024-05-06", "2024-05-09"), cal).collect()}
    assert str(got["2024-05-01"]) == "2024-05-06" and str(got["2024-05-06"]) == "2024-05-09" and got["2024-05-09"] is None


def test_spans_that_touch_are_merged(spark):
    rows = [("2024-01-01", "2024-02-01"), ("2024-02-01", "2024-03-01"), ("2024-05-01", "2024-06-01"), ("2024-05-10", "2024-05-11")]
    spans = spark.createDataFrame(rows, "start string, end string")
    assert sorted((r.start, r.end) for r in C.merge_spans(spans).collect()) == [("2024-01-01", "2024-03-01"), ("2024-05-01", "2024-06-01")]


def test_tail_windows_match_brute_force(spark):
    rng = np.random.default_rng(2)
    start = dt.date(2024, 1, 1)
    rows = [(e, start + dt.timedelta(days=i), float(i)) for e in "ab" for i in range(40) if rng.random() < 0.4]
    panel = spark.createDataFrame(rows, "entity string, date date, x double")
    cal = dates(spark, *[str(start + dt.timedelta(days=i)) for i in range(40)])
    weeks = C.week_ends(cal)
    got = tail_windows(panel, weeks, ["x"], 3).toPandas()
    want = []
    for week in [r.date for r in weeks.collect()]:
        for e in "ab":
            past = [r for r in rows if r[0] == e and r[1] <= week][-3:]
            if len(past) == 3:
                want += [(week, e, k, r[2]) for k, r in enumerate(past)]
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want)


def test_streamed_stops_equal_the_batch(spark, tmp_path):
    start = dt.date(2024, 1, 1)
    rng = np.random.default_rng(4)
    days = [start + dt.timedelta(days=i) for i in range(30)]
    bars, positions = [], []
    for e in "abc":
        price = 100 * np.exp(np.cumsum(rng.normal(0, 0.04, 30)))
        bars += [(e, d, float(p), float(p * 1.03), float(p * 0.97), float(p * 1.01)) for d, p in zip(days, price)]
        positions += [(d, e, 0.5, days[i // 7 * 7]) for i, d in enumerate(days) if (i // 5) % 3 != 1]
    bars = spark.createDataFrame(bars, "entity string, date date, open double, high double, low double, close double")
    positions = spark.createDataFrame(positions, "date date, entity string, weight double, signal_date date")
    stops = Stops(rules=("fixed_tp_sl", "trailing_sl"), take_profit=0.12, stop_loss=0.06, trail_start=0.05, trail_drawdown=0.03)
    batch = X.simulate(positions, bars, [("live", stops)]).toPandas()
    rows = X.stop_days(positions, bars)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.STATE_STORE)
    # Days arrive shuffled within a week, some twice, one far too late; the last row only moves the watermark on.
    arrival = F.floor((F.dayofyear("date") + F.pmod(F.hash("entity", "date"), F.lit(5))) / 9)
    end = rows.limit(1).withColumns({"entity": F.lit("end"), "date": F.lit("2024-03-01").cast("date"), "weight": F.lit(0.0)})
    late = rows.where("date = DATE '2024-01-02' AND entity = 'a'").withColumn("close", F.lit(1.0))
    steps = [rows.where(arrival == i) for i in range(4)]
    late_count = 0
    for part in (steps[0], steps[1].union(steps[0].where("date > DATE '2024-01-05'")), steps[2], steps[3].union(late), end):
        part.repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        events = live.live_stops(live.stream_table(spark, f"{tmp_path}/in", 100), stops, late="9 days")
        query = live.append_to(events, f"{tmp_path}/out", f"{tmp_path}/log")
        query.awaitTermination()
        late_count += live.late_rows(query)
    assert late_count >= 1
    streamed = spark.read.parquet(f"{tmp_path}/out").toPandas()
    order = ["entity", "date", "kind"]
    assert {"SL", "TP"} & set(batch["kind"]) and "TRAIL_SL" in set(batch["kind"])
    pd.testing.assert_frame_equal(
        batch.sort_values(order).reset_index(drop=True), streamed.sort_values(order).reset_index(drop=True))


def test_replayed_batch_changes_nothing(spark, tmp_path):
    path = f"{tmp_path}/panel"
    assert live.read_panel(spark, path) is None
    bars = spark.createDataFrame(
        [(e, dt.date(2024, m, 2), float(m)) for e in "abcdefgh" for m in (1, 2)], "entity string, date date, close double")
    revised = bars.where("close = 2 AND entity < 'c'").withColumn("close", F.lit(9.0)).withColumn("volume", F.lit(1.0))
    live.merge_batch(bars, path, batch_id=0, buckets=3)
    for batch_id in (1, 1, 0):
        live.merge_batch(revised, path, batch_id=batch_id, buckets=3)
    live.merge_batch(revised, path, buckets=3)
    now = live.read_panel(spark, path).collect()
    assert sorted((r["entity"], r["close"], r["volume"]) for r in now if r["date"].month == 2) == [
        (e, 9.0 if e < "c" else 2.0, 1.0 if e < "c" else None) for e in "abcdefgh"]
    assert len(now) == 16 and {r["close"] for r in now if r["date"].month == 1} == {1.0}
    # The first version is still whole; a version without its mark is not seen.
    assert {r["close"] for r in live.read_panel(spark, path, 1).collect()} == {1.0, 2.0}
    os.remove(f"{path}/_versions/3/_SUCCESS")
    assert live._manifests(spark, path) == [1, 2]
    live.merge_batch(revised, path, batch_id=2, buckets=3)
    assert live.vacuum(spark, path, keep=1) > 0 and live._manifests(spark, path) == [3]
    assert sorted(map(str, live.read_panel(spark, path).collect())) == sorted(map(str, now))


def test_state_path_waits_for_hysteresis_and_respects_the_cap(spark):
    strength = [0.5, 0.9, 0.9, 0.9, 0.5, 0.1, 0.1, 0.1]
    rows = [("s", dt.date(2024, 1, 1) + dt.timedelta(weeks=i), e) for i, e in enumerate(strength)]
    env = spark.createDataFrame(rows, "entity string, date date, env_strength double")
    cfg = Allocation(mode="state", smooth=0.0, weekly_cap=1.0)
    got = weight_path(env, cfg).toPandas().sort_values("date")["w_g"].tolist()
    assert got == pytest.approx([0.30, 0.35, 0.35, 0.50, 0.50, 0.20, 0.20, 0.05])
    capped = weight_path(env).toPandas().sort_values("date")["w_g"]
    assert capped.diff().abs().max() <= 0.10 + 1e-12


def test_registry_is_consistent():
    names, checked = set(entry_points.queries()), set(entry_points.oracle_sql())
    assert checked <= names and len(names) > 180


class FakeSession:
    """Just enough of a session to ask where the shared folder is."""

    def __init__(self, named, current, master):
        self.conf, self.sparkContext, self.master = self, self, master
        self.named, self.current = named, current

    def get(self, key, default=None):
        return self.named or default

    def getCheckpointDir(self):
        return self.current

    def setCheckpointDir(self, path):
        self.current = path


def test_shared_folder_comes_from_the_session():
    assert shared_dir(FakeSession("hdfs://x/cp", None, "yarn")) == "hdfs://x/cp"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(FakeSession(None, None, "yarn"))
    local = FakeSession(None, None, "local[2]")
    assert shared_dir(local) == shared_dir(local)


def test_entry_returns_all_factors(spark):
    df = entry_points.entry(spark)
    assert len(df.columns) == 98
