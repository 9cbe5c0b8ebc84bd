"""Simulation and stop rules on hand-built cases."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.config import Costs, Stops
from tapeloom.operators import evaluation as E
from tapeloom.operators import simulate as M
from tapeloom.operators import stops as X
from tapeloom.operators.stop_fold import fold

FREE = Costs(0, 0, 0)
START = dt.date(2024, 1, 1)


def bar(i, o=100.0, h=None, low=None, c=None, prev=100.0, target=1.0, signal=1, day=None):
    c = o if c is None else c
    return X.Bar(i if day is None else day, i, signal, target, o, max(o, c) if h is None else h, min(o, c) if low is None else low, c, prev)


def run(bars, stops, costs=FREE):
    held = X.Holding()
    return [(b.ord, *e) for b in bars for e in X.advance(held, b, stops, costs)]


def kinds(events):
    return [(e[0], e[1]) for e in events if e[1] != "RET"]


def test_gap_through_stop_fills_at_open():
    out = run([bar(0), bar(1, o=90.0, low=85.0)], Stops(stop_loss=0.05))
    assert kinds(out) == [(0, "BUY"), (1, "SL")]
    assert [e for e in out if e[1] == "SL"][0][6] == 90.0


def test_stop_inside_the_day_fills_at_the_level():
    out = run([bar(0), bar(1, o=99.0, low=94.0)], Stops(stop_loss=0.05))
    assert [e for e in out if e[1] == "SL"][0][6] == pytest.approx(95.0)


def test_gap_through_target_fills_at_open():
    out = run([bar(0), bar(1, o=120.0, h=121.0)], Stops(take_profit=0.15))
    assert [e for e in out if e[1] == "TP"][0][6] == 120.0


def test_stop_wins_over_target_on_one_day():
    out = run([bar(0), bar(1, o=100.0, h=130.0, low=90.0)], Stops(take_profit=0.15, stop_loss=0.05))
    assert kinds(out) == [(0, "BUY"), (1, "SL")]


def test_trailing_stop_arms_and_fires_on_one_day():
    out = run([bar(0), bar(1, o=110.0, h=120.0, low=113.0)], Stops(rules=("trailing_sl",)))
    fired = [e for e in out if e[1] == "TRAIL_SL"][0]
    assert fired[0] == 1 and fired[6] == pytest.approx(120.0 * 0.95)


def test_trailing_stop_uses_yesterdays_peak_at_the_open():
    days = [bar(0), bar(1, o=116.0, h=120.0, low=116.0), bar(2, o=113.0, h=113.0, low=112.0)]
    fired = [e for e in run(days, Stops(rules=("trailing_sl",))) if e[1] == "TRAIL_SL"][0]
    assert fired[0] == 2 and fired[6] == 113.0


def test_unarmed_trailing_stop_never_fires():
    assert kinds(run([bar(0), bar(1, o=100.0, h=110.0, low=60.0)], Stops(rules=("trailing_sl",)))) == [(0, "BUY")]


def test_cooldown_first_and_last_day_and_reentry_in_cycle():
    stops = Stops(stop_loss=0.05, cooldown_days=2)
    days = [bar(0), bar(1, o=90.0)] + [bar(i) for i in range(2, 6)]
    out = run(days, stops)
    returns = [(e[0], e[2]) for e in out if e[1] == "RET"]
    assert returns == [(0, "add"), (1, "stop"), (4, "add"), (5, "keep")]
    assert kinds(out) == [(0, "BUY"), (1, "SL")]  # the silent re-entry logs no BUY
    blocked = run(days, Stops(stop_loss=0.05, cooldown_days=2, block_reentry_returns=True))
    assert [(e[0], e[2]) for e in blocked if e[1] == "RET"] == [(0, "add"), (1, "stop")]


def test_next_signal_buys_again():
    days = [bar(0), bar(1, o=90.0), bar(5, signal=2), bar(6, signal=2, target=0.0)]
    assert kinds(run(days, Stops(stop_loss=0.05, cooldown_days=1))) == [(0, "BUY"), (1, "SL"), (5, "BUY"), (6, "SELL")]


def test_no_sell_is_logged_after_a_stop():
    days = [bar(0), bar(1, o=90.0), bar(4), bar(5, target=0.0)]
    assert kinds(run(days, Stops(stop_loss=0.05, cooldown_days=1))) == [(0, "BUY"), (1, "SL")]


def test_missing_price_on_a_held_day_is_skipped():
    nan = float("nan")
    out = run([bar(0), X.Bar(1, 1, 1, 1.0, nan, nan, nan, nan, 100.0), bar(2, prev=nan)], Stops(stop_loss=0.05))
    assert kinds(out) == [(0, "BUY")]


def wild_days(seed, names=6, days=150):
    """Days with gaps, missing prices, changing targets and signals, long enough for several chunks of the fold."""
    rng = np.random.default_rng(seed)
    rows = []
    for name in range(names):
        price = 100.0
        for i in range(days):
            prev, price = price, price * (1 + rng.normal(0, 0.04))
            if rng.random() < 0.08:  # a day without the name
                continue
            low, high = price * (1 - abs(rng.normal(0, 0.03))), price * (1 + abs(rng.normal(0, 0.03)))
            prices = [rng.uniform(low, high), high, low, price, prev]
            prices = [None if rng.random() < 0.03 else p for p in prices]
            target = float(rng.choice([0.0, 0.25, 0.5, -0.25], p=[0.2, 0.45, 0.25, 0.1]))
            rows.append((f"e{name}", START + dt.timedelta(i), i + i // 5 * 2, i, i // 5, target, *prices))
    return rows


def test_fold_equals_the_days_walked_one_by_one(spark):
    both = ("fixed_tp_sl", "trailing_sl")
    settings = [
        ("off", Stops(rules=())),
        ("fixed", Stops(take_profit=0.06, stop_loss=0.05, cooldown_days=2)),
        ("blocked", Stops(take_profit=0.03, stop_loss=0.03, cooldown_days=1, block_reentry_returns=True)),
        ("trail", Stops(rules=("trailing_sl",), trail_start=0.04, trail_drawdown=0.03, cooldown_days=0)),
        ("chain", Stops(rules=both, take_profit=0.1, stop_loss=0.06, trail_start=0.02, trail_drawdown=0.04)),
        ("turned", Stops(rules=both[::-1] + ("unknown",), take_profit=0.05, stop_loss=0.06, trail_start=0.02, trail_drawdown=0.04)),
    ]
    rows = wild_days(5)
    frame = spark.createDataFrame(rows, "entity string, date date, day int, ord int, signal int, weight double, "
                                  "open double, high double, low double, close double, prev_close double")
    want = []
    for name, stops in settings:
        held = {}
        for entity, date, day, number, signal, weight, *prices in rows:
            today = X.Bar(day, number, signal, weight, *(float("nan") if p is None else p for p in prices))
            for kind, path, w, ret, entry, price in X.advance(held.setdefault(entity, X.Holding()), today, stops, Costs()):
                ret = None if ret is None or ret != ret else ret
                price = None if price is None or price != price else price
                want.append((name, entity, date, kind, path, w, ret, None if ret is None else w * ret, entry, price))
    got = [tuple(r) for r in fold(frame, settings, Costs()).collect()]
    order = lambda r: tuple(map(str, r[:5]))
    got, want = sorted(got, key=order), sorted(want, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    numbers = lambda rows: np.array([r[5:] for r in rows], dtype=float)
    np.testing.assert_allclose(numbers(got), numbers(want), rtol=1e-12)
    assert {"SL", "TP", "TRAIL_SL", "BUY", "SELL"} <= {r[3] for r in got}
    assert fold(frame.limit(0), settings, Costs()).count() == 0


@pytest.fixture(scope="module")
def book(spark):
    days = [START + dt.timedelta(days=i) for i in range(6)]
    prices = {"a": [10, 11, 12, 11, 10, 12], "b": [20, 20, 15, 22, 23, 21], "c": [5, 5, 5, 5, 5, 6]}
    bars = [(e, d, p * 0.99, p * 1.02, p * 0.95, float(p)) for e, ps in prices.items() for d, p in zip(days, ps) if not (e == "c" and d == days[2])]
    held = {"a": [0.5, 0.5, 0.5, 0, 0, 0.5], "b": [0.5, 0.5, 0.25, 0.5, 0.5, 0.5], "c": [0, 0, 0.25, 0.5, 0.5, 0]}
    positions = [(d, e, float(w), days[0]) for e, ws in held.items() for d, w in zip(days, ws) if w]
    return (spark.createDataFrame(positions, "date date, entity string, weight double, signal_date date"),
            spark.createDataFrame(bars, "entity string, date date, open double, high double, low double, close double"), held)


def test_rules_off_equal_the_plain_simulation(book):
    positions, bars, _ = book
    plain = M.daily_nav(M.stock_returns(M.transitions(positions, bars))).toPandas().sort_values("date")
    walked = X.stopped_nav(X.simulate(positions, bars, [("off", Stops(rules=()))]), positions, bars, ["off"]).toPandas().sort_values("date")
    for c in ("ret_total", "nav", "n_long"):
        assert plain[c].tolist() == pytest.approx(walked[c].tolist())


def test_idle_days_have_nav_rows(book):
    positions, bars, _ = book
    stops = [("tight", Stops(stop_loss=0.01, take_profit=0.01, cooldown_days=30))]
    got = X.stopped_nav(X.simulate(positions, bars, stops), positions, bars, ["tight"]).toPandas().sort_values("date")
    assert len(got) == 6
    idle = got[got["n_long"] == 0]
    assert len(idle) and (idle["ret_total"].iloc[-1] == 0)


def test_plain_simulation_by_hand(book):
    positions, bars, _ = book
    got = M.daily_nav(M.stock_returns(M.transitions(positions, bars), FREE)).toPandas().sort_values("date")["ret_total"].tolist()
    assert got[0] == pytest.approx(0.5 * (10 / 9.9 - 1) + 0.5 * (20 / 19.8 - 1))
    assert got[2] == pytest.approx(0.5 * (12 / 11 - 1) + 0.25 * (15 / 20 - 1))  # c has no price that day
    assert got[3] == pytest.approx(0.5 * (11 * 0.99 / 12 - 1) + 0.5 * (22 / 15 - 1))


def test_sweep_matches_single_runs(book):
    positions, bars, _ = book
    settings = X.grid((0.1, 99.0), (0.05,), (1, 3))
    rows = X.sweep(positions, bars, settings).toPandas()
    assert len(rows) == 4 and set(rows["take_profit"]) == {0.1, 99.0}
    table = X.sweep_table(X.sweep(positions, bars, settings), (1, 3))
    assert table.columns == ["take_profit", "stop_loss", "cd_1", "cd_3"] and table.count() == 2


def test_turnover_is_bounded(book):
    positions, _, held = book
    got = E.turnover(E.normalised_weights(positions)).toPandas().sort_values("date")["turnover"]
    w = pd.DataFrame(held)
    w = w.div(w.sum(axis=1), axis=0)
    assert got.tolist() == pytest.approx((0.5 * w.diff().abs().sum(axis=1)).iloc[1:].tolist())
    assert got.between(0, 1).all()


def nav_of(spark, values):
    rows = [("s", START + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, date date, nav double")


@pytest.mark.parametrize(("values", "size", "start", "end"), [
    ([1, 2, 3], 0.0, 0, 0), ([2, 2, 2], 0.0, 0, 0), ([1, 2, 1, 2, 1], 0.5, 1, 2), ([1, 3, 3, 1.5, 3], 0.5, 1, 3)])
def test_drawdown_cases(spark, values, size, start, end):
    row = E.max_drawdown(nav_of(spark, values)).first()
    assert row.max_drawdown == pytest.approx(size)
    assert (row.start_date, row.end_date) == (START + dt.timedelta(days=start), START + dt.timedelta(days=end))
    assert row.recovery_days == end - start


def test_constant_scores_have_no_correlation(spark):
    rows = [("d", f"e{i}", 1.0, float(i)) for i in range(6)]
    df = spark.createDataFrame(rows, "date string, entity string, score double, ret double")
    ret = df.select(F.col("date").alias("sample_date"), "entity", F.col("ret").alias("next_week_return"))
    assert E.rank_ic(df, ret).first().rank_ic is None
    assert E.pearson_ic(df).first().ic is None


def test_series_keys_keep_series_apart(spark):
    from tapeloom.operators import evaluation as E

    days = [dt.date(2020, 12, 30) + dt.timedelta(days=i) for i in range(4)]
    rows = [(s, d, f"e{(i + k) % 2}", 1.0) for k, s in enumerate("ab") for i, d in enumerate(days)]
    weights = spark.createDataFrame(rows, "series_id string, date date, entity string, weight double")
    both = E.turnover(weights, ("series_id",)).toPandas()
    one = E.turnover(weights.where("series_id = 'a'").drop("series_id")).toPandas()
    assert both.groupby("series_id").size().to_dict() == {"a": 3, "b": 3} and set(both["turnover"]) == set(one["turnover"]) == {1.0}
    ic = spark.createDataFrame([(s, d, float(i + k)) for k, s in enumerate("ab") for i, d in enumerate(days)], "series_id string, date date, rank_ic double")
    assert {r["series_id"]: r["ic_mean"] for r in E.ic_summary(ic, keys=("series_id",)).collect()} == {"a": 1.5, "b": 2.5}
    yearly = {(r["series_id"], r["year"]): r["n"] for r in E.yearly_stats(ic, "rank_ic", ("series_id",)).collect()}
    assert yearly == {("a", 2020): 2, ("a", 2021): 2, ("a", None): 4, ("b", 2020): 2, ("b", 2021): 2, ("b", None): 4}
