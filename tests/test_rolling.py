"""Rolling windows and exponential means against pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.fixed_values import FACTOR_COLUMNS
from tapeloom.functions import rolling as R
from tapeloom.operators.factors import in_contract_order, technical_factors


def panel(n=1300, entities=("a", "b"), seed=3):
    rng = np.random.default_rng(seed)
    frames = []
    for e in entities:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        open_ = close * (1 + rng.normal(0, 0.01, n))
        frames.append(pd.DataFrame({
            "entity": e,
            "date": [dt.date(2000, 1, 1) + dt.timedelta(days=i) for i in range(n)],
            "open": open_, "close": close,
            "high": np.maximum(open_, close) * 1.01, "low": np.minimum(open_, close) * 0.99,
            "volume": rng.integers(0, 50, n).astype(float), "num_trades": rng.integers(1, 9, n).astype(float),
            "total_turnover": rng.uniform(1e3, 1e5, n),
        }))
    return pd.concat(frames)


def by_key(df):
    return df.toPandas().sort_values(["entity", "date"]).reset_index(drop=True)


def test_ema_matches_pandas_across_blocks_and_leading_nulls(spark):
    pdf = panel()
    pdf.loc[pdf.index < 3, "close"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("close", F.when(~F.isnan("close"), F.col("close")))
    got = by_key(R.with_ema(df, {"e5": ("close", 5), "e60": ("close", 60)}))
    for name, span in (("e5", 5), ("e60", 60)):
        want = pdf.groupby("entity")["close"].transform(lambda s: s.ewm(span=span, adjust=False).mean())
        np.testing.assert_allclose(got[name], want, rtol=1e-11)


def test_ema_holds_over_a_gap(spark):
    rows = [("a", dt.date(2000, 1, i + 1), v) for i, v in enumerate([1.0, 2.0, None, 4.0])]
    df = spark.createDataFrame(rows, "entity string, date date, x double")
    got = by_key(R.with_ema(df, {"e": ("x", 3)}))["e"].tolist()
    assert got == pytest.approx([1.0, 1.5, 1.5, 2.75])


def test_factors_match_pandas(spark):
    pdf = panel(300)
    got = by_key(technical_factors(spark.createDataFrame(pdf)))
    assert list(got.columns[2:]) == FACTOR_COLUMNS and len(FACTOR_COLUMNS) == 96
    g = pdf.reset_index(drop=True).groupby("entity", group_keys=False)
    close = pdf["close"].reset_index(drop=True)
    ret = g["close"].pct_change()
    both = pd.DataFrame({"entity": pdf["entity"].to_numpy(), "ret": ret, "lag": ret.groupby(pdf["entity"].to_numpy()).shift(1)})
    checks = {
        "skew": ret.groupby(both["entity"]).transform(lambda s: s.rolling(20, min_periods=1).skew()),
        "kurtosis": ret.groupby(both["entity"]).transform(lambda s: s.rolling(20, min_periods=1).kurt()),
        "rev": pd.concat([x["ret"].rolling(20, min_periods=2).corr(x["lag"]) for _, x in both.groupby("entity")]),
        "ma60": g["close"].transform(lambda s: s.rolling(60, min_periods=1).mean()),
        "mom20": g["close"].transform(lambda s: s.pct_change(20)),
        "price_pos_20": (close - g["close"].transform(lambda s: s.rolling(20, min_periods=1).min()))
        / (g["close"].transform(lambda s: s.rolling(20, min_periods=1).max()) - g["close"].transform(lambda s: s.rolling(20, min_periods=1).min()) + 1e-12),
    }
    for name, want in checks.items():
        np.testing.assert_allclose(got[name], want.to_numpy(), rtol=1e-7, atol=1e-9, err_msg=name)
    assert not np.isinf(got[FACTOR_COLUMNS].to_numpy(float)).any()


def test_no_factor_looks_ahead(spark):
    pdf = panel(120, ("a",))
    cut = dt.date(2000, 3, 15)
    full = by_key(technical_factors(spark.createDataFrame(pdf)).where(F.col("date") <= F.lit(cut)))
    part = by_key(technical_factors(spark.createDataFrame(pdf[pdf["date"] <= cut])))
    pd.testing.assert_frame_equal(full, part, rtol=1e-12)


def test_short_and_constant_windows(spark):
    rows = [("one", dt.date(2000, 1, 3), 5.0)] + [("flat", dt.date(2000, 1, 1) + dt.timedelta(days=i), 7.0) for i in range(5)]
    df = spark.createDataFrame(rows, "entity string, date date, close double")
    for c in ("open", "high", "low", "volume", "total_turnover", "num_trades"):
        df = df.withColumn(c, F.col("close"))
    got = by_key(technical_factors(df))
    one = got[got["entity"] == "one"].iloc[0]
    assert np.isnan(one["ret"]) and np.isnan(one["ret_std20"]) and one["ma20"] == 5.0
    flat = got[got["entity"] == "flat"]
    assert flat[["skew", "kurtosis", "rev"]].isna().all().all()


def test_stored_column_order_wins(spark):
    df = technical_factors(spark.createDataFrame(panel(5, ("a",))))
    out = in_contract_order(df, ["mom5", "ret", "gone"])
    assert out.columns == ["entity", "date", "mom5", "ret", "gone"]


def test_rank_of_last(spark):
    pdf = panel(100, ("a",))[["entity", "date", "close"]]
    df = spark.createDataFrame(pdf)
    got = by_key(df.withColumn("r", R.rank_of_last("close", 20, 5)))["r"]
    want = pdf["close"].rolling(20, min_periods=5).apply(lambda x: pd.Series(x).rank(pct=True).iloc[-1])
    np.testing.assert_allclose(got, want.to_numpy())


@pytest.mark.parametrize("name", ["d16_forward_fill", "d2_rolling_std", "d9_lag_diff", "d6_rolling_corr"])
def test_windows_over_supplier_bars_shuffle_only_their_columns(spark, name):
    from tapeloom.plans.catalogue import QUERIES

    out = QUERIES[name](spark, "/root/testdata/sf0.001")
    # Read from the order lines, not from a stored table of all columns.
    assert all("lineitem" in f for f in out.inputFiles())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "l_extendedprice" in plan or name == "d16_forward_fill"
    assert "total_turnover" not in plan and "num_trades" not in plan
    assert out.count() > 0
