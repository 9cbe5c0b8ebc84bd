"""The factor library: 96 technical columns per entity and day.

Columns are added in stages: exponential means first, while rows are narrow,
then windows that all share one specification. One shuffle by entity serves
every stage, and unused factors are pruned from the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.fixed_values import FACTOR_COLUMNS, POSITION_SPANS, SPANS
from tapeloom.functions import rolling as R
from tapeloom.functions.scalars import finite, over, safe_div, zero_to_null


def technical_factors(bars: DataFrame) -> DataFrame:
    """``entity, date`` and the factor columns in contract order."""
    return market_state(bars).select("entity", "date", *FACTOR_COLUMNS)


def market_state(bars: DataFrame) -> DataFrame:
    c = F.col
    df = R.number_rows(bars.withColumns(R.gains_and_losses()))
    df = R.smooth(
        df,
        {f"ema{n}": ("close", n) for n in SPANS}
        | {"_fast": ("close", 12), "_slow": ("close", 26)}
        | R.rsi_specs((14, 5)),
    )
    df = df.withColumns({"macd_dif": c("_fast") - c("_slow"), **R.rsi_values((14, 5))})
    df = R.smooth(df, {"macd_dea": ("macd_dif", 9)}).drop("_row", "_block", "_closes", "_fast", "_slow", "_gain", "_loss", *R.rsi_specs((14, 5)))

    df = df.withColumns(
        {
            "_cf": R.forward_fill("close"),
            "_vf": R.forward_fill("volume"),
            "_tf": R.forward_fill("total_turnover"),
            "prev_close": R.shifted("close"),
            "_prev_volume": R.shifted("volume"),
        }
    )
    df = df.withColumns(
        {
            "ret": R.pct_change("_cf"),
            "_vret": R.pct_change("_vf"),
            "_tret": R.pct_change("_tf"),
            **{f"mom{n}": R.pct_change("_cf", n) for n in SPANS},
            "_range": c("high") - c("low"),
            "_tr": R.true_range(),
            "_traded": zero_to_null("volume"),
        }
    )
    df = df.withColumns(
        {
            "_ret1": R.shifted("ret"),
            "_ma20v": R.rolling_mean("_traded", 20),
            "_std20v": R.rolling_std("volume", 20),
            "_mean20v": R.rolling_mean("volume", 20),
            **{f"ma{n}": R.rolling_mean("close", n) for n in SPANS},
            **{f"ret_std{n}": R.rolling_std("ret", n) for n in SPANS},
            **{f"ret_mean{n}": R.rolling_mean("ret", n) for n in SPANS},
            **{f"_tmean{n}": R.rolling_mean("total_turnover", n) for n in SPANS},
            **{f"_tstd{n}": R.rolling_std("total_turnover", n) for n in SPANS},
            **{f"_hi{n}": R.rolling_max("close", n) for n in POSITION_SPANS},
            **{f"_lo{n}": R.rolling_min("close", n) for n in POSITION_SPANS},
            **{f"mom{n}_z": R.rolling_zscore(f"mom{n}", 60) for n in SPANS},
            "_std_close20": R.rolling_std("close", 20),
            "atr14": R.rolling_mean("_tr", 14),
            "skew": R.rolling_skew("ret", 20),
            "kurtosis": R.rolling_kurtosis("ret", 20),
        }
    )
    df = df.withColumns(
        {
            "liq": over(F.abs(c("volume") - c("_prev_volume")), "_std20v"),
            "rev": R.rolling_corr("ret", "_ret1", 20),
            "price_turnover_corr20": R.rolling_corr("ret", "_tret", 20),
            "volume_price_corr20": R.rolling_corr("_vret", "ret", 20),
            "vol_ret_corr20_lag1": R.rolling_corr("_vret", "_ret1", 20),
            **{f"_maf{n}": R.forward_fill(f"ma{n}") for n in SPANS},
        }
    )
    df = df.withColumns(
        {
            "lip": 0.5 * c("liq") + 0.3 * R.shifted("liq", 1) + 0.2 * R.shifted("liq", 2),
            **{f"ma{n}_slope": R.pct_change(f"_maf{n}") for n in SPANS},
        }
    )
    top = F.when(c("close") >= c("open"), c("close")).otherwise(c("open"))
    bottom = F.when(c("close") >= c("open"), c("open")).otherwise(c("close"))
    band_low, band_high = c("ma20") - 2.0 * c("_std_close20"), c("ma20") + 2.0 * c("_std_close20")
    df = df.withColumns(
        {
            "candle_body": F.abs(c("close") - c("open")),
            "candle_upper": F.when((c("high") - top) < 0, 0.0).otherwise(c("high") - top),
            "candle_lower": F.when((bottom - c("low")) < 0, 0.0).otherwise(bottom - c("low")),
            "turnover": c("total_turnover"),
        }
    )
    derived = {
        "ret_abs": F.abs("ret"),
        "macd_hist": c("macd_dif") - c("macd_dea"),
        "pvo": over(c("close") - c("ema5"), "_ma20v"),
        "sse": over(c("_hi20") - c("_lo20"), "_ma20v"),
        "gap": over(c("open") - c("prev_close"), "prev_close"),
        "vts": over("ret_std10", "ret_std30"),
        "vcll": safe_div("volume", "_ma20v"),
        "rvr": over("ret", "ret_std20"),
        "csl": over(c("close") - c("ma60"), "ma60"),
        "vcbl": over("ret_std5", "ret_std20"),
        "vol_per_trade": over("volume", zero_to_null("num_trades")),
        **{f"price_ma{n}_ratio": over("close", f"ma{n}") for n in SPANS},
        **{f"ma{a}_{b}_cross": over(c(f"ma{a}") - c(f"ma{b}"), f"ma{b}") for a, b in ((5, 10), (10, 20), (20, 60))},
        "boll_ma20": c("ma20"),
        "boll_width": over(band_high - band_low, "ma20"),
        "boll_pctb": over(c("close") - band_low, band_high - band_low),
        "hl_range": over("_range", F.abs("prev_close")),
        "body_ratio": over("candle_body", "_range"),
        "upper_ratio": over("candle_upper", "_range"),
        "lower_ratio": over("candle_lower", "_range"),
        "turnover_ma20_ratio": over("turnover", "_tmean20"),
        "turnover_std20_ratio": over("_tstd20", F.abs("turnover")),
        "vol_std20_over_mean20": over("_std20v", "_mean20v"),
        "vol_cv_20": over("_std20v", "_mean20v"),
        **{f"turnover_mean_ratio_{n}": over(f"_tmean{n}", "turnover") for n in SPANS},
        **{f"turnover_std_ratio_{n}": over(f"_tstd{n}", F.abs("turnover")) for n in SPANS},
        **{f"price_pos_{n}": over(c("close") - c(f"_lo{n}"), c(f"_hi{n}") - c(f"_lo{n}")) for n in POSITION_SPANS},
    }
    df = df.withColumns(derived)
    return df.withColumns({name: finite(name) for name in FACTOR_COLUMNS})


def in_contract_order(df: DataFrame, stored: list[str] | None = None) -> DataFrame:
    """Factor columns in the stored order if there is one, else in the contract's.

    A stored column that the frame lacks comes back as NULL.
    """
    names = stored or FACTOR_COLUMNS
    have = set(df.columns)
    return df.select(
        "entity", "date", *[F.col(n) if n in have else F.lit(None).cast("double").alias(n) for n in names]
    )
