"""Queries over bars: calendar and alignment (b), rolling windows (d), factors (e)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.config import WalkForward
from tapeloom.fixed_values import FACTOR_COLUMNS, SPANS
from tapeloom.functions import rolling as R
from tapeloom.functions.scalars import finite, safe_div
from tapeloom.operators import calendar as C
from tapeloom.operators.factors import in_contract_order, market_state, technical_factors
from tapeloom.plans import fixtures as fx
from tapeloom.plans import sqltext as S
from tapeloom.plans.registry import final, query, report
from tapeloom.sources.bars import table

# ---------------------------------------------------------------- calendar


@query("b1_week_ends", S.with_base("SELECT date, week_ord, next_week_end FROM weeks"))
def week_end_table(spark, root):
    return fx.weeks(spark, root)


@query("b2_gap_week_ends", S.with_base("""
SELECT date, next_date IS NULL AS is_last FROM cal WHERE next_date IS NULL OR next_date - date > 1"""))
def gap_weeks(spark, root):
    cal = fx.calendar(spark, root)
    inner = C.gap_week_ends(cal).withColumn("is_last", F.lit(False))
    with_tail = C.gap_week_ends(cal, include_last=True)
    return with_tail.join(inner, "date", "left").withColumn("is_last", F.col("is_last").isNull())


@query("b3_next_trading_day", S.with_base("""
SELECT d.date, (SELECT min(c.date) FROM cal c WHERE c.date > d.date) AS next_trading_day
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) d"""))
def next_day(spark, root):
    asked = table(spark, root, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    return C.next_trading_day(asked, fx.calendar(spark, root))


@query("b4_align_to_last_available", S.with_base("""
SELECT * FROM (SELECT d.date, (SELECT max(c.date) FROM cal c WHERE c.date <= d.date) AS aligned
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) d) WHERE aligned IS NOT NULL"""))
def align(spark, root):
    asked = table(spark, root, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    return C.align_dates(asked, fx.calendar(spark, root))


@query("b5_as_of_row", S.with_base("""
SELECT p.date, p.picked, reg.close AS index_close FROM (
  SELECT d.date, coalesce((SELECT max(i.date) FROM reg i WHERE i.date <= d.date), (SELECT min(date) FROM reg)) AS picked
  FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) d) p JOIN reg ON reg.date = p.picked""", """
reg AS (SELECT i.date, i.close FROM ibars i JOIN weeks w ON w.date = i.date WHERE i.entity = 'A' AND week_ord % 52 = 10)"""))
def as_of_row(spark, root):
    asked = table(spark, root, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    yearly = fx.weeks(spark, root).where("week_ord % 52 = 10").select("date")
    registry = fx.indices(spark, root).where("entity = 'A'").join(yearly, "date", "left_semi")
    found = C.as_of_rows(asked, registry.select("date", F.col("close").alias("index_close")))
    return found.select("date", "picked", "index_close")


@query("b6_missing_samples", S.with_base("""
SELECT date FROM weeks WHERE date NOT IN (SELECT date FROM lab) UNION SELECT max(date) FROM lab""", S.LABELS, """
lab AS (SELECT DISTINCT sample_date AS date FROM labels_ WHERE sample_date < DATE '2000-01-01')"""))
def missing(spark, root):
    written = fx.labels(spark, root).where("sample_date < DATE '2000-01-01'").select(F.col("sample_date").alias("date"))
    return C.missing_samples(fx.weeks(spark, root), written.distinct())


@query("b7_history_slice", S.with_base("""
SELECT entity, date, close FROM bars
WHERE date >= (SELECT min(date) FROM weeks WHERE date >= DATE '2000-01-01') - 240"""))
def history(spark, root):
    targets = fx.weeks(spark, root).where("date >= DATE '2000-01-01'")
    return C.history_slice(fx.bars(spark, root), targets).select("entity", "date", "close")


@query("b8_walk_forward_schedule", S.with_base("""
SELECT CAST((i0 - 104) / 26 AS BIGINT) AS window_id, week_ord, date,
  CASE WHEN week_ord < i0 THEN 'train' WHEN week_ord < i0 + 26 THEN 'val' ELSE 'predict' END AS role
FROM (SELECT unnest(range(104, (SELECT count(*) FROM weeks) - 26, 26)) AS i0)
JOIN weeks ON week_ord >= i0 - 104 AND week_ord < i0 + 52"""))
def schedule(spark, root):
    plan = C.schedule(fx.weeks(spark, root), WalkForward(104, 26, 26))
    return plan.select("window_id", "week_ord", "date", "role")


@query("b8b_window_table", S.with_base("""
SELECT CAST((i0 - 260) / 52 AS BIGINT) AS window_id,
  min(date) FILTER (week_ord < i0) AS train_start, max(date) FILTER (week_ord < i0) AS train_end,
  min(date) FILTER (week_ord >= i0 AND week_ord < i0 + 26) AS val_start,
  max(date) FILTER (week_ord >= i0 AND week_ord < i0 + 26) AS val_end,
  min(date) FILTER (week_ord >= i0 + 26) AS pred_date, max(date) FILTER (week_ord >= i0 + 26) AS pred_end
FROM (SELECT unnest(range(260, (SELECT count(*) FROM weeks) - 26, 52)) AS i0)
JOIN weeks ON week_ord >= i0 - 260 AND week_ord < i0 + 26 + 52 GROUP BY i0"""))
def window_table(spark, root):
    return C.window_table(C.schedule(fx.weeks(spark, root), WalkForward(260, 26, 52)))


@query("b9_window_spans", S.with_base("""
SELECT min(s) AS start, max(e) AS "end" FROM (
  SELECT *, sum(fresh) OVER (ORDER BY s, e) AS island FROM (
    SELECT *, CASE WHEN s > max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh
    FROM (SELECT greatest(a.date, DATE '1996-06-01') AS s, least(b.date, DATE '2001-06-01') AS e
          FROM (SELECT DISTINCT (SELECT max(date) FROM weeks w WHERE w.date <= m.date) AS date
                FROM (SELECT date FROM cal WHERE ord % 97 = 5) m) x
          JOIN weeks a ON a.date = x.date
          JOIN weeks b ON b.week_ord = least(a.week_ord + 15, (SELECT max(week_ord) FROM weeks)))
    WHERE s <= e)) GROUP BY island"""))
def spans(spark, root):
    cal = fx.calendar(spark, root)
    models = C.days(cal).where("ord % 97 = 5").select("date")
    lo, hi = F.lit("1996-06-01").cast("date"), F.lit("2001-06-01").cast("date")
    return C.window_spans(models, C.week_ends(cal), lo, hi, 16)


@query("b10_align_returns", S.with_base(final("""
SELECT s.entity AS series_id, d.date, coalesce(r.ret, 0) AS ret FROM (SELECT DISTINCT entity FROM rr) s
CROSS JOIN (SELECT DISTINCT date FROM rr) d LEFT JOIN rr r ON r.entity = s.entity AND r.date = d.date""",
    "series_id, date", "ret"),
    "rr AS (SELECT entity, date, close / prev_close - 1 AS ret FROM ibars WHERE prev_close IS NOT NULL)"))
def align_returns(spark, root):
    r = fx.indices(spark, root).where("prev_close IS NOT NULL").select(
        F.col("entity").alias("series_id"), "date", (F.col("close") / F.col("prev_close") - 1).alias("ret"))
    return report(C.align_series(r, "union"))


@query("b10b_align_returns_common", S.with_base(final("""
SELECT entity AS series_id, date, ret FROM rr WHERE date IN
(SELECT date FROM rr GROUP BY date HAVING count(DISTINCT entity) = (SELECT count(DISTINCT entity) FROM rr))""",
    "series_id, date", "ret"),
    "rr AS (SELECT entity, date, close / prev_close - 1 AS ret FROM ibars WHERE prev_close IS NOT NULL)"))
def align_returns_common(spark, root):
    r = fx.indices(spark, root).where("prev_close IS NOT NULL").select(
        F.col("entity").alias("series_id"), "date", (F.col("close") / F.col("prev_close") - 1).alias("ret"))
    return report(C.align_series(r, "intersection"))


@query("b10c_align_navs", S.with_base(final("""
SELECT * FROM (SELECT s.entity AS series_id, d.date, coalesce(r.ret, 0) AS ret_total,
  last_value(r.close IGNORE NULLS) OVER (PARTITION BY s.entity ORDER BY d.date) AS nav
FROM (SELECT DISTINCT entity FROM rr) s
CROSS JOIN (SELECT DISTINCT date FROM rr) d LEFT JOIN rr r ON r.entity = s.entity AND r.date = d.date) WHERE nav IS NOT NULL""",
    "series_id, date", "ret_total nav"),
    "rr AS (SELECT entity, date, close, close / prev_close - 1 AS ret FROM ibars)"))
def align_nav_frames(spark, root):
    r = fx.indices(spark, root).select(
        F.col("entity").alias("series_id"), "date", F.col("close").alias("nav"),
        (F.col("close") / F.col("prev_close") - 1).alias("ret_total"))
    return report(C.align_navs(r))


@query("b11_date_chain", S.with_base("""
SELECT date, week_end, sample_date FROM (
  SELECT *, (SELECT max(sample_date) FROM labels_ l WHERE l.sample_date <= week_end) AS sample_date FROM (
    SELECT d.date, (SELECT max(w.date) FROM weeks w WHERE w.date <= d.date) AS week_end
    FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) d))
WHERE week_end IS NOT NULL AND sample_date IS NOT NULL""", S.LABELS))
def date_chain(spark, root):
    asked = table(spark, root, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    stored = fx.labels(spark, root).select(F.col("sample_date").alias("date")).distinct()
    return C.chained_alignment(asked, fx.weeks(spark, root).select("date"), stored)


# ---------------------------------------------------------------- rolling windows


def rolling_query(name, columns, expressions, sql_columns, source="bars", digits=9, **special):
    """Register a window query over brand or supplier bars, both sides given as expressions."""
    sql = S.with_base(final(f"SELECT entity, date, {', '.join(f'{e} AS {c}' for c, e in sql_columns.items())} FROM {source}",
                            "entity, date", list(sql_columns), digits, **special))

    @query(name, sql)
    def run(spark, root):
        bars = (fx.thin_rows if source == "sbars" else fx.bars)(spark, root)
        out = bars.select("*", *[e.alias(c) for c, e in expressions().items()]).select("entity", "date", *columns)
        return report(out, digits, **special)


rolling_query("d1_rolling_mean_max_min", ["avg20", "max20", "min20"],
              lambda: {"avg20": R.rolling_mean("close", 20), "max20": R.rolling_max("high", 20), "min20": R.rolling_min("low", 20)},
              {"avg20": S.last("avg(close)", 20), "max20": S.last("max(high)", 20), "min20": S.last("min(low)", 20)}, "sbars")
rolling_query("d2_rolling_std", ["std20", "std5"],
              lambda: {"std20": R.rolling_std("close", 20), "std5": R.rolling_std("volume", 5)},
              {"std20": S.last("stddev_samp(close)", 20), "std5": S.last("stddev_samp(volume)", 5)}, "sbars", 6)
rolling_query("d9_lag_diff", ["prev_close", "move"],
              lambda: {"prev_close": R.shifted("close"), "move": F.col("close") - R.shifted("close")},
              {"prev_close": S.lag("close"), "move": f"close - {S.lag('close')}"}, "sbars")
rolling_query("d10_safe_divide", ["ratio"],
              lambda: {"ratio": safe_div(F.col("close") - F.col("open"), F.col("high") - F.col("low"))},
              {"ratio": "(close - open) / (nullif(high - low, 0) + 1e-12)"}, "sbars")
rolling_query("d14_bollinger", ["boll_ma20", "boll_upper", "boll_lower", "boll_width", "boll_pctb"], R.bollinger,
              {"boll_ma20": S.last("avg(close)", 20),
               "boll_upper": f"{S.last('avg(close)', 20)} + 2 * {S.last('stddev_samp(close)', 20)}",
               "boll_lower": f"{S.last('avg(close)', 20)} - 2 * {S.last('stddev_samp(close)', 20)}",
               "boll_width": f"4 * {S.last('stddev_samp(close)', 20)} / ({S.last('avg(close)', 20)} + 1e-12)",
               "boll_pctb": f"(close - ({S.last('avg(close)', 20)} - 2 * {S.last('stddev_samp(close)', 20)})) / (4 * {S.last('stddev_samp(close)', 20)} + 1e-12)"},
              "bars", 7)


@query("d3_ema", S.factor_sql(final("smooth", "entity, date", "ema5 ema12 ema26 ema60", 6), smooth=True))
def ema(spark, root):
    spans = {f"ema{n}": ("close", n) for n in (5, 12, 26, 60)}
    return report(R.with_ema(fx.bars(spark, root), spans).select("entity", "date", *spans), 6)


@query("d4_rolling_skew", S.factor_sql(final("fac", "entity, date", "skew", 6)))
def skew(spark, root):
    return report(technical_factors(fx.bars(spark, root)).select("entity", "date", "skew"), 6)


@query("d5_rolling_kurtosis", S.factor_sql(final("fac", "entity, date", "kurtosis", 6)))
def kurtosis(spark, root):
    return report(technical_factors(fx.bars(spark, root)).select("entity", "date", "kurtosis"), 6)


@query("d6_rolling_corr", S.with_base(final(
    f"SELECT entity, date, {S.corr('close', 'volume')} AS corr20 FROM sbars", "entity, date", "corr20", 6)))
def corr(spark, root):
    bars = fx.thin_rows(spark, root).select("entity", "date", R.rolling_corr("close", "volume", 20).alias("corr20"))
    return report(bars.withColumn("corr20", finite("corr20")), 6)


@query("d7_rolling_zscore", S.with_base(final(
    f"SELECT entity, date, (close - {S.last('avg(close)', 60)}) / ({S.last('stddev_samp(close)', 60)} + 1e-12) AS z60 FROM sbars",
    "entity, date", "z60", 6)))
def zscore(spark, root):
    return report(fx.thin_rows(spark, root).select("entity", "date", R.rolling_zscore("close", 60).alias("z60")), 6)


@query("d8_pct_change_filled", S.with_base(final(f"""
SELECT entity, date, x / lag(x, 5) OVER ({S.O}) - 1 AS change5 FROM (
  SELECT entity, date, last_value(g IGNORE NULLS) OVER ({S.O}) AS x FROM (
    SELECT entity, date, CASE WHEN volume > 10 THEN close END AS g FROM sbars))""", "entity, date", "change5")))
def pct_change(spark, root):
    gappy = fx.thin_rows(spark, root).select("entity", "date", F.when(F.col("volume") > 10, F.col("close")).alias("g"))
    filled = gappy.withColumn("x", R.forward_fill("g"))
    return report(filled.select("entity", "date", R.pct_change("x", 5).alias("change5")))


@query("d11_true_range", S.factor_sql(final("f2", "entity, date", "tr")))
def true_range(spark, root):
    bars = fx.bars(spark, root).withColumn("prev_close", R.shifted("close"))
    return report(bars.select("entity", "date", R.true_range().alias("tr")))


@query("d12_rsi", S.factor_sql(final("smooth", "entity, date", "rsi14 rsi5", 5), smooth=True))
def rsi(spark, root):
    return report(R.with_rsi(fx.bars(spark, root)).select("entity", "date", "rsi14", "rsi5"), 5)


@query("d13_macd", S.factor_sql(final("smooth", "entity, date", "macd_dif macd_dea macd_hist", 5), smooth=True))
def macd(spark, root):
    return report(R.with_macd(fx.bars(spark, root)).select("entity", "date", "macd_dif", "macd_dea", "macd_hist"), 5)


@query("d15_rolling_rank_of_last", S.with_base(final(f"""
SELECT entity, date, CASE WHEN len(v) >= 60 THEN
  (len(list_filter(v, lambda x: x < close)) + (len(list_filter(v, lambda x: x = close)) + 1) / 2.0) / len(v) END AS rank252
FROM (SELECT entity, date, close, list(close) OVER ({S.O} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS v FROM ibars)""",
    "entity, date", "rank252")))
def rank_of_last(spark, root):
    bars = fx.indices(spark, root)
    return report(bars.select("entity", "date", R.rank_of_last("close", 252, 60).alias("rank252")))


@query("d16_forward_fill", S.with_base(f"""
SELECT entity, date, last_value(g IGNORE NULLS) OVER ({S.O}) AS filled FROM (
  SELECT entity, date, CASE WHEN volume > 20 THEN volume END AS g FROM sbars)"""))
def forward_fill(spark, root):
    gappy = fx.thin_rows(spark, root).withColumn("g", F.when(F.col("volume") > 20, F.col("volume")))
    return gappy.select("entity", "date", R.forward_fill("g").alias("filled"))


@query("d17_running_product_max", S.with_base(final(f"""
SELECT entity, date, product(close / prev_close) OVER ({S.O}) AS growth, max(close) OVER ({S.O}) AS top
FROM ibars WHERE prev_close IS NOT NULL""", "entity, date", "growth top", 6)))
def running(spark, root):
    moves = fx.indices(spark, root).where("prev_close IS NOT NULL")
    growth = R.running_product(F.col("close") / F.col("prev_close"))
    return report(moves.select("entity", "date", growth.alias("growth"), R.running_max("close").alias("top")), 6)


# ---------------------------------------------------------------- factors

FACTOR_GROUPS = {
    "e01_returns": (["ret", "ret_abs"], 9),
    "e02_pvo": (["pvo"], 7),
    "e03_sse": (["sse"], 9),
    "e04_liq": (["liq"], 6),
    "e05_skew_kurtosis": (["skew", "kurtosis"], 6),
    "e06_gap": (["gap"], 9),
    "e07_vol_ratios": (["vts", "vcbl"], 7),
    "e08_vcll": (["vcll"], 7),
    "e09_rvr": (["rvr"], 6),
    "e10_csl": (["csl"], 9),
    "e11_rev": (["rev"], 6),
    "e12_lip": (["lip"], 6),
    "e13_vol_per_trade": (["vol_per_trade"], 7),
    "e14_moving_averages": ([x for n in SPANS for x in (f"ma{n}", f"ema{n}", f"price_ma{n}_ratio", f"ma{n}_slope")], 7),
    "e15_crosses": (["ma5_10_cross", "ma10_20_cross", "ma20_60_cross"], 9),
    "e16_rsi": (["rsi14", "rsi5"], 5),
    "e17_macd": (["macd_dif", "macd_dea", "macd_hist"], 5),
    "e18_bollinger": (["boll_ma20", "boll_width", "boll_pctb"], 7),
    "e19_range": (["atr14", "hl_range"], 7),
    "e20_candles": (["candle_body", "candle_upper", "candle_lower", "body_ratio", "upper_ratio", "lower_ratio"], 7),
    "e21_turnover": (["turnover", "turnover_ma20_ratio", "turnover_std20_ratio"], 7),
    "e22_correlations": (["price_turnover_corr20", "volume_price_corr20", "vol_ret_corr20_lag1"], 6),
    "e23_volume_variation": (["vol_std20_over_mean20", "vol_cv_20"], 7),
    "e24_momentum": ([x for n in SPANS for x in (f"mom{n}", f"mom{n}_z")], 6),
    "e25_return_moments": ([x for n in SPANS for x in (f"ret_std{n}", f"ret_mean{n}")], 8),
    "e26_turnover_ratios": ([x for n in SPANS for x in (f"turnover_mean_ratio_{n}", f"turnover_std_ratio_{n}")], 6),
    "e27_price_position": ([f"price_pos_{n}" for n in (20, 60, 120)], 7),
}


def factor_query(name, columns, digits):
    if S.SMOOTHED & set(columns):
        sql = S.with_base(final("allfac", "entity, date", columns, digits), *S.FACTORS, *S.SMOOTH,
                          S.all_factors_relation(), recursive=True)
    else:
        sql = S.factor_sql(final("fac", "entity, date", columns, digits))

    @query(name, sql)
    def run(spark, root):
        return report(market_state(fx.bars(spark, root)).select("entity", "date", *columns), digits)


for _name, (_columns, _digits) in FACTOR_GROUPS.items():
    factor_query(_name, _columns, _digits)


FINE = {c: d for columns, d in FACTOR_GROUPS.values() for c in columns if d < 7}


@query("e28_all_factors", S.with_base(final("allfac", "entity, date", FACTOR_COLUMNS, 7, **FINE), *S.FACTORS, *S.SMOOTH,
                                      S.all_factors_relation(), recursive=True))
def all_factors(spark, root):
    return report(in_contract_order(technical_factors(fx.bars(spark, root))), 7, **FINE)
