"""Queries over scores and positions: labels (g), selection (l), simulation (m), evaluation (n), sweep (q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.config import Costs, Selection, Stops
from tapeloom.fixed_values import COOLDOWN_GRID, STOP_LOSS_GRID, TAKE_PROFIT_GRID
from tapeloom.operators import evaluation as E
from tapeloom.operators import labels as G
from tapeloom.operators import selection as L
from tapeloom.operators import simulate as M
from tapeloom.operators import stops as X
from tapeloom.plans import fixtures as fx
from tapeloom.plans import sqltext as S
from tapeloom.plans.registry import final, query, report
from tapeloom.plans.stopsql import stop_relations

COSTS = Costs()

# ---------------------------------------------------------------- labels


@query("g1_weekly_labels", S.with_base(final("labels_", "sample_date, entity", "next_week_return"), S.LABELS))
def weekly_labels(spark, root):
    return report(fx.labels(spark, root))


@query("g2_update_labels", S.with_base(final("labels_", "sample_date, entity", "next_week_return"), S.LABELS))
def update_labels(spark, root):
    stored = fx.labels(spark, root).where("sample_date < DATE '2000-01-01'")
    return report(G.update_labels(stored, fx.bars(spark, root), fx.weeks(spark, root)))


@query("g3_labels_net_of_costs", S.with_base(final(
    "SELECT sample_date, entity, c1 * (1 - CAST(0.002 AS DOUBLE)) / (o0 * (1 + CAST(0.0015 AS DOUBLE))) - 1 AS net FROM labels_",
    "sample_date, entity", "net"), S.LABELS))
def labels_net(spark, root):
    net = G.weekly_labels(fx.bars(spark, root), fx.weeks(spark, root), COSTS)
    return report(net.withColumnRenamed("next_week_return", "net"))


def _asset_sql(mode):
    start = "n.date <= e.date" if mode == "o2c" else "TRUE"
    base = "n.open" if mode == "o2c" else "b.close"
    return S.with_base(final(f"""
SELECT w.entity, w.f0 AS sample_date, e.close / {base} - 1 AS ret FROM (
  SELECT s.entity, k.date AS f0,
    (SELECT max(i.date) FROM own i WHERE i.entity = s.entity AND i.date <= k.date) AS d0,
    (SELECT max(i.date) FROM own i WHERE i.entity = s.entity AND i.date <= k.next_week_end) AS d1
  FROM (SELECT DISTINCT entity FROM own) s CROSS JOIN weeks k WHERE k.next_week_end IS NOT NULL) w
JOIN own b ON b.entity = w.entity AND b.date = w.d0
LEFT JOIN own n ON n.entity = w.entity AND n.date = b.nxt
JOIN own e ON e.entity = w.entity AND e.date = w.d1
WHERE {start} AND {base} > 0""", "entity, sample_date", "ret"),
        f"own AS (SELECT *, lead(date) OVER ({S.O}) AS nxt FROM bars)")


def asset_query(name, mode):
    @query(name, _asset_sql(mode))
    def run(spark, root):
        return report(G.asset_week_returns(fx.bars(spark, root), fx.weeks(spark, root), mode))


asset_query("g4_asset_week_open_to_close", "o2c")
asset_query("g4b_asset_week_close_to_close", "c2c")


@query("g5_cost_terms", S.with_base(final(
    "SELECT entity, date, open * 1.0015 AS buy_at, close * 0.998 AS sell_at FROM bars", "entity, date", "buy_at sell_at", 7)))
def cost_terms(spark, root):
    return report(fx.bars(spark, root).select(
        "entity", "date", (F.col("open") * (1 + COSTS.buy)).alias("buy_at"), (F.col("close") * (1 - COSTS.sell)).alias("sell_at")), 7)


# ---------------------------------------------------------------- selection

NEUTRAL = """
wn AS (SELECT s.date, s.entity, s.score, ids.id, least(greatest(s.score, q.lo), q.hi) AS sw FROM scores s
       JOIN ids ON ids.entity = s.entity
       JOIN (SELECT date, quantile_cont(score, 0.05) AS lo, quantile_cont(score, 0.95) AS hi FROM scores GROUP BY date) q ON q.date = s.date),
neutral AS (SELECT date, entity, score, sw - avg(sw) OVER (PARTITION BY date, id) AS score_neutral FROM wn)"""

SIZE = """
lc AS (SELECT s.date, s.entity, ln(c.market_cap) AS x FROM scores s JOIN caps c ON c.date = s.date AND c.entity = s.entity
       WHERE c.market_cap > 0),
ed AS (SELECT date, count(*) AS n, list_distinct([quantile_cont(x, 0.0), quantile_cont(x, 0.25), quantile_cont(x, 0.5),
         quantile_cont(x, 0.75), quantile_cont(x, 1.0)]) AS e FROM lc GROUP BY date HAVING count(*) >= 4),
bn AS (SELECT s.date, s.entity, s.score, greatest(len(list_filter(ed.e, lambda v: v < lc.x)), 1) - 1 AS bin
       FROM scores s LEFT JOIN lc ON lc.date = s.date AND lc.entity = s.entity LEFT JOIN ed ON ed.date = s.date),
sized AS (SELECT date, entity, score, bin, CASE WHEN bin IS NULL THEN score
          ELSE score - avg(score) OVER (PARTITION BY date, bin) END AS score_neutral_mkt FROM bn)"""


@query("l1_industry_neutral", S.with_base(final("neutral", "date, entity", "score score_neutral", 8), S.SCORES, S.IDS, NEUTRAL))
def industry_neutral(spark, root):
    out = L.industry_neutral(fx.scores(spark, root), fx.industry_ids(spark, root), 0.05)
    return report(out.select("date", "entity", "score", "score_neutral"), 8)


@query("l2_size_neutral", S.with_base(final("sized", "date, entity", "score score_neutral_mkt", 8), S.SCORES, S.CAPS, SIZE))
def size_neutral(spark, root):
    out = L.size_neutral(fx.scores(spark, root), fx.market_caps(spark, root), "score", 4)
    return report(out.select("date", "entity", "score", "score_neutral_mkt"), 8)


@query("l3_select_on_neutral_score", S.with_base("""
SELECT date, entity FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(score_neutral, 9) DESC, entity) AS rn,
  count(*) OVER (PARTITION BY date) AS n FROM neutral)
WHERE n >= 3 AND rn <= greatest(least(floor(n * CAST(0.4 AS DOUBLE)), 7), CASE WHEN floor(n * CAST(0.4 AS DOUBLE)) = 0 THEN 3 ELSE 0 END)
  AND greatest(least(floor(n * CAST(0.4 AS DOUBLE)), 7), CASE WHEN floor(n * CAST(0.4 AS DOUBLE)) = 0 THEN 3 ELSE 0 END) >= 3""",
    S.SCORES, S.IDS, NEUTRAL))
def select_neutral(spark, root):
    by = L.score_column(industry=True, size=False)
    out = L.industry_neutral(fx.scores(spark, root), fx.industry_ids(spark, root), 0.05)
    return L.select_names(out.withColumn(by, F.round(by, 9)), fx.PICK, by).select("date", "entity")


@query("l4_top_names_equal_weight", S.with_base(final("picked", "date, entity", "score weight"), S.SCORES, S.PICKED))
def top_names(spark, root):
    return report(fx.picked(spark, root).select("date", "entity", "score", "weight"))


@query("l5_score_weights", S.with_base(final("""
SELECT date, entity, CASE WHEN t > 0 THEN greatest(score, 0) / t ELSE CAST(1 AS DOUBLE) / m END AS weight FROM (
  SELECT *, sum(greatest(score, 0)) OVER (PARTITION BY date) AS t, count(*) OVER (PARTITION BY date) AS m
  FROM sel2 WHERE score > 0) WHERE m >= 3""", "date, entity", "weight"), S.SCORES, S.PICKED))
def score_weights(spark, root):
    cfg = Selection(top_pct=0.4, max_n=7, min_n=3, positive_only=True, weight_mode="score")
    return report(fx.picked(spark, root, cfg).select("date", "entity", "weight"))


@query("l6_rebalance_plan", S.with_base(
    "SELECT date, pick_date, signal_date FROM plan WHERE pick_date IS NOT NULL", S.SCORES, S.PICKED, S.POSITIONS))
def rebalance(spark, root):
    return L.rebalance_plan(fx.scores(spark, root), fx.picked(spark, root), 2)


@query("l7_daily_positions", S.with_base(final("positions", "date, entity, signal_date", "weight score"), S.SCORES, S.PICKED, S.POSITIONS))
def daily_positions(spark, root):
    return report(fx.positions(spark, root).select("date", "entity", "signal_date", "weight", "score"))


@query("l8_load_scores", S.with_base(final(
    "SELECT * FROM scores WHERE date BETWEEN DATE '1998-01-01' AND DATE '2000-12-31'", "date, entity", "score"), S.SCORES))
def load_scores(spark, root):
    return report(L.load_scores(fx.scores(spark, root), "1998-01-01", "2000-12-31"))


# ---------------------------------------------------------------- simulation


@query("m1_transitions", S.with_base(final("moves", "date, entity, path", "weight prev_weight"), *S.BOOK))
def transitions(spark, root):
    return report(fx.moves(spark, root).select("date", "entity", "path", "weight", "prev_weight"))


@query("m2_daily_returns", S.with_base(final("daily", "date, n_long", "ret_total"), *S.BOOK))
def daily_returns(spark, root):
    nav = M.daily_nav(M.stock_returns(fx.moves(spark, root), COSTS))
    return report(nav.select("date", "n_long", "ret_total"))


@query("m3_nav", S.with_base(final("navs", "date, n_long", "ret_total nav", 7), *S.BOOK))
def nav(spark, root):
    out = M.daily_nav(M.stock_returns(fx.moves(spark, root), COSTS))
    return report(out.select("date", "n_long", "ret_total", "nav"), 7)


@query("m4_contributions", S.with_base(final("stock_rets", "date, entity, path", "weight ret contribution"), *S.BOOK))
def contributions(spark, root):
    return report(M.stock_returns(fx.moves(spark, root), COSTS))


@query("m5_trade_log", S.with_base(final(
    "SELECT * FROM tlog WHERE path <> 'keep' AND (path = 'reduce' OR entry_price IS NOT NULL)",
    "date, entity, action", "entry_price exec_price", 7), *S.BOOK))
def trade_log(spark, root):
    return report(M.trade_log(fx.moves(spark, root), COSTS), 7)


STOP_SQL = {
    "nav": ("st_nav", "param_id, date, n_long", "ret_long ret_short ret_total nav"),
    "trades": ("st_trades", "param_id, date, entity, action", "entry_price exec_price"),
    "returns": ("st_rets", "param_id, date, entity, path", "weight ret contribution"),
}


def stop_query(name, events, stops):
    relation, keys, doubles = STOP_SQL[events]

    @query(name, S.with_base(final(relation, keys, doubles, 7), *S.BOOK, stop_relations([("base", stops)], COSTS), recursive=True))
    def run(spark, root):
        book = fx.positions(spark, root), fx.bars(spark, root)
        out = X.simulate(*book, [("base", stops)], COSTS)
        if events == "nav":
            return report(X.stopped_nav(out, *book, ["base"]), 7)
        return report({"trades": X.trades_of, "returns": X.returns_of}[events](out), 7)


stop_query("m6_fixed_stops_nav", "nav", Stops(take_profit=0.15, stop_loss=0.05))
stop_query("m7_trailing_stops_trades", "trades", Stops(rules=("trailing_sl",)))
stop_query("m8_rule_chain_trades", "trades", Stops(rules=("fixed_tp_sl", "trailing_sl", "no_such_rule"), stop_loss=0.08, take_profit=0.3))
stop_query("m9_cooldown_returns", "returns", Stops(take_profit=0.1, stop_loss=0.05, cooldown_days=10))
stop_query("m10_blocked_reentry_nav", "nav", Stops(take_profit=0.1, stop_loss=0.05, block_reentry_returns=True))


@query("m11_stops_off_equal_plain_nav", S.with_base(final("navs", "date, n_long", "ret_total nav", 7), *S.BOOK))
def stops_off(spark, root):
    off = Stops(take_profit=99.0, stop_loss=99.0)
    book = fx.positions(spark, root), fx.bars(spark, root)
    events = X.simulate(*book, [("off", off)], COSTS)
    return report(X.stopped_nav(events, *book, ["off"]).select("date", "n_long", "ret_total", "nav"), 7)


@query("m11b_stops_off_trades", S.with_base(final(
    "SELECT * FROM tlog WHERE path <> 'keep' AND (path = 'reduce' OR entry_price IS NOT NULL)",
    "date, entity, action", "entry_price exec_price", 7), *S.BOOK))
def stops_off_trades(spark, root):
    off = Stops(rules=())
    events = X.simulate(fx.positions(spark, root), fx.bars(spark, root), [("off", off)], COSTS)
    return report(X.trades_of(events).drop("param_id"), 7)


# ---------------------------------------------------------------- evaluation

RANKED = """
pairs AS (SELECT s.date, s.entity, s.score, l.next_week_return AS ret FROM scores s
          JOIN labels_ l ON l.sample_date = s.date AND l.entity = s.entity),
rk AS (SELECT date, entity, score, ret,
         rank() OVER (PARTITION BY date ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0 AS rs,
         rank() OVER (PARTITION BY date ORDER BY ret) + (count(*) OVER (PARTITION BY date, ret) - 1) / 2.0 AS rr,
         CAST(row_number() OVER (PARTITION BY date ORDER BY score, md5(entity)) AS DOUBLE) AS os,
         CAST(row_number() OVER (PARTITION BY date ORDER BY ret, md5(entity)) AS DOUBLE) AS ot FROM pairs),
ic AS (SELECT date, count(*) AS n, corr(rs, rr) AS rank_ic FROM rk GROUP BY date HAVING count(*) >= 5)"""
IC = (S.SCORES, S.LABELS, RANKED)


def rank_ic_frame(spark, root):
    return E.rank_ic(fx.scores(spark, root), fx.labels(spark, root))


@query("n1_rank_ic", S.with_base(final("ic", "date, n", "rank_ic"), *IC))
def rank_ic(spark, root):
    return report(rank_ic_frame(spark, root))


@query("n2_rank_ic_ordinal", S.with_base(final(
    "SELECT date, count(*) AS n, CASE WHEN count(*) >= 2 THEN corr(os, ot) ELSE 0 END AS rank_ic FROM rk GROUP BY date",
    "date, n", "rank_ic"), *IC))
def rank_ic_ordinal(spark, root):
    return report(E.rank_ic_ordinal(fx.scored_returns(spark, root)))


@query("n3_pearson_ic", S.with_base(final(
    "SELECT date, count(*) AS n, CASE WHEN var_pop(score) > 1e-12 AND var_pop(ret) > 1e-12 THEN corr(score, ret) END AS ic FROM pairs GROUP BY date",
    "date, n", "ic"), *IC))
def pearson_ic(spark, root):
    return report(E.pearson_ic(fx.scored_returns(spark, root)))


@query("n4_ic_summary", S.with_base(final("""
SELECT count(*) AS n_weeks, avg(rank_ic) AS ic_mean, stddev_samp(rank_ic) AS ic_std, avg(rank_ic) / stddev_samp(rank_ic) AS icir,
  avg(rank_ic) / (stddev_samp(rank_ic) / sqrt(count(*))) AS t_stat FROM ic""", "n_weeks", "ic_mean ic_std icir t_stat"), *IC))
def ic_summary(spark, root):
    return report(E.ic_summary(rank_ic_frame(spark, root)))


@query("f10_yearly_stats", S.with_base(final("""
SELECT CAST(year(date) AS INT) AS year, count(*) AS n, avg(rank_ic) AS mean, stddev_samp(rank_ic) AS std,
  avg(rank_ic) / stddev_samp(rank_ic) AS ir FROM ic GROUP BY ROLLUP (1)""", "year, n", "mean std ir"), *IC))
def yearly(spark, root):
    return report(E.yearly_stats(rank_ic_frame(spark, root), "rank_ic"))


@query("n5_normalised_weights", S.with_base(final("""
SELECT date, entity, CASE WHEN t > 0 THEN w / t ELSE w END AS weight FROM (
  SELECT *, sum(w) OVER (PARTITION BY date) AS t FROM (SELECT date, entity, sum(score) AS w FROM positions GROUP BY 1, 2))""",
    "date, entity", "weight", 7), S.SCORES, S.PICKED, S.POSITIONS))
def normalised(spark, root):
    raw = fx.positions(spark, root).select("date", "entity", F.col("score").alias("weight"))
    return report(E.normalised_weights(raw), 7)


@query("n6_turnover", S.with_base(final("""
SELECT date, least(greatest(0.5 * sum(abs(weight - prev_weight)), 0), 1) AS turnover FROM (
  SELECT e.entity, md.date, md.ord, coalesce(p.weight, 0) AS weight,
    coalesce(lag(p.weight) OVER (PARTITION BY e.entity ORDER BY md.date), 0) AS prev_weight
  FROM (SELECT DISTINCT entity FROM positions) e CROSS JOIN (SELECT date, row_number() OVER (ORDER BY date) AS ord FROM (SELECT DISTINCT date FROM positions)) md
  LEFT JOIN positions p ON p.entity = e.entity AND p.date = md.date) WHERE ord > 1 GROUP BY date""", "date", "turnover"),
    S.SCORES, S.PICKED, S.POSITIONS))
def turnover(spark, root):
    return report(E.turnover(E.normalised_weights(fx.positions(spark, root))))


@query("n7_read_returns", S.with_base(final("""
SELECT series_id, date, ret FROM (SELECT entity AS series_id, date,
  CASE WHEN entity = 'A' THEN close / prev_close - 1 ELSE close / lag(close) OVER (PARTITION BY entity ORDER BY date) - 1 END AS ret
  FROM ibars) WHERE ret IS NOT NULL""", "series_id, date", "ret")))
def read_returns(spark, root):
    nav = fx.indices(spark, root).select(
        F.col("entity").alias("series_id"), "date", F.col("close").alias("nav"),
        F.when(F.col("entity") == "A", F.col("close") / F.col("prev_close") - 1).alias("ret_total"))
    return report(E.read_returns(nav))


SNAV = """
sn AS (SELECT series_id, date, ret, CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY date) = 1 THEN 1
         ELSE product(1 + ret) OVER (PARTITION BY series_id ORDER BY date) END AS nav FROM ir)"""


@query("n8_standard_nav", S.with_base(final("sn", "series_id, date", "ret nav", 6), S.INDEX_RETURNS, SNAV))
def standard_nav(spark, root):
    return report(E.standard_nav(fx.index_returns(spark, root)), 6)


@query("n9_max_drawdown", S.with_base(final("""
SELECT t.series_id, t.dd AS max_drawdown, t.date AS end_date,
  (SELECT min(p.date) FROM pk p WHERE p.series_id = t.series_id AND p.date <= t.date AND abs(p.nav - t.peak) <= 1e-12) AS start_date,
  date_diff('day', (SELECT min(p.date) FROM pk p WHERE p.series_id = t.series_id AND p.date <= t.date AND abs(p.nav - t.peak) <= 1e-12), t.date) AS recovery_days
FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY dd DESC, date) AS k FROM pk) t WHERE k = 1""",
    "series_id, start_date, end_date, recovery_days", "max_drawdown", 7), S.INDEX_RETURNS, SNAV,
    "pk0 AS (SELECT *, max(nav) OVER (PARTITION BY series_id ORDER BY date) AS peak FROM sn)",
    "pk AS (SELECT *, 1 - nav / peak AS dd FROM pk0)"))
def max_drawdown(spark, root):
    return report(E.max_drawdown(E.standard_nav(fx.index_returns(spark, root))), 7)


def perf_sql(source, key):
    return f"""
SELECT {key}, tr AS total_return, pow(1 + tr, CAST(252 AS DOUBLE) / n) - 1 AS annual_return, coalesce(sd * sqrt(252), 0) AS annual_vol,
  CASE WHEN sd > 0 THEN m / sd * sqrt(252) END AS sharpe, mdd AS max_drawdown,
  CASE WHEN mdd > 1e-12 THEN (pow(1 + tr, CAST(252 AS DOUBLE) / n) - 1) / mdd END AS calmar, n AS n_periods
FROM (SELECT {key}, arg_max(nav, date) - 1 AS tr, avg(ret) AS m, stddev_samp(ret) AS sd, max(1 - nav / peak) AS mdd, count(*) AS n
  FROM (SELECT *, max(nav) OVER (PARTITION BY {key} ORDER BY date) AS peak FROM (
    SELECT *, product(1 + ret) OVER (PARTITION BY {key} ORDER BY date) AS nav FROM {source})) GROUP BY {key})"""


PERF = "total_return annual_return annual_vol sharpe max_drawdown calmar"
SCOPED = "sc AS (SELECT series_id, date, ret, NULL AS year FROM ir UNION ALL SELECT series_id, date, ret, CAST(year(date) AS INT) FROM ir)"


@query("n10_performance", S.with_base(final(perf_sql("ir", "series_id"), "series_id, n_periods", PERF, 6), S.INDEX_RETURNS))
def performance(spark, root):
    return report(E.performance(fx.index_returns(spark, root)), 6)


@query("n11_full_metrics", S.with_base(final(perf_sql("sc", "series_id, year"), "series_id, year, n_periods", PERF, 6), S.INDEX_RETURNS, SCOPED))
def full_metrics(spark, root):
    return report(E.full_metrics(fx.index_returns(spark, root)), 6)


@query("n12_excess_nav", S.with_base(final("""
SELECT a.series_id, a.date, a.ret - b.ret AS ret, product(1 + (a.ret - b.ret)) OVER (PARTITION BY a.series_id ORDER BY a.date) AS excess_nav
FROM ir a JOIN ir b ON b.date = a.date AND b.series_id = 'N' WHERE a.series_id <> 'N'""", "series_id, date", "ret excess_nav", 6), S.INDEX_RETURNS))
def excess(spark, root):
    r = fx.index_returns(spark, root)
    return report(E.excess(r.where("series_id <> 'N'"), r.where("series_id = 'N'")), 6)


@query("n13_simple_performance", S.with_base(final("""
SELECT series_id, pow(1 + avg(ret), 252) - 1 AS annual_return, stddev_samp(ret) * sqrt(252) AS annual_vol,
  (pow(1 + avg(ret), 252) - 1) / (stddev_samp(ret) * sqrt(252)) AS sharpe FROM ir GROUP BY 1""",
    "series_id", "annual_return annual_vol sharpe", 6), S.INDEX_RETURNS))
def simple_performance(spark, root):
    return report(E.simple_performance(fx.index_returns(spark, root)), 6)


@query("n14_performance_report", S.with_base(final(perf_sql("rp", "series_id, year"), "series_id, year, n_periods", PERF, 6), S.INDEX_RETURNS, """
cm AS (SELECT * FROM ir WHERE date IN (SELECT date FROM ir GROUP BY date HAVING count(*) = 3)),
al AS (SELECT * FROM cm UNION ALL SELECT 'A - N', a.date, a.ret - b.ret FROM cm a JOIN cm b ON b.date = a.date
       WHERE a.series_id = 'A' AND b.series_id = 'N'),
rp AS (SELECT series_id, date, ret, NULL AS year FROM al UNION ALL SELECT series_id, date, ret, CAST(year(date) AS INT) FROM al)"""))
def performance_report(spark, root):
    return report(E.performance_report(fx.index_returns(spark, root), "A", "N"), 6)


# ---------------------------------------------------------------- sweep


SWEEP = X.grid(TAKE_PROFIT_GRID, STOP_LOSS_GRID, COOLDOWN_GRID)
SWEEP_SQL = """
SELECT tp AS take_profit, sl AS stop_loss, cd AS cooldown_days, CASE WHEN sd > 0 THEN m / sd * sqrt(CAST(252 AS DOUBLE)) END AS sharpe
FROM st_set JOIN (SELECT param_id, avg(ret_total) AS m, stddev_samp(ret_total) AS sd FROM st_daily GROUP BY param_id) USING (param_id)"""


def sweep_sql(body):
    return S.with_base(body, *S.BOOK, stop_relations(SWEEP, COSTS), recursive=True)


def sweep_results(spark, root):
    return X.sweep(fx.positions(spark, root), fx.bars(spark, root), SWEEP, COSTS)


@query("q1_stop_sweep", sweep_sql(final(SWEEP_SQL, "", "take_profit stop_loss cooldown_days sharpe", 7)))
def stop_sweep(spark, root):
    return report(sweep_results(spark, root), 7)


@query("q2_sweep_table", sweep_sql(final(
    "SELECT take_profit, stop_loss, " + ", ".join(f"max(CASE WHEN cooldown_days = {c!r} THEN sharpe END) AS cd_{c:g}" for c in COOLDOWN_GRID)
    + f" FROM ({SWEEP_SQL}) GROUP BY take_profit, stop_loss",
    "", ["take_profit", "stop_loss", *(f"cd_{c:g}" for c in COOLDOWN_GRID)], 7)))
def sweep_table(spark, root):
    return report(X.sweep_table(sweep_results(spark, root), COOLDOWN_GRID), 7)
