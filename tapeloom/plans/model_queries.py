"""Queries over models (j), timing and allocation (c9, o) and streams (s)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tapeloom.config import Allocation, Costs, Stops, WalkForward
from tapeloom.fixed_values import FACTOR_COLUMNS, MARKET_PROXY_PATTERNS
from tapeloom.models import boosting as MB
from tapeloom.models import moments as MM
from tapeloom.models import walkforward as J
from tapeloom.operators import allocation as O
from tapeloom.operators import samples as I
from tapeloom.operators import stops as X
from tapeloom.operators import store as ST
from tapeloom.operators import timing as T
from tapeloom.operators.aggregates import context_features, daily_features
from tapeloom.operators.calendar import days, schedule
from tapeloom.operators.labels import asset_week_returns
from tapeloom.operators.pairwise import pairwise_loss
from tapeloom.operators.universe import tradable
from tapeloom.plans import fixtures as fx
from tapeloom.plans import sqltext as S
from tapeloom.plans.portfolio_queries import RANKED
from tapeloom.plans.registry import final, query, report
from tapeloom.plans.stopsql import stop_relations
from tapeloom.session import shared_dir
from tapeloom.sources.bars import master, table
from tapeloom.sources.readers import market_proxy
from tapeloom.streaming import live

# ---------------------------------------------------------------- models

SCHEDULE = WalkForward(train_weeks=260, val_weeks=52, step_weeks=52)
ALPHAS = (0.1, 1.0, 10.0, 100.0)


@fx.stored("model_rows")
def model_rows(spark, root):
    """Nine numbers of every factor and the market context, for the tradable samples."""
    features = ST.summarised(fx.feature_store(spark, root), FACTOR_COLUMNS)
    return I.model_rows(features, fx.labels(spark, root), tradable(fx.flagged(spark, root)), fx.context(spark, root))


def _plan(spark, root):
    return schedule(fx.weeks(spark, root), SCHEDULE)


@fx.stored("ridges")
def ridges(spark, root):
    return MM.fit_ridges(model_rows(spark, root), _plan(spark, root), ALPHAS)


@fx.stored("ridge_scores")
def ridge_scores(spark, root):
    rows, plan = model_rows(spark, root), _plan(spark, root)
    return MM.score(rows, plan, ridges(spark, root), ("val", "predict"), [J.LABEL])


@query("j1_walk_forward_ridge")
def ridge(spark, root):
    rows, plan = model_rows(spark, root), _plan(spark, root)
    scored = MM.score(rows, plan, MM.fit_ridges(rows, plan), ("predict",))
    return report(scored.select("window_id", "date", "entity", "score"), 6)


_BOOSTED = {}


def boosted(spark, root):
    """The trees of all windows, the held-out losses and the bins, grown once per session."""
    key = (spark.sparkContext.applicationId, root)
    if key not in _BOOSTED:
        _BOOSTED[key] = MB.fit_boosting(model_rows(spark, root), _plan(spark, root))
    return _BOOSTED[key]


@query("j2_walk_forward_boosting")
def boosting(spark, root):
    model, _, cuts = boosted(spark, root)
    scored = MB.score_boosting(model_rows(spark, root), _plan(spark, root), model, cuts, ("predict",))
    return report(scored.select("window_id", "date", "entity", "score"), 6)


def _labelled_days(spark, root):
    daily = daily_features(fx.nav(spark, root), fx.stock_returns(spark, root), fx.positions(spark, root), fx.trades(spark, root))
    return T.next_day_label(daily)


@query("j3_rolling_timing_signals")
def timing_signals(spark, root):
    """From all daily features of the book."""
    labelled = _labelled_days(spark, root)
    columns = [c for c in labelled.columns if c not in ("date", "ret_total", "ret_next", "y")]
    return report(T.rolling_signals(labelled, columns), 6)


@query("j4_scores_in_range")
def scores_in_range(spark, root):
    scored = ridge_scores(spark, root).where("role = 'predict' AND alpha = 1.0")
    return report(J.clip_scores(scored, "1999-06-01", "2001-06-30").select("window_id", "date", "entity", "score"), 6)


@query("j5_score_as_of_day")
def score_as_of(spark, root):
    """The model stored last before the day, on the windows of that day's tradable names."""
    day, home = "2001-03-25", fx.scratch(spark, root, "models")
    J.save_models(ridges(spark, root), _plan(spark, root), home)
    bars = fx.bars(spark, root)
    number = F.split("entity", "#")[1].cast("int")
    names = bars.where(F.col("date") <= day).agg(F.max("date").alias("date")).join(bars.select("date", "entity"), "date")
    st = names.select("date", "entity", F.when(number % 9 == 0, 1).otherwise(0).alias("flag"))
    end = names.select("date", F.lit(0).cast("long").alias("week_ord")).distinct()
    context = context_features(fx.indices(spark, root), fx.sector_series(spark, root), end, fx.INDICES, fx.SECTORS)
    rows = J.rows_as_of(bars, day, FACTOR_COLUMNS, master(bars), None, st, fx.UNIVERSE, context)
    model = J.model_as_of(spark, home, day).where("alpha = 1.0")
    return report(J.score_as_of(rows, model, fx.industry_ids(spark, root), fx.PICK), 6)


def _pair_sql(alpha=None):
    weight = f"least(abs(dy) / {alpha}, 3.0) * " if alpha else ""
    return f"""
SELECT date, count(*) AS n_pairs, avg({weight}(greatest(x, 0) + ln(1 + exp(-abs(x))))) AS loss FROM (
  SELECT date, dy, 0.001 - sign(dy) * ds AS x FROM (
    SELECT date, ret - lead(ret) OVER w AS dy, score - lead(score) OVER w AS ds
    FROM (SELECT *, md5(entity || ':' || r) AS h FROM pairs, (SELECT unnest(range(4)) AS r))
    WINDOW w AS (PARTITION BY date, r ORDER BY h, entity))) WHERE dy <> 0 GROUP BY date"""


@query("j6_pairwise_loss", S.with_base(final(_pair_sql(), "date, n_pairs", "loss", 8), S.SCORES, S.LABELS, RANKED))
def pair_loss(spark, root):
    return report(pairwise_loss(fx.scored_returns(spark, root), margin=0.001), 8)


@query("j7_cost_sensitive_loss", S.with_base(final(_pair_sql("0.02"), "date, n_pairs", "loss", 8), S.SCORES, S.LABELS, RANKED))
def cost_sensitive_loss(spark, root):
    return report(pairwise_loss(fx.scored_returns(spark, root), margin=0.001, alpha=0.02), 8)


def _candidates(spark, root, beta):
    """Every model of every window on its validation weeks: ridges by penalty, and boosting at its best round."""
    known = ridge_scores(spark, root).where(f"role = 'val' AND {J.LABEL} IS NOT NULL").withColumnRenamed(J.LABEL, "ret")
    ridges_ = J.registry(known.withColumn("candidate", F.concat(F.lit("ridge_"), F.col("alpha").cast("string"))), beta, ["window_id", "candidate"])
    model, _, cuts = boosted(spark, root)
    staged = MB.score_boosting(model_rows(spark, root).where(f"{J.LABEL} IS NOT NULL"), _plan(spark, root), model, cuts, ("val",), [J.LABEL], staged=True)
    trees = J.staged_registry(staged.withColumnRenamed(J.LABEL, "ret"), beta).withColumn("candidate", F.lit("boosting"))
    return ridges_.unionByName(trees, allowMissingColumns=True)


@query("j8_model_registry")
def registry(spark, root):
    return report(_candidates(spark, root, 1.0), 6)


@query("j9_best_by_validation")
def best(spark, root):
    return report(J.best_of(_candidates(spark, root, 0.1)), 6)


# ---------------------------------------------------------------- timing and allocation

FOLDS = """
nd AS (SELECT date, ret_total, row_number() OVER (ORDER BY date) - 1 AS i FROM navs),
fold AS (SELECT unnest(range(0, (SELECT CAST(floor((max(i) - 252) / 21) AS BIGINT) + 1 FROM nd))) AS fold),
fm AS (SELECT fold, avg(ret_total) AS m, stddev_pop(ret_total) AS s FROM fold JOIN nd ON i >= fold * 21 AND i < fold * 21 + 252 GROUP BY 1)"""


@query("c9_rolling_train_scaler", S.with_base(final("""
SELECT fm.fold, nd.date, (ret_total - m) / s AS z FROM fm JOIN nd ON i >= fold * 21 + 252 AND i < fold * 21 + 273""", "fold, date", "z", 6), *S.BOOK, FOLDS))
def rolling_scaler(spark, root):
    rows = fx.nav(spark, root).select("date", F.col("ret_total").alias("z"))
    folds = T.scale_by_fold(T.rolling_folds(rows), ["z"])
    return report(folds.where("role = 'predict'").select("fold", "date", "z"), 6)


@query("o1_next_day_label", S.with_base("""
SELECT date, CAST(nxt > -0.03 AS INT) AS y FROM (SELECT date, lead(ret_total) OVER (ORDER BY date) AS nxt FROM navs) WHERE nxt IS NOT NULL""", *S.BOOK))
def next_day_label(spark, root):
    return T.next_day_label(fx.nav(spark, root).select("date", "ret_total")).select("date", "y")


@query("o2_timing_overlay", S.with_base(final("""
SELECT date, signal, signal_prev, ret_total, product(1 + ret_total) OVER (ORDER BY date) AS nav FROM (
  SELECT date, signal, coalesce(s1, signal) AS signal_prev,
    CASE WHEN coalesce(s1, signal) = 1 THEN r ELSE 0 END - CASE WHEN s1 = 1 AND signal = 0 THEN 0.001 ELSE 0 END
      - CASE WHEN s2 = 0 AND s1 = 1 THEN 0.001 ELSE 0 END AS ret_total
  FROM (SELECT date, r, signal, lag(signal, 1) OVER (ORDER BY date) AS s1, lag(signal, 2) OVER (ORDER BY date) AS s2 FROM (
    SELECT n.date, n.ret_total AS r, CASE WHEN c.ord % 7 IN (2, 3) THEN 0 ELSE 1 END AS signal FROM navs n JOIN cal c ON c.date = n.date)))""",
    "date, signal, signal_prev", "ret_total nav", 7), *S.BOOK))
def timing_overlay(spark, root):
    signals = days(fx.calendar(spark, root)).select("date", F.when((F.col("ord") % 7).isin(2, 3), 0).otherwise(1).alias("signal"))
    out = T.overlay(fx.nav(spark, root), signals)
    return report(out.select("date", "signal", "signal_prev", "ret_total", "nav"), 7)


_RANK = """CASE WHEN {v} IS NOT NULL AND len(l_{v}) >= 60 THEN (len(list_filter(l_{v}, lambda x: x < {v})) + (len(list_filter(l_{v}, lambda x: x = {v})) + 1) / 2.0) / len(l_{v}) END"""
ENV = f"""
e1 AS (SELECT entity, date, open, close, coalesce(close / lag(close) OVER ({S.O}) - 1, 0) AS r FROM ibars),
e2 AS (SELECT *, CASE WHEN count(r) OVER ({S.O} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) >= 20
         THEN stddev_samp(r) OVER ({S.O} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * sqrt(252) END AS vol, CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END AS up FROM e1),
e3 AS (SELECT *, list(vol) FILTER (vol IS NOT NULL) OVER ({S.O} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS l_vol, list(up) OVER ({S.O} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS l_up FROM e2),
e4 AS (SELECT *, {_RANK.format(v='vol')} AS vr, {_RANK.format(v='up')} AS br FROM e3),
e5 AS (SELECT entity, date, close, last_value(vr IGNORE NULLS) OVER ({S.O}) AS vol_rank, last_value(br IGNORE NULLS) OVER ({S.O}) AS breadth_rank FROM e4),
eq AS (SELECT entity, count(vol_rank) AS n, [quantile_cont(vol_rank, 0.0), quantile_cont(vol_rank, 0.2), quantile_cont(vol_rank, 0.4),
         quantile_cont(vol_rank, 0.6), quantile_cont(vol_rank, 0.8), quantile_cont(vol_rank, 1.0)] AS c FROM e5 GROUP BY 1),
e6 AS (SELECT e5.*, CASE WHEN vol_rank IS NULL THEN NULL WHEN n >= 20 AND len(list_distinct(c)) = 6 THEN greatest(len(list_filter(c, lambda x: x < vol_rank)), 1)
         ELSE 1 + (vol_rank > 0.2)::INT + (vol_rank > 0.4)::INT + (vol_rank > 0.6)::INT + (vol_rank > 0.8)::INT END AS vol_q FROM e5 JOIN eq USING (entity)),
al AS (SELECT s.entity, w.date AS f0, w.next_week_end AS f1, (SELECT max(i.date) FROM ibars i WHERE i.entity = s.entity AND i.date <= w.date) AS d0,
         (SELECT max(i.date) FROM ibars i WHERE i.entity = s.entity AND i.date <= w.next_week_end) AS d1
       FROM (SELECT DISTINCT entity FROM ibars) s CROSS JOIN weeks w),
eb AS (SELECT al.entity, al.f0 AS date, CASE WHEN coalesce(vol_q, 3) <= 1 THEN 1.0 WHEN coalesce(vol_q, 3) >= 5 THEN 0.0 ELSE (5 - coalesce(vol_q, 3)) / 4.0 END AS env_base
       FROM al JOIN e6 ON e6.entity = al.entity AND e6.date = al.d0),
wr AS (SELECT al.entity, al.f0, b.close / a.close - 1 AS r FROM al JOIN ibars a ON a.entity = al.entity AND a.date = al.d0
       JOIN ibars b ON b.entity = al.entity AND b.date = al.d1 WHERE al.f1 IS NOT NULL),
wx AS (SELECT entity, f0, CASE WHEN count(r) OVER w >= 3 THEN sum(r) OVER w END AS x FROM wr WINDOW w AS (PARTITION BY entity ORDER BY f0 ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
env AS (SELECT eb.entity, eb.date, eb.env_base, least(greatest(CASE WHEN x > 0.02 THEN env_base * 0.5 WHEN x < -0.02 THEN least(1.0, env_base + 0.1) ELSE env_base END, 0.0), 1.0) AS env_strength
        FROM eb LEFT JOIN wx ON wx.entity = eb.entity AND wx.f0 = eb.date)"""


@query("o3_environment_base", S.with_base(final("env", "entity, date", "env_base"), ENV))
def environment_base(spark, root):
    return report(O.base_strength(fx.indices(spark, root), fx.weeks(spark, root)))


@query("o4_quintile_labels", S.with_base("SELECT entity, date, CAST(vol_q AS INT) AS vol_q FROM e6 WHERE vol_q IS NOT NULL", ENV))
def quintile_labels(spark, root):
    ranked = O.quintiles(O.environment_ranks(fx.indices(spark, root)), "vol_rank", "vol_q")
    return ranked.where("vol_q IS NOT NULL").select("entity", "date", F.col("vol_q").cast("int").alias("vol_q"))


@query("o4b_quintiles_without_look_ahead", S.with_base("""
SELECT entity, date, CAST(1 + (vol_rank > 0.2)::INT + (vol_rank > 0.4)::INT + (vol_rank > 0.6)::INT + (vol_rank > 0.8)::INT AS INT) AS vol_q
FROM e5 WHERE vol_rank IS NOT NULL""", ENV))
def quintiles_live(spark, root):
    ranked = O.quintiles(O.environment_ranks(fx.indices(spark, root)), "vol_rank", "vol_q", look_ahead=False)
    return ranked.where("vol_q IS NOT NULL").select("entity", "date", F.col("vol_q").cast("int").alias("vol_q"))


@fx.stored("environment")
def environment_frame(spark, root):
    return O.environment(fx.indices(spark, root), fx.weeks(spark, root))


@query("o5_environment_strength", S.with_base(final("env", "entity, date", "env_base env_strength"), ENV))
def environment(spark, root):
    return report(environment_frame(spark, root))


PATH = """
en AS (SELECT entity, date, 0.1 + 0.8 * env_strength AS t, row_number() OVER (PARTITION BY entity ORDER BY date) AS n FROM env),
path AS (SELECT entity, date, n, least(greatest(least(greatest(0.7 * t + 0.3 * CAST(0.1 AS DOUBLE), 0.0), 0.2), 0.0), 1.0) AS w_g FROM en WHERE n = 1
  UNION ALL SELECT e.entity, e.date, e.n, least(greatest(least(greatest(0.7 * e.t + 0.3 * p.w_g, p.w_g - 0.1), p.w_g + 0.1), 0.0), 1.0)
  FROM path p JOIN en e ON e.entity = p.entity AND e.n = p.n + 1)"""


@query("o6_linear_weight_path", S.with_base(final("path", "entity, date", "w_g"), ENV, PATH, recursive=True))
def linear_path(spark, root):
    return report(O.weight_path(environment_frame(spark, root)))


# States 0 neutral, 1 attack, 2 defense; the target is that of the state before the week's value moves it.
STATE_PATH = """
en7 AS (SELECT entity, date, env_strength AS e, row_number() OVER (PARTITION BY entity ORDER BY date) AS n FROM env),
path7 AS (SELECT entity, date, n, e, 0 AS state, 0 AS streak, least(greatest(least(greatest(0.7 * (CAST(0.2 AS DOUBLE) + 0.15 * least(greatest((e - 0.3) / 0.3, 0), 1)) + 0.3 * 0.1, 0.0), 0.2), 0.0), 1.0) AS w_g,
    CASE WHEN e <= 0.3 OR e >= 0.6 THEN 0 ELSE 0 END AS after, CASE WHEN e <= 0.3 OR e >= 0.6 THEN 1 ELSE 0 END AS run FROM en7 WHERE n = 1
  UNION ALL SELECT entity, date, n, e, state, streak, w_g,
    CASE WHEN mid THEN 0 WHEN asked IS NOT NULL AND streak + 1 >= 2 THEN asked ELSE state END,
    CASE WHEN mid OR (asked IS NOT NULL AND streak + 1 >= 2) THEN 0 WHEN asked IS NOT NULL THEN streak + 1 ELSE streak END
  FROM (SELECT x.entity, x.date, x.n, x.e, p.after AS state, p.run AS streak, NOT (x.e <= 0.3) AND NOT (x.e >= 0.6) AS mid,
      CASE WHEN x.e <= 0.3 AND p.after <> 1 THEN 1 WHEN x.e >= 0.6 AND p.after <> 2 THEN 2 END AS asked,
      least(greatest(least(greatest(0.7 * CASE p.after WHEN 0 THEN CAST(0.2 AS DOUBLE) + 0.15 * least(greatest((x.e - 0.3) / 0.3, 0), 1) WHEN 1 THEN 0.05 ELSE 0.5 END
        + 0.3 * p.w_g, p.w_g - 0.1), p.w_g + 0.1), 0.0), 1.0) AS w_g
    FROM path7 p JOIN en7 x ON x.entity = p.entity AND x.n = p.n + 1))"""


@query("o7_state_weight_path", S.with_base(final("path7", "entity, date", "w_g"), ENV, STATE_PATH, recursive=True))
def state_path(spark, root):
    return report(O.weight_path(environment_frame(spark, root), Allocation(mode="state")))


@query("o8_combined_return", S.with_base(final("""
SELECT date, ret_combo, product(1 + ret_combo) OVER (ORDER BY date) AS nav_combo FROM (
  SELECT date, coalesce(lag(1 - w_g) OVER (ORDER BY date) * coalesce(ret_s, 0) + lag(w_g) OVER (ORDER BY date) * ret_g * (1 - 0.0015), 0) AS ret_combo FROM (
    SELECT p.date, p.w_g, a.r AS ret_s, b.r AS ret_g FROM path p LEFT JOIN wr a ON a.entity = 'A' AND a.f0 = p.date LEFT JOIN wr b ON b.entity = 'N' AND b.f0 = p.date
    WHERE p.entity = 'A'))""", "date", "ret_combo nav_combo", 7), ENV, PATH, recursive=True))
def combined(spark, root):
    weekly = asset_week_returns(fx.indices(spark, root), fx.weeks(spark, root), "c2c")
    leg = lambda e, n: weekly.where(F.col("entity") == e).select(F.col("sample_date").alias("date"), F.col("ret").alias(n))
    path = O.weight_path(environment_frame(spark, root)).where("entity = 'A'").select("date", "w_g")
    out = O.combined(path.join(leg("A", "ret_s"), "date", "left").join(leg("N", "ret_g"), "date", "left"))
    return report(out.select("date", "ret_combo", "nav_combo"), 7)


@query("o9_market_proxy", S.with_base(final("SELECT entity, date, close FROM ibars WHERE entity = 'R'", "entity, date", "close")))
def proxy(spark, root):
    return report(market_proxy(fx.indices(spark, root), ("R",) + MARKET_PROXY_PATTERNS).select("entity", "date", "close"))


# ---------------------------------------------------------------- streams


def _scratch(spark, name):
    """A new folder under the shared one for a stream's files."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("s1_streamed_upsert", S.with_base(final(
    "SELECT entity, date, open, high, low, CASE WHEN date >= DATE '2000-01-01' AND date < DATE '2000-03-01' THEN close * 2 ELSE close END AS close, "
    "volume, total_turnover, num_trades FROM bars", "entity, date", "open high low close volume total_turnover num_trades", 7)))
def streamed_upsert(spark, root):
    home = _scratch(spark, "s1")
    bars = fx.bars(spark, root)
    revised = bars.where("date >= DATE '2000-01-01' AND date < DATE '2000-03-01'").withColumn("close", F.col("close") * 2)
    for step in (bars, revised):
        step.write.mode("append").parquet(f"{home}/in")
        live.upsert_stream(live.stream_table(spark, f"{home}/in", 1000), f"{home}/panel", f"{home}/log").awaitTermination()
    return report(live.read_panel(spark, f"{home}/panel").select(bars.columns), 7)


EVENT_BARS = """
eb AS (SELECT CAST(user_id AS VARCHAR) AS entity, CAST(ts AS DATE) AS date, arg_min(value, {'a': ts, 'b': event_id}) AS open, max(value) AS high,
  min(value) AS low, arg_max(value, {'a': ts, 'b': event_id}) AS close, count(*) AS num_trades FROM events GROUP BY 1, 2)"""


@query("s2_event_bars", f"WITH {EVENT_BARS} " + final("eb", "entity, date, num_trades", "open high low close"))
def event_bars(spark, root):
    return report(live.event_bars(table(spark, root, "events")))


@query("s2b_event_bars_streamed", f"WITH {EVENT_BARS} " + final(
    "SELECT * FROM eb WHERE date + 1 <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY", "entity, date, num_trades", "open high low close"))
def event_bars_streamed(spark, root):
    home = _scratch(spark, "s2")
    events = table(spark, root, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    events.write.parquet(f"{home}/in")
    live.append_to(live.event_bars(live.stream_table(spark, f"{home}/in", 1000)), f"{home}/bars", f"{home}/log").awaitTermination()
    return report(spark.read.parquet(f"{home}/bars"))


LIVE = Stops(take_profit=0.1, stop_loss=0.05)
STOP_EVENTS = S.with_base(final("""
SELECT param_id, entity, date, 'RET' AS kind, path, weight, ret, contribution, CAST(NULL AS DOUBLE) AS entry_price, CAST(NULL AS DOUBLE) AS exec_price FROM st_rets
UNION ALL SELECT param_id, entity, date, action, CASE action WHEN 'BUY' THEN 'add' WHEN 'SELL' THEN 'reduce' ELSE 'stop' END, NULL, NULL, NULL, entry_price, exec_price FROM st_trades""",
    "param_id, entity, date, kind, path", "weight ret contribution entry_price exec_price", 7), *S.BOOK, stop_relations([("live", LIVE)], Costs()), recursive=True)


@query("s3_live_stops", STOP_EVENTS)
def live_stops(spark, root):
    """The book's days in four deliveries, the last days of each partly delayed to the next; then a row that ends the stream."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.STATE_STORE)
    home = _scratch(spark, "s3")
    rows = X.stop_days(fx.positions(spark, root), fx.bars(spark, root))
    span = rows.agg(F.min("day").alias("a"), (F.max("day") + 1).alias("b"))
    share = (F.col("day") - F.col("a")) * 4 / (F.col("b") - F.col("a"))
    delayed = (F.pmod(F.hash("entity", "day"), F.lit(3)) == 0) & (F.floor((F.col("day") + 20 - F.col("a")) * 4 / (F.col("b") - F.col("a"))) > F.floor(share))
    placed = rows.join(F.broadcast(span), F.lit(True)).withColumn("delivery", F.floor(share) + F.when(delayed, 1).otherwise(0)).drop("a", "b")
    end = rows.agg(F.max("day").alias("day"), F.max("ord").alias("ord")).select(
        F.lit("~end").alias("entity"), F.date_add(F.to_date(F.lit("1970-01-01")), (F.col("day") + 100).cast("int")).alias("date"),
        (F.col("day") + 100).alias("day"), (F.col("ord") + 100).alias("ord"), F.lit(-1).alias("signal"), F.lit(0.0).alias("weight"),
        *[F.lit(float("nan")).alias(c) for c in ("open", "high", "low", "close", "prev_close")])
    parts = [placed.where(F.col("delivery") == i).drop("delivery") for i in range(5)]
    for part in [*parts[:4], parts[4].unionByName(end)]:
        part.write.mode("append").parquet(f"{home}/in")
        events = live.live_stops(live.stream_table(spark, f"{home}/in", 1000), LIVE)
        live.append_to(events, f"{home}/events", f"{home}/log").awaitTermination()
    return report(spark.read.parquet(f"{home}/events"), 7)
