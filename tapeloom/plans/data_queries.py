"""Queries over ingest (a), cleaning (c), aggregates (f), universe (h), samples (d18, i) and quality (p)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.config import UniverseRules, WalkForward
from tapeloom.fixed_values import FACTOR_COLUMNS
from tapeloom.functions import rolling as R
from tapeloom.functions.scalars import board, clean_and_clip, parse_date_flexible
from tapeloom.operators import aggregates as A
from tapeloom.operators import calendar as C
from tapeloom.operators import cleaning as N
from tapeloom.operators import quality as P
from tapeloom.operators import samples as I
from tapeloom.operators import store as ST
from tapeloom.operators import universe as H
from tapeloom.plans import fixtures as fx
from tapeloom.plans import sqltext as S
from tapeloom.plans.registry import final, query, report
from tapeloom.sources import bars as B
from tapeloom.sources import readers as RD
from tapeloom.sources import upsert as U

VALUES = "open high low close volume total_turnover num_trades"
PANEL_VALUES = RD.PANEL_VALUES

# ---------------------------------------------------------------- sources and ingest


@query("a1_read_parquet", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def read_parquet(spark, root):
    absent = RD.read_parquet(spark, f"{root}/no_such_table.parquet")
    found = RD.read_parquet(spark, f"{root}/nation.parquet")
    return found.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n")) if absent is None else absent


@query("a2_read_encoded_csv", "SELECT n_name || '行业' AS name, CAST(n_nationkey AS VARCHAR) AS id FROM nation")
def read_encoded(spark, root):
    path = fx.scratch(spark, root, "gbk_names")
    names = B.table(spark, root, "nation").select(
        F.concat("n_name", F.lit("行业")).alias("name"), F.col("n_nationkey").cast("string").alias("id"))
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    names.write.mode("overwrite").option("header", True).option("encoding", "gbk").csv(path)
    return RD.read_csv(spark, path, "name string, id string", "gbk")


@query("a3_parse_dates", """
WITH raw AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d')
  WHEN 2 THEN strftime(o_orderdate, '%Y%m%d') WHEN 3 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 4 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE 'n/a' END AS s FROM orders)
SELECT o_orderkey, CAST(coalesce(try_strptime(s, '%Y-%m-%d'), try_strptime(s, '%Y/%m/%d'), try_strptime(s, '%Y%m%d'),
  try_strptime(s, '%d/%m/%Y'), try_strptime(s, '%m/%d/%Y')) AS DATE) AS parsed FROM raw""")
def parse_dates(spark, root):
    orders = B.table(spark, root, "orders")
    forms = ["yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "dd/MM/yyyy", "MM/dd/yyyy"]
    spelled = F.lit("n/a")
    for i, form in enumerate(forms):
        spelled = F.when(F.col("o_orderkey") % 6 == i, F.date_format("o_orderdate", form)).otherwise(spelled)
    return orders.select("o_orderkey", parse_date_flexible(spelled).alias("parsed"))


@query("a4_write_partitioned", S.with_base(final("bars", "entity, date", PANEL_VALUES)))
def write_partitioned(spark, root):
    path = fx.scratch(spark, root, "by_year")
    RD.write(fx.bars(spark, root).select("entity", "date", *PANEL_VALUES, F.year("date").alias("year")), path, by=["year"])
    return report(RD.read_parquet(spark, path).select("entity", "date", *PANEL_VALUES))


@query("a5_upsert_bars", S.with_base(final("""
SELECT entity, date, CASE WHEN date >= DATE '2000-01-01' THEN close * 2 ELSE close END AS close,
  CASE WHEN date < DATE '2000-01-01' THEN volume END AS volume FROM bars""", "entity, date", "close volume")))
def upsert_bars(spark, root):
    bars = fx.bars(spark, root)
    old = bars.where("date < DATE '2001-01-01'").select("entity", "date", "close", "volume")
    revised = bars.where("date >= DATE '2000-01-01'").select("entity", "date", (F.col("close") * 2).alias("close"))
    return report(U.upsert(old, revised).select("entity", "date", "close", "volume"))


@query("a6_upsert_flags", S.with_base("""
SELECT date, entity, CASE WHEN CAST(ord AS BIGINT) % 3 = 0 THEN 2 ELSE 1 END AS flag FROM bars JOIN cal USING (date)"""))
def upsert_flags(spark, root):
    keys = fx.bars(spark, root).join(C.days(fx.calendar(spark, root)).select("date", "ord"), "date")
    old = keys.select("date", "entity", F.lit(1).alias("flag"))
    new = keys.select("date", "entity", F.when(F.col("ord") % 3 == 0, 2).alias("flag"))
    return U.upsert_flags(old, new)


@query("a7_high_water_mark", S.with_base("""
SELECT entity, date FROM bars WHERE date >= (SELECT max(date) FROM bars WHERE date < DATE '2001-06-01')"""))
def high_water_mark(spark, root):
    bars = fx.bars(spark, root).select("entity", "date")
    return U.since_mark(bars, bars.where("date < DATE '2001-06-01'"))


@query("a8_upsert_calendar", S.with_base("SELECT date FROM cal"))
def upsert_calendar(spark, root):
    cal = fx.calendar(spark, root)
    return U.upsert_days(cal.where("date < DATE '2000-01-01'"), cal.where("date >= DATE '1999-01-01'"))


@query("a9_snapshot_master", "SELECT s_suppkey AS code, s_name AS name, s_nationkey AS market FROM supplier")
def snapshot_master(spark, root):
    return U.snapshot_master(B.table(spark, root, "supplier"), {"s_suppkey": "code", "s_name": "name", "s_nationkey": "market"})


@query("a9b_read_master", S.with_base("""
SELECT entity, min(date) AS ipo_date, CASE WHEN (SELECT max(date) FROM sbars) - max(date) >= 60 THEN max(date) END AS delist_date
FROM sbars GROUP BY 1"""))
def read_master(spark, root):
    raw = B.master(fx.thin_bars(spark, root)).select(
        F.col("entity").alias(" Code "), F.date_format("ipo_date", "yyyyMMdd").alias("IPO_Date"),
        F.coalesce(F.date_format("delist_date", "yyyyMMdd"), F.lit("22000101")).alias("delist_date"))
    return RD.read_master(raw)


@query("a10_classification_map", S.with_base("SELECT entity, industry FROM sgroups"))
def classification(spark, root):
    table = B.supplier_groups(spark, root).select(F.col("entity").alias("order_book_id"), F.col("industry").alias("first_industry_name"))
    return RD.classification_map(table, "first_industry_name", "industry")


@query("a11_dimension_ids", S.with_base("""
SELECT entity, industry AS name, dense_rank() OVER (ORDER BY industry) - 1 AS id FROM sgroups"""))
def dimension_ids(spark, root):
    return U.dimension_ids(B.supplier_groups(spark, root).select("entity", F.col("industry").alias("name")))


@query("a12_unpivot_flags", S.with_base("""
SELECT date, 'Brand#' || b AS entity, CASE WHEN ord % b = 0 THEN 1 ELSE 0 END AS flag FROM cal, (SELECT unnest([2, 3, 5]) AS b)"""))
def unpivot_flags(spark, root):
    days = C.days(fx.calendar(spark, root))
    spelled = {2: ("TRUE", "FALSE"), 3: ("1", "0"), 5: ("True", None)}
    wide = days.select("date", *[
        F.when(F.col("ord") % b == 0, F.lit(yes)).otherwise(F.lit(no)).alias(f"Brand#{b}") for b, (yes, no) in spelled.items()])
    return RD.read_flags(wide)


@query("a13_normalise_panel", S.with_base(final("bars", "entity, date", VALUES)))
def normalise_panel(spark, root):
    raw = fx.bars(spark, root).withColumn("datetime", F.col("date").cast("timestamp")).drop("date")
    return report(RD.normalise_panel(raw.withColumnRenamed("entity", "order_book_id")))


@query("a14_upsert_index_bars", S.with_base(final("SELECT entity, date, close, prev_close FROM ibars", "entity, date", "close prev_close")))
def upsert_indices(spark, root):
    series = fx.indices(spark, root).select("entity", "date", "close", "prev_close")
    stale = series.where("date < DATE '2000-06-01'").withColumn("close", F.col("close") + F.when(F.col("date") >= "2000-01-01", 1.0).otherwise(0.0))
    return report(U.upsert(stale, series.where("date >= DATE '2000-01-01'")))


@query("a15_index_nav", S.with_base(final(f"""
SELECT entity, date, (close - prev_close) / prev_close AS ret_total, product(1 + (close - prev_close) / prev_close) OVER ({S.O}) AS nav
FROM ibars WHERE prev_close IS NOT NULL""", "entity, date", "ret_total nav", 6)))
def index_nav(spark, root):
    ret = (F.col("close") - F.col("prev_close")) / F.col("prev_close")
    moves = fx.indices(spark, root).where("prev_close IS NOT NULL").withColumn("ret_total", ret)
    return report(moves.select("entity", "date", "ret_total", R.running_product(1 + F.col("ret_total")).alias("nav")), 6)


@query("a16_store_catalogue", S.windows_sql(
    f"SELECT sample_date, count(*) AS n_entities, CAST({len(FACTOR_COLUMNS)} AS BIGINT) AS n_factors FROM lastrow GROUP BY 1"))
def store_catalogue(spark, root):
    return P.catalogue(fx.feature_store(spark, root))


@query("a17_read_calendar", S.with_base("SELECT date FROM cal"))
def read_calendar(spark, root):
    raw = fx.calendar(spark, root).select(F.date_format("date", "yyyy/MM/dd").alias("trading_day"))
    return RD.read_calendar(raw.union(raw))


@query("a18_read_positions", S.with_base(final("""
SELECT date, entity, weight FROM positions WHERE date BETWEEN DATE '1999-01-01' AND DATE '2000-12-31'""", "date, entity", "weight"),
    S.SCORES, S.PICKED, S.POSITIONS))
def read_positions(spark, root):
    raw = fx.positions(spark, root).select("date", "entity", F.col("weight").cast("string").alias("weight"))
    bad = raw.withColumn("weight", F.lit("n/a"))
    return report(RD.read_positions(raw.unionByName(bad), "1999-01-01", "2000-12-31"))


# ---------------------------------------------------------------- cleaning

DIGEST = "total weighted low high"


@query("d18_tail_windows", S.windows_sql(final(S.digest("windows"), "sample_date, factor, n_cells, n_values", DIGEST, 8)))
def tail_windows(spark, root):
    return report(ST.store_digest(fx.factor_windows(spark, root), FACTOR_COLUMNS), 8)


@query("c1_mad_clip", S.windows_sql(final(S.digest("clipped"), "sample_date, factor, n_cells, n_values", DIGEST, 8), S.CLIPPED))
def mad_clip(spark, root):
    return report(ST.store_digest(ST.clip_packed(fx.factor_windows(spark, root), FACTOR_COLUMNS), FACTOR_COLUMNS), 8)


@query("c2_winsorize", S.with_base(final("""
SELECT s.date, s.entity, least(greatest(score, lo), hi) AS score FROM scores s
JOIN (SELECT date, quantile_cont(score, 0.1) AS lo, quantile_cont(score, 0.9) AS hi FROM scores GROUP BY 1) q ON q.date = s.date""",
    "date, entity", "score"), S.SCORES))
def winsorize(spark, root):
    return report(N.winsorize(fx.scores(spark, root), "score", 0.1, ["date"]))


@query("c3_clean_and_clip", S.with_base(final("""
SELECT entity, date, CASE WHEN x IS NOT NULL AND isfinite(x) THEN least(greatest(x, -1000), 1000) ELSE 0 END AS x
FROM (SELECT entity, date, total_turnover / nullif(close - open, 0) AS x FROM bars)""",
    "entity, date", "x")))
def clean(spark, root):
    ratio = F.try_divide(F.col("total_turnover"), F.col("close") - F.col("open"))
    return report(fx.bars(spark, root).select("entity", "date", clean_and_clip(ratio, 1000.0).alias("x")))


@query("c4_global_zscore", S.with_base(final("""
SELECT entity, date, (close - m) / s AS close, (volume - vm) / vs AS volume FROM bars,
(SELECT avg(close) AS m, stddev_pop(close) + 1e-6 AS s, avg(volume) AS vm, stddev_pop(volume) + 1e-6 AS vs FROM bars)""", "entity, date", "close volume", 7)))
def global_zscore(spark, root):
    bars = fx.bars(spark, root).select("entity", "date", "close", "volume")
    return report(N.apply_scaler(bars, N.fit_scaler(bars, ["close", "volume"]), ["close", "volume"]), 7)


def _train_rows(spark, root):
    plan = C.schedule(fx.weeks(spark, root), WalkForward(104, 26, 26)).select("window_id", "date", "role")
    return fx.scores(spark, root).join(plan, "date")


SCALED = """
sched AS (SELECT CAST((i0 - 104) / 26 AS BIGINT) AS window_id, date, CASE WHEN week_ord < i0 THEN 'train' WHEN week_ord < i0 + 26 THEN 'val' ELSE 'predict' END AS role
  FROM (SELECT unnest(range(104, (SELECT count(*) FROM weeks) - 26, 26)) AS i0) JOIN weeks ON week_ord >= i0 - 104 AND week_ord < i0 + 52),
fitted AS (SELECT window_id, avg(score) AS score_mean, stddev_pop(score) + 1e-6 AS score_std FROM scores JOIN sched USING (date) WHERE role = 'train' GROUP BY 1)"""


@query("c5_fit_scaler_per_window", S.with_base(final("fitted", "window_id", "score_mean score_std"), S.SCORES, SCALED))
def fit_per_window(spark, root):
    return report(N.fit_scaler(_train_rows(spark, root).where("role = 'train'"), ["score"], ["window_id"]))


@query("c6_apply_scaler_per_window", S.with_base(final("""
SELECT window_id, date, entity, (score - score_mean) / score_std AS score FROM scores JOIN sched USING (date) JOIN fitted USING (window_id)
WHERE role = 'predict'""", "window_id, date, entity", "score", 7), S.SCORES, SCALED))
def apply_per_window(spark, root):
    rows = _train_rows(spark, root)
    scaler = N.fit_scaler(rows.where("role = 'train'"), ["score"], ["window_id"])
    target = rows.where("role = 'predict'").select("window_id", "date", "entity", "score")
    return report(N.apply_scaler(target, scaler, ["score"], ["window_id"]), 7)


@query("c7_sequence_scaler", S.windows_sql(final(
    f"SELECT factor, avg(v) AS mean, stddev_pop(v) + 1e-6 AS std FROM {S.cells('clipped')} GROUP BY 1", "factor", "mean std", 6), S.CLIPPED))
def sequence_scaler(spark, root):
    return report(ST.packed_scaler(fx.feature_store(spark, root), FACTOR_COLUMNS), 6)


@query("c8_scale_without_centring", S.with_base(final("""
SELECT entity, date, close / s AS close FROM bars, (SELECT stddev_pop(close) AS s FROM bars)""", "entity, date", "close", 7)))
def scale_only(spark, root):
    return report(N.scale_only(fx.bars(spark, root).select("entity", "date", "close"), ["close"]), 7)


# ---------------------------------------------------------------- aggregates


@query("f1_sector_bars", S.with_base(final("sday", "date, sector, constituents_count", "close total_turnover volume num_trades", 7), S.SECTOR_DAY))
def sector_bars(spark, root):
    return report(fx.sector_day(spark, root).drop("breadth"), 7)


@query("f2_sector_breadth", S.with_base(final("sday", "date, sector", "breadth"), S.SECTOR_DAY))
def sector_breadth(spark, root):
    return report(fx.sector_day(spark, root).select("date", "sector", "breadth"))


@query("f3_context_features", S.with_base(final("ctx", "date", S.CONTEXT_COLUMNS, 6), *S.context_relations()))
def context(spark, root):
    return report(fx.context(spark, root), 6)


@query("f4_style_breadth", S.with_base(final("sbread", "date", "bread_style"), *S.context_relations()))
def style_breadth(spark, root):
    return report(A.style_breadth(fx.sector_series(spark, root), 5))


CROSS_SECTION = """
csf AS (SELECT date, count(*) AS cs_n, count(*) FILTER (r > 0) AS cs_n_up, count(*) FILTER (NOT r > 0) AS cs_n_dn,
  CAST(count(*) FILTER (r > 0) AS DOUBLE) / count(*) AS cs_ratio_up,
  CASE WHEN sum(w) > 0 THEN coalesce(sum(w) FILTER (r > 0), 0) / sum(w) ELSE 0 END AS cs_ratio_w_up, avg(r) AS cs_mean_ret, sum(w * r) AS cs_wmean_ret,
  stddev_pop(r) AS cs_std_ret, CAST(count(*) FILTER (r > 0.02) AS DOUBLE) / count(*) AS cs_frac_big_up,
  CAST(count(*) FILTER (r < -0.02) AS DOUBLE) / count(*) AS cs_frac_big_dn, quantile_cont(r, 0.1) AS cs_p10_ret,
  quantile_cont(r, 0.5) AS cs_p50_ret, quantile_cont(r, 0.9) AS cs_p90_ret, quantile_cont(r, 0.5) AS cs_median_ret
  FROM (SELECT date, coalesce(weight, 0) AS w, coalesce(ret, 0) AS r FROM stock_rets) GROUP BY date)"""
CS_COUNTS = "cs_n cs_n_up cs_n_dn"
CS_VALUES = ("cs_ratio_up cs_ratio_w_up cs_mean_ret cs_wmean_ret cs_std_ret cs_frac_big_up cs_frac_big_dn cs_p10_ret cs_p50_ret "
             "cs_p90_ret cs_median_ret")
POSITION_FEATURES = """
pf AS (SELECT date, count(DISTINCT entity) AS pos_n_stock, avg(score) AS pos_mean_score, stddev_pop(score) AS pos_std_score,
  quantile_cont(score, 0.5) AS pos_median_score FROM positions GROUP BY 1)"""
POS_VALUES = "pos_mean_score pos_std_score pos_median_score"


@query("f5_cross_section_features", S.with_base(final("csf", "date, cs_n, cs_n_up, cs_n_dn", CS_VALUES, 8), *S.BOOK, CROSS_SECTION))
def cross_section(spark, root):
    return report(A.cross_section_features(fx.stock_returns(spark, root)), 8)


@query("f6_position_features", S.with_base(
    final("pf", "date, pos_n_stock", POS_VALUES, 8), S.SCORES, S.PICKED, S.POSITIONS, POSITION_FEATURES))
def position_features(spark, root):
    return report(A.position_features(fx.positions(spark, root)), 8)


TRADE_FEATURES = """
tf AS (SELECT date, CAST(count(*) FILTER (action = 'BUY') AS DOUBLE) / greatest(count(*) FILTER (action = 'SELL'), 1) AS trd_buy_sell_ratio,
  CAST(count(*) FILTER (action = 'BUY') - count(*) FILTER (action = 'SELL') AS DOUBLE) / count(*) AS trd_net_dir_norm
  FROM tlog WHERE path <> 'keep' AND (path = 'reduce' OR entry_price IS NOT NULL) GROUP BY 1)"""


@query("f7_trade_features", S.with_base(final("tf", "date", "trd_buy_sell_ratio trd_net_dir_norm"), *S.BOOK, TRADE_FEATURES))
def trade_features(spark, root):
    return report(A.trade_features(fx.trades(spark, root)))


F8_COUNTS = [*CS_COUNTS.split(), "pos_n_stock"]
F8_VALUES = ["ret_total", *CS_VALUES.split(), *POS_VALUES.split(), "trd_buy_sell_ratio", "trd_net_dir_norm"]


@query("f8_daily_features", S.with_base(final(
    "SELECT n.date, n.ret_total, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in F8_COUNTS + F8_VALUES[1:])
    + " FROM navs n LEFT JOIN csf ON csf.date = n.date LEFT JOIN pf ON pf.date = n.date LEFT JOIN tf ON tf.date = n.date",
    "date, " + ", ".join(F8_COUNTS), F8_VALUES, 8), *S.BOOK, CROSS_SECTION, POSITION_FEATURES, TRADE_FEATURES))
def daily_features(spark, root):
    out = A.daily_features(fx.nav(spark, root), fx.stock_returns(spark, root), fx.positions(spark, root), fx.trades(spark, root))
    return report(out, 8)


@query("f9_peer_average", S.with_base(final("""
SELECT b.date, b.entity, g.sector, avg(b.close) OVER (PARTITION BY b.date, g.sector) AS peer_mean FROM bars b JOIN groups g ON g.entity = b.entity""",
    "date, entity, sector", "peer_mean", 7)))
def peer_average(spark, root):
    rows = fx.bars(spark, root).join(fx.sector_map(spark, root), "entity").select("date", "entity", "sector", "close")
    return report(A.peer_average(rows, "close", ("date", "sector")).drop("close"), 7)


@query("f11_update_context", S.with_base(final("ctx", "date", S.CONTEXT_COLUMNS, 6), *S.context_relations()))
def update_context(spark, root):
    old = fx.context(spark, root).where("date < DATE '2000-01-01'")
    return report(A.update_context(
        old, fx.indices(spark, root), fx.sector_series(spark, root), fx.weeks(spark, root), fx.INDICES, fx.SECTORS), 6)


# ---------------------------------------------------------------- universe

CODES = """
codes AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 37 % 700000 AS VARCHAR), 6, '0') ||
  ['.XSHG', '.XSHE', '.XBEI', '.XNE', '.NEEQ', '', '.xshg'][CAST(o_orderkey % 7 AS INT) + 1] AS code FROM orders),
boards AS (SELECT o_orderkey, code, CASE
  WHEN upper(split_part(code, '.', 2)) = 'XSHG' AND left(code, 3) IN ('688', '689') THEN 'STAR'
  WHEN upper(split_part(code, '.', 2)) = 'XSHE' AND left(code, 3) IN ('300', '301') THEN 'CHINEXT'
  WHEN upper(split_part(code, '.', 2)) IN ('XBEI', 'XBSE') THEN 'BSE'
  WHEN upper(split_part(code, '.', 2)) IN ('XNE', 'XNEE', 'XNEQ', 'XNEX', 'NEEQ') THEN 'NEEQ' ELSE 'OTHER' END AS board FROM codes)"""


def _codes(spark, root):
    endings = F.array(*[F.lit(x) for x in (".XSHG", ".XSHE", ".XBEI", ".XNE", ".NEEQ", "", ".xshg")])
    code = F.concat(F.lpad((F.col("o_orderkey") * 37 % 700000).cast("string"), 6, "0"), endings[(F.col("o_orderkey") % 7).cast("int")])
    return B.table(spark, root, "orders").select("o_orderkey", code.alias("code"))


@query("h1_board", S.with_base("SELECT o_orderkey, code, board FROM boards", CODES))
def boards(spark, root):
    return _codes(spark, root).withColumn("board", board("code"))


@query("h2_board_switch", S.with_base("SELECT o_orderkey, code FROM boards WHERE board NOT IN ('STAR', 'CHINEXT', 'BSE', 'NEEQ')", CODES))
def board_switch(spark, root):
    return _codes(spark, root).where(~board("code").isin(*UniverseRules().excluded_boards))


def rule_query(name, *rules):
    columns = [f"fails_{r}" for r in rules]

    @query(name, S.with_base(f"SELECT date, entity, {', '.join(columns)} FROM flagged", S.FLAGGED))
    def run(spark, root):
        return fx.flagged(spark, root).select("date", "entity", *columns)


rule_query("h3_ipo_age", "missing_info", "ipo")
rule_query("h4_delisted", "delisted")
rule_query("h5_suspended_st", "suspended", "st")
rule_query("h6_minimum_turnover", "turnover")
rule_query("h7_near_limit", "limit")


@query("h8_universe", S.with_base("SELECT date, entity FROM caused WHERE cause IS NULL", S.FLAGGED))
def universe(spark, root):
    return H.tradable(fx.flagged(spark, root))


@query("h9_attrition", S.with_base("""
SELECT date, rule, n - coalesce(sum(removed) OVER (PARTITION BY date ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  removed, n - sum(removed) OVER (PARTITION BY date ORDER BY step) AS after
FROM (SELECT d.date, r.step, r.rule, d.n, (SELECT count(*) FROM caused c WHERE c.date = d.date AND c.cause = r.rule) AS removed
  FROM (SELECT date, count(*) AS n FROM caused GROUP BY 1) d,
  (SELECT unnest(range(8)) AS step, unnest(['board', 'suspended', 'st', 'turnover', 'missing_info', 'ipo', 'delisted', 'limit']) AS rule) r)""", S.FLAGGED))
def attrition(spark, root):
    return H.attrition(fx.flagged(spark, root))


@query("h9b_removed_samples", S.with_base("""
SELECT date, cause, array_to_string(list_slice(list_sort(list(entity)), 1, 3), ',') AS names FROM caused WHERE cause IS NOT NULL GROUP BY 1, 2""", S.FLAGGED))
def removed_samples(spark, root):
    return H.samples(fx.flagged(spark, root), 3)


@query("h9c_culprit", S.with_base("""
SELECT date, arg_max(cause, list_position(['board', 'suspended', 'st', 'turnover', 'missing_info', 'ipo', 'delisted', 'limit'], cause)) AS culprit
FROM caused GROUP BY date HAVING count(*) FILTER (cause IS NULL) = 0""", S.FLAGGED))
def culprit(spark, root):
    return H.culprit(H.attrition(fx.flagged(spark, root)))


@query("h10_optional_inputs", S.with_base("SELECT date, entity FROM cand", S.FLAGGED))
def optional_inputs(spark, root):
    return H.tradable(H.rule_columns(fx.candidates(spark, root), None))


# ---------------------------------------------------------------- samples


@query("i1_training_rows", S.with_base(final(
    "SELECT s.date AS sample_date, s.entity, s.score, l.next_week_return, ids.id AS industry_id, "
    + ", ".join(f'coalesce(ctx."{c}", 0) AS "{c}"' for c in S.CONTEXT_COLUMNS) + """
FROM scores s JOIN labels_ l ON l.sample_date = s.date AND l.entity = s.entity JOIN (SELECT date, entity FROM caused WHERE cause IS NULL) u
  ON u.date = s.date AND u.entity = s.entity JOIN ids ON ids.entity = s.entity LEFT JOIN ctx ON ctx.date = s.date""",
    "sample_date, entity, industry_id", ["score", "next_week_return", *S.CONTEXT_COLUMNS], 6), S.SCORES, S.LABELS, S.IDS, S.FLAGGED, *S.context_relations()))
def training_rows(spark, root):
    features = fx.scores(spark, root).withColumnRenamed("date", "sample_date")
    return report(I.training_rows(
        features, fx.labels(spark, root), H.tradable(fx.flagged(spark, root)), fx.industry_ids(spark, root), fx.context(spark, root)), 6)


def _summary_sql():
    v = "least(greatest(v, -1e6), 1e6)"
    at = lambda k: f"max({v}) FILTER (t_pos = {49 - k})"
    one = [f"{at(0)} AS x_last", f"avg({v}) AS x_mean", f"stddev_pop({v}) AS x_std", *(f"{at(0)} - {at(k)} AS x_d{k}" for k in (1, 5, 10)),
           *(f"avg({v}) FILTER (t_pos > {49 - k}) AS x_m{k}" for k in (5, 10, 20))]
    means = ", ".join(f"avg(x_{k}) AS x_{k}" for k in ST.STATISTICS)
    return (f"SELECT sample_date, factor, count(*) AS n_samples, {means} FROM "
            f"(SELECT sample_date, entity, factor, {', '.join(one)} FROM {S.cells('clipped')} GROUP BY 1, 2, 3) GROUP BY 1, 2")


@query("i2_window_summary", S.windows_sql(
    final(_summary_sql(), "sample_date, factor, n_samples", [f"x_{k}" for k in ST.STATISTICS], 8), S.CLIPPED))
def window_summary(spark, root):
    """The nine numbers of every factor, averaged over the samples of a date."""
    own = ST.summarised(fx.feature_store(spark, root), FACTOR_COLUMNS)
    width = len(ST.STATISTICS)
    each = F.array(*[F.struct(F.lit(c).alias("factor"), F.slice("features", i * width + 1, width).alias("x")) for i, c in enumerate(FACTOR_COLUMNS)])
    rows = own.select("sample_date", F.explode(each).alias("e")).select("sample_date", "e.*")
    return report(rows.groupBy("sample_date", "factor").agg(
        F.count(F.lit(1)).alias("n_samples"), *[F.avg(F.col("x")[i]).alias(f"x_{k}") for i, k in enumerate(ST.STATISTICS)]), 8)


@query("i3_truncated_windows", S.windows_sql(
    final(S.digest("clipped", "t_pos >= 40", 40), "sample_date, factor, n_cells, n_values", DIGEST, 8), S.CLIPPED))
def truncated(spark, root):
    return report(ST.store_digest(ST.truncate_packed(fx.feature_store(spark, root), FACTOR_COLUMNS, 10), FACTOR_COLUMNS), 8)


@query("i4_scores_with_names", S.with_base(final("""
SELECT s.date, s.entity, g.sector AS name, s.score FROM scores s JOIN groups g ON g.entity = s.entity
WHERE s.date = (SELECT max(date) FROM weeks WHERE date <= DATE '2000-06-30')""", "date, entity, name", "score"), S.SCORES))
def scored_names(spark, root):
    names = fx.sector_map(spark, root).withColumnRenamed("sector", "name")
    return report(I.scored_with_names(fx.scores(spark, root), names, "2000-06-30"))


# ---------------------------------------------------------------- quality


@query("p1_store_audit", S.windows_sql("""
SELECT sample_date, count(*) AS n_samples, count(*) FILTER (p <> 50) AS n_wrong_length, CAST(sum(r - p) AS BIGINT) AS n_duplicates FROM (
  SELECT sample_date, entity, count(*) AS r, count(DISTINCT t_pos) AS p FROM windows GROUP BY 1, 2) GROUP BY 1"""))
def store_audit(spark, root):
    return P.store_audit(fx.feature_store(spark, root), FACTOR_COLUMNS, 50)


@query("p2_missing_counts", S.windows_sql(
    "SELECT factor AS name, count(*) AS n_rows, count(*) FILTER (v IS NULL) AS n_null, count(*) FILTER (isnan(v)) AS n_nan, "
    f"count(*) FILTER (isinf(v)) AS n_inf FROM {S.cells('windows')} GROUP BY 1"))
def missing_counts(spark, root):
    return P.missing_counts(fx.factor_windows(spark, root), FACTOR_COLUMNS)


@query("p3_date_sets", S.windows_sql("""
SELECT date, bool_or(s = 1) AS in_features, bool_or(s = 2) AS in_labels, bool_or(s = 3) AS in_context,
  CASE WHEN bool_or(s = 1) AND bool_or(s = 2) AND bool_or(s = 3) THEN 'all' WHEN bool_or(s = 1) AND NOT bool_or(s = 2) AND NOT bool_or(s = 3) THEN 'features_only'
    WHEN bool_or(s = 1) AND NOT bool_or(s = 2) THEN 'no_label' WHEN bool_or(s = 1) AND NOT bool_or(s = 3) THEN 'no_context' ELSE 'no_features' END AS "set"
FROM (SELECT sample_date AS date, 1 AS s FROM lastrow UNION ALL SELECT sample_date, 2 FROM labels_ UNION ALL SELECT date, 3 FROM weeks WHERE week_ord % 4 <> 1) GROUP BY 1""", S.LABELS))
def date_sets(spark, root):
    rename = F.col("sample_date").alias("date")
    partial = fx.context(spark, root).join(fx.weeks(spark, root).where("week_ord % 4 <> 1"), "date", "left_semi")
    return P.date_sets(fx.feature_store(spark, root).select(rename), fx.labels(spark, root).select(rename), partial)


@query("p4_effective_samples", S.windows_sql("""
SELECT w.date AS sample_date, count(l.entity) AS n_effective FROM weeks w LEFT JOIN (SELECT a.sample_date, a.entity FROM lastrow a
  JOIN labels_ b ON b.sample_date = a.sample_date AND b.entity = a.entity) l ON l.sample_date = w.date GROUP BY 1""", S.LABELS))
def effective_samples(spark, root):
    return P.effective_samples(fx.feature_store(spark, root), fx.labels(spark, root), fx.weeks(spark, root))


@query("p5_map_coverage", S.with_base(final("""
SELECT count(*) AS n_total, count(*) FILTER (e IN (SELECT entity FROM sgroups WHERE sector <> 'ASIA')) AS n_covered,
  CAST(count(*) FILTER (e IN (SELECT entity FROM sgroups WHERE sector <> 'ASIA')) AS DOUBLE) / count(*) AS covered_ratio
FROM (SELECT DISTINCT entity AS e FROM sbars)""", "n_total, n_covered", "covered_ratio")))
def map_coverage(spark, root):
    return report(P.map_coverage(fx.thin_bars(spark, root), B.supplier_groups(spark, root).where("sector <> 'ASIA'")))


@query("p6_contract_check", S.with_base(final("""
SELECT count(*) AS n_rows, count(*) - count(DISTINCT (entity, date)) AS n_duplicate_rows,
  CAST(count(*) FILTER (prev_close IS NULL) AS DOUBLE) / (2 * count(*)) AS missing_ratio FROM ibars""", "n_rows, n_duplicate_rows", "missing_ratio")))
def contract_check(spark, root):
    return report(P.contract_check(fx.indices(spark, root), ["entity", "date"], ["close", "prev_close"]))
