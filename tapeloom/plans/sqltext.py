"""SQL over the given tables that states, independently of the Spark code, what queries return."""

from __future__ import annotations

from tapeloom.fixed_values import FACTOR_COLUMNS, POSITION_SPANS, SPANS

O = "PARTITION BY entity ORDER BY date"


def last(fn: str, n: int) -> str:
    return f"{fn} OVER ({O} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def lag(c: str, n: int = 1) -> str:
    return f"lag({c}, {n}) OVER ({O})"


def ok(e: str) -> str:
    return f"CASE WHEN isfinite({e}) THEN {e} END"


def corr(a: str, b: str, n: int = 20) -> str:
    return ok(f"corr({a}, {b}) OVER ({O} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)")


def moment(fn: str, c: str, least: int, n: int = 20) -> str:
    """DuckDB's skewness and kurtosis are bias-corrected already."""
    frame = f"OVER ({O} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return (f"CASE WHEN count({c}) {frame} >= {least} AND stddev_samp({c}) {frame} > 1e-12 "
            f"THEN {fn}({c}) {frame} END")


BASE = """
trades AS (
  SELECT CAST(l_shipdate AS DATE) AS date, l_partkey, l_suppkey, l_returnflag,
         CAST(100 AS DOUBLE) + l_extendedprice / 1000 AS price, l_quantity AS quantity,
         {'a': l_orderkey, 'b': l_linenumber, 'c': CAST(100 AS DOUBLE) + l_extendedprice / 1000} AS seq
  FROM lineitem WHERE isodow(l_shipdate) < 6),
bars AS (
  SELECT p_brand AS entity, date, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, seq) AS close, sum(quantity) AS volume,
         round(sum(price * quantity), 5) AS total_turnover, CAST(count(*) AS DOUBLE) AS num_trades
  FROM trades JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
sbars AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS entity, date, arg_min(price, seq) AS open, max(price) AS high,
         min(price) AS low, arg_max(price, seq) AS close, sum(quantity) AS volume,
         round(sum(price * quantity), 5) AS total_turnover, CAST(count(*) AS DOUBLE) AS num_trades
  FROM trades GROUP BY 1, 2),
groups AS (
  SELECT DISTINCT p_brand AS entity, 'S' || (CAST(split_part(p_brand, '#', 2) AS INT) % 5) AS sector FROM part),
sgroups AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS entity, r_name AS sector, n_name AS industry
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
ibars AS (
  SELECT *, lag(close) OVER (PARTITION BY entity ORDER BY date) AS prev_close FROM (
    SELECT l_returnflag AS entity, date, arg_min(price, seq) AS open,
           round(sum(price * price * quantity) / sum(price * quantity), 6) AS close,
           round(sum(price * quantity), 5) AS total_turnover
    FROM trades GROUP BY 1, 2)),
cal AS (
  SELECT date, row_number() OVER (ORDER BY date) - 1 AS ord, lag(date) OVER (ORDER BY date) AS prev_date,
         lead(date) OVER (ORDER BY date) AS next_date
  FROM (SELECT DISTINCT date FROM trades)),
weeks AS (
  SELECT date, row_number() OVER (ORDER BY date) - 1 AS week_ord, lead(date) OVER (ORDER BY date) AS next_week_end
  FROM (SELECT max(date) AS date FROM cal GROUP BY date_trunc('week', date)))"""


def with_base(body: str, *more: str, recursive: bool = False) -> str:
    """``body`` with the base relations, and any further relations, in scope."""
    head = "WITH RECURSIVE" if recursive else "WITH"
    return f"{head} {', '.join([BASE, *more])}\n{body}"


def _factor_relations() -> list[str]:
    f1 = (f"f1 AS (SELECT *, {lag('close')} AS pc, {lag('volume')} AS pv FROM bars)")
    moms = ", ".join(f"{ok(f'close / {lag('close', n)} - 1')} AS mom{n}" for n in SPANS)
    f2 = (f"f2 AS (SELECT *, {ok(f'close / {lag('close')} - 1')} AS ret, {ok(f'volume / {lag('volume')} - 1')} AS vret, "
          f"{ok(f'total_turnover / {lag('total_turnover')} - 1')} AS tret, {moms}, "
          "greatest(high - low, coalesce(abs(high - pc), high - low), coalesce(abs(low - pc), high - low)) AS tr FROM f1)")
    per = []
    for n in SPANS:
        per += [f"{last('avg(close)', n)} AS ma{n}", f"{last('stddev_samp(ret)', n)} AS ret_std{n}",
                f"{last('avg(ret)', n)} AS ret_mean{n}", f"{last('avg(total_turnover)', n)} AS tm{n}",
                f"{last('stddev_samp(total_turnover)', n)} AS ts{n}",
                f"{last(f'avg(mom{n})', 60)} AS mm{n}", f"{last(f'stddev_samp(mom{n})', 60)} AS ms{n}"]
    for n in POSITION_SPANS:
        per += [f"{last('max(close)', n)} AS hi{n}", f"{last('min(close)', n)} AS lo{n}"]
    f3 = (f"f3 AS (SELECT *, {lag('ret')} AS ret1, {last('avg(nullif(volume, 0))', 20)} AS ma20v, "
          f"{last('stddev_samp(volume)', 20)} AS std20v, {last('avg(volume)', 20)} AS mean20v, "
          f"{last('stddev_samp(close)', 20)} AS sdc20, {last('avg(tr)', 14)} AS atr14, "
          f"{moment('skewness', 'ret', 3)} AS skew, {moment('kurtosis', 'ret', 4)} AS kurtosis, {', '.join(per)} FROM f2)")
    f4 = (f"f4 AS (SELECT *, abs(volume - pv) / (std20v + 1e-12) AS liq, {corr('ret', 'ret1')} AS rev, "
          f"{corr('ret', 'tret')} AS price_turnover_corr20, {corr('vret', 'ret')} AS volume_price_corr20, "
          f"{corr('vret', 'ret1')} AS vol_ret_corr20_lag1 FROM f3)")
    slopes = ", ".join(f"ma{n} / {lag(f'ma{n}')} - 1 AS ma{n}_slope" for n in SPANS)
    f5 = f"f5 AS (SELECT *, 0.5 * liq + 0.3 * {lag('liq')} + 0.2 * {lag('liq', 2)} AS lip, {slopes} FROM f4)"
    out = ["ret", "abs(ret) AS ret_abs", "(hi20 - lo20) / (ma20v + 1e-12) AS sse", "liq", "skew",
           "(open - pc) / (pc + 1e-12) AS gap", "ret_std10 / (ret_std30 + 1e-12) AS vts",
           "volume / (nullif(ma20v, 0) + 1e-12) AS vcll", "ret / (ret_std20 + 1e-12) AS rvr",
           "(close - ma60) / (ma60 + 1e-12) AS csl", "rev", "ret_std5 / (ret_std20 + 1e-12) AS vcbl", "kurtosis", "lip",
           "volume / (nullif(num_trades, 0) + 1e-12) AS vol_per_trade"]
    for n in SPANS:
        out += [f"ma{n}", f"close / (ma{n} + 1e-12) AS price_ma{n}_ratio", f"ma{n}_slope"]
    for a, b in ((5, 10), (10, 20), (20, 60)):
        out.append(f"(ma{a} - ma{b}) / (ma{b} + 1e-12) AS ma{a}_{b}_cross")
    out += ["ma20 AS boll_ma20", "((ma20 + 2 * sdc20) - (ma20 - 2 * sdc20)) / (ma20 + 1e-12) AS boll_width",
            "(close - (ma20 - 2 * sdc20)) / ((ma20 + 2 * sdc20) - (ma20 - 2 * sdc20) + 1e-12) AS boll_pctb", "atr14",
            "(high - low) / (abs(pc) + 1e-12) AS hl_range", "abs(close - open) AS candle_body",
            "greatest(high - greatest(open, close), 0) AS candle_upper",
            "greatest(least(open, close) - low, 0) AS candle_lower",
            "abs(close - open) / (high - low + 1e-12) AS body_ratio",
            "greatest(high - greatest(open, close), 0) / (high - low + 1e-12) AS upper_ratio",
            "greatest(least(open, close) - low, 0) / (high - low + 1e-12) AS lower_ratio",
            "total_turnover AS turnover", "total_turnover / (tm20 + 1e-12) AS turnover_ma20_ratio",
            "ts20 / (abs(total_turnover) + 1e-12) AS turnover_std20_ratio",
            "price_turnover_corr20", "volume_price_corr20", "std20v / (mean20v + 1e-12) AS vol_std20_over_mean20",
            "std20v / (mean20v + 1e-12) AS vol_cv_20"]
    for n in SPANS:
        out += [f"mom{n}", f"(mom{n} - mm{n}) / (ms{n} + 1e-12) AS mom{n}_z", f"ret_std{n}", f"ret_mean{n}",
                f"tm{n} / (total_turnover + 1e-12) AS turnover_mean_ratio_{n}",
                f"ts{n} / (abs(total_turnover) + 1e-12) AS turnover_std_ratio_{n}"]
    for n in POSITION_SPANS:
        out.append(f"(close - lo{n}) / (hi{n} - lo{n} + 1e-12) AS price_pos_{n}")
    out.append("vol_ret_corr20_lag1")
    plain = f"fac AS (SELECT entity, date, close, ma20v, {', '.join(out)} FROM f5)"
    return [f1, f2, f3, f4, f5, plain]


def _smooth_relations() -> list[str]:
    """Exponential means by plain recursion over each entity's rows."""
    spans = {"e5": 5, "e10": 10, "e20": 20, "e30": 30, "e60": 60, "e12": 12, "e26": 26}
    alpha = {k: f"CAST(2 AS DOUBLE) / {n + 1}" for k, n in spans.items()}
    step = {k: f"({a}) * b.close + (1 - {a}) * r.{k}" for k, a in alpha.items()}
    rsi = []
    for k, n, v in (("u14", 14, "greatest(b.mv, 0)"), ("d14", 14, "greatest(-b.mv, 0)"),
                    ("u5", 5, "greatest(b.mv, 0)"), ("d5", 5, "greatest(-b.mv, 0)")):
        rsi.append(f"CASE WHEN r.{k} IS NULL THEN {v} ELSE CAST(2 AS DOUBLE) / {n + 1} * {v} "
                   f"+ (1 - CAST(2 AS DOUBLE) / {n + 1}) * r.{k} END AS {k}")
    ordered = (f"eo AS (SELECT entity, date, close, row_number() OVER ({O}) AS n, "
               f"close - {lag('close')} AS mv FROM bars)")
    start = ", ".join(f"close AS {k}" for k in spans)
    rec = (f"er AS (SELECT entity, date, n, {start}, CAST(0 AS DOUBLE) AS dea, CAST(NULL AS DOUBLE) AS u14, "
           "CAST(NULL AS DOUBLE) AS d14, CAST(NULL AS DOUBLE) AS u5, CAST(NULL AS DOUBLE) AS d5 FROM eo WHERE n = 1 "
           f"UNION ALL SELECT b.entity, b.date, b.n, {', '.join(f'{v} AS {k}' for k, v in step.items())}, "
           f"0.2 * (({step['e12']}) - ({step['e26']})) + 0.8 * r.dea AS dea, {', '.join(rsi)} "
           "FROM er r JOIN eo b ON b.entity = r.entity AND b.n = r.n + 1)")
    smooth = ("smooth AS (SELECT entity, date, e5 AS ema5, e10 AS ema10, e20 AS ema20, e30 AS ema30, e60 AS ema60, "
              "e12 AS ema12, e26 AS ema26, "
              "100 - 100 / (1 + u14 / (d14 + 1e-12)) AS rsi14, 100 - 100 / (1 + u5 / (d5 + 1e-12)) AS rsi5, "
              "e12 - e26 AS macd_dif, dea AS macd_dea, e12 - e26 - dea AS macd_hist FROM er)")
    return [ordered, rec, smooth]


FACTORS = _factor_relations()
SMOOTH = _smooth_relations()
SMOOTHED = {"pvo", "rsi14", "rsi5", "macd_dif", "macd_dea", "macd_hist"} | {f"ema{n}" for n in SPANS}


def factor_sql(body: str, smooth: bool = False) -> str:
    """``body`` over ``fac`` (window factors) and, if asked, ``smooth`` (exponential means)."""
    return with_base(body, *FACTORS, *(SMOOTH if smooth else []), recursive=smooth)


def all_factors_relation() -> str:
    plain = [n for n in FACTOR_COLUMNS if n not in SMOOTHED]
    return ("allfac AS (SELECT fac.entity, fac.date, " + ", ".join(f"fac.{n}" for n in plain)
            + ", (fac.close - ema5) / (fac.ma20v + 1e-12) AS pvo, "
            + ", ".join(f"smooth.{n}" for n in sorted(SMOOTHED - {"pvo"}))
            + " FROM fac JOIN smooth ON smooth.entity = fac.entity AND smooth.date = fac.date)")


LABELS = """
wk AS (SELECT w.date AS f0, w.next_week_end AS f1,
         (SELECT max(c.date) FROM cal c WHERE c.date <= w.date) AS d0,
         (SELECT max(c.date) FROM cal c WHERE c.date <= w.next_week_end) AS d1
       FROM weeks w WHERE w.next_week_end IS NOT NULL),
wk2 AS (SELECT f0, d1, c.next_date AS ds FROM wk JOIN cal c ON c.date = wk.d0 WHERE c.next_date <= wk.d1),
labels_ AS (SELECT f0 AS sample_date, a.entity, b.close / a.open - 1 AS next_week_return, a.open AS o0, b.close AS c1
       FROM wk2 JOIN bars a ON a.date = wk2.ds JOIN bars b ON b.date = wk2.d1 AND b.entity = a.entity)"""

SCORES = f"""
sc0 AS (SELECT entity, date, close / {lag('close', 20)} - 1 AS score FROM bars),
scores AS (SELECT sc0.* FROM sc0 JOIN weeks ON weeks.date = sc0.date WHERE score IS NOT NULL)"""

CAPS = f"""
caps AS (SELECT entity, date, round(sum(total_turnover) OVER ({O} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 4) AS market_cap
         FROM bars)"""

IDS = """
ids AS (SELECT entity, dense_rank() OVER (ORDER BY sector) - 1 AS id FROM groups)"""

PICKED = """
sel0 AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, entity) AS rn,
           count(*) OVER (PARTITION BY date) AS n FROM scores),
sel1 AS (SELECT *, least(floor(n * CAST(0.4 AS DOUBLE)), 7) AS k FROM sel0),
sel2 AS (SELECT * FROM sel1 WHERE rn <= CASE WHEN k <= 0 AND n >= 3 THEN least(3, n) ELSE k END),
picked AS (SELECT date, entity, score, CAST(1 AS DOUBLE) / m AS weight FROM (
           SELECT *, count(*) OVER (PARTITION BY date) AS m FROM sel2) WHERE m >= 3)"""

POSITIONS = """
sw AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, lead(date) OVER (ORDER BY date) AS nxt,
         date IN (SELECT date FROM picked) AS has FROM (SELECT DISTINCT date FROM scores)),
sw2 AS (SELECT *, last_value(CASE WHEN i % 2 = 0 AND has THEN date END IGNORE NULLS) OVER (ORDER BY date) AS pick_date FROM sw),
plan AS (SELECT *, coalesce(last_value(CASE WHEN i % 2 = 0 AND pick_date IS NOT NULL THEN date END IGNORE NULLS)
         OVER (ORDER BY date), date) AS signal_date FROM sw2),
positions AS (SELECT c.next_date AS date, p.entity, p.weight, p.score, plan.signal_date
       FROM plan JOIN cal c ON c.date >= plan.date AND (plan.nxt IS NULL OR c.date < plan.nxt)
       JOIN picked p ON p.date = plan.pick_date WHERE c.next_date IS NOT NULL)"""

MOVES = """
md AS (SELECT date, row_number() OVER (ORDER BY date) AS ord, lag(date) OVER (ORDER BY date) AS prev_date
       FROM (SELECT DISTINCT date FROM positions) WHERE date IN (SELECT date FROM bars)),
dense AS (SELECT e.entity, md.date, md.prev_date, md.ord, coalesce(p.weight, 0) AS weight,
         coalesce(lag(p.weight) OVER (PARTITION BY e.entity ORDER BY md.date), 0) AS prev_weight
       FROM (SELECT DISTINCT entity FROM positions) e CROSS JOIN md
       LEFT JOIN positions p ON p.entity = e.entity AND p.date = md.date),
moves AS (SELECT d.*, a.open, a.high, a.low, a.close, b.close AS prev_close,
         CASE WHEN prev_weight = 0 THEN 'add' WHEN weight <> 0 THEN 'keep' ELSE 'reduce' END AS path
       FROM dense d LEFT JOIN bars a ON a.entity = d.entity AND a.date = d.date
       LEFT JOIN bars b ON b.entity = d.entity AND b.date = d.prev_date WHERE weight <> 0 OR prev_weight <> 0),
stock_rets AS (SELECT date, entity, path, w AS weight, r AS ret, w * r AS contribution FROM (SELECT *,
         CASE WHEN path = 'reduce' THEN prev_weight ELSE weight END AS w,
         CASE path WHEN 'add' THEN close / (open * CAST(1.0015 AS DOUBLE)) - 1 WHEN 'keep' THEN close / prev_close - 1
              ELSE open * CAST(0.998 AS DOUBLE) / prev_close - 1 END AS r FROM moves)),
daily AS (SELECT date, coalesce(sum(contribution), 0) AS ret_total,
         count(*) FILTER (path IN ('add', 'keep')) AS n_long FROM stock_rets GROUP BY date),
navs AS (SELECT date, ret_total, n_long, product(1 + ret_total) OVER (ORDER BY date) AS nav FROM daily),
runs AS (SELECT *, sum(CASE WHEN path = 'add' THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY ord) AS run FROM moves),
tlog AS (SELECT date, entity, CASE path WHEN 'add' THEN 'BUY' ELSE 'SELL' END AS action,
         first_value(open) OVER (PARTITION BY entity, run ORDER BY ord) AS entry_price,
         CASE path WHEN 'add' THEN open * CAST(1.0015 AS DOUBLE) ELSE open * CAST(0.998 AS DOUBLE) END AS exec_price,
         path FROM runs)"""

BOOK = (SCORES, PICKED, POSITIONS, MOVES)

INDEX_RETURNS = """
ir AS (SELECT entity AS series_id, date, close / prev_close - 1 AS ret FROM ibars WHERE prev_close IS NOT NULL)"""

SECTOR_DAY = """
sday AS (SELECT date, sector, CASE WHEN sum(total_turnover) > 0 THEN sum(close * total_turnover) / sum(total_turnover) ELSE avg(close) END AS close,
         sum(total_turnover) AS total_turnover, sum(volume) AS volume, sum(num_trades) AS num_trades, count(*) AS constituents_count,
         avg(sign(close / open - 1)) AS breadth FROM bars JOIN groups ON groups.entity = bars.entity GROUP BY 1, 2)"""

_SPANS = (5, 10, 20, 60)
_FEATURES = ["ret_1d"] + [f"{m}_{n}" for n in _SPANS for m in ("ret_mean", "ret_std", "to_mean_ratio", "to_std_ratio")]


def _series_features() -> str:
    cells = []
    for n in _SPANS:
        cells += [f"{last('avg(ret_1d)', n)} AS ret_mean_{n}", f"{last('stddev_samp(ret_1d)', n)} AS ret_std_{n}",
                  f"{last('avg(total_turnover)', n)} / (total_turnover + 1e-12) AS to_mean_ratio_{n}",
                  f"{last('stddev_samp(total_turnover)', n)} / (abs(total_turnover) + 1e-12) AS to_std_ratio_{n}"]
    return f"""
series AS (SELECT entity, date, close, total_turnover FROM ibars UNION ALL SELECT sector, date, close, total_turnover FROM sday),
sret AS (SELECT *, close / {lag('close')} - 1 AS ret_1d FROM series),
sfeat AS (SELECT entity, date, ret_1d, {', '.join(cells)} FROM sret)"""


CONTEXT_COLUMNS = [f"{s}_{f}" for s in ("A", "N", "R", "S0", "S1", "S2", "S3", "S4") for f in _FEATURES] + ["bread_style"]


def context_relations() -> list[str]:
    picks = [f"max({f}) FILTER (sf.entity = '{s}') AS {s}_{f}"
             for s in ("A", "N", "R", "S0", "S1", "S2", "S3", "S4") for f in _FEATURES]
    return [SECTOR_DAY, _series_features(), """
sbread AS (SELECT date, CAST(count(*) FILTER (ret_1d > 0) - count(*) FILTER (ret_1d < 0) AS DOUBLE) / 5 AS bread_style
           FROM sret WHERE entity LIKE 'S%' GROUP BY date)""", """
wd AS (SELECT w.date, (SELECT max(i.date) FROM ibars i WHERE i.date <= w.date) AS di,
         (SELECT max(s.date) FROM sday s WHERE s.date <= w.date) AS ds FROM weeks w)""", f"""
ctx AS (SELECT wd.date, {', '.join(picks)}, max(sb.bread_style) AS bread_style FROM wd
        JOIN sfeat sf ON sf.date = CASE WHEN sf.entity LIKE 'S%' THEN wd.ds ELSE wd.di END
        JOIN sbread sb ON sb.date = wd.ds GROUP BY wd.date)"""]


_ALL = ", ".join(FACTOR_COLUMNS)
WINDOWS = f"""
fn AS MATERIALIZED (SELECT entity, date, {", ".join(f"{ok(c)} AS {c}" for c in FACTOR_COLUMNS)}, row_number() OVER ({O}) AS n FROM allfac),
closing AS (SELECT k.date AS sample_date, f.entity, max(f.n) AS r FROM weeks k JOIN fn f ON f.date <= k.date GROUP BY 1, 2 HAVING max(f.n) >= 50),
lastrow AS MATERIALIZED (SELECT sample_date, c.entity, r FROM closing c JOIN fn f ON f.entity = c.entity AND f.n BETWEEN c.r - 49 AND c.r
            GROUP BY 1, 2, 3 HAVING count(coalesce({_ALL})) > 0),
windows AS MATERIALIZED (SELECT l.sample_date, l.entity, CAST(f.n - (l.r - 49) AS INT) AS t_pos, {_ALL}
            FROM lastrow l JOIN fn f ON f.entity = l.entity AND f.n BETWEEN l.r - 49 AND l.r)"""

_MIDDLE = ", ".join(f"quantile_cont({c}, 0.5) AS {c}_m" for c in FACTOR_COLUMNS)
_SPREAD = ", ".join(f"quantile_cont(abs({c} - {c}_m), 0.5) + 1e-6 AS {c}_d" for c in FACTOR_COLUMNS)
_CLAMPED = ", ".join(f"least(greatest({c}, {c}_m - 3 * {c}_d), {c}_m + 3 * {c}_d) AS {c}" for c in FACTOR_COLUMNS)
CLIPPED = f"""
wz AS MATERIALIZED (SELECT sample_date, entity, t_pos, {", ".join(f"coalesce({c}, 0) AS {c}" for c in FACTOR_COLUMNS)} FROM windows),
wm AS MATERIALIZED (SELECT sample_date, t_pos, {_MIDDLE} FROM wz GROUP BY 1, 2),
wd2 AS (SELECT sample_date, t_pos, {_SPREAD} FROM wz JOIN wm USING (sample_date, t_pos) GROUP BY 1, 2),
clipped AS MATERIALIZED (SELECT sample_date, entity, t_pos, {_CLAMPED} FROM wz JOIN wm USING (sample_date, t_pos) JOIN wd2 USING (sample_date, t_pos))"""


def cells(relation: str, where: str = "TRUE") -> str:
    """One row per cell of a relation of windows: ``factor, v``."""
    return f"(SELECT sample_date, entity, t_pos, {_ALL} FROM {relation} WHERE {where}) UNPIVOT INCLUDE NULLS (v FOR factor IN ({_ALL}))"


def digest(relation: str, where: str = "TRUE", first: int = 0) -> str:
    return (f"SELECT sample_date, factor, count(*) AS n_cells, count(v) AS n_values, sum(coalesce(v, 0)) AS total, "
            f"sum(coalesce(v, 0) * (t_pos + {1 - first})) AS weighted, min(v) AS low, max(v) AS high FROM {cells(relation, where)} GROUP BY 1, 2")


def windows_sql(body: str, *more: str) -> str:
    """``body`` over ``windows`` (all factors, 50 rows a sample) and ``lastrow`` (the samples)."""
    return with_base(body, *FACTORS, *SMOOTH, all_factors_relation(), WINDOWS, *more, recursive=True)

FLAGGED = """
cand AS (SELECT DISTINCT w.date, b.entity FROM bars b JOIN weeks w ON date_trunc('week', w.date) = date_trunc('week', b.date)),
mast AS (SELECT entity, min(date) AS ipo_date, CASE WHEN (SELECT max(date) FROM bars) - max(date) >= 60 THEN max(date) END AS delist_date
         FROM bars GROUP BY 1),
flagged AS (SELECT c.date, c.entity, FALSE AS fails_board, b.entity IS NULL AS fails_suspended,
    CAST(split_part(c.entity, '#', 2) AS INT) % 9 = 0 AS fails_st, NOT coalesce(b.total_turnover >= 3000, FALSE) AS fails_turnover,
    m.ipo_date IS NULL AS fails_missing_info, coalesce(c.date - m.ipo_date < 120, FALSE) AS fails_ipo,
    coalesce(c.date >= m.delist_date, FALSE) AS fails_delisted,
    coalesce((b.close / b.open - 1 >= 0.098 AND b.close >= b.high * 0.999) OR (abs(b.open - b.high) <= 0.001 * b.high AND abs(b.close - b.high) <= 0.001 * b.high)
      OR (b.close / b.open - 1 <= -0.098 AND b.close <= b.low * 1.001) OR (abs(b.open - b.low) <= 0.001 * b.low AND abs(b.close - b.low) <= 0.001 * b.low), FALSE) AS fails_limit
  FROM cand c LEFT JOIN bars b ON b.date = c.date AND b.entity = c.entity LEFT JOIN mast m ON m.entity = c.entity),
caused AS (SELECT *, CASE WHEN fails_board THEN 'board' WHEN fails_suspended THEN 'suspended' WHEN fails_st THEN 'st'
    WHEN fails_turnover THEN 'turnover' WHEN fails_missing_info THEN 'missing_info' WHEN fails_ipo THEN 'ipo'
    WHEN fails_delisted THEN 'delisted' WHEN fails_limit THEN 'limit' END AS cause FROM flagged)"""
