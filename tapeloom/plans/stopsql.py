"""The stop rules in recursive SQL: one step per entity and day."""

from __future__ import annotations

from tapeloom.config import Costs, Stops


def _seen(*columns: str) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in columns)


def stop_relations(settings: list[tuple[str, Stops]], costs: Costs) -> str:
    """Relations ``st_events`` (one row per setting, entity and day, with its return and trades) and ``st_nav``."""
    rows = ", ".join(
        f"('{name}', {s.take_profit!r}, {s.stop_loss!r}, {s.cooldown_days!r}, {s.trail_start!r}, {s.trail_drawdown!r}, {s.block_reentry_returns}, "
        f"{'fixed_tp_sl' in s.rules}, {'trailing_sl' in s.rules})" for name, s in settings)
    sell, buy = f"CAST({1 - costs.sell!r} AS DOUBLE)", f"CAST({1 + costs.buy!r} AS DOUBLE)"
    return f"""
st_set(param_id, tp, sl, cd, arm, draw, noback, use_fixed, use_trail) AS (SELECT CAST(column0 AS VARCHAR), CAST(column1 AS DOUBLE), CAST(column2 AS DOUBLE),
  CAST(column3 AS DOUBLE), CAST(column4 AS DOUBLE), CAST(column5 AS DOUBLE), column6, column7, column8 FROM (VALUES {rows}) AS v(column0, column1, column2, column3, column4, column5, column6, column7, column8)),
st_days AS (SELECT m.entity, m.date, m.ord, date_diff('day', DATE '1970-01-01', m.date) AS day, s.signal, m.weight, m.open, m.high, m.low, m.close, m.prev_close,
  row_number() OVER (PARTITION BY m.entity ORDER BY m.ord) AS rn
  FROM moves m LEFT JOIN (SELECT date, min(signal_date) AS signal FROM positions GROUP BY date) s ON s.date = m.date),
st_walk AS (
  SELECT p.param_id, e.entity, 0 AS rn, CAST(NULL AS DATE) AS date, CAST(0 AS DOUBLE) AS held, -2 AS last_ord, CAST(NULL AS DOUBLE) AS entry, CAST(NULL AS DOUBLE) AS peak,
    FALSE AS armed, FALSE AS closed, CAST(NULL AS BIGINT) AS stop_day, CAST(NULL AS DATE) AS stop_signal,
    CAST(NULL AS VARCHAR) AS path, CAST(NULL AS DOUBLE) AS w, CAST(NULL AS DOUBLE) AS r, CAST(NULL AS DOUBLE) AS bought,
    CAST(NULL AS VARCHAR) AS action, CAST(NULL AS DOUBLE) AS sold_from, CAST(NULL AS DOUBLE) AS sold_at
  FROM st_set p CROSS JOIN (SELECT DISTINCT entity FROM st_days) e
  UNION ALL
  SELECT param_id, entity, rn, date, target, ord,
    CASE WHEN hit IS NOT NULL OR (target = 0 AND before <> 0 AND NOT closed1) OR (target = 0 AND before = 0) THEN NULL ELSE e3 END,
    CASE WHEN hit = 'TRAIL_SL' OR (hit IS NULL AND target = 0 AND ((before <> 0 AND NOT closed1) OR (before = 0 AND e3 IS NOT NULL))) THEN NULL ELSE p3 END,
    CASE WHEN hit = 'TRAIL_SL' OR (hit IS NULL AND target = 0 AND ((before <> 0 AND NOT closed1) OR (before = 0 AND e3 IS NOT NULL))) THEN FALSE ELSE a3 END,
    closed1 OR hit IS NOT NULL, CASE WHEN hit IS NOT NULL THEN day ELSE stop_day END, CASE WHEN hit IS NOT NULL THEN signal ELSE stop_signal END,
    CASE WHEN hit IS NOT NULL THEN CASE WHEN before > 0 AND prev_close > 0 THEN 'stop' END WHEN target <> 0 AND before = 0 THEN 'add'
         WHEN target <> 0 THEN 'keep' WHEN before <> 0 THEN 'reduce' END,
    CASE WHEN hit IS NOT NULL OR target = 0 THEN before ELSE target END,
    CASE WHEN hit IS NOT NULL THEN CASE WHEN prev_close > 0 THEN fill * {sell} / prev_close - 1 END WHEN target <> 0 AND before = 0 THEN close / nullif(open * {buy}, 0) - 1
         WHEN target <> 0 THEN close / nullif(prev_close, 0) - 1 WHEN before <> 0 THEN open * {sell} / nullif(prev_close, 0) - 1 END,
    CASE WHEN fresh THEN open END,
    CASE WHEN hit IS NOT NULL THEN CASE WHEN before > 0 AND prev_close > 0 THEN hit END WHEN target = 0 AND before <> 0 AND NOT closed1 THEN 'SELL' END,
    e3, CASE WHEN hit IS NOT NULL THEN fill * {sell} ELSE open * {sell} END
  FROM (
    SELECT *, CASE WHEN hit0 IS NOT NULL THEN 0 ELSE target0 END AS target, hit0 AS hit,
      CASE hit0 WHEN 'SL' THEN least(open, e3 * (1 - sl)) WHEN 'TP' THEN greatest(open, e3 * (1 + tp))
           WHEN 'TRAIL_SL' THEN CASE WHEN open <= p2 * (1 - draw) THEN open ELSE greatest(p2, high) * (1 - draw) END END AS fill,
      CASE WHEN trails AND a3 AND hit0 IS NULL THEN greatest(p2, high) ELSE p2 END AS p3
    FROM (
      SELECT *, CASE WHEN fixes AND low <= e3 * (1 - sl) THEN 'SL' WHEN fixes AND high >= e3 * (1 + tp) THEN 'TP'
                     WHEN trails AND a3 AND (open <= p2 * (1 - draw) OR 1 - low / greatest(p2, high) >= draw) THEN 'TRAIL_SL' END AS hit0
      FROM (
        SELECT *, CASE WHEN trails AND p1 IS NULL THEN e3 ELSE p1 END AS p2,
          CASE WHEN trails AND p1 IS NULL THEN FALSE ELSE a1 END OR (trails AND high / e3 - 1 >= arm) AS a3
        FROM (
          SELECT *, ruled AND use_fixed AND {_seen('open', 'high', 'low')} AS fixes,
            ruled AND use_trail AND {_seen('open', 'high', 'low')} AND coalesce(e1, open) > 0 AND NOT (use_fixed AND
              (low <= coalesce(e1, open) * (1 - sl) OR high >= coalesce(e1, open) * (1 + tp))) AS trails,
            CASE WHEN ruled AND open IS NOT NULL AND (use_fixed OR (high IS NOT NULL AND low IS NOT NULL)) THEN coalesce(e1, open) ELSE e1 END AS e3
          FROM (
            SELECT *, CASE WHEN fresh THEN open ELSE e0 END AS e1, CASE WHEN fresh THEN open ELSE p0 END AS p1, a0 AND NOT fresh AS a1,
              closed AND NOT fresh AS closed1, target0 <> 0 AND before <> 0 AS ruled
            FROM (
              SELECT *, target0 <> 0 AND before = 0 AND NOT blocked AND open IS NOT NULL AS fresh
              FROM (
                SELECT *, CASE WHEN blocked AND noback AND before = 0 THEN 0 WHEN cooling THEN 0 ELSE weight END AS target0
                FROM (
                  SELECT b.*, k.param_id, q.tp, q.sl, q.cd, q.arm, q.draw, q.noback, q.use_fixed, q.use_trail, k.closed, k.stop_day, k.stop_signal,
                    CASE WHEN b.ord = k.last_ord + 1 THEN k.held ELSE 0 END AS before,
                    CASE WHEN b.ord = k.last_ord + 1 THEN k.entry END AS e0,
                    CASE WHEN b.ord = k.last_ord + 1 OR k.entry IS NULL THEN k.peak END AS p0,
                    CASE WHEN b.ord = k.last_ord + 1 OR k.entry IS NULL THEN k.armed ELSE FALSE END AS a0,
                    coalesce(b.day - k.stop_day BETWEEN 0 AND q.cd, FALSE) AS cooling,
                    coalesce(k.stop_signal = b.signal, FALSE) AS blocked
                  FROM st_walk k JOIN st_days b ON b.entity = k.entity AND b.rn = k.rn + 1 JOIN st_set q ON q.param_id = k.param_id))))))))),
st_events AS (SELECT * FROM st_walk WHERE rn > 0),
st_rets AS (SELECT param_id, entity, date, path, w AS weight, r AS ret, w * r AS contribution FROM st_events WHERE path IS NOT NULL),
st_sum AS (SELECT param_id, date, sum(contribution) AS ret_total, count(*) FILTER (path IN ('add', 'keep')) AS n_long FROM st_rets GROUP BY ALL),
st_daily AS (SELECT p.param_id, d.date, coalesce(s.ret_total, 0) AS ret_total, coalesce(s.n_long, 0) AS n_long
  FROM st_set p CROSS JOIN md d LEFT JOIN st_sum s ON s.param_id = p.param_id AND s.date = d.date),
st_nav AS (SELECT param_id, date, ret_total AS ret_long, CAST(0 AS DOUBLE) AS ret_short, ret_total,
  product(1 + ret_total) OVER (PARTITION BY param_id ORDER BY date) AS nav, n_long FROM st_daily),
st_trades AS (SELECT param_id, date, entity, 'BUY' AS action, bought AS entry_price, bought * {buy} AS exec_price FROM st_events WHERE bought IS NOT NULL
  UNION ALL SELECT param_id, date, entity, action, sold_from, sold_at FROM st_events WHERE action IS NOT NULL)"""
