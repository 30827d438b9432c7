"""Catalog entries: monthly series and forecasts."""

from __future__ import annotations

from lodgemetrics.operators import forecast as O
from lodgemetrics.plans.bridge_sql import naive
from lodgemetrics.plans.catalog import Catalog
from lodgemetrics.plans.tails_sql import chi2_p

HOLT = """
WITH RECURSIVE {train} v AS (SELECT hotel, metric, t, value, row_number() OVER (PARTITION BY hotel, metric ORDER BY t) AS rn
    FROM {source} WHERE value IS NOT NULL),
  g AS (SELECT i / 10.0 AS alpha, j / 10.0 AS beta FROM generate_series(1, 9) x(i), generate_series(1, 9) y(j)),
  h AS (SELECT a.hotel, a.metric, alpha, beta, CAST(1 AS BIGINT) AS rn, a.t, a.value AS level,
      (c.value - a.value) / (c.t - a.t) AS trend, CAST(0 AS DOUBLE) AS sse
      FROM v a JOIN v c ON c.hotel = a.hotel AND c.metric = a.metric AND c.rn = 2, g WHERE a.rn = 1
    UNION ALL
    SELECT hotel, metric, alpha, beta, rn, t, l, beta * (l - base) + (1 - beta) * trend, sse + (value - base - trend) ** 2
    FROM (SELECT *, alpha * value + (1 - alpha) * (base + trend) AS l FROM (
      SELECT h.hotel, h.metric, alpha, beta, v.rn, v.t, v.value, trend, sse, level + (v.t - h.t - 1) * trend AS base
      FROM h JOIN v ON v.hotel = h.hotel AND v.metric = h.metric AND v.rn = h.rn + 1))),
  ends AS (SELECT hotel, metric, count(value) AS n, max(t) AS last_t FROM {source} GROUP BY hotel, metric)
SELECT h.hotel, h.metric, alpha, beta, e.n, e.last_t, level + (e.last_t - h.t) * trend AS level, trend, sse
  FROM h JOIN ends e ON e.hotel = h.hotel AND e.metric = h.metric AND e.n = h.rn
  QUALIFY row_number() OVER (PARTITION BY h.hotel, h.metric ORDER BY sse, alpha, beta) = 1"""
HOLT_ALL = HOLT.format(train="", source="ser ")
TRAIN = """SELECT * FROM (SELECT *, max(t) OVER (PARTITION BY hotel, metric) AS end_t FROM ser ) WHERE t <= end_t - 6"""
HOLT_TRAIN = HOLT.format(train=f"tr AS ({TRAIN}),", source="tr ")


WINTERS = """
WITH RECURSIVE {train} v AS (SELECT hotel, metric, t, value, row_number() OVER (PARTITION BY hotel, metric ORDER BY t) AS rn
    FROM {source} ),
  w AS (SELECT i / 10.0 AS x FROM generate_series(1, 9, 2) r(i)),
  g AS (SELECT a.x AS alpha, b.x AS beta, c.x AS gamma FROM w a, w b, w c),
  s AS (SELECT hotel, metric, count(value) AS n, max(t) AS last_t, max(rn) AS months, avg(value) FILTER (rn <= 12) AS m1,
      avg(value) FILTER (rn BETWEEN 13 AND 24) AS m2, list(value ORDER BY rn) FILTER (rn <= 12) AS cycle
    FROM v GROUP BY hotel, metric HAVING count(value) >= 24),
  h AS (SELECT hotel, metric, alpha, beta, gamma, CAST(0 AS BIGINT) AS rn, m1 AS level, coalesce((m2 - m1) / 12, 0) AS trend,
      list_transform(cycle, lambda y: coalesce(y - m1, 0.0)) AS season, CAST(0 AS DOUBLE) AS sse FROM s, g
    UNION ALL
    SELECT hotel, metric, alpha, beta, gamma, next_rn, l, CASE WHEN value IS NULL THEN trend ELSE beta * (l - level) + (1 - beta) * trend END,
      list_concat(season[2:12], [CASE WHEN value IS NULL THEN season[1] ELSE gamma * (value - l) + (1 - gamma) * season[1] END]),
      sse + coalesce((value - level - trend - season[1]) ** 2, 0)
    FROM (SELECT h.*, v.rn AS next_rn, v.value, CASE WHEN v.value IS NULL THEN level + trend
        ELSE alpha * (v.value - season[1]) + (1 - alpha) * (level + trend) END AS l
      FROM h JOIN v ON v.hotel = h.hotel AND v.metric = h.metric AND v.rn = h.rn + 1))
SELECT h.hotel, h.metric, alpha, beta, gamma, s.n, s.last_t, level, trend, season, sse FROM h JOIN s ON s.hotel = h.hotel
  AND s.metric = h.metric AND s.months = h.rn
  QUALIFY row_number() OVER (PARTITION BY h.hotel, h.metric ORDER BY sse, alpha, beta, gamma) = 1"""
WINTERS_ALL = WINTERS.format(train="", source="ser ")
WINTERS_TRAIN = WINTERS.format(train=f"tr AS ({TRAIN}),", source="tr ")


def _wide(effect: str) -> str:
    """Half width of the interval: squares of an error's effects on the months between, added up."""
    return f"1.96 * sqrt(sse / (n - 1) * (1 + coalesce(list_sum(list_transform(range(1, step), lambda j: ({effect}) ** 2)), 0)))"


HOLT_WIDE = _wide("alpha * (1 + beta * j)")
WINTERS_WIDE = _wide("alpha * (1 + beta * j) + CASE WHEN j % 12 = 0 THEN gamma * (1 - alpha) ELSE 0 END")


def _winters_steps(fit: str) -> str:
    return f"""SELECT hotel, metric, CAST(step AS INTEGER) AS step, CAST(last_t + step AS INTEGER) AS t, p AS forecast,
      p - {WINTERS_WIDE} AS lower, p + {WINTERS_WIDE} AS upper
      FROM (SELECT *, level + step * trend + season[(step - 1) % 12 + 1] AS p FROM ({fit}), generate_series(1, 6) s(step))"""


def _holt_steps(fit: str) -> str:
    return f"""SELECT hotel, metric, CAST(step AS INTEGER) AS step, CAST(last_t + step AS INTEGER) AS t, level + step * trend AS forecast,
      level + step * trend - {HOLT_WIDE} AS lower, level + step * trend + {HOLT_WIDE} AS upper
      FROM ({fit}), generate_series(1, 6) s(step)"""


TESTED = f"""SELECT f.*, y.value AS actual FROM (
    SELECT hotel, metric, t, 'holt_trend' AS model, CASE WHEN forecast < 0 THEN 0.0 ELSE forecast END AS forecast, lower, upper FROM ({_holt_steps(HOLT_TRAIN)})
    UNION ALL SELECT hotel, metric, t, 'holt_winters', CASE WHEN forecast < 0 THEN 0.0 ELSE forecast END, lower, upper FROM ({_winters_steps(WINTERS_TRAIN)})
    UNION ALL SELECT hotel, metric, t, 'seasonal_naive', CASE WHEN forecast < 0 THEN 0.0 ELSE forecast END, NULL, NULL FROM (
      WITH tr AS ({TRAIN}) SELECT * FROM ({naive('tr ', 6)}))) f
  JOIN ser y ON y.hotel = f.hotel AND y.metric = f.metric AND y.t = f.t"""
ACF = " UNION ALL ".join(
    f"""SELECT hotel, metric, count(value) AS n, {k} AS lag, sum(c * c{k}) / sum(c * c) AS acf FROM (SELECT *,
    lag(c, {k}) OVER (PARTITION BY hotel, metric ORDER BY t) AS c{k} FROM (SELECT *, value - avg(value)
    OVER (PARTITION BY hotel, metric) AS c FROM ser )) GROUP BY hotel, metric"""
    for k in range(1, 19))


def register(cat: Catalog) -> None:
    add = cat.add
    series = lambda x, **k: O.monthly_series(x.bookings(), **k)
    add("monthly_series", series, "SELECT * FROM ser ", r6="value")
    add("monthly_series_overall", lambda x: series(x, by_hotel=False),
        """SELECT 'overall' AS hotel, CAST(t AS INTEGER) AS t, metric, (t - 1) % 12 + 1 AS month_number,
        printf('%04d-%02d', (t - 1) // 12, (t - 1) % 12 + 1) AS year_month, value FROM (
        SELECT t, unnest(['demand', 'adr', 'revpar', 'room_nights']) AS metric, unnest([d, a, a * o, rn]) AS value FROM (
        SELECT arrival_date_year * 12 + arrival_month_number AS t, CAST(count(*) FILTER (is_canceled = 0) AS DOUBLE) AS d,
        avg(CASE WHEN is_canceled = 0 AND adr > 0 THEN adr END) AS a, avg(1.0 - is_canceled) AS o,
        CAST(sum(CASE WHEN is_canceled = 0 THEN greatest(total_nights, 0) END) AS DOUBLE) AS rn FROM b GROUP BY 1))""", r6="value")
    add("seasonal_decompose", lambda x: O.seasonal_decompose(series(x)),
        """WITH d AS (SELECT *, (CASE WHEN count(value) OVER (w ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) = 11
          THEN sum(value) OVER (w ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) END
          + 0.5 * (lag(value, 6) OVER w + lead(value, 6) OVER w)) / 12 AS trend,
          (t - min(t) OVER (PARTITION BY hotel, metric)) % 12 AS phase FROM ser
          WINDOW w AS (PARTITION BY hotel, metric ORDER BY t)),
        r AS (SELECT hotel, metric, phase, avg(value - trend) AS raw FROM d GROUP BY ALL),
        c AS (SELECT *, raw - avg(raw) OVER (PARTITION BY hotel, metric) AS seasonal FROM r)
        SELECT d.hotel, d.metric, t, month_number, year_month, value, trend, seasonal, value - trend - seasonal AS residual
        FROM d JOIN c ON c.hotel = d.hotel AND c.metric = d.metric AND c.phase = d.phase""",
        r6="value trend seasonal residual")
    add("differencing", lambda x: O.differencing(series(x)),
        """SELECT *, diff1 - lag(diff1, 12) OVER (PARTITION BY hotel, metric ORDER BY t) AS diff1_12 FROM (
        SELECT *, value - lag(value) OVER w AS diff1, value - lag(value, 12) OVER w AS diff12 FROM ser
        WINDOW w AS (PARTITION BY hotel, metric ORDER BY t))""", r6="value diff1 diff12 diff1_12")
    add("acf", lambda x: O.acf(series(x)), ACF, r6="acf")
    boxes = " UNION ALL ".join(
        f"""SELECT hotel, metric, n, {k} AS lag, max(n) * (max(n) + 2) * sum(acf * acf / (n - lag)) AS q_stat
        FROM ({ACF}) WHERE lag <= {k} GROUP BY hotel, metric, n""" for k in (3, 6, 12))
    add("ljung_box", lambda x: O.ljung_box(O.acf(series(x)), p_value=False), boxes, r6="q_stat")
    add("ljung_box_p_value", lambda x: O.ljung_box(O.acf(series(x))),
        f"SELECT *, {chi2_p('q_stat', 'lag')} AS p_value FROM ({boxes})", r6="q_stat p_value")
    add("seasonal_naive", lambda x: O.seasonal_naive(series(x)), "SELECT * FROM naive ", r6="forecast")
    add("holt_trend", lambda x: O.holt_fit(series(x)), HOLT_ALL, r6="alpha beta level trend", r4="sse")
    add("holt_forecast", lambda x: O.holt_forecast(O.holt_fit(series(x))),
        f"""SELECT *, (t - 1) % 12 + 1 AS month_number, printf('%04d-%02d', (t - 1) // 12, (t - 1) % 12 + 1) AS year_month
        FROM ({_holt_steps(HOLT_ALL)})""", r6="forecast lower upper")
    add("holt_winters", lambda x: O.holt_winters_fit(series(x)).drop("season"),
        f"SELECT * EXCLUDE (season) FROM ({WINTERS_ALL})", r6="alpha beta gamma level trend", r4="sse")
    add("holt_winters_forecast", lambda x: O.holt_winters_forecast(O.holt_winters_fit(series(x))),
        f"""SELECT *, (t - 1) % 12 + 1 AS month_number, printf('%04d-%02d', (t - 1) // 12, (t - 1) % 12 + 1) AS year_month
        FROM ({_winters_steps(WINTERS_ALL)})""", r6="forecast lower upper")
    add("holdout_metrics", lambda x: O.holdout_metrics(O.holdout(series(x))),
        f"""SELECT *, CASE WHEN row_number() OVER (PARTITION BY hotel, metric ORDER BY mape, model) = 1 THEN 1 ELSE 0 END AS is_best
        FROM (SELECT hotel, metric, model, avg(abs(actual - forecast)) AS mae, sqrt(avg((actual - forecast) ** 2)) AS rmse,
        avg(abs((actual - forecast) / actual)) FILTER (actual <> 0) AS mape FROM ({TESTED}) GROUP BY ALL)""", r6="mae rmse mape")
    add("pi_coverage", lambda x: O.pi_coverage(O.holdout(series(x))),
        f"""SELECT hotel, metric, model, avg(CASE WHEN actual BETWEEN lower AND upper THEN 1.0 ELSE 0.0 END) AS coverage
        FROM ({TESTED}) WHERE lower IS NOT NULL GROUP BY ALL""", r6="coverage")
    add("season_index", lambda x: O.season_index(series(x)),
        """SELECT *, avg(month_mean) OVER (PARTITION BY hotel, metric) AS grand_mean, month_mean / avg(month_mean)
        OVER (PARTITION BY hotel, metric) AS season_index FROM (SELECT hotel, metric, month_number, avg(value) AS month_mean
        FROM ser GROUP BY ALL)""", r6="month_mean grand_mean season_index")
    add("pricing_stance", lambda x: O.pricing_stance(series(x), O.seasonal_naive(series(x))), "SELECT * FROM fcb ",
        r6="forecast season_index level_index pressure")
    add("forecast_bundle", lambda x: O.forecast_bundle(series(x), O.seasonal_naive(series(x))), "SELECT * FROM bundle ",
        r6="fc_demand fc_adr fc_revpar pressure_demand pressure_adr pressure_revpar")
