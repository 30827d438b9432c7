"""CTEs of the oracle SQL: the booking bridge and the facts built from it."""

BOOKINGS = """
SELECT l_orderkey * 8 + l_linenumber AS booking_key,
  CASE WHEN c_nationkey % 2 = 0 THEN 'City Hotel' ELSE 'Resort Hotel' END AS hotel,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_canceled,
  CAST(abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) % 366 AS INTEGER) AS lead_time,
  CAST(l_shipdate AS DATE) AS arrival_date,
  CAST(year(l_shipdate) AS INTEGER) AS arrival_date_year,
  CAST(month(l_shipdate) AS INTEGER) AS arrival_month_number,
  monthname(l_shipdate) AS arrival_date_month, dayname(l_shipdate) AS day_of_week,
  CAST(weekofyear(l_shipdate) AS INTEGER) AS arrival_date_week_number,
  CAST(day(l_shipdate) AS INTEGER) AS arrival_date_day_of_month,
  strftime(l_shipdate, '%Y-%m') AS year_month,
  CAST(l_quantity AS INTEGER) % 3 AS stays_in_weekend_nights,
  CAST(l_quantity AS INTEGER) % 6 AS stays_in_week_nights,
  CAST(l_quantity AS INTEGER) % 3 + CAST(l_quantity AS INTEGER) % 6 AS total_nights,
  CAST(l_suppkey % 3 + 1 AS INTEGER) AS adults,
  CASE WHEN CAST(l_quantity AS INTEGER) % 11 = 0 THEN NULL
       WHEN CAST(l_quantity AS INTEGER) % 7 = 0 THEN 1 ELSE 0 END AS children,
  CASE WHEN CAST(l_quantity AS INTEGER) % 13 = 0 THEN 1 ELSE 0 END AS babies,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Online TA' WHEN 'BUILDING' THEN 'Offline TA/TO'
    WHEN 'FURNITURE' THEN 'Groups' WHEN 'HOUSEHOLD' THEN 'Direct' WHEN 'MACHINERY' THEN 'Corporate'
    ELSE c_mktsegment END AS market_segment,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'TA/TO' WHEN '2-HIGH' THEN 'Direct' WHEN '3-MEDIUM' THEN 'Corporate'
    WHEN '4-NOT SPECIFIED' THEN 'TA/TO' WHEN '5-LOW' THEN 'GDS' ELSE o_orderpriority END AS distribution_channel,
  CASE c_custkey % 4 WHEN 0 THEN 'Transient' WHEN 1 THEN 'Transient-Party' WHEN 2 THEN 'Contract'
    ELSE 'Group' END AS customer_type,
  CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS is_repeated_guest,
  CAST(CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 3 ELSE 0 END AS INTEGER) AS previous_cancellations,
  CAST(c_custkey % 4 AS INTEGER) AS previous_bookings_not_canceled,
  l_linenumber % 3 AS booking_changes,
  CASE WHEN l_suppkey % 10 <> 0 THEN CAST(l_suppkey AS VARCHAR) END AS agent,
  CASE WHEN l_tax > 0.065 THEN 1 ELSE 0 END AS required_car_parking_spaces,
  CAST(l_quantity AS INTEGER) % 5 AS total_of_special_requests,
  CASE WHEN l_linenumber = 7 AND l_discount < 0.02 THEN 0.0 ELSE l_extendedprice / 500 END AS adr,
  CASE WHEN l_returnflag = 'R' THEN 0.0
       ELSE (CASE WHEN l_linenumber = 7 AND l_discount < 0.02 THEN 0.0 ELSE l_extendedprice / 500 END)
            * (CAST(l_quantity AS INTEGER) % 3 + CAST(l_quantity AS INTEGER) % 6) END AS revenue,
  CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'No-Show' WHEN l_returnflag = 'R' THEN 'Canceled'
    ELSE 'Check-Out' END AS reservation_status,
  CASE WHEN c_nationkey <> 24 THEN n_name END AS country,
  CASE p_size % 10 WHEN 0 THEN 'Refundable' WHEN 1 THEN 'Non Refund' ELSE 'No Deposit' END AS deposit_type,
  chr(CAST(65 + p_size % 8 AS INTEGER)) AS reserved_room_type,
  chr(CAST(65 + p_size % 8 + CASE WHEN l_linenumber = 2 THEN 1
      WHEN l_linenumber = 3 AND p_size % 8 > 0 THEN -1 ELSE 0 END AS INTEGER)) AS assigned_room_type,
  CASE p_size % 4 WHEN 0 THEN 'BB' WHEN 1 THEN 'HB' WHEN 2 THEN 'FB' ELSE 'SC' END AS meal
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey"""

LEAD_BIN = """CASE WHEN lead_time <= 7 THEN '0-7d' WHEN lead_time <= 30 THEN '8-30d' WHEN lead_time <= 90 THEN '31-90d'
  WHEN lead_time <= 180 THEN '91-180d' ELSE '180d+' END"""
LEAD_ORDER = """CASE WHEN lead_time <= 7 THEN 0 WHEN lead_time <= 30 THEN 1 WHEN lead_time <= 90 THEN 2
  WHEN lead_time <= 180 THEN 3 ELSE 4 END"""
LEAD_STRATEGY = LEAD_BIN.replace("d'", "'").replace("d+'", "+'")
LEAD_EDA = """CASE WHEN lead_time <= 30 THEN '0-30' WHEN lead_time <= 60 THEN '31-60' WHEN lead_time <= 90 THEN '61-90'
  WHEN lead_time <= 180 THEN '91-180' ELSE '>180' END"""
SEASON = """CASE WHEN month_number IN (7, 8) THEN 'Peak' WHEN month_number IN (4, 5, 6, 9, 10) THEN 'Shoulder'
  ELSE 'Low' END"""


def season_of(column: str) -> str:
    return SEASON.replace("month_number", column)


def monthly(adr: str, nights: str) -> str:
    return f"""
SELECT hotel, year_month, arrival_date_year AS year, arrival_month_number AS month_number,
  make_date(arrival_date_year, arrival_month_number, 1) AS month_start_date,
  count(*) AS total_bookings, count(*) FILTER (is_canceled = 0) AS successful_bookings,
  count(*) FILTER (is_canceled = 1) AS canceled_bookings, avg(1.0 - is_canceled) AS occupancy_rate,
  coalesce(avg({adr}), 0.0) AS adr, coalesce(avg({adr}), 0.0) * avg(1.0 - is_canceled) AS revpar,
  sum(revenue) AS total_revenue, avg(lead_time) AS avg_lead_time, avg({nights}) AS avg_total_nights,
  count(*) FILTER (reservation_status = 'No-Show') AS no_show_bookings
FROM b GROUP BY hotel, year_month, arrival_date_year, arrival_month_number"""


PAID = "CASE WHEN is_canceled = 0 AND adr > 0 THEN adr END"
STAYED = "CASE WHEN is_canceled = 0 THEN adr END"



def naive(source: str, h: int) -> str:
    """Seasonal naive forecast of the series in ``source``."""
    return f"""
WITH e AS (SELECT hotel, metric, max(t) AS last_t, count(value) AS n, avg(value) AS mean FROM {source} GROUP BY hotel, metric),
  x AS (SELECT hotel, metric, CAST(unnest(generate_series(1, {h})) AS INTEGER) AS step, last_t, n, mean FROM e)
SELECT x.hotel, x.metric, x.step, x.last_t + x.step AS t,
  CASE WHEN n < 12 THEN mean ELSE coalesce(y.value, mean) END AS forecast,
  (x.last_t + x.step - 1) % 12 + 1 AS month_number,
  printf('%04d-%02d', (x.last_t + x.step - 1) // 12, (x.last_t + x.step - 1) % 12 + 1) AS year_month
FROM x LEFT JOIN {source} y ON y.hotel = x.hotel AND y.metric = x.metric
  AND y.t = x.last_t + x.step - 12 * CAST(ceil(x.step / 12) AS INTEGER)"""


CTES = {
    "b": BOOKINGS,
    "stays": "SELECT * FROM b WHERE is_canceled = 0 AND adr > 0",
    "mon": monthly(PAID, "CASE WHEN is_canceled = 0 THEN total_nights END"),
    "mona": monthly(STAYED, "total_nights"),
    "dly": f"""
SELECT hotel, arrival_date, year_month, arrival_date_year AS year, count(*) AS bookings,
  count(*) FILTER (is_canceled = 1) AS canceled, count(*) FILTER (is_canceled = 0) AS successful,
  avg(1.0 - is_canceled) AS occupancy_rate, avg({PAID}) AS adr,
  CAST(sum(CASE WHEN is_canceled = 0 THEN total_nights ELSE 0 END) AS BIGINT) AS room_nights_sold,
  sum(revenue) AS revenue, avg({PAID}) * avg(1.0 - is_canceled) AS revpar
FROM b GROUP BY ALL""",
    "ctx": f"""
SELECT b.*, c.occupancy_rate, c.group_adr, c.group_adr * c.occupancy_rate AS revpar FROM b JOIN (
  SELECT hotel, year_month, avg(1.0 - is_canceled) AS occupancy_rate, avg({STAYED}) AS group_adr
  FROM b GROUP BY hotel, year_month) c ON b.hotel = c.hotel AND b.year_month = c.year_month""",
    "dctx": """
SELECT hotel, arrival_date, year_month, arrival_date_year AS year, count(*) AS bookings,
  count(*) FILTER (is_canceled = 1) AS canceled, count(*) FILTER (is_canceled = 0) AS successful,
  avg(occupancy_rate) AS occupancy_rate, avg(adr) AS adr,
  CAST(sum(CASE WHEN is_canceled = 0 THEN total_nights ELSE 0 END) AS BIGINT) AS room_nights_sold,
  sum(revenue) AS revenue, CAST(sum(total_nights) AS BIGINT) AS available_room_nights,
  avg(adr) * avg(occupancy_rate) AS revpar
FROM ctx GROUP BY ALL""",
    "cube": f"""
SELECT hotel, arrival_date_year AS year, year_month, {LEAD_BIN} AS lead_bin, deposit_type,
  distribution_channel AS channel, market_segment AS segment, reservation_status AS status, country,
  count(*) AS bookings, CAST(sum(is_canceled) AS BIGINT) AS canceled,
  count(*) FILTER (reservation_status = 'No-Show') AS noshow, sum(revenue) AS revenue
FROM b GROUP BY ALL""",
    "raw": """
SELECT booking_key, ' ' || hotel || '  ' AS hotel,
  CASE WHEN booking_key % 97 <> 0 THEN is_canceled END AS is_canceled,
  CASE WHEN booking_key % 89 <> 0 THEN lead_time END AS lead_time,
  arrival_date_year, arrival_date_month || ' ' AS arrival_date_month, arrival_date_week_number,
  arrival_date_day_of_month, arrival_month_number, arrival_date, day_of_week, year_month,
  stays_in_weekend_nights, stays_in_week_nights, adults, CAST(children AS DOUBLE) AS children, babies,
  CASE WHEN booking_key % 31 = 0 THEN '  ' ELSE meal END AS meal, country,
  CASE WHEN booking_key % 41 = 0 THEN '' ELSE market_segment END AS market_segment,
  distribution_channel, is_repeated_guest, previous_cancellations, previous_bookings_not_canceled,
  CASE WHEN booking_key % 43 = 0 THEN ' ' ELSE reserved_room_type END AS reserved_room_type,
  assigned_room_type, booking_changes,
  CASE WHEN booking_key % 47 = 0 THEN NULL ELSE deposit_type END AS deposit_type,
  CAST(agent AS DOUBLE) AS agent, CAST(NULL AS DOUBLE) AS company, 0 AS days_in_waiting_list, customer_type,
  CASE WHEN booking_key % 53 <> 0 THEN adr END AS adr, required_car_parking_spaces,
  total_of_special_requests, reservation_status,
  CASE WHEN booking_key % 59 = 0 THEN 'n/a'
    WHEN booking_key % 2 = 0 THEN strftime(arrival_date - lead_time, '%d/%m/%Y')
    ELSE strftime(arrival_date - lead_time, '%m/%d/%Y') END AS reservation_status_date
FROM b""",
    "panel": """
SELECT year, month_number, sum(total_bookings) AS tb, sum(successful_bookings) AS sb,
  sum(canceled_bookings) AS cb, sum(no_show_bookings) AS ns, sum(total_revenue) AS rev,
  sum(adr * successful_bookings) AS adr_w, sum(occupancy_rate * total_bookings) AS occ_w,
  sum(revpar * total_bookings) AS rp_w
FROM mon GROUP BY year, month_number""",
    "pan": f"""
SELECT *, ln(greatest(demand, 1)) AS log_demand, ln(greatest(adr, 0.001)) AS log_adr, ln(greatest(revpar, 0.001)) AS log_revpar
FROM (SELECT hotel, year_month, arrival_month_number AS month_number, {season_of('arrival_month_number')} AS season,
  count({PAID}) AS demand, avg({PAID}) AS adr, avg(1.0 - is_canceled) AS occ,
  avg({STAYED}) * avg(1.0 - is_canceled) AS revpar, avg(lead_time) FILTER (is_canceled = 0 AND adr > 0) AS lead_mean,
  avg(total_nights) FILTER (is_canceled = 0 AND adr > 0) AS los_mean,
  avg(total_of_special_requests) FILTER (is_canceled = 0 AND adr > 0) AS special_req,
  avg(CASE WHEN market_segment = 'Online TA' THEN 1.0 ELSE 0.0 END) FILTER (is_canceled = 0 AND adr > 0) AS share_online_ta,
  avg(CASE WHEN market_segment = 'Groups' THEN 1.0 ELSE 0.0 END) FILTER (is_canceled = 0 AND adr > 0) AS share_groups,
  avg(CASE WHEN customer_type = 'Transient' THEN 1.0 ELSE 0.0 END) FILTER (is_canceled = 0 AND adr > 0) AS share_transient,
  count(*) AS n_bookings, avg(is_canceled) AS cancel_rate
FROM b GROUP BY hotel, year_month, arrival_month_number) WHERE demand > 0""",
    "segpan": """
SELECT *, ln(greatest(demand, 1)) AS log_demand, ln(greatest(adr, 0.001)) AS log_adr FROM (
SELECT hotel, market_segment, year_month, arrival_month_number AS month_number, count(*) AS demand, avg(adr) AS adr
FROM stays GROUP BY ALL)""",
    "ser": f"""
WITH w AS (SELECT hotel, arrival_date_year * 12 + arrival_month_number AS t,
    CAST(count(*) FILTER (is_canceled = 0) AS DOUBLE) AS demand, avg({PAID}) AS adr,
    avg({PAID}) * avg(1.0 - is_canceled) AS revpar,
    CAST(sum(CASE WHEN is_canceled = 0 THEN total_nights END) AS DOUBLE) AS room_nights FROM b GROUP BY 1, 2),
  s AS (SELECT hotel, CAST(unnest(generate_series(min(t), max(t))) AS INTEGER) AS t FROM w GROUP BY hotel),
  f AS (SELECT s.hotel, s.t, demand, adr, revpar, room_nights FROM s LEFT JOIN w ON s.hotel = w.hotel AND s.t = w.t)
SELECT hotel, metric, t, (t - 1) % 12 + 1 AS month_number, printf('%04d-%02d', (t - 1) // 12, (t - 1) % 12 + 1) AS year_month, value
FROM (SELECT hotel, t, 'demand' AS metric, demand AS value FROM f UNION ALL SELECT hotel, t, 'adr', adr FROM f
  UNION ALL SELECT hotel, t, 'revpar', revpar FROM f UNION ALL SELECT hotel, t, 'room_nights', room_nights FROM f)""",
    "naive": naive("ser", 6),
    "fcb": """
WITH m AS (SELECT hotel, metric, month_number, avg(value) AS mm FROM ser GROUP BY ALL),
  i AS (SELECT *, avg(mm) OVER (PARTITION BY hotel, metric) AS grand FROM m),
  p AS (SELECT n.*, i.mm / i.grand AS season_index, n.forecast / i.grand AS level_index,
    0.5 * i.mm / i.grand + 0.5 * n.forecast / i.grand AS pressure FROM naive n JOIN i ON i.hotel = n.hotel
    AND i.metric = n.metric AND i.month_number = n.month_number),
  q AS (SELECT *, CASE WHEN pressure >= 1.15 THEN 'PROTECT' WHEN pressure <= 0.90 THEN 'STIMULATE' ELSE 'NEUTRAL' END AS stance FROM p)
SELECT * FROM q""",
    "bundle": """
SELECT hotel, t, year_month, month_number,
  max(forecast) FILTER (metric = 'demand') AS fc_demand, max(forecast) FILTER (metric = 'adr') AS fc_adr,
  max(forecast) FILTER (metric = 'revpar') AS fc_revpar, max(pressure) FILTER (metric = 'demand') AS pressure_demand,
  max(pressure) FILTER (metric = 'adr') AS pressure_adr, max(pressure) FILTER (metric = 'revpar') AS pressure_revpar,
  max(stance) FILTER (metric = 'demand') AS stance_demand, max(stance) FILTER (metric = 'adr') AS stance_adr,
  max(stance) FILTER (metric = 'revpar') AS stance_revpar FROM fcb GROUP BY hotel, t, year_month, month_number""",
    "slopes": "SELECT hotel, regr_slope(cancel_rate, log_adr) AS risk_slope FROM pan GROUP BY hotel",
    "scored": """
SELECT *, 0.30::DOUBLE * is_canceled + 0.25::DOUBLE * lead_time / 366 + 0.45::DOUBLE * (((booking_key * 7919) % 10007) / 10007.0::DOUBLE) AS p,
  0.25::DOUBLE * is_canceled + 0.25::DOUBLE * lead_time / 366 + 0.50::DOUBLE * (((booking_key * 104729) % 10009) / 10009.0::DOUBLE) AS p2
FROM b""",
}
