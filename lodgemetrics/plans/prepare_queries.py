"""Catalog entries: sources, preparation and the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodgemetrics.functions import bands
from lodgemetrics.functions.exprs import bookings, count_if
from lodgemetrics.operators import prepare as P
from lodgemetrics.operators import star as S
from lodgemetrics.plans.bridge_sql import LEAD_BIN, LEAD_EDA, LEAD_ORDER, season_of
from lodgemetrics.plans.catalog import Catalog, Inputs
from lodgemetrics.schema import RAW_BOOKING
from lodgemetrics.session import cut_lineage
from lodgemetrics.sources.bridge import table

DESCRIBED = ["booking_key", "is_canceled", "lead_time", "stays_in_weekend_nights", "stays_in_week_nights", "adults",
             "children", "babies", "is_repeated_guest", "previous_cancellations", "previous_bookings_not_canceled",
             "booking_changes", "required_car_parking_spaces", "total_of_special_requests", "adr", "arrival_date_year",
             "arrival_month_number", "arrival_date_week_number", "arrival_date_day_of_month", "total_nights", "revenue"]
KEYS = ["hotel", "lead_time", "arrival_date", "customer_type"]
KEY_SQL = ", ".join(KEYS)
RAW_COLUMNS = ["booking_key", *RAW_BOOKING.names]
TEXT = {f.name for f in RAW_BOOKING.fields if f.dataType.simpleString() == "string"}


def _profile_sql() -> str:
    parts = []
    for c in RAW_COLUMNS:
        blank = f"{c} IS NULL OR trim({c}) = ''" if c in TEXT else f"{c} IS NULL"
        parts.append(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS nulls, "
                     f"count(*) FILTER ({blank}) AS nulls_or_blank FROM raw ")
    return " UNION ALL ".join(parts)


def _describe_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, "
        f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, quantile_cont({c}, 0.25) AS q25, "
        f"quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q75 FROM b " for c in DESCRIBED)


def _spread(df, *cols):
    """Row count per distinct combination, to compare row-level operators as a whole."""
    return df.groupBy(*cols).agg(bookings())


def _standardized(x: Inputs):
    return _spread(P.standardize(x.raw()), "hotel", "is_canceled", "arrival_date_month", "year_month",
                   "meal", "market_segment", "reserved_room_type", "deposit_type", "agent", "children")


def _dedup_sql(keys: str) -> str:
    return f"""SELECT hotel, customer_type, count(*) AS bookings, min(booking_key) AS first_key,
      CAST(sum(booking_key) AS BIGINT) AS key_sum
      FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY booking_key) AS rn FROM b )
      WHERE rn = 1 GROUP BY hotel, customer_type"""


def _star_join(x: Inputs):
    # written once: each dimension and the join would bring all tables together again
    fact = cut_lineage(S.build_fact_booking(x.bookings(part=True, nation=True))
                       .select("hotel", "deposit_type", "country", "revenue"))
    joined = S.star_join(fact, [
        (S.build_dim(fact, ["hotel"], "hotel_key").withColumnRenamed("hotel", "hotel_name"), "hotel", "hotel_name", "inner"),
        (S.build_dim(fact, ["deposit_type"], "deposit_key").withColumnRenamed("deposit_type", "deposit_name"),
         "deposit_type", "deposit_name", "inner"),
        (S.build_dim(fact, ["country"], "country_key").withColumnRenamed("country", "country_code"), "country",
         "country_code", "left")])
    return joined.groupBy("hotel_key", "hotel_name", "deposit_key", "deposit_name", "country_key",
                          "country_code").agg(bookings(), F.sum("revenue").alias("revenue"))


def _role_join(x: Inputs, role: str):
    b = cut_lineage(x.bookings(part=True).select("reserved_room_type", "assigned_room_type", "revenue"))
    joined = S.role_join(b, S.build_dim_room_union(b), role)
    return joined.groupBy(f"{role}_room_key", "room_type").agg(bookings(),
                                                               F.sum("revenue").alias("revenue"))


def _fk_sql(name: str, key: str, source: str) -> str:
    return (f"SELECT '{name}' AS constraint_name, count(*) AS orphan_keys, "
            f"CAST(coalesce(sum(n), 0) AS BIGINT) AS orphan_rows FROM (SELECT {key} AS k, count(*) AS n FROM b "
            f"WHERE {key} IS NOT NULL GROUP BY {key}) WHERE k NOT IN ({source})")


def _fk(x: Inputs):
    b = cut_lineage(x.bookings(part=True, nation=True).select("hotel", "country", "reserved_room_type", "assigned_room_type"))
    checks = [S.fk_check(b, S.build_dim(b, ["hotel"], "hotel_key"), "hotel", "hotel", "fk_hotel"),
              S.fk_check(b, S.build_dim(b, ["country"], "country_key"), "country", "country", "fk_country"),
              S.fk_check(b, S.build_dim_room_union(b).where("room_type <> 'I'"), "assigned_room_type",
                         "room_type", "fk_assigned_room_without_i")]
    return checks[0].unionByName(checks[1]).unionByName(checks[2])


def register(cat: Catalog) -> None:
    add = cat.add
    # --- sources and preparation
    add("bookings_source", lambda x: _spread(x.bookings(part=True, nation=True), "hotel", "country",
                                             "market_segment", "deposit_type", "meal"),
        "SELECT hotel, country, market_segment, deposit_type, meal, count(*) AS bookings FROM b GROUP BY ALL")
    add("null_profile", lambda x: P.null_profile(x.raw()), _profile_sql())
    add("describe_table", lambda x: P.describe_table(x.bookings(), DESCRIBED), _describe_sql(),
        r6="mean std min max q25 median q75")
    add("fill_missing",
        lambda x: P.fill_missing(x.raw()).groupBy("country", "children", "agent").agg(bookings()),
        """SELECT coalesce(country, 'Unknown') AS country, CAST(coalesce(children, 0) AS BIGINT) AS children,
        CAST(CAST(coalesce(agent, 0) AS BIGINT) AS VARCHAR) AS agent, count(*) AS bookings FROM raw GROUP BY ALL""")
    add("standardize", _standardized,
        """SELECT trim(hotel) AS hotel, coalesce(is_canceled, 0) AS is_canceled,
        trim(arrival_date_month) AS arrival_date_month, year_month,
        coalesce(nullif(trim(meal), ''), 'Unknown') AS meal,
        coalesce(nullif(trim(market_segment), ''), 'Unknown') AS market_segment,
        coalesce(nullif(trim(reserved_room_type), ''), '?') AS reserved_room_type,
        coalesce(deposit_type, 'No Deposit') AS deposit_type, CAST(CAST(agent AS BIGINT) AS VARCHAR) AS agent,
        CAST(coalesce(children, 0) AS INTEGER) AS children, count(*) AS bookings FROM raw GROUP BY ALL""")
    add("parse_date_multi",
        lambda x: x.raw().select("booking_key", "reservation_status_date",
                                 bands.parse_date_multi("reservation_status_date").alias("parsed")),
        """SELECT booking_key, reservation_status_date, CAST(coalesce(
        CAST(try_strptime(reservation_status_date, '%d/%m/%Y') AS DATE),
        CAST(try_strptime(reservation_status_date, '%m/%d/%Y') AS DATE)) AS VARCHAR) AS parsed FROM raw """)
    add("duplicate_count", lambda x: P.duplicate_count(x.bookings(), KEYS),
        f"SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM b GROUP BY {KEY_SQL})")
    add("duplicate_groups",
        lambda x: P.duplicate_groups(x.bookings(), KEYS).select("booking_key", *KEYS, "adr", "group_size"),
        f"""SELECT * FROM (SELECT booking_key, hotel, lead_time, CAST(arrival_date AS VARCHAR) AS arrival_date,
        customer_type, adr, count(*) OVER (PARTITION BY {KEY_SQL}) AS group_size FROM b ) WHERE group_size > 1""",
        r6="adr")
    add("dedup_by_key",
        lambda x: P.dedup_by_key(x.bookings(), KEYS).groupBy("hotel", "customer_type").agg(
            bookings(), F.min("booking_key").alias("first_key"), F.sum("booking_key").alias("key_sum")),
        _dedup_sql(KEY_SQL))
    add("dedup_exact", lambda x: _spread(P.dedup_exact(x.bookings().select(
            "hotel", "arrival_date", "lead_time", "market_segment", "is_canceled")), "hotel", "market_segment"),
        """SELECT hotel, market_segment, count(*) AS bookings FROM (SELECT DISTINCT hotel, arrival_date, lead_time,
        market_segment, is_canceled FROM b ) GROUP BY ALL""")
    add("add_arrival_date",
        lambda x: _spread(P.add_arrival_date(x.raw()), "arrival_date", "year_month", "day_of_week"),
        "SELECT CAST(arrival_date AS VARCHAR) AS arrival_date, year_month, day_of_week, count(*) AS bookings FROM raw GROUP BY ALL")
    add("add_nights_revenue",
        lambda x: x.bookings().groupBy("total_nights", "is_canceled").agg(
            bookings(), F.sum("revenue").alias("revenue")),
        "SELECT total_nights, is_canceled, count(*) AS bookings, sum(revenue) AS revenue FROM b GROUP BY ALL",
        r4="revenue")
    add("add_monthly_context",
        lambda x: P.add_monthly_context(x.bookings()).select(
            "booking_key", "hotel", "year_month", "adr", "occupancy_rate", "group_adr", "revpar"),
        "SELECT booking_key, hotel, year_month, adr, occupancy_rate, group_adr, revpar FROM ctx ",
        r6="adr occupancy_rate group_adr revpar")
    add("zero_revenue_audit", lambda x: P.zero_revenue_audit(x.bookings()),
        """SELECT count(*) FILTER (revenue = 0) AS zero_revenue,
        count(*) FILTER (revenue = 0 AND is_canceled = 1) AS canceled,
        count(*) FILTER (revenue = 0 AND is_canceled = 0 AND total_nights > 0 AND adr = 0) AS free_stay,
        count(*) FILTER (revenue = 0 AND is_canceled = 0 AND total_nights = 0) AS zero_nights FROM b """)
    add("lead_time_bin",
        lambda x: x.bookings().groupBy(
            "lead_time", bands.lead_time_bin().alias("lead_time_bin"),
            bands.lead_time_bin_order().alias("lead_time_bin_order"),
            bands.lead_time_bin("lead_time", "eda").alias("eda_bin")).agg(bookings()),
        f"""SELECT lead_time, {LEAD_BIN} AS lead_time_bin, {LEAD_ORDER} AS lead_time_bin_order,
        {LEAD_EDA} AS eda_bin, count(*) AS bookings FROM b GROUP BY ALL""")
    add("season",
        lambda x: x.bookings().groupBy(
            "arrival_month_number", bands.season("arrival_month_number").alias("rate_season"),
            bands.season("arrival_month_number", "calendar").alias("calendar_season")).agg(bookings()),
        f"""SELECT arrival_month_number, {season_of('arrival_month_number')} AS rate_season,
        CASE WHEN arrival_month_number IN (12, 1, 2) THEN 'Winter' WHEN arrival_month_number <= 5 THEN 'Spring'
        WHEN arrival_month_number <= 8 THEN 'Summer' ELSE 'Autumn' END AS calendar_season,
        count(*) AS bookings FROM b GROUP BY ALL""")
    add("cancel_label", lambda x: x.bookings(part=True).groupBy(
            bands.cancel_label().alias("cancel_label"),
            bands.room_mismatch_flag().alias("room_mismatch_flag")).agg(bookings()),
        """SELECT CASE WHEN is_canceled = 1 THEN 'Canceled' ELSE 'Not canceled' END AS cancel_label,
        CASE WHEN reserved_room_type <> assigned_room_type THEN 1 ELSE 0 END AS room_mismatch_flag,
        count(*) AS bookings FROM b GROUP BY ALL""")
    add("filter_stays", lambda x: x.stays().groupBy("hotel").agg(
            bookings(), F.min("adr").alias("min_adr"), F.max("is_canceled").alias("max_canceled")),
        "SELECT hotel, count(*) AS bookings, min(adr) AS min_adr, max(is_canceled) AS max_canceled FROM stays GROUP BY hotel",
        r6="min_adr")
    # --- star schema
    add("build_dim", lambda x: S.build_dim(x.bookings(), ["market_segment", "distribution_channel"], "market_key"),
        """SELECT CAST(row_number() OVER (ORDER BY market_segment, distribution_channel) AS INTEGER) AS market_key,
        market_segment, distribution_channel FROM (SELECT DISTINCT market_segment, distribution_channel FROM b )""")
    add("build_dim_agent", lambda x: S.build_dim(
            x.bookings().select(F.coalesce("agent", F.lit("NULL")).alias("agent_id")), ["agent_id"], "agent_key"),
        """SELECT CAST(row_number() OVER (ORDER BY agent_id) AS INTEGER) AS agent_key, agent_id
        FROM (SELECT DISTINCT coalesce(agent, 'NULL') AS agent_id FROM b )""")
    for name, cols in (("customer", ["customer_type", "is_repeated_guest"]), ("meal", ["meal"]),
                       ("room_pair", ["reserved_room_type", "assigned_room_type"]),
                       ("market_deposit", ["market_segment", "deposit_type"])):
        listed = ", ".join(cols)
        add(f"build_dim_{name}", lambda x, c=cols, n=name: S.build_dim(x.raw(), c, f"{n}_key", nulls=True),
            f"""SELECT CAST(row_number() OVER (ORDER BY {", ".join(f"{c} NULLS FIRST" for c in cols)}) AS INTEGER) AS {name}_key,
            {listed} FROM (SELECT DISTINCT {listed} FROM raw )""")
    add("build_dim_room_union", lambda x: S.build_dim_room_union(x.bookings(part=True)),
        """SELECT CAST(row_number() OVER (ORDER BY room_type) AS INTEGER) AS room_key, room_type FROM (
        SELECT reserved_room_type AS room_type FROM b UNION SELECT assigned_room_type FROM b )""")
    add("build_dim_date", lambda x: S.build_dim_date(x.bookings()),
        f"""SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, CAST(d AS VARCHAR) AS full_date,
        CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month_number, monthname(d) AS month_name,
        strftime(d, '%Y-%m') AS year_month, 'Q' || quarter(d) AS quarter,
        CAST(weekofyear(d) AS INTEGER) AS week_number, CAST(day(d) AS INTEGER) AS day_of_month,
        dayname(d) AS day_of_week, {season_of('month(d)')} AS season
        FROM (SELECT CAST(unnest(generate_series(least(min(arrival_date), DATE '2015-07-01'),
          greatest(max(arrival_date), DATE '2017-09-30'), INTERVAL 1 DAY)) AS DATE) AS d FROM b )""")
    add("build_fact_booking", lambda x: S.build_fact_booking(x.bookings(part=True, nation=True)).select(
            "booking_key", "hotel", "arrival_date", "year_month", "day_of_week", "country", "deposit_type",
            "total_nights", "cancel_label", "lead_time_bin", "room_mismatch_flag", "adr", "revenue"),
        f"""SELECT booking_key, hotel, CAST(arrival_date AS VARCHAR) AS arrival_date, year_month, day_of_week, country,
        deposit_type, total_nights, CASE WHEN is_canceled = 1 THEN 'Canceled' ELSE 'Not canceled' END AS cancel_label,
        {LEAD_BIN} AS lead_time_bin, CASE WHEN reserved_room_type <> assigned_room_type THEN 1 ELSE 0 END AS room_mismatch_flag,
        adr, revenue FROM b """, r6="adr", r4="revenue")
    monthly_cols = """hotel, year_month, year, month_number, CAST(month_start_date AS VARCHAR) AS month_start_date,
        total_bookings, successful_bookings, canceled_bookings, occupancy_rate, adr, revpar, total_revenue,
        avg_lead_time, avg_total_nights, no_show_bookings"""
    for variant, cte in (("warehouse", "mon"), ("analysis", "mona")):
        add(f"build_fact_monthly_{variant}", lambda x, v=variant: x.monthly(v),
            f"SELECT {monthly_cols} FROM {cte} ", r6="occupancy_rate adr revpar avg_lead_time avg_total_nights",
            r4="total_revenue")
    add("build_fact_daily_warehouse", lambda x: x.daily(),
        "SELECT * REPLACE (CAST(arrival_date AS VARCHAR) AS arrival_date) FROM dly ",
        r6="occupancy_rate adr revpar", r4="revenue")
    add("build_fact_daily_context", lambda x: x.daily("context"),
        "SELECT * REPLACE (CAST(arrival_date AS VARCHAR) AS arrival_date) FROM dctx ",
        r6="occupancy_rate adr revpar", r4="revenue")
    add("fk_check", _fk, " UNION ALL ".join([
        _fk_sql("fk_hotel", "hotel", "SELECT DISTINCT hotel FROM b "),
        _fk_sql("fk_country", "country", "SELECT DISTINCT country FROM b WHERE country IS NOT NULL"),
        _fk_sql("fk_assigned_room_without_i", "assigned_room_type",
                "SELECT reserved_room_type FROM b WHERE reserved_room_type <> 'I' UNION "
                "SELECT assigned_room_type FROM b WHERE assigned_room_type <> 'I'")]))
    add("table_counts", lambda x: S.table_counts({
            "fact_booking": x.bookings(), "fact_revpar_monthly": x.monthly(), "fact_daily_adrocc": x.daily(),
            "dim_hotel": S.build_dim(x.bookings(), ["hotel"], "k"), "lineitem": table(x.spark, x.sf_dir, "lineitem")}),
        """SELECT 'fact_booking' AS table_name, count(*) AS n FROM b UNION ALL
        SELECT 'fact_revpar_monthly', count(*) FROM mon UNION ALL SELECT 'fact_daily_adrocc', count(*) FROM dly
        UNION ALL SELECT 'dim_hotel', count(DISTINCT hotel) FROM b UNION ALL SELECT 'lineitem', count(*) FROM lineitem""")
    add("unique_check", lambda x: S.unique_check(x.bookings(), ["booking_key"]),
        "SELECT booking_key, count(*) AS n FROM b GROUP BY booking_key HAVING count(*) > 1")
    add("unique_check_monthly", lambda x: S.unique_check(x.monthly(), ["hotel", "year_month"]).agg(
            F.count(F.lit(1)).alias("violations")),
        "SELECT count(*) AS violations FROM (SELECT hotel, year_month FROM mon GROUP BY ALL HAVING count(*) > 1)")
    add("star_join", _star_join,
        """SELECT dense_rank() OVER (ORDER BY hotel) ::INTEGER AS hotel_key, hotel AS hotel_name,
        dense_rank() OVER (ORDER BY deposit_type) ::INTEGER AS deposit_key, deposit_type AS deposit_name,
        CASE WHEN country IS NOT NULL THEN dense_rank() OVER (ORDER BY country NULLS LAST) ::INTEGER END AS country_key,
        country AS country_code, count(*) AS bookings, sum(revenue) AS revenue
        FROM b GROUP BY hotel, deposit_type, country""", r4="revenue")
    for role in ("reserved", "assigned"):
        add(f"role_join_{role}", lambda x, r=role: _role_join(x, r),
            f"""SELECT k.{role}_room_key, k.room_type, count(*) AS bookings, sum(revenue) AS revenue FROM b JOIN (
            SELECT CAST(row_number() OVER (ORDER BY room_type) AS INTEGER) AS {role}_room_key, room_type FROM (
              SELECT reserved_room_type AS room_type FROM b UNION SELECT assigned_room_type FROM b )) k
            ON {role}_room_type = k.room_type GROUP BY ALL""", r4="revenue")
    add("parameter_range",
        lambda x: x.bookings().groupBy((F.pmod("lead_time", F.lit(61)) - 30).alias("adr_change_pct"))
        .agg(bookings()).join(S.parameter_range(x.spark, "adr_change_pct"), "adr_change_pct", "right"),
        """SELECT CAST(r AS INTEGER) AS adr_change_pct, n AS bookings FROM generate_series(-30, 30) t(r)
        LEFT JOIN (SELECT lead_time % 61 - 30 AS k, count(*) AS n FROM b GROUP BY 1) ON k = r""")
