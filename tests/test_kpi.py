import pytest

from lodgemetrics.operators import adr as A
from lodgemetrics.operators import cancel as C
from lodgemetrics.operators import kpi as K
from lodgemetrics.operators import revpar as R
from lodgemetrics.operators import star as S


@pytest.fixture(scope="module")
def year(make):
    rows = []
    for y in (2015, 2016, 2017):
        for m in range(1, 13):
            if (y, m) in {(2016, 5), (2017, 11), (2017, 12)}:
                continue
            for h, base in (("City Hotel", 100.0), ("Resort Hotel", 80.0)):
                for i in range(4):
                    canceled = int(i == 0 and m % 2 == 0)
                    status = "Check-Out" if not canceled else ("No-Show" if m == 4 else "Canceled")
                    rows.append({"hotel": h, "arrival_date": f"{y}-{m:02d}-{i + 1:02d}", "adr": base + m + i + (y - 2015) * 5,
                                 "is_canceled": canceled, "reservation_status": status, "customer_type": ["Transient", "Group"][i % 2]})
    return make(rows)


def test_weighted_rollup_is_not_a_mean_of_rates(make):
    df = make([{"adr": 100.0}] * 3 + [{"arrival_date": "2016-08-01", "adr": 200.0}])
    r = K.kpi_total(S.build_fact_monthly(df)).first()
    assert (r.bookings, r.adr, r.occupancy_rate) == (4, 125.0, 1.0)
    assert K.kpi_direct(df).first().adr == 125.0


def test_weighted_mean_skips_unusable_rows(spark):
    df = spark.createDataFrame([(1.0, 1.0), (float("nan"), 5.0), (None, 5.0), (9.0, 0.0), (float("inf"), 1.0)], "v double, w double")
    assert K.weighted_mean(df, "v", "w").first()[0] == 1.0
    assert K.weighted_mean(df.where("w = 0"), "v", "w").first()[0] == 0.0


def test_bridge_residual_is_zero(year):
    for r in R.revpar_bridge(S.build_fact_monthly(year)).collect():
        assert abs(r.residual) < 1e-9
        assert abs(r.revpar_prev + r.delta_from_adr + r.delta_from_occupancy - r.revpar_curr) < 1e-9


def test_shares_sum_to_100(year):
    assert abs(sum(r.revenue_share_pct for r in K.revenue_share_by(year, "hotel").collect()) - 100) < 1e-9
    assert abs(sum(r.share_pct for r in K.status_mix(year).collect()) - 100) < 1e-9


def test_cy_py_only_compares_months_of_the_current_year(year):
    r = {x.measure: x for x in R.cy_vs_py(R.measure_panel(S.build_fact_monthly(year))).collect()}
    assert (r["total_bookings"].cy, r["total_bookings"].py) == (80.0, 72.0)  # ten months against nine of them
    assert r["adr"].delta > 0


def test_gap_leaves_yoy_empty(year):
    r = {(x.hotel, x.year_month): x for x in R.yoy(S.build_fact_monthly(year)).collect()}
    assert r["City Hotel", "2017-05"].revpar_py is None and r["City Hotel", "2017-06"].revpar_py is not None


def test_funnel_is_monotone_and_variants_differ(year):
    a = [r.n for r in C.booking_funnel(year).orderBy("stage_order").collect()]
    b = [r.n for r in C.booking_funnel(year, no_show_leaks=False).orderBy("stage_order").collect()]
    assert a[0] >= a[1] >= a[2] and b[1] > a[1]


def test_blank_country_is_kept(make):
    df = make([{"country": None}, {"country": "PRT"}, {"country": "PRT"}])
    got = {r.country_code: r.revenue_share_pct for r in K.top_countries(df, 1).collect()}
    assert list(got) == ["PRT"] and abs(got["PRT"] - 200 / 3) < 1e-9


def test_cube_answers_like_bookings(year):
    cube = K.booking_cube(year)
    assert K.cube_kpis(cube).first().bookings == year.count()
    part = K.cube_slice(cube, hotels=["City Hotel"], years=[2016], brush={"month_number": 7, "hotel": "Resort Hotel"})
    assert {(r.hotel, r.year_month) for r in part.collect()} == {("Resort Hotel", "2016-07")}


def test_month_spine_fills_the_gap(year):
    assert K.month_spine(year).count() == 34


def test_min_n_limits(make):
    df = make([{"market_segment": "A"}] * 49 + [{"market_segment": "B"}] * 50)
    assert [r.market_segment for r in C.cancel_by(df, ["market_segment"], 50).collect()] == ["B"]


def test_sample_hash_stays_in_64_bits(spark):
    keys = [1, 2 ** 31 - 1, 2 ** 40 + 3]
    df = spark.createDataFrame([(k,) for k in keys], "booking_key long")
    assert [r[0] for r in df.select(C.sample_hash()).collect()] == [(k * C.HASH_MUL + C.HASH_ADD) % C.HASH_MOD for k in keys]


def test_room_ladder_ties_and_shift_variants(make):
    rows = [{"reserved_room_type": a, "assigned_room_type": b, "adr": v} for a, b, v in
            [("A", "A", 50.0), ("B", "B", 50.0), ("C", "C", 90.0), ("A", "C", 50.0), ("A", "B", 50.0)]]
    df = make(rows)
    counts = A.room_counts(df)
    ladder = A.room_price_ladder(counts)
    assert [(r.room_type, r.premium_vs_prev) for r in ladder.orderBy("rank").collect()] == [("A", 0.0), ("B", 0.0), ("C", 40.0)]
    lateral = {r.shift_type: r.bookings for r in A.room_shift_taxonomy(A.room_pairs(counts)).collect()}
    down = {r.shift_type: r.bookings for r in A.room_shift_taxonomy(A.room_pairs(counts, ties="downgrade")).collect()}
    assert lateral == {"upgrade": 1, "lateral": 1} and down == {"upgrade": 1, "downgrade": 1}
    assert A.upsell_kpi(A.room_pairs(counts)).first().upsell_opp == 40.0 * 3


def test_scorecard_is_half_when_flat(make):
    rows = [{"hotel": h, "arrival_date": d, "lead_time": lt, "adr": v} for h in ("City Hotel", "Resort Hotel")
            for d, v in (("2016-07-08", 120.0), ("2016-02-01", 80.0)) for lt in (1, 200)]
    assert {r.position for r in A.kpi_scorecard(make(rows)).collect()} == {0.5}
