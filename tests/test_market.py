"""Periods, metrics, trends, growth and profiles on small frames."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from marketspark.functions.periods import Period, calendar, period_index
from marketspark.operators import anomalies, charts, metrics, opportunities, profiles, reports, trends

SALES = """transaction_id string, instance_date date, area_name_en string, developer string, project_name_en string, property_type string, rooms_en string,
actual_worth double, procedure_area double, meter_sale_price double, transaction_type string, originally_offplan boolean, is_luxury boolean,
transaction_year int, transaction_month int"""


def sale(i, day, area="Marina", price=100.0, kind="Off-Plan", developer="Dev", project="Tower", ptype="Villa", rooms="1 B/R", luxury=False):
    return (f"t{i:04}", day, area, developer, project, ptype, rooms, float(price), 10.0, price / 10.0, kind, kind == "Off-Plan", luxury, day.year, day.month)


def frame(spark, rows):
    return spark.createDataFrame(rows, SALES)


def test_period_bounds():
    assert (Period(2024, "monthly", 2).start, Period(2024, "monthly", 2).end) == (date(2024, 2, 1), date(2024, 3, 1))
    assert (Period(2023, "quarterly", 4).start, Period(2023, "quarterly", 4).end) == (date(2023, 10, 1), date(2024, 1, 1))
    assert Period(2024, "semi_annual", 2).end == date(2025, 1, 1) and Period(2024, "annual").end == date(2025, 1, 1)
    assert Period(2024, "quarterly", 1).previous() == Period(2023, "quarterly", 4)
    assert Period(2024, "monthly", 3).year_before() == Period(2023, "monthly", 3)
    assert Period(2024, "monthly", 3).preceding_window() == (date(2024, 1, 30), date(2024, 3, 1))
    assert Period(2024, "monthly", 1).lookback(13) == (date(2022, 12, 1), date(2024, 1, 1))
    for bad in (("monthly", 13), ("quarterly", 0), ("weekly", 1)):
        with pytest.raises(ValueError):
            Period(2024, *bad)


BOUNDS = [date(2023, 12, 31), date(2024, 1, 1), date(2024, 2, 29), date(2024, 3, 31), date(2024, 4, 1), date(2024, 6, 30), date(2024, 12, 31), date(2025, 1, 1)]


def test_periods_are_disjoint_and_complete(spark):
    df = frame(spark, [sale(i, d) for i, d in enumerate(BOUNDS)])
    for kind, n in (("monthly", 12), ("quarterly", 4), ("semi_annual", 2)):
        total = sum(df.where(Period(2024, kind, i).contains()).count() for i in range(1, n + 1))
        assert total == df.where(Period(2024, "annual").contains()).count() == 6
        same = df.select("instance_date", period_index("instance_date", kind).alias("p")).collect()
        for r in same:
            matching = [i for i in range(1, n + 1) if Period(r["instance_date"].year, kind, i).start <= r["instance_date"] < Period(r["instance_date"].year, kind, i).end]
            assert r["p"] == r["instance_date"].year * n + matching[0] - 1


def test_series_keeps_empty_periods(spark):
    df = frame(spark, [sale(1, date(2024, 1, 5)), sale(2, date(2024, 3, 5), price=300.0)])
    got = reports.time_series(df, Period(2023, "monthly", 12), Period(2024, "monthly", 4)).orderBy("period_index").collect()
    assert [(r["period_year"], r["period_number"], r["total_transactions"], r["total_sales_volume"], r["avg_price"]) for r in got] == [
        (2023, 12, 0, 0.0, None), (2024, 1, 1, 100.0, 100.0), (2024, 2, 0, 0.0, None), (2024, 3, 1, 300.0, 300.0), (2024, 4, 0, 0.0, None)
    ]
    assert calendar(spark, Period(2023, "annual"), Period(2024, "annual")).count() == 2


def test_empty_period_is_a_row_of_zeros(spark):
    row = reports.period_metrics(frame(spark, [sale(1, date(2024, 1, 5))]), Period(2020, "annual")).first()
    assert (row["total_transactions"], row["total_sales_volume"], row["luxury_percentage"], row["price_range"]) == (0, 0.0, 0.0, 0.0)


def test_segments_add_up(spark):
    rows = [sale(i, BOUNDS[i % 8], price=100 + i, kind=("Off-Plan", "Existing")[i % 2], luxury=i % 5 == 0, area=f"A{i % 3}") for i in range(60)]
    df = frame(spark, rows)
    year = reports.period_metrics(df, Period(2024, "annual")).first()
    assert year["offplan_count"] + year["ready_count"] == year["total_transactions"]
    assert abs(year["offplan_volume"] + year["ready_volume"] - year["total_sales_volume"]) < 1e-6
    shares = metrics.mix(df, "area_name_en", "area").agg(F.sum("pct")).first()[0]
    assert abs(shares - 100) < 1e-9
    compared = {r["measure"]: r for r in reports.period_comparison(df, Period(2024, "annual"), "yoy").collect()}
    assert compared["offplan_percentage"]["percentage_change"] is None
    assert compared["total_transactions"]["absolute_change"] == year["total_transactions"] - df.where("transaction_year = 2023").count()


def test_change_follows_rows_and_not_the_calendar(spark):
    rows = [("A", 2024, m, "Villa", p, 5) for m, p in ((1, 100.0), (2, 110.0), (5, 0.0), (6, 50.0))]
    df = spark.createDataFrame(rows, "area_name_en string, transaction_year int, transaction_month int, property_type string, avg_price double, tx_count int")
    got = metrics.month_over_month(df).orderBy("transaction_month").collect()
    assert [(r["prev_month_price"], r["pct_change_mom"]) for r in got] == [(None, None), (100.0, pytest.approx(10.0)), (110.0, -100.0), (0.0, None)]


def _monthly(spark, prices, count=10, scope="A"):
    """One scope with the given monthly averages, newest first, ending in June 2024."""
    rows = []
    for back, price in enumerate(prices):
        index = 2024 * 12 + 5 - back
        if price is not None:
            rows += [sale(len(rows) + i, date(index // 12, index % 12 + 1, 15), scope, price) for i in range(count)]
    return rows


AS_OF = date(2024, 6, 30)


def test_momentum_and_trajectory(spark):
    rising = [200.0 * 0.9**i for i in range(13)]
    rows = _monthly(spark, rising) + _monthly(spark, [100.0] * 13, scope="B") + _monthly(spark, [100.0, 120.0], scope="C")
    rows += _monthly(spark, [100.0] * 12, count=4, scope="D")
    rows += _monthly(spark, [110.0, 100.0, None, 100.0, 90.0], scope="E")
    got = {r["area_name_en"]: r for r in trends.price_momentum(frame(spark, rows), ["area_name_en"], AS_OF).collect()}
    assert got["A"]["momentum_3m"] == pytest.approx((1 / 0.9**3 - 1) * 100) and got["A"]["momentum_12m"] == pytest.approx((1 / 0.9**12 - 1) * 100)
    assert got["A"]["trajectory"] == "stable" and got["A"]["consistency_score"] == 1.0
    assert (got["B"]["momentum_6m"], got["B"]["trajectory"], got["B"]["consistency_score"]) == (0.0, "stable", 1.0)
    assert (got["C"]["momentum_3m"], got["C"]["trajectory"], got["C"]["consistency_score"]) == (None, "stable", 0.0)
    assert (got["D"]["current_avg_price"], got["D"]["trajectory"]) == (0.0, "stable")
    # A gap shifts "three months ago" by row, not by calendar.
    assert got["E"]["momentum_3m"] == pytest.approx((110 - 90) / 90 * 100)
    by_calendar = trends.price_momentum(frame(spark, rows), ["area_name_en"], AS_OF, align="calendar").where("area_name_en = 'E'").first()
    assert by_calendar["momentum_3m"] == pytest.approx(10.0)


def test_volume_trend(spark):
    rows = []
    for scope, counts in (("up", (12, 10, 10, 10)), ("down", (8, 10, 10, 10)), ("flat", (10, 10, 10, 10)), ("new", (5,))):
        for back, n in enumerate(counts):
            rows += [sale(len(rows) + i, date(2024, 6 - back, 10), scope) for i in range(n)]
    got = {r["area_name_en"]: (r["volume_trend"], r["current_monthly_volume"]) for r in trends.volume_momentum(frame(spark, rows), ["area_name_en"], AS_OF).collect()}
    assert got == {"up": ("increasing", 12), "down": ("decreasing", 8), "flat": ("stable", 10), "new": ("insufficient_data", 0)}


def test_running_months_and_quarters_do_not_count(spark):
    daily = frame(spark, [sale(i, date(2022, 12, 1) + timedelta(days=i), "A", 100.0) for i in range(740)])
    for as_of in (date(2024, 10, 20), date(2024, 12, 9)):
        volume = trends.volume_momentum(daily, ["area_name_en"], as_of).first()
        assert volume["volume_trend"] == "stable" and abs(volume["volume_3m_change"]) < 5
        assert abs(trends.market_cycle(daily, ["area_name_en"], as_of).first()["recent_volume_trend_qoq"]) < 3
        season = trends.seasonality(daily, ["area_name_en"], date(2023, 1, 1), as_of).first()
        assert season["peak_vs_low_ratio"] < 1.1 and season["current_month_position"] == "normal"
    cut = trends.volume_momentum(daily, ["area_name_en"], date(2024, 12, 9), whole=False).first()
    assert cut["volume_trend"] == "decreasing"
    assert trends.last_whole_end(date(2024, 6, 30)) == date(2024, 7, 1) and trends.last_whole_end(date(2024, 6, 29)) == date(2024, 6, 1)
    assert trends.last_whole_end(date(2024, 12, 31), 3) == date(2025, 1, 1) and trends.last_whole_end(date(2024, 2, 29), 3) == date(2024, 1, 1)


def test_cycle_phases(spark):
    cases = {
        "growth": [(121, 30), (110, 25), (100, 20), (100, 20)], "peak": [(110, 16), (105, 18), (100, 20), (99, 20)],
        "correction": [(90, 20), (95, 20), (100, 20), (110, 20)], "recovery": [(101, 30), (100.5, 25), (100, 20), (101, 20)],
        "stable": [(100, 20), (100, 20), (100, 20), (100, 20)], "short": [(120, 30), (100, 10)],
    }
    rows = []
    for scope, quarters in cases.items():
        for back, (price, n) in enumerate(quarters):
            index = 2024 * 4 + 1 - back
            rows += [sale(len(rows) + i, date(index // 4, index % 4 * 3 + 1, 20), scope, price) for i in range(n)]
    got = {r["area_name_en"]: r for r in trends.market_cycle(frame(spark, rows), ["area_name_en"], AS_OF).collect()}
    assert {k: r["phase"] for k, r in got.items()} == {k: (k if k != "short" else "stable") for k in cases}
    assert (got["short"]["phase_confidence"], got["short"]["phase_duration_months"]) == (0.3, 0)
    assert (got["growth"]["phase_confidence"], got["growth"]["phase_duration_months"]) == (pytest.approx(0.9 if 0.5 + 0.1 + 0.225 > 0.9 else 0.825), 6)
    assert got["correction"]["phase_duration_months"] == 9 and got["stable"]["phase_duration_months"] == 3


def test_seasonality_falls_back_on_little_data(spark):
    rows = [sale(i, date(2024, 1 + i % 3, 3)) for i in range(9)]
    row = trends.seasonality(frame(spark, rows), ["area_name_en"], date(2023, 1, 1), AS_OF).first()
    assert (row["peak_months"], row["low_months"], row["peak_vs_low_ratio"], row["current_month_position"]) == ("March, October", "July, August", 1.3, "normal")


# Known growth figures.
@pytest.mark.parametrize(("base", "value", "growth"), [
    (0, 100, 999999.0), (0, 0, 0.0), (100, 150, 50.0), (100, 50, -50.0), (100, 0, -100.0), (33, 595, 1703.03), (1, 2, 100.0), (100, 100, 0.0),
])
def test_growth_figures(spark, base, value, growth):
    row = spark.range(1).select(
        opportunities.marked_growth(F.lit(base), F.lit(value)), opportunities.marked_compound_growth(F.lit(base), F.lit(value), 2)
    ).first()
    assert row[0] == growth
    if base:
        assert row[1] == pytest.approx(((value / base) ** 0.5 - 1) * 100, abs=0.006)


def test_misleading_growth_is_explained(spark):
    rows = []
    for name, counts in (("solid", (60, 70, 80)), ("tiny", (5, 60, 70)), ("new", (0, 12, 12)), ("jump", (20, 70, 75))):
        for year, n in zip((2022, 2023, 2024), counts):
            rows += [sale(len(rows) + i, date(year, 5, 5), name) for i in range(n)]
    study = opportunities.growth_study(frame(spark, rows), "area_name_en", (2022, 2023, 2024))
    got = {r["name"]: r for r in opportunities.with_misleading_flags(study, (2022, 2023, 2024)).collect()}
    assert not got["solid"]["misleading_flag"] and got["solid"]["misleading_reason"] == ""
    assert got["tiny"]["misleading_reason"] == (
        "starts from 5 sales in 2022; 2023 moved by 1100.0% on a difference of 55 sales; hardly any sales: 5 in 2022"
    )
    assert got["new"]["misleading_reason"].endswith("hardly any sales: 0 in 2022; nothing sold in 2022 to grow from")
    assert got["jump"]["misleading_flag"]


def test_spikes_compare_like_with_like(spark):
    rows = [sale(i, date(2023, 1 + i % 12, 9), "A") for i in range(120)] + [sale(500 + i, date(2024, 1 + i % 3, 9), "A") for i in range(36)]
    df = frame(spark, rows)
    q1 = Period(2024, "quarterly", 1)
    fair = anomalies.activity_shift(df, "area_name_en", q1).first()
    assert fair["historical_monthly_avg"] == 10.0 and fair["change_pct"] == pytest.approx(20.0)
    assert anomalies.volume_spikes(df, q1, per_month=False).first()["change_pct"] == pytest.approx(260.0)
    assert anomalies.volume_spikes(df, q1).count() == 0
    gone = anomalies.volume_drops(df.where("transaction_year = 2023"), q1, min_baseline=5.0).first()
    assert (gone["current_count"], gone["change_pct"]) == (0, -100.0)
    cut = spark.range(1).select(anomalies.months_before(F.lit(date(2024, 3, 31)), 1)).first()[0]
    assert cut == date(2024, 2, 29)


def test_histogram_counts_every_price_once(spark):
    df = frame(spark, [sale(i, date(2024, 1, 1), price=p) for i, p in enumerate((10, 19, 20, 55, 100, 100))])
    got = charts.price_histogram(df, 9).orderBy("bin").collect()
    assert [r["tx_count"] for r in got] == [2, 1, 0, 0, 1, 0, 0, 0, 2]
    assert sum(r["tx_count"] for r in charts.price_histogram(df.where("actual_worth = 100"), 4).collect()) == 2


def test_similarity_stays_between_0_and_1(spark):
    df = spark.createDataFrame([("A", 100.0, 10, "luxury"), ("B", 100.0, 10, "luxury"), ("C", 1000.0, 500, "affordable")], "area_name_en string, avg_price double, total_transactions int, market_segment string")
    pairs = spark.createDataFrame([("A", "B"), ("C", "A")], "area_1 string, area_2 string")
    got = {r["area_1"]: r["similarity_score"] for r in profiles.compare_pairs(df, pairs).collect()}
    assert got == {"A": 1.0, "C": 0.0}
