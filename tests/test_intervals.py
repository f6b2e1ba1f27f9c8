from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tickloom.operators import calendar, intervals

D0 = date(2024, 1, 1)
RANGES = "contract_id int, res_id int, range_from date, range_to date"


def day(n):
    return D0 + timedelta(days=n)


def random_ranges(seed, series=6, hot=0):
    """Ranges of several series; series 0 may hold most of them."""
    rng = random.Random(seed)
    rows = []
    for s in [*range(series), *([0] * hot)]:
        for _ in range(rng.randint(0, 6)):
            a = rng.randint(0, 120)
            rows.append((s, 2, day(a), day(a + rng.randint(0, 15))))
    return rows


def days_of(rows):
    held = {}
    for c, r, a, b, *_ in rows:
        held.setdefault((c, r), set()).update(a + timedelta(days=i) for i in range((b - a).days + 1))
    return held


def test_merge_covers_the_same_days_with_disjoint_untouching_ranges(spark):
    rows = random_ranges(1, hot=30)
    merged = [tuple(r) for r in intervals.merge(spark.createDataFrame(rows, RANGES)).select("contract_id", "res_id", "range_from", "range_to").collect()]
    assert days_of(merged) == days_of(rows)
    by_series = {}
    for c, r, a, b in sorted(merged):
        if (c, r) in by_series:
            assert a > by_series[c, r] + timedelta(days=1)
        by_series[c, r] = b
    again = intervals.merge(spark.createDataFrame(merged, RANGES))
    assert sorted(map(tuple, again.select("contract_id", "res_id", "range_from", "range_to").collect())) == sorted(merged)


def test_missing_and_held_make_up_what_was_wanted(spark):
    rows = random_ranges(2)
    wants = [(i, s, 2, day(10 * i - 20), day(10 * i + 30)) for i in range(12) for s in range(8)]
    wants = [(n, *w[1:]) for n, w in enumerate(wants)]
    got = intervals.missing(
        spark.createDataFrame(wants, "want_id int, contract_id int, res_id int, want_from date, want_to date"),
        spark.createDataFrame(rows, RANGES),
    ).collect()
    gaps = {}
    for r in got:
        new = {r.gap_from + timedelta(days=i) for i in range((r.gap_to - r.gap_from).days + 1)}
        assert not gaps.setdefault(r.want_id, set()) & new
        gaps[r.want_id] |= new
    held = days_of(rows)
    for w, s, res, a, b in wants:
        asked = {a + timedelta(days=i) for i in range((b - a).days + 1)}
        assert gaps.get(w, set()) == asked - held.get((s, res), set())


def series_with_many_ranges():
    """A series of 2,000 short ranges and one of long ones, asked for over many bins of the calendar."""
    rng = random.Random(9)
    hot = [(0, 2, day(3 * i), day(3 * i + rng.randint(0, 1))) for i in range(2000)]
    long = [(1, 2, day(a), day(a + rng.randint(60, 400))) for a in range(-300, 6000, 530)]
    wants = [(n, n % 3, 2, day(a), day(a + rng.choice([0, 1, 30, 63, 64, 65, 700]))) for n, a in enumerate(rng.sample(range(-400, 6200), 300))]
    return hot + long, wants


WANTS = "want_id int, contract_id int, res_id int, want_from date, want_to date"


def test_ranges_are_met_in_bins_of_the_calendar(spark):
    rows, wants = series_with_many_ranges()
    held = days_of(rows)
    df = intervals.missing(spark.createDataFrame(wants, WANTS), spark.createDataFrame(rows, RANGES))
    gaps = {}
    for r in df.collect():
        assert r.gap_from <= r.gap_to
        assert r.gap_from == r.want_from or r.gap_from - timedelta(days=1) in held[r.contract_id, 2]
        new = {r.gap_from + timedelta(days=i) for i in range((r.gap_to - r.gap_from).days + 1)}
        assert not new & gaps.setdefault(r.want_id, set())
        gaps[r.want_id] |= new
    for w, s, res, a, b in wants:
        assert gaps.get(w, set()) == {a + timedelta(days=i) for i in range((b - a).days + 1)} - held.get((s, res), set())
    plan = df._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and all("_bin" in line for line in joins)


@pytest.mark.parametrize("how", ["left_semi", "left_anti"])
def test_containment_is_looked_up_in_one_bin(spark, how):
    rows, wants = series_with_many_ranges()
    rows += [(0, 2, day(5), day(900)), (0, 2, day(5), day(7)), (0, 2, day(6), day(5000))]
    inside = {w for w, s, r, a, b in wants if any((c, q) == (s, r) and f <= a and t >= b for c, q, f, t in rows)}
    df = intervals.contained_in(spark.createDataFrame(wants, WANTS), spark.createDataFrame(rows, RANGES), "want_from", "want_to", how=how)
    got = {r.want_id for r in df.collect()}
    assert got == (inside if how == "left_semi" else {w[0] for w in wants} - inside) and df.columns == WANTS_COLUMNS


WANTS_COLUMNS = ["want_id", "contract_id", "res_id", "want_from", "want_to"]


def test_split_and_chunks_respect_the_limit(spark):
    gaps = spark.createDataFrame([(1, day(0), day(249)), (2, day(0), day(99)), (3, day(5), day(5))], "id int, gap_from date, gap_to date")
    pieces = sorted((r.id, r.gap_from, r.gap_to) for r in intervals.split(gaps, 100).collect())
    assert pieces == [(1, day(0), day(99)), (1, day(100), day(199)), (1, day(200), day(249)), (2, day(0), day(99)), (3, day(5), day(5))]
    chunks = intervals.chunks_newest_first(gaps, F.lit(100), "gap_from", "gap_to").where("id = 1").orderBy("ordinal").collect()
    assert [(r.chunk_from, r.chunk_to) for r in chunks] == [(day(150), day(249)), (day(50), day(149)), (day(0), day(49))]


def test_gap_view_looks_at_the_next_start_only(spark):
    rows = [(1, 2, day(0), day(50)), (1, 2, day(5), day(8)), (1, 2, day(20), day(60)), (2, 2, day(0), day(3)), (2, 2, day(4), day(9))]
    gaps = intervals.gap_detail(intervals.gaps_after(spark.createDataFrame(rows, RANGES))).collect()
    assert [(r.contract_id, r.gap_from, r.gap_to, r.missing_days) for r in gaps] == [(1, day(9), day(19), 11)]


def test_shifting_there_and_back_returns_to_the_same_trading_day(spark):
    exchanges = spark.createDataFrame([("NSE",)], "exchange string")
    holidays = spark.createDataFrame([("NSE", date(2024, 1, 26))], "exchange string, holiday_date date")
    observed = spark.createDataFrame([("NSE", date(2024, 1, 20))], "exchange string, trade_date date")
    days = calendar.day_table(exchanges, "2023-12-01", "2024-03-31", holidays, observed)
    trading = {r.trade_date for r in days.where("is_trading").collect()}
    assert date(2024, 1, 20) in trading and date(2024, 1, 26) not in trading and date(2024, 1, 21) not in trading
    asks = days.where("is_trading AND trade_date BETWEEN '2024-01-10' AND '2024-02-10'").select("exchange", F.col("trade_date").alias("day"))
    there = calendar.shift(asks, days, F.lit(5)).select("exchange", F.col("day").alias("start"), F.col("shifted").alias("day"))
    back = calendar.shift(there, days, F.lit(-5))
    assert back.where("NOT (start <=> shifted)").count() == 0


def test_reversed_ranges_are_refused(spark):
    rows = spark.createDataFrame([(1, 2, "2024-01-10", "2024-01-05")], "contract_id int, res_id int, a string, b string")
    ranges = rows.selectExpr("contract_id", "res_id", "cast(a as date) range_from", "cast(b as date) range_to")
    with pytest.raises(Exception, match="ends before it starts"):
        intervals.merge(ranges).collect()


def test_the_day_table_reaches_as_far_as_the_requests(spark):
    spans = spark.sql("SELECT 'NSE' AS exchange, DATE '1990-01-01' AS day_from, DATE '2040-12-31' AS day_to")
    none = spark.sql("SELECT 'NSE' AS exchange, DATE '1990-01-01' AS holiday_date, DATE '1990-01-01' AS trade_date")
    days = calendar.day_table_over(spans, none, none.limit(0))
    counted = calendar.count_between(spans, days).first()
    assert counted["trading_days"] == sum(r["is_trading"] for r in days.collect()) > 13_000 and counted["calendar_reason"] is None
    assert calendar.count_between(spans, days.where("trade_date > '2000-01-01'")).first()["calendar_reason"] == calendar.OUTSIDE
