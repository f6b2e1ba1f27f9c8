"""Range arithmetic and the trading calendar."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.base import Tables, query
from catalogue.sql import B, S, q, qq
from tickloom.functions import clock
from tickloom.operators import calendar, coverage, intervals

SERIES_SQL = f"{B('contract_id')}, {B('res_id')}"


@query(
    "i1_coverage_gaps",
    q(f"SELECT {B('contract_id')}, {B('res_id')}, {S('gap_after')}, {S('gap_before')}, fyers_symbol, {S('expiry_date')}, {B('underlying_id')} FROM gaps JOIN contracts USING (contract_id)"),
)
def i1(t: Tables):
    return coverage.gaps(t.coverage, t.contracts)


@query(
    "i2_gap_detail",
    q(f"SELECT {SERIES_SQL}, {S('gap_after')}, {S('gap_before')}, {S('gap_after + 1', 'gap_from')}, {S('gap_before - 1', 'gap_to')}, {B('gap_before - gap_after - 1', 'missing_days')} FROM gaps"),
)
def i2(t: Tables):
    return intervals.gap_detail(intervals.gaps_after(t.coverage))


@query("i3_merge_ranges", q(f"SELECT {SERIES_SQL}, {S('range_from')}, {S('range_to')} FROM islands"))
def i3(t: Tables):
    return intervals.merge(intervals.held(t.coverage))


# Every order wants the 300 days from its own date; the oracle marks single days.
WANTS = """wants AS (SELECT o_orderkey AS want_id, CASE WHEN u < 5 THEN u + 1 ELSE (1 + 2 * (u % 5) + ((u // 5) // 2) % 2) * 1048576 + 2 * ((u // 5) // 4) + (u // 5) % 2 END AS contract_id,
    CAST(o_orderpriority[1] AS INT) + 1 AS res_id, CAST(o_orderdate AS DATE) + 8766 - 30 AS want_from, CAST(o_orderdate AS DATE) + 8766 + 270 AS want_to
    FROM (SELECT *, o_custkey // 10 AS u FROM orders)),
met AS (SELECT w.*, i.range_from AS f, i.range_to AS e FROM wants w LEFT JOIN islands i ON i.contract_id = w.contract_id AND i.res_id = w.res_id AND i.range_from <= want_to AND i.range_to >= want_from),
edged AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY want_id ORDER BY f) + 1, want_from) AS prev, lead(f) OVER (PARTITION BY want_id ORDER BY f) IS NULL AS is_last FROM met),
gap AS (SELECT want_id, contract_id, res_id, prev AS gap_from, CASE WHEN f IS NULL THEN want_to ELSE f - 1 END AS gap_to FROM edged
        UNION ALL SELECT want_id, contract_id, res_id, e + 1, want_to FROM edged WHERE is_last AND f IS NOT NULL),
missing AS (SELECT * FROM gap WHERE gap_from <= gap_to)"""


def wants(t: Tables):
    o = t.with_ids(t.given("orders").withColumn("user_id", F.floor(F.col("o_custkey") / 10)))
    start = F.date_add(F.to_date("o_orderdate"), 8766)
    return o.select(
        F.col("o_orderkey").alias("want_id"), "contract_id",
        (F.substring("o_orderpriority", 1, 1).cast("smallint") + 1).cast("smallint").alias("res_id"),
        F.date_sub(start, 30).alias("want_from"), F.date_add(start, 270).alias("want_to"),
    )


def missing(t: Tables):
    return intervals.missing(wants(t), intervals.held(t.coverage))


@query("i4_missing_windows", qq(WANTS, f"SELECT {B('want_id')}, {SERIES_SQL}, {S('gap_from')}, {S('gap_to')} FROM missing"))
def i4(t: Tables):
    return missing(t).drop("want_from", "want_to")


@query(
    "i4_missing_days",
    qq(WANTS.split("met AS")[0].rstrip().rstrip(",") + """, day AS (SELECT want_id, contract_id, res_id, unnest(generate_series(want_from, want_to, INTERVAL 1 DAY))::DATE AS d FROM wants),
      covered AS (SELECT DISTINCT contract_id, res_id, unnest(generate_series(range_from, range_to, INTERVAL 1 DAY))::DATE AS d FROM held)""",
       f"SELECT {B('want_id')}, {B('count(*)', 'days_missing')} FROM day ANTI JOIN covered USING (contract_id, res_id, d) GROUP BY want_id"),
)
def i4_days(t: Tables):
    gaps = missing(t).withColumn("n", clock.span_days(F.col("gap_from"), F.col("gap_to")))
    return gaps.groupBy("want_id").agg(F.sum("n").alias("days_missing"))


@query(
    "i5_split_windows",
    qq(WANTS, f"""SELECT {B('want_id')}, {S('gap_from + n * 100', 'piece_from')}, {S('least(gap_from + n * 100 + 99, gap_to)', 'piece_to')}, {B('n', 'ordinal')}
      FROM (SELECT *, unnest(range(0, (gap_to - gap_from) // 100 + 1))::INT AS n FROM missing)"""),
)
def i5(t: Tables):
    return intervals.split(missing(t), 100).select(
        "want_id", F.col("gap_from").alias("piece_from"), F.col("gap_to").alias("piece_to"), "ordinal"
    )


@query(
    "i6_chunks_newest_first",
    q(f"""SELECT {SERIES_SQL}, {B('n', 'ordinal')}, {S('greatest(range_from, range_to - n * 30 - 29)', 'chunk_from')}, {S('range_to - n * 30', 'chunk_to')}
      FROM (SELECT *, unnest(range(0, (range_to - range_from) // 30 + 1))::INT AS n FROM islands)"""),
)
def i6(t: Tables):
    return intervals.chunks_newest_first(intervals.merge(intervals.held(t.coverage)), F.lit(30))


@query("i7_held_ranges", q(f"SELECT {SERIES_SQL}, {S('range_from')}, {S('range_to')}, status, {B('row_count')} FROM coverage WHERE status IN ('ok', 'empty')"))
def i7(t: Tables):
    return intervals.held(t.coverage).drop("payload_sha256")


@query(
    "i8_last_expiry_of_month",
    qq("ed AS (SELECT DISTINCT o_custkey AS underlying_id, CAST(o_orderdate AS DATE) AS expiry_date FROM orders)",
       f"""SELECT {B('underlying_id')}, {S('expiry_date')}, {B('CAST(expiry_date = m AS INT)', 'is_last_of_month')}, CASE WHEN expiry_date = m THEN 'M' ELSE 'W' END AS expiry_cycle_derived,
      'derived' AS expiry_cycle_source FROM (SELECT *, max(expiry_date) OVER (PARTITION BY underlying_id, date_trunc('month', expiry_date)) AS m FROM ed)"""),
)
def i8(t: Tables):
    dates = t.given("orders").select(F.col("o_custkey").alias("underlying_id"), F.to_date("o_orderdate").alias("expiry_date")).distinct()
    return intervals.last_of_month(dates)


@query(
    "i11_contained_in_row",
    qq(WANTS, f"SELECT {B('want_id')} FROM wants w WHERE EXISTS (SELECT 1 FROM held h WHERE h.contract_id = w.contract_id AND h.res_id = w.res_id AND h.range_from <= want_from + 25 AND h.range_to >= want_from + 60)"),
)
def i11(t: Tables):
    asked = wants(t).withColumns({"a": F.date_add("want_from", 25), "b": F.date_add("want_from", 60)})
    return intervals.contained_in(asked, intervals.held(t.coverage), "a", "b").select("want_id")


@query(
    "i11_contained_in_merged",
    qq(WANTS, f"SELECT {B('want_id')} FROM wants w WHERE NOT EXISTS (SELECT 1 FROM islands h WHERE h.contract_id = w.contract_id AND h.res_id = w.res_id AND h.range_from <= want_from + 25 AND h.range_to >= want_from + 60)"),
)
def i11m(t: Tables):
    asked = wants(t).withColumns({"a": F.date_add("want_from", 25), "b": F.date_add("want_from", 60)})
    merged = intervals.merge(intervals.held(t.coverage))
    return intervals.contained_in(asked, merged, "a", "b", how="left_anti").select("want_id")


# -- calendar ---------------------------------------------------------------------------------------


@query("c1_trading_calendar", q(f"SELECT exchange, {S('trade_date')}, {B('CAST(is_observed AS INT)', 'is_observed')}, {B('CAST(is_trading AS INT)', 'is_trading')} FROM days"))
def c1(t: Tables):
    return t.days


# A few reach outside the day table, before it and after it.
SPANS = """spans AS (SELECT o_orderkey, exchange, a, b, CASE WHEN a < DATE '2018-01-01' OR b > DATE '2026-12-31' THEN 'day_not_in_calendar' END AS why FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'NSE' ELSE 'BSE' END AS exchange,
    DATE '2022-01-01' + CAST(o_orderkey % 700 + far AS INT) AS a, DATE '2022-01-01' + CAST(o_orderkey % 700 + far + o_custkey % 90 AS INT) AS b
  FROM (SELECT *, CASE o_orderkey % 97 WHEN 0 THEN -6000 WHEN 1 THEN 6000 ELSE 0 END AS far FROM orders)))"""


def spans(t: Tables):
    k = F.col("o_orderkey")
    far = F.when(k % 97 == 0, -6000).when(k % 97 == 1, 6000).otherwise(0)
    start = F.date_add(clock.day("2022-01-01"), (k % 700 + far).cast("int"))
    return t.given("orders").select(
        k, F.when(k % 2 == 0, "NSE").otherwise("BSE").alias("exchange"), start.alias("day_from"),
        F.date_add(start, (F.col("o_custkey") % 90).cast("int")).alias("day_to"),
    )


@query(
    "c2_count_trading_days",
    qq(SPANS, f"SELECT {B('o_orderkey')}, {B('CASE WHEN why IS NULL THEN (SELECT count(*) FROM days d WHERE d.exchange = s.exchange AND d.is_trading AND d.trade_date BETWEEN a AND b) END', 'trading_days')}, why AS calendar_reason FROM spans s"),
)
def c2(t: Tables):
    return calendar.count_between(spans(t), t.days).select("o_orderkey", "trading_days", "calendar_reason")


SHIFTS = f"""{SPANS}, td AS (SELECT exchange, trade_date, row_number() OVER (PARTITION BY exchange ORDER BY trade_date) AS o FROM days WHERE is_trading),
upto AS (SELECT d.exchange, d.trade_date AS a, sum(CAST(d.is_trading AS INT)) OVER (PARTITION BY d.exchange ORDER BY d.trade_date) AS u, d.is_trading FROM days d),
placed AS (SELECT s.o_orderkey, s.exchange, s.a, o_orderkey % 11 - 5 AS n, u, is_trading FROM spans s LEFT JOIN upto USING (exchange, a))"""


@query(
    "c3_shift_trading_days",
    qq(SHIFTS, f"""SELECT {B('o_orderkey')}, {B('n')}, {S('CASE WHEN n = 0 THEN a ELSE trade_date END', 'shifted')}, CASE WHEN u IS NULL THEN 'day_not_in_calendar' END AS calendar_reason FROM placed p
      LEFT JOIN td ON td.exchange = p.exchange AND td.o = CASE WHEN n > 0 THEN u + n WHEN is_trading THEN u + n ELSE u + n + 1 END"""),
)
def c3(t: Tables):
    asked = spans(t).withColumnRenamed("day_from", "day").withColumn("n", F.col("o_orderkey") % 11 - 5)
    return calendar.shift(asked, t.days, F.col("n")).select("o_orderkey", "n", "shifted", "calendar_reason")


@query(
    "c3_next_inclusive",
    qq(SPANS, f"SELECT {B('o_orderkey')}, {S('CASE WHEN a BETWEEN (SELECT min(trade_date) FROM days) AND (SELECT max(trade_date) FROM days) THEN (SELECT min(trade_date) FROM days d WHERE d.exchange = s.exchange AND is_trading AND trade_date >= a) END', 'nxt')}, {S('CASE WHEN a BETWEEN (SELECT min(trade_date) FROM days) AND (SELECT max(trade_date) FROM days) THEN (SELECT max(trade_date) FROM days d WHERE d.exchange = s.exchange AND is_trading AND trade_date <= a) END', 'prv')} FROM spans s"),
)
def c3i(t: Tables):
    asked = spans(t).withColumnRenamed("day_from", "day").select("o_orderkey", "exchange", "day")
    nxt = calendar.shift(asked, t.days, F.lit(1), inclusive=True).withColumnRenamed("shifted", "nxt")
    return calendar.shift(nxt, t.days, F.lit(-1), inclusive=True).select("o_orderkey", "nxt", F.col("shifted").alias("prv"))


@query(
    "c4_seconds_window",
    q(f"""SELECT exchange, {S('min(trade_date)', 'window_from')}, {S('max(trade_date)', 'window_to')} FROM (
      SELECT *, row_number() OVER (PARTITION BY exchange ORDER BY trade_date DESC) AS r FROM days WHERE is_trading AND trade_date <= DATE '2024-01-28') WHERE r <= 30 GROUP BY exchange"""),
)
def c4(t: Tables):
    return calendar.seconds_window(t.days, "2024-01-28")


@query(
    "c5_day_bounds_and_floors",
    qq(SPANS, f"""SELECT {B('o_orderkey')}, {B('epoch(CAST(a AS TIMESTAMP)) - 19800', 'start_utc')}, {B('epoch(CAST(a AS TIMESTAMP)) - 19800 + 86400', 'end_utc')},
      {S('''greatest(a, CASE exchange WHEN 'BSE' THEN DATE '2023-08-07' ELSE DATE '2022-01-03' END)''', 'clamped')},
      strftime(CAST(a AS TIMESTAMP) - INTERVAL 900 SECOND, '%Y-%m-%d %H:%M:%S.%f') AS cutoff FROM spans"""),
)
def c5(t: Tables):
    start, end = calendar.day_bounds_utc(F.col("day_from"))
    return spans(t).select(
        "o_orderkey", start.alias("start_utc"), end.alias("end_utc"),
        calendar.clamp_to_floor(F.col("exchange"), F.col("day_from")).alias("clamped"),
        calendar.partial_cutoff(clock.midnight(F.col("day_from")), F.lit(900)).alias("cutoff"),
    )
