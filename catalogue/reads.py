"""Bar reads, filters, paging and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.base import Tables, query
from catalogue.sql import B, D, S, T, U, q, qq
from tickloom.functions import clock
from tickloom.operators import bars, catalog, coverage, requestlog
from tickloom.sources import tables as table_views

BAR = f"{T('ts')}, {D('open')}, {D('high')}, {D('low')}, {D('close')}, {B('volume')}, {B('oi')}"
OUT = f"{U('ts', 'timestamp')}, {D('open')}, {D('high')}, {D('low')}, {D('close')}, {B('volume')}"


@query(
    "s1_candle_view",
    q(f"SELECT contract_id, {B('count(*)', 'n')}, {D('sum(CAST(close AS DOUBLE))', 'c')} FROM "
      "(SELECT CAST(contract_id AS BIGINT) AS contract_id, CAST(close AS BIGINT) AS close FROM candles) GROUP BY contract_id"),
)
def s1(t: Tables):
    table_views.publish_views(t.spark, candles=t.candles)
    return t.spark.sql(
        "SELECT contract_id, count(*) AS n, sum(CAST(round(close) AS DOUBLE)) AS c FROM v_candle GROUP BY contract_id"
    )


@query(
    "s17_resolutions",
    q(f"SELECT {B('res_id')}, fyers_code, {B('seconds')}, chart_interval, {B('max_days', 'max_days_per_request')}, "
      f"{B('(SELECT count(*) FROM coverage c WHERE c.res_id = r.res_id)', 'chunks')} FROM resolutions r"),
)
def s17(t: Tables):
    used = t.coverage.groupBy("res_id").agg(F.count("*").alias("chunks"))
    return t.resolutions.join(used, "res_id", "left").select(
        "res_id", "fyers_code", "seconds", "chart_interval", "max_days_per_request",
        F.coalesce("chunks", F.lit(0)).alias("chunks"),
    )


@query("f1_bars", q(f"SELECT {BAR} FROM candles WHERE contract_id = 1 AND res_id = 2 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'"))
def f1(t: Tables):
    return bars.window(t.candles, 1, 2, "2024-01-05 00:00:00", "2024-01-20 00:00:00")


WINDOWS = """windows AS (SELECT contract_id AS request_id, contract_id, first_ts + INTERVAL 1 DAY AS start_ts,
  last_ts - INTERVAL 1 DAY AS end_ts FROM bounds)"""


def life_windows(t: Tables):
    """A window per series: its life without the first and last day."""
    return t.bounds.select(
        F.col("contract_id").alias("request_id"), "contract_id", "res_id",
        F.timestamp_add("DAY", F.lit(1), "first_ts").alias("start_ts"),
        F.timestamp_add("DAY", F.lit(-1), "last_ts").alias("end_ts"),
    )


@query(
    "f1_bars_many_windows",
    qq(WINDOWS, f"SELECT {B('request_id')}, {BAR} FROM candles k JOIN windows w USING (contract_id) WHERE ts >= start_ts AND ts < end_ts"),
)
def f1_many(t: Tables):
    return bars.windows(t.candles, life_windows(t)).select(
        "request_id", "ts", "open", "high", "low", "close", "volume", "oi"
    )


@query("f2_bar_projection", q(f"SELECT {B('contract_id')}, {OUT}, {B('oi')} FROM candles"))
def f2(t: Tables):
    return bars.project(t.candles, keep=["contract_id"])


@query("f2_bar_projection_without_oi", q(f"SELECT {B('contract_id')}, {OUT} FROM candles"))
def f2b(t: Tables):
    return bars.project(t.candles, include_oi=False, keep=["contract_id"])


@query(
    "f3_clock_round_trip",
    q(f"SELECT {B('event_id')}, {U('ts', 'utc')}, {T('''date_trunc('second', ts)''', 'ist')} FROM events"),
)
def f3(t: Tables):
    ts = F.col("ts").cast("timestamp_ntz")
    return t.given("events").select(
        "event_id", clock.utc_seconds(ts).alias("utc"), clock.ist_from_utc_seconds(clock.utc_seconds(ts)).alias("ist")
    )


@query("f4_oi_series", q(f"SELECT {B('contract_id')}, {B('res_id')}, {U('ts', 'timestamp')}, {B('oi')} FROM candles WHERE oi IS NOT NULL"))
def f4(t: Tables):
    return bars.oi_points(t.candles)


# Requested windows from every event: an offset and a span around the event's own time.
ASKED = """asked AS (
  SELECT event_id AS request_id, contract_id,
         CASE WHEN event_id % 11 <> 0 THEN CAST(date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', ts)) AS BIGINT) - 19800 - 86400 * (event_id % 40) END AS from_ts,
         CASE WHEN event_id % 13 <> 0 THEN CAST(date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', ts)) AS BIGINT) - 19800 - 86400 * (event_id % 40) + 43200 * (event_id % 60) END AS to_ts
    FROM (SELECT *, user_id % 5 + 1 AS underlying_id,
                 CASE WHEN user_id < 5 THEN user_id + 1
                      ELSE (1 + 2 * (user_id % 5) + ((user_id // 5) // 2) % 2) * 1048576 + 2 * ((user_id // 5) // 4) + (user_id // 5) % 2 END AS contract_id
            FROM events)),
lim AS (SELECT contract_id, CAST(date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', first_ts)) AS BIGINT) - 19800 AS f,
               CAST(date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', last_ts)) AS BIGINT) - 19800 AS l FROM bounds),
clamped AS (
  SELECT a.*, f, l,
         CASE WHEN f IS NULL THEN from_ts WHEN from_ts IS NULL OR to_ts IS NULL THEN f WHEN to_ts < f THEN from_ts
              ELSE greatest(f, least(to_ts, l) - greatest(to_ts - from_ts, 1)) END AS cf,
         CASE WHEN f IS NULL THEN to_ts WHEN from_ts IS NULL OR to_ts IS NULL THEN l WHEN to_ts < f THEN to_ts
              ELSE least(to_ts, l) END AS ct
    FROM asked a LEFT JOIN lim USING (contract_id))"""


def asked_windows(t: Tables):
    e = F.col("event_id")
    base = clock.utc_seconds(F.col("ts").cast("timestamp_ntz")) - 86400 * (e % 40)
    return t.with_ids(t.given("events")).select(
        e.alias("request_id"), "contract_id", F.lit(2).cast("smallint").alias("res_id"),
        F.when(e % 11 != 0, base).alias("from_ts"),
        F.when(e % 13 != 0, base + 43200 * (e % 60)).alias("to_ts"),
    )


@query(
    "f5_window_clamp",
    qq(ASKED, f"""SELECT {B('request_id')}, {B('contract_id')}, {B('cf', 'from_ts')}, {B('ct', 'to_ts')},
      CAST(CASE WHEN f IS NULL THEN 0 WHEN from_ts IS NULL OR to_ts IS NULL THEN CAST(from_ts IS NOT NULL OR to_ts IS NOT NULL AS INT)
           WHEN to_ts < f THEN 0 ELSE CAST(cf <> from_ts OR ct <> to_ts AS INT) END AS BIGINT) AS clamped FROM clamped"""),
)
def f5(t: Tables):
    return bars.clamp(asked_windows(t), t.bounds).drop("res_id")


@query(
    "f6_range_cap",
    qq(WINDOWS, f"""SELECT {B('request_id')}, {B('count(k.ts)', 'available')}, {B('CAST(count(k.ts) > 60 AS INT)', 'too_large')}
      FROM windows w LEFT JOIN candles k ON k.contract_id = w.contract_id AND ts >= start_ts AND ts < end_ts GROUP BY request_id"""),
)
def f6(t: Tables):
    return bars.range_cap(t.candles, life_windows(t), maximum=60)


CONTRACT_COLUMNS = ["contract_id", "fyers_symbol", "kind", "expiry_date", "strike", "option_type", "rows"]
CONTRACT_SQL = f"{B('contract_id')}, fyers_symbol, kind, {S('expiry_date')}, {D('strike')}, option_type, {B('coalesce(row_count, 0)', 'rows')}"


@query(
    "f7_contract_filter",
    q(f"""SELECT {CONTRACT_SQL} FROM contracts c LEFT JOIN bounds b USING (contract_id)
      WHERE kind <> 'SPOT' AND underlying_id = 2 AND expiry_date >= DATE '2024-01-01' AND kind = 'OPT' AND option_type = 'CE'
        AND strike >= 15 AND strike <= 700 AND contains(upper(fyers_symbol), 'BETA') AND sealed_at IS NULL AND coalesce(row_count, 0) > 0"""),
)
def f7(t: Tables):
    listed = catalog.contracts_with_rows(t.contracts, t.bounds)
    wanted = catalog.contract_filter(
        underlying_id=2, expiry_from="2024-01-01", kind="OPT", option_type="CE", strike_min="15",
        strike_max="700", symbol_contains="beta", sealed=False, has_data=True,
    )
    return listed.where(wanted).select(*CONTRACT_COLUMNS)


@query(
    "f8_resolution_resolve",
    q(f"""SELECT {B('event_id')}, {B('r.res_id', 'res_id')}, r.fyers_code FROM
      (SELECT event_id, ['1','5s','','D','nope'][event_id % 5 + 1] AS code, ['1m','D','M','15m','m','h'][event_id % 6 + 1] AS interval FROM events) a
      LEFT JOIN resolutions r ON CASE WHEN code <> '' THEN upper(r.fyers_code) = upper(code)
         ELSE interval <> 'M' AND lower(r.chart_interval) = CASE WHEN lower(interval) IN ('s','m','h','d','w') THEN '1' || lower(interval) ELSE lower(interval) END END"""),
)
def f8(t: Tables):
    e = F.col("event_id")
    asked = t.given("events").select(
        "event_id",
        F.element_at(F.array(*[F.lit(x) for x in ("1", "5s", "", "D", "nope")]), (e % 5 + 1).cast("int")).alias("code"),
        F.element_at(F.array(*[F.lit(x) for x in ("1m", "D", "M", "15m", "m", "h")]), (e % 6 + 1).cast("int")).alias("interval"),
    )
    known, unknown = bars.resolve_resolutions(asked, t.resolutions)
    return known.select("event_id", "res_id", "fyers_code").unionByName(
        unknown.select("event_id"), allowMissingColumns=True
    )


@query(
    "f10_underlying_search",
    qq("hit AS (SELECT fytoken FROM history WHERE valid_to IS NULL AND segment_code = 10 AND contains(upper(symbol_ticker), 'NATION_1'))",
       f"""SELECT root, {B('10', 'exchange_code')}, under_fytoken, cash_ticker, {B('contract_count')}, {B('match_rank')} FROM (
      SELECT g.under_symbol AS root, g.under_fytoken, g.contract_count, c.symbol_ticker AS cash_ticker,
             CASE WHEN g.under_symbol = 'NATION_1' THEN 0 WHEN starts_with(g.under_symbol, 'NATION_1') OR ends_with(c.symbol_ticker, 'NATION_1') THEN 1 ELSE 2 END AS match_rank
        FROM (SELECT under_symbol, min(under_fytoken) AS under_fytoken, count(*) AS contract_count FROM history
               WHERE valid_to IS NULL AND segment_code = 11
                 AND (contains(upper(under_symbol), 'NATION_1') OR under_fytoken IN (SELECT fytoken FROM hit)) GROUP BY under_symbol) g
        LEFT JOIN (SELECT * FROM history WHERE valid_to IS NULL AND segment_code = 10) c ON c.fytoken = g.under_fytoken)
      ORDER BY match_rank, contract_count DESC, root LIMIT 25"""),
)
def f10(t: Tables):
    return catalog.search_underlyings(t.master_history, "NSE:nation_1", [10, 12], 25)


@query(
    "f11_request_filter",
    q(f"SELECT {B('task_id')}, kind, state, {T('created_at')} FROM request_log WHERE created_at >= TIMESTAMP '2024-01-05' AND kind = 'click' AND state = 'done' ORDER BY request_log.created_at DESC, task_id DESC LIMIT 100"),
)
def f11(t: Tables):
    return requestlog.recent(t.request_log, "2024-01-05 00:00:00", "click", "done", 100).select(
        "task_id", "kind", "state", "created_at"
    )


@query(
    "f12_bar_hygiene",
    qq("""raw AS (SELECT user_id, event_id, floor(event_id / 3.0) AS time, CASE WHEN event_id % 17 = 0 THEN 'NaN'::DOUBLE ELSE value END AS open,
             value + 1 AS high, value - 1 AS low, CASE WHEN event_id % 19 = 0 THEN NULL ELSE value END AS close,
             CASE WHEN event_id % 4 = 0 THEN 'inf'::DOUBLE ELSE value * 2 END AS volume FROM events),
       good AS (SELECT *, row_number() OVER (PARTITION BY user_id % 3, time ORDER BY event_id DESC) AS rn FROM raw
                 WHERE NOT isnan(open) AND close IS NOT NULL)""",
       f"SELECT {B('user_id % 3', 'series')}, {B('time')}, open, high, low, close, CASE WHEN isinf(volume) THEN NULL ELSE volume END AS volume FROM good WHERE rn = 1"),
)
def f12(t: Tables):
    e, v = F.col("event_id"), F.col("value")
    raw = t.given("events").select(
        (F.col("user_id") % 3).alias("series"), e.alias("arrival"), (e / 3.0).alias("time"),
        F.when(e % 17 == 0, float("nan")).otherwise(v).alias("open"), (v + 1).alias("high"), (v - 1).alias("low"),
        F.when(e % 19 != 0, v).alias("close"), F.when(e % 4 == 0, float("inf")).otherwise(v * 2).alias("volume"),
    )
    return bars.hygiene(raw, ["series"])


@query("f13_spot_bars", q(f"SELECT {B('underlying_id')}, {OUT} FROM candles k JOIN underlyings u ON u.spot_contract_id = k.contract_id"))
def f13(t: Tables):
    return bars.project(bars.spot_series(t.candles, t.underlyings), include_oi=False, keep=["underlying_id"])


@query("t1_bars_before", q(f"SELECT {BAR} FROM candles WHERE contract_id = 2 AND ts < TIMESTAMP '2024-01-25' ORDER BY candles.ts DESC LIMIT 40"))
def t1(t: Tables):
    return bars.before(t.candles, 2, 2, "2024-01-25 00:00:00", 40)


@query(
    "t1_bars_before_each",
    q(f"""SELECT {B('contract_id', 'request_id')}, {T('ts')}, {D('close')} FROM
      (SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY ts DESC) AS rn FROM candles WHERE ts < TIMESTAMP '2024-01-25') WHERE rn <= 20"""),
)
def t1_each(t: Tables):
    asks = t.bounds.select(
        F.col("contract_id").alias("request_id"), "contract_id", "res_id", clock.ntz("2024-01-25 00:00:00").alias("before_ts")
    )
    return bars.before_each(t.candles, asks, 20).select("request_id", "ts", "close")


@query(
    "t2_contract_page",
    q(f"""SELECT * EXCLUDE (rn, total), CAST(total > 15 AS BIGINT) AS has_more FROM (
      SELECT {CONTRACT_SQL}, row_number() OVER (ORDER BY c.strike NULLS LAST, c.contract_id) AS rn, count(*) OVER () AS total
        FROM contracts c LEFT JOIN bounds b USING (contract_id)
       WHERE kind <> 'SPOT' AND (strike > 5 OR strike IS NULL OR (strike = 5 AND contract_id > 2097152))) WHERE rn <= 15"""),
)
def t2(t: Tables):
    listed = catalog.contracts_with_rows(t.contracts, t.bounds)
    page = catalog.contract_page(listed, catalog.contract_filter(), "strike", False, ("5", 2097152), 15)
    return page.select(*CONTRACT_COLUMNS, "has_more")


@query(
    "t2_contract_page_descending",
    q(f"""SELECT * EXCLUDE (rn, total), CAST(total > 15 AS BIGINT) AS has_more FROM (
      SELECT {CONTRACT_SQL}, row_number() OVER (ORDER BY coalesce(row_count, 0) DESC, c.contract_id DESC) AS rn, count(*) OVER () AS total
        FROM contracts c LEFT JOIN bounds b USING (contract_id) WHERE kind <> 'SPOT') WHERE rn <= 15"""),
)
def t2d(t: Tables):
    listed = catalog.contracts_with_rows(t.contracts, t.bounds)
    page = catalog.contract_page(listed, catalog.contract_filter(), "rows", True, None, 15)
    return page.select(*CONTRACT_COLUMNS, "has_more")


@query(
    "t3_expiry_page",
    q(f"""SELECT {B('expiry_id')}, {S('expiry_date')}, {B('contract_count')}, CAST(count(*) OVER () > 1 AS BIGINT) AS has_more
      FROM expiries WHERE underlying_id = 3 AND expiry_date > DATE '2024-01-01' QUALIFY row_number() OVER (ORDER BY expiries.expiry_date) <= 1"""),
)
def t3(t: Tables):
    page = catalog.expiry_page(t.expiries, 3, after="2024-01-01", limit=1)
    return page.select("expiry_id", "expiry_date", "contract_count", "has_more")


@query(
    "t4_expiry_contracts",
    q(f"""SELECT {CONTRACT_SQL} FROM contracts c LEFT JOIN bounds b USING (contract_id)
      WHERE kind <> 'SPOT' AND underlying_id = 1 AND expiry_date = DATE '2024-01-25' ORDER BY c.strike NULLS LAST, c.contract_id LIMIT 500"""),
)
def t4(t: Tables):
    listed = catalog.contracts_with_rows(t.contracts, t.bounds)
    wanted = catalog.contract_filter(underlying_id=1, expiry_from="2024-01-25", expiry_to="2024-01-25")
    return catalog.contract_page(listed, wanted, "strike", limit=500).select(*CONTRACT_COLUMNS)


@query(
    "t5_latest_expiries",
    q(f"""SELECT {B('underlying_id')}, {S('expiry_date')} FROM expiries WHERE contracts_discovered_at IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY underlying_id ORDER BY expiries.expiry_date DESC) <= 1"""),
)
def t5(t: Tables):
    return catalog.latest_expiries(t.expiries, 1, discovered=True).select("underlying_id", "expiry_date")


@query(
    "t7_id_order",
    q(f"""SELECT {B('contract_id')}, {B('''row_number() OVER (PARTITION BY underlying_id, expiry_date ORDER BY
        CASE kind WHEN 'FUT' THEN 0 WHEN 'OPT' THEN 1 ELSE 2 END, coalesce(strike, 0), CASE option_type WHEN 'CE' THEN 0 WHEN 'PE' THEN 1 ELSE 2 END,
        instrument_class, fyers_symbol)''', 'nth')} FROM contracts"""),
)
def t7(t: Tables):
    from pyspark.sql import Window

    c = t.contracts
    order = Window.partitionBy("underlying_id", "expiry_date").orderBy(*catalog.in_id_order(c))
    return c.select("contract_id", F.row_number().over(order).alias("nth"))


@query(
    "j10_contracts_full",
    q(f"""SELECT {B('contract_id')}, c.fyers_symbol, u.fyers_symbol AS underlying_symbol, display_name AS underlying_name,
      u.instrument_kind AS underlying_kind, {B('contract_id_lo')}, {B('contract_id_hi')}, {B('options_count')}
      FROM contracts c JOIN underlyings u USING (underlying_id) LEFT JOIN expiries e ON e.expiry_id = c.expiry_id"""),
)
def j10(t: Tables):
    full = catalog.contracts_full(
        t.contracts, t.underlyings, t.expiries
    )
    return full.select(
        "contract_id", "fyers_symbol", "underlying_symbol", "underlying_name", "underlying_kind",
        "contract_id_lo", "contract_id_hi", "options_count",
    )


@query(
    "a5_expiry_listing",
    q(f"""SELECT {B('e.expiry_id', 'expiry_id')}, {S('e.expiry_date', 'expiry_date')},
      {B('coalesce(contracts_with_data, 0)', 'contracts_with_data')}, {B('coalesce(contracts_sealed, 0)', 'contracts_sealed')},
      {B('coalesce(ok, 0)', 'chunks_ok')}, {B('coalesce(empty, 0)', 'chunks_empty')}, {B('coalesce(error, 0)', 'chunks_error')}, {B('coalesce(rows, 0)', 'rows')}
      FROM (SELECT * FROM expiries WHERE underlying_id = 4) e
      LEFT JOIN (SELECT expiry_id, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'empty') AS empty,
                        count(*) FILTER (WHERE status = 'error') AS error, sum(row_count) AS rows
                   FROM coverage JOIN contracts USING (contract_id) GROUP BY expiry_id) v ON v.expiry_id = e.expiry_id
      LEFT JOIN (SELECT expiry_id, count(DISTINCT contract_id) AS contracts_with_data FROM bounds JOIN contracts USING (contract_id) GROUP BY expiry_id) h ON h.expiry_id = e.expiry_id
      LEFT JOIN (SELECT expiry_id, count(*) AS contracts_sealed FROM contracts WHERE sealed_at IS NOT NULL GROUP BY expiry_id) s ON s.expiry_id = e.expiry_id"""),
)
def a5(t: Tables):
    page = catalog.expiry_page(t.expiries, 4)
    listing = catalog.expiry_listing(page, t.contracts, t.coverage, t.bounds)
    return listing.select(
        "expiry_id", "expiry_date", "contracts_with_data", "contracts_sealed", "chunks_ok", "chunks_empty", "chunks_error", "rows"
    )


@query(
    "a6_underlying_listing",
    q(f"""SELECT {B('u.underlying_id', 'underlying_id')}, u.fyers_symbol, {B('coalesce(row_count, 0)', 'spot_bars')}, {T('last_ts', 'spot_last_ts')},
      {S('first_expiry')}, {S('last_expiry')}, {B('expiry_count')}, {B('contract_count')}
      FROM underlyings u LEFT JOIN bounds b ON b.contract_id = u.spot_contract_id
      LEFT JOIN (SELECT underlying_id, min(expiry_date) AS first_expiry, max(expiry_date) AS last_expiry, count(*) AS expiry_count,
                        sum(contract_count) AS contract_count FROM expiries GROUP BY underlying_id) e USING (underlying_id)"""),
)
def a6(t: Tables):
    return catalog.underlying_listing(t.underlyings, t.bounds, t.expiries).select(
        "underlying_id", "fyers_symbol", "spot_bars", "spot_last_ts", "first_expiry", "last_expiry", "expiry_count", "contract_count"
    )


@query(
    "a7_contract_detail",
    q(f"""SELECT {B('c.contract_id', 'contract_id')}, {B('v.res_id', 'res_id')}, {B('count(*)', 'chunks')}, {B('''count(*) FILTER (WHERE status = 'ok')''', 'chunks_ok')},
      {S('min(range_from)', 'have_from')}, {S('max(range_to)', 'have_to')}, {B('sum(v.row_count)', 'rows')}, {B('any_value(b.row_count)', 'bars_held')}
      FROM contracts c JOIN coverage v USING (contract_id) LEFT JOIN bounds b ON b.contract_id = c.contract_id GROUP BY c.contract_id, v.res_id"""),
)
def a7(t: Tables):
    detail = catalog.contract_detail(t.contracts, t.bounds, t.coverage, t.resolutions)
    return detail.select(
        "contract_id", F.try_element_at("resolutions", F.lit(1))["rows"].alias("bars_held"), F.inline("coverage")
    ).drop("chunks_empty", "chunks_error")


@query(
    "u2_expiries_with_holes",
    q(f"""SELECT {B('underlying_id')}, {S('expiry_date')} FROM (
      SELECT underlying_id, expiry_date FROM coverage JOIN contracts USING (contract_id) WHERE status = 'error' AND expiry_date IS NOT NULL
      UNION SELECT underlying_id, expiry_date FROM gaps JOIN contracts USING (contract_id) WHERE expiry_date IS NOT NULL)"""),
)
def u2(t: Tables):
    return coverage.expiries_with_holes(t.coverage, t.contracts)


@query(
    "f13_point_lookups",
    q(f"SELECT {B('underlying_id')}, fyers_symbol, {B('spot_contract_id')} FROM underlyings WHERE underlying_id = 3"),
)
def f13_lookup(t: Tables):
    return t.underlyings.where("underlying_id = 3").select("underlying_id", "fyers_symbol", "spot_contract_id")

