"""As-of matches, option chains and point-in-time joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.base import EXPIRIES, Tables, query
from catalogue.sql import B, D, S, T, U, q, qq
from tickloom.functions import clock, sqltable
from tickloom.operators import asof, chain, registry, versioning
from tickloom.sources import tables as table_views

SPOT = "spot AS (SELECT underlying_id, k.ts, k.close AS spot FROM candles k JOIN underlyings u ON u.spot_contract_id = k.contract_id)"
EVERY = "asks AS (SELECT event_id, user_id % 5 + 1 AS underlying_id, ts AS at_ts FROM events)"


def every_event(t: Tables):
    """Every event asks for the spot of its underlying at its own moment."""
    return t.with_ids(t.given("events")).select(
        "event_id", "underlying_id", F.col("ts").cast("timestamp_ntz").alias("at_ts")
    )


@query(
    "j1_spot_asof",
    qq(f"{SPOT}, {EVERY}", f"""SELECT {B('event_id')}, {B('a.underlying_id', 'underlying_id')}, {T('a.at_ts', 'at_ts')}, {T('s.ts', 'spot_ts')}, {D('s.spot', 'spot')}
      FROM asks a ASOF LEFT JOIN spot s ON a.underlying_id = s.underlying_id AND a.at_ts >= s.ts"""),
)
def j1(t: Tables):
    return asof.spot_at(t.candles, t.underlyings, every_event(t), 2)


@query(
    "j1_spot_asof_strict",
    qq(f"{SPOT}, {EVERY}", f"""SELECT {B('event_id')}, {T('s.ts', 'matched_ts')}, {D('s.spot', 'spot')}
      FROM asks a ASOF LEFT JOIN spot s ON a.underlying_id = s.underlying_id AND a.at_ts > s.ts"""),
)
def j1_strict(t: Tables):
    spot = asof.spot_closes(t.candles, t.underlyings, 2)
    return asof.asof_backward(
        every_event(t), spot, ["underlying_id"], "at_ts", "ts", ["spot"], inclusive=False, bucket_seconds=3600
    ).select("event_id", "matched_ts", "spot")


@query("j1_spot_at_one", qq(SPOT, f"SELECT {T('ts')}, {D('spot', 'close')} FROM spot WHERE underlying_id = 3 AND ts <= TIMESTAMP '2024-01-17 12:00:00' ORDER BY spot.ts DESC LIMIT 1"))
def j1_one(t: Tables):
    return asof.spot_at_one(t.candles, t.underlyings, 3, 2, "2024-01-17 12:00:00")


@query(
    "j2_end_of_day_spot",
    qq(SPOT, f"""SELECT {B('e.underlying_id', 'underlying_id')}, {S('e.expiry_date', 'expiry_date')}, {D('s.spot', 'spot')}
      FROM expiries e ASOF LEFT JOIN spot s ON e.underlying_id = s.underlying_id AND CAST(e.expiry_date + 1 AS TIMESTAMP) > s.ts"""),
)
def j2(t: Tables):
    return asof.end_of_day_spot(t.candles, t.underlyings, t.expiries.select("underlying_id", "expiry_date"))


# At-the-money asks: every event, against the first expiry of its underlying.
ATM = f"""{SPOT}, {EVERY}, priced AS (
  SELECT a.event_id AS request_id, a.underlying_id, DATE '{EXPIRIES[0]}' AS expiry_date, a.at_ts, s.spot
    FROM asks a ASOF LEFT JOIN spot s ON a.underlying_id = s.underlying_id AND a.at_ts >= s.ts),
strikes AS (SELECT DISTINCT underlying_id, expiry_date, strike FROM contracts WHERE kind = 'OPT'),
near AS (SELECT p.request_id, arg_min(strike, abs(strike - CAST(spot AS DECIMAL(12,4))) * 1000000 + strike / 1000) AS atm_strike
           FROM priced p JOIN strikes USING (underlying_id, expiry_date) WHERE spot IS NOT NULL GROUP BY p.request_id),
picks AS (SELECT p.*, n.atm_strike FROM priced p LEFT JOIN near n USING (request_id))"""


def atm_asks(t: Tables):
    return every_event(t).select(
        F.col("event_id").alias("request_id"), "underlying_id", clock.day(EXPIRIES[0]).alias("expiry_date"), "at_ts"
    )


@query(
    "j3_at_the_money",
    qq(ATM, f"""SELECT {B('request_id')}, {D('spot')}, {D('atm_strike')}, {B('ce.contract_id', 'ce_contract_id')}, {B('pe.contract_id', 'pe_contract_id')}
      FROM picks p LEFT JOIN contracts ce ON ce.underlying_id = p.underlying_id AND ce.expiry_date = p.expiry_date AND ce.strike = p.atm_strike AND ce.option_type = 'CE'
      LEFT JOIN contracts pe ON pe.underlying_id = p.underlying_id AND pe.expiry_date = p.expiry_date AND pe.strike = p.atm_strike AND pe.option_type = 'PE'"""),
)
def j3(t: Tables):
    return chain.at_the_money(t.candles, t.underlyings, t.contracts, atm_asks(t), 2).select(
        "request_id", "spot", "atm_strike", "ce_contract_id", "pe_contract_id"
    )


# Chains at every stored day of every expiry.
DAYS = "chain_days AS (SELECT DISTINCT underlying_id, expiry_date, ts AS at_ts FROM daily JOIN contracts USING (contract_id) WHERE kind <> 'SPOT')"
LEGS = f"""{DAYS}, chain_legs AS (
  SELECT underlying_id, expiry_date, ts AS at_ts, contract_id, strike, option_type, fyers_symbol, lot_size, open, high, low, close, volume, oi
    FROM daily JOIN contracts USING (contract_id) WHERE kind = 'OPT')"""


def chain_asks(t: Tables):
    moments = t.daily.join(t.contracts.where("kind <> 'SPOT'"), "contract_id").select(
        "underlying_id", "expiry_date", F.col("ts").alias("at_ts")
    ).distinct()
    return moments.select(
        F.concat_ws("|", "underlying_id", "expiry_date", F.date_format("at_ts", "yyyyMMdd")).alias("request_id"),
        "underlying_id", "expiry_date", F.lit(100).cast("smallint").alias("res_id"), "at_ts",
    )


@query(
    "j4_chain_at",
    q(f"""SELECT {D('strike')}, option_type, fyers_symbol, {B('lot_size')}, {D('open')}, {D('high')}, {D('low')}, {D('close')}, {B('volume')}, {B('oi')}
      FROM daily JOIN contracts USING (contract_id) WHERE underlying_id = 2 AND expiry_date = DATE '2024-01-25' AND kind = 'OPT' AND ts = TIMESTAMP '2024-01-10'"""),
)
def j4(t: Tables):
    return chain.chain_at(t.daily, t.expiries, t.contracts, 2, "2024-01-25", 100, "2024-01-10 00:00:00")


@query("j4_chain_legs", qq(LEGS, f"SELECT {B('underlying_id')}, {S('expiry_date')}, {T('at_ts')}, {B('contract_id')}, {D('strike')}, option_type, {D('close')} FROM chain_legs"))
def j4_all(t: Tables):
    return chain.legs_at(t.daily, t.contracts, chain_asks(t)).select(
        "underlying_id", "expiry_date", "at_ts", "contract_id", "strike", "option_type", "close"
    )


DSPOT = "dspot AS (SELECT underlying_id, k.ts, k.close AS spot FROM daily k JOIN underlyings u ON u.spot_contract_id = k.contract_id)"
GRID = f"""{LEGS}, {DSPOT}, strikes AS (SELECT DISTINCT underlying_id, expiry_date, strike FROM contracts WHERE kind = 'OPT'),
priced AS (SELECT d.*, s.spot FROM chain_days d ASOF LEFT JOIN dspot s ON d.underlying_id = s.underlying_id AND d.at_ts >= s.ts),
near AS (SELECT underlying_id, expiry_date, at_ts, any_value(spot) AS spot,
                arg_min(strike, abs(strike - CAST(spot AS DECIMAL(12,4))) * 1000000 + strike / 1000) AS atm_strike
           FROM priced JOIN strikes USING (underlying_id, expiry_date) WHERE spot IS NOT NULL GROUP BY ALL)"""


def chain_picks(t: Tables):
    return chain.at_the_money(t.daily, t.underlyings, t.contracts, chain_asks(t), 100)


@query(
    "j5_chain_grid",
    qq(GRID, f"""SELECT {B('g.underlying_id', 'underlying_id')}, {S('g.expiry_date', 'expiry_date')}, {U('g.at_ts', 'ts')}, {D('strike')},
      {B('''coalesce(max(CASE WHEN option_type = 'CE' THEN lot_size END), max(lot_size))''', 'lot_size')}, {B('''max(CASE WHEN option_type = 'CE' THEN contract_id END)''', 'ce_id')},
      {D('''max(CASE WHEN option_type = 'CE' THEN close END)''', 'ce_close')}, {B('''max(CASE WHEN option_type = 'CE' THEN oi END)''', 'ce_oi')},
      {B('''max(CASE WHEN option_type = 'PE' THEN contract_id END)''', 'pe_id')}, {D('''max(CASE WHEN option_type = 'PE' THEN close END)''', 'pe_close')},
      {D('any_value(n.spot)', 'spot')}, {B('CAST(coalesce(g.strike = any_value(n.atm_strike), false) AS INT)', 'is_atm')}
      FROM chain_legs g LEFT JOIN near n USING (underlying_id, expiry_date, at_ts) GROUP BY g.underlying_id, g.expiry_date, g.at_ts, g.strike"""),
)
def j5(t: Tables):
    asks = chain_asks(t)
    grid = chain.grid(chain.legs_at(t.daily, t.contracts, asks), chain_picks(t))
    return grid.join(asks.select("request_id", "underlying_id", "expiry_date"), "request_id").select(
        "underlying_id", "expiry_date", "ts", "strike", "lot_size", F.col("ce.contract_id").alias("ce_id"),
        F.col("ce.close").alias("ce_close"), F.col("ce.oi").alias("ce_oi"), F.col("pe.contract_id").alias("pe_id"),
        F.col("pe.close").alias("pe_close"), "spot", "is_atm",
    )


@query(
    "j6_chain_window",
    qq(GRID, f"""SELECT {B('e.underlying_id', 'underlying_id')}, {S('e.expiry_date', 'expiry_date')}, {T('k.ts', 'ts')}, {D('c.strike', 'strike')}, option_type, {D('k.close', 'close')}, {B('k.volume', 'volume')}, {B('k.oi', 'oi')}
      FROM near n JOIN expiries e USING (underlying_id, expiry_date) JOIN contracts c ON c.expiry_id = e.expiry_id AND c.kind = 'OPT' JOIN daily k ON k.contract_id = c.contract_id
      WHERE k.ts >= n.at_ts AND k.ts < n.at_ts + INTERVAL 7 DAY AND abs(c.strike - n.atm_strike) <= 2 * strike_step"""),
)
def j6(t: Tables):
    picks = chain_picks(t).withColumns(
        {
            "start_ts": F.col("at_ts"),
            "end_ts": F.timestamp_add("DAY", F.lit(7), "at_ts"),
            "strikes_each_side": F.lit(2),
        }
    )
    banded = chain.band(t.daily, t.expiries, t.contracts, picks)
    return banded.join(picks.select("request_id", "underlying_id", "expiry_date"), "request_id").drop("request_id")


@query(
    "j7_snap_to_bar",
    qq("""snaps AS (SELECT event_id AS request_id, 1 + 2 * (user_id % 5) + event_id % 2 AS expiry_id, CASE WHEN event_id % 9 <> 0 THEN ts - to_days(CAST(event_id % 3 AS INT)) END AS at_ts FROM events),
       moments AS (SELECT DISTINCT expiry_id, ts FROM candles JOIN contracts USING (contract_id) WHERE kind <> 'SPOT'),
       newest AS (SELECT expiry_id, max(ts) AS ts FROM moments GROUP BY expiry_id)""",
       f"""SELECT {B('s.request_id', 'request_id')}, {T('CASE WHEN s.at_ts IS NULL THEN n.ts ELSE m.ts END', 'snapped_ts')} FROM snaps s
      ASOF LEFT JOIN moments m ON s.expiry_id = m.expiry_id AND s.at_ts >= m.ts LEFT JOIN newest n ON n.expiry_id = s.expiry_id"""),
)
def j7(t: Tables):
    e = F.col("event_id")
    asks = t.given("events").select(
        e.alias("request_id"), (1 + 2 * (F.col("user_id") % 5) + e % 2).cast("int").alias("expiry_id"),
        F.lit(2).cast("smallint").alias("res_id"),
        F.when(e % 9 != 0, F.timestamp_add("DAY", -(e % 3), F.col("ts").cast("timestamp_ntz"))).alias("at_ts"),
    )
    return asof.last_moment(t.candles, t.contracts, asks).select("request_id", "snapped_ts")


@query(
    "j14_oi_alignment",
    qq("points AS (SELECT contract_id, ts + INTERVAL 90 SECOND AS point_ts, oi * 3 AS point_oi FROM candles WHERE oi IS NOT NULL)",
       f"""SELECT {B('k.contract_id', 'contract_id')}, {T('k.ts', 'ts')}, {T('p.point_ts', 'point_at')}, {B('p.point_oi', 'point_oi')}
      FROM candles k ASOF LEFT JOIN points p ON k.contract_id = p.contract_id AND k.ts >= p.point_ts"""),
)
def j14(t: Tables):
    points = t.candles.where("oi IS NOT NULL").select(
        "contract_id", F.timestamp_add("SECOND", F.lit(90), "ts").alias("point_ts"), (F.col("oi") * 3).alias("point_oi")
    )
    return asof.align_oi(t.candles.select("contract_id", "ts"), points)


@query(
    "a15_chain_totals",
    qq(LEGS, f"""SELECT {B('underlying_id')}, {S('expiry_date')}, {T('at_ts')}, {B('call_oi')}, {B('put_oi')}, {B('call_volume')}, {B('put_volume')},
      CASE WHEN call_oi > 0 THEN CAST(put_oi AS DOUBLE) / call_oi END AS pcr FROM (
      SELECT underlying_id, expiry_date, at_ts, coalesce(sum(oi) FILTER (WHERE option_type = 'CE'), 0) AS call_oi, coalesce(sum(oi) FILTER (WHERE option_type = 'PE'), 0) AS put_oi,
             coalesce(sum(volume) FILTER (WHERE option_type = 'CE'), 0) AS call_volume, coalesce(sum(volume) FILTER (WHERE option_type = 'PE'), 0) AS put_volume
        FROM chain_legs GROUP BY ALL)"""),
)
def a15(t: Tables):
    legs = chain.legs_at(t.daily, t.contracts, chain_asks(t))
    return chain.totals(legs, ["underlying_id", "expiry_date", "at_ts"])


EOD = f"""{SPOT}, eod AS (SELECT e.underlying_id, e.expiry_date, s.spot FROM expiries e ASOF LEFT JOIN spot s ON e.underlying_id = s.underlying_id AND CAST(e.expiry_date + 1 AS TIMESTAMP) > s.ts),
ranked AS (SELECT underlying_id, expiry_date, strike, spot, row_number() OVER (PARTITION BY underlying_id, expiry_date ORDER BY strike) AS r
             FROM (SELECT DISTINCT underlying_id, expiry_date, strike FROM contracts WHERE kind = 'OPT') JOIN eod USING (underlying_id, expiry_date)),
atm AS (SELECT underlying_id, expiry_date, arg_min(r, abs(strike - CAST(spot AS DECIMAL(12,4))) * 1000000 + strike / 1000) AS ar FROM ranked GROUP BY ALL)"""


@query(
    "f9_strike_scope_band",
    qq(EOD, f"""SELECT {B('contract_id')}, {D('c.strike', 'strike')} FROM contracts c LEFT JOIN ranked r ON r.underlying_id = c.underlying_id AND r.expiry_date = c.expiry_date AND r.strike = c.strike
      LEFT JOIN atm a ON a.underlying_id = c.underlying_id AND a.expiry_date = c.expiry_date
      WHERE c.kind <> 'SPOT' AND (c.strike IS NULL OR abs(r.r - a.ar) <= 2)"""),
)
def f9(t: Tables):
    own = t.contracts.where("kind <> 'SPOT'")
    spots = asof.end_of_day_spot(t.candles, t.underlyings, t.expiries.select("underlying_id", "expiry_date"))
    return chain.strike_scope(own, "band", spots=spots, steps=2).select("contract_id", "strike")


@query("f9_strike_scope_explicit", q(f"SELECT {B('contract_id')}, {D('strike')} FROM contracts WHERE kind <> 'SPOT' AND (strike IS NULL OR strike IN (SELECT CAST(p_size AS DECIMAL(12,4)) FROM part))"))
def f9e(t: Tables):
    return chain.strike_scope(
        t.contracts.where("kind <> 'SPOT'"), "explicit", strikes=t.given("part").select(F.col("p_size").alias("strike"))
    ).select("contract_id", "strike")


# -- SQL table functions ---------------------------------------------------------------------------


def vocabulary(t: Tables, candles):
    table_views.publish_views(
        t.spark, candles=candles, dim_underlying=t.underlyings, dim_contract=t.contracts, dim_expiry=t.expiries
    )
    sqltable.register(t.spark)
    return t.spark


@query("sql_bars", q(f"SELECT {T('ts')}, {D('open')}, {D('high')}, {D('low')}, {D('close')}, {B('volume')}, {B('oi')} FROM candles WHERE contract_id = 4 AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-12'"))
def sql_bars(t: Tables):
    return vocabulary(t, t.candles).sql(
        "SELECT * FROM bars(4, 2, timestamp_ntz'2024-01-03 00:00:00', timestamp_ntz'2024-01-12 00:00:00')"
    )


@query("sql_spot_at", qq(SPOT, f"SELECT {T('ts')}, {D('spot', 'close')} FROM spot WHERE underlying_id = 1 AND ts <= TIMESTAMP '2024-01-15 10:00:00' ORDER BY spot.ts DESC LIMIT 1"))
def sql_spot_at(t: Tables):
    return vocabulary(t, t.candles).sql("SELECT * FROM spot_at(1, 2, timestamp_ntz'2024-01-15 10:00:00')")


SQL_ATM = f"""{SPOT}, s1 AS (SELECT spot FROM spot WHERE underlying_id = 2 AND ts <= TIMESTAMP '2024-01-15 10:00:00' ORDER BY spot.ts DESC LIMIT 1)"""


@query("sql_atm_strike", qq(SQL_ATM, f"SELECT {D('strike')} FROM contracts, s1 WHERE underlying_id = 2 AND expiry_date = DATE '2024-01-25' AND kind = 'OPT' ORDER BY abs(contracts.strike - spot), contracts.strike LIMIT 1"))
def sql_atm(t: Tables):
    return vocabulary(t, t.candles).sql("SELECT * FROM atm_strike(2, date'2024-01-25', 2, timestamp_ntz'2024-01-15 10:00:00')")


@query(
    "sql_chain_at",
    q(f"""SELECT {D('strike')}, option_type, fyers_symbol, {B('lot_size')}, {D('open')}, {D('high')}, {D('low')}, {D('close')}, {B('volume')}, {B('oi')}
      FROM daily JOIN contracts USING (contract_id) WHERE underlying_id = 3 AND expiry_date = DATE '2024-02-29' AND kind = 'OPT' AND ts = TIMESTAMP '2024-01-11'"""),
)
def sql_chain_at(t: Tables):
    return vocabulary(t, t.daily).sql("SELECT * FROM chain_at(3, date'2024-02-29', 100, timestamp_ntz'2024-01-11 00:00:00')")


@query(
    "sql_chain_window",
    qq(f"{DSPOT}, s1 AS (SELECT spot FROM dspot WHERE underlying_id = 3 AND ts <= TIMESTAMP '2024-01-05' ORDER BY dspot.ts DESC LIMIT 1), a1 AS (SELECT strike FROM contracts, s1 WHERE underlying_id = 3 AND expiry_date = DATE '2024-02-29' AND kind = 'OPT' ORDER BY abs(contracts.strike - spot), contracts.strike LIMIT 1)",
       f"""SELECT {T('ts')}, {D('c.strike', 'strike')}, option_type, {D('close')}, {B('volume')}, {B('oi')} FROM daily JOIN contracts c USING (contract_id), a1
      WHERE underlying_id = 3 AND expiry_date = DATE '2024-02-29' AND kind = 'OPT' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' AND abs(c.strike - a1.strike) <= 2 * 10"""),
)
def sql_chain_window(t: Tables):
    return vocabulary(t, t.daily).sql(
        "SELECT * FROM chain_window(3, date'2024-02-29', 100, timestamp_ntz'2024-01-05 00:00:00', timestamp_ntz'2024-01-12 00:00:00', 2)"
    )


# -- instrument master -------------------------------------------------------------------------------


@query(
    "j8_facts_on_date",
    qq("asked AS (SELECT CAST('C' || o_custkey AS VARCHAR) AS fytoken, o_orderkey, DATE '2024-01-01' + CAST(o_orderkey % 40 AS INT) AS on_date FROM orders)",
       f"""SELECT {B('o_orderkey')}, a.fytoken, {S('on_date')}, {B('min_lot_size')}, {S('valid_from')} FROM asked a
      LEFT JOIN history h ON h.fytoken = a.fytoken AND h.valid_from <= on_date AND (h.valid_to IS NULL OR h.valid_to > on_date)"""),
)
def j8(t: Tables):
    asked = t.given("orders").select(
        F.concat(F.lit("C"), "o_custkey").alias("fytoken"), "o_orderkey",
        F.date_add(clock.day("2024-01-01"), (F.col("o_orderkey") % 40).cast("int")).alias("on_date"),
    )
    return versioning.facts_on(t.master_history, asked).select("o_orderkey", "fytoken", "on_date", "min_lot_size", "valid_from")


ENRICHED = """cc AS (SELECT c_custkey, 'NSE:' || CASE WHEN c_nationkey = 7 THEN '7' ELSE '' END || 'NATION_' || c_nationkey || '24JAN' || (c_custkey + 1) || CASE WHEN c_acctbal >= 4000 THEN 'CE' ELSE 'PE' END AS sym,
  CASE WHEN c_nationkey % 2 = 0 THEN DATE '2024-01-15' ELSE DATE '2024-01-25' END AS expiry_date FROM customer)"""


@query(
    "j9_enrich_contracts",
    qq(ENRICHED, f"""SELECT {B('c_custkey', 'contract_id')}, fytoken, {B('min_lot_size', 'lot_size')}, {S('valid_from', 'instrument_master_valid_from')}, {B('CAST(valid_from IS NOT NULL AS INT)', 'is_hit')}
      FROM cc LEFT JOIN history h ON h.symbol_ticker = sym AND valid_from <= cc.expiry_date AND (valid_to IS NULL OR valid_to > cc.expiry_date)"""),
)
def j9(t: Tables):
    root = F.concat(F.when(F.col("c_nationkey") == 7, "7").otherwise(""), F.lit("NATION_"), F.col("c_nationkey"))
    contracts = t.given("customer").select(
        F.col("c_custkey").alias("contract_id"),
        F.concat(F.lit("NSE:"), root, F.lit("24JAN"), F.col("c_custkey") + 1, F.when(F.col("c_acctbal") >= 4000, "CE").otherwise("PE")).alias("fyers_symbol"),
        F.when(F.col("c_nationkey") % 2 == 0, clock.day("2024-01-15")).otherwise(clock.day("2024-01-25")).alias("expiry_date"),
    )
    return versioning.enrich_contracts(contracts, t.master_history).select(
        "contract_id", "fytoken", "lot_size", "instrument_master_valid_from", "is_hit"
    )


CANDIDATES = """roots AS (SELECT under_symbol AS root, min(under_fytoken) AS tok, count(*) AS n FROM history WHERE valid_to IS NULL AND segment_code = 11 GROUP BY under_symbol),
cand AS (SELECT root, n, tok, c.symbol_ticker AS ticker, c.symbol_details AS details,
                CASE WHEN c.symbol_ticker IS NULL THEN 'no_cash_row' WHEN NOT regexp_full_match(root, '[A-Z][A-Z0-9&_.\\-]*') THEN 'bad_root' END AS reason
           FROM roots LEFT JOIN (SELECT * FROM history WHERE valid_to IS NULL AND segment_code = 10) c ON c.fytoken = tok)"""


def candidates(t: Tables):
    history = t.master_history
    cash = history.where("valid_to IS NULL AND segment_code = 10")
    return registry.root_candidates(registry.root_counts(history), cash)


@query(
    "j13_root_candidates",
    qq(CANDIDATES, f"SELECT 'NSE' AS exchange, root, ticker AS fyers_symbol, root AS display_name, 'INDEX' AS instrument_kind, 'FO' AS derivative_segment, tok AS under_fytoken, {B('n', 'contract_count')} FROM cand WHERE reason IS NULL"),
)
def j13(t: Tables):
    return candidates(t)[0]


@query("j13_root_rejects", qq(CANDIDATES, f"SELECT 'NSE' AS exchange, root, reason, {B('n', 'contract_count')} FROM cand WHERE reason IS NOT NULL"))
def j13r(t: Tables):
    return candidates(t)[1]


# Suppliers as declared underlyings: some exchanges and segments do not exist.
DECLARED = """decl AS (SELECT s_suppkey AS underlying_id, upper(['nse','bse','MCX','XSE'][s_nationkey % 4 + 1]) AS exchange, ['CM','FO','CD','COM','ZZ'][s_suppkey % 5 + 1] AS segment FROM supplier),
coded AS (SELECT *, CASE exchange WHEN 'NSE' THEN 10 WHEN 'MCX' THEN 11 WHEN 'BSE' THEN 12 END AS ec, CASE segment WHEN 'CM' THEN 10 WHEN 'FO' THEN 11 WHEN 'CD' THEN 12 WHEN 'COM' THEN 20 END AS sc FROM decl),
judged AS (SELECT *, CASE WHEN ec IS NULL THEN 'unknown_exchange' WHEN sc IS NULL THEN 'unknown_segment'
  WHEN NOT ((ec, sc) IN ((10,10),(10,11),(10,12),(11,20),(12,10),(12,11),(12,12),(11,11))) THEN 'pair_not_traded' END AS reason FROM coded)"""


def declared(t: Tables):
    def nth(values, i):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))

    return t.given("supplier").select(
        F.col("s_suppkey").alias("underlying_id"), nth(["nse", "bse", "MCX", "XSE"], F.col("s_nationkey") % 4).alias("exchange"),
        nth(["CM", "FO", "CD", "COM", "ZZ"], F.col("s_suppkey") % 5).alias("segment"),
    )


@query("j16_registry_mirror", qq(DECLARED, f"SELECT {B('underlying_id')}, exchange, segment, {B('ec', 'exchange_code')}, {B('sc', 'segment_code')}, CASE exchange WHEN 'BSE' THEN '2023-08-07' ELSE '2022-01-03' END AS data_floor FROM judged WHERE reason IS NULL"))
def j16(t: Tables):
    return registry.mirror(declared(t))[0]


@query("j16_registry_skipped", qq(DECLARED, f"SELECT {B('underlying_id')}, exchange, segment, reason FROM judged WHERE reason IS NOT NULL"))
def j16s(t: Tables):
    return registry.mirror(declared(t))[1]
