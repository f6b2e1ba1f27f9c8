"""Building and decomposing contract symbols, and what follows from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.base import YEARS, Tables, query
from catalogue.sql import B, D, S, q, qq
from tickloom.operators import registry, symbols


def roots(t: Tables):
    """The registered roots: every underlying's own."""
    return t.underlyings.select("root", "instrument_kind", F.lit("FO").alias("derivative_segment"))


@query("p5_build_symbols", q("SELECT fyers_symbol, kind, exchange, root FROM contracts"))
def p5(t: Tables):
    return t.contracts.select("fyers_symbol", "kind", "exchange", "root")


PARSE_SQL = f"""SELECT {B('contract_id')}, fyers_symbol, kind, exchange, {B('''CASE exchange WHEN 'NSE' THEN 10 ELSE 12 END''', 'exchange_code')}, root2 AS root,
  CASE WHEN kind = 'SPOT' THEN 'CM' ELSE 'FO' END AS segment, {D('strike')}, option_type, {B('year(expiry_date)', 'expiry_year')}, {B('month(expiry_date)', 'expiry_month')},
  {S('''CASE WHEN kind = 'OPT' AND expiry_date = DATE '2024-01-25' THEN expiry_date END''', 'expiry')},
  CASE WHEN kind = 'SPOT' THEN 'NONE' WHEN kind = 'OPT' AND expiry_date = DATE '2024-01-25' THEN 'WEEKLY_CODED' ELSE 'MONTHLY_CODED' END AS symbol_expiry_encoding,
  CASE WHEN kind = 'SPOT' THEN 'INDEX' ELSE instrument_class END AS instrument_class, CAST(NULL AS VARCHAR) AS parse_error
  FROM (SELECT *, root AS root2 FROM contracts)"""
PARSE_OUT = [
    "contract_id", "fyers_symbol", "kind", "exchange", "exchange_code", "root", "segment", "strike", "option_type",
    "expiry_year", "expiry_month", "expiry", "symbol_expiry_encoding", "instrument_class", "parse_error",
]


@query("p1_parse_symbols", q(PARSE_SQL))
def p1(t: Tables):
    listed = t.contracts.select("contract_id", "fyers_symbol")
    return symbols.parse(listed, roots(t), YEARS).select(*PARSE_OUT)


# Every customer and order as a weekly symbol of a root nobody registered: the split alone decides.
WEEKLY = """wk AS (SELECT o_orderkey, 'NSE:' || 'N' || chr(CAST(65 + c_nationkey AS INT)) || strftime(o_orderdate + INTERVAL 9000 DAY, '%y')
    || ['1','2','3','4','5','6','7','8','9','O','N','D'][month(o_orderdate + INTERVAL 9000 DAY)] || strftime(o_orderdate + INTERVAL 9000 DAY, '%d') || (o_orderkey % 900 + 1) || 'PE' AS sym,
    'N' || chr(CAST(65 + c_nationkey AS INT)) AS root, CAST(o_orderdate + INTERVAL 9000 DAY AS DATE) AS expiry, o_orderkey % 900 + 1 AS strike FROM orders JOIN customer ON c_custkey = o_custkey),
cut AS (SELECT *, sym[5:length(sym) - 2] AS core, unnest(generate_series(1, length(sym) - 12)) AS i FROM wk),
pieces AS (SELECT o_orderkey, root, expiry, strike, core[1:i] AS r, core[i+1:i+2] AS yy, core[i+3:i+3] AS m, core[i+4:i+5] AS dd, core[i+6:] AS k FROM cut),
cand AS (SELECT *, try_cast('20' || yy || '-' || list_position(['1','2','3','4','5','6','7','8','9','O','N','D'], m) || '-' || dd AS DATE) AS d FROM pieces
   WHERE regexp_full_match(r, '[A-Z][A-Z0-9&_.\\-]*') AND regexp_full_match(yy || dd, '[0-9]{4}') AND list_contains(['1','2','3','4','5','6','7','8','9','O','N','D'], m)
     AND regexp_full_match(k, '[1-9][0-9]*(\\.[0-9]+)?')),
okay AS (SELECT o_orderkey, count(*) AS n, any_value(r) AS r, any_value(d) AS d, any_value(k) AS k FROM cand WHERE d IS NOT NULL AND year(d) BETWEEN 2015 AND 2031 GROUP BY o_orderkey)"""


def weekly_orders(t: Tables):
    o = t.given("orders").join(t.given("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    expiry = F.date_add(F.to_date("o_orderdate"), 9000)
    root = F.concat(F.lit("N"), F.chr(F.col("c_nationkey") + 65))
    strike = (F.col("o_orderkey") % 900 + 1).cast("string")
    return o.select(
        "o_orderkey", root.alias("own_root"), expiry.alias("own_expiry"), strike.alias("own_strike"),
        symbols.build_weekly(F.lit("NSE"), root, expiry, strike, F.lit("PE")).alias("fyers_symbol"),
    )


@query(
    "p2_weekly_splits",
    qq(WEEKLY, f"""SELECT {B('w.o_orderkey', 'o_orderkey')}, sym AS fyers_symbol, CASE WHEN n = 1 THEN o.r END AS root, {S('CASE WHEN n = 1 THEN o.d END', 'expiry')}, {D('CASE WHEN n = 1 THEN o.k END', 'strike')},
      CASE WHEN n IS NULL THEN 'no_valid_split' WHEN n > 1 THEN 'ambiguous' END AS parse_error FROM wk w LEFT JOIN okay o USING (o_orderkey)"""),
)
def p2(t: Tables):
    return symbols.parse(weekly_orders(t), roots(t), YEARS).select("o_orderkey", "fyers_symbol", "root", "expiry", "strike", "parse_error")


@query(
    "p3_hint_verification",
    qq(WEEKLY, f"""SELECT {B('w.o_orderkey', 'o_orderkey')}, CASE WHEN w.o_orderkey % 10 IN (3, 6) THEN NULL ELSE w.root END AS root,
      CASE WHEN w.o_orderkey % 10 = 3 THEN 'root_disagrees' WHEN w.o_orderkey % 10 = 6 THEN 'expiry_disagrees' END AS parse_error FROM wk w"""),
)
def p3(t: Tables):
    k = F.col("o_orderkey") % 10
    hinted = weekly_orders(t).withColumns(
        {
            "hr": F.when(k == 3, F.concat("own_root", F.lit("X"))).otherwise(F.col("own_root")),
            # A wrong day still leaves the right root hint to decide the split.
            "he": F.when(k == 6, F.date_add("own_expiry", 40)).otherwise(F.col("own_expiry")),
        }
    )
    parsed = symbols.parse(hinted, roots(t), YEARS, expected_root="hr", expected_expiry="he")
    return parsed.select("o_orderkey", "root", "parse_error")


@query(
    "p4_segments_and_classes",
    qq("""pairs AS (SELECT o_orderkey, ['NSE','BSE','MCX'][o_orderkey % 3 + 1] AS exchange, ['SPOT','FUT','OPT'][o_custkey % 3 + 1] AS kind,
           ['ALPHA','DELTA','USDINR','ZETA'][o_orderkey % 4 + 1] AS root FROM orders)""",
       f"""SELECT {B('o_orderkey')}, CASE WHEN p.exchange = 'MCX' THEN 'COM' WHEN kind = 'SPOT' THEN 'CM' WHEN u.root IS NOT NULL THEN 'FO' WHEN p.root = 'USDINR' THEN 'CD' ELSE 'FO' END AS segment,
      {B('''CAST(p.exchange <> 'MCX' AND kind <> 'SPOT' AND u.root IS NULL AS INT)''', 'inferred')},
      CASE WHEN kind = 'SPOT' THEN 'EQUITY' WHEN u.root IS NULL THEN NULL ELSE kind || CASE u.instrument_kind WHEN 'INDEX' THEN 'IDX' ELSE 'STK' END END AS instrument_class
      FROM pairs p LEFT JOIN underlyings u USING (root)"""),
)
def p4(t: Tables):
    def nth(values, i):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))

    k = F.col("o_orderkey")
    pairs = t.given("orders").select(
        k, nth(["NSE", "BSE", "MCX"], k % 3).alias("exchange"), nth(["SPOT", "FUT", "OPT"], F.col("o_custkey") % 3).alias("kind"),
        nth(["ALPHA", "DELTA", "USDINR", "ZETA"], k % 4).alias("root"), F.lit("EQ").alias("series"),
    ).join(roots(t), "root", "left")
    segment, inferred = symbols.segment_of(F.col("exchange"), F.col("kind"), F.col("root"), F.col("derivative_segment"))
    return pairs.select(
        "o_orderkey", segment.alias("segment"), inferred.alias("inferred"),
        symbols.instrument_class(F.col("kind"), F.col("series"), F.col("instrument_kind")).alias("instrument_class"),
    )


# The audit compares current options with the vendor's fields; root 7NATION_7 cannot be parsed.
@query(
    "p6_parser_audit_rejects",
    q("""SELECT min(symbol_ticker) AS symbol_ticker, 'no_valid_split' AS parse_error FROM history WHERE valid_to IS NULL AND segment_code = 11 AND under_symbol = '7NATION_7' GROUP BY under_symbol"""),
)
def p6_rejects(t: Tables):
    return symbols.audit(t.master_history, roots(t), YEARS)[1]


@query(
    "p6_parser_audit",
    q(f"""SELECT symbol_ticker, 'strike' AS field, {S('CAST(strike_price AS DECIMAL(12,4))', 'parsed')}, {S('CAST(strike_price + 1 AS DECIMAL(12,4))', 'vendor')} FROM history
      WHERE valid_to IS NULL AND segment_code = 11 AND under_symbol <> '7NATION_7' AND under_symbol[8:] IN ('2', '4')
      QUALIFY row_number() OVER (PARTITION BY under_symbol ORDER BY symbol_ticker) = 1"""),
)
def p6(t: Tables):
    wrong = F.col("under_symbol").isin("NATION_2", "NATION_4")
    edited = t.master_history.withColumn(
        "strike_price",
        F.when(wrong, F.col("strike_price") + 1).otherwise(F.col("strike_price")).cast("decimal(12,4)"),
    )
    return symbols.audit(edited, roots(t), YEARS)[0]


@query(
    "p7_contract_rows",
    q(f"""SELECT fyers_symbol, kind, instrument_class, root, {D('strike')}, option_type, {S('expiry_date')}, {B('isodow(expiry_date)', 'expiry_dow')},
      CASE WHEN kind = 'FUT' THEN 'futures' ELSE 'options' END AS source_array FROM contracts WHERE kind <> 'SPOT'"""),
)
def p7(t: Tables):
    c = t.contracts.where("kind <> 'SPOT'")
    listed = c.select(
        F.col("fyers_symbol").alias("symbol"), F.when(F.col("kind") == "FUT", "futures").otherwise("options").alias("source_array"),
        F.lit(0).alias("source_array_index"), "expiry_date", F.col("root").alias("root_hint"),
    )
    rows, _ = symbols.contract_rows(listed, roots(t), YEARS)
    return rows.select("fyers_symbol", "kind", "instrument_class", "root", "strike", "option_type", "expiry_date", "expiry_dow", "source_array")


@query(
    "p9_cash_naming",
    q(f"""SELECT {B('s_suppkey')}, CASE WHEN s_nationkey % 3 = 0 THEN 'INDEX' WHEN s_suppkey % 4 = 0 THEN 'INDEX' ELSE 'EQUITY' END AS kind,
      CASE WHEN s_suppkey % 5 = 0 THEN 'R' || s_suppkey WHEN s_suppkey % 5 = 1 THEN 'R' || s_suppkey ELSE s_name END AS display_name FROM supplier"""),
)
def p9(t: Tables):
    k = F.col("s_suppkey")
    s = t.given("supplier").select(
        k, F.concat(F.lit("R"), k).alias("root"),
        F.concat(F.lit("NSE:R"), k, F.when(F.col("s_nationkey") % 3 == 0, "-index").otherwise("-EQ")).alias("ticker"),
        F.when(k % 4 == 0, 10).otherwise(0).alias("type_code"),
        F.when(k % 5 == 0, " index ").when(k % 5 == 1, F.lit(None)).otherwise(F.col("s_name")).alias("details"),
    )
    return s.select(
        "s_suppkey", registry.cash_kind(F.col("ticker"), F.col("type_code")).alias("kind"),
        registry.display_name(F.col("root"), F.col("details")).alias("display_name"),
    )

