from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest

from tickloom.operators import registry, symbols

YEARS = symbols.year_window(2026)

# symbol -> (segment, kind, root, class, expiry, encoding, strike, right)
CASES = {
    "NSE:SBIN-EQ": ("CM", "SPOT", "SBIN", "EQUITY", None, "NONE", None, None),
    "NSE:NIFTY50-INDEX": ("CM", "SPOT", "NIFTY50", "INDEX", None, "NONE", None, None),
    "NSE:BAJAJ-AUTO-EQ": ("CM", "SPOT", "BAJAJ-AUTO", "EQUITY", None, "NONE", None, None),
    "NSE:M&M-EQ": ("CM", "SPOT", "M&M", "EQUITY", None, "NONE", None, None),
    "NSE:NIFTY26SEPFUT": ("FO", "FUT", "NIFTY", "FUTIDX", None, "MONTHLY_CODED", None, None),
    "NSE:USDINR20OCTFUT": ("CD", "FUT", "USDINR", None, None, "MONTHLY_CODED", None, None),
    "MCX:GOLD20DECFUT": ("COM", "FUT", "GOLD", None, None, "MONTHLY_CODED", None, None),
    "NSE:NIFTYNXT5026MARFUT": ("FO", "FUT", "NIFTYNXT50", None, None, "MONTHLY_CODED", None, None),
    "NSE:BAJAJ-AUTO25OCTFUT": ("FO", "FUT", "BAJAJ-AUTO", None, None, "MONTHLY_CODED", None, None),
    "NSE:BANKNIFTY25MAR52000PE": ("FO", "OPT", "BANKNIFTY", "OPTIDX", None, "MONTHLY_CODED", "52000", "PE"),
    "NSE:MARUTI25MAR11000CE": ("FO", "OPT", "MARUTI", None, None, "MONTHLY_CODED", "11000", "CE"),
    "NSE:GBPINR20NOV80.5PE": ("CD", "OPT", "GBPINR", None, None, "MONTHLY_CODED", "80.5", "PE"),
    "BSE:SENSEX5025NOV25000CE": ("FO", "OPT", "SENSEX50", None, None, "MONTHLY_CODED", "25000", "CE"),
    "NSE:NIFTY2510923000CE": ("FO", "OPT", "NIFTY", "OPTIDX", date(2025, 1, 9), "WEEKLY_CODED", "23000", "CE"),
    "NSE:NIFTY20O0811000CE": ("FO", "OPT", "NIFTY", "OPTIDX", date(2020, 10, 8), "WEEKLY_CODED", "11000", "CE"),
    "NSE:NIFTY20D1025000CE": ("FO", "OPT", "NIFTY", "OPTIDX", date(2020, 12, 10), "WEEKLY_CODED", "25000", "CE"),
    "BSE:SENSEX2381161000CE": ("FO", "OPT", "SENSEX", "OPTIDX", date(2023, 8, 11), "WEEKLY_CODED", "61000", "CE"),
    "NSE:GBPINR20N0580.5PE": ("CD", "OPT", "GBPINR", None, date(2020, 11, 5), "WEEKLY_CODED", "80.5", "PE"),
    "NSE:NIFTYNXT502510923000CE": ("FO", "OPT", "NIFTYNXT50", None, date(2025, 1, 9), "WEEKLY_CODED", "23000", "CE"),
    "NSE:MARICO20O0811000CE": ("FO", "OPT", "MARICO", None, date(2020, 10, 8), "WEEKLY_CODED", "11000", "CE"),
    "NSE:USDINR2280580.5CE": ("CD", "OPT", "USDINR", None, date(2022, 8, 5), "WEEKLY_CODED", "80.5", "CE"),
}
REJECTS = {
    "NSE:ABC225125100CE": "ambiguous",
    "NSE:NIFTY2500923000CE": "no_valid_split",
    "NSE:NIFTY2513223000CE": "no_valid_split",
    "NSE:NIFTY2011300000CE": "no_valid_split",
    "NSE:GARBAGE": "unrecognised",
    "XYZ:NIFTY25MARFUT": "unknown_exchange",
    "NIFTY25MARFUT": "no_exchange",
    "NSE:NIFTY09MARFUT": "year_out_of_window",
}


def parsed(spark, rows, schema="fyers_symbol string", **hints):
    roots = registry.builtin_roots(spark)
    df = spark.createDataFrame(rows, schema)
    return {r.fyers_symbol: r for r in symbols.parse(df, roots, YEARS, **hints).collect()}


def test_decomposition(spark):
    got = parsed(spark, [(s,) for s in CASES])
    for s, (segment, kind, root, klass, expiry, encoding, strike, right) in CASES.items():
        r = got[s]
        want = (None, segment, kind, root, klass, expiry, encoding, strike and Decimal(strike), right)
        have = (r.parse_error, r.segment, r.kind, r.root, r.instrument_class, r.expiry, r.symbol_expiry_encoding, r.strike, r.option_type)
        assert have == want, s


def test_rejects(spark):
    got = parsed(spark, [(s,) for s in REJECTS])
    assert {s: got[s].parse_error for s in REJECTS} == REJECTS
    assert all(got[s].root is None for s in REJECTS)


def test_a_known_root_settles_an_ambiguous_symbol_and_a_hint_outranks_it(spark):
    df = spark.createDataFrame([("NSE:ABC225125100CE",)], "fyers_symbol string")
    roots = spark.createDataFrame([("ABC2", "EQUITY", "FO")], "root string, instrument_kind string, derivative_segment string")
    r = symbols.parse(df, roots, YEARS).first()
    assert (r.root, r.expiry, r.strike, r.parse_confidence) == ("ABC2", date(2025, 1, 25), Decimal(100), "scored")
    assert "multiple_candidates" in r.parse_warnings
    hinted = df.selectExpr("fyers_symbol", "date'2022-05-12' AS e")
    r = symbols.parse(hinted, roots, YEARS, expected_expiry="e").first()
    assert (r.root, r.parse_method, r.parse_confidence) == ("ABC", "hinted", "exact")


@pytest.mark.parametrize(
    "symbol,root,expiry,error",
    [
        ("NSE:NIFTY25MAR23000CE", "NIFTY", date(2025, 3, 27), None),
        ("NSE:NIFTY25MAR23000CE", "NIFTY", date(2025, 4, 3), "expiry_disagrees"),
        ("NSE:NIFTY2510923000CE", "NIFTY", date(2025, 1, 16), "expiry_disagrees"),
        ("NSE:NIFTY2510923000CE", "BANKNIFTY", date(2025, 1, 9), "root_disagrees"),
    ],
)
def test_hints_verify(spark, symbol, root, expiry, error):
    got = parsed(
        spark, [(symbol, root, expiry)], "fyers_symbol string, r string, e date", expected_root="r", expected_expiry="e"
    )[symbol]
    assert got.parse_error == error
    if error is None:
        assert got.expiry == expiry and "expiry_day_unknown" not in got.parse_warnings


def test_tied_splits_that_all_miss_the_root_hint_disagree_with_it(spark):
    """The symbol splits three ways into the same day, so the day decides nothing."""
    rows = [("NQX", "root_disagrees", None), ("NQ2", None, "NQ2"), (None, "ambiguous", None)]
    df = spark.createDataFrame([("NSE:NQ22222222PE", h, date(2022, 2, 22)) for h, _, _ in rows], "fyers_symbol string, r string, e date")
    out = symbols.parse(df, registry.builtin_roots(spark), YEARS, expected_root="r", expected_expiry="e").collect()
    assert {(o.r, o.parse_error, o.root) for o in out} == set(rows)


def test_a_wrong_day_that_another_root_fits_disagrees_not_the_root(spark):
    """The first symbol is NB on 3 February or NB20 on 14 March, the second NQ122 on the 21st, NQ1 or NQ12 on the 22nd."""
    rows = [
        ("NSE:NB2020314777PE", "NB", date(2020, 2, 3), None),
        ("NSE:NB2020314777PE", "NB", date(2020, 3, 14), "expiry_disagrees"),
        ("NSE:NB2020314777PE", "NBX", date(2020, 3, 14), "root_disagrees"),
        ("NSE:NQ122222215PE", "NQ122", date(2022, 2, 21), None),
        ("NSE:NQ122222215PE", "NQ122", date(2022, 2, 22), "expiry_disagrees"),
        ("NSE:NQ122222215PE", "NQX", date(2022, 2, 22), "root_disagrees"),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "fyers_symbol string, r string, e date")
    out = symbols.parse(df, registry.builtin_roots(spark), YEARS, expected_root="r", expected_expiry="e").collect()
    assert {(o.fyers_symbol, o.r, o.e, o.parse_error) for o in out} == set(rows)


def test_repeated_symbols_keep_every_row(spark):
    df = spark.createDataFrame([("NSE:NIFTY2510923000CE", i) for i in range(50)], "fyers_symbol string, n int")
    out = symbols.parse(df, registry.builtin_roots(spark), YEARS)
    assert out.count() == 50 and out.select("root").distinct().count() == 1
