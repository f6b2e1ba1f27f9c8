from __future__ import annotations

import json
from datetime import datetime
from decimal import Decimal

import pytest

from catalogue import files
from catalogue.base import Tables
from tickloom.sources import envelopes, master_files, payloads

COLUMNS = ["timestamp", "open", "high", "low", "close", "volume", "open_interest"]
ROW = [1742960700, 730.00, 750.00, 645.00, 706.00, 359100, 5131225]


def ingest(spark, columns, rows, s="ok"):
    payload = json.dumps({"s": s, "columns": columns, "candles": rows})
    raw = spark.createDataFrame([(7, 2, payload)], "contract_id int, res_id int, payload string")
    good, bad = envelopes.ingest(raw)
    return good.collect(), bad.collect()


def test_the_documented_row(spark):
    good, bad = ingest(spark, COLUMNS, [ROW])
    assert not bad
    r = good[0]
    assert r.ts == datetime(2025, 3, 26, 9, 15) and r.open == Decimal("730.0000") and r.oi == 5131225
    assert (r.contract_id, r.res_id, r.volume) == (7, 2, 359100)


def test_columns_are_found_by_name_and_unknown_ones_ignored(spark):
    order = ["vwap", "close", "timestamp", "volume", "low", "high", "open"]
    good, bad = ingest(spark, order, [[1, 706.0, 1742960700, 9, 645.0, 750.0, 730.05]])
    assert not bad and good[0].open == Decimal("730.0500") and good[0].close == Decimal("706.0000") and good[0].oi is None


@pytest.mark.parametrize(
    "columns,rows,reason",
    [
        (COLUMNS[:4], [ROW[:4]], "column_missing"),
        ([*COLUMNS, "Close "], [[*ROW, 1]], "column_repeated"),
        (COLUMNS, [ROW, ROW[:5]], "row_too_short"),
        (COLUMNS, [ROW, [ROW[0], 100.12345, *ROW[2:]]], "price_needs_more_decimals"),
        (COLUMNS, [[ROW[0], 10_000_000, *ROW[2:]]], "price_out_of_range"),
        (COLUMNS, [[ROW[0], "NaN", *ROW[2:]]], "price_not_a_number"),
        (COLUMNS, [["soon", *ROW[1:]]], "integer_not_a_number"),
    ],
)
def test_one_unusable_value_refuses_the_envelope(spark, columns, rows, reason):
    good, bad = ingest(spark, columns, rows)
    assert not good and [b.reason for b in bad] == [reason]


def test_a_leading_zero_is_no_json_and_no_derived_envelope_has_one(spark, tmp_path):
    raw = spark.createDataFrame([(7, 2, '{"s":"ok","columns":["volume"],"candles":[[012]]}')], "contract_id int, res_id int, payload string")
    assert [b.reason for b in envelopes.ingest(raw)[1].collect()] == ["undecodable"]
    # A bar without volume on the day whose volumes are too long.
    events = spark.createDataFrame(
        [(1000, datetime(2024, 1, 19, 10), 7, "view", 5.0, '{"k": 3}')],
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert [r.reason for r in files.s2q(Tables(spark, str(tmp_path))).collect()] == ["integer_out_of_range"]


def test_payloads_are_decoded_once(spark):
    raw = spark.range(3).selectExpr("CAST(id AS INT) AS contract_id", "2 AS res_id", "concat('{', id) AS payload")
    for df in (envelopes.ingest(raw)[0], payloads.chain_quotes(raw, ["contract_id"])):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_quotes_need_a_dated_front_and_a_right(spark):
    leg = {"symbol": "A", "option_type": "CE", "strike_price": 5}
    dates = {"good": [{"date": "25-01-2024", "expiry_flag": "W"}], "bad": [{"date": "99-99-2024", "expiry_flag": "W"}], "none": []}
    raw = [(k, json.dumps({"expiryData": d, "optionsChain": [{"symbol": "U", "fp": 7}, leg]})) for k, d in dates.items()]
    raw += [("legless", json.dumps({"expiryData": dates["good"], "optionsChain": []})), ("text", "{"), ("null", None)]
    got = payloads.chain_quotes(spark.createDataFrame(raw, "k string, payload string"), ["k"]).collect()
    assert [(r.k, r.strike, r.fp) for r in got] == [("good", Decimal(5), Decimal(7))]


def test_chain_payloads_are_dealt_out_before_they_grow(spark, tmp_path):
    part = spark.range(40).selectExpr("id AS p_partkey", "'a' AS p_name", "1.0D AS p_retailprice", "CAST(id AS INT) AS p_size")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert files.chain_payloads(Tables(spark, str(tmp_path))).rdd.getNumPartitions() > 1


def test_no_data_is_neither_bars_nor_refused(spark):
    good, bad = ingest(spark, [], [], "no_data")
    assert not good and not bad


MEMBER = {
    "fyToken": "1011", "symTicker": "NSE:A-EQ", "exchange": 10, "segment": 10, "exSeries": "EQ", "exInstType": 0,
    "underSym": "A", "underFyTok": "1011", "optType": "XX", "strikePrice": -1.0, "minLotSize": 1, "tickSize": 0.05,
    "isin": "", "symDetails": "A LTD", "qtyFreeze": "91865", "expiryDate": "", "faceValue": 1.0, "tradingSession": "0915-1530|1815-1915:",
}


@pytest.mark.parametrize("indent", [None, 2])
def test_a_master_file_is_split_between_members(spark, tmp_path, indent):
    option = {**MEMBER, "fyToken": "1012", "optType": "CE", "strikePrice": 2950.5, "expiryDate": "1790676600"}
    lost = {**MEMBER, "fyToken": None}
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"NSE:A-EQ": MEMBER, "NSE:A26SEP2950.5CE": option, "NSE:LOST-EQ": lost}, indent=indent))
    rows, bad = master_files.read(spark, str(path))
    got = {r.symbol_ticker: r for r in rows.collect()}
    assert set(got) == {"NSE:A-EQ", "NSE:A26SEP2950.5CE"}
    assert [(b.symbol_ticker, b.problem) for b in bad.collect()] == [("NSE:LOST-EQ", "token_missing")]
    a, o = got["NSE:A-EQ"], got["NSE:A26SEP2950.5CE"]
    assert (a.strike_price, a.option_type, a.isin, a.expiry_date) == (None, None, None, None)
    assert (o.strike_price, o.option_type, str(o.expiry_date)) == (Decimal("2950.5000"), "CE", "2026-09-29")
    assert a.row_hash != o.row_hash and len(a.row_hash) == 64


@pytest.mark.parametrize(
    "payload,reason",
    [
        (None, "undecodable"), ("<html>502 Bad Gateway</html>", "undecodable"), ('{"s":"ok","columns":["times', "undecodable"),
        ('{"columns":[],"candles":[]}', "undecodable"), ('{"s":"error","message":"x"}', "status_error"),
        ('{"s":"ok"}', "columns_missing"), (json.dumps({"s": "ok", "columns": COLUMNS}), "candles_missing"),
        (json.dumps({"s": "ok", "columns": COLUMNS, "candles": [[*ROW[:5], "9" * 20, 1]]}), "integer_out_of_range"),
        (json.dumps({"s": "ok", "columns": COLUMNS, "candles": [[*ROW[:6], "x"]]}), "open_interest_unusable"),
    ],
)
def test_what_cannot_be_read_is_refused(spark, payload, reason):
    raw = spark.createDataFrame([(7, 2, payload)], "contract_id int, res_id int, payload string")
    good, bad = envelopes.ingest(raw)
    assert not good.collect() and [b.reason for b in bad.collect()] == [reason]


def test_an_empty_answer_is_accepted(spark):
    assert ingest(spark, COLUMNS, []) == ([], [])


def test_no_member_of_a_master_file_is_lost(spark, tmp_path):
    one = json.dumps(MEMBER)
    path = tmp_path / "m"
    path.mkdir()
    brace = json.dumps({**MEMBER, "symDetails": "A }, B", "isin": '} "quoted\\" {"'})
    (path / "spaced.json").write_text('{ "S1": %s ,\n "S2":%s } ' % (one, one))
    (path / "brace.json").write_text('{"B1": %s, "B}\\"2": %s}\n' % (brace, brace))
    (path / "cut.json").write_text('{"C1": %s, "C2": %s' % (one, one[:40]))
    (path / "cut_after.json").write_text('{"D1": %s, "D2": %s\n' % (one, one))
    (path / "cut_in_text.json").write_text('{"E1": %s, "E2": %s' % (one, brace[: brace.index("}") + 1]))
    rows, bad = master_files.read(spark, str(path))
    found = {r.symbol_ticker: (r.symbol_details, r.isin) for r in rows.collect()}
    assert set(found) == {"S1", "S2", "B1", 'B}"2'}
    assert found["B1"] == found['B}"2'] == ("A }, B", '} "quoted\\" {"')
    problems = {(b.file.rsplit("/", 1)[1], b.problem) for b in bad.collect()}
    assert problems == {(f"{name}.json", "file_cut_off") for name in ("cut", "cut_after", "cut_in_text")}


def test_members_are_whole_wherever_the_file_is_split(spark, tmp_path):
    path = tmp_path / "m"
    path.mkdir()
    values = ["}" * (i % 5) + ' "x\\ ' * (i % 3) + "é{" * (i % 4) + "," * (i % 2) for i in range(120)]
    (path / "a.json").write_text(json.dumps({f"T{i}": {**MEMBER, "symDetails": v + "|"} for i, v in enumerate(values)}, ensure_ascii=False))
    whole = {(f"T{i}", (v + "|").strip()) for i, v in enumerate(values)}
    for size in (97, 512, 100_000):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        try:
            rows, bad = master_files.read(spark, str(path))
            assert {(r.symbol_ticker, r.symbol_details) for r in rows.collect()} == whole
            assert bad.count() == 0
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
