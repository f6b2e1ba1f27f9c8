from __future__ import annotations

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest

from pyspark.sql import functions as F

from catalogue import state
from catalogue.base import Tables
from tickloom import schemas
from tickloom.operators import calendar, catalog, chain, ids, intervals, quality, requestlog, writes
from tickloom.plans import backfill

EXPIRY = date(2025, 3, 27)
NOW = "2025-09-10 12:00:00"
STRIKES = (22900, 23000, 23100)


def world(spark, exchange="NSE", life=200, data_from=date(2022, 1, 3), sealed=()):
    underlyings = spark.createDataFrame(
        [(1, exchange, data_from, life, 120, 1, "NSE:NIFTY50-INDEX")],
        "underlying_id int, exchange string, data_from date, option_life_days int, future_life_days int, spot_contract_id int, fyers_symbol string",
    )
    rows = [
        (1024 + i, 1, EXPIRY, "OPT", Decimal(s), r, datetime(2025, 4, 1) if 1024 + i in sealed else None)
        for i, (s, r) in enumerate((s, r) for s in STRIKES for r in ("CE", "PE"))
    ]
    contracts = spark.createDataFrame(
        rows, "contract_id int, underlying_id int, expiry_date date, kind string, strike decimal(12,4), option_type string, sealed_at timestamp_ntz"
    )
    none = spark.createDataFrame([], "exchange string, holiday_date date"), spark.createDataFrame([], "exchange string, trade_date date")
    days = calendar.day_table(underlyings, "2021-12-01", "2025-12-31", *none)
    return underlyings, contracts, days


def ledger(spark, rows):
    return spark.createDataFrame(rows, "contract_id int, res_id smallint, range_from date, range_to date, status string, row_count bigint")


def walk(spark, held=(), resolutions=("1",), **kw):
    sheet = backfill.Sheet(now=NOW, resolutions=resolutions, **{k: v for k, v in kw.items() if k in backfill.Sheet.__dataclass_fields__})
    underlyings, contracts, days = world(spark, **{k: v for k, v in kw.items() if k in ("exchange", "life", "data_from", "sealed")})
    typical = spark.createDataFrame([], "underlying_id int, res_id smallint, typical bigint")
    sessions = spark.createDataFrame([], "exchange string, session_seconds bigint")
    tasks = backfill.plan_contracts(contracts, underlyings, ledger(spark, list(held)), days, typical, sessions, sheet)
    got = tasks.collect()
    emitted = sorted((r.contract_id, r.chunk_from, r.chunk_to) for r in got if r.outcome == "emit")
    return emitted, sum(r.outcome == "skip" for r in got)


NEWEST = (EXPIRY - timedelta(days=99), EXPIRY)
ALL = [1024 + i for i in range(6)]


def test_a_fresh_contract_takes_one_chunk_ending_on_its_expiry(spark):
    assert walk(spark) == ([(c, *NEWEST) for c in ALL], 0)


def test_floors_and_lives_clamp_the_window(spark):
    assert {e[1] for e in walk(spark, data_from=date(2025, 1, 15))[0]} == {date(2025, 1, 15)}
    assert {e[1:] for e in walk(spark, life=10)[0]} == {(EXPIRY - timedelta(days=10), EXPIRY)}
    got = walk(spark, range_from="2025-03-01", range_to="2025-03-20")[0]
    assert {e[1:] for e in got} == {(date(2025, 3, 1), date(2025, 3, 20))}


def test_held_chunks_are_skipped_and_move_the_probe_back(spark):
    held = [(1024, 2, *NEWEST, "ok", 10)]
    emitted, skipped = walk(spark, held)
    assert skipped == 1 and emitted[0] == (1024, NEWEST[0] - timedelta(days=100), NEWEST[0] - timedelta(days=1))
    partly = [(1024, 2, NEWEST[0], EXPIRY - timedelta(days=5), "ok", 10)]
    assert walk(spark, partly) == ([(c, *NEWEST) for c in ALL], 0)
    failed = [(1024, 2, *NEWEST, "error", 0)]
    assert walk(spark, failed) == ([(c, *NEWEST) for c in ALL], 0)


def test_an_empty_chunk_ends_the_walk(spark):
    emitted, skipped = walk(spark, [(1024, 2, *NEWEST, "empty", 0)])
    assert [e[0] for e in emitted] == ALL[1:] and skipped == 1


def test_without_probing_every_chunk_of_the_life_is_emitted(spark):
    assert len(walk(spark, probe_backward=False)[0]) == 6 * 3


def test_sealed_contracts_drop_out_unless_forced(spark):
    assert [e[0] for e in walk(spark, sealed=(1024, 1025))[0]] == ALL[2:]
    held = [(c, 2, EXPIRY - timedelta(days=400), EXPIRY, "ok", 1) for c in ALL]
    assert len(walk(spark, held, sealed=(1024,), force_refresh=True)[0]) == 6


def test_seconds_outside_the_window_plan_nothing_and_unknown_codes_are_named(spark):
    assert walk(spark, resolutions=("5S",)) == ([], 0)
    with pytest.raises(ValueError, match="7M"):
        walk(spark, resolutions=("7M",))


def test_strike_scopes_keep_futures(spark):
    _, contracts, _ = world(spark)
    future = contracts.limit(1).selectExpr("2000 AS contract_id", "underlying_id", "expiry_date", "'FUT' AS kind", "CAST(NULL AS DECIMAL(12,4)) AS strike", "CAST(NULL AS STRING) AS option_type", "sealed_at")
    both = contracts.unionByName(future)
    spots = spark.createDataFrame([(1, EXPIRY, Decimal("22950"))], "underlying_id int, expiry_date date, spot decimal(11,4)")
    band = chain.strike_scope(both, "band", spots=spots, steps=0).collect()
    assert sorted((r.kind, r.strike and int(r.strike)) for r in band) == [("FUT", None), ("OPT", 22900), ("OPT", 22900)]
    kept = backfill.scope_contracts(both, "BOTH", ["CE"]).collect()
    assert sum(r.kind == "FUT" for r in kept) == 1 and all(r.option_type in (None, "CE") for r in kept)


def test_ids_are_disjoint_ordered_and_stable(spark):
    expiries = schemas.empty(spark, schemas.EXPIRY)
    counts = spark.createDataFrame([(2, date(2025, 1, 2), 10), (1, date(2025, 2, 6), 1500), (1, date(2025, 1, 2), 0)], "underlying_id int, expiry_date date, contract_count int")
    blocks = ids.allocate_blocks(expiries, counts)
    got = [(r.contract_id_lo, r.contract_id_hi) for r in blocks.orderBy("underlying_id", "expiry_date").collect()]
    assert got == [(1024, 2047), (2048, 4095), (4096, 5119)]
    batch = spark.createDataFrame(
        [(2, date(2025, 1, 2), s, k, Decimal(p) if p else None, r, None) for s, k, p, r in [("c", "OPT", "20", "PE"), ("b", "OPT", "20", "CE"), ("a", "OPT", "100", "CE"), ("f", "FUT", None, None)]],
        "underlying_id int, expiry_date date, fyers_symbol string, kind string, strike decimal(12,4), option_type string, instrument_class string",
    )
    nobody = spark.createDataFrame([], "fyers_symbol string, contract_id int")
    first = {r.fyers_symbol: r.contract_id for r in ids.assign(batch, blocks, nobody).collect()}
    assert first == {"f": 4096, "b": 4097, "c": 4098, "a": 4099}
    more = batch.unionByName(batch.where("fyers_symbol = 'b'").withColumn("fyers_symbol", F.lit("b2")))
    held = spark.createDataFrame(list(first.items()), "fyers_symbol string, contract_id int")
    second = {r.fyers_symbol: r.contract_id for r in ids.assign(more, blocks, held).collect()}
    assert second == {**first, "b2": 4100}


def test_symbols_beyond_a_full_block_are_named_and_not_listed_as_assigned(spark, tmp_path):
    # 4,500 legs a block of 4,096 slots, as the tables give them at 60 times sf0.1.
    events = spark.range(45_000).selectExpr("id AS event_id", "timestamp_ntz'2024-01-02 10:00:00' AS ts", "id AS user_id", "'view' AS event_type", "1.0D AS value", "'{}' AS props")
    events.write.parquet(f"{tmp_path}/events.parquet")
    t = Tables(spark, str(tmp_path))
    given = [r.contract_id for r in state.w7(t).select("contract_id").collect()]
    assert None not in given and len(given) == len(set(given)) == 10 * 4096
    assert ids.unplaced(state.assigned(t)).count() == 45_000 - 5 - 10 * 4096


def test_free_ids_lie_in_the_gaps_between_kept_ones(spark):
    import random

    rng = random.Random(6)
    blocks = [(1, date(2025, 1, 2), 1024, 1024 + 199), (1, date(2025, 1, 9), 2048, 2048 + (1 << 20) - 1), (2, date(2025, 1, 2), 9, 11)]
    spans = {(u, e): (lo, hi) for u, e, lo, hi in blocks}
    names = [(u, e, f"{u}{e}{i:03}") for (u, e), n in zip(spans, (180, 150, 5)) for i in range(n)]
    held = {}
    for (u, e), (lo, hi) in spans.items():
        mine = [n for a, b, n in names if (a, b) == (u, e)]
        taken = rng.sample(range(lo, min(hi, lo + 300) + 1), min(len(mine) // 2, hi - lo + 1))
        held |= dict(zip(rng.sample(mine, len(taken)), taken))
    held[names[0][2]] = 5
    batch = spark.createDataFrame([(*n, "OPT", "XX", Decimal(1), "CE") for n in names], "underlying_id int, expiry_date date, fyers_symbol string, kind string, instrument_class string, strike decimal(12,4), option_type string")
    df = ids.assign(
        batch, spark.createDataFrame(blocks, "underlying_id int, expiry_date date, contract_id_lo bigint, contract_id_hi bigint"),
        spark.createDataFrame(list(held.items()), "fyers_symbol string, contract_id int"),
    )
    got = {r.fyers_symbol: r.contract_id for r in df.collect()}
    want = {}
    for (u, e), (lo, hi) in spans.items():
        mine = sorted(n for a, b, n in names if (a, b) == (u, e))
        kept = {n: held[n] for n in mine if lo <= held.get(n, -1) <= hi}
        free = iter(sorted(set(range(lo, min(hi, lo + 999) + 1)) - set(kept.values())))
        want |= {n: kept[n] if n in kept else next(free, None) for n in mine}
    assert got == want
    assert "sequence(" not in df._jdf.queryExecution().analyzed().toString()


def test_an_overflowing_block_moves_behind_the_last_one(spark):
    recorded = spark.createDataFrame([(1, date(2025, 1, 2), 1024, 2047), (1, date(2025, 1, 9), 2048, 3071)], "underlying_id int, expiry_date date, contract_id_lo int, contract_id_hi int")
    counts = spark.createDataFrame([(1, date(2025, 1, 2), 1025), (1, date(2025, 1, 9), 900)], "underlying_id int, expiry_date date, contract_count int")
    got = {str(r.expiry_date): (r.outcome, r.contract_id_lo, r.contract_id_hi) for r in ids.allocate_blocks(recorded, counts).collect()}
    assert got == {"2025-01-02": ("relocated", 3072, 5119), "2025-01-09": ("reused", 2048, 3071)}


def test_overlap_count_equals_the_pairs(spark):
    import random

    rng = random.Random(5)
    blocks = [(i, a, a + rng.randint(0, 5000)) for i in range(120) for a in [rng.randint(0, 200_000)]]
    blocks += [(1000 + i, 50_000, 50_400) for i in range(60)]
    blocks += [(2000, 50_400, 50_400), (2001, 0, 210_000), (2002, 50_401, 50_401), (2003, 50_401, 50_401)]
    df = spark.createDataFrame(blocks, "expiry_id int, contract_id_lo int, contract_id_hi int")
    want = sum(a[1] <= b[2] and b[1] <= a[2] for i, a in enumerate(blocks) for b in blocks[i + 1 :])
    assert quality.overlap_count(df, stretch=7_000).first().offending == want
    pairs = {(min(a[0], b[0]), max(a[0], b[0])) for i, a in enumerate(blocks) for b in blocks[i + 1 :] if a[1] <= b[2] and b[1] <= a[2]}
    for stretch in (1 << 22, 7_000):
        found = [tuple(r) for r in quality.overlapping_blocks(df, stretch).collect()]
        assert len(found) == want and set(found) == pairs


def test_deviating_cursor_pages_cover_every_row_once(spark):
    rows = [(i, "OPT", Decimal(i * 7 % 5) if i % 6 else None) for i in range(1, 40)]
    listed = spark.createDataFrame(rows, "contract_id int, kind string, strike decimal(12,4)").withColumn("rows", F.lit(0))
    for descending in (False, True):
        seen, after = [], None
        while True:
            page = catalog.contract_page(listed, F.lit(True), "strike", descending, after, 7)
            order = [F.desc_nulls_first("strike"), F.desc("contract_id")] if descending else [F.asc_nulls_last("strike"), F.asc("contract_id")]
            got = page.orderBy(*order).collect()
            seen += [r.contract_id for r in got]
            if not got[-1].has_more:
                break
            after = (got[-1].strike, got[-1].contract_id)
        assert sorted(seen) == list(range(1, 40)) and len(seen) == 39
    with pytest.raises(ValueError):
        catalog.contract_page(listed, F.lit(True), "lot_size")


def test_outcome_precedence(spark):
    rows = [("no_data", -429, 429), ("error", -8, 429), ("error", -8, 401), ("error", -8, 500), ("error", None, 503), ("error", -7, 599), ("error", -7, 418), ("ok", 0, 200)]
    got = requestlog.classify(spark.createDataFrame(rows, "status string, code int, http_status int")).collect()
    assert [r.retry_class for r in got] == ["empty", "rate_limited", "auth_fatal", "auth_recoverable", "transient", "transient", "fatal"]


def test_short_batches_never_remove_contracts(spark):
    current = spark.createDataFrame([(1, "a", datetime(2024, 1, 1)), (2, "b", datetime(2024, 1, 1))], "contract_id int, fyers_symbol string, first_seen_at timestamp_ntz")
    batch = spark.createDataFrame([(2, "b"), (3, "c")], "contract_id int, fyers_symbol string")
    full = current.withColumn("last_seen_at", F.col("first_seen_at"))
    got = {r.fyers_symbol: (r.contract_id, r.first_seen_at) for r in writes.upsert_contracts(full, batch, "2024-06-01 00:00:00").collect()}
    assert got == {"a": (1, datetime(2024, 1, 1)), "b": (2, datetime(2024, 1, 1)), "c": (3, datetime(2024, 6, 1))}


def test_reversed_ranges_are_reported(spark):
    df = spark.createDataFrame([(date(2024, 1, 2), date(2024, 1, 1)), (date(2024, 1, 1), date(2024, 1, 1))], "range_from date, range_to date")
    assert intervals.reversed_ranges(df).count() == 1
