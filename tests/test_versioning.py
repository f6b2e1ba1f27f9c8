from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.operators import versioning
from tickloom.sources import master_files


def staged(spark, members):
    """``token -> (segment, lot)`` as staged rows."""
    base = spark.createDataFrame(
        [(t, f"NSE:{t}-EQ", 10, seg, lot) for t, (seg, lot) in members.items()],
        "fytoken string, symbol_ticker string, exchange_code smallint, segment_code smallint, min_lot_size int",
    )
    full = base.select(
        *[F.col(n) if n in base.columns else F.lit(None).cast(t).alias(n) for n, t in schemas.MASTER_COLUMNS]
    )
    return full.withColumn("row_hash", master_files.row_hash())


def state(history):
    return {
        (r.fytoken, str(r.valid_from), r.valid_to and str(r.valid_to), r.min_lot_size) for r in history.collect()
    }


def run(spark, *days):
    history = schemas.empty(spark, schemas.MASTER_HISTORY)
    for as_of, members in days:
        history = versioning.merge(history, staged(spark, members), as_of)
        rows = history.collect()
        history = spark.createDataFrame(rows, schemas.MASTER_HISTORY) if rows else history
        still_open = [r.fytoken for r in rows if r.valid_to is None]
        assert len(still_open) == len(set(still_open))
    return history


A, B = (10, 1), (11, 1)


def test_a_reload_is_quiet_and_a_change_opens_a_version(spark):
    h = run(spark, ("2024-01-01", {"x": A, "y": B}), ("2024-01-02", {"x": A, "y": B}), ("2024-01-03", {"x": (10, 5), "y": B}))
    assert state(h) == {("x", "2024-01-01", "2024-01-03", 1), ("x", "2024-01-03", None, 5), ("y", "2024-01-01", None, 1)}
    asked = spark.createDataFrame([("x", date(2024, 1, d)) for d in (1, 2, 3, 9)], "fytoken string, on_date date")
    got = {r.on_date.day: r.min_lot_size for r in versioning.facts_on(h, asked).collect()}
    assert got == {1: 1, 2: 1, 3: 5, 9: 5}


def test_only_segments_the_file_carries_are_closed(spark):
    h = run(spark, ("2024-01-01", {"x": A, "y": B}), ("2024-01-02", {"z": A}))
    assert state(h) == {("x", "2024-01-01", "2024-01-02", 1), ("y", "2024-01-01", None, 1), ("z", "2024-01-02", None, 1)}


def test_a_relisted_member_reopens(spark):
    h = run(spark, ("2024-01-01", {"x": A, "z": A}), ("2024-01-02", {"z": A}), ("2024-01-05", {"x": A, "z": A}))
    assert ("x", "2024-01-05", None, 1) in state(h) and ("x", "2024-01-01", "2024-01-02", 1) in state(h)


def test_a_same_day_change_amends_and_a_same_day_replay_changes_nothing(spark):
    day1 = ("2024-01-01", {"x": A})
    h = run(spark, day1, ("2024-01-01", {"x": (10, 9)}))
    assert state(h) == {("x", "2024-01-01", None, 9)}
    twice = run(spark, day1, ("2024-01-02", {"x": (10, 2)}), ("2024-01-02", {"x": (10, 2)}))
    assert state(twice) == {("x", "2024-01-01", "2024-01-02", 1), ("x", "2024-01-02", None, 2)}


def test_a_vanished_member_opened_today_stays_open(spark):
    h = run(spark, ("2024-01-01", {"x": A, "z": A}), ("2024-01-01", {"z": A}))
    assert ("x", "2024-01-01", None, 1) in state(h)
