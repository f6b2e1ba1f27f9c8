from __future__ import annotations

import random
from datetime import date, datetime, timedelta
from decimal import Decimal

from tickloom.operators import asof, chain

T0 = datetime(2024, 1, 1)


def build(spark, seed=3, points=300, asks=400):
    """One key holds most of both sides; one key has no points at all."""
    rng = random.Random(seed)
    right = {}
    for _ in range(points):
        key = 1 if rng.random() < 0.6 else rng.randint(2, 4)
        right[key, T0 + timedelta(seconds=rng.randint(0, 10 * 86400))] = rng.randint(0, 1000)
    left = []
    for i in range(asks):
        key = 1 if rng.random() < 0.6 else rng.randint(2, 5)
        moment = rng.choice(list(right))[1] if rng.random() < 0.3 else T0 + timedelta(seconds=rng.randint(-86400, 12 * 86400))
        left.append((i, key, None if rng.random() < 0.05 else moment))
    l = spark.createDataFrame(left, "id int, k int, at timestamp_ntz")
    r = spark.createDataFrame([(k, t, v) for (k, t), v in right.items()], "k int, ts timestamp_ntz, v int")
    return left, right, l, r


def brute(left, right, inclusive):
    out = {}
    for i, k, at in left:
        hits = [(t, v) for (rk, t), v in right.items() if at is not None and rk == k and (t <= at if inclusive else t < at)]
        out[i] = max(hits) if hits else (None, None)
    return out


def test_matches_brute_force_for_every_bucket_size(spark):
    left, right, l, r = build(spark)
    for inclusive in (True, False):
        want = brute(left, right, inclusive)
        for bucket in (3600, 86400, 10**9):
            got = asof.asof_backward(l, r, ["k"], "at", "ts", ["v"], bucket_seconds=bucket, inclusive=inclusive).collect()
            assert len(got) == len(left)
            assert {x.id: (x.matched_ts, x.v) for x in got} == want


def test_a_null_value_is_a_value(spark):
    l = spark.createDataFrame([(1, 1, T0 + timedelta(hours=2))], "id int, k int, at timestamp_ntz")
    r = spark.createDataFrame([(1, T0, 5), (1, T0 + timedelta(hours=1), None)], "k int, ts timestamp_ntz, v int")
    row = asof.asof_backward(l, r, ["k"], "at", "ts", ["v"]).first()
    assert row.v is None and row.matched_ts == T0 + timedelta(hours=1)


def test_no_window_spans_a_whole_key(spark):
    """The plan shuffles moments by (key, bucket); only one row per bucket is ordered by key alone. Nothing is
    joined to find a match; the one join brings it back to the asks of its moment, by equality."""
    _, _, l, r = build(spark)
    plan = asof._matched(l.select("k", "at").distinct(), r, ["k"], "at", "ts", ["v"], asof.DAY, True)
    plan = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan and "Join" not in plan
    whole = asof.asof_backward(l, r, ["k"], "at", "ts", ["v"])._jdf.queryExecution()
    joins = [line for line in whole.optimizedPlan().toString().splitlines() if "Join" in line]
    assert len(joins) == 1 and "LeftOuter" in joins[0] and "at#" in joins[0] and " = _k_at#" in joins[0]
    assert "NestedLoop" not in whole.executedPlan().toString() and "Cartesian" not in whole.executedPlan().toString()


def test_a_moment_that_most_asks_share_is_matched_once(spark):
    points = spark.range(1000).selectExpr("1 AS k", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id) AS ts", "id AS v")
    asks = spark.range(20_000).selectExpr(
        "id", "1 AS k", "timestamp_ntz'2024-01-01 10:00:30' + make_interval(0, 0, 0, 0, 0, IF(id % 10 = 0, id div 10 % 700, 0)) AS at"
    ).union(spark.createDataFrame([(-1, None, None), (-2, 1, None)], "id long, k int, at timestamp_ntz"))
    got = asof.asof_backward(asks, points, ["k"], "at", "ts", ["v"], bucket_seconds=asof.HOUR)
    moments = asks.select("k", "at").distinct()
    once = asof._matched(moments, points, ["k"], "at", "ts", ["v"], asof.HOUR, True)
    assert once.count() == moments.where("at IS NOT NULL").count() == 700
    rows = {r.id: r.v for r in got.collect()}
    assert len(rows) == 20_002 and rows[-1] is None and rows[-2] is None
    assert all(rows[i] == 600 + (i // 10 % 700 if i % 10 == 0 else 0) if (i // 10 % 700 if i % 10 == 0 else 0) < 400 else rows[i] == 999 for i in range(20_000))


def test_the_nearest_strike_is_that_of_brute_force_and_no_spot_meets_the_whole_ladder(spark):
    rng = random.Random(5)
    day = date(2024, 1, 25)
    # Strikes of two chains across many buckets of the strike line; the third has none.
    strikes = {1: [Decimal(10 * i + 5) for i in range(1200)], 2: [Decimal("0.0500"), Decimal(2500), Decimal(9000)]}
    spots = [(u, Decimal(rng.randint(0, 1_400_000)) / 100) for u in (1, 2, 3) for _ in range(60)]
    spots += [(1, Decimal(10)), (1, Decimal(0)), (2, Decimal("5750.0000")), (1, None)]
    contracts = spark.createDataFrame(
        [(u, day, "OPT", s) for u, all_of in strikes.items() for s in all_of for _ in "CP"] + [(1, day, "FUT", None)],
        "underlying_id int, expiry_date date, kind string, strike decimal(12,4)",
    )
    priced = spark.createDataFrame([(u, day, p) for u, p in spots], "underlying_id int, expiry_date date, spot decimal(11,4)")
    found = chain.nearest_strikes(chain.strike_ladder(contracts), priced)
    want = {
        (u, p): min(strikes[u], key=lambda s: (abs(s - p), s)) if u in strikes else None for u, p in spots if p is not None
    }
    assert {(r.underlying_id, r.spot): r.atm_strike for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "CartesianProduct" not in plan
