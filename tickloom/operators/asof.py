"""Backward as-of matching without a theta join.

Asks are reduced to their distinct moments first and joined back to the match, so a moment that most
of them share is matched once. Moments and right rows are laid on one time line per key and each
moment takes the last right row at or before it. A key can hold a large share of all rows, so the
line is cut into time buckets: the window runs per (key, bucket), and every bucket is opened by the
last right row of the buckets before it. Those openers come from one aggregated row per (key,
bucket), a number bounded by the calendar rather than by the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions import clock, folders

DAY = 86400
HOUR = 3600


def _bucket(df: DataFrame, column: str, width: int) -> Column:
    """The bucket of a moment, ``width`` in seconds, or of a whole number."""
    is_number = isinstance(df.schema[column].dataType, T.IntegralType)
    place = F.col(column) if is_number else clock.local_seconds(F.col(column))
    return F.floor(place / width).cast("bigint")


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    values: Sequence[str],
    *,
    bucket_seconds: int = DAY,
    inclusive: bool = True,
    matched_ts: str = "matched_ts",
) -> DataFrame:
    """Every left row with ``values`` of the last right row at or before it (nulls when none).

    ``right`` must be unique on (keys, right_ts). Both sides are moments or both whole numbers. With ``inclusive=False`` the match is strictly
    before. Rows whose moment is null match nothing and are kept.
    """
    keys = list(keys)
    moments = left.select(*keys, left_ts).distinct()
    found = _matched(moments, right, keys, left_ts, right_ts, values, bucket_seconds, inclusive)
    # Keys may be null on both sides; a moment that is null matches nothing.
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col(left_ts) == F.col("_k_at")]
    return left.join(found, same, "left").select(
        *[F.col(c) for c in left.columns], F.col("_p._at").alias(matched_ts), *[F.col(f"_p._v_{v}").alias(v) for v in values]
    )


def _matched(
    asked: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, values: Sequence[str],
    bucket_seconds: int, inclusive: bool,
) -> DataFrame:
    """Each distinct moment as (_k_<key>.., _k_at) with ``_p``, the last right row: _at and _v_<value>.."""
    payload = F.struct(
        F.col(right_ts).alias("_at"), *[F.col(v).alias(f"_v_{v}") for v in values]
    )
    points = right.where(F.col(right_ts).isNotNull()).select(
        *keys, _bucket(right, right_ts, bucket_seconds).alias("_b"), payload.alias("_p")
    )
    asks = asked.where(F.col(left_ts).isNotNull()).withColumn("_b", _bucket(asked, left_ts, bucket_seconds))

    # One row per (key, bucket): the last point inside it, columns taken one by one so that the
    # aggregate buffers stay fixed-width.
    at = F.col("_p._at")
    tails = points.groupBy(*keys, "_b").agg(
        F.max(at).alias("_at"),
        *[F.max_by(F.col(f"_p._v_{v}"), at).alias(f"_v_{v}") for v in values],
    )
    tail_struct = F.struct("_at", *[f"_v_{v}" for v in values])
    earlier = (
        Window.partitionBy(*keys).orderBy("_b").rangeBetween(Window.unboundedPreceding, -1)
    )
    openers = (
        tails.select(*keys, "_b", tail_struct.alias("_p"), F.lit(False).alias("_ask"))
        .unionByName(
            asks.select(*keys, "_b")
            .distinct()
            .select(*keys, "_b", F.lit(None).cast(points.schema["_p"].dataType).alias("_p"),
                    F.lit(True).alias("_ask"))
        )
        .withColumn("_p", F.last("_p", ignorenulls=True).over(earlier))
        .where("_ask AND _p IS NOT NULL")
        .select(*keys, "_b", "_p")
    )

    side = 1 if inclusive else -1
    line = (
        points.unionByName(openers)
        .select(*keys, "_b", "_p", at.alias("_t"), F.lit(0).alias("_side"))
        .unionByName(
            asks.select(
                *keys, "_b", F.lit(None).cast(points.schema["_p"].dataType).alias("_p"),
                F.col(left_ts).alias("_t"), F.lit(side).alias("_side"),
            )
        )
    )
    up_to_here = (
        Window.partitionBy(*keys, "_b")
        .orderBy("_t", "_side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    hits = line.withColumn("_p", F.last("_p", ignorenulls=True).over(up_to_here)).where(F.col("_side") != 0)
    return hits.where("_p IS NOT NULL").select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_t").alias("_k_at"), "_p")


def spot_closes(candles: DataFrame, underlyings: DataFrame, res_id: int | None = None) -> DataFrame:
    """``(underlying_id, ts, spot)`` of every underlying's own series."""
    spot = candles if res_id is None else candles.where(F.col("res_id") == res_id)
    own = underlyings.select("underlying_id", F.col("spot_contract_id").alias("contract_id"))
    own, more = folders.keyed(candles, own)
    return spot.join(own, ["contract_id", *more]).select("underlying_id", "res_id", "ts", F.col("close").alias("spot"))


def spot_at(
    candles: DataFrame, underlyings: DataFrame, requests: DataFrame, res_id: int
) -> DataFrame:
    """Last spot close at or before each ``(underlying_id, at_ts)``, with the bar it came from."""
    spot = spot_closes(candles, underlyings, res_id)
    return asof_backward(
        requests, spot, ["underlying_id"], "at_ts", "ts", ["spot"], matched_ts="spot_ts",
        bucket_seconds=HOUR,
    )


def spot_at_one(
    candles: DataFrame, underlyings: DataFrame, underlying_id: int, res_id: int, ts: str
) -> DataFrame:
    """The single-request form: one aggregate over a pruned scan."""
    mine = underlyings.where(F.col("underlying_id") == underlying_id)
    own = spot_closes(folders.of_months(candles, last=ts), mine, res_id).where(F.col("ts") <= clock.ntz(ts))
    return own.agg(
        F.max("ts").alias("ts"), F.max_by("spot", "ts").alias("close")
    ).where("ts IS NOT NULL")


def end_of_day_spot(candles: DataFrame, underlyings: DataFrame, wanted: DataFrame) -> DataFrame:
    """Settlement reference of each ``(underlying_id, expiry_date)``: the last spot close before
    the next midnight at any stored resolution, the finer one on a tie."""
    daily = (
        spot_closes(candles, underlyings)
        .groupBy("underlying_id", "ts")
        .agg(F.min_by("spot", "res_id").alias("spot"))
        .groupBy("underlying_id", clock.midnight(F.to_date("ts")).alias("ts"))
        .agg(F.max_by("spot", "ts").alias("spot"))
    )
    asked = wanted.withColumn("_day", clock.midnight(F.col("expiry_date")))
    return asof_backward(
        asked, daily, ["underlying_id"], "_day", "ts", ["spot"], bucket_seconds=366 * DAY
    ).drop("_day", "matched_ts")


def align_oi(bars: DataFrame, points: DataFrame) -> DataFrame:
    """Each bar with the last external open-interest point at or before it, never a later one."""
    return asof_backward(
        bars, points, ["contract_id"], "ts", "point_ts", ["point_oi"], matched_ts="point_at"
    )


def last_moment(candles: DataFrame, contracts: DataFrame, requests: DataFrame) -> DataFrame:
    """Latest bar of a whole expiry at or before a moment, or its last bar when none is named.

    Requests are ``(request_id, expiry_id, res_id, at_ts)``. Bars are reduced to the distinct
    moments of each expiry before anything is matched.
    """
    moments = (
        candles.join(contracts.where("kind = 'OPT' OR kind = 'FUT'").select("contract_id", "expiry_id"), "contract_id")
        .select("expiry_id", "res_id", "ts")
        .distinct()
    )
    keys = ["expiry_id", "res_id"]
    named = asof_backward(
        requests.where("at_ts IS NOT NULL"), moments, keys, "at_ts", "ts", [], matched_ts="snapped_ts"
    )
    newest = moments.groupBy(*keys).agg(F.max("ts").alias("snapped_ts"))
    open_ended = requests.where("at_ts IS NULL").join(newest, keys, "left")
    return named.unionByName(open_ended.select(*named.columns))
