"""Bar reads: windows, projections, clamps, paging and hygiene.

Single reads take literals, so the filter reaches the Parquet scan. Many reads at once take a
request table and become one equi-join with the window as a residual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import clock, folders, money, rows
from tickloom.operators import asof

PRICES = ["open", "high", "low", "close"]
MAX_BARS_PER_ANSWER = 500_000
DEFAULT_BEFORE = 500
DEFAULT_RESOLUTION = "1"


def window(candles: DataFrame, contract_id: int, res_id: int, start: str, end: str) -> DataFrame:
    """Bars of one series in the half-open ``[start, end)``, ascending."""
    return (
        folders.of_months(folders.of_series(candles, contract_id), start, end).where(
            (F.col("contract_id") == contract_id)
            & (F.col("res_id") == res_id)
            & (F.col("ts") >= clock.ntz(start))
            & (F.col("ts") < clock.ntz(end))
        )
        .select("ts", *PRICES, "volume", "oi")
        .orderBy("ts")
    )


def windows(candles: DataFrame, requests: DataFrame) -> DataFrame:
    """Bars of many ``(request_id, contract_id, res_id, start_ts, end_ts)`` windows.

    Windows are laid on the days they touch and the day joins the key, so a bar meets only the
    windows of its own day and a series with very many bars is spread over its days.
    """
    last_moment = F.timestamp_add("MICROSECOND", F.lit(-1), F.col("end_ts"))
    by_day = requests.where("end_ts > start_ts").withColumn(
        "_day", F.explode(F.sequence(F.to_date("start_ts"), F.to_date(last_moment)))
    )
    by_day, more = folders.keyed(candles, by_day, "_day")
    return (
        candles.withColumn("_day", F.to_date("ts"))
        .join(by_day, ["contract_id", "res_id", "_day", *more])
        .where((F.col("ts") >= F.col("start_ts")) & (F.col("ts") < F.col("end_ts")))
        .drop("_day", *more)
    )


def project(bars: DataFrame, include_oi: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Outgoing shape: UTC seconds and DOUBLE prices; ``oi`` is left out unless asked for."""
    return bars.select(
        *(keep or []),
        clock.utc_seconds(F.col("ts")).alias("timestamp"),
        *[money.as_double(F.col(p)).alias(p) for p in PRICES],
        "volume",
        *(["oi"] if include_oi else []),
    )


def oi_points(candles: DataFrame) -> DataFrame:
    """Open-interest points of every series; a bar without open interest is not a point."""
    return candles.where("oi IS NOT NULL").select(
        "contract_id", "res_id", clock.utc_seconds(F.col("ts")).alias("timestamp"), "oi"
    )


def clamp(requests: DataFrame, bounds: DataFrame) -> DataFrame:
    """Slide each requested window into what the series holds, keeping its span.

    Requests carry nullable ``from_ts``/``to_ts`` in UTC seconds; ``bounds`` is one row per series.
    A window wholly left of the data stays as asked and answers nothing.
    """
    known = requests.join(
        bounds.select(
            "contract_id",
            "res_id",
            clock.utc_seconds(F.col("first_ts")).alias("_first"),
            clock.utc_seconds(F.col("last_ts")).alias("_last"),
        ),
        ["contract_id", "res_id"],
        "left",
    )
    asked_from, asked_to = F.col("from_ts"), F.col("to_ts")
    first, last = F.col("_first"), F.col("_last")
    end = F.least(asked_to, last)
    start = F.greatest(first, end - F.greatest(asked_to - asked_from, F.lit(1)))
    untouched = first.isNull() | (asked_to < first)
    whole = asked_from.isNull() | asked_to.isNull()

    def pick(given: Column, full: Column, slid: Column) -> Column:
        return F.when(first.isNull(), given).when(whole, full).when(untouched, given).otherwise(slid)

    moved = (
        F.when(first.isNull(), F.lit(False))
        .when(whole, asked_from.isNotNull() | asked_to.isNotNull())
        .when(untouched, F.lit(False))
        .otherwise((start != asked_from) | (end != asked_to))
    )
    return known.select(
        *[c for c in requests.columns if c not in ("from_ts", "to_ts")],
        pick(asked_from, first, start).alias("from_ts"),
        pick(asked_to, last, end).alias("to_ts"),
        moved.alias("clamped"),
    )


def as_store_windows(clamped: DataFrame) -> DataFrame:
    """Clamped UTC windows to half-open IST windows; ``to`` names a bar that is expected back."""
    return clamped.select(
        *[c for c in clamped.columns if c not in ("from_ts", "to_ts")],
        clock.ist_from_utc_seconds(F.col("from_ts")).alias("start_ts"),
        clock.ist_from_utc_seconds(F.col("to_ts") + 1).alias("end_ts"),
    )


def daily_counts(candles: DataFrame) -> DataFrame:
    """Bars of each series and day, as ``(contract_id, res_id, day, n)``."""
    return candles.groupBy("contract_id", "res_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


def running_counts(daily: DataFrame) -> DataFrame:
    """Daily counts with the bars of the series up to the day (``through``) and ``before`` it, a
    window over the calendar; ``at`` is the day as a moment."""
    so_far = F.sum("n").over(Window.partitionBy("contract_id", "res_id").orderBy("day"))
    counted = daily.withColumn("through", so_far.cast("bigint"))
    return counted.withColumns({"before": F.col("through") - F.col("n"), "at": clock.midnight(F.col("day"))})


def _counted_before(asks: DataFrame, counts: DataFrame, moment: str, name: str) -> DataFrame:
    """``asks`` with the bars of their series on days before ``moment``, a midnight."""
    found = asof.asof_backward(
        asks, counts, ["contract_id", "res_id"], moment, "at", ["through"], bucket_seconds=366 * asof.DAY, inclusive=False
    )
    return found.withColumn(name, F.coalesce("through", F.lit(0))).drop("through", "matched_ts")


def range_cap(
    candles: DataFrame, requests: DataFrame, maximum: int = MAX_BARS_PER_ANSWER, daily: DataFrame | None = None
) -> DataFrame:
    """Bars available per request and whether that is more than one answer may carry.

    Whole days are the difference of two running counts of ``daily`` (``daily_counts``, kept beside
    the bars where there are many). Bars are read for the days that a request begins or ends inside
    of, two at most.
    """
    counts = running_counts(daily_counts(candles) if daily is None else daily)
    first, last = (clock.midnight(F.to_date(c)) for c in ("start_ts", "end_ts"))
    next_day = F.when(F.col("start_ts") == first, first).otherwise(clock.midnight(F.date_add(F.to_date("start_ts"), 1)))
    asked = requests.select("request_id", "contract_id", "res_id", "start_ts", "end_ts").where("end_ts > start_ts")
    asked = asked.withColumns({"_from": next_day, "_to": last})
    whole = asked.where("_from < _to")
    for moment, name in (("_from", "_n_from"), ("_to", "_n_to")):
        whole = _counted_before(whole, counts, moment, name)
    inside = whole.select("request_id", (F.col("_n_to") - F.col("_n_from")).alias("n"))
    edges = F.array(
        F.struct(F.col("start_ts").alias("a"), F.least("_from", "end_ts").alias("b")),
        F.struct(F.greatest("_to", "start_ts", F.when(F.col("_from") > F.col("_to"), F.col("end_ts"))).alias("a"), F.col("end_ts").alias("b")),
    )
    parts = asked.select("request_id", "contract_id", "res_id", F.inline(edges)).where("a < b")
    edge_bars = windows(candles, parts.withColumnsRenamed({"a": "start_ts", "b": "end_ts"}))
    counted = inside.unionByName(edge_bars.select("request_id", F.lit(1).cast("bigint").alias("n")))
    counted = counted.groupBy("request_id").agg(F.sum("n").alias("n"))
    available = F.coalesce("n", F.lit(0))
    return requests.join(counted, "request_id", "left").select(
        "request_id",
        available.cast("bigint").alias("available"),
        (available > maximum).alias("too_large"),
    )


def before(
    candles: DataFrame, contract_id: int, res_id: int, ts: str, count: int = DEFAULT_BEFORE
) -> DataFrame:
    """The last ``count`` bars before a moment, oldest first. The reverse limit is a top-k."""
    wanted = rows.at_least_one(count)
    return (
        folders.of_months(folders.of_series(candles, contract_id), last=ts).where(
            (F.col("contract_id") == contract_id)
            & (F.col("res_id") == res_id)
            & (F.col("ts") < clock.ntz(ts))
        )
        .select("ts", *PRICES, "volume", "oi")
        .orderBy(F.desc("ts"))
        .limit(wanted)
        .orderBy("ts")
    )


def before_each(
    candles: DataFrame, requests: DataFrame, count: int = DEFAULT_BEFORE, daily: DataFrame | None = None
) -> DataFrame:
    """``before`` for many ``(request_id, contract_id, res_id, before_ts)`` at once.

    Bars are counted per day first (``daily``, as in ``range_cap``). The running count says how many
    bars come before a request's day; looked up the other way round, it says on which day the bar
    ``count`` places earlier lies. Only the window from there is read and ranked.
    """
    wanted = rows.at_least_one(count)
    series = ["contract_id", "res_id"]
    counts = running_counts(daily_counts(candles) if daily is None else daily)
    asked = requests.select("request_id", *series, "before_ts", clock.midnight(F.to_date("before_ts")).alias("_day"))
    placed = _counted_before(asked, counts, "_day", "_at")
    placed = placed.withColumn("_at", F.greatest(F.col("_at") - wanted, F.lit(0)))
    found = asof.asof_backward(placed, counts, series, "_at", "before", ["day"], bucket_seconds=1 << 20, matched_ts="_before")
    bounded = found.where("day IS NOT NULL").select(
        "request_id", *series, "before_ts", clock.midnight(F.col("day")).alias("start_ts"), F.col("before_ts").alias("end_ts")
    )
    ranked = windows(candles, bounded).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("ts")))
    )
    return ranked.where(F.col("_rank") <= wanted).drop("_rank", "start_ts", "end_ts")


def resolve_resolutions(requests: DataFrame, resolutions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(code, interval)`` pairs to resolution rows; returns (resolved, unknown).

    The vendor code wins over the chart interval, a bare unit means one of it, upper-case ``M`` is
    a calendar month and is refused, and nothing given means one minute.
    """
    token = F.trim("interval")
    interval = (
        F.when(token.isin("", "M"), F.lit(None))
        .when(F.lower(token).isin("s", "m", "h", "d", "w"), F.concat(F.lit("1"), F.lower(token)))
        .otherwise(F.lower(token))
    )
    code = F.upper(F.trim("code"))
    has_code = code.isNotNull() & (code != "")
    has_interval = F.col("interval").isNotNull() & (F.col("interval") != "")
    keyed = requests.withColumn(
        "_key",
        F.when(has_code, F.concat(F.lit("code:"), code))
        .when(has_interval, F.concat(F.lit("interval:"), interval))
        .otherwise(F.lit(f"code:{DEFAULT_RESOLUTION}")),
    )
    fields = ["res_id", "fyers_code", "chart_interval", "seconds"]
    by_code = F.concat(F.lit("code:"), F.upper("fyers_code"))
    by_interval = F.concat(F.lit("interval:"), F.lower("chart_interval"))
    # 30 rows of fixed values: the only table broadcast by hand.
    lookup = F.broadcast(
        resolutions.select(by_code.alias("_key"), *fields).unionByName(
            resolutions.select(by_interval.alias("_key"), *fields)
        )
    )
    joined = keyed.join(lookup, "_key", "left").drop("_key")
    return joined.where("res_id IS NOT NULL"), joined.where("res_id IS NULL").drop(*fields)


def hygiene(raw: DataFrame, series: list[str]) -> DataFrame:
    """Drawable bars from ``series, arrival, time, open..close, volume`` doubles.

    Rows with a non-finite required field go, time becomes an integer, and one bar per time stays:
    the last to arrive. The pick aggregates map-side rather than ranking a whole series.
    """

    def finite(name: str) -> Column:
        value = F.col(name)
        return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))

    required = [finite(c) for c in ["time", *PRICES]]
    kept = raw
    for condition in required:
        kept = kept.where(condition)
    kept = kept.withColumn("time", F.floor("time").cast("bigint")).withColumn(
        "volume", F.when(finite("volume"), F.col("volume"))
    )
    return rows.latest_per_key(kept, [*series, "time"], [F.col("arrival")]).drop("arrival")


def spot_series(candles: DataFrame, underlyings: DataFrame) -> DataFrame:
    """Each underlying's own bars, found through its spot contract id."""
    own = underlyings.select("underlying_id", F.col("spot_contract_id").alias("contract_id"))
    own, more = folders.keyed(candles, own)
    return candles.join(own, ["contract_id", *more]).drop(*more)
