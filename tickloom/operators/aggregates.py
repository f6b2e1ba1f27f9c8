"""Aggregates over bars and over the coverage ledger. All of them combine map-side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import clock, folders
from tickloom.functions.rows import count_where
from tickloom.schemas import MINUTE_RES_ID


def daily_bars(candles: DataFrame, res_id: int = MINUTE_RES_ID) -> DataFrame:
    """Daily bars from one-minute bars: first open, extremes, last close, last open interest.

    ``min_by``/``max_by`` keep one candidate per group and input partition, so the shuffle carries
    days instead of minutes and a hot series needs no window.
    """
    return (
        candles.where(F.col("res_id") == res_id)
        .groupBy("contract_id", F.to_date("ts").alias("trade_date"))
        .agg(
            F.min_by("open", "ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"),
            F.sum("volume").alias("volume"),
            F.max_by("oi", "ts").alias("oi"),
            F.count("*").alias("bar_count"),
        )
    )


def bounds(candles: DataFrame, *parts: str) -> DataFrame:
    """Rows, first and last bar of each series, or of its part in each of ``parts``; a series
    without bars has no row."""
    return candles.groupBy("contract_id", "res_id", *parts).agg(
        F.count("*").alias("row_count"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def combined_bounds(partials: DataFrame) -> DataFrame:
    """Bounds of each series from those of its parts."""
    return partials.groupBy("contract_id", "res_id").agg(
        F.sum("row_count").alias("row_count"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
    )


def bounds_utc(bounds_table: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Bounds of every series in UTC seconds with the resolution's codes."""
    return bounds_table.join(
        F.broadcast(resolutions.select("res_id", "fyers_code", "chart_interval", "seconds")),
        "res_id",
        "left",
    ).select(
        "contract_id",
        "res_id",
        "fyers_code",
        "chart_interval",
        "seconds",
        clock.utc_seconds(F.col("first_ts")).alias("first_ts"),
        clock.utc_seconds(F.col("last_ts")).alias("last_ts"),
        F.col("row_count").alias("rows"),
    )


def expiry_rollup(contracts: DataFrame) -> DataFrame:
    """Counts, flags and strike extremes of each expiry."""
    rolled = (
        contracts.where("expiry_id IS NOT NULL")
        .groupBy("expiry_id")
        .agg(
            F.count("*").alias("contract_count"),
            count_where(F.col("kind") == "FUT").alias("futures_count"),
            count_where(F.col("kind") == "OPT").alias("options_count"),
            F.min("strike").alias("min_strike"),
            F.max("strike").alias("max_strike"),
        )
    )
    return rolled.withColumn("has_futures", F.col("futures_count") > 0).withColumn(
        "has_options", F.col("options_count") > 0
    )


def strike_step(contracts: DataFrame) -> DataFrame:
    """Most common positive gap between adjacent distinct strikes, the smaller gap on a tie."""
    strikes = (
        contracts.where("kind = 'OPT' AND strike IS NOT NULL")
        .select("expiry_id", "strike")
        .distinct()
    )
    gaps = strikes.withColumn(
        "gap",
        F.col("strike") - F.lag("strike").over(Window.partitionBy("expiry_id").orderBy("strike")),
    ).where("gap > 0")
    return (
        gaps.groupBy("expiry_id", "gap")
        .agg(F.count("*").alias("n"))
        .groupBy("expiry_id")
        .agg(F.min_by("gap", F.struct(-F.col("n"), F.col("gap"))).alias("strike_step"))
    )


def underlying_rollup(expiries: DataFrame) -> DataFrame:
    """First and last expiry, how many, and how many contracts behind them."""
    return expiries.groupBy("underlying_id").agg(
        F.min("expiry_date").alias("first_expiry"),
        F.max("expiry_date").alias("last_expiry"),
        F.count("*").alias("expiry_count"),
        F.coalesce(F.sum("contract_count"), F.lit(0)).alias("contract_count"),
    )


def trading_days(
    candles: DataFrame, underlyings: DataFrame, seeds: DataFrame | None = None,
    res_id: int = MINUTE_RES_ID,
) -> DataFrame:
    """Observed sessions per exchange from spot bars; seeded rows are kept beside them.

    Only spot series are read. Bars are first reduced per series and day, so no exchange is ever counted in one task.
    """
    spot = underlyings.select(F.col("spot_contract_id").alias("contract_id")).distinct()
    spot, more = folders.keyed(candles, spot)
    per_series = (
        candles.where(F.col("res_id") == res_id)
        .join(spot, ["contract_id", *more], "left_semi")
        .groupBy("contract_id", F.to_date("ts").alias("trade_date"))
        .agg(F.min("ts").alias("o"), F.max("ts").alias("c"), F.count("*").alias("n"))
    )
    observed = (
        per_series.join(
            underlyings.select("exchange", F.col("spot_contract_id").alias("contract_id")),
            "contract_id",
        )
        .groupBy("exchange", "trade_date")
        .agg(
            F.min("o").alias("session_open"),
            F.max("c").alias("session_close"),
            F.sum("n").alias("bar_count"),
            F.count("*").alias("contract_count"),
        )
        .withColumn("derived_from", F.lit("spot_bars"))
    )
    if seeds is None:
        return observed
    kept = seeds.where("derived_from <> 'spot_bars'")
    return observed.unionByName(kept.select(*observed.columns))


def typical_rows(coverage: DataFrame, contracts: DataFrame) -> DataFrame:
    """Median rows of successful non-empty chunks per underlying and resolution.

    Equal sizes are counted first, so the exact median reads distinct chunk sizes and weights.
    """
    sizes = (
        coverage.where("status = 'ok' AND row_count > 0")
        .join(contracts.select("contract_id", "underlying_id"), "contract_id")
        .groupBy("underlying_id", "res_id", "row_count")
        .agg(F.count("*").alias("n"))
    )
    median = F.percentile("row_count", F.lit(0.5), F.col("n"))
    return sizes.groupBy("underlying_id", "res_id").agg(
        F.bround(median, 0).cast("bigint").alias("typical")
    )


def longest_session(days: DataFrame) -> DataFrame:
    """Longest observed session of each exchange in seconds."""
    length = clock.local_seconds(F.col("session_close")) - clock.local_seconds(F.col("session_open"))
    return (
        days.where("session_close > session_open")
        .groupBy("exchange")
        .agg(F.max(length).alias("session_seconds"))
    )


def sibling_contract_count(expiries: DataFrame) -> DataFrame:
    """Upper median of the known contract counts of each underlying's discovered expiries."""
    counts = (
        expiries.where("contracts_discovered_at IS NOT NULL AND contract_count > 0")
        .groupBy("underlying_id", "contract_count")
        .agg(F.count("*").alias("n"))
    )
    per_underlying = Window.partitionBy("underlying_id")
    running = counts.withColumn(
        "upto", F.sum("n").over(per_underlying.orderBy("contract_count"))
    ).withColumn("total", F.sum("n").over(per_underlying))
    return (
        running.where(F.col("upto") > F.floor(F.col("total") / 2))
        .groupBy("underlying_id")
        .agg(F.min("contract_count").alias("sibling_count"))
    )


def interval_availability(
    declared: DataFrame, bounds_table: DataFrame, resolutions: DataFrame
) -> DataFrame:
    """Declared resolutions together with held ones per contract, and which of them have bars.

    ``declared`` is ``(contract_id, fyers_code)``; a repeated bound keeps the row with most rows.
    """
    fixed = F.broadcast(resolutions)
    wanted = (
        declared.join(fixed.select("res_id", "fyers_code"), "fyers_code")
        .select("contract_id", "res_id")
        .distinct()
    )
    held = bounds_table.groupBy("contract_id", "res_id").agg(
        F.max_by(F.struct("row_count", "first_ts", "last_ts"), "row_count").alias("b")
    )
    rows = F.coalesce("b.row_count", F.lit(0))
    return (
        wanted.join(held, ["contract_id", "res_id"], "full_outer")
        .join(fixed, "res_id")
        .select(
            "contract_id",
            "res_id",
            "chart_interval",
            "seconds",
            rows.alias("rows"),
            clock.utc_seconds(F.col("b.first_ts")).alias("first_ts"),
            clock.utc_seconds(F.col("b.last_ts")).alias("last_ts"),
            F.when(rows > 0, "available").otherwise("no_data").alias("state"),
        )
    )
