"""Trading days per exchange: observed days win, else a weekday that is not a holiday.

The day table is exchanges x calendar days, a size set by the calendar and not by the bars.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import clock
from tickloom.schemas import EXCHANGE_FLOORS

SECONDS_WINDOW_DAYS = 30
#: Why a request has no trading days: it reaches outside the day table.
OUTSIDE = "day_not_in_calendar"


def day_table(
    exchanges: DataFrame, first: str | Column, last: str | Column, holidays: DataFrame, observed: DataFrame
) -> DataFrame:
    """Every calendar day of ``[first, last]`` for each exchange with ``is_trading``."""
    days = exchanges.select("exchange").distinct().select(
        "exchange", F.explode(F.sequence(*[clock.day(d) if isinstance(d, str) else d for d in (first, last)])).alias("trade_date")
    )
    seen = observed.select("exchange", "trade_date").distinct().withColumn("_seen", F.lit(True))
    closed = (
        holidays.select("exchange", F.col("holiday_date").alias("trade_date"))
        .distinct()
        .withColumn("_closed", F.lit(True))
    )
    rule = (clock.iso_weekday(F.col("trade_date")) <= 5) & F.col("_closed").isNull()
    return (
        days.join(seen, ["exchange", "trade_date"], "left")
        .join(closed, ["exchange", "trade_date"], "left")
        .select(
            "exchange",
            "trade_date",
            F.coalesce("_seen", F.lit(False)).alias("is_observed"),
            (F.coalesce("_seen", F.lit(False)) | rule).alias("is_trading"),
        )
    )


def day_table_over(spans: DataFrame, holidays: DataFrame, observed: DataFrame) -> DataFrame:
    """The day table that spans all of ``(exchange, day_from, day_to)``."""
    edges = spans.agg(F.min("day_from").alias("first"), F.max("day_to").alias("last"))
    first, last = (edges.select(F.date_format(c, "yyyy-MM-dd")).scalar().cast("date") for c in ("first", "last"))
    return day_table(spans, first, last, holidays, observed)


def ordinals(days: DataFrame) -> DataFrame:
    """Each day with the number of trading days up to and including it."""
    order = Window.partitionBy("exchange").orderBy("trade_date")
    return days.withColumn(
        "ordinal", F.sum(F.col("is_trading").cast("int")).over(order).cast("int")
    )


def count_between(requests: DataFrame, days: DataFrame) -> DataFrame:
    """Trading days in each inclusive ``(exchange, day_from, day_to)``: two ordinal lookups.

    A request with an end outside the day table comes back with no count and its reason in
    ``calendar_reason``.
    """
    numbered = ordinals(days)
    start = numbered.select(
        "exchange", F.col("trade_date").alias("day_from"),
        (F.col("ordinal") - F.col("is_trading").cast("int")).alias("_before"),
    )
    end = numbered.select(
        "exchange", F.col("trade_date").alias("day_to"), F.col("ordinal").alias("_upto")
    )
    known = F.col("_upto").isNotNull() & F.col("_before").isNotNull()
    return (
        requests.join(start, ["exchange", "day_from"], "left")
        .join(end, ["exchange", "day_to"], "left")
        .withColumn("trading_days", F.when(known, F.greatest(F.col("_upto") - F.col("_before"), F.lit(0)).cast("bigint")))
        .withColumn("calendar_reason", F.when(~known, OUTSIDE))
        .drop("_before", "_upto")
    )


def shift(requests: DataFrame, days: DataFrame, n: Column, inclusive: bool = False) -> DataFrame:
    """The n-th trading day from each ``(exchange, day)``; negative goes back, 0 stays.

    With ``inclusive`` the day itself counts when it trades, so n=1 is "this day or the next". A day
    outside the table has no result and its reason in ``calendar_reason``; a result outside has none.
    """
    numbered = ordinals(days)
    own = numbered.select(
        "exchange",
        F.col("trade_date").alias("day"),
        F.col("ordinal").alias("_upto"),
        F.col("is_trading").alias("_trades"),
    )
    counts_itself = F.col("_trades").cast("int")
    forward = F.col("_upto") + F.col("_n") - (counts_itself if inclusive else F.lit(0))
    # Going back from a trading day, its own ordinal is the starting point; from a closed day the
    # last trading day before it is already one step.
    step_back = F.when(F.col("_trades"), F.col("_upto") + F.col("_n")).otherwise(
        F.col("_upto") + F.col("_n") + 1
    )
    backward = F.when(F.lit(inclusive) & F.col("_trades"), F.col("_upto") + F.col("_n") + 1).otherwise(
        step_back
    )
    target = F.when(F.col("_n") > 0, forward).otherwise(backward)
    trading = numbered.where("is_trading").select(
        "exchange", F.col("ordinal").alias("_target"), F.col("trade_date").alias("_hit")
    )
    placed = requests.withColumn("_n", n).join(own, ["exchange", "day"], "left").withColumn("_target", target)
    return (
        placed.join(trading, ["exchange", "_target"], "left")
        .withColumn("shifted", F.when(F.col("_n") == 0, F.col("day")).otherwise(F.col("_hit")))
        .withColumn("calendar_reason", F.when(F.col("_upto").isNull(), OUTSIDE))
        .drop("_n", "_upto", "_trades", "_target", "_hit")
    )


def seconds_window(
    days: DataFrame, as_of: str, length: int = SECONDS_WINDOW_DAYS
) -> DataFrame:
    """First and last of the trailing ``length`` trading days on or before a date."""
    past = days.where(F.col("is_trading") & (F.col("trade_date") <= clock.day(as_of)))
    newest = Window.partitionBy("exchange").orderBy(F.desc("trade_date"))
    return (
        past.withColumn("_r", F.row_number().over(newest))
        .where(F.col("_r") <= length)
        .groupBy("exchange")
        .agg(F.min("trade_date").alias("window_from"), F.max("trade_date").alias("window_to"))
    )


def day_bounds_utc(day_column: Column) -> tuple[Column, Column]:
    """Half-open UTC seconds of one IST calendar day."""
    start = clock.utc_seconds(clock.midnight(day_column))
    return start, start + clock.SECONDS_PER_DAY


def exchange_floor(exchange: Column) -> Column:
    """First date an exchange serves, null for an unknown one."""
    return reduce(
        lambda acc, item: F.when(F.upper(F.trim(exchange)) == item[0], clock.day(item[1])).otherwise(acc),
        EXCHANGE_FLOORS.items(),
        F.lit(None).cast("date"),
    )


def clamp_to_floor(exchange: Column, d: Column) -> Column:
    """A date moved forward to the exchange's first served date."""
    return F.greatest(d, exchange_floor(exchange))


def partial_cutoff(now: Column, seconds: Column) -> Column:
    """Latest moment whose bar is complete: one period before now."""
    return F.timestamp_add("SECOND", -seconds, now)
