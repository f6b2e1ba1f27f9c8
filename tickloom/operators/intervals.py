"""Arithmetic on inclusive calendar ranges, per series.

Ranges that share a start are first reduced to the longest one. That changes no result and bounds
every window by the number of distinct start dates, however many ledger rows a series has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import clock

SERIES = ["contract_id", "res_id"]
#: Days of a bin in joins of ranges.
BIN_DAYS = 64
HELD_STATUSES = ["ok", "empty"]


def held(coverage: DataFrame) -> DataFrame:
    """Ledger rows that count as coverage. A failed fetch does not."""
    return coverage.where(F.col("status").isin(HELD_STATUSES))


def longest_per_start(ranges: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """The longest range of every start date."""
    return ranges.groupBy(*keys, "range_from").agg(F.max("range_to").alias("range_to"))


def reversed_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges that end before they start: an error for every operator here."""
    return ranges.where("range_to < range_from")


def refused(ranges: DataFrame) -> DataFrame:
    """The ranges, failing on the first that ends before it starts."""
    text = F.concat(F.lit("range ends before it starts: "), F.col("range_from"), F.lit(".."), F.col("range_to"))
    checked = F.when(F.col("range_to") < F.col("range_from"), F.raise_error(text).cast("date")).otherwise(F.col("range_to"))
    return ranges.withColumn("range_to", checked)


def merge(ranges: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Coalesce ranges that overlap or touch. A reversed range is an error."""
    order = Window.partitionBy(*keys).orderBy("range_from")
    reach = F.max("range_to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(
        reach.isNull() | (F.col("range_from") > F.date_add(reach, 1)), F.lit(1)
    ).otherwise(F.lit(0))
    marked = longest_per_start(refused(ranges), keys).withColumn("_start", starts)
    islands = marked.withColumn("_island", F.sum("_start").over(order))
    return (
        islands.groupBy(*keys, "_island")
        .agg(F.min("range_from").alias("range_from"), F.max("range_to").alias("range_to"))
        .drop("_island")
    )


def gaps_after(coverage: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Holes between one range and the next by start date, whatever their status.

    The faithful form looks at the next start only, so a long range that contains later ones can
    still show a hole; ``missing`` is the exact form.
    """
    following = F.lead("range_from").over(Window.partitionBy(*keys).orderBy("range_from"))
    return (
        longest_per_start(coverage, keys)
        .withColumn("gap_before", following)
        .where(F.col("gap_before") > F.date_add("range_to", 1))
        .select(*keys, F.col("range_to").alias("gap_after"), "gap_before")
    )


def gap_detail(gaps: DataFrame) -> DataFrame:
    """The missing days of each hole, both ends inclusive."""
    gap_from, gap_to = F.date_add("gap_after", 1), F.date_sub("gap_before", 1)
    return gaps.withColumns(
        {
            "gap_from": gap_from,
            "gap_to": gap_to,
            "missing_days": clock.span_days(gap_from, gap_to),
        }
    )


def bin_of(day: Column) -> Column:
    return F.floor(F.unix_date(day) / BIN_DAYS).cast("int")


def on_bins(ranges: DataFrame, start: str, end: str, *names: str) -> DataFrame:
    """Ranges on every bin they touch, as ``_bin``, under ``names``; ``_own`` is the bin they start in.

    Of disjoint ranges of one series only the first on a bin can come in from an earlier one, so
    there are at most half as many on a bin as it has days, and one more.
    """
    first, last = bin_of(F.col(start)), bin_of(F.col(end))
    return ranges.where(F.col(start) <= F.col(end)).select(*names, first.alias("_own"), F.explode(F.sequence(first, last)).alias("_bin"))


def missing(
    wants: DataFrame, ranges: DataFrame, keys: Sequence[str] = SERIES, want_id: str = "want_id"
) -> DataFrame:
    """Parts of each ``(want_id, keys.., want_from, want_to)`` that no range covers.

    Wants and merged ranges are laid on bins of the calendar and the bin joins the key, so a want
    meets the ranges of its own bins only, however many its series has. A pair that shares several
    bins meets in the first. Every range met can leave a hole before it, and so does the end of the
    want, which stands behind them as one more.
    """
    merged = merge(ranges, keys).withColumns({"_from": F.col("range_from"), "_to": F.col("range_to")})
    islands = on_bins(merged, "_from", "_to", *keys, "_from", "_to").withColumnRenamed("_own", "_island_bin")
    asked = wants.where("want_to >= want_from")
    met = on_bins(asked, "want_from", "want_to", *wants.columns).join(islands, [*keys, "_bin"]).where(
        (F.col("_bin") == F.greatest("_own", "_island_bin")) & (F.col("_from") <= F.col("want_to")) & (F.col("_to") >= F.col("want_from"))
    )
    behind = F.date_add("want_to", 1)
    ends = asked.select(*wants.columns, behind.alias("_from"), behind.alias("_to"))
    order = Window.partitionBy(want_id, *keys).orderBy("_from")
    gap_from = F.coalesce(F.date_add(F.lag("_to").over(order), 1), F.col("want_from"))
    return (
        met.select(*wants.columns, "_from", "_to").unionByName(ends)
        .select(*wants.columns, gap_from.alias("gap_from"), F.date_sub("_from", 1).alias("gap_to"))
        .where("gap_from <= gap_to")
    )


def split(gaps: DataFrame, max_days: int) -> DataFrame:
    """Cut each gap into pieces of at most ``max_days`` calendar days, oldest first."""
    if max_days < 1:
        raise ValueError("max_days must be at least one day")
    others = [c for c in gaps.columns if c not in ("gap_from", "gap_to")]
    starts = F.sequence("gap_from", "gap_to", F.make_interval(days=F.lit(max_days)))
    return gaps.select(*others, "gap_to", F.posexplode(starts).alias("ordinal", "gap_from")).select(
        *others,
        "ordinal",
        "gap_from",
        F.least(F.date_add("gap_from", max_days - 1), F.col("gap_to")).alias("gap_to"),
    )


def chunks_newest_first(
    df: DataFrame, max_days: Column, start: str = "range_from", end: str = "range_to"
) -> DataFrame:
    """Pieces of at most ``max_days`` days cut from the right edge; ordinal 0 is the newest."""
    others = [c for c in df.columns if c not in (start, end)]
    last = F.floor(F.datediff(F.col(end), F.col(start)) / max_days).cast("int")
    cut = (
        df.where(F.col(end) >= F.col(start))
        .withColumn("_n", max_days.cast("int"))
        .withColumn("ordinal", F.explode(F.sequence(F.lit(0), last)))
    )
    chunk_to = F.date_sub(F.col(end), F.col("ordinal") * F.col("_n"))
    chunk_from = F.greatest(F.col(start), F.date_sub(chunk_to, F.col("_n") - 1))
    return cut.select(
        *others, "ordinal", chunk_from.alias("chunk_from"), chunk_to.alias("chunk_to")
    )


def contained_in(
    df: DataFrame, ranges: DataFrame, start: str, end: str, keys: Sequence[str] = SERIES,
    how: str = "left_semi",
) -> DataFrame:
    """Rows whose [start, end] lies inside one of ``ranges`` (``left_anti`` for those that do
    not). Pass merged ranges for the exact test, ledger rows for the row-wise one.

    A range that holds all of a row holds its first day: rows are looked up in the bin of that day,
    among ranges laid on every bin they touch.
    """
    held = around(ranges, keys)
    first = df.withColumn("_bin", bin_of(F.col(start)))
    on = [first[k] == held[f"_k_{k}"] for k in keys] + [
        first["_bin"] == held["_held_bin"], held["_from"] <= first[start], held["_to"] >= first[end]
    ]
    return first.join(held, on, how).drop("_bin")


def around(ranges: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Ranges under names of their own, on every bin they touch; of one start the longest."""
    longest = longest_per_start(ranges, keys).withColumns({"_from": F.col("range_from"), "_to": F.col("range_to")})
    named = longest.withColumns({f"_k_{k}": F.col(k) for k in keys})
    laid = on_bins(named, "_from", "_to", *[f"_k_{k}" for k in keys], "_from", "_to")
    return laid.drop("_own").withColumnRenamed("_bin", "_held_bin")


def last_of_month(dates: DataFrame, key: str = "underlying_id") -> DataFrame:
    """Mark the last expiry of every calendar month as M, the others as W."""
    latest = F.max("expiry_date").over(Window.partitionBy(key, F.trunc("expiry_date", "MM")))
    return dates.withColumn("is_last_of_month", F.col("expiry_date") == latest).withColumns(
        {
            "expiry_cycle_derived": F.when(F.col("is_last_of_month"), "M").otherwise("W"),
            "expiry_cycle_source": F.lit("derived"),
        }
    )
