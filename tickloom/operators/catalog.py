"""Catalog listings: filters, rollups, keyset pages and search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import clock, money
from tickloom.functions.rows import at_least_one, count_where
from tickloom.operators import aggregates, coverage as coverage_ops
from tickloom.schemas import SEGMENT_CODES

CONTRACT_SORTS = ["expiry_date", "strike", "fyers_symbol", "rows"]


def contracts_full(
    contracts: DataFrame, underlyings: DataFrame, expiries: DataFrame
) -> DataFrame:
    """Contracts with their underlying and expiry attributes."""
    u = underlyings.select(
        "underlying_id",
        F.col("fyers_symbol").alias("underlying_symbol"),
        F.col("display_name").alias("underlying_name"),
        F.col("instrument_kind").alias("underlying_kind"),
    )
    e = expiries.select(
        "expiry_id", "expiry_cycle_derived", "contract_id_lo", "contract_id_hi",
        "options_count", "futures_count",
    )
    return contracts.join(u, "underlying_id").join(e, "expiry_id", "left")


def contract_filter(
    *,
    underlying_id: int | None = None,
    expiry_from: str | None = None,
    expiry_to: str | None = None,
    kind: str | None = None,
    option_type: str | None = None,
    strike_min: str | None = None,
    strike_max: str | None = None,
    symbol_contains: str | None = None,
    has_data: bool | None = None,
    sealed: bool | None = None,
) -> Column:
    """One predicate from optional narrowings over contracts joined to ``rows``."""
    terms = [F.col("kind") != "SPOT"]
    if underlying_id is not None:
        terms.append(F.col("underlying_id") == underlying_id)
    if expiry_from is not None:
        terms.append(F.col("expiry_date") >= clock.day(expiry_from))
    if expiry_to is not None:
        terms.append(F.col("expiry_date") <= clock.day(expiry_to))
    if kind is not None:
        terms.append(F.col("kind") == kind)
    if option_type is not None:
        terms.append(F.col("option_type") == option_type)
    if strike_min is not None:
        terms.append(F.col("strike") >= F.lit(str(strike_min)).cast(money.STRIKE))
    if strike_max is not None:
        terms.append(F.col("strike") <= F.lit(str(strike_max)).cast(money.STRIKE))
    if symbol_contains:
        terms.append(F.upper("fyers_symbol").contains(symbol_contains.upper()))
    if sealed is not None:
        terms.append(F.col("sealed_at").isNotNull() if sealed else F.col("sealed_at").isNull())
    if has_data is not None:
        terms.append(F.col("rows") > 0 if has_data else F.col("rows") == 0)
    return reduce(lambda a, b: a & b, terms)


def contracts_with_rows(
    contracts: DataFrame, bounds: DataFrame, res_id: int | None = None
) -> DataFrame:
    """Contracts left-joined to their bounds, at one resolution when given."""
    b = bounds if res_id is None else bounds.where(F.col("res_id") == res_id)
    return contracts.join(
        b.select("contract_id", "res_id", "row_count", "first_ts", "last_ts"), "contract_id", "left"
    ).withColumn("rows", F.coalesce("row_count", F.lit(0)).cast("bigint")).drop("row_count")


def contract_page(
    listed: DataFrame,
    predicate: Column,
    sort: str = "expiry_date",
    descending: bool = False,
    after: tuple[object, int] | None = None,
    limit: int = 100,
) -> DataFrame:
    """One keyset page in (sort, contract_id) order with a ``has_more`` flag.

    The cursor is the pair (sort value, contract_id) of the last row seen, so no row is skipped
    when ids do not follow the sort. Null sort values come last ascending, first descending.
    """
    if sort not in CONTRACT_SORTS:
        raise ValueError(f"contracts cannot be paged by {sort!r}; the choices are {CONTRACT_SORTS}")
    size = at_least_one(limit)
    page = listed.where(predicate)
    column, tie = F.col(sort), F.col("contract_id")
    if after is not None:
        value = F.lit(after[0]).cast(listed.schema[sort].dataType)
        last_id = F.lit(after[1])
        if after[0] is None:
            rest = column.isNull() & (tie < last_id if descending else tie > last_id)
            page = page.where(rest | column.isNotNull() if descending else rest)
        elif descending:
            page = page.where((column < value) | ((column == value) & (tie < last_id)))
        else:
            page = page.where(
                (column > value) | column.isNull() | ((column == value) & (tie > last_id))
            )
    order = (
        [column.desc_nulls_first(), tie.desc()] if descending else [column.asc_nulls_last(), tie.asc()]
    )
    return with_more_flag(page, order, size)


def with_more_flag(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """The first ``size`` rows in order and whether another one follows (top-k of size + 1)."""
    fetched = df.orderBy(*order).limit(size + 1)
    rank = F.row_number().over(Window.orderBy(*order))
    total = F.count("*").over(Window.partitionBy())
    return (
        fetched.withColumn("_r", rank)
        .withColumn("has_more", total > size)
        .where(F.col("_r") <= size)
        .drop("_r")
    )


def expiry_page(
    expiries: DataFrame, underlying_id: int, after: str | None = None, limit: int = 200,
    expiry_from: str | None = None, expiry_to: str | None = None,
) -> DataFrame:
    """One keyset page of an underlying's expiries in date order."""
    page = expiries.where(F.col("underlying_id") == underlying_id)
    if expiry_from is not None:
        page = page.where(F.col("expiry_date") >= clock.day(expiry_from))
    if expiry_to is not None:
        page = page.where(F.col("expiry_date") <= clock.day(expiry_to))
    if after is not None:
        page = page.where(F.col("expiry_date") > clock.day(after))
    return with_more_flag(page, [F.asc("expiry_date")], at_least_one(limit))


def expiry_listing(
    page: DataFrame, contracts: DataFrame, coverage: DataFrame, bounds: DataFrame,
    res_id: int | None = None,
) -> DataFrame:
    """A page of expiries with chunk counts by status, contracts with data and contracts sealed.

    The page is taken first; ledgers are reduced to its contracts before they are grouped.
    """
    mine = contracts.join(page.select("expiry_id"), "expiry_id", "left_semi")
    ids = mine.select("contract_id", "expiry_id")
    if res_id is not None:
        coverage = coverage.where(F.col("res_id") == res_id)
        bounds = bounds.where(F.col("res_id") == res_id)
    chunks = (
        coverage.join(ids, "contract_id")
        .groupBy("expiry_id")
        .agg(
            count_where(F.col("status") == "ok").alias("chunks_ok"),
            count_where(F.col("status") == "empty").alias("chunks_empty"),
            count_where(F.col("status") == "error").alias("chunks_error"),
            F.sum("row_count").alias("rows"),
        )
    )
    held = (
        bounds.where("row_count > 0")
        .select("contract_id")
        .distinct()
        .join(ids, "contract_id")
        .groupBy("expiry_id")
        .agg(F.count("*").alias("contracts_with_data"))
    )
    sealed = (
        mine.where("sealed_at IS NOT NULL")
        .groupBy("expiry_id")
        .agg(F.count("*").alias("contracts_sealed"))
    )
    out = page
    for part in (chunks, held, sealed):
        out = out.join(part, "expiry_id", "left")
    counts = [
        "contracts_with_data", "contracts_sealed", "chunks_ok", "chunks_empty", "chunks_error", "rows",
    ]
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in counts})


def underlying_listing(underlyings: DataFrame, bounds: DataFrame, expiries: DataFrame) -> DataFrame:
    """Underlyings with their expiry rollup and the bars of their own series."""
    spot = bounds.groupBy(F.col("contract_id").alias("spot_contract_id")).agg(
        F.sum("row_count").alias("spot_bars"), F.max("last_ts").alias("spot_last_ts")
    )
    return (
        underlyings.join(spot, "spot_contract_id", "left")
        .join(aggregates.underlying_rollup(expiries), "underlying_id", "left")
        .withColumn("spot_bars", F.coalesce("spot_bars", F.lit(0)).cast("bigint"))
    )


def contract_detail(
    contracts: DataFrame, bounds: DataFrame, coverage: DataFrame, resolutions: DataFrame
) -> DataFrame:
    """Each contract with its bounds per resolution (finest first) and its chunk counts.

    A contract has at most fifteen resolutions, so the nested lists are short.
    """
    held = (
        aggregates.bounds_utc(bounds, resolutions)
        .groupBy("contract_id")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("seconds", "res_id", "fyers_code", "first_ts", "last_ts", "rows"))
            ).alias("resolutions")
        )
    )
    chunks = (
        coverage.groupBy("contract_id", "res_id")
        .agg(
            F.count("*").alias("chunks"),
            count_where(F.col("status") == "ok").alias("chunks_ok"),
            count_where(F.col("status") == "empty").alias("chunks_empty"),
            count_where(F.col("status") == "error").alias("chunks_error"),
            F.min("range_from").alias("have_from"),
            F.max("range_to").alias("have_to"),
            F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows"),
        )
        .groupBy("contract_id")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "res_id", "chunks", "chunks_ok", "chunks_empty", "chunks_error",
                        "have_from", "have_to", "rows",
                    )
                )
            ).alias("coverage")
        )
    )
    return contracts.join(held, "contract_id", "left").join(chunks, "contract_id", "left")


def latest_expiries(
    expiries: DataFrame, n: int, discovered: bool | None = None,
    date_from: str | None = None, date_to: str | None = None,
) -> DataFrame:
    """The newest ``n`` expiries of each underlying, optionally by discovery state and dates."""
    wanted = expiries
    if discovered is not None:
        seen = F.col("contracts_discovered_at")
        wanted = wanted.where(seen.isNotNull() if discovered else seen.isNull())
    if date_from is not None:
        wanted = wanted.where(F.col("expiry_date") >= clock.day(date_from))
    if date_to is not None:
        wanted = wanted.where(F.col("expiry_date") <= clock.day(date_to))
    return coverage_ops.newest_per_underlying(wanted, n)


def in_id_order(contracts: DataFrame) -> list[Column]:
    """Sort terms in which ids are handed out: futures, then strikes with the call first."""
    return [
        F.when(F.col("kind") == "FUT", 0).when(F.col("kind") == "OPT", 1).otherwise(2),
        F.coalesce(contracts["strike"], F.lit(0).cast(money.STRIKE)),
        F.when(F.col("option_type") == "CE", 0).when(F.col("option_type") == "PE", 1).otherwise(2),
        F.coalesce(contracts["instrument_class"], F.lit("")),
        contracts["fyers_symbol"],
    ]


def search_term(query: str) -> str:
    """What a query searches for: a full symbol means the part after its exchange."""
    value = query.strip().upper()
    return value.split(":", 1)[1] if ":" in value else value


def search_underlyings(
    master: DataFrame, query: str, exchange_codes: list[int], limit: int
) -> DataFrame:
    """Derivative roots that match by root or by their cash ticker, deepest chain first within
    exact, prefix and other matches."""
    term = search_term(query)
    current = master.where("valid_to IS NULL")
    cash = current.where(F.col("segment_code") == SEGMENT_CODES["CM"])
    by_ticker = cash.where(F.upper("symbol_ticker").contains(term)).select(
        F.col("fytoken").alias("under_fytoken"), F.lit(True).alias("_ticker_hit")
    )
    grouped = (
        current.where(
            (F.col("segment_code") == SEGMENT_CODES["FO"])
            & F.col("exchange_code").isin(exchange_codes)
            & F.col("under_symbol").isNotNull()
            & F.col("under_fytoken").isNotNull()
        )
        .groupBy("under_symbol", "exchange_code", "under_fytoken")
        .agg(F.count("*").alias("n"))
        .join(by_ticker, "under_fytoken", "left")
        .where(F.upper("under_symbol").contains(term) | F.col("_ticker_hit"))
        .groupBy("under_symbol", "exchange_code")
        .agg(F.min("under_fytoken").alias("under_fytoken"), F.sum("n").alias("contract_count"))
    )
    named = grouped.join(
        cash.select(F.col("fytoken").alias("under_fytoken"), F.col("symbol_ticker").alias("cash_ticker")),
        "under_fytoken",
        "left",
    )
    root = F.upper(F.trim("under_symbol"))
    rank = (
        F.when(root == term, 0)
        .when(root.startswith(term) | F.col("cash_ticker").endswith(term), 1)
        .otherwise(2)
    )
    return (
        named.select(
            root.alias("root"), "exchange_code", "under_fytoken", "cash_ticker",
            "contract_count", rank.alias("match_rank"),
        )
        .orderBy("match_rank", F.desc("contract_count"), "root", "exchange_code")
        .limit(limit)
    )
