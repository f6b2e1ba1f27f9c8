"""What a download would cost, from the catalog, the ledger and the calendar alone.

A sheet is a table of ``(underlying_id, expiry_date)`` with optional range ends; contracts,
resolutions, held ranges and trading days are joined to it and the result is one row per request
plus one summary row. The newest-first walk with its early stop becomes a minimum over ordinals.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import clock
from tickloom.operators import calendar, intervals
from tickloom.schemas import EXCHANGE_CODES, RESOLUTIONS

# Request span, last-resort session, bytes per row, rate, budget and sweep share.
MAX_DAYS_PER_REQUEST = 100
NOMINAL_SESSION_SECONDS = 385 * 60
BYTES_PER_ROW = 15.21
REQUESTS_PER_MINUTE = 170
DAILY_BUDGET = 100_000
SWEEP_SHARE = 0.70
DISCOVERY_WINDOW_DAYS = 366
TRAILING_DISCOVERY_DAYS = 365
SECONDS_CODES = ["5S", "10S", "15S", "30S", "45S"]

SERIES = ["contract_id", "res_id"]


@dataclass(frozen=True)
class Sheet:
    """The literal part of a request; its expiries are a table."""

    now: str
    resolutions: tuple[str, ...] = ("1",)
    range_from: str | None = None
    range_to: str | None = None
    force_refresh: bool = False
    include_oi: bool = True
    probe_backward: bool = True
    sweep: bool = False

    @property
    def today(self) -> str:
        return self.now[:10]


def selected_resolutions(sheet: Sheet) -> Column:
    """The sheet's resolutions as one literal array: at most the fifteen fixed rows."""
    known = {code: (res_id, code, seconds, most) for res_id, code, seconds, _, _, most, *_ in RESOLUTIONS}
    wanted = [c.strip().upper() for c in sheet.resolutions]
    unknown = [c for c in wanted if c not in known]
    if unknown:
        raise ValueError(f"not a resolution served here: {', '.join(unknown)}")
    return F.array(
        *[
            F.struct(
                F.lit(known[c][0]).cast("smallint").alias("res_id"),
                F.lit(c).alias("fyers_code"),
                F.lit(known[c][2]).alias("seconds"),
                F.lit(known[c][3]).alias("max_days_per_request"),
            )
            for c in wanted
        ]
    )


def chunk_days() -> Column:
    """Days one request may span: 100, less for resolutions under a minute."""
    return F.when(
        F.col("seconds") < 60,
        F.greatest(F.least(F.col("max_days_per_request"), F.lit(MAX_DAYS_PER_REQUEST)), F.lit(1)),
    ).otherwise(F.lit(MAX_DAYS_PER_REQUEST))


def bars_per_day(session_seconds: Column) -> Column:
    """Nominal bars of one trading day."""
    return F.when(F.col("seconds") >= 86400, F.lit(1)).otherwise(
        F.greatest(F.ceil(session_seconds / F.col("seconds")), F.lit(1))
    )


def scope_contracts(
    contracts: DataFrame, instrument_class: str = "BOTH", option_types: list[str] | None = None
) -> DataFrame:
    """Contracts of a class and right; a future has no right and survives the right filter."""
    out = contracts.where("kind <> 'SPOT'")
    if instrument_class != "BOTH":
        out = out.where(F.col("kind") == instrument_class)
    if instrument_class != "FUT" and option_types:
        out = out.where(F.col("option_type").isNull() | F.col("option_type").isin(option_types))
    return out


def split_sealed(contracts: DataFrame, force_refresh: bool = False) -> tuple[DataFrame, DataFrame]:
    """(contracts to plan, sealed contracts skipped)."""
    if force_refresh:
        return contracts, contracts.where(F.lit(False))
    return contracts.where("sealed_at IS NULL"), contracts.where("sealed_at IS NOT NULL")


def _clamp_partial(range_to: Column, now: str) -> Column:
    moment = clock.ntz(now)
    cutoff = calendar.partial_cutoff(moment, F.col("seconds")).cast("date")
    return F.when(range_to < moment.cast("date"), range_to).otherwise(F.least(range_to, cutoff))


def contract_windows(
    contracts: DataFrame, underlyings: DataFrame, seconds_windows: DataFrame, sheet: Sheet
) -> DataFrame:
    """Inclusive fetch window of every contract at every resolution, fully clamped.

    ``underlyings`` carry the life lengths. Expiries outside the trailing seconds window drop out
    for resolutions under a minute, as do windows that close before they open.
    """
    per_underlying = underlyings.select(
        "underlying_id", "exchange", "data_from", "option_life_days", "future_life_days"
    )
    placed = contracts.join(per_underlying, "underlying_id").join(seconds_windows, "exchange", "left")
    spread = placed.select("*", F.inline(selected_resolutions(sheet)))
    is_seconds = F.col("seconds") < 60
    life = F.when(F.col("kind") == "FUT", F.col("future_life_days")).otherwise(
        F.col("option_life_days")
    )
    start = F.greatest(
        F.date_sub("expiry_date", life),
        F.col("data_from"),
        calendar.exchange_floor(F.col("exchange")),
        F.lit(sheet.range_from).cast("date"),
        F.when(is_seconds, F.col("window_from")),
    )
    end = _clamp_partial(F.least(F.col("expiry_date"), F.lit(sheet.range_to).cast("date")), sheet.now)
    reachable = ~is_seconds | F.col("expiry_date").between(F.col("window_from"), F.col("window_to"))
    return (
        spread.withColumn("range_from", start)
        .withColumn("range_to", end)
        .where(F.coalesce(reachable, F.lit(False)) & (F.col("range_to") >= F.col("range_from")))
        .drop("window_from", "window_to", "data_from", "option_life_days", "future_life_days")
    )


def spot_windows(
    underlyings: DataFrame, expiries: DataFrame, seconds_windows: DataFrame, sheet: Sheet
) -> DataFrame:
    """Inclusive fetch window of every underlying's own series over its selected expiries."""
    span = expiries.groupBy("underlying_id").agg(
        F.min("expiry_date").alias("_first"), F.max("expiry_date").alias("_last")
    )
    placed = underlyings.join(span, "underlying_id").join(seconds_windows, "exchange", "left")
    spread = placed.select("*", F.inline(selected_resolutions(sheet)))
    is_seconds = F.col("seconds") < 60
    start = F.greatest(
        F.coalesce(F.lit(sheet.range_from).cast("date"), F.col("_first")),
        F.col("data_from"),
        calendar.exchange_floor(F.col("exchange")),
        F.when(is_seconds, F.col("window_from")),
    )
    end = F.least(
        F.coalesce(F.lit(sheet.range_to).cast("date"), F.col("_last")),
        F.when(is_seconds, F.col("window_to")),
    )
    return (
        spread.withColumn("range_from", start)
        .withColumn("range_to", _clamp_partial(end, sheet.now))
        .where("range_to >= range_from")
        .select(
            F.col("spot_contract_id").alias("contract_id"), "underlying_id", "exchange",
            "fyers_symbol", "res_id", "fyers_code", "seconds", "max_days_per_request",
            "range_from", "range_to",
        )
    )


def candidate_chunks(windows: DataFrame) -> DataFrame:
    """Request-sized pieces of each window, newest first."""
    return intervals.chunks_newest_first(windows, chunk_days())


def classify_chunks(chunks: DataFrame, coverage: DataFrame) -> DataFrame:
    """What each candidate is: ``dead`` (inside a recorded hole in the data), ``held`` (inside
    merged coverage) or ``missing``. Merged ranges are disjoint, so each test matches at most one,
    looked up in the bin of the chunk's first day."""
    held = intervals.merge(intervals.held(coverage))
    dead = intervals.merge(coverage.where("status = 'empty' AND row_count = 0"))

    def inside(df: DataFrame, ranges: DataFrame, flag: str) -> DataFrame:
        r = intervals.around(ranges).withColumn(flag, F.lit(True))
        df = df.withColumn("_bin", intervals.bin_of(F.col("chunk_from")))
        on = [df[k] == r[f"_k_{k}"] for k in SERIES] + [df["_bin"] == r["_held_bin"]]
        return df.join(r, [*on, r["_from"] <= df["chunk_from"], r["_to"] >= df["chunk_to"]], "left").drop(
            "_bin", *[c for c in r.columns if c != flag]
        )

    marked = inside(inside(chunks, held, "_held"), dead, "_dead")
    return marked.withColumn(
        "state", F.when(F.col("_dead"), "dead").when(F.col("_held"), "held").otherwise("missing")
    ).drop("_held", "_dead")


def subtract_coverage(classified: DataFrame, probe_backward: bool = True) -> DataFrame:
    """Keep what the newest-first walk visits, each row marked ``emit`` or ``skip``.

    The walk stops at the first dead chunk, and with probing at the first missing one.
    """
    series = Window.partitionBy(*SERIES)

    def first(state: str) -> Column:
        return F.min(F.when(F.col("state") == state, F.col("ordinal"))).over(series)

    never = F.lit(2**31 - 1)
    stop = F.coalesce(first("dead"), never)
    if probe_backward:
        stop = F.least(stop, F.coalesce(first("missing"), never))
    return (
        classified.withColumn("_stop", stop)
        .where(F.col("ordinal") <= F.col("_stop"))
        .withColumn("outcome", F.when(F.col("state") == "missing", "emit").otherwise("skip"))
        .drop("_stop")
    )


def subtract_spot_coverage(classified: DataFrame) -> DataFrame:
    """A spot series is continuous: every chunk that is not held is emitted, oldest first."""
    return classified.withColumn(
        "outcome", F.when(F.col("state") == "missing", "emit").otherwise("skip")
    )


def estimate_rows(
    tasks: DataFrame, typical: DataFrame, days: DataFrame, sessions: DataFrame
) -> DataFrame:
    """Rows each request is expected to bring: the typical chunk when one is known, else trading
    days times nominal bars. ``is_nominal`` marks the fallback."""
    known = tasks.join(typical, ["underlying_id", "res_id"], "left").join(
        sessions, "exchange", "left"
    )
    counted = calendar.count_between(
        known.withColumnsRenamed({"chunk_from": "day_from", "chunk_to": "day_to"}), days
    ).withColumnsRenamed({"day_from": "chunk_from", "day_to": "chunk_to"})
    session = F.coalesce("session_seconds", F.lit(NOMINAL_SESSION_SECONDS))
    observed = F.when(F.col("typical") > 0, F.col("typical"))
    nominal = F.col("trading_days") * bars_per_day(session)
    return (
        counted.withColumn("is_nominal", observed.isNull())
        .withColumn("rows_estimated", F.coalesce(observed, nominal).cast("bigint"))
        .drop("typical", "session_seconds", "trading_days", "calendar_reason")
    )


def discovery_tasks(
    wanted: DataFrame, expiries: DataFrame, siblings: DataFrame, resolution_count: int
) -> tuple[DataFrame, DataFrame]:
    """Wanted expiries without contracts yet, each with the requests expected behind it, and the
    wanted expiries the catalog does not know."""
    known = expiries.select(
        "underlying_id", "expiry_date", "contracts_discovered_at",
        F.lit(True).alias("_known"),
    )
    joined = wanted.join(known, ["underlying_id", "expiry_date"], "left")
    undiscovered = (
        joined.where("_known AND contracts_discovered_at IS NULL")
        .join(siblings, "underlying_id", "left")
        .select(
            "underlying_id",
            "expiry_date",
            (F.coalesce("sibling_count", F.lit(0)) * resolution_count)
            .cast("bigint")
            .alias("downstream"),
        )
    )
    return undiscovered, joined.where("_known IS NULL").select("underlying_id", "expiry_date")


def refused_underlyings(wanted: DataFrame, expiries: DataFrame) -> DataFrame:
    """Underlyings with known wanted expiries none of which has contracts: nothing to price."""
    known = wanted.join(
        expiries.select("underlying_id", "expiry_date", "contracts_discovered_at"),
        ["underlying_id", "expiry_date"],
    )
    return (
        known.groupBy("underlying_id")
        .agg(
            F.count("contracts_discovered_at").alias("discovered"),
            F.count("*").alias("discovery_tasks"),
        )
        .where("discovered = 0")
        .select("underlying_id", "discovery_tasks")
    )


def price(
    walked: DataFrame, discovery: DataFrame, scoped: DataFrame, sheet: Sheet, *,
    spot: DataFrame | None = None, used_today: int = 0, daily_budget: int = DAILY_BUDGET,
    per_minute: int = REQUESTS_PER_MINUTE, sweep_share: float = SWEEP_SHARE,
) -> DataFrame:
    """The summary row of a plan.

    ``walked`` and ``spot`` are estimated contract and spot chunks with their outcome, ``discovery``
    the expiries to discover, ``scoped`` every contract of the sheet, sealed ones included.
    """
    emit = F.col("outcome") == "emit"

    def chunk_part(chunks: DataFrame, tasks: str) -> DataFrame:
        return chunks.agg(
            F.count(F.when(emit, 1)).alias(tasks),
            F.count(F.when(F.col("outcome") == "skip", 1)).alias("chunks_skipped_covered"),
            F.sum(F.when(emit, F.col("rows_estimated"))).alias("rows_estimated"),
            F.count(F.when(emit & F.col("is_nominal"), 1)).alias("nominal"),
        )

    is_sealed = F.col("sealed_at").isNotNull() & F.lit(not sheet.force_refresh)
    per_expiry = scoped.groupBy("underlying_id", "expiry_date").agg(
        F.count(F.when(~is_sealed, 1)).alias("live"), F.count(F.when(is_sealed, 1)).alias("sealed")
    )
    # One-row aggregates stacked, then summed: nothing is joined.
    parts = [
        chunk_part(walked, "chunk_tasks"),
        discovery.agg(
            F.count("*").alias("discovery_tasks"),
            F.sum("downstream").alias("estimated_downstream_requests"),
        ),
        per_expiry.agg(
            F.count("*").alias("expiries_planned"),
            F.sum("live").alias("contracts_planned"),
            F.sum("sealed").alias("contracts_sealed_skipped"),
        ),
        *([chunk_part(spot, "spot_tasks")] if spot is not None else []),
    ]
    stacked = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    one = stacked.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in stacked.columns]
    )
    if spot is None:
        one = one.withColumn("spot_tasks", F.lit(0).cast("bigint"))
    remaining = max(0, daily_budget - used_today)
    allowance = max(0, int(daily_budget * sweep_share) - used_today) if sheet.sweep else remaining
    tasks = F.col("chunk_tasks") + F.col("discovery_tasks") + F.col("spot_tasks")
    has_seconds = any(c.strip().upper() in SECONDS_CODES for c in sheet.resolutions)
    job_kind = (
        F.when((F.col("discovery_tasks") > 0) & (F.col("discovery_tasks") == F.col("tasks_total")), "contract_discovery")
        .when((F.col("spot_tasks") > 0) & (F.col("spot_tasks") == F.col("tasks_total")), "underlying_history")
        .otherwise("seconds_capture" if has_seconds else "candle_backfill")
    )
    requests = tasks + F.col("estimated_downstream_requests")
    exceeds = F.col("requests_estimated") > allowance
    return (
        one.withColumn("tasks_total", tasks)
        .withColumn("requests_estimated", requests)
        .select(
            "tasks_total",
            "requests_estimated",
            "chunks_skipped_covered",
            "contracts_sealed_skipped",
            "contracts_planned",
            "expiries_planned",
            "spot_tasks",
            job_kind.alias("job_kind"),
            "discovery_tasks",
            "estimated_downstream_requests",
            "rows_estimated",
            F.bround(F.col("rows_estimated") * F.lit(BYTES_PER_ROW), 0)
            .cast("bigint")
            .alias("bytes_estimated"),
            F.ceil(F.col("requests_estimated") * 60 / per_minute).cast("bigint").alias("eta_seconds"),
            F.lit(remaining).cast("bigint").alias("budget_remaining"),
            F.lit(allowance).cast("bigint").alias("budget_allowance"),
            (F.lit(remaining) - F.col("requests_estimated")).cast("bigint").alias("budget_after"),
            exceeds.alias("exceeds_budget"),
            F.array_join(
                F.array_compact(
                    F.array(
                        F.when(F.col("nominal") > 0, "rows_estimated_is_nominal"),
                        F.when(F.col("discovery_tasks") > 0, "contracts_not_discovered"),
                        F.when(exceeds, "exceeds_budget"),
                    )
                ),
                ",",
            ).alias("warnings"),
        )
    )


def after_chunk(
    results: DataFrame, floors: DataFrame, days: DataFrame, coverage: DataFrame,
) -> DataFrame:
    """What follows each fetched chunk: ``seal`` with a reason, or the next older chunk.

    ``results`` is ``(contract_id, res_id, exchange, range_from, range_to, status, first_ts)``,
    ``floors`` is ``(contract_id, floor)``. Older chunks have the fetched chunk's own length; the
    newest one that is not all held is taken, down to the floor: it holds the last day before the
    fetched chunk that no merged ledger range covers, so no step is tried one by one.
    """
    span = F.greatest(
        F.least(clock.span_days(F.col("range_from"), F.col("range_to")), F.lit(MAX_DAYS_PER_REQUEST)),
        F.lit(1),
    )
    expected = calendar.shift(
        results.withColumn("day", F.col("range_from")), days, F.lit(1), inclusive=True
    ).withColumnRenamed("shifted", "_expected").drop("day")
    judged = expected.join(floors, "contract_id", "left").withColumns(
        {
            "_span": span,
            "reason": F.when(F.col("status") == "empty", "no_data").when(
                F.col("first_ts").isNull() | (F.to_date("first_ts") > F.col("_expected")),
                "life_inside_chunk",
            ),
        }
    )
    chunk_key = [*SERIES, "range_from", "range_to"]
    walking = judged.where("reason IS NULL AND date_sub(range_from, 1) >= floor").select(
        *chunk_key, "_span", "floor"
    )
    merged = intervals.merge(intervals.held(coverage)).select(
        *SERIES, F.col("range_from").alias("_held_from"), F.col("range_to").alias("_held_to")
    )
    day_before = F.date_sub("range_from", 1)
    # Merged ranges are apart, so a day lies in one of them at most.
    covered = walking.alias("w").join(
        merged.alias("m"),
        reduce(lambda a, b: a & b, [F.col(f"w.{k}") == F.col(f"m.{k}") for k in SERIES])
        & day_before.between(F.col("_held_from"), F.col("_held_to")),
        "left",
    ).select("w.*", F.coalesce(F.date_sub("_held_from", 1), day_before).alias("_missing"))
    step = F.floor(F.datediff(day_before, "_missing") / F.col("_span")).cast("int")
    older_to = F.date_sub("range_from", 1 + step * F.col("_span"))
    next_chunk = covered.where("_missing >= floor").groupBy(*chunk_key).agg(
        F.max_by(
            F.struct(
                F.greatest(F.col("floor"), F.date_sub(older_to, F.col("_span") - 1)).alias("older_from"),
                older_to.alias("older_to"),
            ),
            older_to,
        ).alias("n")
    )
    return judged.join(next_chunk, chunk_key, "left").select(
        *SERIES,
        "range_from",
        "range_to",
        F.when(F.col("n").isNotNull(), "older_chunk").otherwise("seal").alias("action"),
        F.when(F.col("n").isNull(), F.coalesce("reason", F.lit("floor_reached"))).alias("reason"),
        F.col("n.older_from").alias("next_from"),
        F.col("n.older_to").alias("next_to"),
    )


def seal_if_idle(decisions: DataFrame, open_tasks: DataFrame) -> DataFrame:
    """Contracts to seal: none of their resolutions still has open work."""
    ended = decisions.groupBy("contract_id").agg(
        F.bool_and(F.col("action") == "seal").alias("all_sealed")
    )
    return ended.where("all_sealed").join(
        open_tasks.select("contract_id"), "contract_id", "left_anti"
    ).select("contract_id")


def older_tasks_to_skip(decisions: DataFrame, pending: DataFrame) -> DataFrame:
    """Pending chunks of the same job older than a no-data boundary of their series."""
    edges = decisions.where("reason = 'no_data'").groupBy("job_id", *SERIES).agg(
        F.max("range_from").alias("_edge")
    )
    return pending.join(edges, ["job_id", *SERIES]).where(
        F.col("range_to") < F.col("_edge")
    ).drop("_edge")


def discovery_windows(requests: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """``(request_id, exchange, range_from, range_to)`` to discovery pieces and refusals.

    A missing range means the trailing year. The end is moved back to yesterday, the last day
    served; a start before the exchange's first served date or after that end is refused.
    """
    now = clock.day(today)
    last_served = F.date_sub(now, 1)
    ranged = requests.withColumns(
        {
            "_from": F.coalesce("range_from", F.date_sub(now, TRAILING_DISCOVERY_DAYS)),
            "_to": F.least(F.coalesce("range_to", now), last_served),
        }
    )
    judged = ranged.withColumn(
        "reason",
        F.when(~F.upper("exchange").isin(list(EXCHANGE_CODES)), "unknown_exchange")
        .when(F.upper("exchange") == "MCX", "exchange_not_served")
        .when(F.col("_from") < calendar.exchange_floor(F.col("exchange")), "range_before_floor")
        .when(F.col("_to") < F.col("_from"), "range_after_last_served"),
    )
    pieces = intervals.chunks_newest_first(
        judged.where("reason IS NULL").select("request_id", "exchange", "_from", "_to"),
        F.lit(DISCOVERY_WINDOW_DAYS), "_from", "_to",
    )
    return pieces, judged.where("reason IS NOT NULL").select("request_id", "exchange", "reason")


def plan_contracts(
    contracts: DataFrame, underlyings: DataFrame, coverage: DataFrame,
    days: DataFrame, typical: DataFrame, sessions: DataFrame, sheet: Sheet,
) -> DataFrame:
    """Contract requests of a sheet end to end: window, candidates, subtraction, estimate."""
    live, _ = split_sealed(contracts, sheet.force_refresh)
    windows = contract_windows(
        live, underlyings, calendar.seconds_window(days, sheet.today), sheet
    )
    ledger = coverage.where(F.lit(False)) if sheet.force_refresh else coverage
    walked = subtract_coverage(
        classify_chunks(candidate_chunks(windows), ledger), sheet.probe_backward
    )
    return estimate_rows(walked, typical, days, sessions)


def plan_spot(
    underlyings: DataFrame, expiries: DataFrame, coverage: DataFrame,
    days: DataFrame, typical: DataFrame, sessions: DataFrame, sheet: Sheet,
) -> DataFrame:
    """Spot requests of a sheet end to end."""
    windows = spot_windows(
        underlyings, expiries, calendar.seconds_window(days, sheet.today), sheet
    )
    ledger = coverage.where(F.lit(False)) if sheet.force_refresh else coverage
    walked = subtract_spot_coverage(classify_chunks(candidate_chunks(windows), ledger))
    return estimate_rows(walked, typical, days, sessions)
