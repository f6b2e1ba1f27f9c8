"""State changes as functions from the current tables and a delta to the next tables.

Nothing here runs an action. Anti-joins and unions express replace, and the sinks decide which
partitions the next state is written to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import clock, folders
from tickloom.functions.rows import latest_per_key, replace_by_key
from tickloom.operators import aggregates, intervals
from tickloom.operators.ids import running_totals
from tickloom.schemas import CANDLE_COLUMNS, COVERAGE_KEY, MINUTE_RES_ID

SERIES = ["contract_id", "res_id"]


# -- bars and ledger -----------------------------------------------------------------------------


def latest_requests(chunks: DataFrame) -> DataFrame:
    """One row per request key out of a batch, the latest fetched; the payload digest breaks ties."""
    return latest_per_key(
        chunks, COVERAGE_KEY, [F.col("fetched_at"), F.coalesce("payload_sha256", F.lit(""))]
    )


def changed_chunks(chunks: DataFrame, coverage: DataFrame) -> DataFrame:
    """Chunks whose digest and status the ledger does not already record under the same key."""
    recorded = coverage.where("payload_sha256 IS NOT NULL").select(
        *COVERAGE_KEY, "payload_sha256", "status"
    )
    return chunks.join(recorded, [*COVERAGE_KEY, "payload_sha256", "status"], "left_anti")


def outside_windows(candles: DataFrame, chunks: DataFrame) -> DataFrame:
    """Bars no chunk of the batch claims.

    Windows are whole days: merged first, then laid on their days, so the day is part of the join
    key and a series with most of the bars is spread over its days.
    """
    days = F.explode(F.sequence("range_from", "range_to")).alias("_day")
    claimed = intervals.merge(chunks.select(*COVERAGE_KEY)).select("contract_id", "res_id", days)
    return candles.withColumn("_day", F.to_date("ts")).join(
        claimed, ["contract_id", "res_id", "_day"], "left_anti"
    ).select(*candles.columns)


def replace_chunks(candles: DataFrame, chunks: DataFrame, bars: DataFrame) -> DataFrame:
    """Next bar table: exactly the requested windows are emptied and refilled, so a replay changes
    nothing and a shorter answer removes what is gone."""
    return outside_windows(candles, chunks).unionByName(bars.select(*CANDLE_COLUMNS))


def upsert_coverage(coverage: DataFrame, chunks: DataFrame) -> DataFrame:
    """Next ledger: one row per request key, the new one replacing the old."""
    return replace_by_key(coverage, chunks, COVERAGE_KEY)


def refresh_bounds(partials: DataFrame, candles: DataFrame, touched: DataFrame) -> DataFrame:
    """Next partial bounds, a row a series and folder: those of the touched folders from their bars,
    which are all that is read, the others as they are. A series emptied there loses its row."""
    fresh = aggregates.bounds(candles.join(touched.where("id_block >= 0"), folders.FOLDERS, "left_semi"), *folders.FOLDERS)
    return partials.join(touched, folders.FOLDERS, "left_anti").unionByName(fresh.select(*partials.columns))


# -- catalog ---------------------------------------------------------------------------------------


def upsert_underlyings(current: DataFrame, delta: DataFrame) -> DataFrame:
    """Next underlyings. A renamed symbol displaces the old row by either of its keys; the spot id
    already recorded is kept when the delta brings none."""
    known = current.select("underlying_id", F.col("spot_contract_id").alias("_spot"))
    resolved = (
        delta.join(known, "underlying_id", "left")
        .withColumn("spot_contract_id", F.coalesce("spot_contract_id", "_spot"))
        .drop("_spot")
    )
    kept = current.join(delta.select("underlying_id"), "underlying_id", "left_anti").join(
        delta.select("fyers_symbol"), "fyers_symbol", "left_anti"
    )
    return kept.select(*current.columns).unionByName(resolved.select(*current.columns))


def spot_contract_rows(underlyings: DataFrame, current: DataFrame, now: str) -> DataFrame:
    """Next contracts after the spot row of each underlying is rewritten; first_seen_at stays."""
    seen = current.select("contract_id", F.col("first_seen_at").alias("_seen"))
    fresh = underlyings.select(
        F.col("spot_contract_id").alias("contract_id"),
        "underlying_id",
        "fyers_symbol",
        F.lit("SPOT").alias("kind"),
        F.col("instrument_kind").alias("instrument_class"),
        "exchange",
        "segment",
        "root",
    ).join(seen, "contract_id", "left")
    filled = fresh.withColumn("first_seen_at", F.coalesce("_seen", clock.ntz(now))).withColumn(
        "last_seen_at", clock.ntz(now)
    )
    missing = [c for c in current.columns if c not in filled.columns]
    shaped = filled.withColumns(
        {c: F.lit(None).cast(current.schema[c].dataType) for c in missing}
    ).select(*[F.col(c).cast(current.schema[c].dataType).alias(c) for c in current.columns])
    kept = current.join(shaped.select("contract_id"), "contract_id", "left_anti").join(
        shaped.select("fyers_symbol"), "fyers_symbol", "left_anti"
    )
    return kept.select(*current.columns).unionByName(shaped)


def upsert_expiries(current: DataFrame, delta: DataFrame, id_column: str = "expiry_id") -> DataFrame:
    """Next expiries. A known expiry keeps its id, block and counts and only refreshes what
    discovery said; new ones follow the highest id in (underlying, date) order."""
    keys = ["underlying_id", "expiry_date"]
    provenance = [
        "expiry_cycle_derived", "is_last_of_month", "source_range_from", "source_range_to",
    ]
    new = delta.select(*keys, F.struct(*[c for c in delta.columns if c not in keys]).alias("new"))
    old = current.select(*keys, F.struct(*[c for c in current.columns if c not in keys]).alias("old"))
    both = old.join(new, keys, "full_outer")
    fresh = running_totals(
        both.where("old IS NULL").select(*keys, F.lit(1).alias("_one")), "_one", "_nth"
    )
    top = current.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("_top"))
    numbered = fresh.select(*keys, (top.scalar() + F.col("_nth")).cast("int").alias("_new_id"))
    merged = both.join(numbered, keys, "left")
    touched = F.col("new").isNotNull()

    def value(name: str) -> Column:
        was = F.col(f"old.{name}")
        if name == id_column:
            return F.coalesce(was, F.col("_new_id"))
        if name in ("has_futures", "has_options"):
            return F.coalesce(was, F.lit(False))
        if name == "expiry_dow":
            return F.when(touched, clock.iso_weekday(F.col("expiry_date"))).otherwise(was)
        if name == "expiry_cycle_source" and name in delta.columns:
            return F.coalesce(F.col(f"new.{name}"), was)
        if name == "discovered_at" and name in delta.columns:
            return F.coalesce(was, F.col(f"new.{name}"))
        if name in provenance and name in delta.columns:
            return F.coalesce(F.col(f"new.{name}"), was)
        return was

    return merged.select(
        *[
            F.col(c) if c in keys else value(c).cast(current.schema[c].dataType).alias(c)
            for c in current.columns
        ]
    )


def one_per_symbol(listed: DataFrame) -> DataFrame:
    """One row per symbol of a batch; the later position wins, futures coming before options."""
    array_rank = F.when(F.col("source_array") == "futures", 0).otherwise(1)
    return latest_per_key(
        listed, ["fyers_symbol"], [array_rank, F.col("source_array_index")], listed.columns
    ).select(*listed.columns)


def upsert_contracts(current: DataFrame, batch: DataFrame, now: str) -> DataFrame:
    """Next contracts after a discovery batch with ids: adds and updates, never removes; the first
    sighting of a symbol is kept."""
    seen = current.select("fyers_symbol", F.col("first_seen_at").alias("_seen"))
    stamped = (
        batch.join(seen, "fyers_symbol", "left")
        .withColumn("first_seen_at", F.coalesce("_seen", clock.ntz(now)))
        .withColumn("last_seen_at", clock.ntz(now))
        .drop("_seen")
    )
    missing = [c for c in current.columns if c not in stamped.columns]
    shaped = stamped.withColumns(
        {c: F.lit(None).cast(current.schema[c].dataType) for c in missing}
    ).select(*[F.col(c).cast(current.schema[c].dataType).alias(c) for c in current.columns])
    kept = current.join(shaped.select("contract_id"), "contract_id", "left_anti").join(
        shaped.select("fyers_symbol"), "fyers_symbol", "left_anti"
    )
    return kept.select(*current.columns).unionByName(shaped)


def remap_ids(table: DataFrame, mapping: DataFrame) -> DataFrame:
    """A table that references contract ids after a renumbering ``(old_id, new_id)``."""
    moved = mapping.select(F.col("old_id").alias("contract_id"), "new_id")
    return table.join(moved, "contract_id", "left").select(
        *[
            F.coalesce("new_id", "contract_id").cast(table.schema[c].dataType).alias(c)
            if c == "contract_id"
            else F.col(c)
            for c in table.columns
        ]
    )


def remap_collisions(mapping: DataFrame) -> DataFrame:
    """New ids that are old ids of the same mapping: any row means the mapping must be refused."""
    return mapping.select(F.col("new_id").alias("id")).join(
        mapping.select(F.col("old_id").alias("id")), "id", "left_semi"
    )


def set_availability(expiries: DataFrame, seen: DataFrame) -> DataFrame:
    """OR the futures and options flags of a discovery answer onto the expiries; never unset."""
    keys = ["underlying_id", "expiry_date"]
    flags = seen.groupBy(*keys).agg(
        F.bool_or("has_futures").alias("_f"), F.bool_or("has_options").alias("_o")
    )
    joined = expiries.join(flags, keys, "left")
    return joined.withColumns(
        {
            "has_futures": F.col("has_futures") | F.coalesce("_f", F.lit(False)),
            "has_options": F.col("has_options") | F.coalesce("_o", F.lit(False)),
        }
    ).select(*expiries.columns)


def set_cycles(expiries: DataFrame, live: DataFrame) -> DataFrame:
    """Take W/M from a live chain for expiries already known; unknown ones are not created."""
    keys = ["underlying_id", "expiry_date"]
    flags = live.groupBy(*keys).agg(F.max("expiry_flag").alias("_flag"))
    joined = expiries.join(flags, keys, "left")
    known = F.col("_flag").isNotNull()
    return joined.withColumns(
        {
            "expiry_cycle_derived": F.coalesce("_flag", "expiry_cycle_derived"),
            "expiry_cycle_source": F.when(known, "api").otherwise(F.col("expiry_cycle_source")),
            "is_last_of_month": F.when(known, F.col("_flag") == "M").otherwise(
                F.col("is_last_of_month")
            ),
        }
    ).select(*expiries.columns)


def seal(contracts: DataFrame, finished: DataFrame, now: str) -> DataFrame:
    """Stamp contracts whose life is fully covered; an earlier stamp stays."""
    done = finished.select("contract_id").distinct().withColumn("_done", F.lit(True))
    joined = contracts.join(done, "contract_id", "left")
    return joined.withColumn(
        "sealed_at", F.coalesce("sealed_at", F.when(F.col("_done"), clock.ntz(now)))
    ).select(*contracts.columns)


def deactivate(underlyings: DataFrame, ids: Sequence[int]) -> DataFrame:
    """Hide underlyings without touching a bar."""
    return underlyings.withColumn(
        "is_active", F.col("is_active") & ~F.col("underlying_id").isin(list(ids))
    )


def purge(tables: dict[str, DataFrame], contracts: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """Tables that carry contract ids without the contracts of the removed underlyings."""
    ids = contracts.join(gone.select("underlying_id"), "underlying_id", "left_semi").select(
        "contract_id"
    )
    return {name: df.join(ids, "contract_id", "left_anti") for name, df in tables.items()}


def purge_count(candles: DataFrame, contracts: DataFrame, gone: DataFrame) -> DataFrame:
    """Bars a purge removes, per underlying."""
    ids = contracts.join(gone.select("underlying_id"), "underlying_id", "left_semi").select(
        "contract_id", "underlying_id"
    )
    keys, more = folders.keyed(candles, ids.select("contract_id"))
    kept = candles.join(keys, ["contract_id", *more], "left_semi")
    per_series = kept.groupBy("contract_id").agg(F.count("*").alias("n"))
    return per_series.join(ids, "contract_id").groupBy("underlying_id").agg(
        F.sum("n").alias("deleted")
    )


def prune(log: DataFrame, as_of: str, days: int, at: str = "at") -> DataFrame:
    """Log rows younger than the retention; 0 keeps everything."""
    if days <= 0:
        return log
    return log.where(F.to_date(at) >= F.date_sub(clock.day(as_of), days))


# -- runs --------------------------------------------------------------------------------------------


def open_runs(runs: DataFrame, new: DataFrame) -> DataFrame:
    """Append newly started runs."""
    empty = {c: F.lit(None).cast(runs.schema[c].dataType) for c in runs.columns if c not in new.columns}
    return runs.unionByName(new.withColumns(empty).select(*runs.columns))


def close_runs(runs: DataFrame, ended: DataFrame) -> DataFrame:
    """Write the end time, status, totals and error of finished runs."""
    facts = ["finished_at", "status", "requests_made", "rows_written", "bytes_downloaded", "error_text"]
    e = ended.select("run_id", F.struct(*facts).alias("e"))
    joined = runs.join(e, "run_id", "left")
    return joined.select(
        *[
            F.when(F.col("e").isNotNull(), F.col(f"e.{c}")).otherwise(F.col(c)).alias(c)
            if c in facts
            else F.col(c)
            for c in runs.columns
        ]
    )


def refresh_trading_days(
    current: DataFrame, candles: DataFrame, underlyings: DataFrame, res_id: int = MINUTE_RES_ID
) -> DataFrame:
    """Next trading-day table: derived rows are rebuilt, seeded ones stay."""
    return aggregates.trading_days(candles, underlyings, current, res_id)
