"""The instrument master as a type-2 dimension.

``valid_to`` is exclusive. A day's file is merged by one full outer join of the open rows with the
staged rows on token; closed history only passes through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import clock
from tickloom.functions.rows import replace_by_key
from tickloom.schemas import MASTER_NAMES

ATTRIBUTES = [n for n in MASTER_NAMES if n != "fytoken"] + ["row_hash"]
HISTORY = [*MASTER_NAMES, "row_hash", "valid_from", "valid_to"]
SHRINK_FLOOR = 0.5
FACTS = ["min_lot_size", "tick_size", "qty_freeze", "qty_multiplier"]


def merge_actions(history: DataFrame, staged: DataFrame, as_of: str) -> DataFrame:
    """Open rows and staged rows matched on token with what happens to each.

    amended: opened today and different, corrected in place. versioned: opened earlier and
    different, closed and reopened. closed: gone from a file that covers its exchange and segment.
    inserted: no open row. unchanged: the rest. A closed row that began today rides along, because
    a relisting on that date takes its place.
    """
    today = clock.day(as_of)
    scope = (
        staged.where("exchange_code IS NOT NULL AND segment_code IS NOT NULL")
        .select("exchange_code", "segment_code")
        .distinct()
        .withColumn("_in_scope", F.lit(True))
    )
    old_rows = (
        history.where(F.col("valid_to").isNull() | (F.col("valid_from") == today))
        .join(scope, ["exchange_code", "segment_code"], "left")
        .select("fytoken", F.struct(*ATTRIBUTES, "valid_from", "valid_to").alias("old"), "_in_scope")
    )
    new_rows = staged.select("fytoken", F.struct(*ATTRIBUTES).alias("new"))
    both = old_rows.join(new_rows, "fytoken", "full_outer")
    old, new = F.col("old"), F.col("new")
    is_open = old.isNotNull() & old["valid_to"].isNull()
    differs = old["row_hash"] != new["row_hash"]
    gone = F.coalesce(F.col("_in_scope"), F.lit(False)) & (old["valid_from"] < today)
    action = (
        F.when(~is_open & new.isNotNull(), "inserted")
        .when(~is_open, "kept")
        .when(new.isNull(), F.when(gone, "closed").otherwise("kept"))
        .when(differs & (old["valid_from"] == today), "amended")
        .when(differs & (old["valid_from"] < today), "versioned")
        .otherwise("unchanged")
    )
    return both.withColumn("action", action).drop("_in_scope")


def merge(history: DataFrame, staged: DataFrame, as_of: str) -> DataFrame:
    """Next state of the whole dimension after one day's file: one join, history passed through."""
    today = clock.day(as_of)

    def row(source: Column, valid_from: Column, valid_to: Column) -> Column:
        return F.struct(
            F.col("fytoken"),
            *[source[a].alias(a) for a in ATTRIBUTES],
            valid_from.alias("valid_from"),
            valid_to.alias("valid_to"),
        )

    old, new, action = F.col("old"), F.col("new"), F.col("action")
    still_open = F.lit(None).cast("date")
    closed_old = row(old, old["valid_from"], today)
    opened_new = row(new, today, still_open)
    next_rows = (
        F.when(action.isin("inserted", "amended"), F.array(opened_new))
        .when(action == "versioned", F.array(closed_old, opened_new))
        .when(action == "closed", F.array(closed_old))
        .otherwise(F.array(row(old, old["valid_from"], old["valid_to"])))
    )
    moved = merge_actions(history, staged, as_of).select(F.inline(next_rows))
    past = history.where(F.col("valid_to").isNotNull() & (F.col("valid_from") != today))
    return past.select(*HISTORY).unionByName(moved.select(*HISTORY))


def merge_counts(actions: DataFrame) -> DataFrame:
    """How many instruments each action touched."""
    return actions.where("action <> 'kept'").groupBy("action").agg(F.count("*").alias("n"))


def shrink_guard(
    staged: DataFrame, snapshots: DataFrame, by: str = "file", floor: float = SHRINK_FLOOR
) -> DataFrame:
    """Staged against previous row counts per file with ``refused``. A short file cannot be told
    from a mass delisting, so it must not be merged."""
    counted = staged.groupBy(by).agg(F.count("*").alias("staged"))
    previous = latest_snapshots(snapshots, by).select(by, F.col("row_count").alias("previous"))
    joined = counted.join(previous, by, "full_outer").withColumns(
        {
            "staged": F.coalesce("staged", F.lit(0)).cast("bigint"),
            "previous": F.coalesce("previous", F.lit(0)).cast("bigint"),
        }
    )
    return joined.withColumn(
        "refused", (F.col("previous") > 0) & (F.col("staged") < F.col("previous") * floor)
    )


def latest_snapshots(snapshots: DataFrame, by: str = "file") -> DataFrame:
    """The newest snapshot row of each file."""
    rest = [c for c in snapshots.columns if c != by]
    return (
        snapshots.groupBy(by)
        .agg(F.max_by(F.struct(*rest), "snapshot_date").alias("s"))
        .select(by, *[F.col(f"s.{c}").alias(c) for c in rest])
    )


def record_snapshots(snapshots: DataFrame, today: DataFrame) -> DataFrame:
    """Snapshot manifest after a day: one row per (date, file), the later write wins."""
    return replace_by_key(snapshots, today, ["snapshot_date", "file"])


def needs_diff(today: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Files whose content moved since their newest snapshot; the rest only record the day."""
    known = latest_snapshots(snapshots).select("file", F.col("sha256").alias("_known"))
    return today.join(known, "file", "left").withColumn(
        "changed", F.col("_known").isNull() | (F.col("_known") != F.col("sha256"))
    ).drop("_known")


def facts_on(history: DataFrame, requests: DataFrame, key: str = "fytoken") -> DataFrame:
    """The version of each ``(key, on_date)`` true on its date; misses keep null facts."""
    versions = history.select(
        F.col(key).alias("_k"), *FACTS, "valid_from", "valid_to",
        *(["fytoken"] if key != "fytoken" else []),
    )
    return requests.join(
        versions,
        (requests[key] == F.col("_k"))
        & (F.col("valid_from") <= requests["on_date"])
        & (F.col("valid_to").isNull() | (F.col("valid_to") > requests["on_date"])),
        "left",
    ).drop("_k", "valid_to")


def enrich_contracts(contracts: DataFrame, history: DataFrame) -> DataFrame:
    """Contracts with token and sizing facts as of their expiry; a miss keeps the row as it was."""
    filled = {
        "fytoken": "fytoken",
        "lot_size": "min_lot_size",
        "tick_size": "tick_size",
        "qty_freeze": "qty_freeze",
        "qty_multiplier": "qty_multiplier",
    }
    versions = history.select(
        F.col("symbol_ticker").alias("fyers_symbol"),
        *[F.col(source).alias(f"_m_{target}") for target, source in filled.items()],
        "valid_from",
        "valid_to",
    )
    c = contracts
    joined = c.join(
        versions,
        (c["fyers_symbol"] == versions["fyers_symbol"])
        & (versions["valid_from"] <= c["expiry_date"])
        & (versions["valid_to"].isNull() | (versions["valid_to"] > c["expiry_date"])),
        "left",
    )
    hit = F.col("valid_from").isNotNull()

    def value(name: str) -> Column:
        was = c[name] if name in c.columns else F.lit(None)
        return F.when(hit, F.col(f"_m_{name}")).otherwise(was).alias(name)

    return joined.select(
        *[c[n] for n in c.columns if n not in filled],
        *[value(n) for n in filled],
        F.col("valid_from").alias("instrument_master_valid_from"),
        hit.alias("is_hit"),
    )
