"""Integrity checks. Each yields the offending rows; ``report`` counts them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.schemas import BLOCK_SIZE, FIRST_BLOCK_BASE, SPOT_ID_MAX

SERIES = ["contract_id", "res_id"]
#: Ids in a stretch; ids are 32-bit numbers.
STRETCH = 1 << 22


def duplicate_bars(candles: DataFrame) -> DataFrame:
    """Keys held more than once, with the number of copies."""
    return (
        candles.groupBy(*SERIES, "ts").agg(F.count("*").alias("copies")).where(F.col("copies") > 1)
    )


def worst_duplicates(candles: DataFrame, limit: int = 50) -> DataFrame:
    """The most duplicated keys."""
    return (
        duplicate_bars(candles)
        .orderBy(F.desc("copies"), "contract_id", "res_id", "ts")
        .limit(limit)
    )


def ledger_mismatches(coverage: DataFrame, candles: DataFrame) -> DataFrame:
    """Series whose successful chunks claim another number of bars than there are."""
    claimed = (
        coverage.where("status = 'ok'").groupBy(*SERIES).agg(F.sum("row_count").alias("claimed"))
    )
    actual = candles.groupBy(*SERIES).agg(F.count("*").alias("actual"))
    joined = claimed.join(actual, SERIES, "left").withColumn(
        "actual", F.coalesce("actual", F.lit(0)).cast("bigint")
    )
    return joined.where(F.col("claimed") != F.col("actual"))


def worst_mismatches(coverage: DataFrame, candles: DataFrame, limit: int = 200) -> DataFrame:
    """The largest disagreements between ledger and bars."""
    return (
        ledger_mismatches(coverage, candles)
        .orderBy(F.desc(F.abs(F.col("claimed") - F.col("actual"))), *SERIES)
        .limit(limit)
    )


def contracts_without_bars(contracts: DataFrame, bounds: DataFrame) -> DataFrame:
    return contracts.where("kind <> 'SPOT'").join(
        bounds.select("contract_id"), "contract_id", "left_anti"
    )


def stray_spot_ids(contracts: DataFrame) -> DataFrame:
    return contracts.where((F.col("kind") == "SPOT") & (F.col("contract_id") > SPOT_ID_MAX))


def low_contract_ids(contracts: DataFrame) -> DataFrame:
    return contracts.where((F.col("kind") != "SPOT") & (F.col("contract_id") < FIRST_BLOCK_BASE))


def outside_block(contracts: DataFrame, expiries: DataFrame) -> DataFrame:
    blocks = expiries.where("contract_id_lo IS NOT NULL").select(
        "expiry_id", "contract_id_lo", "contract_id_hi"
    )
    return (
        contracts.where("kind <> 'SPOT'")
        .join(blocks, "expiry_id")
        .where(
            (F.col("contract_id") < F.col("contract_id_lo"))
            | (F.col("contract_id") > F.col("contract_id_hi"))
        )
    )


def overlapping_blocks(expiries: DataFrame, stretch: int = 1 << 22) -> DataFrame:
    """Pairs of expiries whose id blocks intersect.

    One sweep along the id line numbers the blocks by their start. A block that starts as number n
    and ends when m have started meets exactly the blocks n + 1 to m: those numbers are its pairs,
    and nothing else is formed. The sweep runs in stretches of ids, each on top of the number of
    starts in the stretches before it (at most 512 for the id type).
    """
    blocks = expiries.where("contract_id_lo IS NOT NULL").select(
        F.col("expiry_id").alias("id"), F.col("contract_id_lo").cast("bigint").alias("lo"), F.col("contract_id_hi").cast("bigint").alias("hi")
    )
    ends = F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("start")), F.struct(F.col("hi").alias("at"), F.lit(0).alias("start")))
    events = blocks.where("hi >= lo").select("id", F.inline(ends)).withColumn("part", F.floor(F.col("at") / stretch))
    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = events.groupBy("part").agg(F.sum("start").alias("starts"))
    before = before.select("part", F.coalesce(F.sum("starts").over(earlier), F.lit(0)).alias("base"))
    # At one id blocks start before any ends: blocks that share only that id intersect.
    sweep = Window.partitionBy("part").orderBy("at", F.desc("start"), "id").rowsBetween(Window.unboundedPreceding, 0)
    numbered = events.withColumn("nth", F.sum("start").over(sweep)).join(before, "part").withColumn("nth", F.col("nth") + F.col("base"))
    placed = numbered.groupBy("id").agg(F.max(F.when(F.col("start") == 1, F.col("nth"))).alias("own"), F.max("nth").alias("last"))
    met = placed.where("last > own").select("id", F.explode(F.sequence(F.col("own") + 1, "last")).alias("own"))
    return met.join(placed.select("own", F.col("id").alias("other")), "own").select(
        F.least("id", "other").alias("a_id"), F.greatest("id", "other").alias("b_id")
    )


def overlap_count(expiries: DataFrame, stretch: int = 1 << 22) -> DataFrame:
    """How many pairs of blocks intersect, without forming a pair.

    Blocks open and close along the id line; a block that opens meets every block still open. The
    running count is taken per stretch of ids on top of the totals of the stretches before it (at
    most 512 for the id type).
    """
    blocks = expiries.where("contract_id_lo IS NOT NULL")
    events = blocks.select(
        F.inline(
            F.array(
                F.struct(F.col("contract_id_lo").cast("bigint").alias("at"), F.lit(1).alias("step")),
                F.struct(
                    (F.col("contract_id_hi").cast("bigint") + 1).alias("at"), F.lit(-1).alias("step")
                ),
            )
        )
    ).withColumn("part", F.floor(F.col("at") / stretch))
    before = (
        events.groupBy("part")
        .agg(F.sum("step").alias("net"))
        .withColumn(
            "base",
            F.coalesce(
                F.sum("net").over(
                    Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .select("part", "base")
    )
    inside = Window.partitionBy("part").orderBy("at", "step").rowsBetween(
        Window.unboundedPreceding, -1
    )
    still_open = F.coalesce(F.sum("step").over(inside), F.lit(0))
    return (
        events.withColumn("open", still_open)
        .join(before, "part")
        .where("step = 1")
        .agg(F.coalesce(F.sum(F.col("open") + F.col("base")), F.lit(0)).alias("offending"))
    )


def blocks_reaching_back(expiries: DataFrame) -> DataFrame:
    """Expiries whose block starts inside an earlier one.

    The id space is cut into stretches, of which there are 512 at most: the furthest end before a
    block is the greater of that of earlier stretches and that of earlier blocks of its own.
    """
    blocks = expiries.where("contract_id_lo IS NOT NULL").withColumn("part", F.floor(F.col("contract_id_lo") / STRETCH))
    ends = blocks.groupBy("part").agg(F.max("contract_id_hi").alias("end"))
    parts = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("part", F.max("end").over(parts).alias("end_before"))
    order = Window.partitionBy("part").orderBy("contract_id_lo", "expiry_id")
    own = F.max("contract_id_hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return (
        blocks.withColumn("own", own)
        .join(before, "part")
        .withColumn("reach", F.greatest("own", "end_before"))
        .where(F.col("reach") >= F.col("contract_id_lo"))
        .select("expiry_id", "contract_id_lo", "reach")
    )


def unaligned_blocks(expiries: DataFrame) -> DataFrame:
    return expiries.where(
        F.col("contract_id_lo").isNotNull() & (F.col("contract_id_lo") % BLOCK_SIZE != 0)
    )


def orphan_series(candles: DataFrame, contracts: DataFrame) -> DataFrame:
    """Contract ids that have bars and no contract row; ids are made distinct before the join."""
    return (
        candles.select("contract_id")
        .distinct()
        .join(contracts.select("contract_id"), "contract_id", "left_anti")
    )


def report(
    candles: DataFrame, coverage: DataFrame, bounds: DataFrame, contracts: DataFrame,
    expiries: DataFrame,
) -> DataFrame:
    """``(check_name, offending)`` of every check."""
    checks = {
        "duplicate_keys": duplicate_bars(candles),
        "coverage_row_mismatch": ledger_mismatches(coverage, candles),
        "contracts_with_no_bars": contracts_without_bars(contracts, bounds),
        "spot_id_out_of_reserved_range": stray_spot_ids(contracts),
        "contract_id_below_first_block": low_contract_ids(contracts),
        "contract_id_outside_block": outside_block(contracts, expiries),
        "unaligned_id_blocks": unaligned_blocks(expiries),
        "candles_without_a_contract": orphan_series(candles, contracts),
    }
    rows = [
        df.agg(F.count("*").alias("offending")).select(F.lit(name).alias("check_name"), "offending")
        for name, df in checks.items()
    ]
    rows.append(
        overlap_count(expiries).select(F.lit("overlapping_id_blocks").alias("check_name"), "offending")
    )
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out
