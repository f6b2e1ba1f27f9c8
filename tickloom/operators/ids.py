"""Contract ids: one aligned block per expiry, strikes in order inside it.

Ids are a prefix sum over *new expiries*, a table with one row per expiry. It is summed per
underlying first, and only the per-underlying totals (at most 999, the spot id space) meet in one
window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators import asof, catalog
from tickloom.schemas import BLOCK_SIZE, FIRST_BLOCK_BASE, MAX_CONTRACT_ID, SPOT_ID_MAX


def running_totals(df: DataFrame, amount: str, out: str) -> DataFrame:
    """Inclusive running sum in (underlying_id, expiry_date) order, in three levels: stretches of
    4096 underlyings, underlyings inside a stretch, expiries of an underlying."""
    totals = df.groupBy("underlying_id").agg(F.sum(amount).alias("_t")).withColumn(
        "_part", F.floor(F.col("underlying_id") / 4096)
    )

    def earlier(column: str, part: Column, order: str) -> Column:
        rows = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(column).over(rows), F.lit(0))

    parts = totals.groupBy("_part").agg(F.sum("_t").alias("_p"))
    parts = parts.select("_part", earlier("_p", F.lit(0), "_part").alias("_parts_before"))
    before = totals.withColumn("_own_before", earlier("_t", F.col("_part"), "underlying_id")).join(parts, "_part").select(
        "underlying_id", (F.col("_parts_before") + F.col("_own_before")).alias("_before")
    )
    inside = F.sum(amount).over(
        Window.partitionBy("underlying_id")
        .orderBy("expiry_date")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        df.withColumn("_inside", inside)
        .join(before, "underlying_id")
        .withColumn(out, (F.col("_inside") + F.col("_before")).cast("bigint"))
        .drop("_inside", "_before")
    )


def block_size(contract_count: Column) -> Column:
    """Padded block size: whole units, at least one."""
    return F.greatest(F.ceil(contract_count / BLOCK_SIZE), F.lit(1)).cast("bigint") * BLOCK_SIZE


def allocate_blocks(expiries: DataFrame, counts: DataFrame) -> DataFrame:
    """``(underlying_id, expiry_date, contract_count)`` to blocks.

    A recorded block is reused while it fits; an overflowing or new expiry takes the next block
    after the highest one recorded. ``outcome`` says which; ``too_high`` marks a block beyond the
    id type.
    """
    keys = ["underlying_id", "expiry_date"]
    recorded = expiries.select(
        *keys, F.col("contract_id_lo").alias("old_lo"), F.col("contract_id_hi").alias("old_hi")
    )
    wanted = counts.join(recorded, keys, "left").withColumn(
        "needed", block_size(F.col("contract_count"))
    )
    fits = F.col("old_lo").isNotNull() & (
        F.col("old_hi") - F.col("old_lo") + 1 >= F.col("needed")
    )
    judged = wanted.withColumn(
        "outcome",
        F.when(fits, "reused").when(F.col("old_lo").isNotNull(), "relocated").otherwise("created"),
    )
    top = expiries.agg(
        F.greatest(F.coalesce(F.max("contract_id_hi") + 1, F.lit(0)), F.lit(FIRST_BLOCK_BASE)).alias(
            "base"
        )
    )
    placed = running_totals(judged.where("outcome <> 'reused'"), "needed", "_end").withColumn(
        "base", top.scalar()
    )
    hi = F.col("base") + F.col("_end") - 1
    fresh = placed.select(
        *keys, "contract_count", "outcome",
        (hi - F.col("needed") + 1).alias("contract_id_lo"), hi.alias("contract_id_hi"),
    )
    reused = judged.where("outcome = 'reused'").select(
        *keys, "contract_count", "outcome",
        F.col("old_lo").cast("bigint").alias("contract_id_lo"),
        F.col("old_hi").cast("bigint").alias("contract_id_hi"),
    )
    return fresh.unionByName(reused).withColumn(
        "too_high", F.col("contract_id_hi") > MAX_CONTRACT_ID
    )


def assign(batch: DataFrame, blocks: DataFrame, existing: DataFrame) -> DataFrame:
    """Contract ids of a deduplicated batch.

    An id already recorded stays when it is inside the block; other symbols take the lowest free
    slots in id order. Free slots are the gaps between kept ids: the k-th of a block lies in the last
    gap with fewer than k free slots before it. Symbols beyond the last free slot of a full block come
    back without an id.
    """
    keys = ["underlying_id", "expiry_date"]
    placed = batch.join(blocks.select(*keys, "contract_id_lo", "contract_id_hi"), keys).join(
        existing.select("fyers_symbol", F.col("contract_id").alias("_had")), "fyers_symbol", "left"
    )
    stays = F.col("_had").between(F.col("contract_id_lo"), F.col("contract_id_hi"))
    kept = placed.where(stays).withColumn("contract_id", F.col("_had").cast("bigint"))
    fresh = placed.where(~F.coalesce(stays, F.lit(False)))
    taken = kept.select(*keys, F.col("contract_id").alias("_at")).distinct()
    edges = blocks.where("contract_id_lo IS NOT NULL").select(
        *keys, F.explode(F.array((F.col("contract_id_lo") - 1).cast("bigint"), (F.col("contract_id_hi") + 1).cast("bigint"))).alias("_at")
    )
    along = Window.partitionBy(*keys).orderBy("_at")
    gaps = taken.unionByName(edges).select(*keys, (F.lag("_at").over(along) + 1).alias("_first"), "_at")
    gaps = gaps.where("_at > _first").withColumn("_size", F.col("_at") - F.col("_first"))
    free_before = F.sum("_size").over(Window.partitionBy(*keys).orderBy("_first")) - F.col("_size")
    gaps = gaps.withColumn("_free", free_before)
    ranked = fresh.withColumn(
        "_nth",
        F.row_number().over(Window.partitionBy(*keys).orderBy(*catalog.in_id_order(fresh))).cast("bigint") - 1,
    )
    found = asof.asof_backward(ranked, gaps, keys, "_nth", "_free", ["_first", "_size"], bucket_seconds=1 << 16, matched_ts="_gap")
    inside = F.col("_nth") - F.col("_gap")
    given = found.withColumn("contract_id", F.when(inside < F.col("_size"), F.col("_first") + inside))
    columns = [*batch.columns, "contract_id", "_had"]
    return (
        kept.select(*columns)
        .unionByName(given.select(*columns))
        .withColumn("contract_id", F.col("contract_id").cast("int"))
    )


def renumbered(assigned: DataFrame) -> DataFrame:
    """``(old_id, new_id)`` of symbols whose id changed."""
    return assigned.where("_had IS NOT NULL AND _had <> contract_id").select(
        F.col("_had").alias("old_id"), F.col("contract_id").alias("new_id")
    )


def unplaced(assigned: DataFrame) -> DataFrame:
    """Symbols whose block had no slot left, for which a larger block must be allocated."""
    return assigned.where("contract_id IS NULL")


def lowest_free_spot_id(underlyings: DataFrame) -> DataFrame:
    """The lowest unused spot id as one row, null when all 999 are taken."""
    spark = underlyings.sparkSession
    slots = spark.range(1, SPOT_ID_MAX + 1).select(F.col("id").cast("int").alias("spot_contract_id"))
    return slots.join(
        underlyings.select("spot_contract_id"), "spot_contract_id", "left_anti"
    ).agg(F.min("spot_contract_id").alias("spot_contract_id"))
