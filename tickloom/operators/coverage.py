"""Coverage rollups. They read the ledger and the bounds, never the bar table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.rows import count_where
from tickloom.operators import intervals


def grid(coverage: DataFrame, contracts: DataFrame, expiries: DataFrame) -> DataFrame:
    """Expiry by resolution matrix per underlying; spot series have no cell.

    The distinct contract count is taken by collapsing to one row per contract first, so a hot
    cell is spread over its contracts.
    """
    per_contract = (
        coverage.groupBy("contract_id", "res_id")
        .agg(
            count_where(F.col("status") == "ok").alias("ok"),
            count_where(F.col("status") == "empty").alias("empty"),
            count_where(F.col("status") == "error").alias("error"),
            F.sum("row_count").alias("rows"),
            F.min("range_from").alias("have_from"),
            F.max("range_to").alias("have_to"),
        )
        .join(
            contracts.where("kind <> 'SPOT'").select(
                "contract_id", "underlying_id", "expiry_id", "expiry_date"
            ),
            "contract_id",
        )
    )
    cells = per_contract.groupBy("underlying_id", "expiry_id", "expiry_date", "res_id").agg(
        F.count("*").alias("contracts_covered"),
        F.sum("ok").alias("chunks_ok"),
        F.sum("empty").alias("chunks_empty"),
        F.sum("error").alias("chunks_error"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.min("have_from").alias("have_from"),
        F.max("have_to").alias("have_to"),
    )
    total = F.coalesce(F.col("contract_count"), F.lit(0)).cast("bigint")
    return (
        cells.join(expiries.select("expiry_id", "contract_count"), "expiry_id", "left")
        .withColumn("contracts_total", total)
        .withColumn(
            "contracts_missing",
            F.greatest(F.col("contracts_total") - F.col("contracts_covered"), F.lit(0)),
        )
        .drop("expiry_id", "contract_count")
    )


def per_contract(coverage: DataFrame, contracts: DataFrame) -> DataFrame:
    """What is held of each contract at each resolution."""
    summed = coverage.groupBy("contract_id", "res_id").agg(
        F.min("range_from").alias("have_from"),
        F.max("range_to").alias("have_to"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows_held"),
        count_where(F.col("status") == "empty").alias("empty_chunks"),
    )
    return summed.join(
        contracts.select("contract_id", "fyers_symbol", "strike", "option_type", "expiry_date"),
        "contract_id",
    )


def gaps(coverage: DataFrame, contracts: DataFrame) -> DataFrame:
    """Holes between recorded chunks with the contract they belong to."""
    return intervals.gaps_after(coverage).join(
        contracts.select("contract_id", "fyers_symbol", "expiry_date", "underlying_id"),
        "contract_id",
    )


def needing_data(contracts: DataFrame, coverage: DataFrame, res_id: int) -> DataFrame:
    """Non-spot contracts with no chunk at a resolution."""
    fetched = coverage.where(F.col("res_id") == res_id).select("contract_id")
    return contracts.where("kind <> 'SPOT'").join(fetched, "contract_id", "left_anti")


def expiries_with_holes(
    coverage: DataFrame, contracts: DataFrame, newest: int | None = None
) -> DataFrame:
    """Expiries with a failed chunk or a hole between chunks, the newest ``n`` per underlying."""
    dated = contracts.where("expiry_date IS NOT NULL").select(
        "contract_id", "underlying_id", "expiry_date"
    )
    failed = coverage.where("status = 'error'").select("contract_id").distinct()
    holed = intervals.gaps_after(coverage).select("contract_id").distinct()
    expiries = (
        failed.unionByName(holed)
        .join(dated, "contract_id")
        .select("underlying_id", "expiry_date")
        .distinct()
    )
    return expiries if newest is None else newest_per_underlying(expiries, newest)


def newest_per_underlying(expiries: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` expiries of each underlying."""
    order = Window.partitionBy("underlying_id").orderBy(F.desc("expiry_date"))
    return expiries.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")
