"""Predicates and join keys that let a scan of the stored bar table skip folders.

The stored table has ``id_block`` and ``trade_month``; other bar tables do not, and pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.schemas import BLOCK_SIZE

WIDTH = "ids_per_block"
FOLDERS = ["id_block", "trade_month"]


def width(candles: DataFrame) -> int | None:
    """Ids per block of a stored table, ``None`` for any other."""
    if not set(FOLDERS) <= set(candles.columns):
        return None
    return candles.schema["id_block"].metadata.get(WIDTH, BLOCK_SIZE)


def block(contract_id: Column, ids_per_block: int) -> Column:
    return F.floor(contract_id / ids_per_block).cast("int")


def of_series(candles: DataFrame, contract_id: int) -> DataFrame:
    """Bars in the folders of one contract."""
    ids = width(candles)
    return candles if ids is None else candles.where(F.col("id_block") == contract_id // ids)


def of_months(candles: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Bars in the folders of the months from one moment to another, both given as text."""
    if width(candles) is None:
        return candles
    if first is not None:
        candles = candles.where(F.col("trade_month") >= first[:7])
    return candles if last is None else candles.where(F.col("trade_month") <= last[:7])


def keyed(candles: DataFrame, wanted: DataFrame, day: str | None = None) -> tuple[DataFrame, list[str]]:
    """``wanted`` with the folder columns of its contracts (and of ``day``), and the keys to join on.

    The comparison marks the wanted side as selective, so the join prunes the scan at run time.
    """
    ids = width(candles)
    if ids is None:
        return wanted, []
    wanted = wanted.withColumn("id_block", block(F.col("contract_id"), ids)).where("id_block >= 0")
    if day is None:
        return wanted, ["id_block"]
    return wanted.withColumn("trade_month", F.date_format(day, "yyyy-MM")), FOLDERS
