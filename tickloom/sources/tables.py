"""Fact and dimension scans behind one name each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom import schemas


def candles(spark: SparkSession, path: str) -> DataFrame:
    """The bar fact table. Layout columns used for pruning are dropped from the logical view."""
    df = spark.read.parquet(path)
    return df.select(*schemas.CANDLE_COLUMNS)


def publish_views(spark: SparkSession, **tables: DataFrame) -> None:
    """Register each table as a temporary view; the bar table becomes ``v_candle`` as well, so
    every query above it goes through one name."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
        if name == "candles":
            df.createOrReplaceTempView("v_candle")


def archive(spark: SparkSession, root: str) -> DataFrame:
    """A partitioned archive read back; filters on the partition columns prune directories."""
    return spark.read.parquet(f"{root}/candles")


def archive_catalog(spark: SparkSession, root: str, table: str) -> DataFrame:
    """One dimension stored beside an archive."""
    return spark.read.parquet(f"{root}/{table}.parquet")
