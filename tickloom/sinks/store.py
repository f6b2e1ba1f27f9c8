"""The bar table and its keyed companions on disk.

Bars are foldered by ``id_block`` (contract id over a block of ids, so one expiry sits in one
folder) and ``trade_month`` and sorted by key inside. A write touches only the folders its request
windows can change.

A table that changes is a series of snapshots. Each batch writes the new content of the folders it
touches under its own name, where nothing is ever changed again, and last of all one row a folder
into ``versions``. Readers take each folder from the newest batch that has such a row: a batch is
seen whole, in all tables at once, or not at all, and a folder left without rows is one whose newest
version has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions import folders as layout
from tickloom.functions.folders import FOLDERS
from tickloom import schemas
from tickloom.operators import writes
from tickloom.schemas import BLOCK_SIZE, CANDLE_COLUMNS, CANDLES
from tickloom.sinks.export import KEY, clustered

BARS_ON_DISK = f"{CANDLES}, id_block int, trade_month string"
#: Without a name, the row of the batch itself.
VERSIONS = "name string, id_block int, trade_month string, batch string"


def id_block(ids_per_block: int = BLOCK_SIZE) -> Column:
    return F.floor(F.col("contract_id") / ids_per_block).cast("int")


def with_folders(candles: DataFrame, ids_per_block: int = BLOCK_SIZE) -> DataFrame:
    """Bars with the columns they are foldered by."""
    return candles.select(*CANDLE_COLUMNS).withColumns(
        {"id_block": id_block(ids_per_block), "trade_month": F.date_format("ts", "yyyy-MM")}
    )


def write(candles: DataFrame, path: str, ids_per_block: int = BLOCK_SIZE) -> None:
    """Write the whole table clustered: also the rewrite that restores key order."""
    put(with_folders(candles, ids_per_block), path, FOLDERS, KEY)


def read(spark: SparkSession, path: str, ids_per_block: int = BLOCK_SIZE) -> DataFrame:
    """The table with its folder columns; filters on them prune. The block width stays with it."""
    table = spark.read.schema(BARS_ON_DISK).parquet(path)
    return table.withColumn("id_block", F.col("id_block").alias("id_block", metadata={layout.WIDTH: ids_per_block}))


def touched_folders(chunks: DataFrame, ids_per_block: int = BLOCK_SIZE) -> DataFrame:
    """Folders a batch of request windows can change."""
    months = F.sequence(
        F.trunc("range_from", "MM"), F.trunc("range_to", "MM"), F.make_interval(months=F.lit(1))
    )
    return (
        chunks.select(id_block(ids_per_block).alias("id_block"), F.explode(months).alias("_m"))
        .select("id_block", F.date_format("_m", "yyyy-MM").alias("trade_month"))
        .distinct()
    )


def inside(table: DataFrame, touched: DataFrame, folders: list[str]) -> DataFrame:
    """Rows of the touched folders. The comparison marks the small side as selective, so the join
    prunes the scan of the large one at run time."""
    return table.join(touched.where(F.col("id_block") >= 0), folders, "left_semi")


def next_bars(
    table: DataFrame, touched: DataFrame, chunks: DataFrame, bars: DataFrame,
    ids_per_block: int = BLOCK_SIZE,
) -> DataFrame:
    """New content of the touched bar folders."""
    current = inside(table, touched, FOLDERS)
    return writes.outside_windows(current, chunks).unionByName(
        with_folders(bars, ids_per_block).select(*current.columns)
    )


def put(df: DataFrame, path: str, folders: list[str], key: list[str]) -> None:
    """Write a whole table, or one batch's snapshot of some of its folders."""
    rows = clustered(df, [*folders, *key])
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*folders).parquet(path)


def versions(spark: SparkSession, root: str, before: str | None = None) -> DataFrame:
    """Every folder every batch wrote; those of batches before one."""
    path = f"{root}/versions"
    found = spark.read.schema(VERSIONS).parquet(path) if exists(spark, path) else spark.createDataFrame([], VERSIONS)
    return found if before is None else found.where(F.col("batch") < before)


def is_committed(spark: SparkSession, root: str, batch: str) -> bool:
    return not versions(spark, root).where(F.col("batch") == batch).isEmpty()


def commit(spark: SparkSession, root: str, batch: str, touched: dict[str, DataFrame]) -> None:
    """Make a batch visible: one small file with a row for each folder it touched, and one for itself."""
    rows = spark.createDataFrame([(None, None, None)], VERSIONS.rsplit(",", 1)[0])
    for name, folders in touched.items():
        rows = rows.unionByName(folders.withColumn("name", F.lit(name)), allowMissingColumns=True)
    rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{root}/versions/batch={batch}")


def current(
    spark: SparkSession, root: str, name: str, ddl: str, folders: list[str], before: str | None = None
) -> DataFrame:
    """A table as of the newest batch, or as it was before one. The versions prune the scan at run time."""
    path = f"{root}/{name}"
    if not exists(spark, path):
        return schemas.empty(spark, ddl)
    newest = versions(spark, root, before).where(F.col("name") == name).groupBy(*folders).agg(F.max("batch").alias("batch"))
    snapshots = spark.read.schema(f"{ddl}, batch string").parquet(path)
    return inside(snapshots, newest, ["batch", *folders]).drop("batch")


def out_of_order(table: DataFrame) -> DataFrame:
    """Files of a folder whose key range starts before an earlier one ends: none after a clustered
    write. One row per file is compared."""
    per_file = table.groupBy(F.input_file_name().alias("file"), *FOLDERS).agg(
        F.min(F.struct(*KEY)).alias("lo"), F.max(F.struct(*KEY)).alias("hi")
    )
    order = Window.partitionBy(*FOLDERS).orderBy("lo")
    return per_file.withColumn("before", F.lag("hi").over(order)).where("before > lo")


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)
