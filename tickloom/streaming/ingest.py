"""Landed envelopes to bars, ledger and bounds, replay-safe.

A file stream with a declared schema feeds ``foreachBatch``. Each batch is parsed, reduced to the
latest answer per request, stripped of answers already recorded, and replaces its windows in
snapshots of the folders it touches (``sinks.store``). It works from the tables as they were before
it, so what a lost attempt left behind is written over, and a batch already visible is left alone.
A late correction replaces its window; there is no watermark to miss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom import schemas
from tickloom.functions import clock, money
from tickloom.operators import aggregates, writes
from tickloom.sinks import store
from tickloom.sources import envelopes

LANDED = (
    "contract_id int, res_id smallint, range_from date, range_to date, "
    "fetched_at timestamp_ntz, payload string"
)

BLOCK = ["id_block"]
#: Name, columns and folders of each table. Bounds are kept for each folder of bars and added up in reads.
TABLES = {
    "candles": (store.BARS_ON_DISK, store.FOLDERS),
    "coverage": (f"{schemas.COVERAGE}, id_block int", BLOCK),
    "bounds": (f"{schemas.BOUNDS}, id_block int, trade_month string", store.FOLDERS),
}


#: The batch of a compacted root, before any batch of a stream.
FIRST = "0"


def chunk_rows(classified: DataFrame) -> DataFrame:
    """Ledger rows of accepted envelopes; bounds come from the rows themselves."""
    times = F.transform(
        "candles",
        lambda r: money.whole(envelopes.at(r, "timestamp"), "bigint"),
    )
    first, last = F.array_min(times), F.array_max(times)
    size = F.size("candles")
    return classified.where("reason IS NULL").select(
        *schemas.COVERAGE_KEY,
        F.when((F.col("s") == "no_data") | (size == 0), "empty").otherwise("ok").alias("status"),
        size.cast("bigint").alias("row_count"),
        clock.ist_from_utc_seconds(first).alias("first_ts"),
        clock.ist_from_utc_seconds(last).alias("last_ts"),
        F.col("payload_sha256"),
        "fetched_at",
    )


def classify_landed(landed: DataFrame) -> DataFrame:
    """Landed rows with digest, decoded body and refusal reason."""
    hashed = landed.withColumn("payload_sha256", F.sha2("payload", 256))
    return envelopes.classify(envelopes.parse(hashed))


def apply_batch(
    spark: SparkSession, root: str, landed: DataFrame, batch: str,
    ids_per_block: int = schemas.BLOCK_SIZE,
) -> None:
    """One batch into the tables under ``root``: bars, ledger, bounds, quarantine. Batches are
    ordered by name."""
    if store.is_committed(spark, root, batch):
        return
    block = store.id_block(ids_per_block)
    classified = classify_landed(landed).persist()
    newest = writes.latest_requests(chunk_rows(classified))
    own_blocks = newest.select(block.alias("id_block")).distinct()
    ledger = store.inside(_table(spark, root, "coverage", batch), own_blocks, BLOCK).drop("id_block")
    chosen = writes.changed_chunks(newest, ledger).persist()

    answer = [*schemas.COVERAGE_KEY, "payload_sha256", "fetched_at"]
    wanted = classified.join(chosen.select(*answer), answer, "left_semi").dropDuplicates(answer)
    touched = store.touched_folders(chosen, ids_per_block)
    blocks = chosen.select(block.alias("id_block")).distinct()
    was = _table(spark, root, "candles", batch)
    bars = store.next_bars(was, touched, chosen, envelopes.bars(wanted), ids_per_block)
    _put(root, "candles", batch, bars, store.KEY)
    # The snapshot just written holds exactly the touched folders.
    written = spark.read.schema(store.BARS_ON_DISK).parquet(f"{root}/candles/batch={batch}")
    _put(root, "bounds", batch, aggregates.bounds(written, *store.FOLDERS), writes.SERIES)
    held = store.inside(_table(spark, root, "coverage", batch), blocks, BLOCK).drop("id_block")
    next_ledger = writes.upsert_coverage(held, chosen).withColumn("id_block", block)
    _put(root, "coverage", batch, next_ledger, schemas.COVERAGE_KEY)
    envelopes.quarantine(classified).write.mode("overwrite").parquet(f"{root}/quarantine/batch={batch}")
    store.commit(spark, root, batch, {"candles": touched, "bounds": touched, "coverage": blocks})
    chosen.unpersist()
    classified.unpersist()


def _put(root: str, name: str, batch: str, rows: DataFrame, key: list[str]) -> None:
    ddl, folders = TABLES[name]
    store.put(rows.select(*StructType.fromDDL(ddl).names), f"{root}/{name}/batch={batch}", folders, key)


def _table(spark: SparkSession, root: str, name: str, before: str | None = None) -> DataFrame:
    return store.current(spark, root, name, *TABLES[name], before)


def tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The current tables under ``root``."""
    return {
        "candles": _table(spark, root, "candles").select(*schemas.CANDLE_COLUMNS),
        "coverage": _table(spark, root, "coverage").drop("id_block"),
        "bounds": aggregates.combined_bounds(_table(spark, root, "bounds")),
    }


def compact(spark: SparkSession, root: str, to: str) -> None:
    """The current tables as the first batch of a new root, without the snapshots they replaced."""
    for name, key in (("candles", store.KEY), ("bounds", writes.SERIES), ("coverage", schemas.COVERAGE_KEY)):
        _put(to, name, FIRST, _table(spark, root, name), key)
    kept = {n: spark.read.schema(ddl).parquet(f"{to}/{n}").select(*f).distinct() for n, (ddl, f) in TABLES.items()}
    store.commit(spark, to, FIRST, kept)


def start(
    spark: SparkSession, landing: str, root: str, *, files_per_batch: int | None = None,
    available_now: bool = False, ids_per_block: int = schemas.BLOCK_SIZE,
):
    """Follow a landing folder of Parquet envelopes."""
    reader = spark.readStream.schema(LANDED)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def each(batch_df: DataFrame, batch_id: int) -> None:
        apply_batch(batch_df.sparkSession, root, batch_df, f"{batch_id:012d}", ids_per_block)

    writer = (
        reader.parquet(landing)
        .writeStream.foreachBatch(each)
        .option("checkpointLocation", f"{root}/progress")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
