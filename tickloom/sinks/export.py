"""Exports: what to write, how it is laid out, what is recorded beside it.

A "single" export is a folder of files that are sorted inside and disjoint in key between each
other, which is what one sorted file is for a reader that prunes on statistics.
"""

from __future__ import annotations

import json
import operator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions import clock, money

# Layouts, row groups, modelled bytes per row and the safety margin.
FORMATS = ["parquet", "csv"]
LAYOUTS = ["single", "hive"]
CODECS = ["zstd", "snappy", "gzip", "uncompressed"]
QUERY_ROW_GROUP = 122_880
ARCHIVE_ROW_GROUP = 1_000_000
BYTES_PER_ROW = {"parquet": 8, "csv": 70}
WEAK_CODECS = {"uncompressed": 2, "snappy": 2}
MARGIN = 0.20
PARTITIONS = ["underlying_symbol", "expiry_date"]
KEY = ["contract_id", "res_id", "ts"]
#: Most rows of a file.
ROWS_PER_FILE = 16_000_000
#: Bytes up to which a file is hashed as one value, and bytes of a block of a larger one.
WHOLE_FILE, BLOCK = 256 << 20, 1 << 20

#: What can narrow an export: the table and column it looks at, how it compares, how its value is read.
LIMITS = {
    "underlying_id": ("contracts", "underlying_id", "eq", F.lit),
    "kind": ("contracts", "kind", "eq", F.lit),
    "option_type": ("contracts", "option_type", "eq", F.lit),
    "expiry_from": ("contracts", "expiry_date", "ge", clock.day),
    "expiry_to": ("contracts", "expiry_date", "le", clock.day),
    "resolutions": ("bars", "res_id", "in", None),
    "contract_ids": ("bars", "contract_id", "rows", None),
    "ts_from": ("bars", "ts", "ge", clock.ntz),
    "ts_to": ("bars", "ts", "lt", clock.ntz),
}
COMPARED = {"eq": operator.eq, "ge": operator.ge, "le": operator.le, "lt": operator.lt}


class Scope(dict):
    """Limits of an export by name, those of ``LIMITS``; what is not named is not limited."""

    def __init__(self, **limits) -> None:
        if unknown := sorted(set(limits) - set(LIMITS)):
            raise ValueError(f"an export cannot be limited by {unknown}")
        super().__init__({k: v for k, v in limits.items() if v is not None and v != ()})

    def narrow(self, table: str, df: DataFrame) -> DataFrame:
        """``df`` under the limits of one table. A list of ids is joined as rows, whatever its length."""
        for name, value in self.items():
            own, column, how, read = LIMITS[name]
            if own != table:
                continue
            if how == "rows":
                ids = df.sparkSession.createDataFrame([(i,) for i in value], f"{column} int").distinct()
                df = df.join(ids, column, "left_semi")
            elif how == "in":
                df = df.where(F.col(column).isin(list(value)))
            else:
                df = df.where(COMPARED[how](F.col(column), read(value)))
        return df


@dataclass(frozen=True)
class Spec:
    """Format, layout and codec of an export, and its limits."""

    format: str = "parquet"
    layout: str = "single"
    compression: str = "zstd"
    denormalise: bool = True
    scope: Scope = field(default_factory=Scope)

    def problem(self) -> str | None:
        """Why nothing can be written this way; ``None`` when it can. The first that holds."""
        tree = self.layout == "hive"
        checks = {
            "format_unknown": self.format not in FORMATS,
            "layout_unknown": self.layout not in LAYOUTS,
            "codec_unknown": self.compression.lower() not in CODECS,
            "tree_needs_parquet": tree and self.format != "parquet",
            "tree_needs_dimensions": tree and not self.denormalise,
        }
        return next((name for name, holds in checks.items() if holds), None)

    def validate(self) -> Spec:
        if (problem := self.problem()) is not None:
            raise ValueError(f"{problem}: {self}")
        return self

    @property
    def row_group(self) -> int:
        return {"single": QUERY_ROW_GROUP, "hive": ARCHIVE_ROW_GROUP}[self.layout]


def spec_problems(specs: DataFrame) -> DataFrame:
    """``Spec.problem`` of specs given as rows (format, layout, compression, denormalise)."""
    tree = F.col("layout") == "hive"
    return specs.withColumn(
        "problem",
        F.when(~F.col("format").isin(FORMATS), "format_unknown")
        .when(~F.col("layout").isin(LAYOUTS), "layout_unknown")
        .when(~F.lower("compression").isin(CODECS), "codec_unknown")
        .when(tree & (F.col("format") != "parquet"), "tree_needs_parquet")
        .when(tree & ~F.col("denormalise"), "tree_needs_dimensions"),
    )


def in_scope(candles: DataFrame, contracts: DataFrame, scope: Scope) -> tuple[DataFrame, DataFrame]:
    """(bars, contracts) under the limits; those on bars reach the scan."""
    return scope.narrow("bars", candles), scope.narrow("contracts", contracts)


def _times() -> list[Column]:
    """The bar's moment twice; what each form means stands in the metadata of its field."""
    return [
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts_ist", metadata={"offset_seconds": clock.IST_OFFSET_SECONDS}),
        clock.utc_seconds(F.col("ts")).alias("ts_utc_epoch", metadata={"unit": "second", "offset_seconds": 0}),
    ]


def denormalised(
    candles: DataFrame, contracts: DataFrame, underlyings: DataFrame, resolutions: DataFrame
) -> DataFrame:
    """Bars with contract, underlying and resolution attributes, plus ``ts`` to order by."""
    c = contracts.select(
        "contract_id", "underlying_id", F.col("fyers_symbol").alias("symbol"), "kind",
        "instrument_class", "exchange", "expiry_date", money.as_double(F.col("strike")).alias("strike"),
        "option_type", "lot_size",
    )
    u = underlyings.select(
        "underlying_id",
        F.col("fyers_symbol").alias("underlying_symbol"),
        F.col("display_name").alias("underlying_name"),
    )
    # The dimension side is joined first, so the fact meets one table.
    wide = c.join(u, "underlying_id")
    return (
        candles.join(wide, "contract_id")
        .join(F.broadcast(resolutions.select("res_id", F.col("fyers_code").alias("resolution"))), "res_id", "left")
        .select(
            "symbol", "underlying_symbol", "underlying_name", "kind", "instrument_class", "exchange",
            "expiry_date", "strike", "option_type", "lot_size", "resolution", *_times(),
            "open", "high", "low", "close", "volume", "oi", "contract_id", "res_id", "ts",
        )
    )


def raw(candles: DataFrame, contracts: DataFrame) -> DataFrame:
    """Bars of known contracts without dimension attributes, plus ``ts`` to order by."""
    return candles.join(contracts.select("contract_id"), "contract_id", "left_semi").select(
        "contract_id", "res_id", *_times(), "open", "high", "low", "close", "volume", "oi", "ts"
    )


def rows(
    spec: Spec, candles: DataFrame, contracts: DataFrame, underlyings: DataFrame,
    resolutions: DataFrame,
) -> DataFrame:
    """What an export writes."""
    k, c = in_scope(candles, contracts, spec.validate().scope)
    return denormalised(k, c, underlyings, resolutions) if spec.denormalise else raw(k, c)


def estimate(spec: Spec, candles: DataFrame, contracts: DataFrame) -> DataFrame:
    """Rows in scope and the modelled size."""
    k, c = in_scope(candles, contracts, spec.validate().scope)
    per_row = BYTES_PER_ROW[spec.format]
    if spec.format == "parquet":
        per_row *= WEAK_CODECS.get(spec.compression.lower(), 1)
    total = k.join(c.select("contract_id"), "contract_id", "left_semi").agg(F.count("*").alias("row_count"))
    return total.withColumn(
        "estimated_bytes", F.floor(F.col("row_count") * F.lit(per_row * (1 + MARGIN))).cast("bigint")
    )


def clustered(df: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Rows range-partitioned by key and sorted. Bounds are sampled from the data, so a hot leading key is cut
    further along the key instead of landing in one task. Adaptive execution joins small neighbours."""
    return df.repartitionByRange(*key).sortWithinPartitions(*key)


def counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """``df`` with its rows counted as they pass; read ``row_count`` after the write."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("row_count")), seen


def _writer(df: DataFrame, spec: Spec):
    writer = df.write.mode("overwrite").option("compression", spec.compression.lower())
    writer = writer.option("maxRecordsPerFile", ROWS_PER_FILE)
    if spec.format == "parquet":
        # Rows per row group are bounded by the page-row checks and the block size in bytes.
        writer = writer.option("parquet.block.row.count.limit", spec.row_group)
    return writer


def write_single(df: DataFrame, path: str, spec: Spec) -> int:
    """A folder of sorted files with disjoint key ranges; returns the rows written."""
    out, seen = counted(clustered(df).drop("ts"))
    if spec.format == "csv":
        out.write.mode("overwrite").option("header", True).option("maxRecordsPerFile", ROWS_PER_FILE).csv(path)
    else:
        _writer(out, spec).parquet(path)
    return seen.get["row_count"]


def write_archive(
    df: DataFrame, root: str, spec: Spec, catalog: dict[str, DataFrame] | None = None
) -> int:
    """A partitioned archive, with the dimensions beside it when given; returns the bars written.

    Range partitioning leads with the partition columns, so each task writes few folders and a
    large (underlying, expiry) is spread over several sorted files.
    """
    out, seen = counted(clustered(df, [*PARTITIONS, *KEY]).drop("ts"))
    _writer(out, spec).partitionBy(*PARTITIONS).parquet(f"{root}/candles")
    for name, table in (catalog or {}).items():
        _writer(table, spec).parquet(f"{root}/{name}.parquet")
    return seen.get["row_count"]


def sidecar(df: DataFrame, spec: Spec, export_id: str, created_at: str, row_count: DataFrame) -> DataFrame:
    """One row describing what was written: the schema with the metadata of its fields, the spec, the rows."""
    described = {"schema": df.drop("ts").schema.jsonValue(), "spec": vars(spec)}
    return row_count.select(
        F.lit(export_id).alias("export_id"),
        F.lit(created_at).cast("timestamp_ntz").alias("created_at"),
        F.col("row_count"),
        F.lit(json.dumps(described, default=str)).alias("description"),
    )


def file_digests(spark: SparkSession, path: str, whole: int = WHOLE_FILE, block: int = BLOCK) -> DataFrame:
    """SHA-256 and size of every part file with its folder, hashed where the files are read.

    A file of at most ``whole`` bytes is hashed as it is. A larger one is read by many tasks, and its digest is
    the SHA-256 of the hex digests of its blocks of ``block`` bytes, in order; no task holds more than some blocks. Files without any bytes have no row.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "part-*")
    small = reader.format("binaryFile").load(path).where(F.col("length") <= whole)
    small = small.select("path", F.col("length").alias("byte_size"), F.sha2("content", 256).alias("sha256"))
    large = _block_digests(reader.option("lineSep", "\n").format("text").load(path), whole, block)
    return small.unionByName(large).select(
        F.element_at(F.split("path", "/"), -2).alias("folder"),
        F.element_at(F.split("path", "/"), -1).alias("file"),
        "byte_size",
        "sha256",
    )


def _block_digests(lines: DataFrame, whole: int, block: int) -> DataFrame:
    """(path, byte_size, sha256) of the files above ``whole`` bytes, from their pieces between line feeds.

    Any file is such pieces, text or not. A piece's place is what stands before it in its read split and in the
    splits before that one; pieces are cut where blocks end and meet again block by block. The line feed added
    to a last piece that has none lies beyond the file's size and is cut off.
    """
    told = lines.where(F.col("_metadata.file_size") > whole).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"),
        F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("piece"),
    )
    before = Window.partitionBy("path", "split").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    length = F.octet_length("piece").cast("bigint")
    placed = told.withColumn("inside", F.coalesce(F.sum(length).over(before), F.lit(0)))
    # One row a split: its bytes are added up over the splits before it.
    sums = told.groupBy("path", "split").agg(F.sum(length).alias("bytes"))
    earlier = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        "path", "split", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("start"),
        F.sum("bytes").over(Window.partitionBy("path")).alias("found"),
    )
    placed = placed.join(starts, ["path", "split"]).withColumn("begin", F.col("start") + F.col("inside"))
    stop = F.least(F.col("begin") + length, F.col("size"))
    placed = placed.withColumn("stop", stop).where("begin < stop")
    blocks = F.explode(F.sequence(F.expr(f"begin div {block}"), F.expr(f"(stop - 1) div {block}")))
    cut = placed.withColumn("block", blocks).withColumn("from", F.greatest("begin", F.col("block") * block))
    until = F.least("stop", (F.col("block") + 1) * block)
    bytes_of = F.substring("piece", F.col("from") - F.col("begin") + 1, until - F.col("from"))
    cut = cut.select("path", "size", "found", "block", F.struct("from", bytes_of.cast("string").alias("bytes")).alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["bytes"]), "")
    each = cut.groupBy("path", "size", "found", "block").agg(F.sha2(joined.cast("binary"), 256).alias("digest"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block", "digest"))), lambda x: x["digest"])
    files = each.groupBy("path", "size", "found").agg(F.sha2(F.array_join(ordered, ""), 256).alias("sha256"))
    # Spark unpacks compressed text as it reads it: then what was read is not the file.
    partly = F.raise_error(F.concat(F.lit("not readable in parts: "), "path"))
    read = F.col("found").isin(F.col("size"), F.col("size") + 1)
    return files.select("path", F.col("size").alias("byte_size"), F.when(read, F.col("sha256")).otherwise(partly).alias("sha256"))


def manifest_row(
    spec: Spec, export_id: str, path: str, created_at: str, row_count: int, digests: DataFrame
) -> DataFrame:
    """The manifest row of a finished export; its digest covers the sorted file digests."""
    # Digests are folded per prefix first: at most 4096 of them meet in the last step.
    folded = F.sha2(F.array_join(F.sort_array(F.collect_list("sha256")), ""), 256)
    by_prefix = digests.groupBy(F.substring("sha256", 1, 3).alias("prefix")).agg(
        F.sum("byte_size").alias("byte_size"), folded.alias("sha256")
    )
    total = by_prefix.agg(F.sum("byte_size").alias("byte_size"), folded.alias("sha256"))
    return total.select(
        F.lit(export_id).alias("export_id"),
        F.lit(spec.format).alias("kind"),
        F.lit(path).alias("path"),
        F.lit(json.dumps(spec.scope, default=str, sort_keys=True)).alias("filters_json"),
        F.lit(row_count).cast("bigint").alias("row_count"),
        "byte_size",
        "sha256",
        F.lit(created_at).cast("timestamp_ntz").alias("created_at"),
    )


def to_arrow(df: DataFrame):
    """A bounded result as an Arrow table with its decimals intact, for the edge only."""
    return df.toArrow()
