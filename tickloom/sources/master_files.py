"""Instrument-master files: one JSON object keyed by ticker, tens of megabytes each.

The text reader splits the object at closing braces, so a large file is read by many tasks. Members
are flat, so a brace ends one unless it stands inside a text. Whether it does is a prefix scan: a
piece with an odd number of quotes turns the state "inside a text" round. The odd pieces of each read
split are counted, the counts of earlier splits of the file are added, and a running count inside the
split does the rest. Pieces that no text crosses are members as they are; those between two odd
pieces, often of different splits, are put together again. A text needs as much memory as it is long.

A whole file has as many closing as opening braces outside texts, and its quotes come in pairs. The
closing braces are the bytes of the file that the pieces lack. Otherwise the file was cut off, and
all its members are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.functions import clock, money

# The member attributes read, and the fillers that mean "not applicable".
ATTRIBUTES = [
    "fyToken", "symTicker", "exchange", "segment", "exInstType", "underSym", "underFyTok",
    "exSeries", "isin", "minLotSize", "tickSize", "qtyFreeze", "qtyMultiplier", "faceValue",
    "strikePrice", "optType", "expiryDate", "tradingSession", "symDetails",
]
FILLERS = ["", "XX", "NA", "N/A", "-"]
MEMBER = ", ".join(f"{a} string" for a in ATTRIBUTES)
FIELD_SEPARATOR = "\x1f"


#: A text with its quotes; possessive, so that a long one does not deepen the matcher's stack.
QUOTED = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """Texts between closing braces: file, size (of the file), split, at (their order in the split), value."""
    return spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )


def crossed(parts: DataFrame) -> DataFrame:
    """Pieces with ``odd``, whether their quotes do not pair, and ``before``, the odd pieces of the file before them."""
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    told = parts.withColumn("odd", ((F.length(bare) - F.length(F.replace(bare, F.lit('"')))) % 2).cast("int"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = told.groupBy("file", "split").agg(F.sum("odd").alias("odd"))
    splits = splits.select("file", "split", F.coalesce(F.sum("odd").over(earlier), F.lit(0)).alias("in_splits"))
    inside = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    told = told.withColumn("in_split", F.coalesce(F.sum("odd").over(inside), F.lit(0))).join(splits, ["file", "split"])
    return told.select(*parts.columns, "odd", (F.col("in_splits") + F.col("in_split")).alias("before"))


def joined(parts: DataFrame) -> DataFrame:
    """Crossed pieces as (file, value): what stands between two odd pieces is one value again."""
    apart = (F.col("before") % 2 == 0) & (F.col("odd") == 0)
    order = F.array_sort(F.collect_list(F.struct("split", "at", "value")))
    text = F.array_join(F.transform(order, lambda x: x["value"]), "}")
    again = parts.where(~apart).groupBy("file", F.expr("before div 2").alias("text")).agg(text.alias("value"))
    return parts.where(apart).select("file", "value").unionByName(again.select("file", "value"))


def whole_files(parts: DataFrame) -> DataFrame:
    """(file, paired, closings): whether quotes pair, and the closing braces outside texts, of every file."""
    inside = ((F.col("before") + F.col("odd")) % 2 == 1).cast("int")
    return parts.groupBy("file").agg(
        (F.sum("odd") % 2 == 0).alias("paired"),
        (F.first("size") - F.sum(F.octet_length("value")) - F.sum(inside)).alias("closings"),
    )


def members(spark: SparkSession, path: str) -> DataFrame:
    """``(file, ticker, member, flaw)`` per instrument, read in parallel inside each file."""
    parts = crossed(pieces(spark, path))
    files = whole_files(parts)
    # Without pairs nothing tells where a text ends: such a file's pieces are refused as they are.
    fine = parts.join(files.where("paired"), "file", "left_semi")
    texts = joined(fine).unionByName(parts.join(files.where("NOT paired"), "file", "left_semi").select("file", "value"))
    opened = F.length(F.regexp_replace(F.regexp_replace("value", QUOTED, ""), r"[^{]", ""))
    texts = texts.withColumn("opened", opened)
    openings = texts.groupBy("file").agg(F.sum("opened").alias("openings"))
    is_whole = files.join(openings, "file").select("file", (F.col("paired") & (F.col("openings") == F.col("closings"))).alias("is_whole"))
    split = split_members(texts.select("file", F.regexp_replace("value", r"^[\s,{]*", "").alias("value"))).join(is_whole, "file")
    return split.withColumn("flaw", F.when(~F.col("is_whole"), "file_cut_off").otherwise(F.col("flaw"))).drop("is_whole")


def split_members(texts: DataFrame) -> DataFrame:
    """Texts of one member each to ticker, decoded member and what is wrong with it."""
    text = F.col("value")
    ticker = F.regexp_extract(text, r'(?s)^"([^"\\]*+(?:\\.[^"\\]*+)*+)"\s*:', 1)
    body = F.regexp_extract(text, r'(?s)^"[^"\\]*+(?:\\.[^"\\]*+)*+"\s*:\s*(\{.*)', 1)
    name = F.from_json(F.concat(F.lit('{"t":"'), ticker, F.lit('"}')), "t string")["t"]
    return texts.where(text != "").select(
        *[c for c in texts.columns if c != "value"],
        F.coalesce(name, ticker).alias("ticker"),
        F.from_json(F.concat(body, F.lit("}")), MEMBER).alias("member"),
        F.when(body == "", "no_member").alias("flaw"),
    )


def _text(name: str) -> Column:
    trimmed = F.trim(F.col(f"member.{name}"))
    return F.when(trimmed != "", trimmed)


def _coded(name: str) -> Column:
    value = _text(name)
    return F.when(~F.upper(value).isin(FILLERS), value)


def _decimal(name: str, decimal_type: str) -> Column:
    return money.quantised(F.col(f"member.{name}"), decimal_type)


def _integer(name: str, integral: str = "int") -> Column:
    return money.whole(F.col(f"member.{name}"), integral)


def row_hash() -> Column:
    """Digest over the stored attributes. ``concat_ws`` skips nulls, so each one is made empty."""
    parts = [F.coalesce(F.col(n).cast("string"), F.lit("")) for n in schemas.MASTER_NAMES]
    return F.sha2(F.concat_ws(FIELD_SEPARATOR, *parts), 256)


def project(member_rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Members to the nineteen stored columns plus ``row_hash`` and ``problem``."""
    strike = _decimal("strikePrice", money.STRIKE)
    seconds = money.whole(F.col("member.expiryDate"), "bigint")
    ticker = F.coalesce(F.when(F.trim("ticker") != "", F.trim("ticker")), _text("symTicker"))
    values = {
        "fytoken": _text("fyToken"),
        "symbol_ticker": ticker,
        "exchange_code": _integer("exchange", "smallint"),
        "segment_code": _integer("segment", "smallint"),
        "ex_instrument_type": _integer("exInstType"),
        "under_symbol": _text("underSym"),
        "under_fytoken": _text("underFyTok"),
        "ex_series": _coded("exSeries"),
        "isin": _coded("isin"),
        "min_lot_size": _integer("minLotSize"),
        "tick_size": _decimal("tickSize", "decimal(9,4)"),
        "qty_freeze": _integer("qtyFreeze"),
        "qty_multiplier": _decimal("qtyMultiplier", "decimal(12,4)"),
        "face_value": _decimal("faceValue", "decimal(12,4)"),
        "strike_price": F.when(strike > -1, strike),
        "option_type": _coded("optType"),
        "expiry_date": F.when(seconds > 0, clock.date_from_utc_seconds(seconds)),
        "trading_session": _text("tradingSession"),
        "symbol_details": _text("symDetails"),
    }
    flaw = F.col("flaw") if "flaw" in member_rows.columns else F.lit(None).cast("string")
    typed = member_rows.select(
        *(keep or []), *[values[n].cast(t).alias(n) for n, t in schemas.MASTER_COLUMNS], flaw.alias("_flaw")
    )
    problem = F.when(F.col("_flaw").isNotNull(), F.col("_flaw")).when(F.col("symbol_ticker").isNull(), "ticker_missing").when(
        F.col("fytoken").isNull(), "token_missing"
    )
    return typed.withColumn("row_hash", row_hash()).withColumn("problem", problem).drop("_flaw")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Files to (staged rows, refused members with their problem)."""
    rows = project(members(spark, path), keep=["file"])
    return rows.where("problem IS NULL").drop("problem"), rows.where("problem IS NOT NULL")
