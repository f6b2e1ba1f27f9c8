"""Discovery and live-chain payloads as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import money

EXPIRY_PAYLOAD = "expiry_dates struct<futures: array<string>, options: array<string>>"
CONTRACT_PAYLOAD = "contracts struct<futures: array<string>, options: array<string>>"
LEG = (
    "symbol: string, option_type: string, strike_price: string, ltp: string, bid: string, "
    "ask: string, volume: string, oi: string, prev_oi: string, fp: string, "
    "greeks: struct<iv: string, delta: string, gamma: string, theta: string, vega: string>"
)
CHAIN_PAYLOAD = (
    "expiryData array<struct<date: string, expiry_flag: string>>, "
    f"optionsChain array<struct<{LEG}>>, indiavixData struct<ltp: string>"
)
SOURCE_ARRAYS = ["futures", "options"]
#: The member without which a payload of a kind says nothing.
BODIES = {"expiries": (EXPIRY_PAYLOAD, "expiry_dates"), "contracts": (CONTRACT_PAYLOAD, "contracts"), "chain": (CHAIN_PAYLOAD, "optionsChain")}


def undecodable(raw: DataFrame, keys: list[str], kind: str, payload: str = "payload") -> DataFrame:
    """Keys and reason of payloads that cannot be read as their kind: no row of them goes anywhere else."""
    schema, needed = BODIES[kind]
    body = F.from_json(payload, f"{schema}, _corrupt_record string")
    judged = raw.withColumn("_b", body).withColumn(
        "reason",
        F.when(F.col(payload).isNull(), "payload_missing")
        .when(F.col("_b").isNull() | F.col("_b._corrupt_record").isNotNull(), "not_json")
        .when(F.col(f"_b.{needed}").isNull(), f"{needed}_missing"),
    )
    return judged.where("reason IS NOT NULL").select(*keys, "reason")


def _tagged(path: str, source: str) -> Column:
    values = F.coalesce(F.col(path), F.array().cast("array<string>"))
    return F.transform(values, lambda v: F.struct(F.lit(source).alias("source"), v.alias("text")))


def expiry_dates(
    raw: DataFrame, keys: list[str], payload: str = "payload"
) -> tuple[DataFrame, DataFrame]:
    """Expiry payloads to (distinct dates with membership flags, values that are not dates)."""
    body = raw.withColumn("_b", F.from_json(payload, EXPIRY_PAYLOAD))
    listed = body.select(
        *keys,
        F.explode(F.concat(*[_tagged(f"_b.expiry_dates.{a}", a) for a in SOURCE_ARRAYS])).alias("e"),
    ).select(
        *keys, "e.source", "e.text", F.try_to_date(F.trim("e.text"), "yyyy-MM-dd").alias("d")
    )
    dates = (
        listed.where("d IS NOT NULL")
        .groupBy(*keys, F.col("d").alias("expiry_date"))
        .agg(
            F.bool_or(F.col("source") == "futures").alias("has_futures"),
            F.bool_or(F.col("source") == "options").alias("has_options"),
        )
    )
    return dates, listed.where("d IS NULL").select(*keys, "source", "text")


def contract_symbols(raw: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """Contract payloads to ``(symbol, source_array, source_array_index)``, blanks dropped before
    positions are counted."""
    body = raw.withColumn("_b", F.from_json(payload, CONTRACT_PAYLOAD))

    def numbered(array: str) -> Column:
        trimmed = F.transform(
            F.coalesce(F.col(f"_b.contracts.{array}"), F.array().cast("array<string>")),
            lambda v: F.trim(v),
        )
        return F.transform(
            F.filter(trimmed, lambda v: v != ""),
            lambda v, i: F.struct(
                v.alias("symbol"), F.lit(array).alias("source_array"), i.alias("source_array_index")
            ),
        )

    return body.select(*keys, F.inline(F.concat(*[numbered(a) for a in SOURCE_ARRAYS])))


def _dmy(text: Column) -> Column:
    return F.try_to_date(F.trim(text), "dd-MM-yyyy")


def _flag(text: Column) -> Column:
    return F.upper(F.trim(text))


def chain_expiries(raw: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """Expiry flags a chain payload carries: day-month-year dates, W and M flags only."""
    body = raw.withColumn("_b", F.from_json(payload, CHAIN_PAYLOAD))
    return (
        body.select(*keys, F.posexplode("_b.expiryData").alias("position", "e"))
        .select(
            *keys,
            "position",
            _dmy(F.col("e.date")).alias("expiry_date"),
            _flag(F.col("e.expiry_flag")).alias("expiry_flag"),
        )
        .where("expiry_date IS NOT NULL AND expiry_flag IN ('W', 'M')")
    )


def _num(path: str, decimal_type: str) -> Column:
    return money.wide(F.col(path)).try_cast(decimal_type)


def chain_quotes(raw: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """Option legs of each chain payload with the first listed expiry, the forward price of the
    underlying's own row and the volatility index beside every leg. Legs are told from the
    underlying by their right, never by position."""
    body = raw.withColumn("_b", F.from_json(payload, CHAIN_PAYLOAD))

    def right(leg: Column) -> Column:
        return F.upper(F.trim(F.coalesce(leg["option_type"], F.lit(""))))

    def flagged(e: Column) -> Column:
        return _dmy(e["date"]).isNotNull() & _flag(e["expiry_flag"]).isin("W", "M")

    own = F.filter("_b.optionsChain", lambda leg: ~right(leg).isin("CE", "PE"))
    legs = F.filter("_b.optionsChain", lambda leg: right(leg).isin("CE", "PE"))
    read = body.select(
        *keys,
        F.get(F.filter("_b.expiryData", flagged), F.lit(0)).alias("front"),
        F.try_element_at(own, F.lit(-1))["fp"].alias("fp_text"),
        F.col("_b.indiavixData.ltp").alias("vix_text"),
        legs.alias("legs"),
    )
    # The outer form with the test inside keeps the optimizer from copying the decoding into filters
    # below it; legs have a right, so none is null.
    dated = F.when(F.col("front").isNotNull(), F.col("legs"))
    return (
        read.select(*keys, "front", "fp_text", "vix_text", F.explode_outer(dated).alias("leg"))
        .where("leg IS NOT NULL")
        .select(
            *keys,
            _dmy(F.col("front.date")).alias("expiry_date"),
            _flag(F.col("front.expiry_flag")).alias("expiry_flag"),
            _num("leg.strike_price", "decimal(12,4)").alias("strike"),
            right(F.col("leg")).alias("option_type"),
            F.when(F.trim("leg.symbol") != "", F.trim("leg.symbol")).alias("fyers_symbol"),
            *[_num(f"leg.{n}", "decimal(11,4)").alias(n) for n in ("ltp", "bid", "ask")],
            *[money.whole(F.col(f"leg.{n}"), "bigint").alias(n) for n in ("volume", "oi", "prev_oi")],
            _num("leg.greeks.iv", "decimal(9,4)").alias("iv"),
            _num("leg.greeks.delta", "decimal(9,6)").alias("delta"),
            _num("leg.greeks.gamma", "decimal(12,8)").alias("gamma"),
            _num("leg.greeks.theta", "decimal(12,6)").alias("theta"),
            _num("leg.greeks.vega", "decimal(12,6)").alias("vega"),
            _num("fp_text", "decimal(11,4)").alias("fp"),
            _num("vix_text", "decimal(11,4)").alias("india_vix"),
        )
    )
