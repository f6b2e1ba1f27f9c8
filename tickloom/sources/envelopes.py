"""Bar envelopes: ``{"s": .., "columns": [..], "candles": [[..], ..]}`` to typed bars.

One envelope is one request's answer. A single unusable value refuses the whole envelope, since a
chunk is made durable whole or not at all, and the refusal carries its reason. The decision is
taken inside the row with array functions, so no shuffle and no Python is involved.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.functions import clock, money

PAYLOAD = "s string, columns array<string>, candles array<array<string>>, _corrupt_record string"
STATUSES = ["ok", "no_data"]

# The vendor's column names and the names they take here.
ALIASES = {
    "timestamp": "ts",
    "open": "open",
    "high": "high",
    "low": "low",
    "close": "close",
    "volume": "volume",
    "open_interest": "oi",
}
PRICES = ["open", "high", "low", "close"]
REQUIRED = ["timestamp", "open", "high", "low", "close", "volume"]


def parse(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Decode the JSON text column into ``columns`` and ``candles`` beside the other columns."""
    body = F.from_json(F.col(payload), PAYLOAD)
    return raw.withColumn("_body", body).select(
        *[c for c in raw.columns if c != payload],
        F.when(F.col("_body._corrupt_record").isNull(), F.col("_body.s")).alias("s"),
        F.transform("_body.columns", lambda c: F.lower(F.trim(c))).alias("columns"),
        F.col("_body.candles").alias("candles"),
    )


def at(row: Column, name: str) -> Column:
    """The value of a named column in a positional row, null when the column is absent."""
    position = F.array_position(F.col("columns"), name).cast("int")
    return F.when(position > 0, F.get(row, position - 1))


def _first_problem(*problems: Column) -> Column:
    return F.coalesce(*problems)


def _occurrences(name: str) -> Column:
    return F.size(F.filter("columns", lambda c: c == name))


def refusal() -> Column:
    """Why an envelope cannot be stored, null when it can."""
    repeated = reduce(
        lambda a, b: a | b,
        [_occurrences(name) > 1 for name in ALIASES],
    )
    absent = reduce(
        lambda a, b: a | b, [F.array_position("columns", n) == 0 for n in REQUIRED]
    )
    short = F.exists("candles", lambda r: F.size(r) < F.size("columns"))

    def row_problem(r: Column) -> Column:
        numbers = [at(r, "timestamp"), at(r, "volume")]
        integers = F.when(
            reduce(lambda a, b: a | b, [F.isnan(F.coalesce(F.trim(n).try_cast("double"), F.lit(float("nan")))) for n in numbers]), F.lit("integer_not_a_number")
        ).when(
            reduce(lambda a, b: a | b, [money.whole(n, "bigint").isNull() for n in numbers]), F.lit("integer_out_of_range")
        )
        oi = at(r, "open_interest")
        interest = F.when(oi.isNotNull() & money.whole(oi, "bigint").isNull(), F.lit("open_interest_unusable"))
        return _first_problem(integers, *[money.price_problem(at(r, p)) for p in PRICES], interest)

    first_bad = F.get(
        F.filter(F.transform("candles", row_problem), lambda p: p.isNotNull()), F.lit(0)
    )
    return (
        F.when(F.col("columns").isNull(), "columns_missing")
        .when(F.col("candles").isNull(), "candles_missing")
        .when(repeated, "column_repeated")
        .when(absent, "column_missing")
        .when(short, "row_too_short")
        .otherwise(first_bad)
    )


def classify(parsed: DataFrame) -> DataFrame:
    """Parsed envelopes with a ``reason`` column.

    Only an explicit no-data answer may come without rows. What cannot be decoded, or has another
    status, is refused: it says nothing about the window and must not empty it.
    """
    status = F.coalesce("s", F.lit(""))
    reason = (
        F.when(F.col("s").isNull(), "undecodable")
        .when(~status.isin(STATUSES), F.concat(F.lit("status_"), status))
        .when(status == "ok", refusal())
    )
    rows = F.when(status == "ok", F.col("candles"))
    return parsed.withColumn("reason", reason).withColumn(
        "candles", F.coalesce(rows, F.array().cast("array<array<string>>"))
    )


def bars(classified: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Typed bars of every accepted envelope, with any ``keep`` columns beside them."""
    row = F.col("row")
    # The outer form with the test inside keeps the optimizer from copying the decoding into filters
    # below it; a row that is null refuses its envelope, so the filter after drops empty ones only.
    accepted = F.when(F.col("reason").isNull(), F.col("candles"))
    exploded = classified.select(
        "contract_id", "res_id", *(keep or []), "columns", F.explode_outer(accepted).alias("row")
    ).where("row IS NOT NULL")
    return exploded.select(
        F.col("contract_id").cast("int").alias("contract_id"),
        F.col("res_id").cast("smallint").alias("res_id"),
        clock.ist_from_utc_seconds(money.whole(at(row, "timestamp"), "bigint")).alias("ts"),
        *[money.as_price(at(row, p)).alias(p) for p in PRICES],
        money.whole(at(row, "volume"), "bigint").alias("volume"),
        money.whole(at(row, "open_interest"), "bigint").alias("oi"),
        *(keep or []),
    )


def quarantine(classified: DataFrame) -> DataFrame:
    """Refused envelopes with the reason, keyed as they arrived."""
    return classified.where(F.col("reason").isNotNull()).drop("columns", "candles", "s")


def ingest(raw: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Raw envelopes to (bars, quarantine)."""
    classified = classify(parse(raw, payload))
    return bars(classified).select(*schemas.CANDLE_COLUMNS), quarantine(classified)
