"""Roots and underlyings: resolving derivative roots to cash tickers, merging and mirroring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.calendar import exchange_floor
from tickloom.operators.symbols import ROOT_PATTERN
from tickloom.schemas import EXCHANGE_CODES, SEGMENT_CODES

# Labels that are no names, the exchange and segment pairs that exist, the shape of
# a cash ticker, and the cash type code that means an index.
DEGENERATE_NAMES = ["INDEX", "IDX", "EQ", "XX"]
VALID_PAIRS = [(10, 10), (10, 11), (10, 12), (11, 20), (12, 10), (12, 11), (12, 12), (11, 11)]
TICKER_PATTERN = r"^(?:NSE|BSE|MCX):[A-Z0-9&_.\-]+$"
INDEX_TYPE_CODE = 10
MIRRORED = ["NSE", "BSE", "MCX"]
#: Characters of one kind that are still listed one by one.
FEW = 4

# The built-in roots.
BUILTIN_ROOTS = [
    ("NIFTY", "NSE:NIFTY50-INDEX", "NIFTY 50", "NSE", "INDEX", "FO", 1),
    ("BANKNIFTY", "NSE:NIFTYBANK-INDEX", "NIFTY BANK", "NSE", "INDEX", "FO", 2),
    ("SENSEX", "BSE:SENSEX-INDEX", "SENSEX", "BSE", "INDEX", "FO", 3),
    ("RELIANCE", "NSE:RELIANCE-EQ", "Reliance Industries", "NSE", "EQUITY", "FO", 4),
]
ROOTS = (
    "root string, fyers_symbol string, display_name string, exchange string, "
    "instrument_kind string, derivative_segment string, underlying_id int, is_builtin boolean"
)


def _code(name: Column | str, codes: dict[str, int]) -> Column:
    """The numeric code of a name, null when it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for item in codes.items() for x in item]), F.col(name) if isinstance(name, str) else name)


def builtin_roots(spark) -> DataFrame:
    """The four built-in roots."""
    return spark.createDataFrame([(*r, True) for r in BUILTIN_ROOTS], ROOTS)


def name_of(code: Column, codes: dict[str, int]) -> Column:
    mapping = F.create_map(*[F.lit(x) for name, c in codes.items() for x in (c, name)])
    return F.try_element_at(mapping, code.cast("int"))


def cash_kind(ticker: Column, type_code: Column) -> Column:
    """INDEX or EQUITY of a cash row: the ticker suffix decides, then the type code."""
    return F.when(F.upper(ticker).endswith("-INDEX"), "INDEX").when(
        type_code == INDEX_TYPE_CODE, "INDEX"
    ).otherwise("EQUITY")


def display_name(root: Column, details: Column) -> Column:
    """The vendor's label, or the root when that label names nothing."""
    label = F.trim(details)
    return F.when(
        label.isNull() | (label == "") | F.upper(label).isin(DEGENERATE_NAMES), root
    ).otherwise(label)


def root_counts(master: DataFrame) -> DataFrame:
    """Current derivative contracts per exchange and root with one underlying token."""
    return (
        master.where(
            F.col("valid_to").isNull()
            & (F.col("segment_code") == SEGMENT_CODES["FO"])
            & F.col("under_symbol").isNotNull()
            & F.col("under_fytoken").isNotNull()
        )
        .groupBy("exchange_code", "under_symbol")
        .agg(
            F.min("under_fytoken").alias("under_fytoken"),
            F.min("segment_code").alias("segment_code"),
            F.count("*").alias("contract_count"),
        )
    )


def root_candidates(derivatives: DataFrame, cash: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counted roots resolved to cash rows; returns (accepted, rejected with a reason)."""
    grouped = (
        derivatives.withColumn("root", F.upper(F.trim("under_symbol")))
        .withColumn("exchange", name_of(F.col("exchange_code"), EXCHANGE_CODES))
        .where("root <> '' AND exchange IS NOT NULL")
        .groupBy("exchange", "root")
        .agg(
            F.min("under_fytoken").alias("under_fytoken"),
            F.min("segment_code").alias("segment_code"),
            F.sum("contract_count").alias("contract_count"),
        )
    )
    joined = grouped.join(
        cash.select(
            F.col("fytoken").alias("under_fytoken"), "symbol_ticker", "ex_instrument_type",
            "symbol_details",
        ),
        "under_fytoken",
        "left",
    )
    ticker = F.col("symbol_ticker")
    reason = (
        F.when(ticker.isNull(), "no_cash_row")
        .when(~F.col("root").rlike(ROOT_PATTERN), "bad_root")
        .when(~ticker.rlike(TICKER_PATTERN), "bad_ticker")
        .when(~ticker.startswith(F.concat("exchange", F.lit(":"))), "exchange_mismatch")
    )
    judged = joined.select(
        "exchange",
        "root",
        ticker.alias("fyers_symbol"),
        display_name(F.col("root"), F.col("symbol_details")).alias("display_name"),
        cash_kind(ticker, F.col("ex_instrument_type")).alias("instrument_kind"),
        F.coalesce(name_of(F.col("segment_code"), SEGMENT_CODES), F.lit("FO")).alias(
            "derivative_segment"
        ),
        "under_fytoken",
        "contract_count",
        reason.alias("reason"),
    )
    accepted = judged.where("reason IS NULL").drop("reason")
    return accepted, judged.where("reason IS NOT NULL").select(
        "exchange", "root", "reason", "contract_count"
    )


def merge_roots(base: DataFrame, candidates: DataFrame) -> DataFrame:
    """Next root dimension with an ``outcome``: added, replaced, kept.

    A built-in root is never overwritten; any other one follows the vendor's cash ticker. A root
    listed on several exchanges is taken once, from the exchange with the lower code.
    """
    once = candidates.groupBy("root").agg(
        F.min_by(
            F.struct(
                "fyers_symbol", "display_name", "exchange", "instrument_kind", "derivative_segment"
            ),
            F.struct(_code("exchange", EXCHANGE_CODES).isNull(), _code("exchange", EXCHANGE_CODES), "exchange", "fyers_symbol"),
        ).alias("new")
    )
    old = base.select("root", F.struct(*[c for c in base.columns if c != "root"]).alias("old"))
    both = old.join(once, "root", "full_outer")
    replace = (
        F.col("old").isNotNull()
        & ~F.coalesce(F.col("old.is_builtin"), F.lit(False))
        & (F.col("new.fyers_symbol") != F.col("old.fyers_symbol"))
    )
    use_new = F.col("old").isNull() | F.coalesce(replace, F.lit(False))

    def pick(name: str) -> Column:
        return F.when(use_new, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}")).alias(name)

    return both.select(
        "root",
        *[
            pick(c)
            for c in (
                "fyers_symbol", "display_name", "exchange", "instrument_kind", "derivative_segment",
            )
        ],
        F.col("old.underlying_id").alias("underlying_id"),
        F.coalesce(F.col("old.is_builtin"), F.lit(False)).alias("is_builtin"),
        F.when(F.col("old").isNull(), "added").when(use_new, "replaced").otherwise("kept").alias(
            "outcome"
        ),
    )


def _roots(derivatives: DataFrame) -> DataFrame:
    return derivatives.select(F.upper(F.trim("under_symbol")).alias("root")).where("root <> ''").distinct()


def unusual_roots(derivatives: DataFrame) -> DataFrame:
    """Roots with other characters than capitals and digits, and whether the pattern still takes them."""
    return _roots(derivatives).where(~F.col("root").rlike("^[A-Z0-9]+$")).select(
        "root", F.col("root").rlike(ROOT_PATTERN).alias("fits_pattern")
    )


def character_class(derivatives: DataFrame) -> DataFrame:
    """Which characters roots use at the start and after it, and the pattern that follows, as one row.

    Characters are made distinct before they are gathered, so what meets in a row is an alphabet.
    A kind of character used more than ``FEW`` times over stands as its whole range.
    """
    roots = _roots(derivatives)
    used = roots.select(F.posexplode(F.split("root", "")).alias("at", "c")).where("c <> ''")
    used = used.select(F.when(F.col("at") == 0, "first").otherwise("body").alias("part"), "c").distinct()
    kinds = used.withColumn("kind", F.expr("CASE WHEN c BETWEEN 'A' AND 'Z' THEN 0 WHEN c BETWEEN '0' AND '9' THEN 1 ELSE 2 END"))
    spans = F.create_map(F.lit(0), F.lit("A-Z"), F.lit(1), F.lit("0-9"))
    shown = F.when(F.col("c") == "-", "\\-").otherwise(F.col("c"))
    by_kind = kinds.groupBy("part", "kind").agg(
        F.array_join(F.sort_array(F.collect_list("c")), "").alias("chars"),
        F.when((F.count("c") > FEW) & (F.col("kind") < 2), spans[F.col("kind")])
        .otherwise(F.array_join(F.sort_array(F.collect_list(shown)), "")).alias("piece"),
    )
    parts = by_kind.groupBy("part").agg(
        F.array_join(F.sort_array(F.flatten(F.collect_list(F.split("chars", "")))), "").alias("chars"),
        F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("kind", "piece"))), lambda x: x["piece"]), ""), F.lit("]")).alias("piece"),
    )
    both = parts.groupBy().pivot("part", ["first", "body"]).agg(F.first("chars").alias("chars"), F.first("piece").alias("piece"))
    count = roots.agg(F.count("*").alias("root_count"))
    return both.select(
        count.scalar().alias("root_count"), "first_chars", "body_chars",
        F.concat("first_piece", F.coalesce("body_piece", F.lit("[]")), F.lit("*")).alias("pattern"),
    )


def mirror(declared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Declared underlyings with their numeric codes; returns (mirrored, skipped with a reason)."""
    exchange, segment = F.upper("exchange"), F.upper("segment")

    coded = declared.withColumns(
        {
            "exchange": exchange,
            "segment": segment,
            "exchange_code": _code(exchange, EXCHANGE_CODES),
            "segment_code": _code(segment, SEGMENT_CODES),
        }
    )
    pair = F.struct("exchange_code", "segment_code")
    valid = pair.isin(*[F.struct(F.lit(a).alias("exchange_code"), F.lit(b).alias("segment_code")) for a, b in VALID_PAIRS])
    judged = coded.withColumn(
        "reason",
        F.when(F.col("exchange_code").isNull(), "unknown_exchange")
        .when(F.col("segment_code").isNull(), "unknown_segment")
        .when(~valid, "pair_not_traded"),
    ).withColumn("data_floor", exchange_floor(F.col("exchange")))
    return (
        judged.where("reason IS NULL").drop("reason"),
        judged.where("reason IS NOT NULL").select("underlying_id", "exchange", "segment", "reason"),
    )
