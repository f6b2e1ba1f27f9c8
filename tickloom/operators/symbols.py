"""Contract symbols as columns: build, decompose, verify and audit.

A weekly symbol has no separators, so every split is tried, inside the row, with array functions.
Hints and a single valid split settle nearly every symbol there and then; only symbols that stay
tied are set against the root dimension, once per distinct symbol. No row is grouped or shuffled
by its symbol, so a symbol that fills the table costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import clock, money
from tickloom.schemas import EXCHANGE_CODES, SEGMENT_CODES

# Month names, the weekly month alphabet (there is no 0), patterns, year floor.
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
WEEKLY_MONTHS = ["1", "2", "3", "4", "5", "6", "7", "8", "9", "O", "N", "D"]
ROOT_PATTERN = r"^[A-Z][A-Z0-9&_.\-]*$"
STRIKE_PATTERN = r"^[0-9]+([.][0-9]+)?$"
WEEKLY_TAIL = r"^[0-9]{2}[1-9OND][0-9]{2}(?:[1-9][0-9]*(?:[.][0-9]+)?|0[.][0-9]+)$"
CURRENCY_PAIR = r"^(?:USD|EUR|GBP|JPY|AUD|CAD|CHF|SGD|AED|CNY)(?:INR|USD|JPY)$"
MIN_YEAR = 2015
YEARS_AHEAD = 5

_MONTH_ALT = "|".join(MONTHS)
FUTURE_PATTERN = rf"^(.+?)([0-9]{{2}})({_MONTH_ALT})FUT$"
MONTHLY_PATTERN = rf"^(.+?)([0-9]{{2}})({_MONTH_ALT})([0-9]+(?:[.][0-9]+)?)(CE|PE)$"

PARSED = [
    "exchange", "exchange_code", "segment", "segment_code", "kind", "instrument_class", "root",
    "series", "expiry", "expiry_year", "expiry_month", "expiry_day", "symbol_expiry_encoding",
    "strike", "strike_raw", "option_type", "parse_method", "parse_confidence", "parse_warnings",
    "parse_error",
]


def year_window(as_of_year: int) -> tuple[int, int]:
    """Plausible expiry years; the upper end follows the clock."""
    return MIN_YEAR, as_of_year + YEARS_AHEAD


# -- building ----------------------------------------------------------------------------------


def _yy(d: Column) -> Column:
    return F.date_format(d, "yy")


def _mon(d: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(d))


def build_cash(exchange: Column, name: Column, series: Column) -> Column:
    return F.concat(F.upper(exchange), F.lit(":"), F.upper(name), F.lit("-"), F.upper(series))


def build_future(exchange: Column, root: Column, expiry: Column) -> Column:
    return F.concat(
        F.upper(exchange), F.lit(":"), F.upper(root), _yy(expiry), _mon(expiry), F.lit("FUT")
    )


def build_monthly(
    exchange: Column, root: Column, expiry: Column, strike: Column, right: Column
) -> Column:
    return F.concat(
        F.upper(exchange), F.lit(":"), F.upper(root), _yy(expiry), _mon(expiry), strike,
        F.upper(right),
    )


def build_weekly(
    exchange: Column, root: Column, expiry: Column, strike: Column, right: Column
) -> Column:
    code = F.element_at(F.array(*[F.lit(m) for m in WEEKLY_MONTHS]), F.month(expiry))
    return F.concat(
        F.upper(exchange), F.lit(":"), F.upper(root), _yy(expiry), code,
        F.date_format(expiry, "dd"), strike, F.upper(right),
    )


def plain_strike(strike: Column) -> Column:
    """A strike as symbols write it: no trailing zeros."""
    text = strike.cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"([.][0-9]*?)0+$", "$1"), r"[.]$", "")


# -- decomposing -------------------------------------------------------------------------------


def _valid_strike(raw: Column) -> Column:
    """A positive plain number without a leading zero, else null."""
    value = raw.try_cast(money.STRIKE)
    leading_zero = raw.startswith("0") & ~raw.startswith("0.")
    return F.when(raw.rlike(STRIKE_PATTERN) & ~leading_zero & (value > 0), value)


def _month_number(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name).cast("int")


def _splits(core: Column, years: tuple[int, int]) -> Column:
    """Valid ``{root}{YY}{M}{dd}{strike}`` splits of the text before the right.

    The shape of root and tail is tested first; dates and strikes are read from what is left.
    """
    n = F.length(core)
    months = F.array(*[F.lit(m) for m in WEEKLY_MONTHS])

    def shaped(i: Column) -> Column:
        return F.substring(core, i + 1, n).rlike(WEEKLY_TAIL) & F.substring(core, F.lit(1), i).rlike(
            ROOT_PATTERN
        )

    def split(i: Column) -> Column:
        month = F.array_position(months, F.substring(core, i + 3, F.lit(1))).cast("string")
        iso = F.concat(
            F.lit("20"), F.substring(core, i + 1, F.lit(2)), F.lit("-"), F.lpad(month, 2, "0"),
            F.lit("-"), F.substring(core, i + 4, F.lit(2)),
        )
        strike_raw = F.substring(core, i + 6, n)
        return F.struct(
            F.substring(core, F.lit(1), i).alias("root"),
            iso.try_cast("date").alias("expiry"),
            strike_raw.try_cast(money.STRIKE).alias("strike"),
            strike_raw.alias("strike_raw"),
        )

    def usable(s: Column) -> Column:
        return F.year(s["expiry"]).between(*years) & (s["strike"] > 0)

    tails = F.filter(F.sequence(F.lit(1), n - 6), shaped)
    return F.filter(F.transform(tails, split), usable)


def _shapes(tagged: DataFrame, years: tuple[int, int]) -> DataFrame:
    """Exchange, body and the decomposition of everything but weekly options."""
    text = F.upper(F.trim("symbol"))
    has_colon = F.instr(text, ":") > 0
    df = tagged.withColumns(
        {
            "exchange": F.when(has_colon, F.substring_index(text, ":", 1)),
            "body": F.when(has_colon, F.regexp_replace(text, "^[^:]*:", "")),
        }
    )
    body = F.col("body")

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(body, pattern, group)

    is_future = body.rlike(FUTURE_PATTERN) & part(FUTURE_PATTERN, 1).rlike(ROOT_PATTERN)
    future_year = F.lit(2000) + part(FUTURE_PATTERN, 2).try_cast("int")
    monthly_year = F.lit(2000) + part(MONTHLY_PATTERN, 2).try_cast("int")
    monthly_strike = _valid_strike(part(MONTHLY_PATTERN, 4))
    is_option = body.rlike("(CE|PE)$")
    is_monthly = (
        body.rlike(MONTHLY_PATTERN)
        & part(MONTHLY_PATTERN, 1).rlike(ROOT_PATTERN)
        & monthly_strike.isNotNull()
        & monthly_year.between(*years)
    )
    cash_root, cash_series = F.regexp_extract(body, "^(.+)-([^-]+)$", 1), F.regexp_extract(
        body, "^(.+)-([^-]+)$", 2
    )
    is_cash = (cash_series != "") & cash_root.rlike(ROOT_PATTERN)
    known_exchange = F.col("exchange").isin(list(EXCHANGE_CODES))
    shape = (
        F.when(~has_colon | (body == ""), "no_exchange")
        .when(~known_exchange, "unknown_exchange")
        .when(is_future & ~future_year.between(*years), "year_out_of_window")
        .when(is_future, "future")
        .when(is_option & is_monthly, "monthly")
        .when(is_option, "weekly")
        .when(is_cash, "cash")
        .otherwise("unrecognised")
    )
    df = df.withColumn("shape", shape)
    future, monthly, cash = (F.col("shape") == s for s in ("future", "monthly", "cash"))
    return df.withColumns(
        {
            "root": F.when(future, part(FUTURE_PATTERN, 1))
            .when(monthly, part(MONTHLY_PATTERN, 1))
            .when(cash, cash_root),
            "series": F.when(cash, cash_series),
            "expiry_year": F.when(future, future_year).when(monthly, monthly_year),
            "expiry_month": F.when(future, _month_number(part(FUTURE_PATTERN, 3))).when(
                monthly, _month_number(part(MONTHLY_PATTERN, 3))
            ),
            "strike": F.when(monthly, monthly_strike),
            "strike_raw": F.when(monthly, part(MONTHLY_PATTERN, 4)),
            "option_type": F.when(is_option, F.substring(body, -2, 2)),
        }
    )


def parse(
    df: DataFrame,
    roots: DataFrame,
    years: tuple[int, int],
    *,
    symbol: str = "fyers_symbol",
    expected_root: str | None = None,
    expected_expiry: str | None = None,
) -> DataFrame:
    """Input rows with the decomposition of their symbol beside them.

    ``roots`` is ``(root, instrument_kind, derivative_segment)``, unique on root. ``parse_error``
    is null for an accepted symbol; a hint that disagrees with the symbol is an error too.
    """
    hint_root = (
        F.upper(F.trim(F.col(expected_root))) if expected_root else F.lit(None).cast("string")
    )
    hint_expiry = F.col(expected_expiry) if expected_expiry else F.lit(None).cast("date")
    tagged = df.select(
        F.struct(*df.columns).alias("_row"),
        F.col(symbol).alias("symbol"),
        F.when(hint_root != "", hint_root).alias("hint_root"),
        hint_expiry.alias("hint_expiry"),
    )
    known = roots.select(F.col("root").alias("known_root"), "instrument_kind", "derivative_segment")
    split = _with_candidates(_shapes(tagged, years), years)
    return _finish(_settle_ties(split, known), known).select("_row.*", *PARSED)


def _with_candidates(shapes: DataFrame, years: tuple[int, int]) -> DataFrame:
    """Weekly splits of each row and the ones the hints leave on top."""
    core = F.expr("substring(body, 1, length(body) - 2)")
    tried = F.when((F.col("shape") == "weekly") & (F.length(core) >= 7), _splits(core, years))

    def by_hints(c: Column) -> Column:
        expiry_hit = F.coalesce(c["expiry"] == F.col("hint_expiry"), F.lit(False))
        root_hit = F.coalesce(c["root"] == F.col("hint_root"), F.lit(False))
        return expiry_hit.cast("int") * 2 + root_hit.cast("int")

    df = shapes.withColumn("tried", tried)
    df = df.withColumn("best", F.array_max(F.transform("tried", by_hints)))
    return df.withColumn("top", F.filter("tried", lambda c: by_hints(c) == F.col("best")))


def _settle_ties(split: DataFrame, known: DataFrame) -> DataFrame:
    """The winning split of each row: the only one on top, or the only one whose root is known.

    Tied symbols are few; each distinct one is resolved once and joined back.
    """
    key = ["symbol", "hint_root", "hint_expiry"]
    # The outer form keeps the optimizer from copying the split expressions into a scan filter.
    tied = F.when(F.size("top") > 1, F.col("top"))
    ties = split.select(*key, F.explode_outer(tied).alias("c")).where("c IS NOT NULL").distinct()
    judged = (
        ties.join(known.select("known_root"), F.col("c.root") == F.col("known_root"), "left")
        .groupBy(*key)
        .agg(
            F.count("known_root").alias("tie_known"),
            F.max(F.when(F.col("known_root").isNotNull(), F.col("c"))).alias("tie_pick"),
        )
        .withColumnsRenamed({k: f"_{k}" for k in key})
    )
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    joined = split.join(judged, on, "left").drop(*[f"_{k}" for k in key])
    only = F.when(F.size("top") == 1, F.get("top", F.lit(0)))
    return joined.withColumn(
        "won", F.coalesce(only, F.when(F.col("tie_known") == 1, F.col("tie_pick")))
    )


def _finish(df: DataFrame, known: DataFrame) -> DataFrame:
    """Everything that follows from the shape and the winning split."""
    weekly = F.col("shape") == "weekly"
    df = df.withColumns(
        {
            "root": F.when(weekly, F.col("won.root")).otherwise(F.col("root")),
            "strike": F.when(weekly, F.col("won.strike")).otherwise(F.col("strike")),
            "strike_raw": F.when(weekly, F.col("won.strike_raw")).otherwise(F.col("strike_raw")),
        }
    ).join(known, F.col("root") == F.col("known_root"), "left")
    is_known = F.col("known_root").isNotNull() | F.coalesce(
        F.col("root") == F.col("hint_root"), F.lit(False)
    )
    single = F.size("tried") == 1
    # Whichever of the tied splits is meant, it is not the one of the root the caller knows.
    no_root_hit = F.col("hint_root").isNotNull() & ~F.exists("top", lambda c: c["root"] == F.col("hint_root"))
    error = (
        F.when(F.col("shape").isin("future", "monthly", "cash"), F.lit(None))
        .when(weekly & (F.coalesce(F.size("tried"), F.lit(0)) <= 0), "no_valid_split")
        .when(weekly & F.col("won").isNull() & no_root_hit & _has_hinted_root(), "expiry_disagrees")
        .when(weekly & F.col("won").isNull() & no_root_hit, "root_disagrees")
        .when(weekly & F.col("won").isNull(), "ambiguous")
        .when(weekly, F.lit(None))
        .otherwise(F.col("shape"))
    )
    hinted_call = F.col("hint_root").isNotNull() | F.col("hint_expiry").isNotNull()
    hinted_win = F.col("best") >= 1
    kind = (
        F.when(F.col("shape") == "future", "FUT")
        .when(F.col("shape").isin("monthly", "weekly"), "OPT")
        .when(F.col("shape") == "cash", "SPOT")
    )
    df = df.withColumns(
        {
            "parse_error": error,
            "kind": kind,
            "symbol_expiry_encoding": F.when(weekly, "WEEKLY_CODED")
            .when(F.col("shape").isin("future", "monthly"), "MONTHLY_CODED")
            .otherwise("NONE"),
            "expiry": F.when(weekly, F.col("won.expiry")).when(
                F.col("shape").isin("future", "monthly"), F.col("hint_expiry")
            ),
            "parse_method": F.when(F.col("shape") == "cash", "none")
            .when(F.when(weekly, hinted_win).otherwise(hinted_call), "hinted")
            .otherwise("enumerated"),
            "parse_confidence": F.when(weekly & ~single & ~hinted_win, "scored").otherwise("exact"),
        }
    )
    segment, inferred = segment_of(
        F.col("exchange"), F.col("kind"), F.col("root"), F.col("derivative_segment")
    )
    klass = instrument_class(F.col("kind"), F.col("series"), F.col("instrument_kind"))
    df = df.withColumns(
        {
            "exchange_code": _code(F.col("exchange"), EXCHANGE_CODES),
            "segment": segment,
            "segment_code": _code(segment, SEGMENT_CODES),
            "instrument_class": klass,
            "expiry_year": F.when(weekly, F.year("expiry")).otherwise(F.col("expiry_year")),
            "expiry_month": F.when(weekly, F.month("expiry")).otherwise(F.col("expiry_month")),
            "expiry_day": F.dayofmonth("expiry"),
        }
    )
    monthly = F.col("symbol_expiry_encoding") == "MONTHLY_CODED"
    warnings = F.array_compact(
        F.array(
            F.when(weekly & ~single, "multiple_candidates"),
            F.when((F.col("kind") != "SPOT") & ~is_known, "root_unknown"),
            F.when(inferred, "segment_inferred"),
            F.when(F.col("instrument_class").isNull(), "instrument_class_unknown"),
            F.when(monthly & F.col("expiry").isNull(), "expiry_day_unknown"),
        )
    )
    df = df.withColumn("parse_warnings", warnings).withColumn(
        "parse_error", F.coalesce("parse_error", hint_disagreement())
    )
    ok = F.col("parse_error").isNull()
    kept = [F.col(c) if c == "parse_error" else F.when(ok, F.col(c)).alias(c) for c in PARSED]
    return df.select("_row", *kept)


def _has_hinted_root() -> Column:
    """Whether some split of a weekly symbol has the root the caller knows, on whatever day."""
    return F.exists("tried", lambda c: c["root"] == F.col("hint_root"))


def hint_disagreement() -> Column:
    """Why a decomposition contradicts what the caller already knew, null when it does not.

    A wrong day can happen to be that of another root's split. If the symbol splits into the known
    root too, it is the day that disagrees.
    """
    weekly = F.col("symbol_expiry_encoding") == "WEEKLY_CODED"
    monthly = F.col("symbol_expiry_encoding") == "MONTHLY_CODED"
    other_month = (F.year("hint_expiry") != F.col("expiry_year")) | (
        F.month("hint_expiry") != F.col("expiry_month")
    )
    other_root = (F.col("kind") != "SPOT") & (F.col("root") != F.col("hint_root"))
    return (
        F.when(weekly & other_root & _has_hinted_root(), "expiry_disagrees")
        .when(other_root, "root_disagrees")
        .when(weekly & (F.col("expiry") != F.col("hint_expiry")), "expiry_disagrees")
        .when(monthly & other_month, "expiry_disagrees")
    )


def _code(name: Column, codes: dict[str, int]) -> Column:
    mapping = F.create_map(*[F.lit(x) for item in codes.items() for x in item])
    return F.try_element_at(mapping, name)


def segment_of(
    exchange: Column, kind: Column, root: Column, registered: Column
) -> tuple[Column, Column]:
    """Segment and whether it was inferred rather than known."""
    sure = F.when(exchange == "MCX", "COM").when(kind == "SPOT", "CM").otherwise(registered)
    guess = F.when(root.rlike(CURRENCY_PAIR), "CD").otherwise("FO")
    return F.coalesce(sure, guess), sure.isNull()


def instrument_class(kind: Column, series: Column, registered_kind: Column) -> Column:
    """Index or stock, from the registry; unknown for currency and commodity roots."""
    return (
        F.when((kind == "SPOT") & (series == "INDEX"), "INDEX")
        .when(kind == "SPOT", "EQUITY")
        .when((registered_kind == "INDEX") & (kind == "FUT"), "FUTIDX")
        .when(registered_kind == "INDEX", "OPTIDX")
        .when((registered_kind == "EQUITY") & (kind == "FUT"), "FUTSTK")
        .when(registered_kind == "EQUITY", "OPTSTK")
    )


# -- using the parser ----------------------------------------------------------------------------


def contract_rows(
    listed: DataFrame, roots: DataFrame, years: tuple[int, int]
) -> tuple[DataFrame, DataFrame]:
    """Listed symbols ``(symbol, source_array, source_array_index, expiry_date, root_hint)`` to
    (contract rows, unparseable symbols).

    The requested expiry is authoritative; what the symbol said is kept beside it.
    """
    parsed = parse(
        listed.withColumnRenamed("symbol", "fyers_symbol"),
        roots,
        years,
        expected_root="root_hint",
        expected_expiry="expiry_date",
    )
    good = parsed.where("parse_error IS NULL").withColumns(
        {
            "instrument_class": F.coalesce("instrument_class", "kind"),
            "parsed_expiry_date": F.col("expiry"),
            "source_expiry_date_requested": F.col("expiry_date"),
            "expiry_year": F.year("expiry_date"),
            "expiry_month": F.month("expiry_date"),
            "expiry_day": F.dayofmonth("expiry_date"),
            "expiry_dow": clock.iso_weekday(F.col("expiry_date")),
        }
    )
    bad = parsed.where("parse_error IS NOT NULL").select(*listed_columns(listed), "parse_error")
    return good.drop("root_hint", "expiry", "parse_error"), bad


def listed_columns(listed: DataFrame) -> list[str]:
    return ["fyers_symbol" if c == "symbol" else c for c in listed.columns]


def audit(master: DataFrame, roots: DataFrame, years: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Decompose one current option per root and compare with the vendor's own fields.

    Returns (disagreements, unparseable). The option with the smallest ticker stands for a root.
    """
    sample = (
        master.where(
            (F.col("valid_to").isNull())
            & (F.col("segment_code") == SEGMENT_CODES["FO"])
            & F.col("option_type").isNotNull()
            & F.col("under_symbol").isNotNull()
        )
        .groupBy("under_symbol")
        .agg(
            F.min(
                F.struct(
                    "symbol_ticker",
                    F.col("strike_price").alias("vendor_strike"),
                    F.col("option_type").alias("vendor_right"),
                    F.col("expiry_date").alias("vendor_expiry"),
                )
            ).alias("s")
        )
        .select("under_symbol", "s.*")
    )
    parsed = parse(
        sample, roots, years, symbol="symbol_ticker", expected_expiry="vendor_expiry"
    )
    good = parsed.where("parse_error IS NULL")

    def field(name: str, ours: Column, theirs: Column) -> Column:
        return F.struct(
            F.lit(name).alias("field"),
            ours.cast("string").alias("parsed"),
            theirs.cast("string").alias("vendor"),
        )

    checks = F.array(
        F.when(
            ~F.col("root").eqNullSafe(F.upper(F.trim("under_symbol"))),
            field("root", F.col("root"), F.col("under_symbol")),
        ),
        F.when(
            ~F.col("option_type").eqNullSafe(F.col("vendor_right")),
            field("option_type", F.col("option_type"), F.col("vendor_right")),
        ),
        F.when(
            F.col("strike") != F.col("vendor_strike"),
            field("strike", F.col("strike"), F.col("vendor_strike")),
        ),
    )
    disagreements = good.select("symbol_ticker", F.inline(F.array_compact(checks)))
    return disagreements, parsed.where("parse_error IS NOT NULL").select(
        "symbol_ticker", "parse_error"
    )
