"""Option chains: at-the-money picks, the grid, strike bands and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import clock, folders, money
from tickloom.operators import asof, bars

LEG_FIELDS = ["contract_id", "fyers_symbol", "open", "high", "low", "close", "volume", "oi"]


#: Bucket of the strike line an as-of match is cut into: 1,000 points at four places.
STRIKE_BUCKET = 10_000_000


def strike_ladder(contracts: DataFrame) -> DataFrame:
    """Distinct option strikes of each expiry, one per row."""
    return (
        contracts.where("kind = 'OPT' AND strike IS NOT NULL")
        .select("underlying_id", "expiry_date", F.col("strike").cast(money.STRIKE).alias("strike"))
        .distinct()
    )


def nearest_strikes(ladder: DataFrame, priced: DataFrame) -> DataFrame:
    """Each distinct ``(underlying_id, expiry_date, spot)`` with ``atm_strike``: the closest strike,
    the lower one on a tie.

    The neighbours on either side come from as-of matches along the strike line, upwards and, with
    signs turned, downwards, so no spot meets the whole ladder.
    """
    keys = ["underlying_id", "expiry_date"]

    def units(c: str) -> Column:
        return (F.col(c).cast(money.STRIKE) * 10000).cast("bigint")

    asked = priced.where("spot IS NOT NULL").select(*keys, "spot").distinct().withColumns(
        {"_at": units("spot"), "_down": -units("spot")}
    )
    steps = ladder.select(*keys, units("strike").alias("_s"), (-units("strike")).alias("_n"), "strike")

    def beside(left: DataFrame, at: str, line: str, out: str) -> DataFrame:
        found = asof.asof_backward(
            left, steps.select(*keys, line, F.col("strike").alias(out)), keys, at, line, [out],
            bucket_seconds=STRIKE_BUCKET, matched_ts="_m",
        )
        return found.drop("_m")

    both = beside(beside(asked, "_at", "_s", "_below"), "_down", "_n", "_above")
    spot = F.col("spot").cast(money.STRIKE)
    nearer = F.col("_below").isNotNull() & (
        F.col("_above").isNull() | (spot - F.col("_below") <= F.col("_above") - spot)
    )
    return both.select(*keys, "spot", F.when(nearer, F.col("_below")).otherwise(F.col("_above")).alias("atm_strike"))


def at_the_money(
    candles: DataFrame,
    underlyings: DataFrame,
    contracts: DataFrame,
    requests: DataFrame,
    res_id: int,
) -> DataFrame:
    """Spot, nearest strike and both legs for each ``(request_id, underlying_id, expiry_date,
    at_ts)``. Strikes are chosen once per distinct spot and joined back, so no request is
    multiplied by its strikes."""
    spotted = asof.spot_at(candles, underlyings, requests, res_id).drop("spot_ts")
    nearest = nearest_strikes(strike_ladder(contracts), spotted)
    picked = spotted.join(nearest, ["underlying_id", "expiry_date", "spot"], "left")
    legs = (
        contracts.where("kind = 'OPT'")
        .groupBy("underlying_id", "expiry_date", F.col("strike").alias("atm_strike"))
        .agg(
            F.max(F.when(F.col("option_type") == "CE", F.col("contract_id"))).alias("ce_contract_id"),
            F.max(F.when(F.col("option_type") == "PE", F.col("contract_id"))).alias("pe_contract_id"),
        )
    )
    return picked.join(legs, ["underlying_id", "expiry_date", "atm_strike"], "left")


def legs_at(candles: DataFrame, contracts: DataFrame, requests: DataFrame) -> DataFrame:
    """Option bars of a whole expiry at an exact moment, for each ``(request_id, underlying_id,
    expiry_date, res_id, at_ts)``: equi-joins all the way down."""
    options = contracts.where("kind = 'OPT'").select(
        "contract_id", "underlying_id", "expiry_date", "strike", "option_type", "fyers_symbol",
        "lot_size",
    )
    return requests.join(options, ["underlying_id", "expiry_date"]).join(
        candles.withColumnRenamed("ts", "at_ts"), ["contract_id", "res_id", "at_ts"]
    )


def chain_at(
    candles: DataFrame,
    expiries: DataFrame,
    contracts: DataFrame,
    underlying_id: int,
    expiry_date: str,
    res_id: int,
    ts: str,
) -> DataFrame:
    """The single-chain form: the folders of the expiry's contracts and of the month bound the scan."""
    expiry = expiries.where(
        (F.col("underlying_id") == underlying_id) & (F.col("expiry_date") == clock.day(expiry_date))
    ).select("expiry_id", "contract_id_lo", "contract_id_hi")
    options = (
        contracts.where("kind = 'OPT'")
        .join(expiry, "expiry_id")
        .where(F.col("contract_id").between(F.col("contract_id_lo"), F.col("contract_id_hi")))
        .select("contract_id", "strike", "option_type", "fyers_symbol", "lot_size")
    )
    options, more = folders.keyed(candles, options)
    return (
        folders.of_months(candles, ts, ts)
        .where((F.col("res_id") == res_id) & (F.col("ts") == clock.ntz(ts)))
        .join(options, ["contract_id", *more])
        .select(
            "strike", "option_type", "fyers_symbol", "lot_size",
            "open", "high", "low", "close", "volume", "oi",
        )
        .orderBy("strike", "option_type")
    )


def grid(legs: DataFrame, picks: DataFrame) -> DataFrame:
    """One row per request and strike with both rights side by side, spot and the ATM mark."""

    def leg(right: str) -> Column:
        values = [
            money.as_double(F.col(c)).alias(c) if c in ("open", "high", "low", "close") else F.col(c)
            for c in LEG_FIELDS
        ]
        return F.max(F.when(F.col("option_type") == right, F.struct(*values)))

    rows = legs.groupBy("request_id", "strike").agg(
        F.min("at_ts").alias("at_ts"),
        # First known lot size in right order: the call's when it has one, else the put's.
        F.min_by("lot_size", F.when(F.col("lot_size").isNotNull(), F.col("option_type"))).alias(
            "lot_size"
        ),
        leg("CE").alias("ce"),
        leg("PE").alias("pe"),
    )
    return rows.join(picks.select("request_id", "spot", "atm_strike"), "request_id", "left").select(
        "request_id",
        clock.utc_seconds(F.col("at_ts")).alias("ts"),
        money.as_double(F.col("strike")).alias("strike"),
        "lot_size",
        "ce",
        "pe",
        money.as_double(F.col("spot")).alias("spot"),
        F.coalesce(F.col("strike") == F.col("atm_strike"), F.lit(False)).alias("is_atm"),
    )


def band(
    candles: DataFrame, expiries: DataFrame, contracts: DataFrame, picks: DataFrame
) -> DataFrame:
    """Bars of the strikes within ``strikes_each_side`` steps of the strike that was at the money
    when the window opened. ``picks`` carry ``(request_id, underlying_id, expiry_date, res_id,
    start_ts, end_ts, strikes_each_side, atm_strike)``."""
    steps = expiries.select("underlying_id", "expiry_date", "strike_step")
    inside = (
        picks.join(steps, ["underlying_id", "expiry_date"])
        .join(
            contracts.where("kind = 'OPT'").select(
                "contract_id", "underlying_id", "expiry_date", "strike", "option_type"
            ),
            ["underlying_id", "expiry_date"],
        )
        .where(
            F.abs(F.col("strike") - F.col("atm_strike"))
            <= F.col("strikes_each_side") * F.col("strike_step")
        )
        .select("request_id", "contract_id", "res_id", "start_ts", "end_ts", "strike", "option_type")
    )
    return bars.windows(candles, inside).select(
        "request_id", "ts", "strike", "option_type", "close", "volume", "oi"
    )


def totals(legs: DataFrame, by: list[str]) -> DataFrame:
    """Call and put totals with the put/call ratio; no call open interest means no ratio."""

    def side(right: str, column: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("option_type") == right, F.col(column))), F.lit(0))

    summed = legs.groupBy(*by).agg(
        side("CE", "oi").alias("call_oi"),
        side("PE", "oi").alias("put_oi"),
        side("CE", "volume").alias("call_volume"),
        side("PE", "volume").alias("put_volume"),
    )
    return summed.withColumn(
        "pcr", F.when(F.col("call_oi") > 0, F.col("put_oi") / F.col("call_oi"))
    )


def strike_scope(
    contracts: DataFrame, mode: str, strikes: DataFrame | None = None,
    spots: DataFrame | None = None, steps: int = 0,
) -> DataFrame:
    """Contracts inside a strike scope; futures always stay.

    ``all`` keeps everything, ``explicit`` keeps the strikes of a one-column table at four places,
    ``band`` keeps ``steps`` ranks either side of the strike nearest ``spots`` per
    (underlying, expiry).
    """
    if mode == "all":
        return contracts
    if mode == "explicit":
        wanted = strikes.select(F.col("strike").cast(money.STRIKE).alias("_w")).distinct()
        hit = contracts.join(wanted, contracts["strike"] == wanted["_w"], "left")
        return hit.where("strike IS NULL OR _w IS NOT NULL").drop("_w")
    if mode != "band":
        raise ValueError(f"unknown strike scope {mode!r}")
    keys = ["underlying_id", "expiry_date"]
    ladder = strike_ladder(contracts)
    ranked = ladder.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("strike")))
    centre = (
        nearest_strikes(ladder, spots.select(*keys, "spot"))
        .select(*keys, F.col("atm_strike").alias("strike"))
        .join(ranked, [*keys, "strike"])
        .select(*keys, F.col("_rank").alias("_centre"))
    )
    near = ranked.join(centre, keys).where(F.abs(F.col("_rank") - F.col("_centre")) <= steps)
    near = near.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("strike").alias("_strike"))
    at = [F.col(k) == F.col(f"_{k}") for k in [*keys, "strike"]]
    futures = contracts.where("strike IS NULL")
    return futures.unionByName(contracts.join(near, at, "left_semi"))
