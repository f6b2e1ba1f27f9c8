"""Registry, output shape and the domain tables derived from the given ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom import schemas
from tickloom.functions import clock
from tickloom.operators import aggregates, symbols

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ID_BLOCK = 1024 * 1024
COVERAGE_SHIFT = 8766
EXPIRIES = ["2024-01-25", "2024-02-29"]
ROOTS = ["ALPHA", "BETA", "GAMMA", "DELTA", "OMEGA"]
YEARS = symbols.year_window(2026)


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its oracle; the result is given a neutral shape."""

    def keep(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return neutral(fn(Tables(spark, sf_dir)))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def neutral(df: DataFrame) -> DataFrame:
    """Plain types both engines render alike: bigint, double, text."""

    def shaped(f: T.StructField):
        c = F.col(f"`{f.name}`")
        kind = f.dataType
        if isinstance(kind, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(kind, T.IntegralType | T.BooleanType):
            c = c.cast("bigint")
        elif isinstance(kind, T.TimestampNTZType | T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(kind, T.DateType):
            c = c.cast("string")
        elif isinstance(kind, T.ArrayType | T.MapType | T.StructType):
            raise TypeError(f"nested column {f.name}")
        return c.alias(f.name)

    return df.select(*[shaped(f) for f in df.schema])


class Tables:
    """The given tables of one scale and what is derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.dir = sf_dir

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # -- ids ---------------------------------------------------------------------------------

    @staticmethod
    def with_ids(df: DataFrame, user: str = "user_id") -> DataFrame:
        """Ids of a user: the first five are spot series, the rest legs of ten chains."""
        u = F.col(user)
        n = F.floor(u / 5)
        expiry_index = F.floor(n / 2) % 2
        strike_index = F.floor(n / 4)
        expiry_id = 1 + 2 * (u % 5) + expiry_index
        return df.withColumns(
            {
                "underlying_id": (u % 5 + 1).cast("int"),
                "leg": n.cast("bigint"),
                "expiry_id": F.when(u >= 5, expiry_id).cast("int"),
                "contract_id": F.when(u < 5, u + 1)
                .otherwise(expiry_id * ID_BLOCK + 2 * strike_index + n % 2)
                .cast("int"),
            }
        )

    # -- bars --------------------------------------------------------------------------------

    @property
    def candles(self) -> DataFrame:
        """One bar per event: the event's value is open and close."""
        price = F.col("value").cast("decimal(11,4)")
        k = F.get_json_object("props", "$.k").cast("bigint")
        return self.with_ids(self.given("events")).select(
            "contract_id",
            F.lit(2).cast("smallint").alias("res_id"),
            F.col("ts").cast("timestamp_ntz").alias("ts"),
            price.alias("open"),
            (price + 1).cast("decimal(11,4)").alias("high"),
            (price - 1).cast("decimal(11,4)").alias("low"),
            price.alias("close"),
            (F.col("event_id") % 1000).alias("volume"),
            F.when(F.col("event_id") % 5 != 0, k).alias("oi"),
        )

    @property
    def daily(self) -> DataFrame:
        """Daily bars stored at midnight, where legs of a chain share their moments."""
        return aggregates.daily_bars(self.candles).select(
            "contract_id",
            F.lit(100).cast("smallint").alias("res_id"),
            clock.midnight(F.col("trade_date")).alias("ts"),
            "open", "high", "low", "close", "volume", "oi",
        )

    @property
    def lineitem_bars(self) -> DataFrame:
        """Bars per part from line items, for the larger runs."""
        price = (F.col("l_extendedprice") / F.col("l_quantity")).cast("decimal(11,4)")
        return self.given("lineitem").select(
            F.col("l_partkey").cast("int").alias("contract_id"),
            F.lit(2).cast("smallint").alias("res_id"),
            F.timestamp_add("SECOND", F.col("l_orderkey") % 86400, F.col("l_shipdate").cast("timestamp_ntz")).alias("ts"),
            price.alias("open"), price.alias("high"), price.alias("low"), price.alias("close"),
            F.col("l_quantity").cast("bigint").alias("volume"),
            F.col("l_orderkey").alias("oi"),
        )

    # -- dimensions ----------------------------------------------------------------------------

    @property
    def underlyings(self) -> DataFrame:
        i = F.col("underlying_id")
        root = F.element_at(F.array(*[F.lit(r) for r in ROOTS]), i)
        exchange = F.when(i.isin(3, 5), "BSE").otherwise("NSE")
        ids = self.with_ids(self.given("events").select("user_id").distinct())
        return ids.select("underlying_id").distinct().select(
            i,
            F.concat(exchange, F.lit(":"), root, F.lit("-INDEX")).alias("fyers_symbol"),
            root.alias("root"),
            exchange.alias("exchange"),
            F.lit("CM").alias("segment"),
            F.when(i == 4, "EQUITY").otherwise("INDEX").alias("instrument_kind"),
            F.initcap(root).alias("display_name"),
            i.alias("spot_contract_id"),
            clock.day("2022-01-03").alias("data_from"),
            (i != 5).alias("is_active"),
            F.lit(200).alias("option_life_days"),
            F.lit(120).alias("future_life_days"),
        )

    @property
    def contracts(self) -> DataFrame:
        """Spot rows and the legs of ten chains, with symbols built from their parts."""
        ids = self.with_ids(self.given("events").select("user_id").distinct())
        u = self.underlyings.select(
            "underlying_id", "root", "exchange", "instrument_kind",
            F.col("fyers_symbol").alias("spot_symbol"),
        )
        leg = F.col("leg")
        is_spot = F.col("user_id") < 5
        is_future = (F.floor(leg / 4) == 0) & (leg % 2 == 1)
        strike = (10 * F.floor(leg / 4) + 5).cast("decimal(12,4)")
        expiry = F.when(F.floor(leg / 2) % 2 == 0, EXPIRIES[0]).otherwise(EXPIRIES[1]).cast("date")
        kind = F.when(is_spot, "SPOT").when(is_future, "FUT").otherwise("OPT")
        parts = ids.join(u, "underlying_id").withColumns(
            {
                "kind": kind,
                "expiry_date": F.when(~is_spot, expiry),
                "strike": F.when(kind == "OPT", strike),
                "option_type": F.when(kind == "OPT", F.when(leg % 2 == 0, "CE").otherwise("PE")),
            }
        )
        text = symbols.plain_strike(F.col("strike"))
        weekly = symbols.build_weekly(F.col("exchange"), F.col("root"), F.col("expiry_date"), text, F.col("option_type"))
        monthly = symbols.build_monthly(F.col("exchange"), F.col("root"), F.col("expiry_date"), text, F.col("option_type"))
        future = symbols.build_future(F.col("exchange"), F.col("root"), F.col("expiry_date"))
        return parts.select(
            "contract_id", "underlying_id", "expiry_id",
            F.when(is_spot, F.col("spot_symbol"))
            .when(F.col("kind") == "FUT", future)
            .when(F.col("expiry_date") == EXPIRIES[0], weekly)
            .otherwise(monthly)
            .alias("fyers_symbol"),
            "kind",
            F.when(is_spot, F.col("instrument_kind"))
            .otherwise(F.concat(F.col("kind"), F.when(F.col("instrument_kind") == "INDEX", "IDX").otherwise("STK")))
            .alias("instrument_class"),
            "exchange",
            F.when(is_spot, "CM").otherwise("FO").alias("segment"),
            "root", "expiry_date", "strike", "option_type",
            F.when(~is_spot, F.when(leg % 3 != 0, 25 * F.col("underlying_id"))).cast("int").alias("lot_size"),
            F.when((leg % 7 == 0) & ~is_spot, clock.ntz("2024-03-01 00:00:00")).alias("sealed_at"),
            clock.ntz("2024-01-01 00:00:00").alias("first_seen_at"),
            clock.ntz("2024-01-01 00:00:00").alias("last_seen_at"),
        )

    @property
    def expiries(self) -> DataFrame:
        c = self.contracts.where("kind <> 'SPOT'")
        return (
            c.groupBy("expiry_id", "underlying_id", "expiry_date")
            .agg(
                F.count("*").cast("int").alias("contract_count"),
                F.count(F.when(F.col("kind") == "FUT", 1)).cast("int").alias("futures_count"),
                F.count(F.when(F.col("kind") == "OPT", 1)).cast("int").alias("options_count"),
            )
            .select(
                "expiry_id", "underlying_id", "expiry_date", "contract_count", "futures_count", "options_count",
                F.lit(10).cast("decimal(12,4)").alias("strike_step"),
                (F.col("expiry_id") * ID_BLOCK).alias("contract_id_lo"),
                ((F.col("expiry_id") + 1) * ID_BLOCK - 1).alias("contract_id_hi"),
                F.lit("W").alias("expiry_cycle_derived"),
                F.lit("derived").alias("expiry_cycle_source"),
                F.lit(False).alias("is_last_of_month"),
                (F.col("futures_count") > 0).alias("has_futures"),
                F.lit(False).alias("has_options"),
                clock.ntz("2024-01-01 00:00:00").alias("discovered_at"),
                F.when(
                    ~((F.col("underlying_id") == 5) & (F.col("expiry_date") == EXPIRIES[1])),
                    clock.ntz("2024-01-02 00:00:00"),
                ).alias("contracts_discovered_at"),
            )
        )

    @property
    def resolutions(self) -> DataFrame:
        return schemas.resolutions(self.spark)

    # -- ledger ----------------------------------------------------------------------------------

    @property
    def coverage(self) -> DataFrame:
        """One fetch chunk per order, the later order winning a repeated key."""
        o = self.with_ids(
            self.given("orders").withColumn("user_id", F.floor(F.col("o_custkey") / 10))
        )
        start = F.date_add(F.to_date("o_orderdate"), COVERAGE_SHIFT)
        status = (
            F.when(F.col("o_orderstatus") == "F", "ok")
            .when(F.col("o_orderstatus") == "O", "empty")
            .otherwise("error")
        )
        rows = o.select(
            "contract_id",
            (F.substring("o_orderpriority", 1, 1).cast("smallint") + 1).cast("smallint").alias("res_id"),
            start.alias("range_from"),
            F.date_add(start, (F.col("o_orderkey") % 90).cast("int")).alias("range_to"),
            status.alias("status"),
            F.when(status == "ok", F.col("o_orderkey") % 5000).otherwise(0).cast("bigint").alias("row_count"),
            F.concat(F.lit("h"), (F.col("o_orderkey") % 7).cast("string")).alias("payload_sha256"),
            F.col("o_orderkey"),
        )
        return rows.groupBy(*schemas.COVERAGE_KEY).agg(
            F.max_by("status", "o_orderkey").alias("status"),
            F.max_by("row_count", "o_orderkey").alias("row_count"),
            F.max_by("payload_sha256", "o_orderkey").alias("payload_sha256"),
        )

    @property
    def bounds(self) -> DataFrame:
        return aggregates.bounds(self.candles)

    # -- instrument master -------------------------------------------------------------------------

    def master_members(self, day: int) -> DataFrame:
        """The day's master as JSON-ready members: nations are the cash rows, customers the
        derivative contracts on them. The second day drops and adds accounts by balance and moves
        the lot of one segment."""
        nations = self.given("nation").select(
            F.concat(F.lit("N"), "n_nationkey").alias("fyToken"),
            F.concat(F.lit("NSE:"), "n_name", F.lit("-INDEX")).alias("symTicker"),
            F.lit("10").alias("exchange"),
            F.lit("10").alias("segment"),
            F.lit("10").alias("exInstType"),
            F.col("n_name").alias("underSym"),
            F.concat(F.lit("N"), "n_nationkey").alias("underFyTok"),
            F.lit("XX").alias("optType"),
            F.lit("-1.0").alias("strikePrice"),
            F.lit("1").alias("minLotSize"),
            F.lit("0.05").alias("tickSize"),
            F.lit("").alias("expiryDate"),
            F.lit("INDEX").alias("symDetails"),
        )
        c = self.given("customer")
        c = c.where("c_acctbal < 8500") if day == 1 else c.where("c_acctbal >= 0")
        root = F.concat(F.when(F.col("c_nationkey") == 7, "7").otherwise(""), F.lit("NATION_"), F.col("c_nationkey"))
        strike = F.col("c_custkey") + 1
        right = F.when(F.col("c_acctbal") >= 4000, "CE").otherwise("PE")
        moved = (F.col("c_mktsegment") == "BUILDING") & F.lit(day == 2)
        customers = c.select(
            F.concat(F.lit("C"), "c_custkey").alias("fyToken"),
            F.concat(F.lit("NSE:"), root, F.lit("24JAN"), strike, right).alias("symTicker"),
            F.lit("10").alias("exchange"),
            F.lit("11").alias("segment"),
            F.lit("14").alias("exInstType"),
            root.alias("underSym"),
            F.concat(F.when(F.col("c_nationkey") >= 23, "X").otherwise("N"), F.col("c_nationkey")).alias("underFyTok"),
            right.alias("optType"),
            F.concat(strike, F.lit(".0")).alias("strikePrice"),
            (F.col("c_nationkey") + 1 + moved.cast("int")).cast("string").alias("minLotSize"),
            F.lit("0.05").alias("tickSize"),
            F.lit("1706157000").alias("expiryDate"),
            F.col("c_name").alias("symDetails"),
        )
        return nations.unionByName(customers)

    def master(self, day: int) -> DataFrame:
        """The day's staged rows."""
        from tickloom.sources import master_files

        members = self.master_members(day)
        absent = [a for a in master_files.ATTRIBUTES if a not in members.columns]
        packed = members.select(
            F.col("symTicker").alias("ticker"),
            F.struct(
                *[
                    F.lit(None).cast("string").alias(a) if a in absent else F.col(a)
                    for a in master_files.ATTRIBUTES
                ]
            ).alias("member"),
        )
        return master_files.project(packed).drop("problem")

    @property
    def master_history(self) -> DataFrame:
        """The dimension after both days."""
        from tickloom.operators import versioning

        first = versioning.merge(
            schemas.empty(self.spark, schemas.MASTER_HISTORY), self.master(1), "2024-01-10"
        )
        return versioning.merge(first, self.master(2), "2024-01-20")

    # -- request log ---------------------------------------------------------------------------------

    @property
    def request_log(self) -> DataFrame:
        """One request per event."""
        e = F.col("event_id")
        state = F.element_at(
            F.array(*[F.lit(s) for s in ("done", "empty", "failed", "pending")]), (e % 4 + 1).cast("int")
        )
        settled = e % 4 != 3
        ts = F.col("ts").cast("timestamp_ntz")
        http = F.element_at(
            F.array(*[F.lit(h) for h in (200, 400, 401, 429, 500, 502, 507, 404)]), (e % 8 + 1).cast("int")
        )
        code = F.element_at(
            F.array(*[F.lit(h) for h in (0, -8, -15, -17, -50, -300, -429, 400, -999)]), (e % 9 + 1).cast("int")
        )
        return self.given("events").select(
            e.alias("task_id"),
            F.col("user_id").alias("job_id"),
            F.col("event_type").alias("kind"),
            state.alias("state"),
            ts.alias("created_at"),
            ts.alias("started_at"),
            F.when(settled, F.timestamp_add("SECOND", e % 600, ts)).alias("finished_at"),
            F.when(settled, 1).otherwise(0).alias("requests_used"),
            F.when(e % 4 == 0, e % 1000).alias("row_count"),
            F.when(settled, F.length("props").cast("bigint")).alias("response_bytes"),
            F.when(e % 4 == 0, "ok").when(e % 4 == 1, "no_data").otherwise("error").alias("status"),
            http.alias("http_status"),
            code.alias("code"),
        )

    # -- calendar -----------------------------------------------------------------------------------

    @property
    def holidays(self) -> DataFrame:
        return self.spark.createDataFrame(
            [("NSE", "2024-01-26"), ("BSE", "2024-01-26"), ("NSE", "2023-12-25"), ("NSE", "2024-03-08")],
            "exchange string, holiday_date string",
        ).select("exchange", F.col("holiday_date").cast("date").alias("holiday_date"))

    @property
    def observed_days(self) -> DataFrame:
        return aggregates.trading_days(self.candles, self.underlyings)

    @property
    def days(self) -> DataFrame:
        from tickloom.operators import calendar

        return calendar.day_table(
            self.underlyings.select("exchange").distinct(), "2018-01-01", "2026-12-31", self.holidays, self.observed_days
        )
