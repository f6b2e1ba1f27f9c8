"""Declared table layouts and fixed reference values. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CANDLE_COLUMNS = ["contract_id", "res_id", "ts", "open", "high", "low", "close", "volume", "oi"]
CANDLES = (
    "contract_id int, res_id smallint, ts timestamp_ntz, open decimal(11,4), high decimal(11,4), "
    "low decimal(11,4), close decimal(11,4), volume bigint, oi bigint"
)
COVERAGE_KEY = ["contract_id", "res_id", "range_from", "range_to"]
COVERAGE = (
    "contract_id int, res_id smallint, range_from date, range_to date, status string, "
    "row_count bigint, first_ts timestamp_ntz, last_ts timestamp_ntz, payload_sha256 string, "
    "fetched_at timestamp_ntz"
)
BOUNDS = (
    "contract_id int, res_id smallint, row_count bigint, first_ts timestamp_ntz, "
    "last_ts timestamp_ntz"
)
UNDERLYING = (
    "underlying_id int, fyers_symbol string, root string, exchange string, segment string, "
    "instrument_kind string, display_name string, spot_contract_id int, data_from date, "
    "is_active boolean"
)
EXPIRY = (
    "expiry_id int, underlying_id int, expiry_date date, has_futures boolean, "
    "has_options boolean, futures_count int, options_count int, contract_count int, "
    "min_strike decimal(12,4), max_strike decimal(12,4), strike_step decimal(12,4), "
    "contract_id_lo int, contract_id_hi int, expiry_cycle_derived string, "
    "expiry_cycle_source string, is_last_of_month boolean, expiry_dow int, "
    "source_range_from date, source_range_to date, discovered_at timestamp_ntz, "
    "contracts_discovered_at timestamp_ntz"
)
GREEKS = (
    "contract_id int, res_id smallint, ts timestamp_ntz, iv decimal(9,4), delta decimal(9,6), "
    "gamma decimal(12,8), theta decimal(12,6), vega decimal(12,6), rho decimal(12,6), "
    "fp decimal(11,4), src string"
)
INGEST_RUN = (
    "run_id bigint, job_id string, job_kind string, underlying_id int, started_at timestamp_ntz, "
    "finished_at timestamp_ntz, status string, requests_made bigint, rows_written bigint, "
    "bytes_downloaded bigint, app_version string, error_text string"
)

# The business columns of the instrument master, in table order, with their types.
MASTER_COLUMNS = [
    ("fytoken", "string"),
    ("symbol_ticker", "string"),
    ("exchange_code", "smallint"),
    ("segment_code", "smallint"),
    ("ex_instrument_type", "int"),
    ("under_symbol", "string"),
    ("under_fytoken", "string"),
    ("ex_series", "string"),
    ("isin", "string"),
    ("min_lot_size", "int"),
    ("tick_size", "decimal(9,4)"),
    ("qty_freeze", "int"),
    ("qty_multiplier", "decimal(12,4)"),
    ("face_value", "decimal(12,4)"),
    ("strike_price", "decimal(12,4)"),
    ("option_type", "string"),
    ("expiry_date", "date"),
    ("trading_session", "string"),
    ("symbol_details", "string"),
]
MASTER_NAMES = [name for name, _ in MASTER_COLUMNS]
MASTER = ", ".join(f"{n} {t}" for n, t in MASTER_COLUMNS) + ", row_hash string"
MASTER_HISTORY = MASTER + ", valid_from date, valid_to date"

# The bar resolutions served, with the vendor's code, the length in seconds, the
# label, the chart interval, the most days one request may span and the days of availability.
RESOLUTIONS = [
    (1, "5S", 5, "5 seconds", "5s", 30, 30, True),
    (2, "1", 60, "1 minute", "1m", 95, None, True),
    (3, "2", 120, "2 minutes", "2m", 95, None, True),
    (4, "3", 180, "3 minutes", "3m", 95, None, True),
    (5, "5", 300, "5 minutes", "5m", 95, None, True),
    (6, "10", 600, "10 minutes", "10m", 95, None, True),
    (7, "15", 900, "15 minutes", "15m", 95, None, True),
    (8, "20", 1200, "20 minutes", "20m", 95, None, True),
    (9, "30", 1800, "30 minutes", "30m", 95, None, True),
    (10, "45", 2700, "45 minutes", "45m", 95, None, True),
    (11, "60", 3600, "1 hour", "1h", 95, None, True),
    (12, "120", 7200, "2 hours", "2h", 95, None, True),
    (13, "180", 10800, "3 hours", "3h", 95, None, True),
    (14, "240", 14400, "4 hours", "4h", 95, None, True),
    (100, "D", 86400, "1 day", "1d", 0, None, False),
]
RESOLUTION = (
    "res_id smallint, fyers_code string, seconds int, label string, chart_interval string, "
    "max_days_per_request int, availability_window_days int, is_intraday boolean"
)
MINUTE_RES_ID = 2

# Numeric codes of exchanges and segments, and the first date each exchange serves.
EXCHANGE_CODES = {"NSE": 10, "MCX": 11, "BSE": 12}
SEGMENT_CODES = {"CM": 10, "FO": 11, "CD": 12, "COM": 20}
EXCHANGE_FLOORS = {"NSE": "2022-01-03", "BSE": "2023-08-07", "MCX": "2022-01-03"}

# The id space. Spot series take 1..999, every other id sits in an aligned block.
SPOT_ID_MAX = 999
BLOCK_SIZE = 1024
FIRST_BLOCK_BASE = 1024
MAX_CONTRACT_ID = 2**31 - 1


def resolutions(spark: SparkSession) -> DataFrame:
    """The fixed resolution dimension (15 rows)."""
    return spark.createDataFrame(RESOLUTIONS, RESOLUTION)


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    """A zero-row table of a declared layout."""
    return spark.createDataFrame([], ddl)
