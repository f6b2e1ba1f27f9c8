"""Payloads in, files out, and the stream between them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalogue.base import EXPIRIES, ID_BLOCK, Tables, query
from catalogue.sql import B, D, S, T, U, q, qq
from tickloom import session
from tickloom.functions import clock
from tickloom.sinks import export, store
from tickloom.sources import envelopes, master_files, payloads
from tickloom.sources import tables as table_reads
from tickloom.streaming import ingest

COLUMNS = ["timestamp", "open", "high", "low", "close", "volume", "open_interest"]


def day_envelopes(t: Tables):
    """One envelope per series and day as a vendor would send it. Some days of the month are
    broken in one way each, some leave open interest out, some shuffle their columns."""
    d = F.dayofmonth("ts")
    value = {
        "timestamp": clock.utc_seconds(F.col("ts")).cast("string"),
        "open": F.concat(F.col("open").cast("string"), F.when(d == 9, "5").otherwise("")),
        "high": F.col("high").cast("string"),
        "low": F.col("low").cast("string"),
        "close": F.col("close").cast("string"),
        "volume": F.concat(F.when(d == 19, "9" * 20).otherwise(""), F.col("volume").cast("string")),
        "open_interest": F.when(d == 20, '"x"').otherwise(F.coalesce(F.col("oi").cast("string"), F.lit("null"))),
    }

    def both(names):
        text = F.concat(F.lit("["), F.concat_ws(",", *[value[n] for n in names]), F.lit("]"))
        return text, '["' + '","'.join(names) + '"]'

    layouts = {
        7: [c for c in COLUMNS if c != "volume"],
        8: [*COLUMNS, "close"],
        11: COLUMNS[:-1],
        13: ["open_interest", "close", "timestamp", "volume", "low", "high", "open"],
    }
    row, names = both(COLUMNS)
    row, names = (row, F.lit(names))
    for dom, layout in layouts.items():
        r, n = both(layout)
        row, names = F.when(d == dom, r).otherwise(row), F.when(d == dom, n).otherwise(names)
    row = F.when(d == 10, F.regexp_replace(row, r",[^,]*\]$", "]")).otherwise(row)
    lines = t.candles.select("contract_id", "res_id", F.to_date("ts").alias("day"), names.alias("names"), row.alias("row"))
    packed = lines.groupBy("contract_id", "res_id", "day").agg(
        F.first("names").alias("names"), F.sort_array(F.collect_list("row")).alias("rows")
    )
    empty = F.dayofmonth("day") == 12
    dom = F.dayofmonth("day")
    status = F.when(dom == 17, "{").when(dom == 18, '{"s":"error",').otherwise('{"s":"ok",')
    body = F.concat(status, F.lit('"columns":'), "names", F.lit(',"candles":['), F.array_join("rows", ","), F.lit("]}"))
    return packed.select(
        "contract_id", "res_id", F.col("day").alias("range_from"), F.col("day").alias("range_to"),
        F.when(empty, '{"s":"no_data","candles":[]}')
        .when(dom == 14, "<html>502 Bad Gateway</html>")
        .when(dom == 15, F.lit(None).cast("string"))
        .when(dom == 16, F.substring(body, 1, 90))
        .otherwise(body)
        .alias("payload"),
    )


GOOD = """good AS (SELECT contract_id, res_id, date_trunc('second', ts) AS ts, open, high, low, close, volume, CASE WHEN day(ts) = 11 THEN NULL ELSE oi END AS oi
  FROM candles WHERE day(ts) NOT IN (7, 8, 9, 10, 12, 14, 15, 16, 17, 18, 19, 20))"""


@query("s2_envelope_bars", qq(GOOD, f"SELECT {B('contract_id')}, {B('res_id')}, {T('ts')}, {D('open')}, {D('high')}, {D('low')}, {D('close')}, {B('volume')}, {B('oi')} FROM good"))
def s2(t: Tables):
    return envelopes.ingest(day_envelopes(t))[0]


@query(
    "s2_envelope_quarantine",
    q(f"""SELECT DISTINCT {B('contract_id')}, {B('res_id')}, {S('CAST(ts AS DATE)', 'range_from')}, CASE day(ts) WHEN 7 THEN 'column_missing' WHEN 8 THEN 'column_repeated' WHEN 9 THEN 'price_needs_more_decimals' WHEN 10 THEN 'row_too_short' WHEN 18 THEN 'status_error' WHEN 19 THEN 'integer_out_of_range' WHEN 20 THEN 'open_interest_unusable' ELSE 'undecodable' END AS reason
      FROM candles WHERE day(ts) IN (7, 8, 9, 10, 14, 15, 16, 17, 18, 19, 20)"""),
)
def s2q(t: Tables):
    return envelopes.ingest(day_envelopes(t))[1].select("contract_id", "res_id", "range_from", "reason")


MEMBER_SQL = f"""SELECT fytoken, symbol_ticker, {B('10', 'exchange_code')}, {B('segment_code')}, {B('ex_type', 'ex_instrument_type')}, under_symbol, under_fytoken, option_type, {D('strike_price')},
  {B('lot1', 'min_lot_size')}, {D('0.05', 'tick_size')}, {S('expiry_date')}, symbol_details FROM members WHERE in1"""


#: Members of one master file.
MEMBERS_PER_FILE = 100_000


def write_master(members, path: str) -> None:
    """Members as master files of a bounded number of members each, a member a line."""
    files = 1 + members.count() // MEMBERS_PER_FILE
    numbered = members.withColumn("file", F.pmod(F.xxhash64("symTicker"), F.lit(files)))
    first = F.row_number().over(Window.partitionBy("file").orderBy("symTicker")) == 1
    name = F.regexp_extract(F.to_json(F.struct(F.col("symTicker").alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
    text = F.concat(F.when(first, "  ").otherwise(", "), name, F.lit(": "), F.to_json(F.struct(*members.columns)))
    ends = numbered.select("file").distinct().select("file", F.explode(F.array(F.lit("{ "), F.lit("}"))).alias("value"))
    ends = ends.select("file", F.when(F.col("value") == "}", 2).otherwise(0).alias("part"), "value", F.lit(True).alias("later"))
    lines = numbered.select("file", F.lit(1).alias("part"), text.alias("value"), ~first).toDF("file", "part", "value", "later")
    lines.unionByName(ends).repartition("file").sortWithinPartitions("file", "part", "later").select("file", "value").write.partitionBy("file").text(path)


@query("s3_instrument_master", q(MEMBER_SQL))
def s3(t: Tables):
    path = session.fresh_path(t.spark, "master")
    write_master(t.master_members(1), path)
    rows, _ = master_files.read(t.spark, path)
    return rows.select(
        "fytoken", "symbol_ticker", "exchange_code", "segment_code", "ex_instrument_type", "under_symbol", "under_fytoken",
        "option_type", "strike_price", "min_lot_size", "tick_size", "expiry_date", "symbol_details",
    )


@query(
    "s3_braces_in_values",
    q("""SELECT fytoken, symbol_ticker || CASE WHEN length(fytoken) % 2 = 0 THEN '}"{' ELSE '' END AS symbol_ticker,
      CASE length(fytoken) % 3 WHEN 0 THEN '} , ' || symbol_details || ' \\"}' WHEN 1 THEN '{"' || symbol_details || '" :}}' ELSE symbol_details END AS symbol_details
      FROM members WHERE in1"""),
)
def s3_braces(t: Tables):
    path = session.fresh_path(t.spark, "master")
    kind = F.length("fyToken") % 3
    told = F.when(kind == 0, F.concat(F.lit("} , "), "symDetails", F.lit(' \\"}'))).when(kind == 1, F.concat(F.lit('{"'), "symDetails", F.lit('" :}}')))
    ticker = F.concat("symTicker", F.when(F.length("fyToken") % 2 == 0, '}"{').otherwise(""))
    write_master(t.master_members(1).withColumns({"symDetails": told.otherwise(F.col("symDetails")), "symTicker": ticker}), path)
    return master_files.read(t.spark, path)[0].select("fytoken", "symbol_ticker", "symbol_details")


@query(
    "s3_row_hash",
    q("""SELECT fytoken, sha256(array_to_string([fytoken, symbol_ticker, '10', CAST(segment_code AS VARCHAR), CAST(ex_type AS VARCHAR), under_symbol, under_fytoken, '', '', CAST(lot1 AS VARCHAR), '0.0500', '', '', '',
      coalesce(CAST(CAST(strike_price AS DECIMAL(12,4)) AS VARCHAR), ''), coalesce(option_type, ''), coalesce(CAST(expiry_date AS VARCHAR), ''), '', symbol_details], chr(31))) AS row_hash FROM members WHERE in1"""),
)
def s3_hash(t: Tables):
    return t.master(1).select("fytoken", "row_hash")


EXPIRY_LISTS = """listed AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, true AS f FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT o_custkey, CAST(o_orderdate AS DATE) + 7, false FROM orders)"""


def expiry_payloads(t: Tables):
    d = F.to_date("o_orderdate").cast("string")
    body = F.concat(
        F.lit('{"expiry_dates":{"futures":['), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit('"'), d, F.lit('"'))).otherwise(""),
        F.lit('],"options":[" '), F.date_add(F.to_date("o_orderdate"), 7).cast("string"), F.lit(' ","2024-13-45"]}}'),
    )
    return t.given("orders").select("o_custkey", body.alias("payload"))


@query(
    "s4_expiry_dates",
    qq(EXPIRY_LISTS, f"SELECT {B('o_custkey')}, {S('d', 'expiry_date')}, {B('CAST(bool_or(f) AS INT)', 'has_futures')}, {B('CAST(bool_or(NOT f) AS INT)', 'has_options')} FROM listed GROUP BY o_custkey, d"),
)
def s4(t: Tables):
    return payloads.expiry_dates(expiry_payloads(t), ["o_custkey"])[0]


@query("s4_bad_dates", q(f"SELECT {B('o_custkey')}, 'options' AS source, '2024-13-45' AS text FROM orders"))
def s4b(t: Tables):
    return payloads.expiry_dates(expiry_payloads(t), ["o_custkey"])[1]


SPOILED_SQL = """SELECT {0}, CASE o_orderkey % 4 WHEN 1 THEN 'payload_missing' WHEN 2 THEN 'not_json' ELSE '{1}_missing' END AS reason FROM orders WHERE o_orderkey % 4 <> 0"""


def spoiled(t: Tables, whole: str):
    """A payload per order: three in four cannot be read."""
    kind = F.col("o_orderkey") % 4
    text = F.when(kind == 0, whole).when(kind == 2, whole[:-9]).when(kind == 3, '{"other":1}')
    return t.given("orders").select("o_orderkey", text.alias("payload"))


@query("s4_undecodable", q(SPOILED_SQL.format(B("o_orderkey"), "expiry_dates")))
def s4_spoiled(t: Tables):
    return payloads.undecodable(spoiled(t, '{"expiry_dates":{"futures":["2024-01-25"],"options":[]}}'), ["o_orderkey"], "expiries")


@query("s5_undecodable", q(SPOILED_SQL.format(B("o_orderkey"), "contracts")))
def s5_spoiled(t: Tables):
    return payloads.undecodable(spoiled(t, '{"contracts":{"futures":["A24JANFUT"],"options":[]}}'), ["o_orderkey"], "contracts")


@query("s6_undecodable", q(SPOILED_SQL.format(B("o_orderkey"), "optionsChain")))
def s6_spoiled(t: Tables):
    return payloads.undecodable(spoiled(t, '{"optionsChain":[{"symbol":"A"}],"expiryData":[]}'), ["o_orderkey"], "chain")


@query("u3_date_membership", qq(EXPIRY_LISTS, f"SELECT {S('d', 'expiry_date')}, {B('CAST(bool_or(f) AS INT)', 'has_futures')}, {B('CAST(bool_or(NOT f) AS INT)', 'has_options')} FROM listed GROUP BY d"))
def u3(t: Tables):
    everywhere = expiry_payloads(t).withColumn("one", F.lit(1))
    return payloads.expiry_dates(everywhere, ["one"])[0].drop("one")


@query(
    "s5_contract_symbols",
    q(f"""SELECT {B('p_partkey')}, 'P' || p_partkey || 'FUT' AS symbol, 'futures' AS source_array, {B('0', 'source_array_index')} FROM part
      UNION ALL SELECT p_partkey, p_name || 'CE', 'options', 0 FROM part UNION ALL SELECT p_partkey, p_name || 'PE', 'options', 1 FROM part"""),
)
def s5(t: Tables):
    body = F.concat(
        F.lit('{"contracts":{"futures":["  P'), "p_partkey", F.lit('FUT "," "],"options":["'), "p_name",
        F.lit('CE",""," '), "p_name", F.lit('PE"]}}'),
    )
    return payloads.contract_symbols(t.given("part").select("p_partkey", body.alias("payload")), ["p_partkey"])


def chain_payloads(t: Tables):
    price, size = F.col("p_retailprice").cast("decimal(11,4)"), F.col("p_size")

    def leg(right, strike):
        return F.concat(
            F.lit('{"symbol":"'), "p_name", F.lit(f'{right}","option_type":"{right}","strike_price":'), strike, F.lit(',"ltp":'), price,
            F.lit(',"bid":1.5,"ask":null,"volume":'), size, F.lit(',"oi":'), F.col("p_partkey"), F.lit(',"greeks":{"iv":12.5,"delta":0.25}}'),
        )

    own = F.concat(F.lit('{"symbol":"'), "p_name", F.lit('","option_type":"","strike_price":-1,"fp":'), price + 2, F.lit("}"))
    flag = F.when(size % 2 == 0, "W").otherwise("M")
    body = F.concat(
        F.lit('{"expiryData":[{"date":"99-99-2024","expiry_flag":"W"},{"date":"25-01-2024","expiry_flag":"'), flag,
        F.lit('"},{"date":"29-02-2024","expiry_flag":"Q"}],"optionsChain":['), leg("CE", size), F.lit(","), own, F.lit(","), leg("PE", size + 5),
        F.lit('],"indiavixData":{"ltp":14.25}}'),
    )
    # A part is a few stored bytes and its payload hundreds: rows are dealt out before they grow.
    parts = t.given("part").select("p_partkey", "p_name", "p_retailprice", "p_size")
    parts = parts.repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")))
    return parts.select("p_partkey", body.alias("payload"))


@query(
    "s6_chain_quotes",
    q("SELECT * FROM (" + " UNION ALL ".join(
        f"""SELECT {B('p_partkey')}, '2024-01-25' AS expiry_date, CASE WHEN p_size % 2 = 0 THEN 'W' ELSE 'M' END AS expiry_flag, {D(f'p_size + {add}', 'strike')}, '{right}' AS option_type, p_name || '{right}' AS fyers_symbol,
        {D('p_retailprice', 'ltp')}, {D('1.5', 'bid')}, {D('NULL', 'ask')}, {B('p_size', 'volume')}, {B('p_partkey', 'oi')}, {D('12.5', 'iv')}, {D('0.25', 'delta')}, {D('CAST(p_retailprice AS DECIMAL(11,4)) + 2', 'fp')}, {D('14.25', 'india_vix')} FROM part"""
        for right, add in (("CE", 0), ("PE", 5))) + ")"),
)
def s6(t: Tables):
    return payloads.chain_quotes(chain_payloads(t), ["p_partkey"]).drop("prev_oi", "gamma", "theta", "vega")


@query("s6_chain_flags", q(f"SELECT {B('p_partkey')}, {B('1', 'position')}, '2024-01-25' AS expiry_date, CASE WHEN p_size % 2 = 0 THEN 'W' ELSE 'M' END AS expiry_flag FROM part"))
def s6f(t: Tables):
    return payloads.chain_expiries(chain_payloads(t), ["p_partkey"])


# -- exports -------------------------------------------------------------------------------------------


def export_rows(t: Tables, spec: export.Spec):
    return export.rows(spec, t.candles, t.contracts, t.underlyings, t.resolutions)


WIDE_SQL = f"""c.fyers_symbol AS symbol, u.fyers_symbol AS underlying_symbol, display_name AS underlying_name, c.kind AS kind, instrument_class, c.exchange AS exchange, {S('c.expiry_date', 'expiry_date')},
  {D('c.strike', 'strike')}, option_type, {B('lot_size')}, '1' AS resolution, strftime(k.ts, '%Y-%m-%d %H:%M:%S') AS ts_ist, {U('k.ts', 'ts_utc_epoch')}, {D('open')}, {D('high')}, {D('low')}, {D('close')}, {B('volume')}, {B('oi')},
  {B('k.contract_id', 'contract_id')}, {B('res_id')}"""
RAW_SQL = f"{B('contract_id')}, {B('res_id')}, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_ist, {U('ts', 'ts_utc_epoch')}, {D('open')}, {D('high')}, {D('low')}, {D('close')}, {B('volume')}, {B('oi')}"


@query("j11_denormalised_export", q(f"SELECT {WIDE_SQL} FROM candles k JOIN contracts c USING (contract_id) JOIN underlyings u ON u.underlying_id = c.underlying_id"))
def j11(t: Tables):
    return export_rows(t, export.Spec()).drop("ts")


@query("s7_parquet_export", q(f"SELECT {RAW_SQL} FROM candles"))
def s7(t: Tables):
    path = session.fresh_path(t.spark, "export")
    spec = export.Spec(denormalise=False)
    export.write_single(export_rows(t, spec), path, spec)
    return t.spark.read.parquet(path)


@query("s8_partitioned_archive", q(f"SELECT {WIDE_SQL} FROM candles k JOIN contracts c USING (contract_id) JOIN underlyings u ON u.underlying_id = c.underlying_id"))
def s8(t: Tables):
    return table_reads.archive(t.spark, archived(t))


def archived(t: Tables) -> str:
    root = session.fresh_path(t.spark, "archive")
    spec = export.Spec(layout="hive")
    export.write_archive(
        export_rows(t, spec), root, spec,
        {"dim_underlying": t.underlyings, "dim_expiry": t.expiries, "dim_contract": t.contracts, "dim_resolution": t.resolutions},
    )
    return root


@query("s9_csv_export", q(f"SELECT CAST(contract_id AS VARCHAR) AS contract_id, '2' AS res_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_ist, CAST(CAST(date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', ts)) - 19800 AS BIGINT) AS VARCHAR) AS ts_utc_epoch, {S('open')}, {S('high')}, {S('low')}, {S('close')}, {S('volume')}, {S('oi')} FROM candles"))
def s9(t: Tables):
    path = session.fresh_path(t.spark, "csv")
    spec = export.Spec(format="csv", denormalise=False)
    export.write_single(export_rows(t, spec), path, spec)
    text = ", ".join(f"{c} string" for c in ["contract_id", "res_id", "ts_ist", "ts_utc_epoch", "open", "high", "low", "close", "volume", "oi"])
    return t.spark.read.schema(text).option("header", True).csv(path)


SCOPE = export.Scope(
    underlying_id=2, expiry_from="2024-01-01", expiry_to="2024-01-31", kind="OPT", option_type="PE", resolutions=(2,),
    ts_from="2024-01-05 00:00:00", ts_to="2024-01-25 00:00:00",
)
SCOPE_SQL = "FROM candles k JOIN contracts c USING (contract_id) WHERE c.underlying_id = 2 AND c.expiry_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' AND c.kind = 'OPT' AND c.option_type = 'PE' AND k.ts >= TIMESTAMP '2024-01-05' AND k.ts < TIMESTAMP '2024-01-25'"


@query("s10_export_scope", q(f"SELECT {B('contract_id')}, {T('ts')}, {D('close')} {SCOPE_SQL}"))
def s10(t: Tables):
    rows = export_rows(t, export.Spec(denormalise=False, scope=SCOPE))
    return rows.select("contract_id", "ts", "close")


@query("s12_export_estimate", q(f"SELECT {B('count(*)', 'row_count')}, {B('floor(count(*) * (16 * 1.2::DOUBLE))', 'estimated_bytes')} {SCOPE_SQL}"))
def s12(t: Tables):
    return export.estimate(export.Spec(compression="snappy", scope=SCOPE), t.candles, t.contracts)


@query("s13_export_sidecar", q(f"SELECT 'e1' AS export_id, '2024-03-01 00:00:00.000000' AS created_at, {B('count(*)', 'row_count')}, {B('21', 'described_columns')} {SCOPE_SQL}"))
def s13(t: Tables):
    spec = export.Spec(scope=SCOPE)
    counted = export.estimate(spec, t.candles, t.contracts)
    described = export.sidecar(export_rows(t, spec), spec, "e1", "2024-03-01 00:00:00", counted)
    names = F.from_json("description", "schema struct<fields: array<struct<name: string>>>")
    return described.select("export_id", "created_at", "row_count", F.size(names["schema"]["fields"]).alias("described_columns"))


@query("s13_export_manifest", q(f"SELECT 'e2' AS export_id, 'parquet' AS kind, {B('count(*)', 'row_count')}, {B('1', 'has_size')}, {B('64', 'digest_length')} {SCOPE_SQL}"))
def s13m(t: Tables):
    path = session.fresh_path(t.spark, "export")
    spec = export.Spec(denormalise=False, scope=SCOPE)
    written = export.write_single(export_rows(t, spec), path, spec)
    row = export.manifest_row(spec, "e2", path, "2024-03-01 00:00:00", written, export.file_digests(t.spark, path))
    return row.select("export_id", "kind", "row_count", (F.col("byte_size") > 0).alias("has_size"), F.length("sha256").alias("digest_length"))


@query(
    "s14_file_digests",
    f"""SELECT 'nation=' || c_nationkey AS folder, {B('sum(strlen(c_name) + 1)', 'byte_size')}, sha256(string_agg(c_name || chr(10), '' ORDER BY c_name)) AS sha256
      FROM customer GROUP BY c_nationkey""",
)
def s14(t: Tables):
    path = session.fresh_path(t.spark, "export")
    names = t.given("customer").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("value"))
    names.repartition("nation").sortWithinPartitions("nation", "value").write.partitionBy("nation").text(path)
    return export.file_digests(t.spark, path).select("folder", "byte_size", "sha256")


@query("s16_arrow_hand_off", q(f"SELECT {B('res_id')}, {B('count(*)', 'bars')}, {D('min(low)', 'low')}, {D('max(high)', 'high')}, {D('sum(close)', 'closes')}, {T('max(ts)', 'last_ts')} FROM candles GROUP BY res_id"))
def s16(t: Tables):
    # At most a row for each of the fifteen resolutions crosses to the driver.
    summary = t.candles.groupBy("res_id").agg(
        F.count("*").alias("bars"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("close").alias("closes"), F.max("ts").alias("last_ts")
    )
    return t.spark.createDataFrame(export.to_arrow(summary))


@query(
    "s11_spec_problems",
    f"""SELECT {B('o_orderkey')}, CASE WHEN f = 'orc' THEN 'format_unknown' WHEN l = 'flat' THEN 'layout_unknown' WHEN c = 'lz77' THEN 'codec_unknown'
      WHEN l = 'hive' AND f = 'csv' THEN 'tree_needs_parquet' WHEN l = 'hive' AND NOT d THEN 'tree_needs_dimensions' END AS problem
      FROM (SELECT o_orderkey, ['parquet', 'csv', 'orc'][o_orderkey % 3 + 1] AS f, ['single', 'hive', 'flat'][o_orderkey // 3 % 3 + 1] AS l,
        ['ZSTD', 'snappy', 'lz77'][o_orderkey // 9 % 3 + 1] AS c, o_custkey % 2 = 0 AS d FROM orders)""",
)
def s11(t: Tables):
    def one_of(n, *names):
        return F.get(F.array(*map(F.lit, names)), F.expr(f"cast(o_orderkey div {n} % 3 as int)"))

    specs = t.given("orders").select(
        "o_orderkey", one_of(1, "parquet", "csv", "orc").alias("format"), one_of(3, "single", "hive", "flat").alias("layout"),
        one_of(9, "ZSTD", "snappy", "lz77").alias("compression"), (F.col("o_custkey") % 2 == 0).alias("denormalise"),
    )
    return export.spec_problems(specs).select("o_orderkey", "problem")


@query(
    "s15_archive_read_back",
    q(f"""SELECT c.fyers_symbol AS symbol, {B('count(*)', 'bars')}, {D('max(close)', 'high_close')} FROM candles k JOIN contracts c USING (contract_id) JOIN underlyings u ON u.underlying_id = c.underlying_id
      WHERE u.fyers_symbol = 'NSE:BETA-INDEX' AND c.expiry_date = DATE '{EXPIRIES[0]}' GROUP BY c.fyers_symbol"""),
)
def s15(t: Tables):
    root = archived(t)
    back = table_reads.archive(t.spark, root).where(
        (F.col("underlying_symbol") == "NSE:BETA-INDEX") & (F.col("expiry_date") == clock.day(EXPIRIES[0]))
    )
    known = table_reads.archive_catalog(t.spark, root, "dim_contract").select(F.col("fyers_symbol").alias("symbol"))
    return back.join(known, "symbol", "left_semi").groupBy("symbol").agg(F.count("*").alias("bars"), F.max("close").alias("high_close"))


# -- the table on disk and the stream ---------------------------------------------------------------------


@query(
    "w14_clustered_rewrite",
    q(f"SELECT {B('contract_id // 1048576', 'id_block')}, strftime(ts, '%Y-%m') AS trade_month, {B('count(*)', 'bars')}, {B('0', 'files_out_of_order')} FROM candles GROUP BY ALL"),
)
def w14(t: Tables):
    path = session.fresh_path(t.spark, "candles")
    store.write(t.candles, path, ID_BLOCK)
    table = store.read(t.spark, path, ID_BLOCK)
    wrong = store.out_of_order(table).groupBy(*store.FOLDERS).agg(F.count("*").alias("n"))
    return (
        table.groupBy(*store.FOLDERS).agg(F.count("*").alias("bars")).join(wrong, store.FOLDERS, "left")
        .withColumn("files_out_of_order", F.coalesce("n", F.lit(0))).drop("n")
    )


def streamed(t: Tables) -> dict:
    """Land every envelope, then a second answer for the days before the sixth, and follow both."""
    landing, root = session.fresh_path(t.spark, "landing"), session.fresh_path(t.spark, "tables")
    first = day_envelopes(t).withColumn("fetched_at", clock.ntz("2024-04-01 00:00:00"))
    again = first.where("day(range_from) < 6").select(
        "contract_id", "res_id", "range_from", "range_to", F.lit('{"s":"no_data","candles":[]}').alias("payload"),
        clock.ntz("2024-04-02 00:00:00").alias("fetched_at"),
    )
    for part in (first, again):
        part.select("contract_id", "res_id", "range_from", "range_to", "fetched_at", "payload").write.mode("append").parquet(landing)
        ingest.start(t.spark, landing, root, available_now=True, ids_per_block=ID_BLOCK).awaitTermination()
    return ingest.tables(t.spark, root)


LEFT = GOOD.replace("NOT IN (7, 8, 9, 10, 12, 14, 15, 16, 17, 18, 19, 20)", "NOT IN (1, 2, 3, 4, 5, 7, 8, 9, 10, 12, 14, 15, 16, 17, 18, 19, 20)").replace("good AS", "stay AS")


@query("x1_stream_bars", qq(LEFT, f"SELECT {B('contract_id')}, {B('res_id')}, {T('ts')}, {D('open')}, {D('close')}, {B('volume')}, {B('oi')} FROM stay"))
def x1(t: Tables):
    return streamed(t)["candles"].select("contract_id", "res_id", "ts", "open", "close", "volume", "oi")


@query(
    "x1_stream_ledger",
    q(f"""SELECT {B('contract_id')}, {S('d', 'range_from')}, CASE WHEN day(d) < 6 OR day(d) = 12 THEN 'empty' ELSE 'ok' END AS status, {B('CASE WHEN day(d) < 6 OR day(d) = 12 THEN 0 ELSE n END', 'row_count')}
      FROM (SELECT contract_id, CAST(ts AS DATE) AS d, count(*) AS n FROM candles WHERE day(ts) NOT IN (7, 8, 9, 10, 14, 15, 16, 17, 18, 19, 20) GROUP BY ALL)"""),
)
def x1_ledger(t: Tables):
    return streamed(t)["coverage"].select("contract_id", "range_from", "status", "row_count")


@query("x1_stream_bounds", qq(LEFT, f"SELECT {B('contract_id')}, {B('count(*)', 'row_count')}, {T('min(ts)', 'first_ts')}, {T('max(ts)', 'last_ts')} FROM stay GROUP BY contract_id"))
def x1_bounds(t: Tables):
    return streamed(t)["bounds"].select("contract_id", "row_count", "first_ts", "last_ts")

