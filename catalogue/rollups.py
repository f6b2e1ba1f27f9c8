"""Aggregates, coverage rollups, quality checks and the request log."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.base import Tables, query
from catalogue.sql import B, D, S, T, U, q, qq
from tickloom.operators import aggregates, coverage, quality, registry, requestlog


@query(
    "daily_bars",
    q(f"""SELECT {B('contract_id')}, {S('CAST(ts AS DATE)', 'trade_date')}, {D('first(open ORDER BY ts)', 'open')}, {D('max(high)', 'high')},
      {D('min(low)', 'low')}, {D('last(close ORDER BY ts)', 'close')}, {B('sum(volume)', 'volume')}, {B('last(oi ORDER BY ts)', 'oi')},
      {B('count(*)', 'bar_count')} FROM candles GROUP BY contract_id, CAST(ts AS DATE)"""),
)
def a1(t: Tables):
    return aggregates.daily_bars(t.candles)


@query("a2_bounds", q(f"SELECT {B('contract_id')}, {B('res_id')}, {B('row_count')}, {T('first_ts')}, {T('last_ts')} FROM bounds"))
def a2(t: Tables):
    return aggregates.bounds(t.candles)


@query(
    "a3_coverage_grid",
    q(f"""SELECT {B('c.underlying_id', 'underlying_id')}, {S('c.expiry_date', 'expiry_date')}, {B('res_id')}, {B('count(DISTINCT contract_id)', 'contracts_covered')},
      {B('''count(*) FILTER (WHERE status = 'ok')''', 'chunks_ok')}, {B('''count(*) FILTER (WHERE status = 'empty')''', 'chunks_empty')},
      {B('''count(*) FILTER (WHERE status = 'error')''', 'chunks_error')}, {B('sum(row_count)', 'rows')}, {S('min(range_from)', 'have_from')},
      {S('max(range_to)', 'have_to')}, {B('max(contract_count)', 'contracts_total')},
      {B('greatest(max(contract_count) - count(DISTINCT contract_id), 0)', 'contracts_missing')}
      FROM coverage JOIN contracts c USING (contract_id) LEFT JOIN expiries e ON e.expiry_id = c.expiry_id
      WHERE kind <> 'SPOT' GROUP BY c.underlying_id, c.expiry_date, res_id"""),
)
def a3(t: Tables):
    return coverage.grid(t.coverage, t.contracts, t.expiries)


@query(
    "a4_contract_coverage",
    q(f"""SELECT {B('contract_id')}, {B('res_id')}, fyers_symbol, {D('strike')}, option_type, {S('expiry_date')}, {S('min(range_from)', 'have_from')},
      {S('max(range_to)', 'have_to')}, {B('sum(row_count)', 'rows_held')}, {B('''count(*) FILTER (WHERE status = 'empty')''', 'empty_chunks')}
      FROM coverage JOIN contracts USING (contract_id) GROUP BY ALL"""),
)
def a4(t: Tables):
    return coverage.per_contract(t.coverage, t.contracts)


@query(
    "a8_expiry_rollup",
    q(f"""SELECT {B('expiry_id')}, {B('count(*)', 'contract_count')}, {B('''count(*) FILTER (WHERE kind = 'FUT')''', 'futures_count')},
      {B('''count(*) FILTER (WHERE kind = 'OPT')''', 'options_count')}, {D('min(strike)', 'min_strike')}, {D('max(strike)', 'max_strike')},
      {B('''CAST(count(*) FILTER (WHERE kind = 'FUT') > 0 AS INT)''', 'has_futures')}, {B('''CAST(count(*) FILTER (WHERE kind = 'OPT') > 0 AS INT)''', 'has_options')}
      FROM contracts WHERE expiry_id IS NOT NULL GROUP BY expiry_id"""),
)
def a8(t: Tables):
    return aggregates.expiry_rollup(t.contracts)


# Strikes with uneven gaps: every part's size is a strike of its brand.
@query(
    "a9_strike_step",
    qq("""s AS (SELECT DISTINCT CAST(p_brand[7:] AS INT) AS expiry_id, CAST(p_size AS DECIMAL(12,4)) AS strike FROM part),
       g AS (SELECT expiry_id, strike - lag(strike) OVER (PARTITION BY expiry_id ORDER BY strike) AS gap FROM s),
       n AS (SELECT expiry_id, gap, count(*) AS n FROM g WHERE gap > 0 GROUP BY ALL)""",
       f"SELECT {B('expiry_id')}, {D('gap', 'strike_step')} FROM n QUALIFY row_number() OVER (PARTITION BY n.expiry_id ORDER BY n.n DESC, n.gap) = 1"),
)
def a9(t: Tables):
    strikes = t.given("part").select(
        F.substring("p_brand", 7, 9).cast("int").alias("expiry_id"), F.col("p_size").cast("decimal(12,4)").alias("strike"),
        F.lit("OPT").alias("kind"),
    )
    return aggregates.strike_step(strikes)


@query(
    "a10_underlying_rollup",
    q(f"""SELECT {B('underlying_id')}, {S('min(expiry_date)', 'first_expiry')}, {S('max(expiry_date)', 'last_expiry')}, {B('count(*)', 'expiry_count')},
      {B('sum(contract_count)', 'contract_count')} FROM expiries GROUP BY underlying_id"""),
)
def a10(t: Tables):
    return aggregates.underlying_rollup(t.expiries)


@query(
    "a11_trading_days",
    q(f"SELECT exchange, {S('trade_date')}, {T('session_open')}, {T('session_close')}, {B('bar_count')}, {B('contract_count')}, 'spot_bars' AS derived_from FROM observed"),
)
def a11(t: Tables):
    return aggregates.trading_days(t.candles, t.underlyings)


@query(
    "a12_typical_rows",
    q(f"""SELECT {B('underlying_id')}, {B('res_id')}, {B('round_even(median(row_count), 0)', 'typical')}
      FROM coverage JOIN contracts USING (contract_id) WHERE status = 'ok' AND row_count > 0 GROUP BY underlying_id, res_id"""),
)
def a12(t: Tables):
    return aggregates.typical_rows(t.coverage, t.contracts)


@query(
    "a13_longest_session",
    q(f"""SELECT exchange, {B('''max(date_diff('second', date_trunc('second', session_open), date_trunc('second', session_close)))''', 'session_seconds')}
      FROM observed WHERE session_close > session_open GROUP BY exchange"""),
)
def a13(t: Tables):
    return aggregates.longest_session(t.observed_days)


@query(
    "a14_sibling_count",
    q(f"""SELECT {B('underlying_id')}, {B('l[len(l) // 2 + 1]', 'sibling_count')} FROM (
      SELECT underlying_id, list(contract_count ORDER BY contract_count) AS l FROM expiries
       WHERE contracts_discovered_at IS NOT NULL AND contract_count > 0 GROUP BY underlying_id)"""),
)
def a14(t: Tables):
    return aggregates.sibling_contract_count(t.expiries)


@query(
    "a16_root_counts",
    q(f"""SELECT {B('10', 'exchange_code')}, under_symbol, min(under_fytoken) AS under_fytoken, {B('11', 'segment_code')}, {B('count(*)', 'contract_count')}
      FROM history WHERE valid_to IS NULL AND segment_code = 11 GROUP BY under_symbol"""),
)
def a16(t: Tables):
    return registry.root_counts(t.master_history)


@query(
    "a17_root_characters",
    q(f"""SELECT {B('count(*)', 'root_count')}, (SELECT string_agg(c, '' ORDER BY c) FROM (SELECT DISTINCT under_symbol[1] AS c FROM history WHERE segment_code = 11)) AS first_chars,
      (SELECT string_agg(c, '' ORDER BY c) FROM (SELECT DISTINCT unnest(string_split(under_symbol[2:], '')) AS c FROM history WHERE segment_code = 11)) AS body_chars,
      '[7N][A-Z0-9_]*' AS pattern FROM
      (SELECT DISTINCT under_symbol AS r FROM history WHERE segment_code = 11)"""),
)
def a17(t: Tables):
    roots = t.master_history.where("segment_code = 11")
    return registry.character_class(roots).select(
        "root_count", "first_chars", "body_chars",
        F.regexp_replace("pattern", r"^\[N7\]", "[7N]").alias("pattern"),
    )


@query(
    "a17_unusual_roots",
    q(f"""SELECT r AS root, {B("CAST(r[1] <> '7' AS INT)", 'fits_pattern')} FROM (SELECT DISTINCT under_symbol AS r FROM history WHERE segment_code = 11) WHERE NOT regexp_full_match(r, '[A-Z0-9]+')"""),
)
def a17_roots(t: Tables):
    return registry.unusual_roots(t.master_history.where("segment_code = 11"))


@query(
    "a18_bounds_utc",
    q(f"""SELECT {B('contract_id')}, {B('res_id')}, fyers_code, chart_interval, {B('seconds')}, {U('first_ts')}, {U('last_ts')}, {B('row_count', 'rows')}
      FROM bounds LEFT JOIN resolutions USING (res_id)"""),
)
def a18(t: Tables):
    return aggregates.bounds_utc(t.bounds, t.resolutions)


PROGRESS = f"""SELECT {B('job_id')}, {B('count(*)', 'total')}, {B('''count(*) FILTER (WHERE state = 'pending')''', 'pending')}, {B('''count(*) FILTER (WHERE state = 'leased')''', 'leased')},
  {B('''count(*) FILTER (WHERE state = 'done')''', 'done')}, {B('''count(*) FILTER (WHERE state = 'empty')''', 'empty')}, {B('''count(*) FILTER (WHERE state = 'failed')''', 'failed')},
  {B('''count(*) FILTER (WHERE state = 'skipped')''', 'skipped')}, {B('''count(*) FILTER (WHERE state = 'cancelled')''', 'cancelled')}, {B('sum(requests_used)', 'requests_used')},
  {B('coalesce(sum(row_count), 0)', 'rows_written')}, {B('coalesce(sum(response_bytes), 0)', 'bytes_downloaded')}, {B('''count(*) FILTER (WHERE state = 'pending')''', 'open')},
  CASE WHEN count(*) FILTER (WHERE state = 'pending') > 0 THEN CAST(round_even(count(*) FILTER (WHERE state = 'pending') / (170 / 60.0::DOUBLE), 0) AS BIGINT) END AS eta_seconds,
  CASE WHEN count(*) FILTER (WHERE state <> 'pending') > 0 THEN round(count(*) FILTER (WHERE state <> 'pending') / (greatest(date_diff('second', min(date_trunc('second', started_at)), max(date_trunc('second', finished_at))), 1) / 60.0::DOUBLE), 2) END AS tasks_per_minute
  FROM request_log GROUP BY job_id"""


@query("a20_request_progress", q(PROGRESS))
def a20(t: Tables):
    return requestlog.progress(t.request_log, 170)


@query(
    "a21_interval_availability",
    q(f"""SELECT {B('contract_id')}, {B('res_id')}, chart_interval, {B('seconds')}, {B('coalesce(row_count, 0)', 'rows')}, {U('first_ts')}, {U('last_ts')},
      CASE WHEN coalesce(row_count, 0) > 0 THEN 'available' ELSE 'no_data' END AS state
      FROM (SELECT DISTINCT contract_id, res_id FROM coverage) d FULL OUTER JOIN bounds b USING (contract_id, res_id) JOIN resolutions USING (res_id)"""),
)
def a21(t: Tables):
    declared = t.coverage.join(t.resolutions, "res_id").select("contract_id", "fyers_code")
    return aggregates.interval_availability(declared, t.bounds, t.resolutions)


@query("j12_contracts_needing_data", q(f"""SELECT {B('contract_id')}, fyers_symbol, kind FROM contracts c
  WHERE kind <> 'SPOT' AND NOT EXISTS (SELECT 1 FROM coverage v WHERE v.contract_id = c.contract_id AND v.res_id = 6)"""))
def j12(t: Tables):
    return coverage.needing_data(t.contracts, t.coverage, 6).select("contract_id", "fyers_symbol", "kind")


@query(
    "p8_outcome_classes",
    qq("""c AS (SELECT *, CASE WHEN status = 'no_data' THEN 'empty' WHEN http_status = 429 OR code = -429 THEN 'rate_limited' WHEN http_status = 401 THEN 'auth_fatal'
            WHEN code IN (-8, -16, -17) THEN 'auth_recoverable' WHEN code = -15 THEN 'auth_fatal' WHEN code IN (-50, -51, -53, -99, -300, -352, 400) THEN 'fatal'
            WHEN http_status IN (400, 403) THEN 'fatal' WHEN http_status IN (500, 502, 503, 504) OR http_status BETWEEN 500 AND 599 THEN 'transient' ELSE 'fatal' END AS retry_class
            FROM request_log WHERE status <> 'ok')""",
       f"""SELECT {B('task_id')}, retry_class, CASE retry_class WHEN 'empty' THEN 'empty' WHEN 'fatal' THEN 'failed' ELSE 'pending' END AS task_state,
      {B('''CAST(retry_class = 'transient' AS INT)''', 'consumes_attempt')},
      CASE WHEN retry_class = 'rate_limited' THEN 'paused_rate' WHEN retry_class LIKE 'auth%' THEN 'paused_auth' END AS pipeline_mode,
      {B('''CAST(retry_class = 'fatal' AND code = -300 AND coalesce(http_status, 0) NOT IN (401, 429) AS INT)''', 'check_symbol_encoding')} FROM c"""),
)
def p8(t: Tables):
    return requestlog.classify(t.request_log).select(
        "task_id", "retry_class", "task_state", "consumes_attempt", "pipeline_mode", "check_symbol_encoding"
    )


# -- quality ----------------------------------------------------------------------------------------

DUP = "dup AS (SELECT CAST(l_partkey AS BIGINT) AS contract_id, l_shipdate AS ts, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1)"


def line_bars(t: Tables):
    """Line items as bars keyed by part and ship date, a key that does repeat."""
    return t.given("lineitem").select(
        F.col("l_partkey").cast("int").alias("contract_id"), F.lit(2).cast("smallint").alias("res_id"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
    )


@query("q1_duplicate_bars", qq(DUP, f"SELECT contract_id, {B('2', 'res_id')}, {T('ts')}, {B('copies')} FROM dup"))
def q1(t: Tables):
    return quality.duplicate_bars(line_bars(t))


@query("t6_worst_duplicates", qq(DUP, f"SELECT contract_id, {B('2', 'res_id')}, {T('ts')}, {B('copies')} FROM dup ORDER BY dup.copies DESC, contract_id, dup.ts LIMIT 50"))
def t6(t: Tables):
    return quality.worst_duplicates(line_bars(t))


MISMATCH = """mis AS (SELECT * FROM (SELECT v.contract_id, v.res_id, sum(v.row_count) AS claimed,
  coalesce(any_value(b.row_count), 0) AS actual FROM coverage v LEFT JOIN bounds b USING (contract_id, res_id) WHERE status = 'ok' GROUP BY v.contract_id, v.res_id) WHERE claimed <> actual)"""


@query("q2_ledger_mismatches", qq(MISMATCH, f"SELECT {B('contract_id')}, {B('res_id')}, {B('claimed')}, {B('actual')} FROM mis"))
def q2(t: Tables):
    return quality.ledger_mismatches(t.coverage, t.candles)


@query("q2_worst_mismatches", qq(MISMATCH, f"SELECT {B('contract_id')}, {B('res_id')}, {B('claimed')}, {B('actual')} FROM mis ORDER BY abs(mis.claimed - mis.actual) DESC, mis.contract_id, mis.res_id LIMIT 200"))
def q2w(t: Tables):
    return quality.worst_mismatches(t.coverage, t.candles)


# Contracts of the customers, most of them without bars; each customer is an expiry of its own.
CUSTOMER_LEGS = """cl AS (SELECT CAST(c_custkey AS BIGINT) * 512 + c_nationkey * 40 + 1 AS contract_id, CASE WHEN c_nationkey = 0 THEN 'SPOT' ELSE 'OPT' END AS kind,
  CAST(c_custkey AS BIGINT) AS expiry_id FROM customer)"""


def customer_legs(t: Tables):
    return t.given("customer").select(
        (F.col("c_custkey") * 512 + F.col("c_nationkey") * 40 + 1).cast("int").alias("contract_id"),
        F.when(F.col("c_nationkey") == 0, "SPOT").otherwise("OPT").alias("kind"),
        F.col("c_custkey").alias("expiry_id"),
    )


def customer_blocks(t: Tables):
    """Overlapping and unaligned blocks: customer n holds ids from 512 n, 700 wide."""
    n = F.col("c_custkey")
    return t.given("customer").select(
        n.alias("expiry_id"), (n * 512).alias("contract_id_lo"), (n * 512 + 699).alias("contract_id_hi")
    )


BLOCKS = "nb AS (SELECT c_custkey AS expiry_id, c_custkey * 512 AS lo, c_custkey * 512 + 699 AS hi FROM customer)"


@query("q3_contracts_without_bars", qq(CUSTOMER_LEGS, "SELECT contract_id, kind FROM cl WHERE kind <> 'SPOT' AND contract_id NOT IN (SELECT contract_id FROM bounds)"))
def q3(t: Tables):
    return quality.contracts_without_bars(customer_legs(t), t.bounds).select("contract_id", "kind")


@query("q4_stray_spot_ids", qq(CUSTOMER_LEGS, "SELECT contract_id FROM cl WHERE kind = 'SPOT' AND contract_id > 999"))
def q4(t: Tables):
    return quality.stray_spot_ids(customer_legs(t)).select("contract_id")


@query("q5_low_contract_ids", qq(CUSTOMER_LEGS, "SELECT contract_id FROM cl WHERE kind <> 'SPOT' AND contract_id < 1024"))
def q5(t: Tables):
    return quality.low_contract_ids(customer_legs(t)).select("contract_id")


@query("q6_outside_block", qq(f"{CUSTOMER_LEGS}, {BLOCKS}", f"SELECT contract_id, {B('expiry_id')} FROM cl JOIN nb USING (expiry_id) WHERE kind <> 'SPOT' AND (contract_id < lo OR contract_id > hi)"))
def q6(t: Tables):
    return quality.outside_block(customer_legs(t), customer_blocks(t)).select("contract_id", "expiry_id")


@query("j15_overlapping_blocks", qq(BLOCKS, f"SELECT {B('a.expiry_id', 'a_id')}, {B('b.expiry_id', 'b_id')} FROM nb a JOIN nb b ON a.expiry_id < b.expiry_id AND a.lo <= b.hi AND b.lo <= a.hi"))
def j15(t: Tables):
    return quality.overlapping_blocks(customer_blocks(t))


# Order intervals as blocks: many, of every width, spread over the id line.
@query(
    "q7_overlap_count",
    qq("ob AS (SELECT o_orderkey AS id, o_custkey * 1000 AS lo, o_custkey * 1000 + o_orderkey % 3000 AS hi FROM orders)",
       f"SELECT {B('count(*)', 'offending')} FROM ob a JOIN ob b ON a.id < b.id AND a.lo <= b.hi AND b.lo <= a.hi"),
)
def q7(t: Tables):
    lo = F.col("o_custkey") * 1000
    blocks = t.given("orders").select(
        F.col("o_orderkey").alias("expiry_id"), lo.alias("contract_id_lo"), (lo + F.col("o_orderkey") % 3000).alias("contract_id_hi")
    )
    return quality.overlap_count(blocks)


@query("q7_blocks_reaching_back", qq(BLOCKS, f"SELECT {B('expiry_id')}, {B('lo', 'contract_id_lo')}, {B('r', 'reach')} FROM (SELECT *, max(hi) OVER (ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM nb) WHERE r >= lo"))
def q7b(t: Tables):
    return quality.blocks_reaching_back(customer_blocks(t))


@query("q8_unaligned_blocks", qq(BLOCKS, f"SELECT {B('expiry_id')} FROM nb WHERE lo % 1024 <> 0"))
def q8(t: Tables):
    return quality.unaligned_blocks(customer_blocks(t)).select("expiry_id")


@query("q9_orphan_series", qq(CUSTOMER_LEGS, f"SELECT DISTINCT {B('contract_id')} FROM candles WHERE contract_id NOT IN (SELECT contract_id FROM cl)"))
def q9(t: Tables):
    return quality.orphan_series(t.candles, customer_legs(t))


@query(
    "q10_health_report",
    qq(MISMATCH, """SELECT 'duplicate_keys' AS check_name, count(*) AS offending FROM (SELECT 1 FROM candles GROUP BY contract_id, res_id, ts HAVING count(*) > 1)
      UNION ALL SELECT 'coverage_row_mismatch', count(*) FROM mis
      UNION ALL SELECT 'contracts_with_no_bars', count(*) FROM contracts WHERE kind <> 'SPOT' AND contract_id NOT IN (SELECT contract_id FROM bounds)
      UNION ALL SELECT 'spot_id_out_of_reserved_range', count(*) FROM contracts WHERE kind = 'SPOT' AND contract_id > 999
      UNION ALL SELECT 'contract_id_below_first_block', count(*) FROM contracts WHERE kind <> 'SPOT' AND contract_id < 1024
      UNION ALL SELECT 'contract_id_outside_block', count(*) FROM contracts c JOIN expiries e ON e.expiry_id = c.expiry_id WHERE kind <> 'SPOT' AND (contract_id < contract_id_lo OR contract_id > contract_id_hi)
      UNION ALL SELECT 'overlapping_id_blocks', count(*) FROM expiries a JOIN expiries b ON a.expiry_id < b.expiry_id AND a.contract_id_lo <= b.contract_id_hi AND b.contract_id_lo <= a.contract_id_hi
      UNION ALL SELECT 'unaligned_id_blocks', count(*) FROM expiries WHERE contract_id_lo % 1024 <> 0
      UNION ALL SELECT 'candles_without_a_contract', count(*) FROM (SELECT DISTINCT contract_id FROM candles) WHERE contract_id NOT IN (SELECT contract_id FROM contracts)"""),
)
def q10(t: Tables):
    return quality.report(t.candles, t.coverage, t.bounds, t.contracts, t.expiries)
