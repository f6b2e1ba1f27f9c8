"""The same domain tables in the oracle's SQL, and small helpers for its output columns."""

from __future__ import annotations


def B(expr: str, name: str | None = None) -> str:
    return f"CAST({expr} AS BIGINT) AS {name or expr}"


def D(expr: str, name: str | None = None) -> str:
    return f"CAST({expr} AS DOUBLE) AS {name or expr}"


def S(expr: str, name: str | None = None) -> str:
    return f"CAST({expr} AS VARCHAR) AS {name or expr}"


def T(expr: str, name: str | None = None) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f') AS {name or expr}"


def U(expr: str, name: str | None = None) -> str:
    """UTC seconds of an IST wall clock."""
    return f"CAST(date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', {expr})) - 19800 AS BIGINT) AS {name or expr}"


IDS = """
  user_id % 5 + 1 AS underlying_id, user_id // 5 AS leg,
  CASE WHEN user_id >= 5 THEN 1 + 2 * (user_id % 5) + ((user_id // 5) // 2) % 2 END AS expiry_id,
  CASE WHEN user_id < 5 THEN user_id + 1
       ELSE (1 + 2 * (user_id % 5) + ((user_id // 5) // 2) % 2) * 1048576
            + 2 * ((user_id // 5) // 4) + (user_id // 5) % 2 END AS contract_id
"""

BASE = f"""
candles AS (
  SELECT contract_id, 2 AS res_id, ts, CAST(value AS DECIMAL(11,4)) AS open,
         CAST(CAST(value AS DECIMAL(11,4)) + 1 AS DECIMAL(11,4)) AS high,
         CAST(CAST(value AS DECIMAL(11,4)) - 1 AS DECIMAL(11,4)) AS low,
         CAST(value AS DECIMAL(11,4)) AS close, event_id % 1000 AS volume,
         CASE WHEN event_id % 5 <> 0 THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END AS oi
    FROM (SELECT *, {IDS} FROM events)),
daily AS (
  SELECT contract_id, 100 AS res_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS ts,
         first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low,
         last(close ORDER BY ts) AS close, sum(volume) AS volume, last(oi ORDER BY ts) AS oi,
         count(*) AS bar_count
    FROM candles GROUP BY contract_id, CAST(ts AS DATE)),
underlyings AS (
  SELECT underlying_id, exchange || ':' || root || '-INDEX' AS fyers_symbol, root, exchange,
         CASE WHEN underlying_id = 4 THEN 'EQUITY' ELSE 'INDEX' END AS instrument_kind,
         upper(root[1]) || lower(root[2:]) AS display_name, underlying_id AS spot_contract_id,
         DATE '2022-01-03' AS data_from, underlying_id <> 5 AS is_active
    FROM (SELECT DISTINCT user_id % 5 + 1 AS underlying_id,
                 ['ALPHA','BETA','GAMMA','DELTA','OMEGA'][user_id % 5 + 1] AS root,
                 CASE WHEN user_id % 5 + 1 IN (3, 5) THEN 'BSE' ELSE 'NSE' END AS exchange
            FROM events)),
legs AS (
  SELECT contract_id, underlying_id, expiry_id, leg,
         CASE WHEN user_id < 5 THEN 'SPOT' WHEN leg // 4 = 0 AND leg % 2 = 1 THEN 'FUT' ELSE 'OPT' END AS kind,
         CASE WHEN user_id < 5 THEN NULL WHEN (leg // 2) % 2 = 0 THEN DATE '2024-01-25' ELSE DATE '2024-02-29' END AS expiry_date
    FROM (SELECT DISTINCT user_id, {IDS} FROM events)),
contracts AS (
  SELECT l.contract_id, l.underlying_id, l.expiry_id, l.kind, l.expiry_date, u.exchange, u.root, u.instrument_kind,
         CASE WHEN kind = 'OPT' THEN CAST(10 * (leg // 4) + 5 AS DECIMAL(12,4)) END AS strike,
         CASE WHEN kind = 'OPT' THEN CASE WHEN leg % 2 = 0 THEN 'CE' ELSE 'PE' END END AS option_type,
         CASE WHEN kind = 'SPOT' THEN u.fyers_symbol
              WHEN kind = 'FUT' THEN u.exchange || ':' || u.root || CASE WHEN l.expiry_date = DATE '2024-01-25' THEN '24JANFUT' ELSE '24FEBFUT' END
              WHEN l.expiry_date = DATE '2024-01-25' THEN u.exchange || ':' || u.root || '24125' || CAST(10 * (leg // 4) + 5 AS VARCHAR) || CASE WHEN leg % 2 = 0 THEN 'CE' ELSE 'PE' END
              ELSE u.exchange || ':' || u.root || '24FEB' || CAST(10 * (leg // 4) + 5 AS VARCHAR) || CASE WHEN leg % 2 = 0 THEN 'CE' ELSE 'PE' END
         END AS fyers_symbol,
         CASE WHEN kind = 'SPOT' THEN u.instrument_kind
              ELSE kind || CASE WHEN u.instrument_kind = 'INDEX' THEN 'IDX' ELSE 'STK' END END AS instrument_class,
         CASE WHEN kind <> 'SPOT' AND leg % 3 <> 0 THEN 25 * l.underlying_id END AS lot_size,
         CASE WHEN kind <> 'SPOT' AND leg % 7 = 0 THEN TIMESTAMP '2024-03-01' END AS sealed_at,
         TIMESTAMP '2024-01-01' AS first_seen_at
    FROM legs l JOIN underlyings u USING (underlying_id)),
expiries AS (
  SELECT expiry_id, underlying_id, expiry_date, count(*) AS contract_count,
         count(*) FILTER (WHERE kind = 'FUT') AS futures_count, count(*) FILTER (WHERE kind = 'OPT') AS options_count,
         CAST(10 AS DECIMAL(12,4)) AS strike_step, expiry_id * 1048576 AS contract_id_lo,
         (expiry_id + 1) * 1048576 - 1 AS contract_id_hi, 'W' AS expiry_cycle_derived,
         CASE WHEN NOT (underlying_id = 5 AND expiry_date = DATE '2024-02-29') THEN TIMESTAMP '2024-01-02' END AS contracts_discovered_at
    FROM contracts WHERE kind <> 'SPOT' GROUP BY ALL),
resolutions AS (
  SELECT * FROM (VALUES
    (1,'5S',5,'5s',30),(2,'1',60,'1m',95),(3,'2',120,'2m',95),(4,'3',180,'3m',95),(5,'5',300,'5m',95),
    (6,'10',600,'10m',95),(7,'15',900,'15m',95),(8,'20',1200,'20m',95),(9,'30',1800,'30m',95),
    (10,'45',2700,'45m',95),(11,'60',3600,'1h',95),(12,'120',7200,'2h',95),(13,'180',10800,'3h',95),
    (14,'240',14400,'4h',95),(100,'D',86400,'1d',0)) v(res_id, fyers_code, seconds, chart_interval, max_days)),
coverage AS (
  SELECT contract_id, res_id, range_from, range_to, last(status ORDER BY k) AS status,
         last(row_count ORDER BY k) AS row_count, last(payload_sha256 ORDER BY k) AS payload_sha256
    FROM (SELECT contract_id, CAST(o_orderpriority[1] AS INT) + 1 AS res_id, o_orderkey AS k,
                 CAST(o_orderdate AS DATE) + 8766 AS range_from,
                 CAST(o_orderdate AS DATE) + 8766 + CAST(o_orderkey % 90 AS INT) AS range_to,
                 CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'empty' ELSE 'error' END AS status,
                 CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 5000 ELSE 0 END AS row_count,
                 'h' || (o_orderkey % 7) AS payload_sha256
            FROM (SELECT *, {IDS} FROM (SELECT *, o_custkey // 10 AS user_id FROM orders)))
   GROUP BY contract_id, res_id, range_from, range_to),
bounds AS (
  SELECT contract_id, res_id, count(*) AS row_count, min(ts) AS first_ts, max(ts) AS last_ts
    FROM candles GROUP BY contract_id, res_id),
gaps AS (
  SELECT contract_id, res_id, range_to AS gap_after, nxt AS gap_before
    FROM (SELECT *, lead(range_from) OVER (PARTITION BY contract_id, res_id ORDER BY range_from, range_to) AS nxt
            FROM coverage)
   WHERE nxt > range_to + 1),
held AS (SELECT contract_id, res_id, range_from, range_to FROM coverage WHERE status IN ('ok', 'empty')),
islands AS (
  SELECT contract_id, res_id, min(range_from) AS range_from, max(range_to) AS range_to
    FROM (SELECT *, sum(CASE WHEN reach IS NULL OR range_from > reach + 1 THEN 1 ELSE 0 END)
                      OVER (PARTITION BY contract_id, res_id ORDER BY range_from, range_to ROWS UNBOUNDED PRECEDING) AS island
            FROM (SELECT *, max(range_to) OVER (PARTITION BY contract_id, res_id ORDER BY range_from, range_to
                                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM held))
   GROUP BY contract_id, res_id, island),
request_log AS (
  SELECT event_id AS task_id, user_id AS job_id, event_type AS kind,
         ['done','empty','failed','pending'][event_id % 4 + 1] AS state, ts AS created_at, ts AS started_at,
         CASE WHEN event_id % 4 <> 3 THEN ts + to_seconds(event_id % 600) END AS finished_at,
         CASE WHEN event_id % 4 <> 3 THEN 1 ELSE 0 END AS requests_used,
         CASE WHEN event_id % 4 = 0 THEN event_id % 1000 END AS row_count,
         CASE WHEN event_id % 4 <> 3 THEN length(props) END AS response_bytes,
         CASE event_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'no_data' ELSE 'error' END AS status,
         [200,400,401,429,500,502,507,404][event_id % 8 + 1] AS http_status,
         [0,-8,-15,-17,-50,-300,-429,400,-999][event_id % 9 + 1] AS code
    FROM events),
observed AS (
  SELECT u.exchange, CAST(k.ts AS DATE) AS trade_date, min(k.ts) AS session_open, max(k.ts) AS session_close,
         count(*) AS bar_count, count(DISTINCT k.contract_id) AS contract_count
    FROM candles k JOIN underlyings u ON u.spot_contract_id = k.contract_id GROUP BY ALL),
holidays AS (
  SELECT * FROM (VALUES ('NSE', DATE '2024-01-26'), ('BSE', DATE '2024-01-26'), ('NSE', DATE '2023-12-25'),
                        ('NSE', DATE '2024-03-08')) v(exchange, holiday_date)),
days AS (
  SELECT e.exchange, CAST(d AS DATE) AS trade_date,
         (o.trade_date IS NOT NULL) AS is_observed,
         (o.trade_date IS NOT NULL OR (isodow(d) <= 5 AND h.holiday_date IS NULL)) AS is_trading
    FROM (SELECT DISTINCT exchange FROM underlyings) e
   CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '2018-01-01', DATE '2026-12-31', INTERVAL 1 DAY)) AS DATE) AS d) g
    LEFT JOIN observed o ON o.exchange = e.exchange AND o.trade_date = g.d
    LEFT JOIN holidays h ON h.exchange = e.exchange AND h.holiday_date = g.d),
members AS (
  SELECT 'N' || n_nationkey AS fytoken, 'NSE:' || n_name || '-INDEX' AS symbol_ticker, 10 AS segment_code,
         n_name AS under_symbol, 'N' || n_nationkey AS under_fytoken, NULL AS option_type, NULL AS strike_price,
         1 AS lot1, 1 AS lot2, 'INDEX' AS symbol_details, 0.0 AS bal, true AS in1, true AS in2, 10 AS ex_type, NULL::DATE AS expiry_date
    FROM nation
  UNION ALL
  SELECT 'C' || c_custkey,
         'NSE:' || CASE WHEN c_nationkey = 7 THEN '7' ELSE '' END || 'NATION_' || c_nationkey || '24JAN' || (c_custkey + 1)
           || CASE WHEN c_acctbal >= 4000 THEN 'CE' ELSE 'PE' END, 11,
         CASE WHEN c_nationkey = 7 THEN '7' ELSE '' END || 'NATION_' || c_nationkey,
         CASE WHEN c_nationkey >= 23 THEN 'X' ELSE 'N' END || c_nationkey,
         CASE WHEN c_acctbal >= 4000 THEN 'CE' ELSE 'PE' END, c_custkey + 1, c_nationkey + 1,
         c_nationkey + 1 + CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END, c_name, c_acctbal,
         c_acctbal < 8500, c_acctbal >= 0, 14, DATE '2024-01-25'
    FROM customer),
history AS (
  SELECT *, lot1 AS min_lot_size, DATE '2024-01-10' AS valid_from,
         CASE WHEN NOT in2 OR lot1 <> lot2 THEN DATE '2024-01-20' END AS valid_to FROM members WHERE in1
  UNION ALL
  SELECT *, lot2, DATE '2024-01-20', NULL FROM members WHERE in2 AND (NOT in1 OR lot1 <> lot2))
"""


def q(body: str) -> str:
    """A query over the domain tables."""
    return f"WITH {BASE}\n{body}"


def qq(ctes: str, body: str) -> str:
    """A query over the domain tables and further ones."""
    return f"WITH {BASE},\n{ctes}\n{body}"
