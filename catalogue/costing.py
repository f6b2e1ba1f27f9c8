"""The backfill plan: windows, chunks, subtraction, estimates and what follows a chunk."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.base import Tables, query
from catalogue.sql import B, S, q, qq
from tickloom.functions import clock
from tickloom.operators import aggregates, calendar, coverage, intervals
from tickloom.plans import backfill

NOW = "2024-01-28 10:00:00"
SHEET = backfill.Sheet(now=NOW, resolutions=("1", "5", "15", "5S"))


def islands(source: str, name: str) -> str:
    """Merged ranges of a ledger subset."""
    return f"""{name} AS (SELECT contract_id, res_id, min(range_from) AS f, max(range_to) AS e FROM (
      SELECT *, sum(CASE WHEN reach IS NULL OR range_from > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY contract_id, res_id ORDER BY range_from, range_to ROWS UNBOUNDED PRECEDING) AS g
        FROM (SELECT *, max(range_to) OVER (PARTITION BY contract_id, res_id ORDER BY range_from, range_to ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
                FROM coverage WHERE {source})) GROUP BY contract_id, res_id, g)"""


PLAN = f"""sw AS (SELECT exchange, min(trade_date) AS wf, max(trade_date) AS wt FROM (SELECT *, row_number() OVER (PARTITION BY exchange ORDER BY trade_date DESC) AS r
    FROM days WHERE is_trading AND trade_date <= DATE '2024-01-28') WHERE r <= 30 GROUP BY exchange),
res4 AS (SELECT res_id, fyers_code, seconds, CASE WHEN seconds < 60 THEN 30 ELSE 100 END AS n FROM resolutions WHERE fyers_code IN ('1', '5', '15', '5S')),
win0 AS (SELECT c.contract_id, c.underlying_id, c.exchange, c.kind, c.sealed_at, r.*,
    greatest(c.expiry_date - CASE WHEN kind = 'FUT' THEN 120 ELSE 200 END, DATE '2022-01-03', CASE c.exchange WHEN 'BSE' THEN DATE '2023-08-07' ELSE DATE '2022-01-03' END,
             CASE WHEN seconds < 60 THEN wf ELSE DATE '1900-01-01' END) AS rf,
    CASE WHEN c.expiry_date < DATE '2024-01-28' THEN c.expiry_date ELSE least(c.expiry_date, CAST(TIMESTAMP '{NOW}' - to_seconds(seconds) AS DATE)) END AS rt
    FROM contracts c JOIN sw USING (exchange) CROSS JOIN res4 r WHERE kind <> 'SPOT' AND (seconds >= 60 OR c.expiry_date BETWEEN wf AND wt)),
win AS (SELECT * FROM win0 WHERE rt >= rf),
live AS (SELECT * FROM win WHERE sealed_at IS NULL),
chunk AS (SELECT *, rt - o * n AS ct, greatest(rf, rt - o * n - n + 1) AS cf FROM (SELECT *, unnest(range(0, (rt - rf) // n + 1))::INT AS o FROM live)),
{islands("status IN ('ok', 'empty')", "hi")},
{islands("status = 'empty' AND row_count = 0", "di")},
cls AS (SELECT c.*, CASE WHEN EXISTS (SELECT 1 FROM di WHERE di.contract_id = c.contract_id AND di.res_id = c.res_id AND di.f <= cf AND di.e >= ct) THEN 'dead'
                         WHEN EXISTS (SELECT 1 FROM hi WHERE hi.contract_id = c.contract_id AND hi.res_id = c.res_id AND hi.f <= cf AND hi.e >= ct) THEN 'held' ELSE 'missing' END AS state FROM chunk c),
edge AS (SELECT contract_id, res_id, coalesce(min(CASE WHEN state = 'dead' THEN o END), 99999) AS d, coalesce(min(CASE WHEN state = 'missing' THEN o END), 99999) AS m FROM cls GROUP BY ALL),
walk AS (SELECT c.*, CASE WHEN state = 'missing' THEN 'emit' ELSE 'skip' END AS outcome FROM cls c JOIN edge USING (contract_id, res_id) WHERE o <= least(d, m)),
walk_all AS (SELECT c.*, CASE WHEN state = 'missing' THEN 'emit' ELSE 'skip' END AS outcome FROM cls c JOIN edge USING (contract_id, res_id) WHERE o <= d),
typ AS (SELECT c.underlying_id, v.res_id, CAST(round_even(median(row_count), 0) AS BIGINT) AS typical FROM coverage v JOIN contracts c USING (contract_id) WHERE status = 'ok' AND row_count > 0 GROUP BY ALL),
ses AS (SELECT exchange, max(date_diff('second', date_trunc('second', session_open), date_trunc('second', session_close))) AS ss FROM observed WHERE session_close > session_open GROUP BY exchange),
est AS (SELECT w.*, typical IS NULL AS nominal, coalesce(typical, (SELECT count(*) FROM days d WHERE d.exchange = w.exchange AND is_trading AND trade_date BETWEEN cf AND ct)
          * greatest(ceil(coalesce(ss, 23100) / w.seconds), 1)) AS rows_est FROM walk w LEFT JOIN typ USING (underlying_id, res_id) LEFT JOIN ses USING (exchange)),
und AS (SELECT e.underlying_id, e.expiry_date, coalesce(s.l[len(s.l) // 2 + 1], 0) * 4 AS downstream FROM expiries e
  LEFT JOIN (SELECT underlying_id, list(contract_count ORDER BY contract_count) AS l FROM expiries WHERE contracts_discovered_at IS NOT NULL GROUP BY underlying_id) s USING (underlying_id)
  WHERE contracts_discovered_at IS NULL)"""

CHUNK_SQL = f"{B('contract_id')}, {B('res_id')}, {B('o', 'ordinal')}, {S('cf', 'chunk_from')}, {S('ct', 'chunk_to')}"
CHUNK = ["contract_id", "res_id", "ordinal", "chunk_from", "chunk_to"]


def live_windows(t: Tables):
    live, _ = backfill.split_sealed(backfill.scope_contracts(t.contracts))
    own = live.drop("exchange")
    return backfill.contract_windows(own, t.underlyings, calendar.seconds_window(t.days, SHEET.today), SHEET)


def walked(t: Tables, probe: bool = True):
    chunks = backfill.candidate_chunks(live_windows(t))
    return backfill.subtract_coverage(backfill.classify_chunks(chunks, t.coverage), probe)


def estimated(t: Tables):
    return backfill.estimate_rows(
        walked(t), aggregates.typical_rows(t.coverage, t.contracts), t.days, aggregates.longest_session(t.observed_days)
    )


@query("k1_contract_windows", qq(PLAN, f"SELECT {B('contract_id')}, {B('res_id')}, {S('rf', 'range_from')}, {S('rt', 'range_to')} FROM live"))
def k1(t: Tables):
    return live_windows(t).select("contract_id", "res_id", "range_from", "range_to")


@query("k2_candidate_chunks", qq(PLAN, f"SELECT {CHUNK_SQL} FROM chunk"))
def k2(t: Tables):
    return backfill.candidate_chunks(live_windows(t)).select(*CHUNK)


@query("k3_coverage_subtraction", qq(PLAN, f"SELECT {CHUNK_SQL}, state, outcome FROM walk"))
def k3(t: Tables):
    return walked(t).select(*CHUNK, "state", "outcome")


@query("k3_without_probing", qq(PLAN, f"SELECT {CHUNK_SQL}, state, outcome FROM walk_all"))
def k3_all(t: Tables):
    return walked(t, probe=False).select(*CHUNK, "state", "outcome")


@query("k4_sealed_skipped", q(f"SELECT {B('underlying_id')}, {B('count(*)', 'sealed')} FROM contracts WHERE kind <> 'SPOT' AND sealed_at IS NOT NULL GROUP BY underlying_id"))
def k4(t: Tables):
    _, sealed = backfill.split_sealed(backfill.scope_contracts(t.contracts))
    return sealed.groupBy("underlying_id").agg(F.count("*").alias("sealed"))


SPOT_PLAN = f"""{PLAN}, span AS (SELECT underlying_id, min(expiry_date) AS a, max(expiry_date) AS b FROM expiries GROUP BY underlying_id),
sp0 AS (SELECT u.spot_contract_id AS contract_id, r.*, greatest(DATE '2022-06-01', DATE '2022-01-03', CASE u.exchange WHEN 'BSE' THEN DATE '2023-08-07' ELSE DATE '2022-01-03' END, CASE WHEN seconds < 60 THEN wf ELSE DATE '1900-01-01' END) AS rf,
    CASE WHEN seconds < 60 THEN least(b, wt) ELSE b END AS e0 FROM underlyings u JOIN span USING (underlying_id) JOIN sw USING (exchange) CROSS JOIN res4 r),
sp AS (SELECT *, CASE WHEN e0 < DATE '2024-01-28' THEN e0 ELSE least(e0, CAST(TIMESTAMP '{NOW}' - to_seconds(seconds) AS DATE)) END AS rt FROM sp0),
spc AS (SELECT *, rt - o * n AS ct, greatest(rf, rt - o * n - n + 1) AS cf FROM (SELECT *, unnest(range(0, (rt - rf) // n + 1))::INT AS o FROM sp WHERE rt >= rf))"""


@query(
    "k5_spot_chunks",
    qq(SPOT_PLAN, f"""SELECT {CHUNK_SQL}, CASE WHEN EXISTS (SELECT 1 FROM hi WHERE hi.contract_id = c.contract_id AND hi.res_id = c.res_id AND hi.f <= cf AND hi.e >= ct) THEN 'skip' ELSE 'emit' END AS outcome FROM spc c"""),
)
def k5(t: Tables):
    sheet = backfill.Sheet(now=NOW, resolutions=SHEET.resolutions, range_from="2022-06-01")
    windows = backfill.spot_windows(t.underlyings, t.expiries, calendar.seconds_window(t.days, sheet.today), sheet)
    chunks = backfill.classify_chunks(backfill.candidate_chunks(windows), t.coverage)
    return backfill.subtract_spot_coverage(chunks).select(*CHUNK, "outcome")


def wanted_expiries(t: Tables):
    """All catalogued expiries and one month the catalog does not know."""
    known = t.expiries.select("underlying_id", "expiry_date")
    return known.unionByName(t.underlyings.select("underlying_id", clock.day("2024-03-28").alias("expiry_date")))


@query("k6_discovery_tasks", qq(PLAN, f"SELECT {B('underlying_id')}, {S('expiry_date')}, {B('downstream')} FROM und"))
def k6(t: Tables):
    siblings = aggregates.sibling_contract_count(t.expiries)
    return backfill.discovery_tasks(wanted_expiries(t), t.expiries, siblings, len(SHEET.resolutions))[0]


@query("k6_unknown_expiries", q(f"SELECT {B('underlying_id')}, '2024-03-28' AS expiry_date FROM underlyings"))
def k6u(t: Tables):
    siblings = aggregates.sibling_contract_count(t.expiries)
    return backfill.discovery_tasks(wanted_expiries(t), t.expiries, siblings, 4)[1]


@query("k6_refused_underlyings", q(f"SELECT {B('underlying_id')}, {B('count(*)', 'discovery_tasks')} FROM expiries GROUP BY underlying_id HAVING count(CASE WHEN underlying_id % 2 = 1 THEN contracts_discovered_at END) = 0"))
def k6r(t: Tables):
    half = F.when(F.col("underlying_id") % 2 == 1, F.col("contracts_discovered_at"))
    known = t.expiries.withColumn("contracts_discovered_at", half)
    return backfill.refused_underlyings(known.select("underlying_id", "expiry_date"), known)


@query("k7_row_estimate", qq(PLAN, f"SELECT {CHUNK_SQL}, outcome, {B('CAST(nominal AS INT)', 'is_nominal')}, {B('rows_est', 'rows_estimated')} FROM est"))
def k7(t: Tables):
    return estimated(t).select(*CHUNK, "outcome", "is_nominal", "rows_estimated")


# Every held chunk as a fetch result: its first bar comes some days after its left edge.
AFTER = """done AS (SELECT v.*, c.exchange, greatest(DATE '2022-01-03', CASE c.exchange WHEN 'BSE' THEN DATE '2023-08-07' ELSE DATE '2022-01-03' END,
    coalesce(c.expiry_date - CASE WHEN c.kind = 'FUT' THEN 120 ELSE 200 END, DATE '1900-01-01')) AS floor, range_from + CAST(row_count % 4 AS INT) AS first_day
    FROM coverage v JOIN contracts c USING (contract_id) WHERE status IN ('ok', 'empty')),
exp AS (SELECT d.*, (SELECT min(trade_date) FROM days t WHERE t.exchange = d.exchange AND t.is_trading AND t.trade_date >= d.range_from) AS expected FROM done d),
dec AS (SELECT *, CASE WHEN status = 'empty' THEN 'no_data' WHEN first_day > expected THEN 'life_inside_chunk' END AS reason, CAST(least(range_to - range_from + 1, 100) AS INT) AS span FROM exp),
stp AS (SELECT contract_id, res_id, range_from, range_to, floor, span, k, range_from - 1 - k * span AS ot FROM (SELECT *, unnest(range(0, greatest(range_from - floor, 0) + 1))::INT AS k FROM dec WHERE reason IS NULL)),
old AS (SELECT *, greatest(floor, ot - span + 1) AS of_ FROM stp WHERE ot >= floor),
isl AS (SELECT *, coalesce(range_from > max(range_to) OVER (PARTITION BY contract_id, res_id ORDER BY range_from, range_to ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, true) AS fresh FROM held),
mrg AS (SELECT contract_id, res_id, min(range_from) AS range_from, max(range_to) AS range_to FROM (SELECT *, sum(fresh::INT) OVER (PARTITION BY contract_id, res_id ORDER BY range_from, range_to ROWS UNBOUNDED PRECEDING) AS g FROM isl) GROUP BY contract_id, res_id, g),
free AS (SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM mrg h WHERE h.contract_id = o.contract_id AND h.res_id = o.res_id AND h.range_from <= of_ AND h.range_to >= ot)),
pick AS (SELECT * FROM free QUALIFY row_number() OVER (PARTITION BY contract_id, res_id, range_from, range_to ORDER BY free.k) = 1)"""


def after(t: Tables):
    c = t.contracts.select("contract_id", "exchange", "kind", "expiry_date")
    done = intervals.held(t.coverage).join(c, "contract_id")
    results = done.select(
        "contract_id", "res_id", "exchange", "range_from", "range_to", "status",
        clock.midnight(F.date_add("range_from", (F.col("row_count") % 4).cast("int"))).alias("first_ts"),
    )
    life = F.when(F.col("kind") == "FUT", 120).otherwise(200)
    floors = c.select(
        "contract_id",
        F.greatest(clock.day("2022-01-03"), calendar.exchange_floor(F.col("exchange")), F.date_sub("expiry_date", life)).alias("floor"),
    )
    return backfill.after_chunk(results, floors, t.days, t.coverage)


@query(
    "k8_after_chunk",
    qq(AFTER, f"""SELECT {B('d.contract_id', 'contract_id')}, {B('d.res_id', 'res_id')}, {S('d.range_from', 'range_from')}, {S('d.range_to', 'range_to')},
      CASE WHEN p.k IS NOT NULL THEN 'older_chunk' ELSE 'seal' END AS action, CASE WHEN p.k IS NULL THEN coalesce(d.reason, 'floor_reached') END AS reason, {S('p.of_', 'next_from')}, {S('p.ot', 'next_to')}
      FROM dec d LEFT JOIN pick p ON p.contract_id = d.contract_id AND p.res_id = d.res_id AND p.range_from = d.range_from AND p.range_to = d.range_to"""),
)
def k8(t: Tables):
    return after(t)


@query(
    "k8_seal_if_idle",
    qq(AFTER, f"""SELECT {B('contract_id')} FROM (SELECT d.contract_id, bool_and(p.k IS NULL) AS s FROM dec d LEFT JOIN pick p ON p.contract_id = d.contract_id AND p.res_id = d.res_id AND p.range_from = d.range_from AND p.range_to = d.range_to
      GROUP BY d.contract_id) WHERE s AND contract_id NOT IN (SELECT contract_id FROM coverage WHERE status = 'error')"""),
)
def k8_seal(t: Tables):
    return backfill.seal_if_idle(after(t), t.coverage.where("status = 'error'"))


@query(
    "k8_older_tasks_to_skip",
    q(f"""SELECT {B('p.contract_id', 'contract_id')}, {B('p.res_id', 'res_id')}, {S('p.range_from', 'range_from')} FROM coverage p
      JOIN (SELECT contract_id, res_id, max(range_from) AS edge FROM coverage WHERE status = 'empty' GROUP BY ALL) e USING (contract_id, res_id) WHERE p.status = 'error' AND p.range_to < edge"""),
)
def k8_skip(t: Tables):
    job = F.lit("j").alias("job_id")
    decisions = t.coverage.where("status = 'empty'").select(job, "contract_id", "res_id", "range_from", F.lit("no_data").alias("reason"))
    pending = t.coverage.where("status = 'error'").select(job, "contract_id", "res_id", "range_from", "range_to")
    return backfill.older_tasks_to_skip(decisions, pending).select("contract_id", "res_id", "range_from")


PRICE = f"""{SPOT_PLAN}, spw AS (SELECT c.*, s.exchange, s.underlying_id, EXISTS (SELECT 1 FROM hi WHERE hi.contract_id = c.contract_id AND hi.res_id = c.res_id AND hi.f <= cf AND hi.e >= ct) AS have FROM spc c JOIN underlyings s ON s.spot_contract_id = c.contract_id),
spe AS (SELECT w.*, typical IS NULL AS nominal, coalesce(typical, (SELECT count(*) FROM days d WHERE d.exchange = w.exchange AND is_trading AND trade_date BETWEEN cf AND ct)
          * greatest(ceil(coalesce(ss, 23100) / w.seconds), 1)) AS rows_est FROM spw w LEFT JOIN typ USING (underlying_id, res_id) LEFT JOIN ses USING (exchange)),
tot AS (SELECT (SELECT count(*) FROM est WHERE outcome = 'emit') + (SELECT count(*) FROM und) + (SELECT count(*) FROM spe WHERE NOT have) AS tasks,
  (SELECT count(*) FROM spe WHERE NOT have) AS spots, (SELECT count(*) FROM contracts WHERE kind <> 'SPOT' AND sealed_at IS NULL) AS live_n, (SELECT count(*) FROM expiries) AS exp_n, (SELECT coalesce(sum(downstream), 0) FROM und) AS down,
  (SELECT count(*) FROM est WHERE outcome = 'skip') + (SELECT count(*) FROM spe WHERE have) AS skipped, (SELECT count(*) FROM contracts WHERE kind <> 'SPOT' AND sealed_at IS NOT NULL) AS sealed,
  (SELECT count(*) FROM und) AS disc, (SELECT coalesce(sum(rows_est), 0) FROM est WHERE outcome = 'emit') + (SELECT coalesce(sum(rows_est), 0) FROM spe WHERE NOT have) AS rws,
  (SELECT count(*) FROM est WHERE outcome = 'emit' AND nominal) + (SELECT count(*) FROM spe WHERE NOT have AND nominal) AS nom)"""


@query(
    "k9_plan_price",
    qq(PRICE, f"""SELECT {B('tasks', 'tasks_total')}, {B('tasks + down', 'requests_estimated')}, {B('skipped', 'chunks_skipped_covered')}, {B('sealed', 'contracts_sealed_skipped')}, {B('live_n', 'contracts_planned')}, {B('exp_n', 'expiries_planned')}, {B('spots', 'spot_tasks')}, 'seconds_capture' AS job_kind, {B('disc', 'discovery_tasks')},
      {B('down', 'estimated_downstream_requests')}, {B('rws', 'rows_estimated')}, {B('round_even(rws * 15.21::DOUBLE, 0)', 'bytes_estimated')}, {B('ceil((tasks + down) * 60 / 170)', 'eta_seconds')},
      {B('700', 'budget_remaining')}, {B('400', 'budget_allowance')}, {B('700 - (tasks + down)', 'budget_after')}, {B('CAST(tasks + down > 400 AS INT)', 'exceeds_budget')},
      concat_ws(',', CASE WHEN nom > 0 THEN 'rows_estimated_is_nominal' END, CASE WHEN disc > 0 THEN 'contracts_not_discovered' END, CASE WHEN tasks + down > 400 THEN 'exceeds_budget' END) AS warnings FROM tot"""),
)
def k9(t: Tables):
    scoped = backfill.scope_contracts(t.contracts)
    siblings = aggregates.sibling_contract_count(t.expiries)
    discovery, _ = backfill.discovery_tasks(wanted_expiries(t), t.expiries, siblings, len(SHEET.resolutions))
    sheet = backfill.Sheet(now=NOW, resolutions=SHEET.resolutions, sweep=True)
    spot_sheet = backfill.Sheet(now=NOW, resolutions=SHEET.resolutions, range_from="2022-06-01")
    spot = backfill.plan_spot(
        t.underlyings, t.expiries, t.coverage, t.days, aggregates.typical_rows(t.coverage, t.contracts),
        aggregates.longest_session(t.observed_days), spot_sheet,
    )
    return backfill.price(estimated(t), discovery, scoped, sheet, spot=spot, used_today=300, daily_budget=1000)


@query(
    "k10_repair_windows",
    qq(PLAN, f"""SELECT {B('l.contract_id', 'contract_id')}, {B('res_id')}, {S('rf', 'range_from')}, {S('rt', 'range_to')} FROM live l JOIN contracts c USING (contract_id) WHERE (c.underlying_id, c.expiry_date) IN (
      SELECT (underlying_id, expiry_date) FROM (SELECT *, row_number() OVER (PARTITION BY underlying_id ORDER BY expiry_date DESC) AS r FROM (
        SELECT underlying_id, expiry_date FROM coverage JOIN contracts USING (contract_id) WHERE status = 'error' AND expiry_date IS NOT NULL
        UNION SELECT underlying_id, expiry_date FROM gaps JOIN contracts USING (contract_id) WHERE expiry_date IS NOT NULL)) WHERE r <= 1)"""),
)
def k10(t: Tables):
    repair = coverage.expiries_with_holes(t.coverage, t.contracts, newest=1)
    scoped = live_windows(t).join(repair, ["underlying_id", "expiry_date"], "left_semi")
    return scoped.select("contract_id", "res_id", "range_from", "range_to")


DISC = """asked AS (SELECT o_orderkey AS request_id, ['NSE','BSE','MCX','XSE'][o_orderkey % 4 + 1] AS exchange, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) + 8766 END AS a,
   CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) + 8766 + CAST(o_custkey AS INT) END AS b FROM orders),
rng AS (SELECT *, coalesce(a, DATE '2024-02-10' - 365) AS f, least(coalesce(b, DATE '2024-02-10'), DATE '2024-02-09') AS e FROM asked),
jud AS (SELECT *, CASE WHEN exchange = 'XSE' THEN 'unknown_exchange' WHEN exchange = 'MCX' THEN 'exchange_not_served'
   WHEN f < CASE exchange WHEN 'BSE' THEN DATE '2023-08-07' ELSE DATE '2022-01-03' END THEN 'range_before_floor' WHEN e < f THEN 'range_after_last_served' END AS reason FROM rng)"""


def discovery(t: Tables):
    k = F.col("o_orderkey")
    given = k % 7 != 0
    start = F.date_add(F.to_date("o_orderdate"), 8766)
    asks = t.given("orders").select(
        k.alias("request_id"),
        F.element_at(F.array(*[F.lit(x) for x in ("NSE", "BSE", "MCX", "XSE")]), (k % 4 + 1).cast("int")).alias("exchange"),
        F.when(given, start).alias("range_from"), F.when(given, F.date_add(start, F.col("o_custkey").cast("int"))).alias("range_to"),
    )
    return backfill.discovery_windows(asks, "2024-02-10")


@query(
    "k11_discovery_windows",
    qq(DISC, f"""SELECT {B('request_id')}, exchange, {B('o', 'ordinal')}, {S('greatest(f, e - o * 366 - 365)', 'chunk_from')}, {S('e - o * 366', 'chunk_to')}
      FROM (SELECT *, unnest(range(0, (e - f) // 366 + 1))::INT AS o FROM jud WHERE reason IS NULL)"""),
)
def k11(t: Tables):
    return discovery(t)[0]


@query("k11_discovery_refusals", qq(DISC, f"SELECT {B('request_id')}, exchange, reason FROM jud WHERE reason IS NOT NULL"))
def k11r(t: Tables):
    return discovery(t)[1]

