from __future__ import annotations

import json
from datetime import date, datetime, timedelta

import pytest

from pyspark.sql import functions as F

from tickloom import schemas, session
from tickloom.operators import aggregates, asof, bars, writes
from tickloom.sinks import export, store
from tickloom.streaming import ingest

COLUMNS = ["timestamp", "open", "high", "low", "close", "volume"]


def bar_rows(contract, d, n, price=10.0):
    start = int((datetime(d.year, d.month, d.day, 9, 15) - datetime(1970, 1, 1)).total_seconds()) - 19800
    return [[start + 60 * i, price, price + 1, price - 1, price, i] for i in range(n)]


def landed(contract, d, n, at, price=10.0):
    payload = json.dumps({"s": "ok" if n else "no_data", "columns": COLUMNS, "candles": bar_rows(contract, d, n, price)})
    return (contract, 2, d, d, at, payload)


def tables(spark, root):
    t = ingest.tables(spark, root)
    bars = sorted((r.contract_id, r.ts, float(r.close)) for r in t["candles"].collect())
    ledger = sorted((r.contract_id, r.range_from, r.status, r.row_count) for r in t["coverage"].collect())
    bounds = sorted((r.contract_id, r.row_count) for r in t["bounds"].collect())
    return bars, ledger, bounds


def test_batches_replace_shrink_and_survive_a_replay(spark):
    root = session.fresh_path(spark, "tables")
    d, later = date(2024, 1, 31), date(2024, 2, 1)
    t1, t2 = datetime(2024, 3, 1), datetime(2024, 3, 2)

    def batch(*rows):
        return spark.createDataFrame(list(rows), ingest.LANDED)

    first = batch(landed(5, d, 4, t1), landed(5, later, 3, t1), landed(2000, d, 2, t1), landed(5, d, 9, datetime(2024, 2, 1)))
    ingest.apply_batch(spark, root, first, "000")
    bars, ledger, bounds = tables(spark, root)
    assert len(bars) == 9 and bounds == [(5, 7), (2000, 2)]
    assert ledger == [(5, d, "ok", 4), (5, later, "ok", 3), (2000, d, "ok", 2)]

    # The same batch again, and the same answers under another batch, change nothing.
    ingest.apply_batch(spark, root, first, "000")
    ingest.apply_batch(spark, root, batch(landed(5, d, 4, t2)), "001")
    assert tables(spark, root) == (bars, ledger, bounds)

    # A shorter answer removes bars; an empty one empties a folder and drops the bounds row.
    second = batch(landed(5, d, 1, t2, 20.0), landed(2000, d, 0, t2))
    ingest.apply_batch(spark, root, second, "002")
    shrunk = tables(spark, root)
    assert [b[2] for b in shrunk[0]] == [20.0, 10.0, 10.0, 10.0] and shrunk[2] == [(5, 4)]
    assert (2000, d, "empty", 0) in shrunk[1]

    # A crash before the batch became visible: no table shows any of it, and the replay repairs all.
    store.remove(spark, f"{root}/versions/batch=002")
    store.remove(spark, f"{root}/coverage/batch=002")
    assert tables(spark, root) == (bars, ledger, bounds)
    ingest.apply_batch(spark, root, second, "002")
    assert tables(spark, root) == shrunk

    # Snapshots that were replaced are left behind in a compacted root, which the stream may go on with.
    compacted = session.fresh_path(spark, "compacted")
    ingest.compact(spark, root, compacted)
    assert tables(spark, compacted) == shrunk
    ingest.apply_batch(spark, compacted, batch(landed(5, d, 2, datetime(2024, 3, 3))), "003")
    assert [c for c, _ in tables(spark, compacted)[2]] == [5] and tables(spark, compacted)[2] == [(5, 5)]


def test_a_batch_reads_only_the_folders_it_touches(spark):
    root = session.fresh_path(spark, "tables")
    months = [date(2024, m, 3) for m in range(1, 7)]
    at = datetime(2024, 9, 1)
    ingest.apply_batch(spark, root, spark.createDataFrame([landed(5, d, 3, at) for d in months], ingest.LANDED), "0")
    table = ingest._table(spark, root, "candles")
    touched = store.touched_folders(spark.createDataFrame([(5, 2, months[2], months[2])], "contract_id int, res_id int, range_from date, range_to date"))
    partials = aggregates.bounds(table, *store.FOLDERS)
    fresh = writes.refresh_bounds(partials, table, touched)
    assert sorted(map(tuple, aggregates.combined_bounds(fresh).collect())) == sorted(map(tuple, aggregates.bounds(table).collect()))
    written = spark.read.schema(store.BARS_ON_DISK).parquet(f"{root}/candles").select("*", "_metadata.file_path")
    files = store.inside(written, touched, store.FOLDERS).select(F.col("file_path").alias("f")).distinct().collect()
    assert len(files) == 1 and "trade_month=2024-03" in files[0].f
    assert "dynamicpruning" in plan_of(store.inside(table, touched, store.FOLDERS)).lower()


def test_writes_count_their_rows_and_keep_field_metadata(spark):
    candles = some_candles(spark, 3, 50)
    for spec in (export.Spec(denormalise=False), export.Spec(format="csv", denormalise=False)):
        rows = export.raw(candles, candles.select("contract_id").distinct())
        assert export.write_single(rows, session.fresh_path(spark, "counted"), spec) == 150
    described = json.loads(export.sidecar(rows, spec, "e", "2024-01-01", spark.range(1).select(F.lit(150).alias("row_count"))).first().description)
    fields = {f["name"]: f for f in described["schema"]["fields"]}
    assert fields["ts_ist"]["metadata"]["offset_seconds"] == 19800 and "ts" not in fields
    assert described["spec"]["format"] == "csv"


def test_a_refused_envelope_is_kept_aside(spark):
    root = session.fresh_path(spark, "tables")
    bad = (5, 2, date(2024, 1, 1), date(2024, 1, 1), datetime(2024, 1, 2), json.dumps({"s": "ok", "columns": ["open"], "candles": [[1]]}))
    good = landed(6, date(2024, 1, 1), 2, datetime(2024, 1, 2))
    ingest.apply_batch(spark, root, spark.createDataFrame([bad, good], ingest.LANDED), "0")
    assert [b[0] for b in tables(spark, root)[0]] == [6, 6]
    assert spark.read.parquet(f"{root}/quarantine").select("reason").first().reason == "column_missing"


def some_candles(spark, contracts=6, n=200):
    return (
        spark.range(contracts * n)
        .selectExpr(
            f"CAST(id % {contracts} + 1 AS INT) AS contract_id", "CAST(2 AS SMALLINT) AS res_id",
            "timestampadd(MINUTE, CAST(id AS INT), timestamp_ntz'2024-01-31 00:00:00') AS ts",
        )
        .select("*", *[F.lit("1.2345").cast("decimal(11,4)").alias(c) for c in ("open", "high", "low", "close")])
        .selectExpr("*", "1L AS volume", "CAST(NULL AS BIGINT) AS oi")
    )


def test_chunk_replace_equals_itself_twice(spark):
    candles = some_candles(spark)
    chunks = spark.createDataFrame([(1, 2, date(2024, 1, 31), date(2024, 1, 31)), (1, 2, date(2024, 1, 30), date(2024, 2, 1))], "contract_id int, res_id smallint, range_from date, range_to date")
    bars = candles.where("contract_id = 1").limit(7)
    once = writes.replace_chunks(candles, chunks, bars)
    twice = writes.replace_chunks(once, chunks, bars)
    assert sorted(map(tuple, once.select("contract_id", "ts").collect())) == sorted(map(tuple, twice.select("contract_id", "ts").collect()))
    assert once.where("contract_id = 1").count() == 7


def test_the_clustered_table_prunes_and_is_ordered(spark):
    path = session.fresh_path(spark, "candles")
    store.write(some_candles(spark, 40, 100), path, 8)
    table = store.read(spark, path)
    assert store.out_of_order(table).count() == 0 and table.count() == 4000
    plan = table.where("id_block = 2 AND trade_month = '2024-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(id_block" in plan


def test_bars_of_touched_folders_are_pruned_at_run_time(spark):
    path = session.fresh_path(spark, "candles")
    store.write(some_candles(spark, 40, 100), path, 8)
    touched = spark.createDataFrame([(2, "2024-01")], "id_block int, trade_month string")
    plan = store.inside(store.read(spark, path), touched, store.FOLDERS)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


@pytest.mark.parametrize(
    "spec",
    [
        dict(format="orc"), dict(layout="tree"), dict(compression="lz77"), dict(layout="hive", format="csv"),
        dict(layout="hive", denormalise=False),
    ],
)
def test_impossible_exports_are_refused(spec):
    with pytest.raises(ValueError):
        export.Spec(**spec).validate()


def test_csv_keeps_decimals_and_whole_seconds(spark):
    path = session.fresh_path(spark, "csv")
    spec = export.Spec(format="csv", denormalise=False)
    candles = some_candles(spark, 2, 5)
    export.write_single(export.raw(candles, candles.select("contract_id").distinct()), path, spec)
    text = spark.read.text(path).collect()
    assert sum(r.value.startswith("contract_id,") for r in text) >= 1
    assert any(r.value.startswith("1,2,2024-01-31 00:00:00,1706639400,1.2345,") for r in text)


def test_row_groups_follow_the_layout(spark, tmp_path):
    import pyarrow.parquet as pq

    spec = export.Spec(denormalise=False)
    candles = some_candles(spark, 1, 300_000).coalesce(1)
    out = export.raw(candles, candles.select("contract_id").distinct()).drop("ts").coalesce(1)
    path = str(tmp_path / "rg")
    export._writer(out, spec).parquet(path)
    file = next((tmp_path / "rg").glob("part-*.parquet"))
    meta = pq.ParquetFile(file).metadata
    assert meta.num_rows == 300_000
    assert max(meta.row_group(i).num_rows for i in range(meta.num_row_groups)) <= export.QUERY_ROW_GROUP


def test_a_small_result_crosses_to_arrow_with_decimals(spark):
    table = export.to_arrow(some_candles(spark, 1, 3))
    assert str(table.schema.field("open").type) == "decimal128(11, 4)" and table.num_rows == 3


def test_unset_ledger_tables_start_empty(spark):
    t = ingest.tables(spark, session.fresh_path(spark, "nothing"))
    assert all(df.count() == 0 for df in t.values()) and t["candles"].columns == schemas.CANDLE_COLUMNS


def test_two_files_of_a_day_keep_the_later_answer(spark):
    root, landing = session.fresh_path(spark, "tables"), session.fresh_path(spark, "landing")
    d = date(2024, 1, 3)
    for i, n in enumerate((3, 5)):
        row = landed(9, d, n, datetime(2024, 2, 1) + timedelta(days=i))
        spark.createDataFrame([row], ingest.LANDED).write.mode("append").parquet(landing)
    ingest.start(spark, landing, root, files_per_batch=1, available_now=True).awaitTermination()
    assert len(tables(spark, root)[0]) == 5


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_reads_of_the_stored_table_skip_folders(spark):
    path = session.fresh_path(spark, "candles")
    store.write(some_candles(spark, 40, 100), path, 8)
    table = store.read(spark, path, 8)
    one = bars.window(table, 17, 2, "2024-01-31 00:00:00", "2024-02-02 00:00:00")
    found = plan_of(one).split("PartitionFilters: [")[1].split("]")[0]
    assert "id_block" in found and "= 2)" in found and "trade_month" in found
    want = bars.window(some_candles(spark, 40, 100), 17, 2, "2024-01-31 00:00:00", "2024-02-02 00:00:00")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, want.collect())) != []

    asked = spark.createDataFrame(
        [(1, 17, 2, datetime(2024, 1, 31), datetime(2024, 2, 2))],
        "request_id int, contract_id int, res_id smallint, start_ts timestamp_ntz, end_ts timestamp_ntz",
    )
    many = bars.windows(table, asked)
    assert "dynamicpruning" in plan_of(many).lower() and set(many.columns) & set(store.FOLDERS) == set()
    owners = spark.createDataFrame([(1, 3, "NSE")], "underlying_id int, spot_contract_id int, exchange string")
    for df in (asof.spot_closes(table, owners), bars.spot_series(table, owners), aggregates.trading_days(table, owners, res_id=2)):
        assert "dynamicpruning" in plan_of(df).lower()
        assert df.count() > 0


def test_counts_and_windows_come_from_running_counts(spark):
    import random

    rng = random.Random(12)
    at = lambda d, m: datetime(2024, 1, 1) + timedelta(days=d, minutes=m)
    moments = {(c, at(rng.choice([0, 1, 2, 5, 9, 30]), rng.choice([0, 1, 700, 1439]))) for c in (1, 2) for _ in range(40)}
    candles = spark.createDataFrame(
        [(c, 2, t, 1, None) for c, t in sorted(moments)], "contract_id int, res_id smallint, ts timestamp_ntz, volume bigint, oi bigint"
    ).select("*", *[F.lit(1).cast("decimal(11,4)").alias(c) for c in bars.PRICES])
    asked = [(n, rng.choice([1, 2, 3]), 2, at(rng.randint(-1, 31), rng.choice([0, 0, 1, 699, 700])), at(rng.randint(-1, 31), rng.choice([0, 0, 1, 701]))) for n in range(150)]
    asked += [(200, 1, 2, at(2, 1), at(2, 701)), (201, 1, 2, at(0, 0), at(1, 0)), (202, 1, 2, at(5, 0), at(5, 0))]
    requests = spark.createDataFrame(asked, "request_id int, contract_id int, res_id smallint, start_ts timestamp_ntz, end_ts timestamp_ntz")
    daily = bars.daily_counts(candles)
    got = {r.request_id: r.available for r in bars.range_cap(candles, requests, 5, daily).collect()}
    assert got == {n: sum(c == k and a <= t < b for k, t in moments) for n, c, _, a, b in asked}

    for count in (1, 7, 500):
        before = bars.before_each(candles, requests.withColumnRenamed("start_ts", "before_ts").drop("end_ts"), count, daily)
        found = {}
        for r in before.collect():
            found.setdefault(r.request_id, set()).add(r.ts)
        for n, c, _, a, _ in asked:
            assert found.get(n, set()) == set(sorted((t for k, t in moments if k == c and t < a), reverse=True)[:count])
    assert "collect_list" not in plan_of(before) and "array_agg" not in plan_of(before)


def test_large_files_are_hashed_in_blocks(spark, tmp_path):
    """Text, bytes of any kind, no line feed at all or only such, and sizes around whole blocks."""
    import hashlib
    import random

    rng, block, whole = random.Random(4), 1000, 1500
    made = {
        "text": b"".join(b"%d,%s\r\n" % (i, b"x" * rng.randint(0, 90)) for i in range(900)), "bytes": rng.randbytes(40_000),
        "one": b"a" * 7_777, "feeds": b"\n" * 5_000, "whole-blocks": b"b\n" * 1_500, "open-end": b"c\n" * 1_499 + b"cc",
        "at-limit": b"d" * 1_500, "above": b"e" * 1_501, "empty": b"", "nulls": b"\0\n\xff\xfe" * 2_000,
    }
    for name, data in made.items():
        (tmp_path / f"f={name}").mkdir()
        (tmp_path / f"f={name}" / "part-0").write_bytes(data)
    want = {}
    for name, data in made.items():
        if not data:
            continue
        leaves = [hashlib.sha256(data[i : i + block]).hexdigest() for i in range(0, len(data), block)]
        want[f"f={name}"] = (len(data), hashlib.sha256(data if len(data) <= whole else "".join(leaves).encode()).hexdigest())
    split, opening = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    try:
        for size in ("3000", "128m"):
            spark.conf.set(split, size)
            spark.conf.set(opening, "0")
            got = export.file_digests(spark, str(tmp_path), whole, block).collect()
            assert {r.folder: (r.byte_size, r.sha256) for r in got} == want and len(got) == len(want)
    finally:
        spark.conf.unset(split)
        spark.conf.unset(opening)


def test_a_large_compressed_text_is_refused(spark, tmp_path):
    import gzip
    import random

    (tmp_path / "part-0.csv.gz").write_bytes(gzip.compress(random.Random(5).randbytes(9_000)))
    assert export.file_digests(spark, str(tmp_path)).count() == 1
    with pytest.raises(Exception, match="not readable in parts"):
        export.file_digests(spark, str(tmp_path), 2_000, 1_000).collect()
