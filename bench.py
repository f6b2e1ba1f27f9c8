"""Headline operators at one scale; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. The given tables are single files, so
they are first copied to folders of several files and the bars are written to the clustered table
the engine keeps; none of that is timed. Each query then runs once to warm up and the best of three
runs is kept. Results go to the no-op sink or to fresh files.
"""

from __future__ import annotations

import json
import os
import time
from functools import partial

from pyspark.sql import functions as F

from catalogue.base import Tables
from catalogue.naming import roots, weekly_orders
from catalogue.ranges import wants
from tickloom import schemas, session
from tickloom.operators import aggregates, asof, bars as bars_of, coverage, intervals, quality, symbols, versioning
from tickloom.sinks import export, store

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


class Copied(Tables):
    """The given tables, read from folders of as many files as there are cores."""

    def __init__(self, spark, sf_dir: str) -> None:
        super().__init__(spark, sf_dir)
        self.root = session.fresh_path(spark, "bench-input")
        for name in ("events", "orders", "customer", "nation", "lineitem"):
            super().given(name).repartition(int(CPUS)).write.parquet(f"{self.root}/{name}")
        store.write(self.lineitem_bars, f"{self.root}/bars", 1 << 20)
        self.table = store.read(spark, f"{self.root}/bars", 1 << 20)

    def given(self, name: str):
        return self.spark.read.parquet(f"{self.root}/{name}")

    @property
    def bars(self):
        return self.table.select(*schemas.CANDLE_COLUMNS)


def workloads(t: Copied) -> dict:
    spark = t.spark
    bars = t.bars
    asks = t.with_ids(t.given("events")).select(
        "event_id", "underlying_id", F.col("ts").cast("timestamp_ntz").alias("at_ts")
    )
    empty = schemas.empty(spark, schemas.MASTER_HISTORY)
    raw = bars.select(
        "contract_id", "res_id", *export._times(), "open", "high", "low", "close", "volume", "oi", "ts"
    )
    held = intervals.held(t.coverage)
    one = bars_of.window(t.table, 77, 2, "2018-01-01", "2030-01-01").agg(F.count("*"), F.max("close"))
    results = {
        "daily_bars": aggregates.daily_bars(bars),
        "series_bounds": aggregates.bounds(bars),
        "one_series_scan": one,
        "duplicate_bars": quality.duplicate_bars(bars),
        "spot_asof": asof.spot_at(t.candles, t.underlyings, asks, 2),
        "merge_ranges": intervals.merge(held),
        "missing_windows": intervals.missing(wants(t), held),
        "coverage_grid": coverage.grid(t.coverage, t.contracts, t.expiries),
        "weekly_splits": symbols.parse(weekly_orders(t), roots(t), (2015, 2031)),
        "version_merge": versioning.merge(empty, t.master(1), "2024-01-10"),
    }
    writes = {
        "export_parquet_zstd": lambda: export.write_single(raw, session.fresh_path(spark, "bench"), export.Spec()),
        "export_csv": lambda: export.write_single(raw, session.fresh_path(spark, "bench"), export.Spec(format="csv")),
        "clustered_rewrite": lambda: store.write(bars, session.fresh_path(spark, "bench"), 1 << 20),
    }
    return {name: partial(drain, df) for name, df in results.items()} | writes


def main() -> None:
    spark = session.build(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
            "spark.sql.files.maxPartitionBytes": "4m",
            "spark.sql.files.openCostInBytes": "256k",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    t = Copied(spark, SF_DIR)
    timings = {}
    for name, run in workloads(t).items():
        run()
        best = None
        for _ in range(RUNS):
            started = time.perf_counter()
            run()
            took = time.perf_counter() - started
            best = took if best is None else min(best, took)
        timings[name] = round(best, 4)
    print(
        json.dumps(
            {
                "metric": "sum of best times of headline operators",
                "value": round(sum(timings.values()), 4),
                "unit": "sec",
                "queries": timings,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(CPUS),
            }
        )
    )


if __name__ == "__main__":
    main()
