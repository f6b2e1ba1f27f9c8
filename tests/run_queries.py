"""Command line form of the comparison: python tests/run_queries.py [sf_dir] [name part ...]"""

import sys
import time
import traceback

sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402
from tests import harness  # noqa: E402
from tickloom import session  # noqa: E402

if __name__ == "__main__":
    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = session.build(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = harness.connect(sf_dir)
    oracles, failed, n = entry.oracle_sql(), [], 0
    for name, fn in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        n += 1
        started = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                problem, note = harness.compare(df, con, oracles[name]), ""
                note = f"rows={df.count()}" if problem is None and "-v" in wanted else ""
            else:
                problem, note = None, f"no oracle, {df.count()} rows"
        except Exception as exc:  # noqa: BLE001
            problem, note = f"{type(exc).__name__}: {str(exc)[:1500]}", ""
            if "-t" in wanted:
                traceback.print_exc()
        print(f"{'FAIL' if problem else 'ok'} {name} {time.time() - started:.1f}s {note} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{n} run, {len(failed)} failed: {failed}")
