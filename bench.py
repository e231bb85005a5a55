"""Benchmark: every registered report at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line. ``prepare_shop_tables`` is the one-off fixture
mapping + publish (bucketed catalog tables in the checkpoint folder),
timed after a JVM warm-up; each report is then timed end to end (median
of $BENCH_RUNS runs) with the ``noop`` sink, which runs the whole plan
without shipping rows to the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shoplens.plans.reports import REPORTS  # noqa: E402
from shoplens.session import local_session  # noqa: E402
from shoplens.sources.fixture import fixture_tables  # noqa: E402


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    only = set(sys.argv[1:])
    spark = local_session(cpus)

    # Warm the JVM (class loading, codegen) on the raw tables, outside the timings.
    for name in ("orders", "lineitem", "events"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").groupBy().count().collect()

    t0 = time.perf_counter()
    tables = fixture_tables(spark, sf_dir)
    tables.items(), tables.summary()  # written at their first use
    prepare = time.perf_counter() - t0

    _run(REPORTS["financials_annual"](tables))  # first report pays one-off planning costs

    times: dict[str, float] = {"prepare_shop_tables": round(prepare, 3)}
    for name, report in REPORTS.items():
        if only and name not in only:
            continue
        samples = []
        for _ in range(runs):
            t = time.perf_counter()
            _run(report(tables))
            samples.append(time.perf_counter() - t)
        times[name] = round(statistics.median(samples), 3)

    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total_sec_prepare_plus_all_reports",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "runs": runs,
        "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
