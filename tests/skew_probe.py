"""Where does a hot key land? Run every report on tables where one key holds
a third of the rows, with the event log on, and print per report the
largest single task's shuffle-read records next to the total.

usage: python tests/skew_probe.py [scale] [name ...]

A report that shuffled raw rows by the hot key would show one task
reading about a third of its input; partial aggregation, partial top-k and
one-row-per-key join sides keep every task small.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from skew_shop import skewed_tables  # noqa: E402

from shoplens.operators.prep import publish  # noqa: E402
from shoplens.plans.reports import REPORTS  # noqa: E402
from shoplens.sources.tables import read_catalog  # noqa: E402


def _events(log_dir: str):
    import zstandard

    for f in glob.glob(f"{log_dir}/*/events_*") + glob.glob(f"{log_dir}/app*"):
        raw = open(f, "rb").read()
        if f.endswith(".zstd"):
            raw = zstandard.ZstdDecompressor().stream_reader(__import__("io").BytesIO(raw)).read()
        for line in raw.decode().splitlines():
            yield json.loads(line)


def main() -> None:
    args = sys.argv[1:]
    scale = int(args[0]) if args else 10
    only = set(args[1:])
    work = tempfile.mkdtemp(prefix="skew-probe-", dir=os.environ.get("PROBE_DIR", "/tmp"))
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "32")
             .config("spark.sql.autoBroadcastJoinThreshold", "-1")  # show the shuffle plans
             # keep the 32 reduce partitions apart: coalescing small ones would
             # look like skew at this size
             .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", work)
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    publish(skewed_tables(spark, scale), f"{work}/tables", catalog_prefix="probe_")
    t = read_catalog(spark, prefix="probe_")
    rows = {n: df.count() for n, df in t.items()}
    names = [n for n in REPORTS if not only or n in only]
    for name in names:
        spark.sparkContext.setJobDescription(name)
        REPORTS[name](t).write.format("noop").mode("overwrite").save()
    spark.stop()

    stage_job, job_name, per_task = {}, {}, {}
    for e in _events(work):
        ev = e["Event"]
        if ev == "SparkListenerJobStart":
            job_name[e["Job ID"]] = e.get("Properties", {}).get("spark.job.description")
            for s in e["Stage IDs"]:
                stage_job[s] = e["Job ID"]
        elif ev == "SparkListenerTaskEnd" and "Task Metrics" in e:
            m = e["Task Metrics"]
            sr = m.get("Shuffle Read Metrics", {})
            recs = sr.get("Total Records Read", 0)
            name = job_name.get(stage_job.get(e["Stage ID"]))
            if name:
                per_task.setdefault(name, []).append(recs)
    print(f"input rows: {rows}")
    print(f"{'report':42s} {'max task shuffle recs':>22s} {'all shuffle recs':>17s} {'max/mean':>9s}")
    for name in names:
        recs = [r for r in per_task.get(name, []) if r] or [0]
        mean = sum(recs) / len(recs)
        ratio = max(recs) / mean if mean else 0.0
        flag = "  <-- one task holds a hot key" if ratio > 4 and max(recs) > 10000 else ""
        print(f"{name:42s} {max(recs):22d} {sum(recs):17d} {ratio:9.1f}{flag}")


if __name__ == "__main__":
    main()
