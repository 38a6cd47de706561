"""Headline timings: enrolment, then every consolidation from the stored tables.

Prints one JSON line. BENCH_SF_DIR names the tables, BENCH_CPUS the threads.
"""

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ridgemark.plans import evaluate, store  # noqa: E402
from ridgemark.plans.enrol import enrol  # noqa: E402
from ridgemark.plans.identify import SCORES, identify  # noqa: E402
from ridgemark.sources import fixture  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    work = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "16g")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, run):
        start = time.perf_counter()
        result = run()
        times[name] = round(time.perf_counter() - start, 3)
        return result

    def build(kind):
        store.write_templates(enrol(fixture.template_minutiae(spark, sf_dir), fixture.ORDER, kind),
                              f"{work}/{kind}/templates")
        store.write_inputs(enrol(fixture.probe_minutiae(spark, sf_dir), fixture.ORDER, kind, "input"),
                           f"{work}/{kind}/inputs")

    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    for kind in ("jiang", "cylinder"):
        timed(f"enrol_{kind}", lambda: build(kind))
    sides = {kind: (store.read_structures(spark, f"{work}/{kind}/templates"),
                    store.read_structures(spark, f"{work}/{kind}/inputs")) for kind in ("jiang", "cylinder")}
    for name, (kind, _) in SCORES.items():
        timed(f"match_{name}", lambda: store.write_scores(identify(*sides[kind], kind, name),
                                                          f"{work}/scores/{name}"))
    scores = spark.read.parquet(f"{work}/scores/jiang_local")
    genuines = fixture.probe_lists(spark, sf_dir)[0]
    found = timed("evaluate", lambda: evaluate.evaluate(scores, genuines, "sfinge").first())
    t, i = sides["jiang"]
    pairs = t.count() * i.count()
    print(json.dumps({
        "metric": "enrol_match_evaluate_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "fingerprint_pairs": pairs,
        "pairs_per_sec": {n: round(pairs / times[f"match_{n}"]) for n in SCORES},
        "rank1_true_positives": found["tp"]}))
    spark.stop()


if __name__ == "__main__":
    main()
