"""Wall seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line.

Each query runs $BENCH_RUNS times (1 unless set) and the median counts. Its SQL twin runs once in DuckDB on the same files.
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = (
    "ingest_events", "readiness_audit", "coverage", "asof_features", "household_snapshot",
    "travel_time_asof", "commute_lookup", "choice_set", "historical_decisions",
    "choice_probabilities", "log_loss", "logit_gradient", "logit_fit", "temporal_holdout",
    "resample_population", "scenario_ensemble", "scenario_compare", "validate_assignments",
    "srm_buckets", "evaluate_experiment", "semantic_hash",
)


def twin_seconds(con: duckdb.DuckDBPyConnection, text: str | None) -> float | None:
    """Seconds until the twin has its result; None where there is no twin or it fails."""
    if text is None:
        return None
    start = time.perf_counter()
    try:
        con.execute(text).fetchmany(1)
    except duckdb.Error as error:
        print(f"twin: {error}", file=sys.stderr, flush=True)
        return None
    return round(time.perf_counter() - start, 3)


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    memory = os.environ.get("BENCH_MEMORY", "16g")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from hearthline.bindings.queries import ORACLES, run

    con = duckdb.connect()
    con.execute(f"SET threads = {int(cpus)}")
    con.execute("SET memory_limit = '8GB'")
    for file in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(file).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{file}'")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    seconds, twins = {}, {}
    for name in names:
        walls = []
        for _ in range(runs):
            start = time.perf_counter()
            run(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
            walls.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(walls), 3)
        twins[name] = twin_seconds(con, ORACLES.get(name))
        print(f"{name}: {seconds[name]} (twin {twins[name]})", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_wall_seconds", "value": round(sum(seconds.values()), 3),
                "unit": "sec", "queries": seconds, "sf": sf_dir.split("sf")[-1],
                "cpus": cpus, "shuffle_partitions": cpus, "driver_memory": memory, "runs": runs,
                "duckdb_seconds": twins,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
