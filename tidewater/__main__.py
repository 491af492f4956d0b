"""python -m tidewater STAGE SF_DIR OUT: runs the queries of a stage (check, outcome, mc, signal, structural, material, fast or all), writes each as Parquet, and the reports of
what is there. Run again over the same input, it goes on where it was: tables that are whole stay."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .runs import STAGES, run_stage, write_reports


def main(stage: str, sf_dir: str, out: str) -> int:
    from .plans.catalogue import QUERIES

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    done = run_stage(spark, QUERIES, STAGES[stage], sf_dir, out) + write_reports(spark, STAGES["all"], out)
    for went in done:
        print(went["status"], went["layer"], went.get("error", "")[:200])
    return int(any(went["status"] == "error" for went in done))


if __name__ == "__main__":
    if len(sys.argv) != 4 or sys.argv[1] not in STAGES:
        sys.exit(__doc__)
    sys.exit(main(*sys.argv[1:]))
