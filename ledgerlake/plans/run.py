"""Command line: land the raw tables and run scenarios.

    python -m ledgerlake.plans.run --sf-dir /path/to/tables --scenarios S1 S2
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .. import constants as K
from ..sources import store
from .context import Lake
from .pipeline import run_all


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description="Run portfolio pipeline scenarios")
    ap.add_argument("--sf-dir", required=True)
    ap.add_argument("--scenarios", nargs="+", default=K.SCENARIO_IDS)
    ap.add_argument("--skip-load", action="store_true", help="reuse landed raw tables")
    args = ap.parse_args(argv)
    spark = SparkSession.builder.appName("ledgerlake-run").getOrCreate()
    if not args.skip_load:
        store.land_all(spark, args.sf_dir, force=True)
    path = run_all(Lake(spark, args.sf_dir), args.scenarios)
    print(f"metrics appended to {path}")


if __name__ == "__main__":
    main()
