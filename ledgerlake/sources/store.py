"""The raw landing zone: derived tables written once as parquet.

Rows are rebalanced on the month (AQE splits a hot month across tasks and
merges small ones) and sorted inside each file, so parquet row-group
statistics can skip on account and date.  ``raw_holdings`` and
``raw_transactions`` are stored in one folder per month, so a month predicate
prunes whole folders.  A table's folder is named after the state of its input
files (names, sizes, modification times), so a changed input is landed anew.
"""

from __future__ import annotations

import hashlib
import re
import threading
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..session import store_dir
from . import fixtures

# name -> (builder, partition columns, sort keys, input tables)
TABLES = {
    # Holdings: one folder per month, and per scenario slice inside it, so a
    # month predicate and a slice predicate both prune whole folders.
    "raw_holdings": (fixtures.raw_holdings, ["as_of_month", "scenario_id"],
                     ["as_of_month", "scenario_id", "account_id", "as_of_date", "security_id"],
                     ["lineitem"]),
    "raw_securities": (fixtures.raw_securities, None, ["security_id"], ["part"]),
    "raw_accounts": (fixtures.raw_accounts, None, ["account_id"],
                     ["supplier", "nation", "region"]),
    "raw_transactions": (fixtures.raw_transactions, ["trade_month"],
                         ["trade_month", "account_id", "trade_date", "transaction_id"], ["orders"]),
    "stress_metrics": (fixtures.stress_metrics, None, ["scenario_id", "started_at", "metric_id"],
                       ["events"]),
    "run_log": (fixtures.run_log, None, ["scenario_id", "phase", "line_no"], ["events"]),
}

# Tables shuffled to their folders as narrow rows, and what makes them whole there.
NARROW = {"raw_holdings": (fixtures.holding_lots, fixtures.holdings_of)}

_ready: set[str] = set()
_locks: dict[str, threading.Lock] = {}
_locks_guard = threading.Lock()


def _lock(key: str) -> threading.Lock:
    with _locks_guard:
        return _locks.setdefault(key, threading.Lock())


# Landed tables as DataFrames, per application and state of the input: file
# listing and schema resolution happen once, not once per query.
_frames: dict[str, DataFrame] = {}


def input_state(spark: SparkSession, sf_dir: str, inputs: list[str]) -> str:
    """Hash of the names, sizes and modification times of the input files."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    h = hashlib.sha1()
    for name in inputs:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet{{,/*,/*/*}}")
        listed = jvm.scala.runtime.ScalaRunTime.stringOf(path.getFileSystem(conf).globStatus(path))
        h.update(re.sub(r"access_time=\d+", "", listed).encode())
    return h.hexdigest()[:12]


def table_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    return f"{store_dir(spark, sf_dir)}/{name}/{input_state(spark, sf_dir, TABLES[name][3])}"


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(f"{path}/_SUCCESS").schema  # committed output only
        return True
    except AnalysisException:
        return False


def write_table(df: DataFrame, path: str, part_cols: list[str] | None, keys: list[str],
                mode: str = "overwrite", whole: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Bulk write, sorted inside each file.  ``whole`` makes the stored rows once they are dealt.

    Rows are rebalanced on the partition column (or the leading key): AQE
    sizes the write tasks from runtime statistics, splits a hot month or key
    over several tasks and merges small ones, with no sampling pass and no
    up-front size estimate."""
    out = whole(df.hint("rebalance", *(part_cols or keys[:1]))).sortWithinPartitions(*keys)
    w = out.write.mode(mode).option("compression", "snappy")
    if part_cols:
        w = w.partitionBy(*part_cols)
    w.parquet(path)


def build(spark: SparkSession, sf_dir: str, name: str, force: bool = False) -> str:
    """Land one table unless it is already committed (one writer per table
    at a time within this driver)."""
    path = table_path(spark, sf_dir, name)
    key = f"{spark.sparkContext.applicationId}:{path}"
    with _lock(key):
        if not force and (key in _ready or exists(spark, path)):
            _ready.add(key)
            return path
        builder, part_cols, keys, _inputs = TABLES[name]
        narrow, whole = NARROW.get(name, (builder, lambda df: df))
        write_table(narrow(spark, sf_dir), path, part_cols, keys, whole=whole)
        _ready.add(key)
        _frames.pop(key, None)
    return path


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A landed table, its files listed now, with its declared schema, so
    partition columns keep their types."""
    path = build(spark, sf_dir, name)
    return spark.read.schema(TABLES[name][0](spark, sf_dir).schema).parquet(path)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A landed table (landed first if needed), listed once per application."""
    key = f"{spark.sparkContext.applicationId}:{table_path(spark, sf_dir, name)}"
    if key not in _frames:
        _frames[key] = read(spark, sf_dir, name)
    return _frames[key]


def land_all(spark: SparkSession, sf_dir: str, force: bool = False) -> dict[str, str]:
    """Land every raw table.  The tables are independent, so their write
    jobs are submitted together and share the cluster."""
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=len(TABLES)) as pool:
        futs = {n: pool.submit(build, spark, sf_dir, n, force) for n in TABLES}
        return {n: f.result() for n, f in futs.items()}
