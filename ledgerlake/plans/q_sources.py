"""Queries over sources: registry counts, pruned scans, slices, catalogues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import int_div
from ..operators import staging
from ..sources import catalog, store
from . import oracle_base as O
from .registry import query

W2 = O.W2
_TS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


@query("src_raw_counts", W2("\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS num_rows FROM {t}"
    for t in ["raw_holdings", "raw_securities", "raw_accounts", "raw_transactions"])))
def src_raw_counts(lake):
    parts = [lake.raw(t).agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("num_rows"))
             for t in ["raw_holdings", "raw_securities", "raw_accounts", "raw_transactions"]]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("src_column_pruned_scan", W2(
    f"SELECT {', '.join(staging.HOLDINGS_SOURCE_COLS)} FROM raw_holdings"))
def src_column_pruned_scan(lake):
    return lake.holdings.select(*staging.HOLDINGS_SOURCE_COLS)


@query("src_partitioned_month_scan", W2(f"""
SELECT * FROM raw_holdings
WHERE as_of_month >= CAST(date_trunc('month', (SELECT max(as_of_date) FROM raw_holdings) - {K.TRAILING_DAYS}) AS DATE)"""))
def src_partitioned_month_scan(lake):
    h = lake.holdings
    start = F.date_sub(staging.latest_date(h), K.TRAILING_DAYS)
    return h.where(F.col("as_of_month") >= F.trunc(start, "MM"))


@query("src_shared_slice", W2("""
SELECT 'S6' AS scenario_id, 'S5' AS slice_id, account_id, security_id, as_of_date, market_value_usd
FROM raw_holdings WHERE scenario_id = 'S5'"""))
def src_shared_slice(lake):
    sid = "S6"
    return staging.scenario_slice(lake.holdings, sid).select(
        F.lit(sid).alias("scenario_id"), F.lit(staging.resolve_slice(sid)).alias("slice_id"),
        "account_id", "security_id", "as_of_date", "market_value_usd")


@query("src_metrics_ordered", W2("""
SELECT metric_id, scenario_id, phase,
       strftime(started_at, '%Y-%m-%d %H:%M:%S.%f') AS started_at,
       strftime(finished_at, '%Y-%m-%d %H:%M:%S.%f') AS finished_at,
       duration_sec, rows_actual, rows_projected, peak_mem_mb, avg_cpu_pct
FROM stress_metrics ORDER BY scenario_id, started_at"""))
def src_metrics_ordered(lake):
    m = lake.metrics
    return (m.select("metric_id", "scenario_id", "phase",
                     F.date_format("started_at", _TS).alias("started_at"),
                     F.date_format("finished_at", _TS).alias("finished_at"),
                     "duration_sec", "rows_actual", "rows_projected", "peak_mem_mb", "avg_cpu_pct",
                     F.col("started_at").alias("_ts"))
            .orderBy("scenario_id", "_ts").drop("_ts"))


def table_inventory(lake):
    """Landed tables by size: the table catalogue (rows) joined to the
    segment catalogue (files, bytes) on table name and owner."""
    paths = {t: store.build(lake.spark, lake.sf_dir, t) for t in store.TABLES}
    tables = reduce(lambda a, b: a.unionByName(b),
                    [catalog.table_catalogue(lake.spark, t, p, store.TABLES[t][1] is not None)
                     for t, p in paths.items()])
    segments = reduce(lambda a, b: a.unionByName(b),
                      [catalog.segment_catalogue(lake.spark, t, p) for t, p in paths.items()])
    return catalog.table_inventory(tables, segments)


_LANDED = {t: "YES" if v[1] is not None else "NO" for t, v in store.TABLES.items()}


@query("src_table_inventory", W2("\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS num_rows, '{p}' AS partitioned, true AS has_files FROM {t}"
    for t, p in _LANDED.items())))
def src_table_inventory(lake):
    return table_inventory(lake).select("table_name", "num_rows", "partitioned",
                                        (F.col("bytes") > 0).alias("has_files"))


@query("src_partition_profile", W2("""
SELECT h.scenario_id, h.as_of_month AS partition_month, count(*) AS num_rows,
       min(h.as_of_date) AS min_date, max(h.as_of_date) AS max_date,
       max(c.projected_rows) // """ + str(K.PROJECTED_MONTHS) + """ AS projected_rows_per_partition
FROM raw_holdings h JOIN scenario_config c ON c.scenario_id = h.scenario_id
WHERE c.strategy = 'scaled_stats'
GROUP BY h.scenario_id, h.as_of_month"""))
def src_partition_profile(lake):
    cfg = catalog.scenario_config(lake.spark).where(F.col("strategy") == "scaled_stats") \
                 .select("scenario_id", "projected_rows")
    h = lake.holdings.select("scenario_id", "as_of_month", "as_of_date")
    j = h.join(F.broadcast(cfg), "scenario_id")
    return j.groupBy("scenario_id", F.col("as_of_month").alias("partition_month")).agg(
        F.count(F.lit(1)).alias("num_rows"),
        F.min("as_of_date").alias("min_date"), F.max("as_of_date").alias("max_date"),
        int_div(F.max("projected_rows"), F.lit(K.PROJECTED_MONTHS)).alias("projected_rows_per_partition"))


@query("src_scenario_config", W2("""
SELECT c.*, s.slice_rows FROM scenario_config c
JOIN (""" + O.slice_counts_sql("raw_holdings", "slice_rows") + """) s ON s.scenario_id = c.scenario_id"""))
def src_scenario_config(lake):
    cfg = catalog.scenario_config(lake.spark)
    return cfg.join(catalog.per_slice_counts(lake.holdings, lake.spark, "slice_rows"), "scenario_id")
