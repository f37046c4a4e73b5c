"""Sink queries: each performs its write(s) and returns the table read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.columns import money_sum
from ..operators import aggregates, marts, sinks
from ..sources import fixtures, store
from ..streaming.incremental import account_day_by_month, run_incremental, sync_months, synced
from . import oracle_base as O
from .registry import query

W2 = O.W2


@query("snk_slice_reload", W2("""
SELECT scenario_id, count(*) AS n_rows, CAST(sum(market_value_usd) AS DECIMAL(38,2)) AS total_mv_usd
FROM raw_holdings GROUP BY scenario_id"""))
def snk_slice_reload(lake):
    """Land all slices, then reload S2 twice (delete + insert as a dynamic
    partition overwrite): the second reload must change nothing."""
    path = lake.sink_path("holdings_by_slice")
    h = lake.holdings.select("account_id", "security_id", "as_of_date", "market_value_usd",
                             "scenario_id")
    sinks.full_refresh(h, path, ["scenario_id"])
    sinks.slice_reload(h, path, "S2")
    sinks.slice_reload(h, path, "S2")
    back = lake.spark.read.schema(h.schema).parquet(path)
    return back.groupBy("scenario_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        money_sum("market_value_usd").alias("total_mv_usd"))


@query("snk_mart_full_refresh", W2(O.mart_sql(f"({O.rollup_sql(0)})")))
def snk_mart_full_refresh(lake):
    """Materialise mart 001 as a table (a rerun replaces it)."""
    path = lake.sink_path("fct_portfolio_summary_001")
    mart = marts.portfolio_summary(aggregates.position_rollup(lake.enriched(), 0))
    sinks.full_refresh(mart, path)
    return lake.spark.read.schema(mart.schema).parquet(path)


@query("snk_insert_defaults", W2("""
SELECT security_id, cusip, isin, ticker, security_name, asset_class, sub_asset_class, country,
       currency, sector, credit_rating, issue_date, maturity_date, 1 AS is_active,
       current_date AS created_dt
FROM raw_securities"""))
def snk_insert_defaults(lake):
    src = fixtures.raw_securities(lake.spark, lake.sf_dir, with_defaults=False)
    return sinks.insert_defaults(src, sinks.table_defaults("raw_securities"))


@query("snk_identity_key", W2("""
SELECT row_number() OVER (ORDER BY started_at NULLS FIRST, metric_id) AS new_id, metric_id, scenario_id, phase,
       started_at
FROM stress_metrics"""))
def snk_identity_key(lake):
    """Three appends, each of a later third of the time; every one goes on from the mark."""
    m = lake.metrics.select("metric_id", "scenario_id", "phase", "started_at")
    path = f"{lake.sink_path('identified')}/{uuid.uuid4().hex}"
    first, last = m.agg(F.min("started_at"), F.max("started_at")).first()
    cuts = [F.lit(first + (last - first) * k / 3).cast("timestamp_ntz") for k in (1, 2)] if first else []
    at = F.col("started_at")
    third = sum((F.when(at >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    for k in range(len(cuts) + 1):
        rows = sinks.append_identified(m.filter(third == k), path, ["started_at", "metric_id"], "new_id")
    return (lake.spark.read.schema(f"new_id long, {', '.join(f'{n} {t}' for n, t in m.dtypes)}").parquet(rows)
            .drop("append"))


@query("snk_incremental_equals_full", W2("""
SELECT account_id, as_of_date, as_of_month, count(DISTINCT security_id) AS sec_count,
       CAST(sum(market_value_usd) AS DECIMAL(38,2)) AS total_mv,
       CAST(sum(unrealized_gain) AS DECIMAL(38,2)) AS total_gain
FROM raw_holdings GROUP BY account_id, as_of_date, as_of_month"""))
def snk_incremental_equals_full(lake):
    """Full build up to a date, in the middle of a month; then the months whose digests
    differ from the whole source.  The table read back equals one full build."""
    path = f"{lake.sink_path('account_day_by_month')}/{uuid.uuid4().hex}"
    h = lake.holdings
    cut = F.date_add(F.add_months(h.agg(F.max("as_of_month")).scalar(), -6), 14)
    sync_months(h.where(F.col("as_of_date") <= cut), path)
    sync_months(h, path)
    return synced(lake.spark, account_day_by_month(h).schema, path)


@query("snk_incremental_stream", W2("""
SELECT account_id, as_of_date, as_of_month, count(DISTINCT security_id) AS sec_count,
       CAST(sum(market_value_usd) AS DECIMAL(38,2)) AS total_mv,
       CAST(sum(unrealized_gain) AS DECIMAL(38,2)) AS total_gain
FROM raw_holdings GROUP BY account_id, as_of_date, as_of_month"""))
def snk_incremental_stream(lake):
    """The same fact table built by the streaming incremental loader."""
    path = store.table_path(lake.spark, lake.sf_dir, "raw_holdings")
    out = f"{lake.sink_path('account_day_stream')}/{path.rsplit('/', 1)[1]}"
    run_incremental(lake.spark, lake.sf_dir, out, f"{out}-stream")
    schema = account_day_by_month(lake.holdings).schema
    return lake.spark.read.schema(schema).parquet(out)
