"""Plan evidence for the pruning comparison (full scan vs trailing window).

The representative mart query (per account and date: distinct securities,
value, gain) is planned both ways.  For the optimiser's cost the holdings are
registered as a catalogue table with statistics of its columns and
partitions; the cost is what the optimised plan's statistics say it reads and
passes on.  Only these few numbers reach the driver.
"""

from __future__ import annotations

import contextlib
import io
import re
import time
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import aggregates, staging
from ..sources import store
from .context import Lake

STATS_COLUMNS = ["account_id", "security_id", "as_of_date", "market_value_usd", "scenario_id", "as_of_month"]
CBO = {"spark.sql.cbo.enabled": "true", "spark.sql.cbo.planStats.enabled": "true"}
_UNITS = {"B": 1, "KiB": 1 << 10, "MiB": 1 << 20, "GiB": 1 << 30, "TiB": 1 << 40, "PiB": 1 << 50, "EiB": 1 << 60}


def explained(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def formatted_plan(df: DataFrame) -> str:
    return explained(df)


def _scan_filters(plan: str) -> dict:
    part = re.findall(r"PartitionFilters: \[(.*)\]", plan)
    pushed = re.findall(r"PushedFilters: \[(.*)\]", plan)
    return {"partition_filters": part[0] if part else "", "pushed_filters": pushed[0] if pushed else ""}


def _files_and_months(h: DataFrame) -> tuple[int, int]:
    row = h.select(F.col("_metadata.file_path").alias("f"), "as_of_month") \
           .agg(F.count_distinct("f").alias("files"), F.count_distinct("as_of_month").alias("months")) \
           .first()
    return int(row["files"]), int(row["months"])


@contextlib.contextmanager
def cost_based(spark: SparkSession):
    """The cost-based optimiser for a while; the session's own settings come back."""
    before = {k: spark.conf.get(k, None) for k in CBO}
    try:
        for k, v in CBO.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def holdings_table(lake: Lake) -> str:
    """The landed holdings as an analysed catalogue table over the same files: its name.

    A changed input is landed in another folder and so gets another table."""
    path = store.build(lake.spark, lake.sf_dir, "raw_holdings")
    name = f"holdings_{zlib.crc32(path.encode()):08x}"
    if not lake.spark.catalog.tableExists(name):
        schema = lake.holdings.schema
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
        lake.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY (as_of_month, scenario_id) "
                       f"LOCATION '{path}'")
        lake.spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
        lake.spark.sql(f"ANALYZE TABLE {name} PARTITION (as_of_month, scenario_id) COMPUTE STATISTICS")
        lake.spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR COLUMNS {', '.join(STATS_COLUMNS)}")
    return name


def table_statistics(lake: Lake) -> dict:
    """What ANALYZE stored: rows, and the least, the greatest and the nulls of the dates."""
    name = holdings_table(lake)
    table = {r["col_name"]: r["data_type"] for r in lake.spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
    column = {r[0]: r[1] for r in lake.spark.sql(f"DESCRIBE EXTENDED {name} as_of_date").collect()}
    return {"rows": int(re.search(r"(\d+) rows", table["Statistics"])[1]), "least": column["min"],
            "greatest": column["max"], "nulls": int(column["num_nulls"])}


def plan_cost(df: DataFrame) -> dict:
    """Cost (bytes that the optimised plan's operators pass on, by its statistics), steps of the plan, and
    how many of its scans have partition filters."""
    text = explained(df, "cost")
    optimized = text.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    sizes = re.findall(r"Statistics\(sizeInBytes=([\d.E+]+) (\w+)", optimized)
    filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", text)
    return {"cost": int(sum(float(n) * _UNITS[u] for n, u in sizes)), "plan_steps": len(sizes),
            "partition_ops": sum(bool(f.strip()) for f in filters)}


def representative(h: DataFrame, sid: str, pruning: bool) -> DataFrame:
    """The representative mart query over a scenario's slice."""
    if pruning:
        newest = h.agg(F.max("as_of_date")).first()[0]  # known when planned, as a run date is
        h = staging.trailing_window(h, run_date=str(newest)) if newest is not None else h.limit(0)
    return aggregates.account_day(staging.scenario_slice(h, sid))


def scenario_cost(lake: Lake, sid: str, pruning: bool) -> dict:
    """``plan_cost`` of the representative query of a scenario on the analysed table."""
    with cost_based(lake.spark):
        return plan_cost(representative(lake.spark.table(holdings_table(lake)), sid, pruning))


def cost_evidence(lake: Lake, sid: str = "S5", shared_sid: str = "S6") -> DataFrame:
    """One row per plan (full, pruned): stored statistics, months the window keeps of all, the plan's cost and steps,
    and whether pruning made it cheaper."""
    stats = table_statistics(lake)
    months = lake.holdings.select("as_of_month").distinct().count()
    newest = lake.holdings.agg(F.max("as_of_date")).first()[0]
    kept = (lake.holdings.filter(F.col("as_of_month") >= F.trunc(F.date_sub(F.lit(newest), K.TRAILING_DAYS), "MM"))
            .select("as_of_month").distinct().count())
    found = [("full", sid, months, scenario_cost(lake, sid, False)), ("pruned", shared_sid, kept, scenario_cost(lake, shared_sid, True))]
    least = min(c["cost"] for *_, c in found)
    rows = [(plan, s, stats["rows"], stats["least"], stats["greatest"], stats["nulls"], months, m, c["cost"], c["plan_steps"],
             c["partition_ops"], c["cost"] == least and c["cost"] < max(x["cost"] for *_, x in found)) for plan, s, m, c in found]
    return lake.spark.createDataFrame(rows, "plan string, scenario_id string, table_rows long, min_date string, max_date string, "
                                            "null_dates long, months_total long, months_scanned long, cost long, plan_steps long, "
                                            "partition_ops long, cheaper boolean")


def explain_evidence(lake: Lake, sid: str = "S5", shared_sid: str = "S6") -> dict:
    h = lake.holdings
    out = {}
    for label, src, s in [("full", h, sid),
                          ("pruned", staging.trailing_window(h), shared_sid)]:
        part = staging.scenario_slice(src, s)
        q = aggregates.account_day(part)
        plan = formatted_plan(q)
        t0 = time.time()
        q.write.format("noop").mode("overwrite").save()
        seconds = round(time.time() - t0, 3)
        files, months = _files_and_months(part)
        cost = scenario_cost(lake, s, label == "pruned")
        out[label] = {"scenario": s, "seconds": seconds,
                      "files_scanned": files, "months_scanned": months, **cost, **_scan_filters(plan)}
    full, pruned = out["full"]["seconds"], out["pruned"]["seconds"]
    out["reduction_pct"] = round((1 - pruned / max(full, 1e-3)) * 100, 1)
    out["trailing_days"] = K.TRAILING_DAYS
    return out
