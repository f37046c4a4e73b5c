"""Writes: bulk append, slice reload, full refresh, incremental load,
insert defaults and identity keys.

Every write is one Spark job whose output is committed atomically by the
file committer, so a lost executor only retries tasks; a rerun of a whole
job overwrites exactly what it wrote before (idempotent).
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..session import checkpoint_root
from .ranks import numbered


def rebalanced(df: DataFrame, partition_by: list[str]) -> DataFrame:
    """Group rows by output partition before a partitioned write, so each
    task writes few folders.  The rebalance hint lets AQE split a hot
    partition value over several tasks and merge small ones."""
    return df.hint("rebalance", *partition_by)


def bulk_append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = (rebalanced(df, partition_by) if partition_by else df).write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def full_refresh(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace the whole table (a mart built with --full-refresh)."""
    w = (rebalanced(df, partition_by) if partition_by else df).write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def overwrite_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace only the partitions present in ``df`` (dynamic overwrite);
    all other partitions stay as they are."""
    (rebalanced(df, partition_by).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic")
       .partitionBy(*partition_by).parquet(path))


def slice_reload(h: DataFrame, path: str, sid: str) -> None:
    """Delete-then-insert of one scenario slice as a single dynamic
    partition overwrite of ``scenario_id=sid``."""
    overwrite_partitions(h.where(F.col("scenario_id") == sid), path, ["scenario_id"])


def insert_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Add a column default only where the input lacks the column (an
    explicit NULL stays NULL, as with an INSERT naming the column)."""
    for name, value in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, value)
    return df


def table_defaults(table: str) -> dict[str, Column]:
    """Column defaults declared by the raw tables' DDL."""
    return {
        "raw_securities": {"is_active": F.lit(1), "created_dt": F.current_date()},
        "raw_accounts": {"status": F.lit("ACTIVE")},
        "raw_holdings": {"fx_rate": F.lit(1).cast("decimal(20,8)")},
        "stress_metrics": {"pruning_active": F.lit(0)},
    }[table]


def read_if_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # nothing written yet
        return spark.createDataFrame([], schema)


def counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """``df`` and an observation whose ``rows`` the action on it counts on its way."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def identity_key(df: DataFrame, order: list[str], name: str, spark: SparkSession,
                 work: str | None = None) -> DataFrame:
    """Dense 1..n key in ``order`` without a single-task window (see ``ranks.numbered``).  The
    sorted rows are written to ``work`` when this is called."""
    work = work or f"{checkpoint_root(spark)}/ledgerlake-ranks/{uuid.uuid4().hex}"
    rows = numbered(df, [], order, work, "_rank", "_size")
    return rows.select((F.col("_rank") + 1).alias(name), *df.columns)


def append_identified(df: DataFrame, path: str, order: list[str], name: str) -> str:
    """Append ``df`` to the table at ``path`` with keys that go on, in ``order``, from the stored
    high-water mark; keys given once stay.  Returns the folder of the table's rows.

    An append is a folder of its own, and counts once its mark is written.  One that
    died before is written again, over the same folder, by the next call."""
    spark = df.sparkSession
    done = read_if_any(spark, f"{path}/marks", "number long, high long").agg(
        F.coalesce(F.max("number"), F.lit(0)), F.coalesce(F.max("high"), F.lit(0))).first()
    number, high = done[0] + 1, done[1]
    rows = numbered(df, [], order, f"{path}/sorted/{number}", "_rank", "_size")
    out, seen = counted(rows.select((F.col("_rank") + 1 + high).alias(name), *df.columns))
    out.write.mode("overwrite").parquet(f"{path}/rows/append={number}")
    mark = spark.createDataFrame([(number, high + seen.get["rows"])], "number long, high long")
    mark.write.mode("overwrite").parquet(f"{path}/marks/append={number}")
    return f"{path}/rows"
