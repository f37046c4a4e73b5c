"""Scenario settings, budgets and thresholds as small DataFrames, and the
source registry / inventory views over the landed tables.

The setting tables are fixed-size (8 scenarios, 4 thresholds); joining them
to data is always a join to a proven-small side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K

SCENARIO_SCHEMA = T.StructType([
    T.StructField("scenario_id", T.StringType(), False),
    T.StructField("scenario_name", T.StringType()),
    T.StructField("strategy", T.StringType()),
    T.StructField("n_securities", T.LongType()),
    T.StructField("n_accounts", T.LongType()),
    T.StructField("n_days", T.IntegerType()),
    T.StructField("holdings_per_slot", T.IntegerType()),
    T.StructField("txn_ratio", T.DoubleType()),
    T.StructField("threads", T.IntegerType()),
    T.StructField("model_complexity", T.StringType()),
    T.StructField("use_partition_filter", T.BooleanType()),
    T.StructField("n_intermediate", T.IntegerType()),
    T.StructField("n_marts", T.IntegerType()),
    T.StructField("projected_rows", T.LongType()),
])


def scenario_overrides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([list(s) for s in K.SCENARIOS], SCENARIO_SCHEMA)


def scenario_config(spark: SparkSession) -> DataFrame:
    """Per-scenario settings: the defaults, overridden where a scenario sets
    a value (left join + coalesce)."""
    d = K.SCENARIO_DEFAULTS
    defaults = spark.createDataFrame(
        [(sid, d["n_staging"], d["n_intermediate"], d["n_marts"], d["model_complexity"],
          d["use_partition_filter"], float(d["txn_ratio"]), int(d["projected_rows"]))
         for sid in K.SCENARIO_IDS],
        "scenario_id string, d_staging int, d_intermediate int, d_marts int, "
        "d_complexity string, d_pruning boolean, d_txn_ratio double, d_projected long")
    o = scenario_overrides(spark)
    j = defaults.join(F.broadcast(o), "scenario_id", "left")
    return j.select(
        "scenario_id", "scenario_name", "strategy", "n_securities", "n_accounts", "n_days",
        "holdings_per_slot",
        F.coalesce("txn_ratio", "d_txn_ratio").alias("txn_ratio"),
        "threads",
        F.coalesce("model_complexity", "d_complexity").alias("model_complexity"),
        F.coalesce("use_partition_filter", "d_pruning").alias("use_partition_filter"),
        F.col("d_staging").alias("n_staging"),
        F.coalesce("n_intermediate", "d_intermediate").alias("n_intermediate"),
        F.coalesce("n_marts", "d_marts").alias("n_marts"),
        F.coalesce("projected_rows", "d_projected").alias("projected_rows"),
    )


def time_budget(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [list(b) for b in K.TIME_BUDGET],
        "scenario_id string, budget_data_gen_min int, budget_dbt_run_min int, budget_total_min int")


def thresholds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([list(t) for t in K.THRESHOLDS],
                                 "metric string, ok_limit int, warn_limit int")


def slice_map(spark: SparkSession) -> DataFrame:
    """scenario -> stored slice it reads (S6 reads S5)."""
    return spark.createDataFrame([(s, K.SHARED_SLICES.get(s, s)) for s in K.SCENARIO_IDS],
                                 "scenario_id string, slice_id string")


def per_slice_counts(h: DataFrame, spark: SparkSession, col: str = "n_rows") -> DataFrame:
    """Rows per scenario, resolving shared slices (S6 gets S5's count)."""
    c = h.groupBy(F.col("scenario_id").alias("slice_id")).agg(F.count(F.lit(1)).alias(col))
    return (slice_map(spark).join(c, "slice_id", "left")
            .select("scenario_id", F.coalesce(F.col(col), F.lit(0)).cast("long").alias(col)))


OWNER = "ledgerlake"


def table_catalogue(spark: SparkSession, name: str, path: str, partitioned: bool) -> DataFrame:
    """One row per table: owner, name, row count, partitioned flag."""
    return spark.read.parquet(path).agg(
        F.lit(OWNER).alias("owner"), F.lit(name).alias("table_name"),
        F.count(F.lit(1)).alias("num_rows"),
        F.lit("YES" if partitioned else "NO").alias("partitioned"))


def segment_catalogue(spark: SparkSession, name: str, path: str) -> DataFrame:
    """One row per table: owner, name, files and bytes, from file metadata
    only (no data columns are read)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.parquet").load(path).select("length"))  # one row a file
    return files.agg(F.lit(OWNER).alias("owner"), F.lit(name).alias("table_name"),
                     F.count(F.lit(1)).alias("num_files"), F.sum("length").alias("bytes"))


def table_inventory(tables: DataFrame, segments: DataFrame) -> DataFrame:
    """Tables joined to their segments on (table name, owner); size in GB
    to 3 places; the largest first."""
    j = tables.join(segments, ["table_name", "owner"], "inner")
    return (j.select("table_name", "num_rows", "partitioned", "num_files", "bytes",
                     F.round(F.col("bytes") / F.lit(1073741824.0), 3).alias("size_gb"))
             .orderBy(F.desc("bytes"), "table_name"))
