"""Column statistics that merge: one row a month with counts, extremes and HyperLogLog sketches.

A table's statistics come from its months' rows alone.  When files of some months
change, only those months are read again; the others keep their stored rows.
Which months changed is seen from the listing of the table's files (names,
sizes, modification times), without opening them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import overwrite_partitions, read_if_any

LG_K = 12
# Three standard errors of a HyperLogLog estimate with 2^LG_K registers.
ERROR = 3 * 1.04 / 2 ** (LG_K / 2)


def file_state(spark: SparkSession, path: str, month: str) -> DataFrame:
    """Per month folder: ``state``, an order-free digest of its files' names, sizes and times."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    one = F.xxhash64("path", "length", "modificationTime")
    return files.groupBy(F.col(month).cast("date").alias(month)).agg(
        F.concat_ws(":", F.count(F.lit(1)), F.bit_xor(one)).alias("state"))


def month_sketches(df: DataFrame, month: str, cols: list[str]) -> DataFrame:
    """One row a month, in one pass: rows, and per column nulls, least, greatest and a sketch of the values."""
    def of(i: int, c: str) -> list[Column]:
        return [F.count_if(F.col(c).isNull()).alias(f"nulls_{i}"), F.min(c).alias(f"low_{i}"), F.max(c).alias(f"high_{i}"),
                F.hll_sketch_agg(F.col(c).cast("string"), F.lit(LG_K)).alias(f"sketch_{i}")]
    return df.groupBy(month).agg(F.count(F.lit(1)).alias("n"), *[x for i, c in enumerate(cols) for x in of(i, c)])


def merged(sketches: DataFrame, cols: list[str]) -> DataFrame:
    """The table's statistics, one row a column, from its months' rows."""
    def of(i: int, c: str) -> Column:
        distinct = F.hll_sketch_estimate(F.hll_union_agg(f"sketch_{i}"))
        return F.struct(F.lit(c).alias("column_name"), F.coalesce(F.sum("n"), F.lit(0)).alias("num_rows"),
                        F.coalesce(distinct, F.lit(0)).cast("long").alias("num_distinct"),
                        F.coalesce(F.sum(f"nulls_{i}"), F.lit(0)).alias("num_nulls"),
                        F.min(f"low_{i}").cast("string").alias("low_value"), F.max(f"high_{i}").cast("string").alias("high_value"))
    one = sketches.agg(F.array(*[of(i, c) for i, c in enumerate(cols)]).alias("s"))
    return one.select(F.explode("s").alias("s")).select("s.*")


def refresh(table: DataFrame, source: str, path: str, month: str, cols: list[str]) -> list:
    """Bring the months' rows at ``path`` up to date with the files under ``source`` (which ``table``
    reads); returns the months that were read.

    New rows are written before their states, so a run that dies in between is made
    up for by the next.  Months whose files are gone stay without a state."""
    spark = table.sparkSession
    now = file_state(spark, source, month)
    kept = read_if_any(spark, f"{path}/states", f"{month} date, state string")
    same = now[month].eqNullSafe(kept[month]) & (now["state"] == kept["state"])
    months = [r[0] for r in now.join(kept, same, "left_anti").select(month).collect()]  # a value a month folder
    if months:
        part = table.where(among(F.col(month), months))
        overwrite_partitions(month_sketches(part, month, cols), f"{path}/rows", [month])
    now.write.mode("overwrite").parquet(f"{path}/states-new")
    spark.read.schema(now.schema).parquet(f"{path}/states-new").write.mode("overwrite").parquet(f"{path}/states")
    return months


def among(col: Column, values: list) -> Column:
    """Whether a column has one of the values, which may include null."""
    known = [v for v in values if v is not None]
    return (col.isin(known) if known else F.lit(False)) | (col.isNull() if None in values else F.lit(False))


def stored_sketches(table: DataFrame, path: str, month: str, cols: list[str]) -> DataFrame:
    """The months' rows, of months that the table still has."""
    spark = table.sparkSession
    rows = spark.read.schema(month_sketches(table, month, cols).schema).parquet(f"{path}/rows")
    states = spark.read.schema(f"{month} date, state string").parquet(f"{path}/states")
    return rows.join(states.select(F.col(month).alias("_m")), rows[month].eqNullSafe(F.col("_m")), "left_semi")
