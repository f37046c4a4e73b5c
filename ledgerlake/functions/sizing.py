"""Size checks that guard broadcast joins and partition counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

# A side is broadcast only when its exact row count times its projected row
# width is below this; above it the planner's shuffle join is used.
BROADCAST_MAX_BYTES = 64 * 1024 * 1024

_WIDTH = {T.StringType: 32, T.LongType: 8, T.DoubleType: 8, T.IntegerType: 4, T.DateType: 4,
          T.TimestampType: 8, T.TimestampNTZType: 8, T.BooleanType: 1, T.DecimalType: 16,
          T.ShortType: 2, T.ByteType: 1, T.FloatType: 4}


def row_width(schema: T.StructType) -> int:
    """Estimated in-memory bytes per row (strings at a conservative 32)."""
    return 16 + sum(_WIDTH.get(type(f.dataType), 64) for f in schema.fields)


def sized_broadcast(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast ``df`` if an exact count, taken now, times its row width proves
    it small; otherwise leave the strategy to the planner (sort-merge join,
    with AQE splitting skewed partitions)."""
    return F.broadcast(df) if df.count() * row_width(df.schema) <= max_bytes else df


HEAVY_ROWS = 1_000_000  # a key with more is not left to one task


def apart(df: DataFrame, key: str, most: int = HEAVY_ROWS) -> tuple[DataFrame, DataFrame]:
    """The rows of keys (null is one) with at most ``most`` rows, and those of the others: a table
    of n rows has fewer than n / ``most`` such keys, so their list is small."""
    heavy = (df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
             .where(F.col("_n") > most).select("_key"))
    same = F.col(key).eqNullSafe(F.col("_key"))
    return df.join(F.broadcast(heavy), same, "left_anti"), df.join(F.broadcast(heavy), same, "left_semi")


def join_dimension(fact: DataFrame, dim: DataFrame, on, how: str = "left",
                   max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Join a (usually small) dimension; only the columns the caller selected
    into ``dim`` are counted and shipped."""
    return fact.join(sized_broadcast(dim, max_bytes), on=on, how=how)
