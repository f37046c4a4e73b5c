"""Data-quality tests: not_null, unique, primary keys, required columns.

Every test on one model runs in a single aggregation pass (NULL counts) or
one grouped aggregate (duplicate keys); nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_null_failures(df: DataFrame, model: str, cols: list[str],
                      test: str = "not_null") -> DataFrame:
    """One row per column: failing rows where the column is NULL."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    rows = [F.struct(F.lit(model).alias("model"), F.lit(c).alias("column_name"),
                     F.lit(test).alias("test_name"), F.col(c).cast("long").alias("failures"))
            for c in cols]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def not_null_on_base(base: DataFrame, tests: list[tuple[str, str, "F.Column"]],
                     test: str = "not_null") -> DataFrame:
    """Not-null tests of several models that are projections of one base
    table, in ONE aggregation pass: ``tests`` holds (model, column, the
    model's expression for that column over the base columns)."""
    one = base.agg(*[F.count_if(e.isNull()).alias(f"_t{i}") for i, (_, _, e) in enumerate(tests)])
    rows = [F.struct(F.lit(m).alias("model"), F.lit(c).alias("column_name"),
                     F.lit(test).alias("test_name"), F.col(f"_t{i}").cast("long").alias("failures"))
            for i, (m, c, _) in enumerate(tests)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values (non-NULL) that occur more than once."""
    k = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keys]))
    return k.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def unique_on_base(base: DataFrame, tests: list[tuple[str, str, "F.Column"]]) -> DataFrame:
    """Unique tests of several models that are projections of one base
    table, in ONE scan and shuffle: each test's key is a grouping set;
    ``grouping_id`` keeps the sets apart and real NULL keys are skipped."""
    keys = [f"_k{i}" for i in range(len(tests))]
    proj = base.select(*[e.alias(k) for (_, _, e), k in zip(tests, keys)])
    if len(keys) == 1:
        g = proj.groupBy(keys[0]).agg(F.count(F.lit(1)).alias("n")).withColumn("_gid", F.lit(0))
        gid = [0]
    else:
        g = proj.groupingSets([[k] for k in keys], *keys).agg(
            F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_gid"))
        n = len(keys)
        gid = [sum(1 << (n - 1 - j) for j in range(n) if j != i) for i in range(n)]
    one = g.agg(*[F.count_if((F.col("_gid") == gid[i]) & F.col(k).isNotNull() & (F.col("n") > 1))
                  .alias(k) for i, k in enumerate(keys)])
    rows = [F.struct(F.lit(m).alias("model"), F.lit(c).alias("column_name"),
                     F.lit("unique").alias("test_name"), F.col(k).cast("long").alias("failures"))
            for (m, c, _), k in zip(tests, keys)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def unique_failures(df: DataFrame, model: str, col: str) -> DataFrame:
    return duplicate_keys(df, [col]).agg(
        F.lit(model).alias("model"), F.lit(col).alias("column_name"),
        F.lit("unique").alias("test_name"), F.count(F.lit(1)).alias("failures"))


def primary_key_check(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """Rows with a NULL key part and key values that repeat, in one grouped pass."""
    null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in keys])
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return (groups.agg(
        F.lit(table).alias("table_name"), F.lit(",".join(keys)).alias("key_columns"),
        F.coalesce(F.sum(F.when(null, F.col("n"))), F.lit(0)).cast("long").alias("null_key_rows"),
        F.count_if(~null & (F.col("n") > 1)).alias("duplicate_keys"))
            .withColumn("passed", (F.col("null_key_rows") == 0) & (F.col("duplicate_keys") == 0)))


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def summarize(results: DataFrame) -> DataFrame:
    """Pass / warn / error totals (a failing test is an error)."""
    return results.agg(
        F.count(F.lit(1)).alias("tests"),
        F.count_if(F.col("failures") == 0).alias("passed"),
        F.lit(0).cast("long").alias("warned"),
        F.count_if(F.col("failures") > 0).alias("errored"))
