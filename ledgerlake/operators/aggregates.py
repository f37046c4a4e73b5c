"""Aggregations.  All are hash aggregates with a partial (map-side) step, so
a hot key is combined inside each task before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import money_max, money_sum
from ..functions.sizing import join_dimension

MONEY = "decimal(38,2)"


def _rollup_measures() -> list:
    mv = F.col("market_value_usd")
    return [
        F.count(F.lit(1)).alias("lot_count"),
        money_sum(mv).alias("total_mv_usd"),
        money_sum("cost_basis_usd").alias("total_cost_usd"),
        money_sum("unrealized_gain_usd").alias("total_gain_usd"),
        money_sum(F.when(F.col("is_cross_currency") == 1, mv).otherwise(0)).alias("cross_ccy_mv_usd"),
        money_max(mv).alias("max_position_mv"),
    ]


ROLLUP_MEASURES = ["lot_count", "total_mv_usd", "total_cost_usd", "total_gain_usd",
                   "cross_ccy_mv_usd", "max_position_mv"]


def position_rollup(joined: DataFrame, variant: int) -> DataFrame:
    """Intermediate model ``variant``: grouping ``variant mod 3``
    (NULL asset class / sector is its own group)."""
    keys = list(K.GROUPINGS[variant % len(K.GROUPINGS)])
    return joined.groupBy(*keys).agg(*_rollup_measures())


def rollup_sets(joined: DataFrame, variants: list[int]) -> tuple[DataFrame, dict[int, int]]:
    """All distinct groupings of ``variants`` as GROUPING SETS of ONE
    aggregate (one scan, one join, one shuffle).  Returns the aggregate,
    which carries every key column plus ``_gid``, and the ``_gid`` of each
    variant.  Rows of a grouping hold NULL in keys outside it; a real NULL
    asset class or sector stays its own group because ``_gid`` separates
    the sets."""
    sets: list[list[str]] = []
    for v in variants:
        g = list(K.GROUPINGS[v % len(K.GROUPINGS)])
        if g not in sets:
            sets.append(g)
    if len(sets) == 1:
        agg = joined.groupBy(*sets[0]).agg(*_rollup_measures()).withColumn("_gid", F.lit(0).cast("long"))
        return agg, {v: 0 for v in variants}
    cols: list[str] = []
    for g in sets:
        cols += [c for c in g if c not in cols]
    agg = joined.groupingSets(sets, *cols).agg(*_rollup_measures(), F.grouping_id().alias("_gid"))

    def gid(v):
        g = K.GROUPINGS[v % len(K.GROUPINGS)]
        return sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in g)
    return agg, {v: gid(v) for v in variants}


def position_rollups(joined: DataFrame, variants: list[int]) -> list[DataFrame]:
    """One DataFrame per intermediate model, each a selection of the shared
    grouping-sets aggregate (use ``rollup_sets`` directly to consume all of
    them in one pass)."""
    agg, gids = rollup_sets(joined, variants)
    return [agg.where(F.col("_gid") == gids[v])
               .select(*K.GROUPINGS[v % len(K.GROUPINGS)], *ROLLUP_MEASURES) for v in variants]


def cross_currency_mv(h: DataFrame, keys: list[str]) -> DataFrame:
    """SUM(CASE WHEN cross THEN mv ELSE 0) next to the plain total."""
    mv = F.col("market_value_usd")
    return h.groupBy(*keys).agg(
        money_sum(mv).alias("total_mv_usd"),
        money_sum(F.when(F.col("is_cross_currency") == 1, mv).otherwise(0)).alias("cross_ccy_mv_usd"),
    )


def account_day(h: DataFrame) -> DataFrame:
    """The representative mart query: per account and date, distinct
    securities, total value and total gain."""
    return h.groupBy("account_id", "as_of_date").agg(
        F.count_distinct("security_id").alias("sec_count"),
        money_sum("market_value_usd").alias("total_mv"),
        money_sum("unrealized_gain").alias("total_gain"),
    )


def client_day(h: DataFrame, accounts: DataFrame) -> DataFrame:
    """Roll accounts up to their client per date.  The holdings are first
    reduced to account-days (partial aggregate), then joined to the small
    account table, then summed per client."""
    ad = h.groupBy("account_id", "as_of_date").agg(
        F.count(F.lit(1)).alias("n"),
        money_sum("market_value_usd").alias("mv"),
        money_sum("unrealized_gain").alias("gain"))
    j = join_dimension(ad, accounts.select("account_id", "client_id"), "account_id", "inner")
    # ``ad`` has one row per account and date, so counting rows counts
    # distinct accounts (no extra distinct-aggregation stage).
    return j.groupBy("client_id", "as_of_date").agg(
        F.count(F.lit(1)).alias("account_count"),
        F.sum("n").alias("position_count"),
        money_sum("mv").alias("total_mv"),
        money_sum("gain").alias("total_gain"),
    )


def natural_key_rows(h: DataFrame, keys=("account_id", "security_id", "as_of_date")) -> DataFrame:
    """One row per natural key via GROUP BY (not DISTINCT)."""
    return h.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("lot_count"),
        money_sum("market_value_usd").alias("total_mv_usd"),
    )


def table_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Gathered statistics per column: rows, distinct values, NULLs, min and
    max (as text), one row per column.

    One scan: each column is a grouping set of one aggregate that combines
    map-side, so only distinct values shuffle; the statistics then run over
    the values of all columns together.
    """
    vals = df.groupingSets([[c] for c in cols], *cols).agg(
        F.count(F.lit(1)).alias("_n"), F.grouping_id().alias("_gid"))

    def stats(i: int, c: str) -> F.Column:
        own = F.col("_gid") == sum(1 << (len(cols) - 1 - j) for j in range(len(cols)) if j != i)
        v = F.when(own, F.col(c))
        return F.struct(
            F.lit(c).alias("column_name"),
            F.coalesce(F.sum(F.when(own, F.col("_n"))), F.lit(0)).cast("long").alias("num_rows"),
            F.count_if(v.isNotNull()).alias("num_distinct"),
            F.coalesce(F.sum(F.when(own & F.col(c).isNull(), F.col("_n"))), F.lit(0)).cast("long")
            .alias("num_nulls"),
            F.min(v).cast("string").alias("low_value"),
            F.max(v).cast("string").alias("high_value"))

    one = vals.agg(F.array(*[stats(i, c) for i, c in enumerate(cols)]).alias("_s"))
    return one.select(F.explode("_s").alias("r")).select("r.*")
