"""Weights and last-row-wins selections, written skew-safe.

A window ``PARTITION BY account, date`` would put every row of a hot group
into one task.  Instead the group total is a partial aggregate joined back
(AQE splits a skewed join partition), and "last row per group" is a
``max_by`` aggregate, which combines map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.fixtures import account_day_totals, weight_column


def position_weight(h: DataFrame) -> DataFrame:
    """mv / SUM(mv) within account and date, 8 decimals."""
    totals = account_day_totals(h)
    j = h.join(totals, ["account_id", "as_of_date"], "left")
    return j.select("account_id", "security_id", "as_of_date", "market_value_usd",
                    weight_column(F.col("market_value_usd"), F.col("_acct_total"))
                    .alias("weight_runtime"))


def weight_agreement(h: DataFrame) -> DataFrame:
    """Stored weight against a weight worked out here, apart from the rule that
    stored it: rows and mismatches."""
    totals = (h.groupBy("account_id", "as_of_date")
              .agg(F.expr("sum(CAST(market_value_usd * 100 AS DECIMAL(38,0)))").alias("_cents")))
    j = h.join(totals, ["account_id", "as_of_date"], "left")
    rt = F.expr("CAST(round(CAST(market_value_usd AS DOUBLE) / CASE WHEN _cents < 100 THEN 1.0D "
                "ELSE CAST(CAST(_cents AS DECIMAL(36,0)) / 100 AS DOUBLE) END, 8) AS DECIMAL(10,8))")
    return j.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.count_if(~F.col("weight_in_acct").eqNullSafe(rt)).alias("n_mismatch"),
                 F.count_if(F.col("weight_in_acct") < 1).alias("n_shared_slots"))


def latest_per_group(df: DataFrame, keys: list[str], order: list[str],
                     cols: list[str]) -> DataFrame:
    """The row with the greatest ``order`` tuple per ``keys`` (ties broken by
    the later order columns), as one aggregate."""
    best = F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(*[F.col(c) for c in order]))
    return (df.groupBy(*keys).agg(best.alias("_r"))
              .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols]))
