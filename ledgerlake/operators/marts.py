"""Marts: thin selects over a pre-aggregated intermediate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio6

MART_COLS = ["account_id", "as_of_date", "lot_count", "total_mv_usd", "total_cost_usd",
             "total_gain_usd", "cross_ccy_mv_usd", "max_position_mv"]


def portfolio_summary(intermediate: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """8 passed columns + two ratios.  Note the asymmetry: a zero/NULL cost
    gives a NULL market-to-cost ratio, a zero/NULL value gives weight 0."""
    return intermediate.select(
        *(keep or []), *MART_COLS,
        ratio6(F.col("total_mv_usd"), F.col("total_cost_usd"), None).alias("market_to_cost_ratio"),
        ratio6(F.col("cross_ccy_mv_usd"), F.col("total_mv_usd"), 0).alias("cross_ccy_weight"),
    )
