"""Intermediate joins: holdings enriched with security and account context.

Holdings are the only large side.  Each dimension is broadcast only after a
count proves it small; above that bound the planner falls back to a
sort-merge join and AQE splits skewed partitions of the holdings side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import join_dimension

ENRICHED_COLS = ["account_id", "account_name", "account_type", "base_currency",
                 "security_id", "asset_class", "asset_class_display", "sector",
                 "as_of_date", "market_value_usd", "cost_basis_usd", "unrealized_gain_usd",
                 "weight_in_portfolio", "is_cross_currency"]


def holdings_securities(h: DataFrame, sec: DataFrame) -> DataFrame:
    """Left outer on security_id: unmatched holdings keep NULL class/sector."""
    s = sec.select("security_id", "asset_class", "sector", "asset_class_display",
                   "currency_code", "country_code")
    return join_dimension(h, s, "security_id", "left")


def holdings_accounts(h: DataFrame, acc: DataFrame) -> DataFrame:
    a = acc.select("account_id", "name", "account_type", "base_currency", "is_active")
    return join_dimension(h, a.withColumnRenamed("is_active", "account_is_active"),
                          "account_id", "left")


def enriched(stg_h: DataFrame, stg_s: DataFrame, stg_a: DataFrame,
             extra: list[str] | None = None) -> DataFrame:
    """Both left joins; 14 columns, ``name`` renamed to ``account_name``."""
    h = stg_h.select("account_id", "security_id", "as_of_date", "quantity",
                     "market_value_usd", "cost_basis_usd", "unrealized_gain_usd",
                     "weight_in_portfolio", "currency", "is_cross_currency", *(extra or []))
    j = holdings_accounts(holdings_securities(h, stg_s), stg_a)
    return j.select(*[F.col("name").alias("account_name") if c == "account_name" else c
                      for c in ENRICHED_COLS], *(extra or []))
