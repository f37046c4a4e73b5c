"""Staging layer: typed, cleaned projections and the slice/window filters.

Filters are applied to the raw scan before any projection, so Catalyst
pushes them into the parquet reader (``PushedFilters``) and, for the month
column, prunes whole partition folders (``PartitionFilters``).
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import (asset_class_display, concentration_band,
                                 cross_currency_flag, fx_bucket)

# Columns the holdings model reads (explicit list: the scan is pruned to it).
HOLDINGS_SOURCE_COLS = ["account_id", "security_id", "as_of_date", "quantity",
                        "market_value_usd", "cost_basis_usd", "currency", "fx_rate",
                        "unrealized_gain", "weight_in_acct"]
SECURITIES_SOURCE_COLS = ["security_id", "cusip", "isin", "ticker", "security_name",
                          "asset_class", "sub_asset_class", "country", "currency", "sector",
                          "credit_rating", "issue_date", "maturity_date", "is_active"]
ACCOUNTS_SOURCE_COLS = ["account_id", "account_name", "client_id", "account_type",
                        "base_currency", "inception_date", "status", "region", "risk_profile"]


# ---------------------------------------------------------------- filters --

def resolve_slice(sid: str) -> str:
    """A scenario that shares another's data reads that slice (S6 -> S5)."""
    return K.SHARED_SLICES.get(sid, sid)


def scenario_slice(h: DataFrame, sid: str) -> DataFrame:
    return h.where(F.col("scenario_id") == resolve_slice(sid))


def latest_date(h: DataFrame) -> Column:
    """Default run date: the newest position date, as a scalar subquery.

    The newest month is found first (a partition column), so the second
    subquery reads a single month folder.
    """
    month = h.agg(F.max("as_of_month")).scalar()
    return h.where(F.col("as_of_month") == month).agg(F.max("as_of_date")).scalar()


def trailing_window(h: DataFrame, days: int = K.TRAILING_DAYS,
                    run_date: str | date | Column | None = None) -> DataFrame:
    """as_of_date >= run_date - days, plus the implied month predicate so the
    scan prunes month folders (the date predicate alone does not)."""
    if run_date is None:
        rd = latest_date(h)
    elif isinstance(run_date, Column):
        rd = run_date
    else:
        rd = F.lit(str(run_date)).cast("date")
    start = F.date_sub(rd, days)
    return h.where((F.col("as_of_date") >= start) &
                   (F.col("as_of_month") >= F.trunc(start, "MM")))


def key_prefix(df: DataFrame, col: str, prefix: str) -> DataFrame:
    return df.where(F.col(col).startswith(prefix))


def account_history(h: DataFrame, account_id: str, start: str, end: str) -> DataFrame:
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    return h.where((F.col("account_id") == account_id) &
                   F.col("as_of_date").between(s, e) &
                   F.col("as_of_month").between(F.trunc(s, "MM"), F.trunc(e, "MM")))


# ------------------------------------------------------------ projections --

def holdings_extra_columns(complexity: str) -> list[tuple[str, Column]]:
    """Extra staging columns by SQL complexity (simple/medium add none)."""
    if complexity == "extreme":
        return [
            ("concentration_flag", concentration_band(F.col("weight_in_acct"))),
            ("fx_bucket", fx_bucket(F.col("currency"))),
            ("grossed_up_mv", (F.col("market_value_usd") *
                               F.lit(K.GROSS_UP_FACTOR).cast("decimal(2,1)")).cast("decimal(23,3)")),
            ("return_pct", F.col("unrealized_gain").cast("double") /
             F.nullif(F.col("cost_basis_usd"), F.lit(0)).cast("double")),
        ]
    if complexity == "complex":
        gain = F.col("unrealized_gain")
        return [
            ("gross_gain", F.when(gain > 0, gain).otherwise(0).cast("decimal(20,2)")),
            ("gross_loss", F.when(gain < 0, gain).otherwise(0).cast("decimal(20,2)")),
        ]
    return []


def _named(exprs: list[tuple[str, Column]]) -> dict[str, Column]:
    return {name: e for name, e in exprs}


def stg_holdings_exprs(complexity: str = "medium") -> dict[str, Column]:
    """The staging projection of holdings: output name -> expression over
    raw columns (shared by the model and its data tests)."""
    return _named([
        ("account_id", F.col("account_id")),
        ("security_id", F.col("security_id")),
        ("as_of_date", F.col("as_of_date").cast("date")),
        ("quantity", F.col("quantity").cast("decimal(28,8)")),
        ("market_value_usd", F.col("market_value_usd").cast("decimal(20,2)")),
        ("cost_basis_usd", F.col("cost_basis_usd").cast("decimal(20,2)")),
        ("currency", F.upper("currency")),
        ("fx_rate", F.col("fx_rate").cast("decimal(20,8)")),
        ("unrealized_gain_usd", F.col("unrealized_gain").cast("decimal(20,2)")),
        ("weight_in_portfolio", F.col("weight_in_acct").cast("decimal(10,8)")),
        *holdings_extra_columns(complexity),
        ("is_cross_currency", cross_currency_flag(F.col("currency"))),
    ])


def _select(exprs: dict[str, Column]) -> list[Column]:
    return [e.alias(n) for n, e in exprs.items()]


def stg_holdings(raw: DataFrame, sid: str | None = None, pruning: bool = False,
                 complexity: str = "medium", run_date=None,
                 keep_month: bool = False) -> DataFrame:
    """Typed holdings for one slice (or all when ``sid`` is None)."""
    src = raw
    if pruning:
        src = trailing_window(src, run_date=run_date)
    if sid is not None:
        src = scenario_slice(src, sid)
    cols = HOLDINGS_SOURCE_COLS + (["as_of_month"] if keep_month else [])
    out = _select(stg_holdings_exprs(complexity)) + (["as_of_month"] if keep_month else [])
    return src.select(*cols).select(*out)


def stg_securities_exprs() -> dict[str, Column]:
    return _named([
        ("security_id", F.col("security_id")),
        ("preferred_id", F.upper(F.coalesce("cusip", "isin"))),
        ("cusip", F.upper("cusip")),
        ("isin", F.upper("isin")),
        ("ticker", F.upper("ticker")),
        ("security_name", F.col("security_name")),
        ("asset_class", F.upper("asset_class")),
        ("sub_asset_class", F.col("sub_asset_class")),
        ("country_code", F.col("country")),
        ("currency_code", F.upper("currency")),
        ("sector", F.col("sector")),
        ("credit_rating", F.coalesce(F.col("credit_rating"), F.lit(K.DEFAULT_RATING))),
        ("asset_class_display", asset_class_display(F.col("asset_class"))),
        ("issue_date", F.col("issue_date").cast("date")),
        ("maturity_date", F.col("maturity_date").cast("date")),
        ("is_active", F.col("is_active")),
    ])


def stg_securities(raw: DataFrame) -> DataFrame:
    return raw.select(*SECURITIES_SOURCE_COLS).select(*_select(stg_securities_exprs()))


def stg_accounts_exprs() -> dict[str, Column]:
    return _named([
        ("account_id", F.col("account_id")),
        ("name", F.col("account_name")),
        ("client_id", F.col("client_id")),
        ("account_type", F.upper("account_type")),
        ("base_currency", F.upper("base_currency")),
        ("inception_date", F.col("inception_date").cast("date")),
        ("status", F.upper("status")),
        ("region", F.col("region")),
        ("risk_profile", F.col("risk_profile")),
        ("is_active", F.when(F.upper("status") == "ACTIVE", 1).otherwise(0)),
    ])


def stg_accounts(raw: DataFrame) -> DataFrame:
    return raw.select(*ACCOUNTS_SOURCE_COLS).select(*_select(stg_accounts_exprs()))
