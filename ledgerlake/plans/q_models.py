"""Queries over the model layers: staging, joins, intermediates, marts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import (asset_class_display, concentration_band,
                                 cross_currency_flag, fx_bucket, money_sum)
from ..functions.sizing import join_dimension
from ..operators import aggregates, joins, marts, sketches, staging
from ..sources import store
from . import oracle_base as O
from .registry import query

W = O.with_ctes

# ------------------------------------------------------------- staging ----


@query("stg_holdings", W("SELECT * FROM stg_holdings"))
def stg_holdings(lake):
    return lake.stg_holdings()


@query("stg_holdings_complex", W(O.stg_holdings_sql(complexity="complex")))
def stg_holdings_complex(lake):
    return lake.stg_holdings(complexity="complex")


@query("stg_holdings_extreme", W(O.stg_holdings_sql(complexity="extreme")))
def stg_holdings_extreme(lake):
    return lake.stg_holdings(complexity="extreme")


@query("stg_securities", W("SELECT * FROM stg_securities"))
def stg_securities(lake):
    return lake.stg_securities()


@query("stg_accounts", W("SELECT * FROM stg_accounts"))
def stg_accounts(lake):
    return lake.stg_accounts()


@query("prj_cross_currency", W("""
SELECT currency AS raw_currency, CASE WHEN currency <> 'USD' THEN 1 ELSE 0 END AS is_cross_currency,
       count(*) AS n_rows
FROM raw_holdings GROUP BY 1, 2"""))
def prj_cross_currency(lake):
    h = lake.holdings
    return (h.select(F.col("currency").alias("raw_currency"),
                     cross_currency_flag(F.col("currency")).alias("is_cross_currency"))
            .groupBy("raw_currency", "is_cross_currency").agg(F.count(F.lit(1)).alias("n_rows")))


@query("prj_concentration_band", W("""
SELECT CASE """ + " ".join(f"WHEN weight_in_acct > {b} THEN '{lab}'" for b, lab in K.CONCENTRATION_BANDS)
                + f""" ELSE '{K.CONCENTRATION_DEFAULT}' END AS concentration_flag,
       count(*) AS n_rows, CAST(sum(market_value_usd) AS DECIMAL(38,2)) AS total_mv_usd
FROM raw_holdings GROUP BY 1"""))
def prj_concentration_band(lake):
    h = lake.holdings
    return (h.select(concentration_band(F.col("weight_in_acct")).alias("concentration_flag"),
                     "market_value_usd")
            .groupBy("concentration_flag")
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 money_sum("market_value_usd").alias("total_mv_usd")))


@query("prj_fx_bucket", W("""
SELECT currency AS raw_currency,
       CASE WHEN currency = 'USD' THEN 'DOMESTIC' WHEN currency IN ('EUR','GBP','CHF') THEN 'MAJOR_FX'
            ELSE 'EM_FX' END AS fx_bucket,
       count(*) AS n_rows
FROM raw_holdings GROUP BY 1, 2"""))
def prj_fx_bucket(lake):
    h = lake.holdings
    return (h.select(F.col("currency").alias("raw_currency"),
                     fx_bucket(F.col("currency")).alias("fx_bucket"))
            .groupBy("raw_currency", "fx_bucket").agg(F.count(F.lit(1)).alias("n_rows")))


@query("prj_grossed_up", W("""
SELECT account_id, security_id, as_of_date, market_value_usd, grossed_up_mv
FROM (""" + O.stg_holdings_sql(complexity="extreme") + ")"))
def prj_grossed_up(lake):
    return lake.stg_holdings(complexity="extreme").select(
        "account_id", "security_id", "as_of_date", "market_value_usd", "grossed_up_mv")


@query("prj_return_pct", W("""
SELECT account_id, security_id, as_of_date, unrealized_gain_usd, cost_basis_usd, return_pct
FROM (""" + O.stg_holdings_sql(complexity="extreme") + ")"))
def prj_return_pct(lake):
    return lake.stg_holdings(complexity="extreme").select(
        "account_id", "security_id", "as_of_date", "unrealized_gain_usd", "cost_basis_usd",
        "return_pct")


@query("prj_gain_loss_split", W("""
SELECT account_id, security_id, as_of_date, unrealized_gain_usd, gross_gain, gross_loss
FROM (""" + O.stg_holdings_sql(complexity="complex") + ")"))
def prj_gain_loss_split(lake):
    return lake.stg_holdings(complexity="complex").select(
        "account_id", "security_id", "as_of_date", "unrealized_gain_usd", "gross_gain",
        "gross_loss")


@query("prj_preferred_id", W("""
SELECT security_id, cusip AS raw_cusip, isin AS raw_isin, upper(coalesce(cusip, isin)) AS preferred_id
FROM raw_securities"""))
def prj_preferred_id(lake):
    s = lake.securities
    return s.select("security_id", F.col("cusip").alias("raw_cusip"),
                    F.col("isin").alias("raw_isin"),
                    F.upper(F.coalesce("cusip", "isin")).alias("preferred_id"))


@query("prj_rating_default", W("""
SELECT coalesce(credit_rating, 'NR') AS credit_rating, count(*) AS n_securities
FROM raw_securities GROUP BY 1"""))
def prj_rating_default(lake):
    return (lake.securities
            .select(F.coalesce(F.col("credit_rating"), F.lit(K.DEFAULT_RATING)).alias("credit_rating"))
            .groupBy("credit_rating").agg(F.count(F.lit(1)).alias("n_securities")))


@query("prj_asset_class_label", W("""
SELECT asset_class AS raw_asset_class,
       CASE WHEN asset_class = 'EQUITY' THEN 'Equity' WHEN asset_class = 'FIXED_INCOME' THEN 'Fixed Income'
            WHEN asset_class = 'FUND' THEN 'Pooled Vehicle' ELSE 'Other' END AS asset_class_display,
       count(*) AS n_securities
FROM raw_securities GROUP BY 1, 2"""))
def prj_asset_class_label(lake):
    s = lake.securities
    return (s.select(F.col("asset_class").alias("raw_asset_class"),
                     asset_class_display(F.col("asset_class")).alias("asset_class_display"))
            .groupBy("raw_asset_class", "asset_class_display")
            .agg(F.count(F.lit(1)).alias("n_securities")))


# ------------------------------------------------------------- filters ----


@query("flt_scenario_slice", W(O.stg_holdings_sql(sid="S2")))
def flt_scenario_slice(lake):
    return lake.stg_holdings(sid="S2")


@query("flt_trailing_30d", W(O.stg_holdings_sql(pruning=True)))
def flt_trailing_30d(lake):
    return lake.stg_holdings(pruning=True)


# A scenario's own members: the holdings of its securities in its accounts.
@query("flt_key_prefix", W("""
SELECT h.account_id, h.security_id, h.as_of_date, h.market_value_usd
FROM raw_holdings h
JOIN (SELECT security_id FROM raw_securities WHERE security_id LIKE 'S2%') s ON s.security_id = h.security_id
JOIN (SELECT account_id FROM raw_accounts WHERE account_id LIKE 'A2%') a ON a.account_id = h.account_id"""))
def flt_key_prefix(lake):
    s = staging.key_prefix(lake.securities, "security_id", "S2").select("security_id")
    a = staging.key_prefix(lake.accounts, "account_id", "A2").select("account_id")
    h = lake.holdings.select("account_id", "security_id", "as_of_date", "market_value_usd")
    return join_dimension(join_dimension(h, s, "security_id", "inner"), a, "account_id", "inner")


@query("flt_account_history", W("""
SELECT account_id, security_id, as_of_date, market_value_usd, unrealized_gain
FROM raw_holdings WHERE account_id = 'A2_00001' AND as_of_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'"""))
def flt_account_history(lake):
    return staging.account_history(lake.holdings, "A2_00001", "1998-01-01", "1998-12-31").select(
        "account_id", "security_id", "as_of_date", "market_value_usd", "unrealized_gain")


@query("flt_asset_class", W("SELECT * FROM stg_securities WHERE asset_class = 'EQUITY'"))
def flt_asset_class(lake):
    return lake.stg_securities().where(F.col("asset_class") == "EQUITY")


# --------------------------------------------------------------- joins ----


@query("jn_holdings_securities", W("""
SELECT h.account_id, h.security_id, h.as_of_date, h.market_value_usd, s.asset_class, s.sector
FROM stg_holdings h LEFT JOIN stg_securities s ON s.security_id = h.security_id"""))
def jn_holdings_securities(lake):
    return joins.holdings_securities(lake.stg_holdings(), lake.stg_securities()).select(
        "account_id", "security_id", "as_of_date", "market_value_usd", "asset_class", "sector")


@query("jn_holdings_accounts", W("""
SELECT h.account_id, h.security_id, h.as_of_date, h.market_value_usd, a.name AS account_name,
       a.account_type, a.is_active AS account_is_active
FROM stg_holdings h LEFT JOIN stg_accounts a ON a.account_id = h.account_id"""))
def jn_holdings_accounts(lake):
    return joins.holdings_accounts(lake.stg_holdings(), lake.stg_accounts()).select(
        "account_id", "security_id", "as_of_date", "market_value_usd",
        F.col("name").alias("account_name"), "account_type", "account_is_active")


@query("int_joined", W("SELECT * FROM int_joined"))
def int_joined(lake):
    return lake.enriched()


# -------------------------------------------------------- aggregations ----

for _i, _name in enumerate(["int_by_security", "int_by_asset_class", "int_by_sector"]):
    def _mk(i):
        return lambda lake: aggregates.position_rollup(lake.enriched(), i)
    query(_name, W(O.rollup_sql(_i)))(_mk(_i))

for _i in range(3):
    def _mk_mart(i):
        return lambda lake: marts.portfolio_summary(aggregates.position_rollup(lake.enriched(), i))
    query(f"fct_portfolio_summary_{_i + 1:03d}",
          W(O.mart_sql(f"({O.rollup_sql(_i)})")))(_mk_mart(_i))


@query("agg_cross_ccy_mv", W("""
SELECT account_id, CAST(sum(market_value_usd) AS DECIMAL(38,2)) AS total_mv_usd,
       CAST(sum(CASE WHEN is_cross_currency = 1 THEN market_value_usd ELSE 0 END) AS DECIMAL(38,2))
         AS cross_ccy_mv_usd
FROM stg_holdings GROUP BY account_id"""))
def agg_cross_ccy_mv(lake):
    return aggregates.cross_currency_mv(lake.stg_holdings(), ["account_id"])


_ACCOUNT_DAY = """
SELECT account_id, as_of_date, count(DISTINCT security_id) AS sec_count,
       CAST(sum(market_value_usd) AS DECIMAL(38,2)) AS total_mv,
       CAST(sum(unrealized_gain) AS DECIMAL(38,2)) AS total_gain
FROM raw_holdings WHERE scenario_id = 'S5' {extra} GROUP BY account_id, as_of_date"""


@query("agg_account_day", W(_ACCOUNT_DAY.format(extra="")))
def agg_account_day(lake):
    return aggregates.account_day(staging.scenario_slice(lake.holdings, "S5"))


@query("agg_account_day_pruned", W(_ACCOUNT_DAY.format(
    extra=f"AND as_of_date >= (SELECT max(as_of_date) FROM raw_holdings) - {K.TRAILING_DAYS}")))
def agg_account_day_pruned(lake):
    h = staging.trailing_window(lake.holdings)
    return aggregates.account_day(staging.scenario_slice(h, "S6"))


@query("agg_client_day", W("""
SELECT a.client_id, h.as_of_date, count(DISTINCT h.account_id) AS account_count,
       count(*) AS position_count,
       CAST(sum(h.market_value_usd) AS DECIMAL(38,2)) AS total_mv,
       CAST(sum(h.unrealized_gain) AS DECIMAL(38,2)) AS total_gain
FROM raw_holdings h JOIN raw_accounts a ON a.account_id = h.account_id
GROUP BY a.client_id, h.as_of_date"""))
def agg_client_day(lake):
    return aggregates.client_day(lake.holdings, lake.accounts)


_STAT_COLS = ["account_id", "security_id", "as_of_date", "market_value_usd", "cost_basis_usd",
              "currency", "weight_in_acct", "scenario_id"]


@query("agg_table_stats", W("\nUNION ALL\n".join(f"""
SELECT '{c}' AS column_name, count(*) AS num_rows, count(DISTINCT {c}) AS num_distinct,
       count(*) - count({c}) AS num_nulls, CAST(min({c}) AS VARCHAR) AS low_value,
       CAST(max({c}) AS VARCHAR) AS high_value FROM raw_holdings""" for c in _STAT_COLS)))
def agg_table_stats(lake):
    return aggregates.table_stats(lake.holdings, _STAT_COLS)


@query("agg_sketch_stats", W("\nUNION ALL\n".join(f"""
SELECT '{c}' AS column_name, count(*) AS num_rows, count(*) - count({c}) AS num_nulls,
       CAST(min({c}) AS VARCHAR) AS low_value, CAST(max({c}) AS VARCHAR) AS high_value, true AS close
FROM raw_holdings""" for c in _STAT_COLS)))
def agg_sketch_stats(lake):
    """The same statistics merged from a stored row a month; ``close`` says whether the distinct
    values are estimated within three standard errors of the exact count."""
    source = store.build(lake.spark, lake.sf_dir, "raw_holdings")
    path = f"{lake.sink_path('holdings_sketches')}/{source.rsplit('/', 1)[1]}"
    sketches.refresh(lake.holdings, source, path, "as_of_month", _STAT_COLS)
    rows = sketches.merged(sketches.stored_sketches(lake.holdings, path, "as_of_month", _STAT_COLS), _STAT_COLS)
    exact = aggregates.table_stats(lake.holdings, _STAT_COLS).select("column_name", F.col("num_distinct").alias("exact"))
    near = F.abs(F.col("num_distinct") - F.col("exact")) <= F.greatest(F.col("exact") * sketches.ERROR, F.lit(1.0))
    return (rows.join(exact, "column_name")
            .select("column_name", "num_rows", "num_nulls", "low_value", "high_value", near.alias("close")))


@query("so_natural_key_dedup", W("""
SELECT account_id, security_id, as_of_date, count(*) AS lot_count,
       CAST(sum(market_value_usd) AS DECIMAL(38,2)) AS total_mv_usd
FROM raw_holdings GROUP BY account_id, security_id, as_of_date"""))
def so_natural_key_dedup(lake):
    return aggregates.natural_key_rows(lake.holdings)
