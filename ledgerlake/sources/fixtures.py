"""Raw portfolio tables derived from the driver's tables (FIXTURES.md §3).

Each function reads only the columns it needs; Catalyst prunes the parquet
scan to them.  Nothing here collects data to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import cycle_pick, dec, money_sum, padded_id
from ..functions.sizing import HEAVY_ROWS, apart, sized_broadcast


def read_input(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def member_id(letter: str, key: str, width: int) -> F.Column:
    """A dimension key that starts with the scenario it was made for, such as
    ``S3_000010``: scenario ``key % 8 + 1``."""
    return F.concat(F.lit(letter), (F.pmod(key, F.lit(8)) + 1).cast("string"),
                    padded_id("_", key, width))


def held_security() -> F.Column:
    """The security of a holding; one order in 40 names one that is not listed."""
    known = member_id("S", "l_partkey", 6)
    return F.when(F.pmod("l_orderkey", F.lit(40)) == 0, padded_id("S9_", "l_partkey", 6)).otherwise(known)


LOT_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _mv_cost(li: DataFrame, *more: str) -> DataFrame:
    mv = dec("l_extendedprice", 20, 2)
    disc = dec("l_discount", 4, 2)
    tax = dec("l_tax", 4, 2)
    cost = (F.when(F.pmod("l_orderkey", F.lit(97)) == 0, F.lit(0).cast("decimal(20,2)"))
            .when(F.pmod("l_orderkey", F.lit(101)) == 0, F.lit(None).cast("decimal(20,2)"))
            .otherwise((mv * (F.lit(1) - disc) * (F.lit(1) + tax)).cast("decimal(20,2)")))
    ccy = cycle_pick(K.CURRENCIES, "l_orderkey")
    currency = (F.when(F.pmod("l_orderkey", F.lit(89)) == 0, F.lit(None).cast("string"))
                .when(F.pmod("l_orderkey", F.lit(83)) == 0, F.lower(ccy))
                .otherwise(ccy))
    return li.select(
        member_id("A", "l_suppkey", 5).alias("account_id"),
        held_security().alias("security_id"),
        F.col("l_shipdate").cast("date").alias("as_of_date"),
        dec("l_quantity", 28, 8).alias("quantity"),
        mv.alias("market_value_usd"),
        cost.alias("cost_basis_usd"),
        currency.alias("currency"),
        dec(F.lit(10) + F.lit(7) * F.col("l_linenumber"), 20, 8).alias("price_local"),
        dec(F.lit(1) + tax, 20, 8).alias("fx_rate"),
        cycle_pick(K.SLICE_CYCLE, "l_orderkey").alias("scenario_id"),
        *more,
    )


def account_day_totals(h: DataFrame) -> DataFrame:
    """SUM(mv) per account and date: a partial (map-side) aggregate, so a hot
    account-day never has to sit in one task the way a window would."""
    return h.groupBy("account_id", "as_of_date").agg(
        money_sum("market_value_usd").alias("_acct_total"))


def weight_column(mv, total) -> F.Column:
    w = F.round(mv.cast("double") / F.greatest(total.cast("double"), F.lit(1.0)), 8)
    return w.cast("decimal(10,8)")


def holding_lots(spark: SparkSession, sf_dir: str, most: int = HEAVY_ROWS) -> DataFrame:
    """Line items with their weight in their account-day and the columns that holdings are stored by.

    An account is one ``l_suppkey``.  Only these narrow columns are shuffled, once to their
    account-day and once to their folder; ``holdings_of`` makes the holdings there.  The lines of an
    account with more than ``most`` are combined before the shuffle and joined back
    instead, so no hot account-day sits in one task."""
    li = read_input(spark, sf_dir, "lineitem").select(*LOT_COLS, F.col("l_shipdate").cast("date").alias("l_shipdate"))
    few, many = apart(li, "l_suppkey", most)
    keys, mv = ["l_suppkey", "l_shipdate"], dec("l_extendedprice", 20, 2)
    known = F.col("l_suppkey").isNotNull() & F.col("l_shipdate").isNotNull()  # a null key has no total
    few = few.repartition(*keys).withColumn("_mv", mv)
    few = few.withColumn("_acct_total", F.when(known, F.sum("_mv").over(Window.partitionBy(*keys)).cast("decimal(38,2)")))
    many = many.withColumn("_mv", mv)
    many = many.join(many.groupBy(*keys).agg(money_sum("_mv").alias("_acct_total")), keys, "left")
    return few.unionByName(many).select(
        *LOT_COLS, "l_shipdate", weight_column(F.col("_mv"), F.col("_acct_total")).alias("weight_in_acct"),
        F.trunc("l_shipdate", "MM").alias("as_of_month"), cycle_pick(K.SLICE_CYCLE, "l_orderkey").alias("scenario_id"))


def raw_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdings with stored gain, weight and the month partition column."""
    return holdings_of(holding_lots(spark, sf_dir))


def holdings_of(lots: DataFrame) -> DataFrame:
    return _mv_cost(lots, "weight_in_acct", "as_of_month").select(
        "account_id", "security_id", "as_of_date", "as_of_month",
        "quantity", "market_value_usd", "cost_basis_usd", "currency",
        "price_local", "fx_rate",
        (F.col("market_value_usd") - F.col("cost_basis_usd")).cast("decimal(20,2)")
        .alias("unrealized_gain"),
        "weight_in_acct", "scenario_id",
    )


def raw_holdings_unweighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdings before the weight is stored (input of the weight operators)."""
    h = _mv_cost(read_input(spark, sf_dir, "lineitem"))
    return h.withColumn("unrealized_gain",
                        (F.col("market_value_usd") - F.col("cost_basis_usd")).cast("decimal(20,2)"))


def raw_securities(spark: SparkSession, sf_dir: str, with_defaults: bool = True) -> DataFrame:
    p = read_input(spark, sf_dir, "part")
    ac = cycle_pick(K.ASSET_CLASSES, "p_partkey")
    cols = [
        member_id("S", "p_partkey", 6).alias("security_id"),
        F.when(F.pmod("p_partkey", F.lit(7)) == 0, F.lit(None).cast("string"))
        .otherwise(padded_id("c", "p_partkey", 8)).alias("cusip"),
        padded_id("us", "p_partkey", 10).alias("isin"),
        padded_id("t", "p_partkey", 5).alias("ticker"),
        F.col("p_name").alias("security_name"),
        F.when(F.pmod("p_partkey", F.lit(61)) == 0, F.lower(ac)).otherwise(ac).alias("asset_class"),
        F.concat(F.substring(ac, 1, 3), F.lit("_"),
                 F.pmod("p_partkey", F.lit(5)).cast("string")).alias("sub_asset_class"),
        cycle_pick(K.COUNTRIES, "p_size").alias("country"),
        F.lower(cycle_pick(K.CURRENCIES, "p_partkey")).alias("currency"),
        cycle_pick(K.SECTORS, "p_size").alias("sector"),
        F.when(F.pmod("p_size", F.lit(6)) == 5, F.lit(None).cast("string"))
        .otherwise(cycle_pick(K.RATINGS, "p_size")).alias("credit_rating"),
        F.date_add(F.lit("2000-01-01").cast("date"), F.col("p_size").cast("int")).alias("issue_date"),
        F.date_add(F.lit("2000-01-01").cast("date"), F.col("p_size").cast("int") + 3650)
        .alias("maturity_date"),
    ]
    if with_defaults:
        cols.append(F.lit(1).alias("is_active"))
    return p.select(*cols)


def raw_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_input(spark, sf_dir, "supplier")
    n = sized_broadcast(read_input(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    r = sized_broadcast(read_input(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    j = (s.join(n, s.s_nationkey == n.n_nationkey, "inner")
          .join(r, F.col("n_regionkey") == r.r_regionkey, "inner"))
    status = (F.when(F.col("s_acctbal") < 0, "closed")
              .when(F.pmod("s_suppkey", F.lit(2)) == 0, "ACTIVE")
              .otherwise("Active"))
    return j.select(
        member_id("A", "s_suppkey", 5).alias("account_id"),
        F.col("s_name").alias("account_name"),
        padded_id("CLI", F.floor(F.col("s_suppkey") / 5), 5).alias("client_id"),
        F.lower(cycle_pick(K.ACCOUNT_TYPES, "s_suppkey")).alias("account_type"),
        F.lower(cycle_pick(K.CURRENCIES, "s_nationkey")).alias("base_currency"),
        F.date_add(F.lit("2015-01-01").cast("date"),
                   F.pmod("s_suppkey", F.lit(2000)).cast("int")).alias("inception_date"),
        status.alias("status"),
        F.col("r_name").alias("region"),
        cycle_pick(K.RISK_PROFILES, "s_suppkey").alias("risk_profile"),
    )


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_input(spark, sf_dir, "orders")
    return o.select(
        padded_id("T", "o_orderkey", 10).alias("transaction_id"),
        member_id("A", "o_custkey", 5).alias("account_id"),
        member_id("S", "o_orderkey", 6).alias("security_id"),
        F.col("o_orderdate").cast("date").alias("trade_date"),
        F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("trade_month"),
        cycle_pick(K.TXN_TYPES, "o_orderkey").alias("transaction_type"),
        dec("o_totalprice", 20, 2).alias("gross_amount_usd"),
        cycle_pick(K.SLICE_CYCLE, "o_orderkey").alias("scenario_id"),
    )


def _phase(event_type) -> F.Column:
    expr = None
    for et, ph in K.EVENT_PHASE:
        cond = event_type == et
        expr = F.when(cond, ph) if expr is None else expr.when(cond, ph)
    return expr


def stress_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-metric rows, one per event."""
    e = read_input(spark, sf_dir, "events")
    sid = F.concat(F.lit("S"), (F.pmod("user_id", F.lit(8)) + 1).cast("string"))
    phase = _phase(F.col("event_type"))
    dur = dec("value", 12, 3)
    # value has at most 2 decimals: exact micro-second offset.
    micros = F.round(F.col("value") * 100).cast("long") * 10000
    return e.select(
        (F.col("event_id") + 1).alias("metric_id"),
        sid.alias("scenario_id"),
        phase.alias("phase"),
        F.col("ts").alias("started_at"),
        (F.col("ts") + F.make_dt_interval(secs=(micros / F.lit(1000000)).cast("decimal(18,6)")))
        .alias("finished_at"),
        dur.alias("duration_sec"),
        F.when(phase.isin("collect_stats", "dbt_compile"), F.lit(0).cast("long"))
        .otherwise(F.col("event_id") * 100).alias("rows_actual"),
        F.when(sid == "S7", F.lit(1_100_000_000).cast("long"))
        .when(sid == "S8", F.lit(5_000_000_000).cast("long"))
        .otherwise(F.lit(0).cast("long")).alias("rows_projected"),
        dec(F.col("user_id") * 60, 10, 2).alias("peak_mem_mb"),
        dec(F.pmod("user_id", F.lit(101)), 6, 2).alias("avg_cpu_pct"),
    )


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log line per event; a run is one (scenario, phase)."""
    e = read_input(spark, sf_dir, "events")
    w = F.pmod("user_id", F.lit(9)).cast("string")
    er = F.pmod("user_id", F.lit(4)).cast("string")
    kind = F.pmod("event_id", F.lit(4))
    line = (F.when(kind == 0, F.concat(w, F.lit(" of 9 OK")))
            .when(kind == 1, F.concat(F.lit("Completed with "), w, F.lit(" warnings and "),
                                      er, F.lit(" errors")))
            .when(kind == 2, F.concat(F.col("event_id").cast("string"), F.lit(" rows affected")))
            .otherwise(F.concat(F.lit("WARN model "), w, F.lit(" ERROR model "), er)))
    return e.select(
        F.col("event_id").alias("line_no"),
        F.concat(F.lit("S"), (F.pmod("user_id", F.lit(8)) + 1).cast("string")).alias("scenario_id"),
        _phase(F.col("event_type")).alias("phase"),
        line.alias("line"),
    )
