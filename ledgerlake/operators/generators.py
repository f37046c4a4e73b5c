"""Deterministic, set-based versions of the synthetic-load operators.

Randomness is replaced by hashes of the keys, so a rerun (or a retried task)
produces the same rows.  No cross join is used: calendars are generated per
row with ``sequence``/``explode`` and joined to a one-row-per-scenario side.
"""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import cycle_pick, half_up_div, padded_id
from ..functions.sizing import BROADCAST_MAX_BYTES
from ..session import checkpoint_root
from ..sources.catalog import scenario_config, slice_map
from ..sources.fixtures import account_day_totals, weight_column
from .ranks import PACK_BITS, block_of, halves, numbered, packed, permuted, slot_keys, tiles, unpacked


def _slice_holdings(h: DataFrame, spark: SparkSession) -> DataFrame:
    """Holdings labelled with every scenario that reads them (S5 rows also
    serve S6): a join to the 8-row slice map."""
    return h.join(F.broadcast(slice_map(spark)), h.scenario_id == F.col("slice_id"), "inner") \
            .drop(h.scenario_id)


def business_days(h: DataFrame, spark: SparkSession) -> DataFrame:
    """Per scenario: weekdays among ``n_days`` days from the slice's first
    position date, with the number of positions held that day."""
    sh = _slice_holdings(h.select("scenario_id", "as_of_date"), spark)
    base = sh.groupBy("scenario_id").agg(F.min("as_of_date").alias("base_date"))
    cfg = scenario_config(spark).select("scenario_id", "n_days")
    cal = (base.join(F.broadcast(cfg), "scenario_id")
           .select("scenario_id", F.explode(F.sequence(
               F.col("base_date"), F.date_add("base_date", F.col("n_days") - 1))).alias("cal_date"))
           .where(F.weekday("cal_date") < 5))
    per_day = sh.groupBy("scenario_id", F.col("as_of_date").alias("cal_date")) \
                .agg(F.count(F.lit(1)).alias("n_positions"))
    return (cal.join(per_day, ["scenario_id", "cal_date"], "left")
            .select("scenario_id", "cal_date", F.weekday("cal_date").cast("long").alias("weekday"),
                    F.coalesce("n_positions", F.lit(0)).cast("long").alias("n_positions")))


def position_slots(h: DataFrame, spark: SparkSession) -> DataFrame:
    """Account x business-day grid per scenario.  Each account row expands
    its own calendar; the only join is to one base row per scenario."""
    sh = _slice_holdings(h.select("scenario_id", "account_id", "as_of_date"), spark)
    base = sh.groupBy("scenario_id").agg(F.min("as_of_date").alias("base_date"))
    cfg = scenario_config(spark).select("scenario_id", "n_days")
    accts = sh.groupBy("scenario_id", "account_id").agg(F.count(F.lit(1)).alias("_n"))
    per = F.broadcast(base.join(F.broadcast(cfg), "scenario_id"))
    return (accts.join(per, "scenario_id")
            .select("scenario_id", "account_id", F.explode(F.sequence(
                F.col("base_date"), F.date_add("base_date", F.col("n_days") - 1))).alias("slot_date"))
            .where(F.weekday("slot_date") < 5))


def member_ranks(securities: DataFrame, work: str) -> DataFrame:
    """The listed securities of each scenario with dense ranks: scenario_id, security_id, rank, n."""
    sid = F.substring("security_id", 1, 2)
    listed = (securities.select("security_id").filter(F.col("security_id").isNotNull()).distinct()
              .select(sid.alias("scenario_id"), "security_id"))
    return numbered(listed, ["scenario_id"], ["security_id"], work)


def sample_k(h: DataFrame, securities: DataFrame, spark: SparkSession, work: str | None = None,
             max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Per scenario, account and business day, min(k, population) distinct listed
    securities of the scenario, drawn at random without ranking the population per
    slot: a slot's r-th draw is the r-th place of the slot's own permutation of
    the members' dense ranks.  ``work`` is a folder for the ranks.

    There are many more draws than slots or members, so they stay in the task that makes
    them: the members are broadcast as packed names, in tiles below ``max_bytes``, and
    the draws of a tile's scenarios are made once a tile.  Only more than MOST_TILES
    are joined by a shuffle of the draws."""
    work = work or f"{checkpoint_root(spark)}/ledgerlake-ranks/{uuid.uuid4().hex}"
    ranked = member_ranks(securities, f"{work}/sorted")
    ranked.write.mode("overwrite").parquet(f"{work}/ranks")
    members = spark.read.schema(ranked.schema).parquet(f"{work}/ranks")
    cfg = scenario_config(spark).select("scenario_id", "holdings_per_slot")
    population = (members.groupBy("scenario_id").agg(F.max("n").alias("n")).join(F.broadcast(cfg), "scenario_id")
                  .orderBy("scenario_id").collect())  # a row a scenario
    firsts = accumulate((p.n for p in population), initial=0)  # places: those of a scenario follow the last one's
    per = [(p.scenario_id, p.n, p.holdings_per_slot, first) for p, first in zip(population, firsts)]

    def settings(some: list[tuple]) -> DataFrame:
        a, b = halves(F.col("n"))
        return F.broadcast(spark.createDataFrame(some, "scenario_id string, n long, holdings_per_slot int, _first long")
                           .select("*", a.alias("_a"), b.alias("_b")))

    rows = packed(members.join(settings(per), "scenario_id").select(
        (F.col("_first") + F.col("rank")).alias("_at"), "security_id"), F.col("_at"), F.col("security_id"))
    rows.write.mode("overwrite").parquet(f"{work}/packed")
    rows = spark.read.schema(rows.schema).parquet(f"{work}/packed")

    # Distinct in a slice, so S6's slots are shuffled as S5's; one shuffle serves all tiles.
    slots = _slice_holdings(h.select("scenario_id", "account_id", "as_of_date")
                            .where(F.weekday("as_of_date") < 5).distinct(), spark)
    keys = [f"_k{j}" for j in range(4)]
    named = slot_keys(F.col("scenario_id"), F.col("account_id"), F.col("as_of_date").cast("string"))

    def drawn(some: list[tuple], names: DataFrame) -> DataFrame:
        made = (slots.join(settings(some), "scenario_id")
                .select("scenario_id", "account_id", F.col("as_of_date").alias("slot_date"), "n", "_a", "_b", "_first",
                        "holdings_per_slot", *[c.alias(k) for k, c in zip(keys, named, strict=True)])
                .withColumn("_r", F.explode(F.sequence(
                    F.lit(1).cast("long"), F.least(F.col("holdings_per_slot").cast("long"), F.col("n"))))))
        rank = permuted(F.col("_r") - 1, F.col("n"), F.col("_a"), F.col("_b"), [F.col(k) for k in keys])
        place = F.coalesce(F.col("_first") + rank, F.lit(-1))  # never null: a check for nulls would permute twice
        return (made.select("scenario_id", "account_id", "slot_date", "_r", place.alias("_place"))
                .join(names.select("pack", "prefix", "width", "names"), F.shiftright("_place", PACK_BITS) == F.col("pack"))
                .select("scenario_id", "account_id", "slot_date", unpacked(F.col("_place")).alias("security_id"),
                        F.col("_r").alias("rank_in_slot")))

    parts = []
    for low, high in tiles(rows, max_bytes):
        met = [(sid, n, k, first) for sid, n, k, first in per if block_of(first) <= high and block_of(first + n - 1) >= low]
        parts.append(drawn(met, F.broadcast(rows.where(F.col("block").between(low, high)))))
    return reduce(DataFrame.unionByName, parts) if parts else drawn(per, rows)


def position_measures(h: DataFrame) -> DataFrame:
    """gain = round(mv - cost, 2); qty = round(mv / (price * fx), 2) exactly
    (integer arithmetic on scaled values, half up); weight = mv / account-day
    total, 8 places (total from a partial aggregate joined back)."""
    a = (F.col("market_value_usd") * 100).cast("decimal(38,0)")
    p = (F.col("price_local") * 100000000).cast("decimal(38,0)")
    fx = (F.col("fx_rate") * 100000000).cast("decimal(38,0)")
    pf = (p * fx).cast("decimal(38,0)")
    qty_h = half_up_div((a * F.lit(10 ** 16).cast("decimal(38,0)")).cast("decimal(38,0)"), pf)
    j = h.join(account_day_totals(h), ["account_id", "as_of_date"], "left")
    return j.select("account_id", "security_id", "as_of_date", "market_value_usd",
                    F.round(F.col("market_value_usd") - F.col("cost_basis_usd"), 2)
                    .cast("decimal(20,2)").alias("gain"),
                    (qty_h.cast("decimal(38,0)") / 100).cast("decimal(20,2)").alias("qty"),
                    weight_column(F.col("market_value_usd"), F.col("_acct_total")).alias("weight"))


def dimension_cycle(spark: SparkSession, part: DataFrame, supplier: DataFrame) -> DataFrame:
    """Attributes assigned by ``i mod n``: class, sub-class and ticker for
    securities; account type and client for accounts, where the client count
    is a fifth of the account count (at least 1)."""
    ac = cycle_pick(K.ASSET_CLASSES, "p_partkey")
    sec = part.select(
        F.lit("security").alias("dim"),
        padded_id("S", "p_partkey", 6).alias("member_id"),
        ac.alias("class_code"),
        F.concat(F.substring(ac, 1, 3), F.lit("_"), F.pmod("p_partkey", F.lit(5)).cast("string"))
        .alias("sub_class"),
        padded_id("T", "p_partkey", 5).alias("group_id"))
    n_acc = supplier.agg(F.count(F.lit(1))).scalar()
    acc = (supplier.select("s_suppkey",
                           F.greatest(F.floor(n_acc / 5), F.lit(1)).cast("long").alias("nc"))
           .select(F.lit("account").alias("dim"),
                   padded_id("A", "s_suppkey", 5).alias("member_id"),
                   cycle_pick(K.ACCOUNT_TYPES, "s_suppkey").alias("class_code"),
                   F.lit(None).cast("string").alias("sub_class"),
                   padded_id("CLI", F.pmod("s_suppkey", F.col("nc")), 5).alias("group_id")))
    return sec.unionByName(acc)


def volume_estimate(spark: SparkSession, h: DataFrame, txn: DataFrame) -> DataFrame:
    """Dry-run estimates from the settings beside the rows actually stored."""
    from ..sources.catalog import per_slice_counts
    cfg = scenario_config(spark)
    est = cfg.select(
        "scenario_id",
        (F.col("n_accounts") * F.col("n_days") * F.col("holdings_per_slot")).cast("long")
        .alias("est_holdings_rows"),
        (F.col("n_accounts") * F.col("n_days") * F.col("txn_ratio") * 3).cast("long")
        .alias("est_transaction_rows"))
    return (est.join(per_slice_counts(h, spark, "actual_holdings_rows"), "scenario_id", "left")
               .join(per_slice_counts(txn, spark, "actual_transaction_rows"), "scenario_id", "left"))
