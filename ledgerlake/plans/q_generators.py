"""Queries for weights (WN) and the deterministic generators (GEN)."""

from __future__ import annotations

from .. import constants as K
from ..operators import generators, weights
from ..operators.ranks import permuted_sql
from . import oracle_base as O
from .registry import query

W2 = O.W2

_WEIGHT_SQL = ("CAST(round(CAST(market_value_usd AS DOUBLE) / greatest(CAST(sum(market_value_usd) "
               "OVER (PARTITION BY account_id, as_of_date) AS DOUBLE), 1.0), 8) AS DECIMAL(10,8))")

_SLICED = {"sh": """
  SELECT m.scenario_id, h.account_id, h.security_id, h.as_of_date
  FROM raw_holdings h JOIN slice_map m ON m.slice_id = h.scenario_id""",
           "base": "SELECT scenario_id, min(as_of_date) AS base_date FROM sh GROUP BY scenario_id"}


@query("wn_position_weight", W2(f"""
SELECT account_id, security_id, as_of_date, market_value_usd, {_WEIGHT_SQL} AS weight_runtime
FROM raw_holdings"""))
def wn_position_weight(lake):
    return weights.position_weight(lake.holdings)


@query("wn_weight_agrees", W2(f"""
SELECT count(*) AS n_rows,
       count(*) FILTER (WHERE weight_in_acct IS DISTINCT FROM rt) AS n_mismatch,
       count(*) FILTER (WHERE weight_in_acct < 1) AS n_shared_slots
FROM (SELECT weight_in_acct, {_WEIGHT_SQL} AS rt FROM raw_holdings)"""))
def wn_weight_agrees(lake):
    return weights.weight_agreement(lake.holdings)


@query("wn_latest_phase", W2("""
SELECT metric_id, scenario_id, phase, started_at, finished_at, duration_sec, rows_actual,
       rows_projected, peak_mem_mb, avg_cpu_pct
FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id, phase
                                   ORDER BY started_at DESC, metric_id DESC) AS rn
      FROM stress_metrics) WHERE rn = 1"""))
def wn_latest_phase(lake):
    from ..operators.metrics import latest_phase
    return latest_phase(lake.metrics)


@query("gen_business_days", W2("""
SELECT c.scenario_id, c.cal_date, CAST(isodow(c.cal_date) - 1 AS BIGINT) AS weekday,
       CAST(coalesce(p.n, 0) AS BIGINT) AS n_positions
FROM (SELECT b.scenario_id,
             CAST(b.base_date + CAST(unnest(generate_series(0, s.n_days - 1)) AS INTEGER) AS DATE) AS cal_date
      FROM base b JOIN scenario_config s ON s.scenario_id = b.scenario_id) c
LEFT JOIN (SELECT scenario_id, as_of_date, count(*) AS n FROM sh GROUP BY 1, 2) p
  ON p.scenario_id = c.scenario_id AND p.as_of_date = c.cal_date
WHERE isodow(c.cal_date) - 1 < 5""", _SLICED))
def gen_business_days(lake):
    return generators.business_days(lake.holdings, lake.spark)


@query("gen_position_slots", W2("""
SELECT scenario_id, account_id, slot_date FROM (
  SELECT a.scenario_id, a.account_id,
         CAST(b.base_date + CAST(unnest(generate_series(0, s.n_days - 1)) AS INTEGER) AS DATE) AS slot_date
  FROM (SELECT DISTINCT scenario_id, account_id FROM sh) a
  JOIN base b ON b.scenario_id = a.scenario_id
  JOIN scenario_config s ON s.scenario_id = a.scenario_id)
WHERE isodow(slot_date) - 1 < 5""", _SLICED))
def gen_position_slots(lake):
    return generators.position_slots(lake.holdings, lake.spark)


@query("gen_sample_k", W2(f"""
SELECT d.scenario_id, d.account_id, d.slot_date, m.security_id, d.r AS rank_in_slot
FROM (
  SELECT scenario_id, account_id, slot_date, r,
         {permuted_sql("(r - 1)", "n", "a", "b", [f"k{j}" for j in range(4)])} AS rank
  FROM (
    SELECT s.scenario_id, s.account_id, s.as_of_date AS slot_date, p.n, p.a,
           CAST(ceil(p.n / p.a) AS BIGINT) AS b,
           {", ".join(f"CAST('0x' || substr(s.name, {8 * j + 1}, 8) AS BIGINT) AS k{j}" for j in range(4))},
           unnest(generate_series(1, least(CAST(c.holdings_per_slot AS BIGINT), p.n))) AS r
    FROM (SELECT DISTINCT scenario_id, account_id, as_of_date,
                 md5(scenario_id || '|' || account_id || '|' || CAST(as_of_date AS VARCHAR)) AS name
          FROM sh WHERE isodow(as_of_date) < 6) s
    JOIN (SELECT scenario_id, count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM members GROUP BY 1) p USING (scenario_id)
    JOIN scenario_config c USING (scenario_id))) d
JOIN members m ON m.scenario_id = d.scenario_id AND m.rank = d.rank""", {**_SLICED, "members": """
  SELECT substr(security_id, 1, 2) AS scenario_id, security_id,
         row_number() OVER (PARTITION BY substr(security_id, 1, 2) ORDER BY security_id) - 1 AS rank
  FROM (SELECT DISTINCT security_id FROM raw_securities WHERE security_id IS NOT NULL)"""}))
def gen_sample_k(lake):
    return generators.sample_k(lake.holdings, lake.securities, lake.spark, lake.sink_path("security_ranks"))


@query("gen_position_measures", W2(f"""
SELECT account_id, security_id, as_of_date, market_value_usd,
       CAST(round(market_value_usd - cost_basis_usd, 2) AS DECIMAL(20,2)) AS gain,
       CAST(CAST((2 * CAST(market_value_usd * 100 AS HUGEINT) * CAST(10000000000000000 AS HUGEINT) + pf)
                 // (2 * pf) AS DOUBLE) / 100 AS DECIMAL(20,2)) AS qty,
       {_WEIGHT_SQL} AS weight
FROM (SELECT *, CAST(price_local * 100000000 AS HUGEINT) * CAST(fx_rate * 100000000 AS HUGEINT) AS pf
      FROM raw_holdings)"""))
def gen_position_measures(lake):
    return generators.position_measures(lake.holdings)


@query("gen_dimension_cycle", W2(f"""
SELECT 'security' AS dim, printf('S%06d', p_partkey) AS member_id,
       {O.pick(K.ASSET_CLASSES, 'p_partkey')} AS class_code,
       substr({O.pick(K.ASSET_CLASSES, 'p_partkey')}, 1, 3) || '_' || CAST(p_partkey % 5 AS VARCHAR) AS sub_class,
       printf('T%05d', p_partkey) AS group_id
FROM part
UNION ALL
SELECT 'account', printf('A%05d', s_suppkey), {O.pick(K.ACCOUNT_TYPES, 's_suppkey')}, CAST(NULL AS VARCHAR),
       printf('CLI%05d', s_suppkey % greatest((SELECT count(*) FROM supplier) // 5, 1))
FROM supplier"""))
def gen_dimension_cycle(lake):
    from ..sources.fixtures import read_input
    return generators.dimension_cycle(lake.spark, read_input(lake.spark, lake.sf_dir, "part"),
                                      read_input(lake.spark, lake.sf_dir, "supplier"))


@query("gen_volume_estimate", W2("""
SELECT c.scenario_id,
       CAST(c.n_accounts * c.n_days * c.holdings_per_slot AS BIGINT) AS est_holdings_rows,
       CAST(trunc(c.n_accounts * c.n_days * c.txn_ratio * 3) AS BIGINT) AS est_transaction_rows,
       h.actual_holdings_rows, t.actual_transaction_rows
FROM scenario_config c
LEFT JOIN (""" + O.slice_counts_sql("raw_holdings", "actual_holdings_rows") + """) h USING (scenario_id)
LEFT JOIN (""" + O.slice_counts_sql("raw_transactions", "actual_transaction_rows") + """) t USING (scenario_id)"""))
def gen_volume_estimate(lake):
    return generators.volume_estimate(lake.spark, lake.holdings, lake.transactions)
