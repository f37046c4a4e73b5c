"""DuckDB SQL twins of the derived tables (the correctness oracle).

These CTEs restate FIXTURES.md §3 in plain SQL over the driver's views, so
each oracle query starts from the same raw inputs as the Spark job.
"""

from __future__ import annotations

from .. import constants as K


def lst(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def pick(values, expr: str) -> str:
    return f"({lst(values)})[({expr}) % {len(values)} + 1]"


def member(letter: str, key: str, width: int) -> str:
    """SQL of a dimension key that starts with its scenario."""
    return f"printf('{letter}%d_%0{width}d', {key} % 8 + 1, {key})"


CUR = K.CURRENCIES

BASE_CTES = {
    "raw_holdings": f"""
h0 AS (
  SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_shipdate, l_quantity,
         CAST(l_extendedprice AS DECIMAL(20,2)) AS mv,
         CAST(l_discount AS DECIMAL(4,2)) AS disc,
         CAST(l_tax AS DECIMAL(4,2)) AS tax
  FROM lineitem),
h1 AS (
  SELECT {member('A', 'l_suppkey', 5)} AS account_id,
         CASE WHEN l_orderkey % 40 = 0 THEN printf('S9_%06d', l_partkey)
              ELSE {member('S', 'l_partkey', 6)} END AS security_id,
         CAST(l_shipdate AS DATE) AS as_of_date,
         CAST(l_quantity AS DECIMAL(28,8)) AS quantity,
         mv AS market_value_usd,
         CASE WHEN l_orderkey % 97 = 0 THEN CAST(0 AS DECIMAL(20,2))
              WHEN l_orderkey % 101 = 0 THEN CAST(NULL AS DECIMAL(20,2))
              ELSE CAST(mv * (1 - disc) * (1 + tax) AS DECIMAL(20,2)) END AS cost_basis_usd,
         CASE WHEN l_orderkey % 89 = 0 THEN NULL
              WHEN l_orderkey % 83 = 0 THEN lower({pick(CUR, 'l_orderkey')})
              ELSE {pick(CUR, 'l_orderkey')} END AS currency,
         CAST(10 + 7 * l_linenumber AS DECIMAL(20,8)) AS price_local,
         CAST(1 + tax AS DECIMAL(20,8)) AS fx_rate,
         {pick(K.SLICE_CYCLE, 'l_orderkey')} AS scenario_id
  FROM h0),
raw_holdings AS (
  SELECT account_id, security_id, as_of_date,
         CAST(date_trunc('month', as_of_date) AS DATE) AS as_of_month,
         quantity, market_value_usd, cost_basis_usd, currency, price_local, fx_rate,
         CAST(market_value_usd - cost_basis_usd AS DECIMAL(20,2)) AS unrealized_gain,
         CAST(round(CAST(market_value_usd AS DOUBLE) /
               greatest(CAST(sum(market_value_usd) OVER (PARTITION BY account_id, as_of_date)
                             AS DOUBLE), 1.0), 8) AS DECIMAL(10,8)) AS weight_in_acct,
         scenario_id
  FROM h1)""",
    "raw_securities": f"""
raw_securities AS (
  SELECT {member('S', 'p_partkey', 6)} AS security_id,
         CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE printf('c%08d', p_partkey) END AS cusip,
         printf('us%010d', p_partkey) AS isin,
         printf('t%05d', p_partkey) AS ticker,
         p_name AS security_name,
         CASE WHEN p_partkey % 61 = 0 THEN lower({pick(K.ASSET_CLASSES, 'p_partkey')})
              ELSE {pick(K.ASSET_CLASSES, 'p_partkey')} END AS asset_class,
         substr({pick(K.ASSET_CLASSES, 'p_partkey')}, 1, 3) || '_' || CAST(p_partkey % 5 AS VARCHAR)
           AS sub_asset_class,
         {pick(K.COUNTRIES, 'p_size')} AS country,
         lower({pick(CUR, 'p_partkey')}) AS currency,
         {pick(K.SECTORS, 'p_size')} AS sector,
         CASE WHEN p_size % 6 = 5 THEN NULL ELSE {pick(K.RATINGS, 'p_size')} END AS credit_rating,
         DATE '2000-01-01' + CAST(p_size AS INTEGER) AS issue_date,
         DATE '2000-01-01' + CAST(p_size AS INTEGER) + 3650 AS maturity_date,
         1 AS is_active
  FROM part)""",
    "raw_accounts": f"""
raw_accounts AS (
  SELECT {member('A', 's_suppkey', 5)} AS account_id,
         s_name AS account_name,
         printf('CLI%05d', s_suppkey // 5) AS client_id,
         lower({pick(K.ACCOUNT_TYPES, 's_suppkey')}) AS account_type,
         lower({pick(CUR, 's_nationkey')}) AS base_currency,
         DATE '2015-01-01' + CAST(s_suppkey % 2000 AS INTEGER) AS inception_date,
         CASE WHEN s_acctbal < 0 THEN 'closed' WHEN s_suppkey % 2 = 0 THEN 'ACTIVE'
              ELSE 'Active' END AS status,
         r_name AS region,
         {pick(K.RISK_PROFILES, 's_suppkey')} AS risk_profile
  FROM supplier JOIN nation ON n_nationkey = s_nationkey
                JOIN region ON r_regionkey = n_regionkey)""",
    "raw_transactions": f"""
raw_transactions AS (
  SELECT printf('T%010d', o_orderkey) AS transaction_id,
         {member('A', 'o_custkey', 5)} AS account_id,
         {member('S', 'o_orderkey', 6)} AS security_id,
         CAST(o_orderdate AS DATE) AS trade_date,
         CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS trade_month,
         {pick(K.TXN_TYPES, 'o_orderkey')} AS transaction_type,
         CAST(o_totalprice AS DECIMAL(20,2)) AS gross_amount_usd,
         {pick(K.SLICE_CYCLE, 'o_orderkey')} AS scenario_id
  FROM orders)""",
    "stress_metrics": """
stress_metrics AS (
  SELECT event_id + 1 AS metric_id,
         'S' || CAST(user_id % 8 + 1 AS VARCHAR) AS scenario_id,
         CASE event_type """ + " ".join(f"WHEN '{et}' THEN '{ph}'" for et, ph in K.EVENT_PHASE) + """ END
           AS phase,
         ts AS started_at,
         ts + to_microseconds(CAST(round(value * 100) AS BIGINT) * 10000) AS finished_at,
         CAST(value AS DECIMAL(12,3)) AS duration_sec,
         CASE WHEN event_type IN ('error', 'purchase') THEN CAST(0 AS BIGINT)
              ELSE event_id * 100 END AS rows_actual,
         CASE WHEN user_id % 8 + 1 = 7 THEN CAST(1100000000 AS BIGINT)
              WHEN user_id % 8 + 1 = 8 THEN CAST(5000000000 AS BIGINT)
              ELSE CAST(0 AS BIGINT) END AS rows_projected,
         CAST(user_id * 60 AS DECIMAL(10,2)) AS peak_mem_mb,
         CAST(user_id % 101 AS DECIMAL(6,2)) AS avg_cpu_pct
  FROM events)""",
    "run_log": """
run_log AS (
  SELECT event_id AS line_no,
         'S' || CAST(user_id % 8 + 1 AS VARCHAR) AS scenario_id,
         CASE event_type """ + " ".join(f"WHEN '{et}' THEN '{ph}'" for et, ph in K.EVENT_PHASE) + """ END
           AS phase,
         CASE event_id % 4
           WHEN 0 THEN CAST(user_id % 9 AS VARCHAR) || ' of 9 OK'
           WHEN 1 THEN 'Completed with ' || CAST(user_id % 9 AS VARCHAR) || ' warnings and '
                       || CAST(user_id % 4 AS VARCHAR) || ' errors'
           WHEN 2 THEN CAST(event_id AS VARCHAR) || ' rows affected'
           ELSE 'WARN model ' || CAST(user_id % 9 AS VARCHAR) || ' ERROR model '
                || CAST(user_id % 4 AS VARCHAR) END AS line
  FROM events)""",
}


def stg_holdings_sql(sid: str | None = None, pruning: bool = False,
                     complexity: str = "medium", source: str = "raw_holdings") -> str:
    where = ["1 = 1"]
    if pruning:
        where.append(f"as_of_date >= (SELECT max(as_of_date) FROM {source}) - {K.TRAILING_DAYS}")
    if sid is not None:
        where.append(f"scenario_id = '{K.SHARED_SLICES.get(sid, sid)}'")
    extra = ""
    if complexity == "extreme":
        bands = " ".join(f"WHEN weight_in_acct > {b} THEN '{lab}'" for b, lab in K.CONCENTRATION_BANDS)
        extra = f"""
         CASE {bands} ELSE '{K.CONCENTRATION_DEFAULT}' END AS concentration_flag,
         CASE WHEN currency = 'USD' THEN 'DOMESTIC'
              WHEN currency IN ({", ".join(f"'{c}'" for c in K.MAJOR_FX)}) THEN 'MAJOR_FX'
              ELSE 'EM_FX' END AS fx_bucket,
         CAST(market_value_usd * {K.GROSS_UP_FACTOR} AS DECIMAL(23,3)) AS grossed_up_mv,
         CAST(unrealized_gain AS DOUBLE) / CAST(NULLIF(cost_basis_usd, 0) AS DOUBLE) AS return_pct,"""
    elif complexity == "complex":
        extra = """
         CAST(CASE WHEN unrealized_gain > 0 THEN unrealized_gain ELSE 0 END AS DECIMAL(20,2)) AS gross_gain,
         CAST(CASE WHEN unrealized_gain < 0 THEN unrealized_gain ELSE 0 END AS DECIMAL(20,2)) AS gross_loss,"""
    return f"""
  SELECT account_id, security_id,
         CAST(as_of_date AS DATE) AS as_of_date,
         CAST(quantity AS DECIMAL(28,8)) AS quantity,
         CAST(market_value_usd AS DECIMAL(20,2)) AS market_value_usd,
         CAST(cost_basis_usd AS DECIMAL(20,2)) AS cost_basis_usd,
         upper(currency) AS currency,
         CAST(fx_rate AS DECIMAL(20,8)) AS fx_rate,
         CAST(unrealized_gain AS DECIMAL(20,2)) AS unrealized_gain_usd,
         CAST(weight_in_acct AS DECIMAL(10,8)) AS weight_in_portfolio,{extra}
         CASE WHEN currency <> 'USD' THEN 1 ELSE 0 END AS is_cross_currency
  FROM {source} WHERE {" AND ".join(where)}"""


STG_SECURITIES = """
  SELECT security_id,
         upper(coalesce(cusip, isin)) AS preferred_id,
         upper(cusip) AS cusip, upper(isin) AS isin, upper(ticker) AS ticker,
         security_name,
         upper(asset_class) AS asset_class,
         sub_asset_class,
         country AS country_code,
         upper(currency) AS currency_code,
         sector,
         coalesce(credit_rating, 'NR') AS credit_rating,
         CASE WHEN asset_class = 'EQUITY' THEN 'Equity'
              WHEN asset_class = 'FIXED_INCOME' THEN 'Fixed Income'
              WHEN asset_class = 'FUND' THEN 'Pooled Vehicle'
              ELSE 'Other' END AS asset_class_display,
         CAST(issue_date AS DATE) AS issue_date,
         CAST(maturity_date AS DATE) AS maturity_date,
         is_active
  FROM raw_securities"""

STG_ACCOUNTS = """
  SELECT account_id, account_name AS name, client_id,
         upper(account_type) AS account_type,
         upper(base_currency) AS base_currency,
         CAST(inception_date AS DATE) AS inception_date,
         upper(status) AS status, region, risk_profile,
         CASE WHEN upper(status) = 'ACTIVE' THEN 1 ELSE 0 END AS is_active
  FROM raw_accounts"""

ENRICHED = """
  SELECT h.account_id, a.name AS account_name, a.account_type, a.base_currency,
         h.security_id, s.asset_class, s.asset_class_display, s.sector,
         h.as_of_date, h.market_value_usd, h.cost_basis_usd, h.unrealized_gain_usd,
         h.weight_in_portfolio, h.is_cross_currency
  FROM stg_holdings h
  LEFT JOIN stg_securities s ON s.security_id = h.security_id
  LEFT JOIN stg_accounts a ON a.account_id = h.account_id"""


def rollup_sql(variant: int, source: str = "int_joined") -> str:
    keys = ", ".join(K.GROUPINGS[variant % len(K.GROUPINGS)])
    return f"""
  SELECT {keys},
         count(*) AS lot_count,
         CAST(sum(market_value_usd) AS DECIMAL(38,2)) AS total_mv_usd,
         CAST(sum(cost_basis_usd) AS DECIMAL(38,2)) AS total_cost_usd,
         CAST(sum(unrealized_gain_usd) AS DECIMAL(38,2)) AS total_gain_usd,
         CAST(sum(CASE WHEN is_cross_currency = 1 THEN market_value_usd ELSE 0 END)
              AS DECIMAL(38,2)) AS cross_ccy_mv_usd,
         max(market_value_usd) AS max_position_mv
  FROM {source} GROUP BY {keys}"""


def ratio6_sql(num: str, den: str, zero_value: str) -> str:
    """Exact ROUND(num/den, 6) half up, as double (positive operands)."""
    a = f"CAST(({num}) * 100 AS HUGEINT)"
    b = f"CAST(({den}) * 100 AS HUGEINT)"
    return (f"CASE WHEN ({den}) = 0 OR ({den}) IS NULL THEN {zero_value} "
            f"ELSE CAST((2 * {a} * 1000000 + {b}) // (2 * {b}) AS DOUBLE) / 1000000.0 END")


def mart_sql(source: str) -> str:
    return f"""
  SELECT account_id, as_of_date, lot_count, total_mv_usd, total_cost_usd, total_gain_usd,
         cross_ccy_mv_usd, max_position_mv,
         {ratio6_sql('total_mv_usd', 'total_cost_usd', 'CAST(NULL AS DOUBLE)')} AS market_to_cost_ratio,
         {ratio6_sql('cross_ccy_mv_usd', 'total_mv_usd', 'CAST(0 AS DOUBLE)')} AS cross_ccy_weight
  FROM {source}"""


def with_ctes(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the base CTEs plus extra named CTEs (in order)."""
    parts = [v.strip() for v in BASE_CTES.values()]
    parts.append(f"stg_holdings AS ({stg_holdings_sql()})")
    parts.append(f"stg_securities AS ({STG_SECURITIES})")
    parts.append(f"stg_accounts AS ({STG_ACCOUNTS})")
    parts.append(f"int_joined AS ({ENRICHED})")
    for name, sql in (extra or {}).items():
        parts.append(f"{name} AS ({sql})")
    return "WITH " + ",\n".join(parts) + "\n" + body


def _sql_lit(v, typ: str) -> str:
    if v is None:
        return f"CAST(NULL AS {typ})"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return f"CAST({v!r} AS {typ})"


def values_cte(rows, cols: list[tuple[str, str]]) -> str:
    body = ",\n    ".join("(" + ", ".join(_sql_lit(v, t) for v, (_, t) in zip(r, cols)) + ")"
                          for r in rows)
    names = ", ".join(n for n, _ in cols)
    casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in cols)
    return f"SELECT {casts} FROM (VALUES\n    {body}) AS t({names})"


_SCEN_COLS = [("scenario_id", "VARCHAR"), ("scenario_name", "VARCHAR"), ("strategy", "VARCHAR"),
              ("n_securities", "BIGINT"), ("n_accounts", "BIGINT"), ("n_days", "INTEGER"),
              ("holdings_per_slot", "INTEGER"), ("txn_ratio", "DOUBLE"), ("threads", "INTEGER"),
              ("model_complexity", "VARCHAR"), ("use_partition_filter", "BOOLEAN"),
              ("n_intermediate", "INTEGER"), ("n_marts", "INTEGER"), ("projected_rows", "BIGINT")]


def scenario_config_sql() -> str:
    d = K.SCENARIO_DEFAULTS
    rows = []
    for s in K.SCENARIOS:
        r = list(s)
        r[7] = float(d["txn_ratio"]) if r[7] is None else float(r[7])
        r[13] = int(d["projected_rows"]) if r[13] is None else r[13]
        rows.append(r)
    base = values_cte(rows, _SCEN_COLS)
    return (f"SELECT scenario_id, scenario_name, strategy, n_securities, n_accounts, n_days, "
            f"holdings_per_slot, txn_ratio, threads, model_complexity, use_partition_filter, "
            f"CAST({d['n_staging']} AS INTEGER) AS n_staging, n_intermediate, n_marts, projected_rows "
            f"FROM ({base})")


SLICE_MAP = values_cte([(s, K.SHARED_SLICES.get(s, s)) for s in K.SCENARIO_IDS],
                       [("scenario_id", "VARCHAR"), ("slice_id", "VARCHAR")])
TIME_BUDGET = values_cte(K.TIME_BUDGET, [("scenario_id", "VARCHAR"), ("budget_data_gen_min", "INTEGER"),
                                         ("budget_dbt_run_min", "INTEGER"),
                                         ("budget_total_min", "INTEGER")])
THRESHOLDS = values_cte(K.THRESHOLDS, [("metric", "VARCHAR"), ("ok_limit", "INTEGER"),
                                       ("warn_limit", "INTEGER")])

SETTINGS_CTES = {
    "scenario_config": scenario_config_sql(),
    "slice_map": SLICE_MAP,
    "time_budget": TIME_BUDGET,
    "thresholds": THRESHOLDS,
}


def slice_counts_sql(table: str, col: str) -> str:
    return f"""
  SELECT m.scenario_id, CAST(coalesce(c.n, 0) AS BIGINT) AS {col}
  FROM slice_map m LEFT JOIN (SELECT scenario_id AS slice_id, count(*) AS n FROM {table} GROUP BY 1) c
    ON c.slice_id = m.slice_id"""


def W2(body: str, extra: dict[str, str] | None = None) -> str:
    """with_ctes plus the settings tables."""
    return with_ctes(body, {**SETTINGS_CTES, **(extra or {})})
