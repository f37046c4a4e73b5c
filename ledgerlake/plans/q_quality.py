"""Data-quality test queries (not_null, unique, keys, required columns)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import staging
from . import oracle_base as O
from .registry import query

W2 = O.W2

NOT_NULL_TESTS = [
    ("raw_holdings", ["account_id", "security_id", "as_of_date", "quantity"]),
    ("raw_securities", ["security_id"]),
    ("raw_accounts", ["account_id"]),
    ("raw_transactions", ["transaction_id"]),
    ("stg_holdings", ["account_id", "security_id", "as_of_date"]),
    ("stg_securities", ["security_id"]),
    ("stg_accounts", ["account_id"]),
]
UNIQUE_TESTS = [("raw_securities", "security_id"), ("raw_accounts", "account_id"),
                ("stg_securities", "security_id"), ("stg_accounts", "account_id")]
PRIMARY_KEYS = [("raw_securities", ["security_id"]), ("raw_accounts", ["account_id"]),
                ("raw_holdings", ["account_id", "security_id", "as_of_date"]),
                ("raw_transactions", ["transaction_id"])]
REQUIRED = [
    ("raw_securities", ["security_id", "security_name", "asset_class"]),
    ("raw_accounts", ["account_id", "account_name", "client_id", "account_type", "base_currency"]),
    ("raw_holdings", ["account_id", "security_id", "as_of_date", "quantity", "scenario_id"]),
    ("raw_transactions", ["transaction_id", "account_id", "security_id", "trade_date",
                          "transaction_type", "scenario_id"]),
    ("stress_metrics", ["scenario_id", "phase"]),
]


def _model(lake, name):
    return {"stg_holdings": lake.stg_holdings, "stg_securities": lake.stg_securities,
            "stg_accounts": lake.stg_accounts}[name]() if name.startswith("stg_") else lake.raw(name)


def _null_sql(tests, test_name):
    return "\nUNION ALL\n".join(
        f"SELECT '{m}' AS model, '{c}' AS column_name, '{test_name}' AS test_name, "
        f"count(*) FILTER (WHERE {c} IS NULL) AS failures FROM {m}"
        for m, cols in tests for c in cols)


def _unique_sql():
    return "\nUNION ALL\n".join(
        f"SELECT '{m}' AS model, '{c}' AS column_name, 'unique' AS test_name, count(*) AS failures "
        f"FROM (SELECT {c} FROM {m} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1)"
        for m, c in UNIQUE_TESTS)


# Staging models are projections of a raw table: their tests run in the same
# pass as the raw table's.
_STAGED_FROM = {"stg_holdings": ("raw_holdings", staging.stg_holdings_exprs),
                "stg_securities": ("raw_securities", staging.stg_securities_exprs),
                "stg_accounts": ("raw_accounts", staging.stg_accounts_exprs)}


def _expr_of(model: str, col: str):
    return _STAGED_FROM[model][1]()[col] if model in _STAGED_FROM else F.col(col)


def not_null_results(lake):
    by_base: dict[str, list] = {}
    for m, cols in NOT_NULL_TESTS:
        base = _STAGED_FROM.get(m, (m,))[0]
        by_base.setdefault(base, []).extend((m, c, _expr_of(m, c)) for c in cols)
    return Q.union_all([Q.not_null_on_base(lake.raw(b), tests) for b, tests in by_base.items()])


def unique_results(lake):
    by_base: dict[str, list] = {}
    for m, c in UNIQUE_TESTS:
        base = _STAGED_FROM.get(m, (m,))[0]
        by_base.setdefault(base, []).append((m, c, _expr_of(m, c)))
    return Q.union_all([Q.unique_on_base(lake.raw(b), tests) for b, tests in by_base.items()])


@query("dq_not_null", W2(_null_sql(NOT_NULL_TESTS, "not_null")))
def dq_not_null(lake):
    return not_null_results(lake)


@query("dq_unique", W2(_unique_sql()))
def dq_unique(lake):
    return unique_results(lake)


def _pk_sql():
    parts = []
    for t, k in PRIMARY_KEYS:
        any_null = " OR ".join(f"{c} IS NULL" for c in k)
        all_set = " AND ".join(f"{c} IS NOT NULL" for c in k)
        parts.append(
            f"SELECT '{t}' AS table_name, '{','.join(k)}' AS key_columns, "
            f"(SELECT count(*) FILTER (WHERE {any_null}) FROM {t}) AS null_key_rows, "
            f"(SELECT count(*) FROM (SELECT 1 FROM {t} WHERE {all_set} "
            f"GROUP BY {', '.join(k)} HAVING count(*) > 1)) AS duplicate_keys")
    return ("SELECT *, null_key_rows = 0 AND duplicate_keys = 0 AS passed FROM ("
            + "\nUNION ALL\n".join(parts) + ")")


@query("dq_primary_key", W2(_pk_sql()))
def dq_primary_key(lake):
    return Q.union_all([Q.primary_key_check(lake.raw(t), t, k) for t, k in PRIMARY_KEYS])


@query("dq_required_columns", W2(_null_sql(REQUIRED, "required")))
def dq_required_columns(lake):
    return Q.union_all([Q.not_null_failures(lake.raw(t), t, cols, "required") for t, cols in REQUIRED])


@query("dq_summary", W2(f"""
SELECT count(*) AS tests, count(*) FILTER (WHERE failures = 0) AS passed, CAST(0 AS BIGINT) AS warned,
       count(*) FILTER (WHERE failures > 0) AS errored
FROM ({_null_sql(NOT_NULL_TESTS, "not_null")}
      UNION ALL {_unique_sql()})"""))
def dq_summary(lake):
    return Q.summarize(not_null_results(lake).unionByName(unique_results(lake)))
