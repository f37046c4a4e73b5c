"""Per-scenario pipeline queries (PIPE-1) and the model tally (PIPE-3)."""

from __future__ import annotations

import uuid

from .. import constants as K
from ..sources import catalog
from ..operators.metrics import model_counts
from . import oracle_base as O
from .pipeline import mart_name, read_metrics, run_all, scenario, stacked_marts
from .registry import query


def _pipe_sql(sid: str) -> str:
    sc = scenario(sid)
    extra = {
        "sc_stg": O.stg_holdings_sql(sid, sc.pruning, sc.complexity),
        "sc_joined": O.ENRICHED.replace("FROM stg_holdings h", "FROM sc_stg h"),
    }
    for j in range(sc.n_intermediate):
        extra[f"sc_int{j}"] = O.rollup_sql(sc.grouping_of(j), "sc_joined")
    body = "\nUNION ALL\n".join(
        f"SELECT '{mart_name(i)}' AS model, * FROM ({O.mart_sql(f'sc_int{sc.intermediate_of(i)}')})"
        for i in range(sc.n_marts))
    return O.W2(body, extra)


for _sid in K.SCENARIO_IDS:
    def _mk(sid):
        return lambda lake: stacked_marts(lake, scenario(sid))
    query(f"pipe_{_sid}", _pipe_sql(_sid))(_mk(_sid))


def _staging_passes(sid: str) -> str:
    """SQL of the number of passed tests of a scenario's own staging."""
    nulls = [(f"sc_stg_{sid}", c) for c in ("account_id", "security_id", "as_of_date")]
    nulls += [("stg_securities", "security_id"), ("stg_accounts", "account_id")]
    tests = [f"SELECT count(*) FILTER (WHERE {c} IS NULL) AS failures FROM {m}" for m, c in nulls]
    tests += [f"SELECT count(*) FROM (SELECT {c} FROM {m} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1)"
              for m, c in nulls[3:]]
    return f"(SELECT count(*) FROM ({' UNION ALL '.join(tests)}) WHERE failures = 0)"


def _loop_sql(sids: list[str]) -> str:
    extra, rows = {}, []
    for sid in sids:
        sc = scenario(sid)
        stg, joined = f"sc_stg_{sid}", f"sc_joined_{sid}"
        extra[stg] = O.stg_holdings_sql(sid, sc.pruning, sc.complexity)
        extra[joined] = O.ENRICHED.replace("FROM stg_holdings h", f"FROM {stg} h")
        for j in range(sc.n_intermediate):
            extra[f"sc_int_{sid}_{j}"] = O.rollup_sql(sc.grouping_of(j), joined)
        marts_rows = " + ".join(f"(SELECT count(*) FROM ({O.mart_sql(f'sc_int_{sid}_{sc.intermediate_of(i)}')}))"
                                for i in range(sc.n_marts))
        loaded = "0" if sid in K.SHARED_SLICES else f"(SELECT count(*) FROM raw_holdings WHERE scenario_id = '{sid}')"
        per_phase = {"data_generation": loaded, "dbt_compile": "0", "dbt_run": marts_rows,
                     "dbt_test": _staging_passes(sid), "collect_stats": "0"}
        rows += [f"SELECT '{sid}' AS scenario_id, '{phase}' AS phase, CAST({n} AS BIGINT) AS rows_actual, "
                 f"{sc.n_models} AS models_count, {int(sc.pruning)} AS pruning_active" for phase, n in per_phase.items()]
    return O.W2("\nUNION ALL\n".join(rows), extra)


@query("pipe_loop_phases", _loop_sql(["S5", "S6"]))
def pipe_loop_phases(lake):
    """The scenario loop over the pair that differs by pruning alone: the countable part of the
    metric rows that it records."""
    path = run_all(lake, ["S5", "S6"], f"{lake.sink_path('run_metrics')}/{uuid.uuid4().hex}")
    return read_metrics(lake, path).select("scenario_id", "phase", "rows_actual", "models_count", "pruning_active")


@query("pipe_model_counts", O.W2("""
SELECT c.scenario_id, c.n_staging, c.n_intermediate, c.n_marts,
       CAST(c.n_staging + c.n_intermediate + c.n_marts AS BIGINT) AS n_models, s.slice_rows
FROM scenario_config c JOIN (""" + O.slice_counts_sql("raw_holdings", "slice_rows") + """) s
  ON s.scenario_id = c.scenario_id"""))
def pipe_model_counts(lake):
    return model_counts(lake.spark).join(
        catalog.per_slice_counts(lake.holdings, lake.spark, "slice_rows"), "scenario_id")
