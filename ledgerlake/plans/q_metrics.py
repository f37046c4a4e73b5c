"""Run-metrics analytics queries (OBS, ST) and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import metrics as M
from ..operators import sinks, staging
from ..sources import catalog
from . import evidence
from . import oracle_base as O
from .registry import query

_ROWS, _DONE, _OKS = K.RUN_LOG_PATTERNS


def _half_up(a: str, b: str) -> str:
    return f"((2 * ({a}) + ({b})) // (2 * ({b})))"


def _tenths_text(t: str) -> str:
    return f"(CAST(({t}) // 10 AS VARCHAR) || '.' || CAST(({t}) % 10 AS VARCHAR))"


def _hundredths_text(h: str) -> str:
    return f"(CAST(({h}) // 100 AS VARCHAR) || '.' || lpad(CAST(({h}) % 100 AS VARCHAR), 2, '0'))"


_MCTES = {
    "latest": """
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY scenario_id, phase
                                 ORDER BY started_at DESC, metric_id DESC) AS rn
    FROM stress_metrics) WHERE rn = 1""",
    "ph_pivot": "SELECT scenario_id, " + ", ".join(
        f"max(CASE WHEN phase = '{p}' THEN duration_sec END) AS {p}_sec" for p in K.PHASES)
    + " FROM latest GROUP BY scenario_id",
    "sc_rollup": """
  SELECT scenario_id,
         CAST(coalesce(sum(duration_sec), 0) AS DECIMAL(38,3)) AS total_duration_sec,
         CAST(coalesce(max(peak_mem_mb), 0) AS DECIMAL(10,2)) AS peak_memory_mb,
         CAST(coalesce(max(avg_cpu_pct), 0) AS DECIMAL(6,2)) AS peak_cpu_pct,
         CAST(coalesce(sum(rows_actual), 0) AS BIGINT) AS total_rows
  FROM stress_metrics GROUP BY scenario_id""",
    "logsum": f"""
  SELECT scenario_id, phase, log_lines, rows_affected,
         CAST(CASE WHEN n_done > 0 THEN 0 ELSE coalesce(p, 0) END AS BIGINT) AS passes,
         CAST(CASE WHEN n_done > 0 THEN w ELSE n_warn END AS BIGINT) AS warns,
         CAST(CASE WHEN n_done > 0 THEN e ELSE n_err END AS BIGINT) AS errors
  FROM (
    SELECT scenario_id, phase, count(*) AS log_lines,
           CAST(coalesce(sum(TRY_CAST(regexp_extract(line, '{_ROWS}', 1) AS BIGINT)), 0) AS BIGINT)
             AS rows_affected,
           count(*) FILTER (WHERE regexp_matches(line, '{_DONE}')) AS n_done,
           arg_min(TRY_CAST(regexp_extract(line, '{_DONE}', 1) AS BIGINT), line_no)
             FILTER (WHERE regexp_matches(line, '{_DONE}')) AS w,
           arg_min(TRY_CAST(regexp_extract(line, '{_DONE}', 2) AS BIGINT), line_no)
             FILTER (WHERE regexp_matches(line, '{_DONE}')) AS e,
           arg_min(TRY_CAST(regexp_extract(line, '{_OKS}', 1) AS BIGINT), line_no)
             FILTER (WHERE regexp_matches(line, '{_OKS}')) AS p,
           sum(len(regexp_extract_all(line, 'WARN'))) AS n_warn,
           sum(len(regexp_extract_all(line, 'ERROR'))) AS n_err
    FROM run_log GROUP BY scenario_id, phase)""",
    "holdings_start": f"SELECT max(as_of_date) - {K.TRAILING_DAYS} AS start_date FROM raw_holdings",
    "pmatrix": """
  SELECT m.scenario_id, m.slice_id, c.use_partition_filter,
         CAST(coalesce(p.months_total, 0) AS BIGINT) AS months_total,
         CAST(coalesce(p.months_scanned, 0) AS BIGINT) AS months_scanned,
         CAST(coalesce(p.rows_total, 0) AS BIGINT) AS rows_total,
         CAST(coalesce(p.rows_in_scanned_months, 0) AS BIGINT) AS rows_in_scanned_months,
         CAST(coalesce(p.rows_scanned, 0) AS BIGINT) AS rows_scanned
  FROM slice_map m
  LEFT JOIN (
    SELECT scenario_id AS slice_id,
           count(DISTINCT as_of_month) AS months_total,
           count(DISTINCT CASE WHEN as_of_month >= CAST(date_trunc('month', s.start_date) AS DATE)
                               THEN as_of_month END) AS months_scanned,
           count(*) AS rows_total,
           count(*) FILTER (WHERE as_of_month >= CAST(date_trunc('month', s.start_date) AS DATE))
             AS rows_in_scanned_months,
           count(*) FILTER (WHERE as_of_date >= s.start_date) AS rows_scanned
    FROM raw_holdings, holdings_start s GROUP BY scenario_id) p ON p.slice_id = m.slice_id
  JOIN scenario_config c ON c.scenario_id = m.scenario_id""",
}


def WM(body: str) -> str:
    return O.W2(body, _MCTES)


def _pivot(lake):
    return M.phase_pivot(lake.metrics)


def _start(lake):
    return F.date_sub(staging.latest_date(lake.holdings), K.TRAILING_DAYS)


def pruning_evidence(lake):
    return M.pruning_matrix(lake.holdings, lake.spark, _start(lake))


@query("obs_scenario_rollup", WM("SELECT * FROM sc_rollup"))
def obs_scenario_rollup(lake):
    return M.scenario_rollup(lake.metrics)


@query("obs_phase_pivot", WM("SELECT * FROM ph_pivot"))
def obs_phase_pivot(lake):
    return _pivot(lake)


_PROJ = ("CASE WHEN rows_projected > 0 AND rows_actual > 0 THEN CAST(duration_sec AS DOUBLE) * "
         "(CAST(rows_projected AS DOUBLE) / CAST(rows_actual AS DOUBLE)) ELSE CAST(duration_sec AS DOUBLE) END")


@query("obs_scale_projection", WM(f"""
SELECT m.metric_id, m.scenario_id, c.scenario_name, m.phase, m.duration_sec, m.rows_actual,
       m.rows_projected, m.projected_duration_sec, m.projected_duration_sec / 60.0 AS projected_duration_min,
       m.peak_mem_mb, m.avg_cpu_pct, c.strategy, CAST(c.use_partition_filter AS INTEGER) AS pruning_active
FROM (SELECT *, {_PROJ} AS projected_duration_sec FROM stress_metrics) m
LEFT JOIN scenario_config c ON c.scenario_id = m.scenario_id"""))
def obs_scale_projection(lake):
    return M.scale_projection(lake.metrics)


@query("obs_pruning_roi", WM("""
SELECT s5_run_sec, s6_run_sec,
       CASE WHEN s5_run_sec <> 0
            THEN round((1 - CAST(s6_run_sec AS DOUBLE) / greatest(CAST(s5_run_sec AS DOUBLE), 1.0)) * 100, 1)
            ELSE 0.0 END AS pruning_saving_pct,
       CAST(s5_run_sec - s6_run_sec AS DECIMAL(12,3)) AS saving_sec_per_run,
       CAST((s5_run_sec - s6_run_sec) * 365 AS DECIMAL(16,3)) AS saving_sec_per_year
FROM (SELECT CAST(coalesce(max(CASE WHEN scenario_id = 'S5' THEN coalesce(dbt_run_sec, 0) END), 0)
                  AS DECIMAL(12,3)) AS s5_run_sec,
             CAST(coalesce(max(CASE WHEN scenario_id = 'S6' THEN coalesce(dbt_run_sec, 0) END), 0)
                  AS DECIMAL(12,3)) AS s6_run_sec
      FROM ph_pivot)"""))
def obs_pruning_roi(lake):
    return M.pruning_roi(_pivot(lake))


_GRADE_VALUES = [("dbt_compile_s", "p.dbt_compile_sec"), ("dbt_run_s", "p.dbt_run_sec"),
                 ("peak_memory_mb", "r.peak_memory_mb"), ("avg_cpu_pct", "r.peak_cpu_pct"),
                 ("total_duration_s", "r.total_duration_sec")]
_OKF, _WARNF = K.THRESHOLD_FALLBACK


@query("obs_threshold_grade", WM(f"""
SELECT l.scenario_id, l.metric, l.value,
       CAST(coalesce(t.ok_limit, {_OKF}) AS BIGINT) AS ok_limit,
       CAST(coalesce(t.warn_limit, {_WARNF}) AS BIGINT) AS warn_limit,
       CASE WHEN l.value <= coalesce(t.ok_limit, {_OKF}) THEN 'ok'
            WHEN l.value <= coalesce(t.warn_limit, {_WARNF}) THEN 'warn' ELSE 'over' END AS grade
FROM (""" + "\nUNION ALL\n".join(
    f"SELECT r.scenario_id, '{m}' AS metric, CAST(coalesce({v}, 0) AS DECIMAL(20,3)) AS value "
    f"FROM sc_rollup r LEFT JOIN ph_pivot p ON p.scenario_id = r.scenario_id" for m, v in _GRADE_VALUES)
    + ") l LEFT JOIN thresholds t ON t.metric = l.metric"))
def obs_threshold_grade(lake):
    return M.threshold_grade(M.scenario_rollup(lake.metrics), _pivot(lake), lake.spark)


@query("obs_run_log", WM("SELECT * FROM logsum"))
def obs_run_log(lake):
    return M.run_log_summary(lake.run_log)


@query("obs_run_status", WM("""
SELECT p.scenario_id, CAST(coalesce(p.dbt_run_sec, 0) AS DECIMAL(12,3)) AS run_sec,
       CAST(coalesce(l.errors, 0) AS BIGINT) AS run_errors,
       CASE WHEN coalesce(l.errors, 0) = 0 AND coalesce(p.dbt_run_sec, 0) > 0 THEN 'green'
            WHEN coalesce(p.dbt_run_sec, 0) = 0 THEN 'yellow' ELSE 'red' END AS status
FROM ph_pivot p LEFT JOIN (SELECT scenario_id, errors FROM logsum WHERE phase = 'dbt_run') l
  ON l.scenario_id = p.scenario_id"""))
def obs_run_status(lake):
    return M.run_status(_pivot(lake), M.run_log_summary(lake.run_log))


def _avg1(c: str) -> str:
    s, n = f"sum(CAST({c} * 100 AS BIGINT))", f"count({c})"
    return (f"CASE WHEN {n} > 0 THEN CAST(CAST({_half_up(s, '10 * ' + n)} AS DOUBLE) / 10 AS DECIMAL(12,1)) "
            f"ELSE CAST(0 AS DECIMAL(12,1)) END")


def _max1(c: str) -> str:
    return f"CAST(coalesce(round(max({c}), 1), 0) AS DECIMAL(12,1))"


@query("obs_resource_summary", WM(f"""
SELECT scenario_id, {_avg1('avg_cpu_pct')} AS avg_cpu, {_max1('avg_cpu_pct')} AS peak_cpu,
       {_avg1('peak_mem_mb')} AS avg_mem_mb, {_max1('peak_mem_mb')} AS peak_mem_mb
FROM stress_metrics GROUP BY scenario_id"""))
def obs_resource_summary(lake):
    return M.resource_summary(lake.metrics)


_MS = "CAST(total_duration_sec * 1000 AS HUGEINT)"


@query("obs_human_formats", WM(f"""
SELECT scenario_id, total_duration_sec, total_rows,
       CASE WHEN {_MS} < 60000 THEN {_tenths_text(_half_up(_MS, '100'))} || 's'
            WHEN {_MS} < 3600000 THEN {_tenths_text(_half_up(_MS, '6000'))} || 'm'
            ELSE {_tenths_text(_half_up(_MS, '360000'))} || 'h' END AS duration_text,
       CASE WHEN total_rows >= 1000000000 THEN {_hundredths_text(_half_up('total_rows', '10000000'))} || 'B'
            WHEN total_rows >= 1000000 THEN {_tenths_text(_half_up('total_rows', '100000'))} || 'M'
            WHEN total_rows >= 1000 THEN CAST({_half_up('total_rows', '1000')} AS VARCHAR) || 'K'
            ELSE CAST(total_rows AS VARCHAR) END AS rows_text
FROM sc_rollup"""))
def obs_human_formats(lake):
    return M.human_formats(M.scenario_rollup(lake.metrics))


@query("obs_kpis", WM("""
SELECT (SELECT CAST(sum(n_staging + n_intermediate + n_marts) AS BIGINT) FROM scenario_config) AS total_models,
       count(DISTINCT scenario_id) AS scenarios_run,
       CAST(coalesce(sum(rows_actual), 0) AS BIGINT) AS total_rows,
       CAST(coalesce(sum(duration_sec), 0) AS DECIMAL(38,3)) AS total_duration_sec
FROM stress_metrics"""))
def obs_kpis(lake):
    return M.kpis(lake.spark, lake.metrics)


@query("obs_scalability", WM("""
SELECT c.scenario_id, CAST(c.n_staging + c.n_intermediate + c.n_marts AS BIGINT) AS n_models,
       CAST(coalesce(p.dbt_run_sec, 0) AS DECIMAL(12,3)) AS run_sec
FROM scenario_config c LEFT JOIN ph_pivot p ON p.scenario_id = c.scenario_id"""))
def obs_scalability(lake):
    return M.scalability(lake.spark, _pivot(lake))


@query("obs_complexity_cost", WM("""
SELECT s2_run_sec, s4_run_sec, CASE WHEN s2_run_sec > 0 THEN s4_run_sec / s2_run_sec END AS s4_over_s2
FROM (SELECT max(CASE WHEN scenario_id = 'S2' THEN CAST(coalesce(dbt_run_sec, 0) AS DOUBLE) END) AS s2_run_sec,
             max(CASE WHEN scenario_id = 'S4' THEN CAST(coalesce(dbt_run_sec, 0) AS DOUBLE) END) AS s4_run_sec
      FROM ph_pivot)"""))
def obs_complexity_cost(lake):
    return M.complexity_cost(_pivot(lake))


@query("obs_budget_check", WM("""
SELECT b.scenario_id,
       CAST(coalesce(p.data_generation_sec, 0) AS DOUBLE) / 60.0 AS data_gen_min,
       CAST(coalesce(p.dbt_run_sec, 0) AS DOUBLE) / 60.0 AS dbt_run_min,
       CAST(coalesce(r.total_duration_sec, 0) AS DOUBLE) / 60.0 AS total_min,
       b.budget_data_gen_min, b.budget_dbt_run_min, b.budget_total_min,
       CAST(coalesce(r.total_duration_sec, 0) AS DOUBLE) / 60.0 <= b.budget_total_min AS within_budget
FROM time_budget b LEFT JOIN sc_rollup r ON r.scenario_id = b.scenario_id
LEFT JOIN ph_pivot p ON p.scenario_id = b.scenario_id"""))
def obs_budget_check(lake):
    return M.budget_check(lake.spark, M.scenario_rollup(lake.metrics), _pivot(lake))


@query("obs_pruning_matrix", WM("SELECT * FROM pmatrix"))
def obs_pruning_matrix(lake):
    return pruning_evidence(lake)


@query("st_baseline_and_ceiling", WM("""
SELECT min(scenario_id) AS baseline_scenario,
       arg_min(CAST(coalesce(dbt_run_sec, 0) AS DECIMAL(12,3)), scenario_id) AS baseline_run_sec,
       max(scenario_id) AS ceiling_scenario,
       arg_max(CAST(coalesce(dbt_run_sec, 0) AS DECIMAL(12,3)), scenario_id) AS ceiling_run_sec
FROM ph_pivot"""))
def st_baseline_and_ceiling(lake):
    return M.baseline_and_ceiling(_pivot(lake))


@query("agg_conditional_like", WM(f"""
SELECT c.scenario_id, CAST(coalesce(l.max_rows_affected, 0) AS BIGINT) AS max_rows_affected,
       CAST(coalesce(l.log_lines, 0) AS BIGINT) AS log_lines,
       CAST(coalesce(l.completed_lines, 0) AS BIGINT) AS completed_lines
FROM scenario_config c LEFT JOIN (
  SELECT scenario_id, max(TRY_CAST(regexp_extract(line, '{_ROWS}', 1) AS BIGINT)) AS max_rows_affected,
         count(*) AS log_lines, count(*) FILTER (WHERE line LIKE 'Completed%') AS completed_lines
  FROM run_log GROUP BY scenario_id) l ON l.scenario_id = c.scenario_id"""))
def agg_conditional_like(lake):
    """MAX, COUNT(*) and a LIKE-conditional count per scenario; a scenario
    without log lines reports 0s."""
    log = lake.run_log
    g = log.groupBy("scenario_id").agg(
        F.max(F.regexp_extract("line", _ROWS, 1).try_cast("long")).alias("max_rows_affected"),
        F.count(F.lit(1)).alias("log_lines"),
        F.count_if(F.col("line").like("Completed%")).alias("completed_lines"))
    cfg = catalog.scenario_config(lake.spark).select("scenario_id")
    return cfg.join(g, "scenario_id", "left").select(
        "scenario_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c)
                         for c in ["max_rows_affected", "log_lines", "completed_lines"]])


@query("snk_metric_rows", WM("""
SELECT m.metric_id, m.scenario_id, m.phase, m.started_at, m.finished_at, m.rows_actual,
       CAST(CAST(m.ms AS DOUBLE) / 1000 AS DECIMAL(12,3)) AS duration_sec,
       CAST(CAST((2 * m.rows_actual * 100000 + greatest(m.ms, """ + str(K.MIN_DURATION_MS) + """))
                 // (2 * greatest(m.ms, """ + str(K.MIN_DURATION_MS) + """)) AS DOUBLE) / 100
            AS DECIMAL(14,2)) AS rows_per_sec,
       substr(l.line, 1, """ + str(K.NOTES_MAX_CHARS) + """) AS notes
FROM (SELECT *, (2 * (epoch_us(finished_at) - epoch_us(started_at)) + 1000) // 2000 AS ms
      FROM stress_metrics) m
LEFT JOIN run_log l ON l.line_no + 1 = m.metric_id"""))
def snk_metric_rows(lake):
    """The rows of earlier runs are there; those of the last week are appended."""
    earlier, new = M.split_runs(lake.metrics)
    path = lake.sink_path("metric_rows")
    sinks.full_refresh(M.metric_rows(earlier, lake.run_log), path)
    rows = M.metric_rows(new, lake.run_log)
    sinks.bulk_append(rows, path)
    return lake.spark.read.schema(rows.schema).parquet(path)


@query("snk_metric_update", WM("""
SELECT m.*,
       CAST(e.rows_scanned AS BIGINT) AS explain_cost,
       CAST(e.months_total AS BIGINT) AS partition_count,
       CAST(e.months_total - e.months_scanned AS BIGINT) AS partitions_pruned
FROM stress_metrics m LEFT JOIN pmatrix e ON e.scenario_id = m.scenario_id AND m.phase = 'collect_stats'"""))
def snk_metric_update(lake):
    path = lake.sink_path("metric_update")
    updated = M.metric_update(lake.metrics, pruning_evidence(lake))
    sinks.full_refresh(updated, path)
    return lake.spark.read.schema(updated.schema).parquet(path)


_ROLL_COLS = ", ".join(M.OVERLAY_FIELDS)
_ROLL_BODY = _MCTES["sc_rollup"].replace("FROM stress_metrics", "FROM {src}")


@query("jn_metric_overlay", WM(f"""
SELECT coalesce(s.scenario_id, n.scenario_id) AS scenario_id,
       """ + ",\n       ".join(f"coalesce(nullif(n.{f}, 0), s.{f}) AS {f}" for f in M.OVERLAY_FIELDS) + f""",
       n.total_duration_sec IS NOT NULL AS from_new_run
FROM ({_ROLL_BODY.format(src="(SELECT * FROM stress_metrics WHERE started_at < (SELECT max(started_at) FROM stress_metrics) - INTERVAL 7 DAY)")}) s
FULL OUTER JOIN ({_ROLL_BODY.format(src="(SELECT * FROM stress_metrics WHERE started_at >= (SELECT max(started_at) FROM stress_metrics) - INTERVAL 7 DAY)")}) n
  ON n.scenario_id = s.scenario_id"""))
def jn_metric_overlay(lake):
    stored, new = M.split_runs(lake.metrics)
    return M.overlay(M.scenario_rollup(stored), M.scenario_rollup(new), "scenario_id",
                     M.OVERLAY_FIELDS)


@query("obs_plan_cost", O.W2(f"""
SELECT p.plan, p.scenario_id, t.table_rows, t.min_date, t.max_date, t.null_dates, t.months_total,
       CASE WHEN p.plan = 'full' THEN t.months_total ELSE t.months_kept END AS months_scanned,
       p.plan = 'pruned' AS cheaper
FROM (VALUES ('full', 'S5'), ('pruned', 'S6')) p(plan, scenario_id),
     (SELECT count(*) AS table_rows, CAST(min(as_of_date) AS VARCHAR) AS min_date,
             CAST(max(as_of_date) AS VARCHAR) AS max_date,
             count(*) FILTER (WHERE as_of_date IS NULL) AS null_dates,
             count(DISTINCT as_of_month) AS months_total,
             count(DISTINCT as_of_month) FILTER (WHERE as_of_month >= date_trunc('month',
                 (SELECT max(as_of_date) FROM raw_holdings) - INTERVAL {K.TRAILING_DAYS} DAY)) AS months_kept
      FROM raw_holdings) t"""))
def obs_plan_cost(lake):
    """Optimiser's cost of the representative query, full and pruned, from an analysed table."""
    return evidence.cost_evidence(lake).drop("cost", "plan_steps", "partition_ops")
