"""Run-metrics analytics: rollups, pivots, projections, grades and formats.

Fractions that the report rounds are computed with exact integer arithmetic
(half up) so the result does not depend on floating-point summation order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import half_up_div, hundredths_text, tenths_text
from ..sources.catalog import scenario_config, thresholds, time_budget
from .weights import latest_per_group

METRIC_COLS = ["metric_id", "scenario_id", "phase", "started_at", "finished_at", "duration_sec",
               "rows_actual", "rows_projected", "peak_mem_mb", "avg_cpu_pct"]


def _millis(sec: F.Column) -> F.Column:
    return (sec * 1000).cast("decimal(38,0)")


def _dec1(tenths: F.Column) -> F.Column:
    return (tenths.cast("decimal(20,0)") / 10).cast("decimal(12,1)")


# ------------------------------------------------------------ append ----

def metric_rows(metrics: DataFrame, log: DataFrame) -> DataFrame:
    """A metric row as the logger writes it: duration from the timestamps
    (3 places), rows/s = rows / max(duration, 0.001) (2 places), notes cut
    to 3,999 characters."""
    micros = (F.unix_micros(F.col("finished_at").cast("timestamp")) -
              F.unix_micros(F.col("started_at").cast("timestamp")))
    ms = half_up_div(micros, F.lit(1000))
    rps_h = half_up_div(F.col("rows_actual") * 100000, F.greatest(ms, F.lit(K.MIN_DURATION_MS)))
    notes = log.select((F.col("line_no") + 1).alias("metric_id"),
                       F.substring("line", 1, K.NOTES_MAX_CHARS).alias("notes"))
    m = metrics.select("metric_id", "scenario_id", "phase", "started_at", "finished_at",
                       "rows_actual",
                       (ms.cast("decimal(20,0)") / 1000).cast("decimal(12,3)").alias("duration_sec"),
                       (rps_h.cast("decimal(20,0)") / 100).cast("decimal(14,2)").alias("rows_per_sec"))
    return m.join(notes, "metric_id", "left")


UPDATED = ["explain_cost", "partition_count", "partitions_pruned"]


def metric_update(metrics: DataFrame, evidence: DataFrame) -> DataFrame:
    """The metrics table after an update: the ``collect_stats`` rows of each
    scenario get cost, step and pruning counts; all other rows and columns
    stay as they are."""
    ev = evidence.select("scenario_id", F.lit("collect_stats").alias("phase"),
                         F.col("rows_scanned").alias("u_explain_cost"),
                         F.col("months_total").alias("u_partition_count"),
                         (F.col("months_total") - F.col("months_scanned")).alias("u_partitions_pruned"))
    j = metrics.join(F.broadcast(ev), ["scenario_id", "phase"], "left")  # a row a scenario
    new = {c: F.coalesce(F.col(f"u_{c}"), F.col(c) if c in metrics.columns else F.lit(None)).cast("long")
           for c in UPDATED}
    return j.select(*[c for c in metrics.columns if c not in new],
                    *[v.alias(c) for c, v in new.items()])


# ------------------------------------------------------------ rollups ---

def scenario_rollup(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("scenario_id").agg(
        F.coalesce(F.sum("duration_sec"), F.lit(0)).cast("decimal(38,3)").alias("total_duration_sec"),
        F.coalesce(F.max("peak_mem_mb"), F.lit(0)).cast("decimal(10,2)").alias("peak_memory_mb"),
        F.coalesce(F.max("avg_cpu_pct"), F.lit(0)).cast("decimal(6,2)").alias("peak_cpu_pct"),
        F.coalesce(F.sum("rows_actual"), F.lit(0)).cast("long").alias("total_rows"),
    )


def latest_phase(metrics: DataFrame) -> DataFrame:
    """Last row per scenario and phase in start order (metric_id breaks ties)."""
    cols = [c for c in METRIC_COLS if c not in ("scenario_id", "phase")]
    return latest_per_group(metrics, ["scenario_id", "phase"], ["started_at", "metric_id"], cols)


def phase_pivot(metrics: DataFrame) -> DataFrame:
    """One duration column per phase, from the last row of each phase."""
    lp = latest_phase(metrics)
    return (lp.groupBy("scenario_id").pivot("phase", K.PHASES)
              .agg(F.first("duration_sec"))
              .select("scenario_id", *[F.col(p).alias(f"{p}_sec") for p in K.PHASES]))


def scale_projection(metrics: DataFrame) -> DataFrame:
    rp, ra = F.col("rows_projected"), F.col("rows_actual")
    d = F.col("duration_sec").cast("double")
    proj = F.when((rp > 0) & (ra > 0), d * (rp.cast("double") / ra.cast("double"))).otherwise(d)
    cfg = scenario_config(metrics.sparkSession).select(
        "scenario_id", "scenario_name", "strategy",
        F.col("use_partition_filter").cast("int").alias("pruning_active"))  # a row a scenario
    return metrics.select(*METRIC_COLS).join(F.broadcast(cfg), "scenario_id", "left").select(
        "metric_id", "scenario_id", "scenario_name", "phase", "duration_sec", "rows_actual",
        "rows_projected", proj.alias("projected_duration_sec"),
        (proj / 60.0).alias("projected_duration_min"),
        "peak_mem_mb", "avg_cpu_pct", "strategy", "pruning_active")


def pruning_roi(pivot: DataFrame) -> DataFrame:
    """Saving of the pruned scenario (S6) against the full scan (S5)."""
    run = F.coalesce(F.col("dbt_run_sec"), F.lit(0)).cast("decimal(12,3)")
    one = pivot.agg(
        F.coalesce(F.max(F.when(F.col("scenario_id") == "S5", run)), F.lit(0))
        .cast("decimal(12,3)").alias("s5_run_sec"),
        F.coalesce(F.max(F.when(F.col("scenario_id") == "S6", run)), F.lit(0))
        .cast("decimal(12,3)").alias("s6_run_sec"))
    s5, s6 = F.col("s5_run_sec"), F.col("s6_run_sec")
    pct = F.round((1 - s6.cast("double") / F.greatest(s5.cast("double"), F.lit(1.0))) * 100, 1)
    return one.select(
        "s5_run_sec", "s6_run_sec",
        F.when(s5 != 0, pct).otherwise(F.lit(0.0)).alias("pruning_saving_pct"),
        (s5 - s6).cast("decimal(12,3)").alias("saving_sec_per_run"),
        ((s5 - s6) * 365).cast("decimal(16,3)").alias("saving_sec_per_year"))


def threshold_grade(rollup: DataFrame, pivot: DataFrame, spark: SparkSession) -> DataFrame:
    """ok / warn / over per scenario and metric; unknown metrics use the
    fallback limits."""
    j = rollup.join(pivot, "scenario_id", "left")
    vals = [("dbt_compile_s", F.col("dbt_compile_sec")), ("dbt_run_s", F.col("dbt_run_sec")),
            ("peak_memory_mb", F.col("peak_memory_mb")), ("avg_cpu_pct", F.col("peak_cpu_pct")),
            ("total_duration_s", F.col("total_duration_sec"))]
    long = j.select("scenario_id", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"),
                 F.coalesce(v, F.lit(0)).cast("decimal(20,3)").alias("value"))
        for m, v in vals])).alias("r")).select("scenario_id", "r.*")
    ok_fb, warn_fb = K.THRESHOLD_FALLBACK
    t = long.join(F.broadcast(thresholds(spark)), "metric", "left")
    ok = F.coalesce("ok_limit", F.lit(ok_fb))
    warn = F.coalesce("warn_limit", F.lit(warn_fb))
    grade = (F.when(F.col("value") <= ok, "ok").when(F.col("value") <= warn, "warn")
             .otherwise("over"))
    return t.select("scenario_id", "metric", "value", ok.cast("long").alias("ok_limit"),
                    warn.cast("long").alias("warn_limit"), grade.alias("grade"))


# ------------------------------------------------------------ run log ---

_ROWS, _DONE, _OKS = K.RUN_LOG_PATTERNS


def run_log_summary(log: DataFrame) -> DataFrame:
    """Per run (scenario, phase): affected rows, and pass/warn/error counts.

    If any "Completed with W warnings and E errors" line exists, the first
    one gives W and E and passes are 0; otherwise the first "P of T OK" line
    gives the passes and WARN / ERROR are counted as substrings."""
    line = F.col("line")
    n_rows = F.regexp_extract(line, _ROWS, 1).try_cast("long")
    done = F.regexp_extract(line, _DONE, 0) != ""
    oks = F.regexp_extract(line, _OKS, 0) != ""
    w = F.regexp_extract(line, _DONE, 1).try_cast("long")
    e = F.regexp_extract(line, _DONE, 2).try_cast("long")
    p = F.regexp_extract(line, _OKS, 1).try_cast("long")
    g = log.groupBy("scenario_id", "phase").agg(
        F.count(F.lit(1)).alias("log_lines"),
        F.coalesce(F.sum(n_rows), F.lit(0)).cast("long").alias("rows_affected"),
        F.count_if(done).alias("_n_done"),
        F.min_by(F.when(done, w), F.when(done, F.col("line_no"))).alias("_w"),
        F.min_by(F.when(done, e), F.when(done, F.col("line_no"))).alias("_e"),
        F.min_by(F.when(oks, p), F.when(oks, F.col("line_no"))).alias("_p"),
        F.sum(F.regexp_count(line, F.lit("WARN"))).cast("long").alias("_warn"),
        F.sum(F.regexp_count(line, F.lit("ERROR"))).cast("long").alias("_err"))
    has_done = F.col("_n_done") > 0
    return g.select(
        "scenario_id", "phase", "log_lines", "rows_affected",
        F.when(has_done, F.lit(0)).otherwise(F.coalesce("_p", F.lit(0))).cast("long").alias("passes"),
        F.when(has_done, F.col("_w")).otherwise(F.col("_warn")).cast("long").alias("warns"),
        F.when(has_done, F.col("_e")).otherwise(F.col("_err")).cast("long").alias("errors"))


def run_status(pivot: DataFrame, log_summary: DataFrame) -> DataFrame:
    """green: no errors and a run > 0; yellow: no run time; red otherwise."""
    errs = log_summary.where(F.col("phase") == "dbt_run").select(
        "scenario_id", F.col("errors").alias("run_errors"))
    j = pivot.join(errs, "scenario_id", "left")
    run = F.coalesce(F.col("dbt_run_sec"), F.lit(0))
    err = F.coalesce(F.col("run_errors"), F.lit(0))
    status = (F.when((err == 0) & (run > 0), "green").when(run == 0, "yellow").otherwise("red"))
    return j.select("scenario_id", run.cast("decimal(12,3)").alias("run_sec"),
                    err.cast("long").alias("run_errors"), status.alias("status"))


def resource_summary(metrics: DataFrame) -> DataFrame:
    """Average and peak CPU and memory per scenario, 1 place; empty -> 0."""
    def avg1(c):
        s = F.sum((F.col(c) * 100).cast("long"))
        n = F.count(c)
        return F.when(n > 0, _dec1(half_up_div(s, n * 10))).otherwise(F.lit(0).cast("decimal(12,1)"))

    def max1(c):
        return F.coalesce(F.round(F.max(c), 1), F.lit(0)).cast("decimal(12,1)")
    return metrics.groupBy("scenario_id").agg(
        avg1("avg_cpu_pct").alias("avg_cpu"), max1("avg_cpu_pct").alias("peak_cpu"),
        avg1("peak_mem_mb").alias("avg_mem_mb"), max1("peak_mem_mb").alias("peak_mem_mb"))


def human_formats(rollup: DataFrame) -> DataFrame:
    """Durations as s/m/h and row counts as K/M/B (half up at the shown place)."""
    ms = _millis(F.col("total_duration_sec"))
    dur = (F.when(ms < 60000, F.concat(tenths_text(half_up_div(ms, F.lit(100))), F.lit("s")))
           .when(ms < 3600000, F.concat(tenths_text(half_up_div(ms, F.lit(6000))), F.lit("m")))
           .otherwise(F.concat(tenths_text(half_up_div(ms, F.lit(360000))), F.lit("h"))))
    n = F.col("total_rows")
    rows = (F.when(n >= 1_000_000_000,
                   F.concat(hundredths_text(half_up_div(n, F.lit(10_000_000))), F.lit("B")))
            .when(n >= 1_000_000, F.concat(tenths_text(half_up_div(n, F.lit(100_000))), F.lit("M")))
            .when(n >= 1_000, F.concat(half_up_div(n, F.lit(1000)).cast("string"), F.lit("K")))
            .otherwise(n.cast("string")))
    return rollup.select("scenario_id", "total_duration_sec", "total_rows",
                         dur.alias("duration_text"), rows.alias("rows_text"))


def model_counts(spark: SparkSession) -> DataFrame:
    cfg = scenario_config(spark)
    return cfg.select("scenario_id", "n_staging", "n_intermediate", "n_marts",
                      (F.col("n_staging") + F.col("n_intermediate") + F.col("n_marts"))
                      .cast("long").alias("n_models"))


def kpis(spark: SparkSession, metrics: DataFrame) -> DataFrame:
    models = model_counts(spark).agg(F.sum("n_models").alias("m")).scalar()
    return metrics.agg(
        models.cast("long").alias("total_models"),
        F.count_distinct("scenario_id").alias("scenarios_run"),
        F.coalesce(F.sum("rows_actual"), F.lit(0)).cast("long").alias("total_rows"),
        F.coalesce(F.sum("duration_sec"), F.lit(0)).cast("decimal(38,3)").alias("total_duration_sec"))


def scalability(spark: SparkSession, pivot: DataFrame) -> DataFrame:
    return (model_counts(spark).join(pivot, "scenario_id", "left")
            .select("scenario_id", "n_models",
                    F.coalesce("dbt_run_sec", F.lit(0)).cast("decimal(12,3)").alias("run_sec")))


def complexity_cost(pivot: DataFrame) -> DataFrame:
    """Run time of the extreme-SQL scenario (S4) against the same data at
    medium complexity (S2)."""
    run = F.coalesce(F.col("dbt_run_sec"), F.lit(0)).cast("double")
    one = pivot.agg(F.max(F.when(F.col("scenario_id") == "S2", run)).alias("s2_run_sec"),
                    F.max(F.when(F.col("scenario_id") == "S4", run)).alias("s4_run_sec"))
    return one.select("s2_run_sec", "s4_run_sec",
                      F.when(F.col("s2_run_sec") > 0, F.col("s4_run_sec") / F.col("s2_run_sec"))
                      .alias("s4_over_s2"))


def budget_check(spark: SparkSession, rollup: DataFrame, pivot: DataFrame) -> DataFrame:
    j = (time_budget(spark).join(rollup, "scenario_id", "left").join(pivot, "scenario_id", "left"))

    def minutes(c):
        return (F.coalesce(F.col(c), F.lit(0)).cast("double") / 60.0)
    out = j.select("scenario_id",
                   minutes("data_generation_sec").alias("data_gen_min"),
                   minutes("dbt_run_sec").alias("dbt_run_min"),
                   minutes("total_duration_sec").alias("total_min"),
                   "budget_data_gen_min", "budget_dbt_run_min", "budget_total_min")
    return out.withColumn("within_budget", F.col("total_min") <= F.col("budget_total_min"))


def baseline_and_ceiling(pivot: DataFrame) -> DataFrame:
    """Run time of the first and the last scenario (by id)."""
    run = F.coalesce(F.col("dbt_run_sec"), F.lit(0)).cast("decimal(12,3)")
    return pivot.agg(F.min("scenario_id").alias("baseline_scenario"),
                     F.min_by(run, F.col("scenario_id")).alias("baseline_run_sec"),
                     F.max("scenario_id").alias("ceiling_scenario"),
                     F.max_by(run, F.col("scenario_id")).alias("ceiling_run_sec"))


def pruning_matrix(h: DataFrame, spark: SparkSession, start: F.Column) -> DataFrame:
    """Per scenario: month partitions and rows in the slice, and those a
    trailing window starting at ``start`` keeps."""
    from ..sources.catalog import slice_map
    first_month = F.trunc(start, "MM")
    keep = (F.col("as_of_month") >= first_month)
    # One row a slice and month first: no distinct count over the fact.
    months = h.groupBy(F.col("scenario_id").alias("slice_id"), "as_of_month").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("as_of_date") >= start).alias("n_kept"))
    per = months.groupBy("slice_id").agg(
        F.count(F.lit(1)).alias("months_total"),
        F.count_if(keep).alias("months_scanned"),
        F.sum("n").alias("rows_total"),
        F.sum(F.when(keep, F.col("n"))).alias("rows_in_scanned_months"),
        F.sum("n_kept").alias("rows_scanned"))
    cfg = scenario_config(spark).select("scenario_id", "use_partition_filter")
    return (slice_map(spark).join(F.broadcast(per), "slice_id", "left")  # a row a slice
            .join(F.broadcast(cfg), "scenario_id")
            .select("scenario_id", "slice_id", "use_partition_filter",
                    *[F.coalesce(c, F.lit(0)).cast("long").alias(c)
                      for c in ["months_total", "months_scanned", "rows_total",
                                "rows_in_scanned_months", "rows_scanned"]]))


OVERLAY_FIELDS = ["total_duration_sec", "peak_memory_mb", "peak_cpu_pct", "total_rows"]


def overlay(stored: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Merge new results over stored ones: a truthy (non-NULL, non-zero) new
    value wins, otherwise the stored value stays; keys only in ``new`` are
    added.  A full outer join on the key."""
    s = stored.select(key, *[F.col(f).alias(f"_s_{f}") for f in fields])
    n = new.select(key, *[F.col(f).alias(f"_n_{f}") for f in fields])
    j = s.join(n, key, "full")
    return j.select(key, *[F.coalesce(F.nullif(F.col(f"_n_{f}"), F.lit(0)), F.col(f"_s_{f}")).alias(f)
                           for f in fields],
                    F.col(f"_n_{fields[0]}").isNotNull().alias("from_new_run"))


def split_runs(metrics: DataFrame, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """Stored results (older rows, and those without a start) and a new run (the last ``days`` days)."""
    cut = metrics.agg(F.max("started_at")).scalar() - F.make_dt_interval(days=F.lit(days))
    new = F.coalesce(F.col("started_at") >= cut, F.lit(False))
    return metrics.where(~new), metrics.where(new)
