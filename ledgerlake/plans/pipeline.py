"""Layered scenario runs: staging -> intermediates -> marts, with metrics.

In the original suite staging and intermediates are views, so every mart
recomputes the whole chain.  Here each intermediate is computed once: as a
single DataFrame plan (marts sharing an intermediate are generated from it
with ``explode``), or, in ``run_scenario``, written once and read by its
marts.
"""

from __future__ import annotations

import contextlib
import time
import uuid
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StringType, StructField, StructType

from .. import constants as K
from ..operators import aggregates, joins, marts, quality, resources, sinks, staging
from ..session import store_dir
from .context import Lake


@dataclass(frozen=True)
class Scenario:
    sid: str
    complexity: str
    pruning: bool
    n_intermediate: int
    n_marts: int
    n_staging: int = K.SCENARIO_DEFAULTS["n_staging"]

    @property
    def n_models(self) -> int:
        return self.n_staging + self.n_intermediate + self.n_marts

    def intermediate_of(self, mart_index: int) -> int:
        return mart_index % self.n_intermediate

    def grouping_of(self, int_index: int) -> int:
        return int_index % len(K.GROUPINGS)


def scenario(sid: str) -> Scenario:
    row = next(s for s in K.SCENARIOS if s[0] == sid)
    return Scenario(sid=sid, complexity=row[9], pruning=row[10], n_intermediate=row[11],
                    n_marts=row[12])


def mart_name(i: int) -> str:
    return f"fct_portfolio_summary_{i + 1:03d}"


def int_name(j: int) -> str:
    return f"int_holdings_enriched_{j + 1:03d}"


def staged(lake: Lake, sc: Scenario):
    return (lake.stg_holdings(sc.sid, pruning=sc.pruning, complexity=sc.complexity),
            lake.stg_securities(), lake.stg_accounts())


def scenario_rollups(lake: Lake, sc: Scenario):
    """The scenario's intermediates as one grouping-sets aggregate."""
    h, s, a = staged(lake, sc)
    variants = [sc.grouping_of(j) for j in range(sc.n_intermediate)]
    agg, gids = aggregates.rollup_sets(joins.enriched(h, s, a), variants)
    return agg, [gids[v] for v in variants]


def intermediates(lake: Lake, sc: Scenario) -> list[DataFrame]:
    h, s, a = staged(lake, sc)
    joined = joins.enriched(h, s, a)
    return aggregates.position_rollups(joined, [sc.grouping_of(j) for j in range(sc.n_intermediate)])


def _fan_out(agg: DataFrame, names_by_gid: dict[int, list[str]], col: str) -> DataFrame:
    """Each aggregate row, once per model that reads its grouping."""
    models = None
    for gid, ns in names_by_gid.items():
        arr = F.array(*[F.lit(n) for n in ns])
        cond = F.col("_gid") == gid
        models = F.when(cond, arr) if models is None else models.when(cond, arr)
    return agg.select(F.explode(models).alias(col), *agg.columns)


def stacked_marts(lake: Lake, sc: Scenario) -> DataFrame:
    """All marts of a scenario in one pass: every row of the shared
    aggregate fans out (``explode``) to the marts whose intermediate uses
    its grouping.  One scan, one join, one shuffle, no union."""
    agg, gid_of_int = scenario_rollups(lake, sc)
    names: dict[int, list[str]] = {}
    for i in range(sc.n_marts):
        names.setdefault(gid_of_int[sc.intermediate_of(i)], []).append(mart_name(i))
    return marts.portfolio_summary(_fan_out(agg, names, "model"), keep=["model"])


def read_model(lake: Lake, root: str, layer: str, name: str) -> DataFrame:
    """One materialised model: a folder of the layer's dataset."""
    return lake.spark.read.parquet(f"{root}/{layer}/model={name}")


METRICS = ("metric_id long, scenario_id string, scenario_name string, phase string, started_at timestamp_ntz, "
           "finished_at timestamp_ntz, duration_sec decimal(12,3), rows_actual long, rows_projected long, "
           "rows_per_sec decimal(14,2), peak_mem_mb decimal(10,2), avg_cpu_pct decimal(6,2), models_count int, "
           "threads int, complexity string, pruning_active int, explain_cost long, partition_count long, "
           "partitions_pruned long, notes string")


class PhaseLog:
    """The metric rows of one scenario.  A phase's jobs run in a job group, so that the event
    log can say later what memory and CPU they used."""

    def __init__(self, lake: Lake, sc: Scenario):
        self.lake, self.sc, self.rows = lake, sc, []
        self.run = uuid.uuid4().hex[:12]
        self.settings = next(dict(zip(("name", "strategy", "threads", "projected"), (s[1], s[2], s[8], s[13]), strict=True))
                             for s in K.SCENARIOS if s[0] == sc.sid)

    @contextlib.contextmanager
    def phase(self, name: str):
        """Times a phase; its row's other fields are set on what this yields."""
        context = self.lake.spark.sparkContext
        before = {k: context.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description")}
        group = f"{self.run}:{self.sc.sid}:{name}"
        context.setJobGroup(group, f"{self.sc.sid} {name}")
        row = {"rows_actual": 0, "notes": ""}
        begun, t0 = datetime.now(timezone.utc).replace(tzinfo=None), time.time()
        try:
            yield row
        finally:
            for key, value in before.items():
                context.setLocalProperty(key, value)
            spent = time.time() - t0
            self.rows.append({
                "scenario_id": self.sc.sid, "scenario_name": self.settings["name"], "phase": name, "started_at": begun,
                "finished_at": begun + timedelta(seconds=spent), "duration_sec": round(spent, 3),
                "rows_projected": self.settings["projected"] or 0,
                "rows_per_sec": round(row["rows_actual"] / max(spent, 0.001), 2),
                "models_count": self.sc.n_models, "threads": self.settings["threads"], "complexity": self.sc.complexity,
                "pruning_active": int(self.sc.pruning), "job_group": group, **row, "notes": row["notes"][:K.NOTES_MAX_CHARS]})


def staging_tests(lake: Lake, sc: Scenario) -> DataFrame:
    """The tests of the scenario's own staging models: keys not null, dimension keys unique."""
    h, s, a = staged(lake, sc)
    return quality.union_all([
        quality.not_null_failures(h, "stg_holdings", ["account_id", "security_id", "as_of_date"]),
        quality.not_null_failures(s, "stg_securities", ["security_id"]),
        quality.not_null_failures(a, "stg_accounts", ["account_id"]),
        quality.unique_on_base(s, [("stg_securities", "security_id", F.col("security_id"))]),
        quality.unique_on_base(a, [("stg_accounts", "account_id", F.col("account_id"))])])


def _by_model(reads: dict[str, list[str]], column: str) -> Column:
    """The models that read what ``column`` names."""
    out = None
    for source, names in reads.items():
        held = F.array(*map(F.lit, names))
        out = F.when(F.col(column) == source, held) if out is None else out.when(F.col(column) == source, held)
    return out


def run_scenario(lake: Lake, sid: str, run_root: str | None = None) -> list[dict]:
    """Run one scenario end to end and return the metric rows of its five phases.

    ``data_generation`` reloads the scenario's slice (a scenario that shares another's slice
    writes nothing); ``dbt_compile`` plans every model; ``dbt_run``: the intermediates are one
    grouping-sets aggregate written once (one folder per intermediate model), and every mart is
    built from the stored intermediates in a single job (one folder per mart);
    ``dbt_test`` runs the tests of the scenario's own staging; ``collect_stats`` has the
    optimiser's cost and the months that pruning leaves out.  Rows are counted by the
    writes themselves.  Each write is an idempotent overwrite, so a rerun (or a job
    retried after a lost executor) leaves the same tables.
    """
    from .evidence import explained, scenario_cost

    sc = scenario(sid)
    root = run_root or f"{store_dir(lake.spark, lake.sf_dir)}/runs/{sid}"
    log = PhaseLog(lake, sc)

    with log.phase("data_generation") as row:
        if log.settings["strategy"] == "real_shared":
            row["notes"] = f"reads the slice of {staging.resolve_slice(sid)}"
        else:
            loaded, seen = sinks.counted(staging.scenario_slice(lake.holdings, sid))
            sinks.overwrite_partitions(loaded, f"{root}/raw_holdings", ["scenario_id"])
            row["rows_actual"] = seen.get["rows"]

    with log.phase("dbt_compile") as row:
        agg, gids = scenario_rollups(lake, sc)
        models = [*staged(lake, sc), *intermediates(lake, sc), stacked_marts(lake, sc)]
        row["notes"] = f"{sum(bool(explained(m)) for m in models)} plans for {sc.n_models} models"

    with log.phase("dbt_run") as row:
        if sc.complexity in ("complex", "extreme"):
            # The wide staging columns are never read downstream, so a lazy plan
            # would prune them away; materialise staging so their cost shows.
            sinks.full_refresh(staged(lake, sc)[0], f"{root}/stg_holdings")
        ints: dict[int, list[str]] = {}
        for j in range(sc.n_intermediate):
            ints.setdefault(gids[j], []).append(int_name(j))
        sinks.full_refresh(_fan_out(agg, ints, "model"), f"{root}/intermediates", ["model"])
        # Marts from the stored intermediates: one scan, each intermediate row
        # fanned out to the marts that read that intermediate.
        stored = lake.spark.read.parquet(f"{root}/intermediates")
        readers: dict[str, list[str]] = {}
        for i in range(sc.n_marts):
            readers.setdefault(int_name(sc.intermediate_of(i)), []).append(mart_name(i))
        fanned = stored.where(F.col("model").isin(list(readers))).select(
            F.explode(_by_model(readers, "model")).alias("mart"), *[c for c in stored.columns if c != "model"])
        built, seen = sinks.counted(marts.portfolio_summary(fanned, keep=["mart"]).withColumnRenamed("mart", "model"))
        sinks.full_refresh(built, f"{root}/marts", ["model"])
        row["rows_actual"] = seen.get["rows"]
        row["notes"] = f"{sc.n_models} of {sc.n_models} OK"

    with log.phase("dbt_test") as row:
        found = quality.summarize(staging_tests(lake, sc)).first()
        row["rows_actual"] = int(found["passed"])
        row["notes"] = f"{found['passed']} of {found['tests']} OK"

    with log.phase("collect_stats") as row:
        row["explain_cost"] = scenario_cost(lake, sid, sc.pruning)["cost"]
        months = lake.holdings.select("as_of_month").distinct()
        row["partition_count"] = months.count()
        kept = staging.trailing_window(lake.holdings).select(F.trunc("as_of_date", "MM").alias("m")).distinct().count()
        row["partitions_pruned"] = row["partition_count"] - kept if sc.pruning else 0
    return log.rows


def record_metrics(lake: Lake, rows: list[dict], path: str | None = None) -> str:
    """Append run metric rows (five per scenario) to the metrics table, with ids that go on from
    its high-water mark.  Memory and CPU come from the event log, where the
    session keeps one; else they stay null.  Returns the folder of the rows."""
    path = path or f"{store_dir(lake.spark, lake.sf_dir)}/run_metrics"
    schema = StructType.fromDDL(METRICS)
    given = [f for f in schema.fields if f.name not in ("metric_id", "peak_mem_mb", "avg_cpu_pct")]
    table = lake.spark.createDataFrame(
        [tuple(Decimal(str(r[f.name])) if isinstance(f.dataType, DecimalType) else r.get(f.name) for f in given)
         + (r["job_group"],) for r in rows], StructType([*given, StructField("job_group", StringType())]))
    cores = lake.spark.sparkContext.defaultParallelism
    share = 100 * F.col("cpu_sec") / (F.greatest(F.col("duration_sec").cast("double"), F.lit(0.001)) * cores)
    used = F.broadcast(resources.usage_so_far(lake.spark).filter(  # a row a phase of these rows
        F.col("job_group").isin([r["job_group"] for r in rows])))
    table = table.join(used, "job_group", "left").withColumns({
        "peak_mem_mb": F.col("peak_mem_mb").cast("decimal(10,2)"), "avg_cpu_pct": share.cast("decimal(6,2)")})
    return sinks.append_identified(table.select(*[f.name for f in schema.fields if f.name != "metric_id"]), path,
                                   ["started_at", "scenario_id", "phase"], "metric_id")


def read_metrics(lake: Lake, rows_path: str) -> DataFrame:
    """The recorded metric rows, as the run-metrics operators read them."""
    return lake.spark.read.schema(METRICS).parquet(rows_path).drop("append")


def run_all(lake: Lake, sids: list[str] | None = None, metrics_path: str | None = None) -> str:
    """The scenario loop: run each scenario, then append its metric rows.

    Scenarios run one after another (each is itself a set of distributed
    jobs); only a few metric rows per scenario reach the driver."""
    path = None
    for sid in sids or K.SCENARIO_IDS:
        path = record_metrics(lake, run_scenario(lake, sid), metrics_path)
    return path
