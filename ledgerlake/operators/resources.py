"""Resource use per job group, from Spark's own event log.

The log is read as a DataFrame: one JSON line per event, of which only job
starts and task ends are parsed.  A task's stage leads to the job that ran it
first, and that job to its group.
"""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = ("Event string, `Job ID` long, `Stage IDs` array<long>, Properties map<string,string>, `Stage ID` long, "
         "`Task Metrics` struct<`Executor CPU Time`: long, `Executor Run Time`: long, `Peak Execution Memory`: long>, "
         "`Task Executor Metrics` struct<JVMHeapMemory: long, JVMOffHeapMemory: long>")
USAGE = "job_group string, tasks long, cpu_sec double, run_sec double, peak_mem_mb double"
WAIT_SECONDS = 20


def event_log(spark: SparkSession) -> str | None:
    """Where this application's event log can be read, or None: it needs
    ``spark.eventLog.enabled`` and ``spark.eventLog.compress=false``."""
    conf = spark.sparkContext.getConf()
    if conf.get("spark.eventLog.enabled", "false") != "true" or conf.get("spark.eventLog.compress", "true") != "false":
        return None
    app = spark.sparkContext.applicationId
    return f"{conf.get('spark.eventLog.dir')}/{{{app}*,eventlog_v2_{app}*/events_*}}"


def events(spark: SparkSession, path: str) -> DataFrame:
    kinds = F.col("value").rlike('^\\{"Event":"SparkListener(JobStart|JobEnd|TaskEnd)"')
    return (spark.read.text(path).filter(kinds)
            .select(F.from_json("value", EVENT).alias("e")).select("e.*"))


def usage(log: DataFrame) -> DataFrame:
    """Per job group: tasks, CPU and run seconds, and the highest memory that any of its
    tasks saw (an executor's heap and off-heap use, or else a task's own)."""
    jobs = (log.filter(F.col("Event") == "SparkListenerJobStart")
            .select(F.col("Job ID").alias("job"), F.element_at("Properties", "spark.jobGroup.id").alias("job_group"),
                    F.explode("Stage IDs").alias("stage")))
    first = jobs.groupBy("stage").agg(F.min_by("job_group", "job").alias("job_group"))
    seen = F.coalesce(F.col("Task Executor Metrics.JVMHeapMemory") + F.col("Task Executor Metrics.JVMOffHeapMemory"), F.lit(0))
    tasks = log.filter(F.col("Event") == "SparkListenerTaskEnd").select(
        F.col("Stage ID").alias("stage"), F.col("Task Metrics.Executor CPU Time").alias("cpu"),
        F.col("Task Metrics.Executor Run Time").alias("run"),
        F.greatest(seen, F.coalesce(F.col("Task Metrics.Peak Execution Memory"), F.lit(0))).alias("memory"))
    return (tasks.join(first, "stage").filter(F.col("job_group").isNotNull()).groupBy("job_group")
            .agg(F.count(F.lit(1)).alias("tasks"), F.coalesce(F.sum("cpu") / 1e9, F.lit(0.0)).alias("cpu_sec"),
                 F.coalesce(F.sum("run") / 1e3, F.lit(0.0)).alias("run_sec"),
                 (F.max("memory") / (1 << 20)).alias("peak_mem_mb")))


def usage_so_far(spark: SparkSession) -> DataFrame:
    """``usage`` of this application's finished jobs; without a readable log an empty table.

    The log is written behind the jobs, so a last, marked job is awaited in it."""
    path = event_log(spark)
    if path is None:
        return spark.createDataFrame([], USAGE)
    group, context = f"usage-{time.time_ns()}", spark.sparkContext
    before = {k: context.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description")}
    context.setJobGroup(group, "mark in the event log")
    spark.range(1).count()
    for key, value in before.items():
        context.setLocalProperty(key, value)
    mark = F.element_at("Properties", "spark.jobGroup.id") == group
    end = time.time() + WAIT_SECONDS
    while time.time() < end:
        try:
            log = events(spark, path)
            if not log.filter((F.col("Event") == "SparkListenerJobStart") & mark).isEmpty():
                break
        except AnalysisException:  # not there yet
            pass
        time.sleep(0.5)
    else:
        return spark.createDataFrame([], USAGE)
    return usage(log)
