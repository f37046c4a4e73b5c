"""Per-scenario run-metrics rollup maintained as a streaming aggregation.

Metric rows only ever get appended.  The rollup (total duration, peak
memory, peak CPU, total rows per scenario) is the batch operator
``metrics.scenario_rollup`` run on a file stream: Spark keeps one partial
aggregate per scenario in its state store, so state is bounded by the
number of scenarios, not by the rows seen.  Each micro-batch's complete
result replaces the output table; the checkpoint lets a restarted or
retried run resume where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.metrics import scenario_rollup


def stream_rollup(spark: SparkSession, src_path: str, schema, out_path: str,
                  checkpoint: str) -> str:
    def replace(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out_path)

    q = (scenario_rollup(spark.readStream.schema(schema).parquet(src_path))
         .writeStream.outputMode("complete")
         .foreachBatch(replace)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()
    return out_path
