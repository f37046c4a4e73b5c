"""Incremental fact load as Structured Streaming.

New holdings files arriving in the month-partitioned landing folder are read
as a file stream (``trigger(availableNow=True)`` for a daily batch run).  The
stream only notes which months its batches touch, in files beside its
checkpoint.  When it has caught up, those months are rebuilt once from the
whole landed table, whose files are listed then (a month's account-day totals need all of
that month's rows, old and new), with a dynamic partition overwrite; last,
the batches are recorded as rebuilt.  A run that dies in between leaves its
notes, and the next run rebuilds their months.

``sync_months`` is the batch loader: it compares digests of the months instead.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import money_sum
from ..functions.sizing import HEAVY_ROWS, apart
from ..operators import sinks
from ..operators.sketches import among
from ..session import checkpoint_root
from ..sources import store


def account_day_by_month(h: DataFrame, most: int = HEAVY_ROWS) -> DataFrame:
    """Account-days with their month.  One shuffle by account-day serves the distinct count and the
    sums; accounts with more than ``most`` rows are combined before their shuffles instead."""
    few, many = apart(h.select("account_id", "as_of_date", "as_of_month", "security_id", "market_value_usd", "unrealized_gain"),
                      "account_id", most)
    return _account_days(few.repartition(*ACCOUNT_DAY)).unionByName(_account_days(many))


ACCOUNT_DAY = ["account_id", "as_of_date", "as_of_month"]


def _account_days(h: DataFrame) -> DataFrame:
    return (h.groupBy(*ACCOUNT_DAY)
             .agg(F.count_distinct("security_id").alias("sec_count"),
                  money_sum("market_value_usd").alias("total_mv"),
                  money_sum("unrealized_gain").alias("total_gain")))


def month_digests(h: DataFrame) -> DataFrame:
    """Per month, whatever the order of its rows: their number, the XOR of their hashes, and the
    sum of half of each hash (pairs of equal rows cancel in a XOR, not in a sum)."""
    row = F.xxhash64(*sorted(h.columns))
    return h.groupBy("as_of_month").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(row).alias("hashes"), F.sum(F.shiftright(row, 32)).alias("halves"))


DIGESTS = "as_of_month date, n long, hashes long, halves long"


def sync_months(h: DataFrame, out_path: str) -> list:
    """Rebuild the months of the target whose source rows differ from those it was built from, late
    rows and the null month included; returns them.

    The target keeps its source's digests beside it, written after the rebuilt months, so a
    run that dies is made up for.  A month that the source lost keeps its folder, but
    not its digest: read the target by ``synced``."""
    spark = h.sparkSession
    digests = f"{out_path}-digests"
    now = month_digests(h)
    now.write.mode("overwrite").parquet(f"{digests}-new")
    now = spark.read.schema(DIGESTS).parquet(f"{digests}-new")
    old = sinks.read_if_any(spark, digests, DIGESTS)
    same = reduce(Column.__and__, [now[c].eqNullSafe(old[c]) for c in now.columns])
    months = [r[0] for r in now.join(old, same, "left_anti").select("as_of_month").collect()]  # a value a month
    if months:
        sinks.overwrite_partitions(account_day_by_month(h.where(among(F.col("as_of_month"), months))), out_path, ["as_of_month"])
    now.write.mode("overwrite").parquet(digests)
    return months


def synced(spark: SparkSession, schema: StructType, out_path: str) -> DataFrame:
    """The target's months that its source has."""
    rows = sinks.read_if_any(spark, out_path, schema)
    months = sinks.read_if_any(spark, f"{out_path}-digests", DIGESTS).select(F.col("as_of_month").alias("_m"))
    return rows.join(months, rows["as_of_month"].eqNullSafe(F.col("_m")), "left_semi")


def rebuild_touched(spark: SparkSession, src_path: str, schema: StructType, out_path: str,
                    notes: str) -> list:
    """Rebuild the months of all noted batches that no run has rebuilt yet."""
    noted = sinks.read_if_any(spark, f"{notes}/touched", "as_of_month date, batch long")
    done = sinks.read_if_any(spark, f"{notes}/rebuilt", "batch long")
    todo = noted.join(done, "batch", "left_anti")
    # At most one value per month folder and one per batch of the last runs.
    batches = [r[0] for r in todo.select("batch").distinct().collect()]
    months = [r[0] for r in todo.select("as_of_month").distinct().collect()]
    if months:
        table = spark.read.schema(schema).parquet(src_path)  # listed now, not when the session began
        part = table.where(among(F.col("as_of_month"), months))  # static partition pruning
        sinks.overwrite_partitions(account_day_by_month(part), out_path, ["as_of_month"])
        spark.createDataFrame([(b,) for b in batches], "batch long").write.mode("append").parquet(f"{notes}/rebuilt")
    return months


def stream_months(spark: SparkSession, src_path: str, schema: StructType, out_path: str,
                  checkpoint: str, files_per_batch: int | None = None) -> str:
    """Consume the files under ``src_path`` not yet recorded in
    ``checkpoint`` and rebuild the months they touch."""
    notes = f"{checkpoint}-notes"

    def note(batch: DataFrame, batch_id: int) -> None:
        (batch.select("as_of_month").distinct()
         .write.mode("overwrite").parquet(f"{notes}/touched/batch={batch_id}"))

    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    q = (reader.parquet(src_path).writeStream.foreachBatch(note)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()
    rebuild_touched(spark, src_path, schema, out_path, notes)
    return out_path


def run_incremental(spark: SparkSession, sf_dir: str, out_path: str,
                    checkpoint: str | None = None) -> str:
    """Incremental load of the landed holdings of one input folder."""
    src_path = store.build(spark, sf_dir, "raw_holdings")
    schema = store.load(spark, sf_dir, "raw_holdings").schema
    checkpoint = checkpoint or f"{checkpoint_root(spark)}/ledgerlake-streams/{uuid.uuid4().hex}"
    return stream_months(spark, src_path, schema, out_path, checkpoint)
