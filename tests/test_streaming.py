"""The streaming incremental load: a second run consumes only new files,
rebuilds only the months they touch, and equals a full build."""

import uuid

from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from conftest import SF_SMALL


def test_incremental_run_picks_up_new_and_late_files(spark):
    """Two runs in one session, with new and late files in between."""
    from ledgerlake.operators import sinks
    from ledgerlake.plans.context import Lake
    from ledgerlake.session import STORE_TAG_CONF, checkpoint_root
    from ledgerlake.sources import store
    from ledgerlake.streaming.incremental import account_day_by_month, run_incremental

    h = Lake(spark, SF_SMALL).holdings
    months = sorted(r[0] for r in h.select("as_of_month").distinct().collect())
    old, new = months[:-3], months[-3:]
    first = h.where(F.col("as_of_month").isin(old))
    late = first.where(F.col("as_of_month") == old[0]).limit(1)  # held back
    run = f"{checkpoint_root(spark)}/test-stream-{uuid.uuid4().hex}"
    out, ckpt = f"{run}/out", f"{run}/ckpt"
    spark.conf.set(STORE_TAG_CONF, uuid.uuid4().hex)  # a store of this test's own
    try:
        src = store.build(spark, SF_SMALL, "raw_holdings")
        keys = ["as_of_month", "scenario_id"]
        store.write_table(first.exceptAll(late), src, keys, ["account_id"])
        run_incremental(spark, SF_SMALL, out, ckpt)
        got1 = spark.read.parquet(out)
        assert got1.select("as_of_month").distinct().count() == len(old)
        untouched = old[len(old) // 2]
        before = {tuple(r) for r in got1.where(F.col("as_of_month") == untouched).collect()}

        sinks.bulk_append(h.where(F.col("as_of_month").isin(new)).unionByName(late), src, keys)
        run_incremental(spark, SF_SMALL, out, ckpt)
        got = spark.read.schema(account_day_by_month(h).schema).parquet(out)
        full = account_day_by_month(h).select(*got.columns)
        assert got.exceptAll(full).count() == 0 and full.exceptAll(got).count() == 0
        after = {tuple(r) for r in spark.read.parquet(out).where(F.col("as_of_month") == untouched).collect()}
        assert before == after
    finally:
        spark.conf.unset(STORE_TAG_CONF)


def test_a_run_that_died_before_its_rebuild_is_made_up_for(spark):
    from ledgerlake.plans.context import Lake
    from ledgerlake.session import checkpoint_root
    from ledgerlake.sources import store
    from ledgerlake.streaming import incremental as inc

    h = Lake(spark, SF_SMALL).holdings
    run = f"{checkpoint_root(spark)}/test-stream-{uuid.uuid4().hex}"
    src = store.table_path(spark, SF_SMALL, "raw_holdings")
    rebuild, inc.rebuild_touched = inc.rebuild_touched, lambda *a: None  # the first run ends here
    try:
        inc.stream_months(spark, src, h.schema, f"{run}/out", f"{run}/ckpt")
    finally:
        inc.rebuild_touched = rebuild
    inc.stream_months(spark, src, h.schema, f"{run}/out", f"{run}/ckpt")
    assert spark.read.parquet(f"{run}/out").count() == inc.account_day_by_month(h).count()


def test_streaming_metrics_rollup_equals_batch(spark):
    from ledgerlake.operators import sinks
    from ledgerlake.operators.metrics import scenario_rollup
    from ledgerlake.plans.context import Lake
    from ledgerlake.session import checkpoint_root
    from ledgerlake.streaming.metrics_rollup import stream_rollup

    m = Lake(spark, SF_SMALL).metrics
    cut = m.agg(F.percentile_approx("metric_id", 0.5)).first()[0]
    run = f"{checkpoint_root(spark)}/test-rollup-{uuid.uuid4().hex}"
    src, out, ckpt = f"{run}/src", f"{run}/out", f"{run}/ckpt"

    sinks.bulk_append(m.where(F.col("metric_id") <= cut), src)
    stream_rollup(spark, src, m.schema, out, ckpt)
    first = spark.read.parquet(out)
    exp1 = scenario_rollup(m.where(F.col("metric_id") <= cut)).select(*first.columns)
    assert first.exceptAll(exp1).count() == 0 and exp1.exceptAll(first).count() == 0

    sinks.bulk_append(m.where(F.col("metric_id") > cut), src)
    stream_rollup(spark, src, m.schema, out, ckpt)
    got = spark.read.parquet(out)
    exp = scenario_rollup(m).select(*got.columns)
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0


def _holdings(spark, rows):
    return spark.createDataFrame(rows, "account_id string, security_id string, as_of_date date, as_of_month date, "
                                       "market_value_usd decimal(20,2), unrealized_gain decimal(20,2)")


def _row(k, day, month, value="1.00"):
    return (f"A{k % 3}", f"S{k}", day, month, Decimal(value), None)


def test_months_with_late_null_and_doubled_rows_are_rebuilt_by_digest(spark, tmp_path):
    from ledgerlake.streaming.incremental import account_day_by_month, sync_months, synced
    jan, feb, out = date(2024, 1, 1), date(2024, 2, 1), str(tmp_path / "t")
    rows = [_row(k, date(2024, 1 + k % 2, 3), (jan, feb)[k % 2]) for k in range(20)]

    def check(expected):
        h = _holdings(spark, rows)
        assert set(sync_months(h, out)) == expected
        want, got = account_day_by_month(h), synced(spark, account_day_by_month(h).schema, out).select(*account_day_by_month(h).columns)
        assert want.exceptAll(got).count() == 0 and got.exceptAll(want).count() == 0

    check({jan, feb})
    check(set())
    rows += [_row(50, date(2024, 1, 9), jan)]                  # a late row
    check({jan})
    rows += [_row(51, None, None), _row(52, None, None)]       # no month
    check({None})
    rows += [_row(60, date(2024, 2, 9), feb)] * 2              # two equal rows cancel in an XOR
    check({feb})
    rows[-2:] = [_row(61, date(2024, 2, 9), feb)] * 2
    check({feb})
    rows[:] = [r for r in rows if r[3] != jan]                 # a month that is gone
    check(set())


def test_noted_months_may_be_null(spark, tmp_path):
    from ledgerlake.streaming.incremental import account_day_by_month, rebuild_touched
    h = _holdings(spark, [_row(1, None, None), _row(2, date(2024, 1, 2), date(2024, 1, 1))])
    src, out, notes = (str(tmp_path / x) for x in ("src", "out", "notes"))
    h.write.partitionBy("as_of_month").parquet(src)
    h.select("as_of_month").distinct().write.parquet(f"{notes}/touched/batch=0")
    schema = spark.read.schema(h.schema).parquet(src).schema
    assert set(rebuild_touched(spark, src, schema, out, notes)) == {None, date(2024, 1, 1)}
    assert spark.read.schema(account_day_by_month(h).schema).parquet(out).count() == 2


def test_sketches_of_new_months_merge_to_a_full_rebuild(spark, tmp_path):
    from ledgerlake.operators import sketches
    src, path, other = (str(tmp_path / x) for x in ("src", "a", "b"))
    cols = ["account_id", "security_id", "market_value_usd"]

    def rows(month, n, null=False):
        return _holdings(spark, [_row(k * 7 + month, date(2024, month, 2), None if null else date(2024, month, 1), f"{k}.00")
                                 for k in range(n)])

    rows(1, 500).unionAll(rows(2, 300)).write.partitionBy("as_of_month").parquet(src)
    table = lambda: spark.read.schema(rows(1, 1).schema).parquet(src)
    assert len(sketches.refresh(table(), src, path, "as_of_month", cols)) == 2
    assert sketches.refresh(table(), src, path, "as_of_month", cols) == []
    rows(3, 900).unionAll(rows(2, 50)).write.mode("append").partitionBy("as_of_month").parquet(src)
    rows(4, 20, null=True).write.mode("append").partitionBy("as_of_month").parquet(src)
    assert set(sketches.refresh(table(), src, path, "as_of_month", cols)) == {date(2024, 2, 1), date(2024, 3, 1), None}
    sketches.refresh(table(), src, other, "as_of_month", cols)
    got, want = (sorted(tuple(r) for r in sketches.merged(
        sketches.stored_sketches(table(), p, "as_of_month", cols), cols).collect()) for p in (path, other))
    assert got == want and [r[1] for r in got] == [1770] * 3
    exact = table().agg(*[F.countDistinct(c).alias(c) for c in cols]).first()
    assert all(abs(r[2] - exact[r[0]]) <= max(1, sketches.ERROR * exact[r[0]]) for r in got)


def test_account_days_take_one_shuffle_and_heavy_accounts_count_alike(spark):
    from ledgerlake.streaming import incremental as inc
    rows = [_row(k % 40, date(2024, 1 + k % 2, 3), date(2024, 1 + k % 2, 1)) for k in range(200)]
    rows += [(None, "S1", None, None, None, None)] * 3 + [("A0", None, date(2024, 1, 3), date(2024, 1, 1), Decimal(2), Decimal(1))]
    h = _holdings(spark, rows)
    want = h.groupBy("account_id", "as_of_date", "as_of_month").agg(
        F.count_distinct("security_id").alias("sec_count"), F.sum("market_value_usd").cast("decimal(38,2)").alias("total_mv"),
        F.sum("unrealized_gain").cast("decimal(38,2)").alias("total_gain"))
    for most in (0, 66, 10 ** 6):
        got = inc.account_day_by_month(h, most)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    one = inc._account_days(h.repartition(*inc.ACCOUNT_DAY))
    assert one._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
