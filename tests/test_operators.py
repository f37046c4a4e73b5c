"""Edge rows placed on purpose, and operators checked against brute force."""

import os
from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerlake import constants as K


def test_mart_ratio_asymmetry(spark):
    from ledgerlake.operators.marts import portfolio_summary
    rows = [("A1", date(2024, 1, 1), 1, Decimal("10.00"), Decimal("0.00"), Decimal("0"),
             Decimal("5.00"), Decimal("10.00")),
            ("A2", date(2024, 1, 1), 1, Decimal("0.00"), None, Decimal("0"), Decimal("0.00"),
             Decimal("0.00")),
            ("A3", date(2024, 1, 1), 2, Decimal("3.00"), Decimal("7.00"), Decimal("0"),
             Decimal("1.00"), Decimal("2.00"))]
    df = spark.createDataFrame(rows, "account_id string, as_of_date date, lot_count long, "
                               "total_mv_usd decimal(38,2), total_cost_usd decimal(38,2), "
                               "total_gain_usd decimal(38,2), cross_ccy_mv_usd decimal(38,2), "
                               "max_position_mv decimal(20,2)")
    out = {r.account_id: r for r in portfolio_summary(df).collect()}
    assert out["A1"].market_to_cost_ratio is None and out["A1"].cross_ccy_weight == 0.5
    assert out["A2"].market_to_cost_ratio is None and out["A2"].cross_ccy_weight == 0.0
    assert out["A3"].market_to_cost_ratio == 0.428571  # 3/7 = 0.4285714 -> half up at 6
    assert out["A3"].cross_ccy_weight == 0.333333


def test_cross_currency_tests_raw_case(spark):
    from ledgerlake.functions.columns import cross_currency_flag, fx_bucket
    df = spark.createDataFrame([("USD",), ("usd",), (None,), ("EUR",)], "c string")
    got = {r.c: (r.x, r.b) for r in df.select("c", cross_currency_flag(F.col("c")).alias("x"),
                                              fx_bucket(F.col("c")).alias("b")).collect()}
    assert got["USD"] == (0, "DOMESTIC")
    assert got["usd"] == (1, "EM_FX")   # lower case counts as foreign, as written
    assert got[None] == (0, "EM_FX")    # NULL <> 'USD' is unknown -> 0
    assert got["EUR"] == (1, "MAJOR_FX")


def test_layer_name_rules(spark):
    from ledgerlake.functions.columns import layer_name, layer_name_py
    assert layer_name_py("dev", "analytics", None) == "analytics"
    assert layer_name_py("prod", "analytics", " marts ") == "marts"
    assert layer_name_py("dev", "analytics", " marts ") == "analytics_marts"
    df = spark.createDataFrame([("dev", "analytics", None), ("prod", "analytics", " marts "),
                                ("ci", "analytics", "staging")], "t string, s string, c string")
    got = [r.n for r in df.select(layer_name(F.col("t"), F.col("s"), F.col("c")).alias("n")).collect()]
    assert got == ["analytics", "marts", "analytics_staging"]


def test_insert_defaults_only_for_missing_columns(spark):
    from ledgerlake.operators.sinks import insert_defaults, table_defaults
    df = spark.createDataFrame([("A1", None)], "account_id string, status string")
    out = insert_defaults(df, table_defaults("raw_accounts")).first()
    assert out.status is None                      # explicit NULL stays NULL
    df2 = spark.createDataFrame([("A1",)], "account_id string")
    assert insert_defaults(df2, table_defaults("raw_accounts")).first().status == "ACTIVE"


def test_identity_key_is_dense_and_ordered(spark):
    from ledgerlake.operators.sinks import identity_key
    df = spark.range(0, 5000).select(((F.col("id") * 7919) % 5000).alias("k"),
                                     F.lit("x").alias("v")).repartition(7)
    out = identity_key(df, ["k"], "ident", spark).collect()
    pairs = sorted((r.ident, r.k) for r in out)
    assert [p[0] for p in pairs] == list(range(1, 5001))
    assert [p[1] for p in pairs] == list(range(5000))


def test_sample_k_is_distinct_members_of_the_scenario(spark):
    from ledgerlake.operators.generators import sample_k
    from ledgerlake.plans.context import Lake
    lake = Lake(spark, SF_SMALL)
    out = sample_k(lake.holdings, lake.securities, spark)
    slot = ["scenario_id", "account_id", "slot_date"]
    bad = out.groupBy(*slot).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("security_id").alias("d"))
    assert bad.where("n <> d").count() == 0
    assert out.join(lake.securities, "security_id", "left_anti").count() == 0
    assert out.where(~F.col("security_id").startswith(F.col("scenario_id"))).count() == 0


def test_money_sums_keep_legal_amounts(spark):
    from ledgerlake.functions.columns import money_max, money_sum
    big = Decimal("60000000000000000.00")
    df = spark.createDataFrame([(big,), (big,)], "v decimal(20,2)")
    before = spark.conf.get("spark.sql.ansi.enabled")
    try:
        for ansi in ("true", "false"):
            spark.conf.set("spark.sql.ansi.enabled", ansi)
            r = df.agg(money_sum("v").alias("s"), money_max("v").alias("m")).first()
            assert (r.s, r.m) == (2 * big, big)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_halves_round_away_from_zero(spark):
    from ledgerlake.functions.columns import half_up_div
    df = spark.createDataFrame([(-5,), (-7,), (5,), (7,), (-4,), (0,)], "a long")
    got = [r[0] for r in df.select(half_up_div(F.col("a"), F.lit(2))).collect()]
    assert got == [-3, -4, 3, 4, -2, 0]


def _own_input(spark, tmp_path, name):
    """A writable copy of one input table beside links to the others."""
    import os
    for f in os.listdir(SF_SMALL):
        if f != f"{name}.parquet":
            os.symlink(f"{SF_SMALL}/{f}", tmp_path / f)
    spark.read.parquet(f"{SF_SMALL}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_a_grown_input_is_landed_anew(spark, tmp_path):
    from ledgerlake.plans.context import Lake
    d = _own_input(spark, tmp_path, "supplier")
    n = Lake(spark, d).accounts.count()
    more = spark.read.parquet(f"{SF_SMALL}/supplier.parquet").withColumn("s_suppkey", F.col("s_suppkey") + 1000)
    more.write.mode("append").parquet(f"{d}/supplier.parquet")
    assert Lake(spark, d).accounts.count() == 2 * n


def test_a_grown_dimension_is_no_longer_broadcast(spark, tmp_path):
    from ledgerlake.functions.sizing import sized_broadcast
    path = str(tmp_path / "dim")
    spark.range(10).write.parquet(path)
    dim = lambda: sized_broadcast(spark.read.parquet(path), max_bytes=10_000)
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(dim())
    spark.range(100_000).write.mode("overwrite").parquet(path)
    assert not hinted(dim())


def test_inventory_counts_files_and_bytes(spark):
    import os
    from ledgerlake.plans.context import Lake
    from ledgerlake.plans.q_sources import table_inventory
    from ledgerlake.sources import store
    rows = table_inventory(Lake(spark, SF_SMALL)).collect()
    assert [r.bytes for r in rows] == sorted((r.bytes for r in rows), reverse=True)
    for r in rows:
        top = store.table_path(spark, SF_SMALL, r.table_name).removeprefix("file:")
        sizes = [os.path.getsize(f"{d}/{f}") for d, _, fs in os.walk(top) for f in fs if f.endswith(".parquet")]
        assert (r.num_files, r.bytes) == (len(sizes), sum(sizes))


def test_key_prefix_is_a_strict_subset(spark):
    import __spark_entry__ as E
    from ledgerlake.plans.context import Lake
    n = E.queries()["flt_key_prefix"](spark, SF_SMALL).count()
    assert 0 < n < Lake(spark, SF_SMALL).holdings.count()


def test_run_log_completed_line_takes_precedence(spark):
    from ledgerlake.operators.metrics import run_log_summary
    lines = [(1, "S1", "dbt_run", "3 of 9 OK"), (2, "S1", "dbt_run", "WARN a ERROR b"),
             (3, "S1", "dbt_run", "Completed with 1 warning and 2 errors"),
             (4, "S1", "dbt_run", "Completed with 5 warnings and 6 errors"),
             (5, "S1", "dbt_run", "12 Rows Affected"),
             (1, "S2", "dbt_run", "4 of 9 OK"), (2, "S2", "dbt_run", "7 of 9 OK"),
             (3, "S2", "dbt_run", "WARN x WARN y ERROR z")]
    df = spark.createDataFrame(lines, "line_no long, scenario_id string, phase string, line string")
    got = {r.scenario_id: r for r in run_log_summary(df).collect()}
    assert (got["S1"].passes, got["S1"].warns, got["S1"].errors) == (0, 1, 2)
    assert got["S1"].rows_affected == 12
    assert (got["S2"].passes, got["S2"].warns, got["S2"].errors) == (4, 2, 1)


def test_human_formats(spark):
    from ledgerlake.operators.metrics import human_formats
    rows = [("S1", Decimal("59.949"), 999), ("S2", Decimal("90.000"), 2500),
            ("S3", Decimal("7200.000"), 1_250_000), ("S4", Decimal("1.250"), 5_000_000_000)]
    df = spark.createDataFrame(rows, "scenario_id string, total_duration_sec decimal(38,3), "
                               "total_rows long")
    got = {r.scenario_id: (r.duration_text, r.rows_text) for r in human_formats(df).collect()}
    assert got["S1"] == ("59.9s", "999")
    assert got["S2"] == ("1.5m", "3K")        # 2.5K rounds half up
    assert got["S3"] == ("2.0h", "1.3M")
    assert got["S4"] == ("1.3s", "5.00B")


def test_slice_resolver_and_explicit_run_date(spark):
    from ledgerlake.operators import staging
    assert staging.resolve_slice("S6") == "S5" and staging.resolve_slice("S2") == "S2"
    df = spark.createDataFrame([(date(2024, 3, 1), date(2024, 3, 1)), (date(2024, 1, 20), date(2024, 1, 1)),
                                (date(2024, 1, 31), date(2024, 1, 1))],
                               "as_of_date date, as_of_month date")
    kept = sorted(r.as_of_date for r in staging.trailing_window(df, run_date="2024-03-01").collect())
    assert kept == [date(2024, 1, 31), date(2024, 3, 1)]


def test_scenario_run_writes_marts_and_metrics(spark, tmp_path):
    import uuid

    from ledgerlake.operators import metrics as M
    from ledgerlake.plans.context import Lake
    from ledgerlake.plans.pipeline import (int_name, mart_name, read_metrics, read_model, record_metrics,
                                           run_scenario, scenario)
    lake = Lake(spark, SF_SMALL)
    root = f"{spark.conf.get('spark.checkpoint.dir', str(tmp_path))}/test-run-{uuid.uuid4().hex}"
    rows = run_scenario(lake, "S1", run_root=root)
    assert [r["phase"] for r in rows] == K.PHASES
    by = {r["phase"]: r for r in rows}
    sc = scenario("S1")
    for i in range(sc.n_marts):
        assert read_model(lake, root, "marts", mart_name(i)).count() > 0
    assert read_model(lake, root, "intermediates", int_name(0)).count() > 0
    assert by["dbt_run"]["rows_actual"] == sum(read_model(lake, root, "marts", mart_name(i)).count()
                                               for i in range(sc.n_marts))
    assert by["data_generation"]["rows_actual"] == lake.holdings.where("scenario_id = 'S1'").count()
    assert by["collect_stats"]["explain_cost"] > 0 and by["collect_stats"]["partitions_pruned"] == 0
    # The loop's own output feeds the run-metrics operators.
    for more in (rows, run_scenario(lake, "S6", run_root=f"{root}-6")):
        path = record_metrics(lake, more, path=f"{root}/run_metrics")
    m = read_metrics(lake, path)
    assert sorted(r.metric_id for r in m.collect()) == list(range(1, 11))
    rollup = {r.scenario_id: r for r in M.scenario_rollup(m).collect()}
    assert set(rollup) == {"S1", "S6"} and rollup["S1"].total_rows == sum(r["rows_actual"] for r in rows)
    pivot = M.phase_pivot(m).where("scenario_id = 'S6'").first()
    assert all(pivot[f"{p}_sec"] is not None for p in K.PHASES)
    assert M.scale_projection(m).count() == 10


def test_usage_from_an_event_log(spark, tmp_path):
    """Tasks lead to job groups; a stage that two jobs list belongs to the first."""
    import json

    from ledgerlake.operators.resources import events, usage
    start = lambda job, stages, group: {"Event": "SparkListenerJobStart", "Job ID": job, "Stage IDs": stages,
                                        "Properties": {"spark.jobGroup.id": group} if group else {}}
    end = lambda stage, cpu, peak, heap=0: {"Event": "SparkListenerTaskEnd", "Stage ID": stage,
                                            "Task Metrics": {"Executor CPU Time": cpu, "Executor Run Time": 5,
                                                             "Peak Execution Memory": peak},
                                            "Task Executor Metrics": {"JVMHeapMemory": heap, "JVMOffHeapMemory": 0}}
    lines = [start(0, [0, 1], "a"), end(0, 10 ** 9, 1 << 20), end(1, 2 * 10 ** 9, 0, 3 << 20), start(1, [1, 2], "b"),
             end(2, 10 ** 9, 5 << 20), start(2, [3], None), end(3, 10 ** 9, 0), {"Event": "SparkListenerApplicationEnd"}]
    (tmp_path / "log").write_text("\n".join(json.dumps(x, separators=(",", ":")) for x in lines) + "\nnot json\n")
    got = {r.job_group: (r.tasks, r.cpu_sec, r.peak_mem_mb) for r in usage(events(spark, str(tmp_path / "log"))).collect()}
    assert got == {"a": (2, 3.0, 3.0), "b": (1, 1.0, 5.0)}


def test_loop_metrics_from_this_sessions_event_log(tmp_path):
    """A session of its own, as the event log is set when a session starts."""
    import subprocess
    import sys
    code = f"""
from ledgerlake.session import local_session
from ledgerlake.plans.context import Lake
from ledgerlake.plans.pipeline import read_metrics, run_all
spark = local_session(4, 4, extra_conf={{"spark.eventLog.enabled": "true", "spark.eventLog.compress": "false",
    "spark.eventLog.dir": "file://{tmp_path}", "spark.checkpoint.dir": "{tmp_path}/ck"}})
lake = Lake(spark, "{SF_SMALL}")
rows = read_metrics(lake, run_all(lake, ["S1"])).collect()
assert len(rows) == 5 and all(r.peak_mem_mb > 0 and r.avg_cpu_pct > 0 for r in rows if r.phase in ("data_generation", "dbt_run")), rows
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]


def test_pipeline_marts_equal_per_mart_build(spark):
    from ledgerlake.plans.context import Lake
    from ledgerlake.plans.pipeline import intermediates, mart_name, scenario, stacked_marts
    from ledgerlake.operators.marts import portfolio_summary
    lake = Lake(spark, SF_SMALL)
    sc = scenario("S2")
    stacked = stacked_marts(lake, sc)
    ints = intermediates(lake, sc)
    for i in range(sc.n_marts):
        one = portfolio_summary(ints[sc.intermediate_of(i)])
        mine = stacked.where(F.col("model") == mart_name(i)).drop("model")
        assert mine.exceptAll(one).count() == 0 and one.exceptAll(mine).count() == 0


def test_broadcast_only_below_byte_bound(spark):
    from ledgerlake.functions.sizing import sized_broadcast
    import contextlib, io
    small = spark.range(100).selectExpr("id", "cast(id as string) as s")
    fact = spark.range(100000).selectExpr("id % 100 as id")

    def plan(df):
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain()
        return buf.getvalue()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(fact.join(sized_broadcast(small), "id"))
        assert "BroadcastHashJoin" not in plan(fact.join(sized_broadcast(small, max_bytes=1000), "id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sql_models_over_registered_views(spark):
    """A mart written as SQL over the registered views equals the DataFrame
    mart (the view materialisation, SNK-3)."""
    from ledgerlake.plans.context import Lake
    from ledgerlake.plans.pipeline import intermediates, scenario
    from ledgerlake.operators.marts import portfolio_summary
    lake = Lake(spark, SF_SMALL)
    names = lake.register_views("S2")
    assert "int_holdings_enriched_002" in names and "stg_holdings" in names
    sql = spark.sql("""
        SELECT account_id, as_of_date, lot_count, total_mv_usd, total_cost_usd, total_gain_usd,
               cross_ccy_mv_usd, max_position_mv,
               CASE WHEN total_cost_usd = 0 OR total_cost_usd IS NULL THEN NULL
                    ELSE CAST(ROUND(total_mv_usd / total_cost_usd, 6) AS DOUBLE) END AS market_to_cost_ratio,
               CASE WHEN total_mv_usd = 0 OR total_mv_usd IS NULL THEN 0D
                    ELSE CAST(ROUND(cross_ccy_mv_usd / total_mv_usd, 6) AS DOUBLE) END AS cross_ccy_weight
        FROM int_holdings_enriched_002""")
    df = portfolio_summary(intermediates(lake, scenario("S2"))[1])
    assert sql.count() == df.count() > 0
    assert sql.exceptAll(df).count() == 0


def test_cluster_conf_sizes_partitions():
    from ledgerlake.session import cluster_conf
    tb = 100 * 1024 ** 4
    c = cluster_conf(tb, executor_cores=8, executors=1000)
    assert int(c["spark.sql.shuffle.partitions"]) == tb // (128 * 1024 * 1024)
    assert c["spark.sql.adaptive.enabled"] == "true"
    small = cluster_conf(10 * 1024 ** 2, executor_cores=4, executors=2)
    assert int(small["spark.sql.shuffle.partitions"]) == 16


def test_unique_on_base_matches_per_test_counts(spark):
    from ledgerlake.operators.quality import unique_failures, unique_on_base
    rows = [("a", "X"), ("a", "x"), ("b", "Y"), (None, None), (None, "Z"), ("c", "z"), ("c", "Z"), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v string")
    got = {(r.model, r.column_name): r.failures for r in unique_on_base(df, [
        ("raw", "k", F.col("k")), ("raw", "v", F.col("v")), ("stg", "v", F.upper("v"))]).collect()}
    assert got[("raw", "k")] == 2            # 'a' and 'c' repeat; NULL keys are skipped
    assert got[("raw", "v")] == 1            # only 'Z' repeats as written
    assert got[("stg", "v")] == 2            # upper-cased: 'X' and 'Z' repeat
    assert got[("raw", "k")] == unique_failures(df, "raw", "k").first().failures


def test_three_appends_give_dense_stable_ids(spark, tmp_path):
    from ledgerlake.operators.sinks import append_identified
    path, seen = str(tmp_path / "t"), {}
    for k in range(3):
        df = spark.range(100 * k, 100 * k + 70 + k).select(((F.col("id") * 37) % 101).alias("k"), "id").repartition(5)
        if k == 2:  # an append that died before its mark is made up for by the next
            df.select(F.lit(1).cast("long").alias("ident"), "k", "id").write.parquet(f"{path}/rows/append=3")
        rows = spark.read.parquet(append_identified(df, path, ["k", "id"], "ident")).collect()
        ids = {r.id: r.ident for r in rows}
        assert sorted(ids.values()) == list(range(1, len(rows) + 1)) and len(ids) == len(rows)
        assert all(ids[i] == v for i, v in seen.items())
        new = [r for r in rows if r.id not in seen]
        assert [r.id for r in sorted(new, key=lambda r: r.ident)] == [r.id for r in sorted(new, key=lambda r: (r.k, r.id))]
        seen = ids


def test_ranks_over_groups_with_nulls_and_ties(spark, tmp_path):
    from ledgerlake.operators.ranks import numbered
    rows = [(None if k % 7 == 0 else f"g{k % 3}" if k % 2 else "hot", None if k % 11 == 0 else k % 50) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(9)
    out = numbered(df, ["g"], ["v"], str(tmp_path / "w")).collect()
    groups = {}
    for r in out:
        groups.setdefault(r.g, []).append((r["rank"], r.v if r.v is not None else -1, r.n))
    assert len(out) == 3000
    for got in groups.values():
        got.sort()
        assert [x[0] for x in got] == list(range(len(got))) and {x[2] for x in got} == {len(got)}
        assert [x[1] for x in got] == sorted(x[1] for x in got)
    assert numbered(df.limit(0), ["g"], ["v"], str(tmp_path / "e")).count() == 0


def test_permutation_of_ranks(spark):
    from ledgerlake.operators.ranks import halves, permuted, slot_keys
    sizes = [1, 2, 3, 5, 10, 37, 100, 257]
    df = spark.createDataFrame([(n, s) for n in sizes for s in range(40)], "n long, s long")
    df = df.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    keys = slot_keys(F.col("s").cast("string"))
    out = df.select("n", "s", "x", permuted(F.col("x"), F.col("n"), *halves(F.col("n")), keys).alias("y")).collect()
    per = {}
    for r in out:
        per.setdefault((r.n, r.s), {})[r.x] = r.y
    for (n, _), p in per.items():
        assert sorted(p.values()) == list(range(n))
    big = [p for (n, _), p in per.items() if n == 257]
    assert len({tuple(p[k] for k in range(5)) for p in big}) == len(big)           # slots differ
    assert sum(abs(p[k + 1] - p[k]) == 1 for p in big for k in range(256)) < 0.03 * 256 * len(big)  # not neighbours


def test_sample_k_draws_only_and_all_listed_members(spark, tmp_path):
    from ledgerlake.operators.generators import sample_k
    from ledgerlake.plans.context import Lake
    lake = Lake(spark, SF_SMALL)
    listed = lake.securities.filter("substr(security_id, 4, 6) % 3 <> 1")  # keys with gaps
    out = sample_k(lake.holdings, listed, spark, str(tmp_path / "ranks"))
    assert out.join(listed, "security_id", "left_anti").count() == 0
    drawn = {r[0] for r in out.select("scenario_id").distinct().collect()}
    members = listed.filter(F.substring("security_id", 1, 2).isin(*drawn))
    assert members.join(out, "security_id", "left_anti").count() == 0


def _lines(spark, path):
    """Line items with null and doubled keys, one account with most rows, values that any weight holds."""
    rows = [(k % 50, k % 7, None if k % 23 == 0 else (0 if k % 3 else k % 5), k % 4, float(k % 6), (k % 90) + 0.25, 0.01 * (k % 9),
             0.01 * (k % 8), None if k % 29 == 0 else date(2024, 1 + k % 3, 1 + k % 2)) for k in range(400)]
    (spark.createDataFrame(rows + rows[:40], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                           "l_extendedprice double, l_discount double, l_tax double, l_shipdate date")
     .withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp")).write.parquet(f"{path}/lineitem.parquet"))


def test_landed_weights_with_null_and_heavy_accounts(spark, tmp_path):
    from ledgerlake.sources import fixtures
    _lines(spark, tmp_path)
    h = fixtures.raw_holdings(spark, str(tmp_path))
    assert h.count() == 440
    totals = fixtures.account_day_totals(h)
    weight = fixtures.weight_column(F.col("market_value_usd"), F.col("_acct_total"))
    plain = h.join(totals, ["account_id", "as_of_date"], "left").withColumn("weight_in_acct", weight).select(*h.columns)
    for most in (0, 60, 10 ** 6):  # every account is heavy, some are, none is
        lots = fixtures.holding_lots(spark, str(tmp_path), most)
        got = fixtures.holdings_of(lots)
        assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0
        # One string a row is shuffled; before, account, security, currency and scenario were.
        assert [n for n, t in lots.dtypes if t == "string"] == ["scenario_id"]


def test_large_dimension_is_hashed_not_sorted(spark):
    """A dimension too large to broadcast, whose partitions are small: the fact side is not sorted."""
    from ledgerlake.functions.sizing import join_dimension
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fact = spark.range(20_000).select((F.col("id") % 500).alias("k"), "id").repartition(4)
        dim = spark.range(400).select(F.col("id").alias("k"), F.col("id").cast("string").alias("name")).repartition(2)
        j = join_dimension(fact, dim, "k", "left", max_bytes=0)
        assert len(j.collect()) == 20_000
        plan = j._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _holdings(spark):
    """Holdings of four slices, with doubled slots, weekends and a null date."""
    rows = [(f"S{k % 4 + 2}", f"A{k % 3}", None if k == 7 else date(2024, 1, 1 + k % 12)) for k in range(60)]
    return spark.createDataFrame(rows, "scenario_id string, account_id string, as_of_date date")


def test_packed_names_come_back(spark):
    from ledgerlake.operators.ranks import PACK_BITS, packed, unpacked
    odd = ["", " ", ".", "a", "a ", "a.", "a. ", " a", "ä", "äö", "日本 ", "x" * 300, "S1_000001", "S1_0000010"]
    for names in (odd, [f"S{k % 3}_{k:05d}{'é' * (k % 4)}" for k in range(1000)], ["one"], []):
        df = spark.createDataFrame([*enumerate(names)], "place long, name string").repartition(5)
        rows = packed(df, F.col("place"), F.col("name"))
        assert rows.count() == -(-len(names) // (1 << PACK_BITS))
        got = df.select("place").join(rows, F.shiftright("place", PACK_BITS) == F.col("pack")).select("place", unpacked(F.col("place"))).collect()
        assert dict(map(tuple, got)) == dict(enumerate(names)) and len(got) == len(names)


def test_sample_k_draws_are_not_shuffled(spark, tmp_path):
    """800,000 members, more than are broadcast a row each: before, every draw was shuffled to its member."""
    from ledgerlake.operators.generators import sample_k
    listed = spark.range(800_000).select(F.format_string("S%d_%06d", F.col("id") % 8 + 1, "id").alias("security_id"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = sample_k(_holdings(spark), listed, spark, str(tmp_path / "ranks"))
        rows = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        assert plan.count("Exchange hashpartitioning") == 1  # the slots'
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    draws = {"S2": 25, "S3": 30, "S4": 25, "S5": 40, "S6": 40}
    slots = {(r.scenario_id, r.account_id, r.slot_date) for r in rows}
    assert len(rows) == sum(draws[s] for s, _, _ in slots) == len({(*r[:3], r.security_id) for r in rows})
    assert all(r.security_id[:2] == r.scenario_id and (int(r.security_id[3:]) % 8) + 1 == int(r.scenario_id[1]) for r in rows)


def test_sample_k_in_tiles_is_the_same(spark, tmp_path, monkeypatch):
    from ledgerlake.operators import generators, ranks
    listed = spark.range(3000).where("id % 3 <> 1").select(
        F.format_string("S%d_%06d", F.col("id") % 8 + 1, "id").alias("security_id"))

    def sample(members, size, name):
        return sorted(map(tuple, generators.sample_k(_holdings(spark), members, spark, str(tmp_path / name), size).collect()))

    whole = sample(listed, 10 ** 6, "whole")
    assert whole
    monkeypatch.setattr(ranks, "BLOCK_BITS", 3)
    for most, size, tiled in ((9, 3000, True), (1, 3000, False), (9, 10, False)):  # too many tiles, too large blocks
        monkeypatch.setattr(ranks, "MOST_TILES", most)
        assert sample(listed, size, f"{most}-{size}") == whole
        rows = spark.read.parquet(str(tmp_path / f"{most}-{size}/packed"))
        runs = ranks.tiles(rows, size)
        blocks = sorted(r.block for r in rows.select("block").distinct().collect())
        assert [b for low, high in runs for b in range(low, high + 1)] == (blocks if tiled else [])
        assert not tiled or len(runs) > 1
    assert sample(listed.limit(0), 10 ** 6, "none") == []
