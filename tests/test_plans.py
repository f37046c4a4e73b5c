"""Plan shape: pruning and pushdown reach the scan, dimensions broadcast,
and no skew-prone single-group window sits in the hot path."""

import contextlib
import io

from conftest import SF_CHECK

import __spark_entry__ as E

Q = E.queries()


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_column_pruned_scan_reads_ten_columns(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    p = plan(Q["src_column_pruned_scan"](spark, SF_CHECK))
    schema = [ln for ln in p.splitlines() if ln.startswith("ReadSchema")][0]
    fields = schema.split("struct<", 1)[1]
    assert fields.count(":") == 10
    assert "scenario_id" not in schema and "price_local" not in schema


def test_trailing_window_prunes_month_partitions(spark):
    p = plan(Q["flt_trailing_30d"](spark, SF_CHECK))
    assert "PartitionFilters: [isnotnull(as_of_month" in p
    assert "as_of_month#" in p.split("PartitionFilters:")[1].split("\n")[0]


def test_trailing_window_reads_few_months(spark):
    df = Q["src_partitioned_month_scan"](spark, SF_CHECK)
    months = df.select("as_of_month").distinct().count()
    total = Q["src_column_pruned_scan"](spark, SF_CHECK).count()
    assert months <= 3 and df.count() < total / 10


def test_scenario_filter_prunes_slice_folders(spark):
    p = plan(Q["flt_scenario_slice"](spark, SF_CHECK))
    part = p.split("PartitionFilters: [")[1].split("\n")[0]
    assert "scenario_id" in part and "= S2" in part


def test_dimensions_are_broadcast(spark):
    p = plan(Q["int_joined"](spark, SF_CHECK))
    nodes = [ln for ln in p.splitlines() if ln.startswith("(") and "BroadcastHashJoin" in ln]
    assert len(nodes) == 2
    assert "SortMergeJoin" not in p


def test_weight_and_last_row_avoid_group_windows(spark):
    for name in ["wn_position_weight", "wn_latest_phase", "obs_phase_pivot", "gen_position_measures"]:
        assert "Window" not in plan(Q[name](spark, SF_CHECK)), name


def test_rollup_has_partial_aggregate(spark):
    p = plan(Q["int_by_security"](spark, SF_CHECK))
    assert "partial_sum" in p and "partial_count" in p


def test_pipeline_is_one_scan_one_shuffle(spark):
    # S3: 12 marts over 3 intermediates -> one grouping-sets aggregate, one
    # shuffle, one scan of holdings, fanned out with explode (no union).
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        Q["pipe_S3"](spark, SF_CHECK).explain()
    p = buf.getvalue()
    assert p.count("Exchange hashpartitioning") == 1
    assert p.count("Expand [") == 1 and "Generate explode" in p
    assert "Union" not in p
    assert p.count("raw_holdings") == 1
