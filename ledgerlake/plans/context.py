"""Per-input-folder access to the landed raw tables and staged models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import joins, staging
from ..session import apply_conf, store_dir
from ..sources import store


class Lake:
    """The raw tables of one input folder, landed once and read back."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        apply_conf(spark)

    def raw(self, name: str) -> DataFrame:
        return store.load(self.spark, self.sf_dir, name)

    def sink_path(self, name: str) -> str:
        """An output folder of this application: concurrent ones do not meet."""
        app = self.spark.sparkContext.applicationId
        return f"{store_dir(self.spark, self.sf_dir)}/sinks/{app}/{name}"

    @property
    def holdings(self) -> DataFrame:
        return self.raw("raw_holdings")

    @property
    def securities(self) -> DataFrame:
        return self.raw("raw_securities")

    @property
    def accounts(self) -> DataFrame:
        return self.raw("raw_accounts")

    @property
    def transactions(self) -> DataFrame:
        return self.raw("raw_transactions")

    @property
    def metrics(self) -> DataFrame:
        return self.raw("stress_metrics")

    @property
    def run_log(self) -> DataFrame:
        return self.raw("run_log")

    # staged models ------------------------------------------------------
    def stg_holdings(self, sid=None, pruning=False, complexity="medium", run_date=None,
                     keep_month=False) -> DataFrame:
        return staging.stg_holdings(self.holdings, sid, pruning, complexity, run_date, keep_month)

    def stg_securities(self) -> DataFrame:
        return staging.stg_securities(self.securities)

    def stg_accounts(self) -> DataFrame:
        return staging.stg_accounts(self.accounts)

    def enriched(self, sid=None, pruning=False, complexity="medium") -> DataFrame:
        return joins.enriched(self.stg_holdings(sid, pruning, complexity),
                              self.stg_securities(), self.stg_accounts())

    def register_views(self, sid: str | None = None) -> list[str]:
        """Sources, staging and intermediate models as temporary views (the
        "view" materialisation), so they can be queried with spark.sql."""
        from .pipeline import int_name, intermediates, scenario
        views = {n: self.raw(n) for n in ("raw_holdings", "raw_securities", "raw_accounts",
                                          "raw_transactions", "stress_metrics")}
        if sid is None:
            views["stg_holdings"] = self.stg_holdings()
        else:
            sc = scenario(sid)
            views["stg_holdings"] = self.stg_holdings(sid, sc.pruning, sc.complexity)
            for j, df in enumerate(intermediates(self, sc)):
                views[int_name(j)] = df
        views["stg_securities"] = self.stg_securities()
        views["stg_accounts"] = self.stg_accounts()
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        return sorted(views)
