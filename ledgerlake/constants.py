"""Fixed values shared by the Spark jobs and their DuckDB twins.

The FIXED VALUES block holds the values the original benchmark suite uses
(value domains, scenario settings, budgets and thresholds); they are data, not
logic. Two scenario names are shortened, and a ratio the original leaves out
(transactions of S7 and S8) is 0.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the original suite; keep in this order)
# ---------------------------------------------------------------------------
CURRENCIES = ["USD", "EUR", "GBP", "JPY", "CHF", "CAD", "AUD", "HKD"]
ASSET_CLASSES = ["EQUITY", "FIXED_INCOME", "FUND", "CASH", "DERIVATIVE"]
ACCOUNT_TYPES = ["PENSION", "ENDOWMENT", "SOVEREIGN", "INSURANCE", "PRIVATE_WEALTH"]
SECTORS = ["TECHNOLOGY", "FINANCIALS", "HEALTHCARE", "INDUSTRIALS", "ENERGY",
           "CONSUMER", "UTILITIES"]
TXN_TYPES = ["BUY", "SELL", "DIVIDEND", "INTEREST", "TRANSFER"]
COUNTRIES = ["US", "GB", "JP", "DE", "FR", "CH", "CA"]
RATINGS = ["AAA", "AA", "A", "BBB", "BB", "NR"]
RISK_PROFILES = ["CONSERVATIVE", "BALANCED", "GROWTH"]
MAJOR_FX = ["EUR", "GBP", "CHF"]

# Concentration bands: (lower bound exclusive, label), checked in order.
CONCENTRATION_BANDS = [(0.10, "CONCENTRATED"), (0.05, "OVERWEIGHT"), (0.01, "NORMAL")]
CONCENTRATION_DEFAULT = "UNDERWEIGHT"

# Asset class display labels; anything else is "Other".
ASSET_CLASS_DISPLAY = [("EQUITY", "Equity"), ("FIXED_INCOME", "Fixed Income"),
                       ("FUND", "Pooled Vehicle")]
ASSET_CLASS_DISPLAY_DEFAULT = "Other"

GROSS_UP_FACTOR = "1.2"
TRAILING_DAYS = 30
PROJECTED_MONTHS = 24
MIN_DURATION_MS = 1  # rows/s divides by max(duration, 0.001 s)
NOTES_MAX_CHARS = 3999
DEFAULT_RATING = "NR"

# Scenario defaults, then per-scenario settings.
SCENARIO_DEFAULTS = {"n_staging": 3, "n_intermediate": 2, "n_marts": 10,
                     "model_complexity": "medium", "use_partition_filter": False,
                     "txn_ratio": 0.0, "projected_rows": 0}
SCENARIOS = [
    # sid, name, strategy, n_securities, n_accounts, n_days, holdings_per_slot,
    # txn_ratio, threads, complexity, pruning, n_intermediate, n_marts, projected_rows
    ("S1", "Baseline", "real", 200, 30, 30, 15, 0.08, 1, "simple", False, 1, 3, None),
    ("S2", "Current State", "real", 500, 100, 60, 25, 0.06, 4, "medium", False, 2, 8, None),
    ("S3", "Full Migration", "real", 1000, 200, 90, 30, 0.05, 8, "medium", False, 3, 12, None),
    ("S4", "Complex SQL", "real", 500, 100, 60, 25, 0.08, 4, "extreme", False, 2, 8, None),
    ("S5", "Data at Scale — No Pruning", "real", 2000, 300, 90, 40, 0.04, 8, "medium", False, 2, 8, None),
    ("S6", "Data at Scale — Pruning ON", "real_shared", 2000, 300, 90, 40, 0.04, 8, "medium", True, 2, 8, None),
    ("S7", "Enterprise Full (1.1B rows projected)", "scaled_stats", 5000, 1000, 30, 33, None, 8, "complex", True, 3, 15, 1_100_000_000),
    ("S8", "Absolute Worst Case (5B rows projected)", "scaled_stats", 5000, 1000, 30, 33, None, 8, "extreme", True, 3, 15, 5_000_000_000),
]
SCENARIO_IDS = [s[0] for s in SCENARIOS]

# Minutes per scenario: data_gen, dbt_run, total.
TIME_BUDGET = [
    ("S1", 1, 2, 3), ("S2", 2, 3, 5), ("S3", 4, 5, 9), ("S4", 2, 5, 7),
    ("S5", 4, 4, 8), ("S6", 0, 1, 1), ("S7", 3, 2, 5), ("S8", 3, 2, 5),
]

# Report thresholds: metric, ok, warn.  Unknown metrics use the fallback pair.
THRESHOLDS = [("dbt_compile_s", 30, 120), ("dbt_run_s", 300, 1800),
              ("peak_memory_mb", 2048, 8192), ("avg_cpu_pct", 70, 95)]
THRESHOLD_FALLBACK = (999999, 9999999)

# Intermediate grouping variants, chosen by model index modulo 3.
GROUPINGS = [
    ("account_id", "security_id", "as_of_date"),
    ("account_id", "as_of_date", "asset_class"),
    ("account_id", "as_of_date", "sector"),
]

PHASES = ["data_generation", "dbt_compile", "dbt_run", "dbt_test", "collect_stats"]

# Lines of a run log: rows affected, the closing line, models that passed.
RUN_LOG_PATTERNS = (r"(?i)(\d+) rows affected",
                    r"Completed with (\d+) warnings? and (\d+) error",
                    r"(\d+) of (\d+) OK")
# ---------------------------------------------------------------------------
# END FIXED VALUES
# ---------------------------------------------------------------------------

# Fixture mapping from the driver's tables (see FIXTURES.md).  These are our
# own choices, not values of the original suite.
SLICE_CYCLE = ["S1", "S2", "S3", "S4", "S5", "S7", "S8"]
SHARED_SLICES = {"S6": "S5"}
EVENT_PHASE = [("click", "data_generation"), ("error", "collect_stats"),
               ("purchase", "dbt_compile"), ("signup", "dbt_run"),
               ("view", "dbt_test")]
