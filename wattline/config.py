"""Constants of the power / carbon / cost model, gathered in one dataclass.

Fixed values: these must equal the behaviour being reproduced, so they are
stated plainly here and nowhere else.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class EnergyModel:
    # --- fixed values (power model) ---
    power_base_w: float = 10.0          # W = 10 + 0.2 * memory_mb
    power_per_mb_w: float = 0.2
    ms_per_hour: float = 3_600_000.0
    # --- fixed values (carbon, cost) ---
    grid_kg_per_kwh: float = 0.708      # kg CO2 per kWh
    grid_g_per_kwh_ref: float = 708_000.0   # online "gCO2" variant multiplies kWh by this
    inr_per_gb_s: float = 0.001392
    inr_per_request: float = 16.70 / 1_000_000
    usd_per_gb_s: float = 0.0000166667
    usd_per_request: float = 0.20 / 1_000_000
    hours_per_month: int = 24 * 30
    # --- fixed values (floors and confidences) ---
    online_floor_wh: float = 0.0001
    batch_floor_wh: float = 0.0
    confidence: dict = field(default_factory=lambda: {
        "xgboost": 0.96, "random_forest": 0.94, "neural_network": 0.92, "fallback": 0.50})
    gap_confidence_high: float = 0.9998
    gap_confidence_low: float = 0.5000
    # --- fixed values (tiers and verdicts) ---
    drift_on_track_pct: float = 8.0
    drift_warning_pct: float = 20.0
    drift_critical_pct: float = 40.0
    transfer_strong_r2: float = 0.95
    transfer_moderate_r2: float = 0.85
    transfer_limited_r2: float = 0.70
    gap_excellent_pct: float = 90.0
    gap_good_pct: float = 75.0
    memory_tiers: tuple = (128, 256, 512, 1024, 2048, 3000)
    # --- fixed values (trace filters) ---
    min_invocations: int = 10
    memory_cap_mb: float = 1500.0
    duration_cap_ms: float = 300_000.0
    # --- fixed values (spike shape) ---
    spike_multiplier: float = 20.0
    spike_hours: int = 72
    baseline_rph: float = 10_000.0


DEFAULT_MODEL = EnergyModel()

# Default code metrics used when a bundle has no parsable source.
DEFAULT_CODE_METRICS = {
    "lines_of_code": 20.0, "num_loops": 2.0, "num_conditionals": 1.0,
    "num_function_calls": 5.0, "cyclomatic_complexity": 2.0, "max_nesting_depth": 2.0,
}
# Training means used where there is no training table.
FALLBACK_MEANS = {
    "cold_start": 0.033783783783783786, "lines_of_code": 23.86861861861862, "num_loops": 2.40015015015015,
    "num_conditionals": 0.668918918918919, "num_function_calls": 9.396396396396396, "cyclomatic_complexity": 4.069069069069069,
    "max_nesting_depth": 1.5375375375375375, "local_cpu_percent": 17.49655405405405, "memory_efficiency": 0.09614081855292793,
    "share_io": 0.3378, "share_memory": 0.3288,
}
# Default local / cloud durations (ms) when no measurement exists.
DEFAULT_LOCAL_DURATION_MS = 50.0
DEFAULT_AWS_DURATION_MS = 60.0

# Leakage columns removed before modelling.
LEAKAGE_COLUMNS = ("energy_target_wh", "local_energy_wh", "aws_energy_estimate_wh",
                   "aws_cold_start", "calibration_ratio")

# The 15 numeric model inputs, in model order.
NUMERIC_FEATURES = (
    "memory_config_mb", "cold_start", "lines_of_code", "num_loops", "num_conditionals",
    "num_function_calls", "cyclomatic_complexity", "max_nesting_depth", "local_duration_ms",
    "local_cpu_percent", "local_memory_mb", "aws_duration_ms", "aws_memory_used_mb",
    "duration_ratio", "memory_efficiency",
)

# The raw inputs of a request, in the order that a message lists them.
RAW_INPUTS = ("function_name", "function_type", "input_size", *NUMERIC_FEATURES)

# The 12 features checked against the training range.
RANGE_CHECK_FEATURES = (
    "memory_config_mb", "lines_of_code", "num_loops", "num_conditionals",
    "num_function_calls", "cyclomatic_complexity", "max_nesting_depth",
    "local_duration_ms", "local_cpu_percent", "local_memory_mb",
    "aws_duration_ms", "aws_memory_used_mb",
)
