"""Column expressions of the power, energy, carbon and cost model.

All are built-in arithmetic, so they fuse into whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattline.config import DEFAULT_MODEL, EnergyModel


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def power_w(memory_mb, m: EnergyModel = DEFAULT_MODEL) -> Column:
    return F.lit(m.power_base_w) + F.lit(m.power_per_mb_w) * _c(memory_mb)


def energy_wh(memory_mb, duration_ms, m: EnergyModel = DEFAULT_MODEL) -> Column:
    return power_w(memory_mb, m) * _c(duration_ms) / F.lit(m.ms_per_hour)


def carbon_kg(energy_kwh, m: EnergyModel = DEFAULT_MODEL) -> Column:
    return _c(energy_kwh) * F.lit(m.grid_kg_per_kwh)


def gb_seconds(memory_mb, duration_ms) -> Column:
    return (_c(memory_mb) / 1024) * (_c(duration_ms) / 1000)


def cost_per_call_inr(memory_mb, duration_ms, m: EnergyModel = DEFAULT_MODEL) -> Column:
    return gb_seconds(memory_mb, duration_ms) * F.lit(m.inr_per_gb_s) + F.lit(m.inr_per_request)


def cost_per_call_usd(memory_mb, duration_ms, m: EnergyModel = DEFAULT_MODEL) -> Column:
    return gb_seconds(memory_mb, duration_ms) * F.lit(m.usd_per_gb_s) + F.lit(m.usd_per_request)


def floor_prediction(pred, floor: float) -> Column:
    """``max(floor, p)``; a null prediction stays null (``greatest`` alone
    would return the floor)."""
    p = _c(pred)
    return F.when(p.isNull(), F.lit(None).cast("double")).otherwise(F.greatest(F.lit(float(floor)), p))


def abs_error(actual, pred) -> Column:
    return F.abs(_c(actual) - _c(pred))


def pct_error(actual, pred) -> Column:
    """|a - p| / max(a, 1e-9) * 100."""
    return abs_error(actual, pred) / F.greatest(_c(actual), F.lit(1e-9)) * 100.0


def floored_accuracy(actual, pred) -> Column:
    return F.greatest(F.lit(0.0), 100.0 - pct_error(actual, pred))
