"""wattline: energy, carbon and cost analytics for serverless workloads on Spark.

Every operator is a function ``DataFrame -> DataFrame`` written with the
DataFrame API, so Catalyst prunes columns, pushes filters into the Parquet
scan and fuses projections into whole-stage codegen.  Python only runs where
the work cannot be expressed with built-in expressions (pandas functions
for the surrogate / MLP fits and the source-code metrics job).
"""

from wattline.config import EnergyModel, DEFAULT_MODEL

__all__ = ["EnergyModel", "DEFAULT_MODEL"]
