"""faultcast: a Spark-native engine for weather-driven fault forecasting.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark
SQL built-in expressions, so Catalyst can push filters, prune columns and
keep the work inside whole-stage codegen. Column names, thresholds and
window sizes are parameters; the weather roles live in one spec
(:mod:`faultcast.plans.spec`).
"""

__version__ = "0.3"

__all__ = ["session"]
