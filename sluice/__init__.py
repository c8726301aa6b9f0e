"""Policy-driven data readiness on Spark: profile, clean, audit and score tables at any size."""

__version__ = "0.1.0"
