"""Property-market analytics as Spark DataFrame jobs."""

from marketspark.config import MarketConfig

__all__ = ["MarketConfig"]
