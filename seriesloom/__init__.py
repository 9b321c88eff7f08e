"""seriesloom: time-series analytics and forecasting as lazy Spark DataFrame operators."""

from seriesloom.spec import SeriesSpec

__all__ = ["SeriesSpec"]
