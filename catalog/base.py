"""Registry of queries, and the series that they start from."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from seriesloom.operators.clean import fill_missing_dates
from seriesloom.operators.series import build_series
from seriesloom.spec import SeriesSpec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

PANEL = SeriesSpec(group="grp")
ONE = SeriesSpec()
RAW = SeriesSpec(tie="event_id")
RAW_PANEL = SeriesSpec(group="grp", tie="event_id")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Daily revenue by order priority: grp, ts, y."""
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "grp")
    return build_series(orders, "o_orderdate", "o_totalprice", "D", ["grp"])


def revenue(spark: SparkSession, sf: str) -> DataFrame:
    """Daily revenue as one series: ts, y."""
    return build_series(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "D")


def gapped(spark: SparkSession, sf: str) -> DataFrame:
    """The panel on its full daily grid; days without an order have no value."""
    return fill_missing_dates(panel(spark, sf), PANEL, "D")


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumnRenamed("event_type", "grp")
    return build_series(events, "ts", "value", "H", ["grp"])


def raw_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_type").alias("grp"), "ts", F.col("value").alias("y"), "event_id")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# The same series for the checking engine.
PANEL_SQL = "pan AS (SELECT o_orderpriority AS grp, o_orderdate AS ts, sum(o_totalprice) AS y FROM orders GROUP BY ALL)"
REVENUE_SQL = "rev AS (SELECT o_orderdate AS ts, sum(o_totalprice) AS y FROM orders GROUP BY ALL)"
GAP_SQL = (
    PANEL_SQL + ", ends AS (SELECT grp, min(ts) AS a, max(ts) AS b FROM pan GROUP BY grp)"
    ", grid AS (SELECT grp, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS ts FROM ends)"
    ", gap AS (SELECT grid.grp, grid.ts, pan.y FROM grid LEFT JOIN pan USING (grp, ts))"
)
HOURLY_SQL = "hr AS (SELECT event_type AS grp, date_trunc('hour', ts) AS ts, sum(value) AS y FROM events GROUP BY ALL)"
RAW_SQL = "raw AS (SELECT event_type AS grp, ts, value AS y, event_id FROM events)"
