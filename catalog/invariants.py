"""What must hold for results that SQL can't compute: the same full work, reduced to rows that SQL can state."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import HOURLY_SQL, PANEL, PANEL_SQL, QUERIES, panel, query
from seriesloom.operators import spectral

_GRID_SQL = f"""WITH {PANEL_SQL}, ends AS (SELECT grp, max(ts) AS b FROM pan GROUP BY grp)
SELECT grp, CAST(h AS INTEGER) AS h, b + to_days(CAST(h AS INTEGER)) AS ts, true AS in_band FROM ends, (SELECT unnest(generate_series(1, 30)) AS h)"""


def _in_band(df, lo, hi):
    return df.select("grp", F.col("h").cast("int").alias("h"), "ts", ((F.col(lo) <= F.col("yhat")) & (F.col("yhat") <= F.col(hi))).alias("in_band"))


@query("fc_arima_grid", _GRID_SQL)
def _(spark, sf):
    return _in_band(QUERIES["fc_arima"](spark, sf), "lo", "hi")


@query("fc_arima_exog_grid", _GRID_SQL)
def _(spark, sf):
    return _in_band(QUERIES["fc_arima_exog"](spark, sf), "lo", "hi")


@query("seasonal_difference_rule", f"""WITH {PANEL_SQL}, {HOURLY_SQL}
SELECT grp, 7 AS period, count(*) AS n, 1.69202 AS critical, true AS rule FROM pan GROUP BY grp UNION ALL SELECT grp, 24, count(*), 5.098624, true FROM hr GROUP BY grp""")
def _(spark, sf):
    out = QUERIES["seasonal_difference"](spark, sf)
    rule = (F.col("ch_stat") > 0) & ((F.col("ch_stat") > F.col("ch_critical")) == (F.col("seasonal_d") == 1))
    return out.select("grp", "period", "n", F.col("ch_critical").alias("critical"), rule.alias("rule"))


@query("fc_decomposable_grid", _GRID_SQL)
def _(spark, sf):
    return _in_band(QUERIES["fc_decomposable"](spark, sf), "lo", "hi")


@query("fc_decomposable_regressor_grid", _GRID_SQL)
def _(spark, sf):
    return _in_band(QUERIES["fc_decomposable_regressor"](spark, sf), "lo", "hi")


@query("fc_tree_recursive_grid", _GRID_SQL)
def _(spark, sf):
    return _in_band(QUERIES["fc_tree_recursive"](spark, sf), "lo95", "hi95")


@query("fc_tree_regressor_grid", _GRID_SQL)
def _(spark, sf):
    return _in_band(QUERIES["fc_tree_regressor"](spark, sf), "lo95", "hi95")


@query("fc_arima_manual_grid", f"""WITH {HOURLY_SQL}, ends AS (SELECT grp, max(ts) AS b FROM hr GROUP BY grp)
SELECT grp, CAST(h AS INTEGER) AS h, b + to_hours(CAST(h AS INTEGER)) AS ts, true AS in_band FROM ends, (SELECT unnest(generate_series(1, 48)) AS h)""")
def _(spark, sf):
    return _in_band(QUERIES["fc_arima_manual"](spark, sf), "lo", "hi")


@query("feature_importance_sum", "SELECT true AS sums_to_one, true AS in_order")
def _(spark, sf):
    out = QUERIES["feature_importance"](spark, sf)
    ok = F.abs(F.sum("importance") - 1) < 1e-9
    return out.agg(ok.alias("sums_to_one"), (F.min("importance") >= 0).alias("in_order"))


@query("isolation_forest_share", "SELECT event_type AS grp, count(*) AS n, true AS share_fits FROM events GROUP BY event_type")
def _(spark, sf):
    """Some rows are flagged, at most a tenth: values within one step of the forest share a score, so fewer may lie above the cut."""
    out = QUERIES["outlier_isolation_forest"](spark, sf)
    hits = F.count_if("is_outlier")
    return out.groupBy("grp").agg(F.count("*").alias("n"), hits.between(1, 0.1 * F.count("*") + 1).alias("share_fits"))


@query("yeo_johnson_moments", "SELECT event_type AS grp, count(*) AS n, true AS mean_0, true AS deviation_1 FROM events GROUP BY event_type")
def _(spark, sf):
    out = QUERIES["tx_yeo_johnson"](spark, sf)
    return out.groupBy("grp").agg(F.count("*").alias("n"), (F.abs(F.avg("y")) < 1e-6).alias("mean_0"), (F.abs(F.stddev_pop("y") - 1) < 1e-6).alias("deviation_1"))


@query("pacf_first_lag", f"WITH {PANEL_SQL} SELECT DISTINCT grp, true AS starts_as_acf FROM pan")
def _(spark, sf):
    p = QUERIES["pacf"](spark, sf).filter("lag = 1")
    a = spectral.acf(panel(spark, sf), PANEL).filter("lag = 1").select("grp", F.col("acf").alias("a"))
    return p.join(a, "grp").select("grp", (F.abs(F.col("pacf") - F.col("a")) < 1e-9).alias("starts_as_acf"))


@query("adf_range", f"WITH {PANEL_SQL} SELECT DISTINCT grp, true AS p_fits FROM pan")
def _(spark, sf):
    return QUERIES["stationarity_adf"](spark, sf).select("grp", F.col("adf_p").between(0, 1).alias("p_fits"))
