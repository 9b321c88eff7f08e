"""Window and calendar features, and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import GAP_SQL, HOURLY_SQL, ONE, PANEL, PANEL_SQL, RAW_PANEL, RAW_SQL, REVENUE_SQL, gapped, hourly, panel, query, raw_events, revenue, rounded, table
from seriesloom.forecast.baseline import future_dates
from seriesloom.functions import features
from seriesloom.operators import splits
from seriesloom.spec import SeriesSpec

_P = "OVER (PARTITION BY grp ORDER BY ts, event_id"


@query("lag_features", f"""
WITH {RAW_SQL} SELECT *, lag(y, 1) {_P}) AS y_lag_1, lag(y, 7) {_P}) AS y_lag_7, lag(y, 14) {_P}) AS y_lag_14 FROM raw""")
def _(spark, sf):
    return features.lag_features(raw_events(spark, sf), RAW_PANEL)


def _roll(col: str, n: int, shift: int, order: str, y: str = "y") -> str:
    frame = f"OVER (PARTITION BY grp ORDER BY {order} ROWS BETWEEN {n - 1 + shift} PRECEDING AND {shift} PRECEDING)" if shift else (
        f"OVER (PARTITION BY grp ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)")
    full = f"CASE WHEN count({y}) {frame} = {n} THEN"
    return f"round({full} avg({y}) {frame} END, 4) AS {col}rolling_mean_{n}, round({full} stddev_samp({y}) {frame} END, 4) AS {col}rolling_std_{n}"


_ROLLED = [f"rolling_{k}_{n}" for n in (7, 14, 30) for k in ("mean", "std")]


@query("rolling_features", f"""
WITH {RAW_SQL} SELECT *, {', '.join(_roll('y_', n, 0, 'ts, event_id') for n in (7, 14, 30))} FROM raw""")
def _(spark, sf):
    return rounded(features.rolling_features(raw_events(spark, sf), RAW_PANEL), 4, *[f"y_{c}" for c in _ROLLED])


@query("tree_lag_features", f"""
WITH {GAP_SQL}, g AS (SELECT grp, ts, round(y, 2) AS y FROM gap)
SELECT *, lag(y, 1) OVER w AS lag_1, lag(y, 7) OVER w AS lag_7, lag(y, 14) OVER w AS lag_14, lag(y, 28) OVER w AS lag_28 FROM g WINDOW w AS (PARTITION BY grp ORDER BY ts)""")
def _(spark, sf):
    return features.tree_lag_features(rounded(gapped(spark, sf), 2, "y"), PANEL)


@query("tree_rolling_features", f"""
WITH {RAW_SQL} SELECT *, {', '.join(_roll('', n, 1, 'ts, event_id') for n in (7, 14, 30))} FROM raw""")
def _(spark, sf):
    return rounded(features.tree_rolling_features(raw_events(spark, sf), RAW_PANEL), 4, *_ROLLED)


@query("ewm_feature", f"""
WITH {GAP_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ts) AS i FROM gap),
j AS (SELECT a.grp, a.ts, a.y, sum(b.y * 0.75e0 ** (a.i - b.i - 1)) AS n, sum(CASE WHEN b.y IS NOT NULL THEN 0.75e0 ** (a.i - b.i - 1) END) AS d
  FROM k a LEFT JOIN k b ON a.grp = b.grp AND b.i BETWEEN a.i - 129 AND a.i - 1 GROUP BY ALL)
SELECT grp, ts, round(y, 2) AS y, round(n / d, 2) AS ewm_7 FROM j""")
def _(spark, sf):
    return rounded(features.ewm_feature(gapped(spark, sf), PANEL), 2, "y", "ewm_7")


@query("tree_features", f"""
WITH {RAW_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ts, event_id) AS i FROM raw),
j AS (SELECT a.event_id, sum(b.y * 0.75e0 ** (a.i - b.i - 1)) / sum(0.75e0 ** (a.i - b.i - 1)) AS e
  FROM k a JOIN k b ON a.grp = b.grp AND b.i BETWEEN a.i - 129 AND a.i - 1 GROUP BY ALL)
SELECT raw.*, lag(y, 1) {_P}) AS lag_1, lag(y, 7) {_P}) AS lag_7, lag(y, 14) {_P}) AS lag_14, lag(y, 28) {_P}) AS lag_28,
  {', '.join(_roll('', n, 1, 'ts, event_id') for n in (7, 14, 30))}, round(e, 4) AS ewm_7,
  CAST(month(ts) AS INTEGER) AS month, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, CAST(dayofyear(ts) AS INTEGER) AS day_of_year FROM raw LEFT JOIN j USING (event_id)""")
def _(spark, sf):
    return rounded(features.tree_features(raw_events(spark, sf), RAW_PANEL), 4, *_ROLLED, "ewm_7")


@query("date_features", """
SELECT l_orderkey, l_linenumber, l_shipdate, CAST(isodow(l_shipdate) - 1 AS INTEGER) AS day_of_week, CAST(month(l_shipdate) AS INTEGER) AS month, CAST(quarter(l_shipdate) AS INTEGER) AS quarter,
  CAST(year(l_shipdate) AS INTEGER) AS year, CAST(isodow(l_shipdate) >= 6 AS INTEGER) AS is_weekend FROM lineitem""")
def _(spark, sf):
    return features.date_features(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), "l_shipdate")


@query("tree_date_features", """
SELECT l_orderkey, l_linenumber, l_shipdate, CAST(month(l_shipdate) AS INTEGER) AS month, CAST(isodow(l_shipdate) - 1 AS INTEGER) AS day_of_week, CAST(dayofyear(l_shipdate) AS INTEGER) AS day_of_year FROM lineitem""")
def _(spark, sf):
    return features.tree_date_features(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), "l_shipdate")


def _zero(x: str) -> str:
    """Rounded to 6 places, without negative zeros."""
    return f"CASE WHEN abs({x}) < 5e-7 THEN 0.0e0 ELSE round({x}, 6) END"


_CYCLIC_SQL = ", ".join(
    f"{_zero(e)} AS {n}" for n, e in (
        ("feat_dofw_sin", "sin(2 * pi() * (isodow(ts) - 1) / 7)"), ("feat_dofw_cos", "cos(2 * pi() * (isodow(ts) - 1) / 7)"),
        ("feat_month_sin", "sin(2 * pi() * (month(ts) - 1) / 12)"), ("feat_month_cos", "cos(2 * pi() * (month(ts) - 1) / 12)"))
)
_YEAR_SQL = ", ".join(f"{_zero(f'{f}(2 * pi() * {k} * dayofyear(ts) / 365.25e0)')} AS feat_{f}_year_{k}" for k in (1, 2, 3) for f in ("sin", "cos"))
_CYCLIC = ["feat_dofw_sin", "feat_dofw_cos", "feat_month_sin", "feat_month_cos"]
_YEAR = [f"feat_{f}_year_{k}" for k in (1, 2, 3) for f in ("sin", "cos")]


@query("cyclic_features", f"SELECT event_id, ts, {_CYCLIC_SQL} FROM events")
def _(spark, sf):
    return rounded(features.cyclic_features(table(spark, sf, "events").select("event_id", "ts"), "ts"), 6, *_CYCLIC)


@query("fourier_year", f"""
WITH {PANEL_SQL}, wk AS (SELECT 'weekly' AS grp, date_trunc('week', o_orderdate) AS ts FROM orders GROUP BY ALL)
SELECT grp, ts, {_YEAR_SQL} FROM pan UNION ALL SELECT grp, ts, {', '.join(['NULL::DOUBLE'] * 6)} FROM wk""")
def _(spark, sf):
    from seriesloom.operators.series import build_series

    weekly = build_series(table(spark, sf, "orders").withColumn("grp", F.lit("weekly")), "o_orderdate", "o_totalprice", "W", ["grp"])
    both = panel(spark, sf).unionByName(weekly).select("grp", "ts")
    return rounded(features.fourier_year(both, PANEL), 6, *_YEAR)


@query("future_temporal_features", f"""
WITH {PANEL_SQL}, e AS (SELECT grp, max(ts) AS b FROM pan GROUP BY grp),
f AS (SELECT grp, CAST(h AS INTEGER) AS h, b + to_days(CAST(h AS INTEGER)) AS ts FROM e, (SELECT unnest(generate_series(1, 30)) AS h))
SELECT grp, h, ts, {_CYCLIC_SQL}, {_YEAR_SQL} FROM f""")
def _(spark, sf):
    return rounded(features.future_temporal_features(future_dates(panel(spark, sf), PANEL, 30), "ts"), 6, *_CYCLIC, *_YEAR)


@query("holiday_flag", f"""
WITH {PANEL_SQL}, h AS (SELECT DISTINCT l_shipdate AS d FROM lineitem WHERE month(l_shipdate) = 12 AND day(l_shipdate) IN (24, 25, 26))
SELECT grp, ts, round(y, 2) AS y, CAST(h.d IS NOT NULL AS INTEGER) AS is_holiday FROM pan LEFT JOIN h ON h.d = pan.ts""")
def _(spark, sf):
    """Days around Christmas that occur among the ship dates."""
    days = table(spark, sf, "lineitem").filter((F.month("l_shipdate") == 12) & F.day("l_shipdate").isin(24, 25, 26)).select(F.col("l_shipdate").alias("ts"))
    return rounded(features.holiday_flag(panel(spark, sf), days, "ts"), 2, "y")


@query("diff_regular", f"""
WITH {RAW_SQL} SELECT *, round(y - lag(y) {_P}), 6) AS y_diff_1, round(y - lag(y) {_P}), 6) AS y_diff_2 FROM raw""")
def _(spark, sf):
    return rounded(features.diff_regular(raw_events(spark, sf), RAW_PANEL, 2), 6, "y_diff_1", "y_diff_2")


@query("diff_iterated", f"""
WITH {RAW_SQL} SELECT *, round(y - lag(y) {_P}), 6) AS y_diff_1, round(y - 2 * lag(y) {_P}) + lag(y, 2) {_P}), 6) AS y_diff_2 FROM raw""")
def _(spark, sf):
    return rounded(features.diff_regular(raw_events(spark, sf), RAW_PANEL, 2, iterated=True), 6, "y_diff_1", "y_diff_2")


@query("diff_seasonal", f"WITH {RAW_SQL} SELECT *, round(y - lag(y, 7) {_P}), 6) AS y_seasonal_diff FROM raw")
def _(spark, sf):
    return rounded(features.diff_seasonal(raw_events(spark, sf), RAW_PANEL), 6, "y_seasonal_diff")


@query("target_delta", f"WITH {RAW_SQL} SELECT *, lag(y) {_P}) AS lag_1, round(y - lag(y) {_P}), 6) AS label FROM raw")
def _(spark, sf):
    return rounded(features.target_delta(features.tree_lag_features(raw_events(spark, sf), RAW_PANEL, [1]), RAW_PANEL), 6, "label")


_LABEL = "CASE WHEN i < floor(n * 0.7e0) THEN 'train' WHEN i < floor(n * 0.7e0) + floor(n * 0.15e0) THEN 'val' ELSE 'test' END"


@query("split_ratio", f"""
WITH r AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events) SELECT event_id, ts, {_LABEL} AS split FROM r""")
def _(spark, sf):
    return splits.split_ratio(table(spark, sf, "events").select("event_id", "ts"), SeriesSpec(tie="event_id")).select("event_id", "ts", "split")


@query("split_ratio_grouped", f"""
WITH r AS (SELECT event_id, event_type AS grp, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT grp, event_id, ts, {_LABEL} AS split FROM r""")
def _(spark, sf):
    return splits.split_ratio_grouped(raw_events(spark, sf), RAW_PANEL).select("grp", "event_id", "ts", "split")


@query("split_cutoff", f"""
WITH s AS (SELECT l_returnflag AS grp, l_shipdate AS ts, l_orderkey, l_linenumber FROM lineitem UNION ALL
  SELECT 'late', l_shipdate, l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate > TIMESTAMP '2000-01-01'),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ts, l_orderkey, l_linenumber) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n,
  count(*) FILTER (ts <= TIMESTAMP '1999-12-31') OVER (PARTITION BY grp) AS t FROM s)
SELECT grp, ts, l_orderkey, l_linenumber, CASE WHEN t = 0 THEN {_LABEL} WHEN i < t THEN 'train' WHEN i < t + floor((n - t) * 0.5e0) THEN 'val' ELSE 'test' END AS split FROM r""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber")
    both = li.unionByName(li.filter(F.col("ts") > F.lit("2000-01-01").cast("timestamp_ntz")).withColumn("grp", F.lit("late")))
    return splits.split_cutoff(both, SeriesSpec(group="grp", tie=("l_orderkey", "l_linenumber")), "1999-12-31")


def _cv_sql(first: str) -> str:
    return f"""
WITH {PANEL_SQL}, r AS (SELECT grp, ts, row_number() OVER (PARTITION BY grp ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM pan),
f AS (SELECT *, floor(n / 6) AS z FROM r, (SELECT CAST(unnest(generate_series(1, 5)) AS INTEGER) AS fold)),
k AS (SELECT *, n - (5 - fold + 1) * z AS s FROM f)
SELECT grp, ts, fold, CASE WHEN i < s THEN 'train' ELSE 'test' END AS split FROM k WHERE i >= {first} AND i < s + z"""


@query("split_cv", _cv_sql("0"))
def _(spark, sf):
    return splits.split_cv(panel(spark, sf), PANEL).select("grp", "ts", "fold", "split")


@query("split_cv_sliding", _cv_sql("(fold - 1) * z"))
def _(spark, sf):
    return splits.split_cv(panel(spark, sf), PANEL, mode="sliding").select("grp", "ts", "fold", "split")


@query("split_sizes", """
SELECT event_type AS grp, count(*) AS n_total, CAST(floor(count(*) * 0.7e0) AS BIGINT) AS n_train, CAST(floor(count(*) * 0.15e0) AS BIGINT) AS n_val,
  CAST(floor(count(*) * 0.15e0) AS BIGINT) AS n_test, false AS has_features, 0 AS n_features, true AS has_groups FROM events GROUP BY 1""")
def _(spark, sf):
    return splits.split_sizes(raw_events(spark, sf), RAW_PANEL)


@query("split_checks", """
WITH c AS (SELECT event_type AS grp, count(*) AS n FROM events GROUP BY 1)
SELECT grp, n AS n_total, 'sizes_do_not_sum_to_one' AS rule, 0.9e0 AS value FROM c UNION ALL SELECT grp, n, 'train_too_small', 0.4e0 FROM c
UNION ALL SELECT grp, n, 'horizon_too_long', floor(n * 0.3e0) FROM c WHERE 600 > floor(n * 0.3e0)
UNION ALL SELECT grp, n, 'too_few_rows', n FROM c WHERE n < 2000 UNION ALL SELECT grp, n, 'level_out_of_range', 1.0e0 FROM c""")
def _(spark, sf):
    out = splits.split_checks(raw_events(spark, sf), RAW_PANEL, (0.4, 0.25, 0.25), horizon=600, levels=(0.8, 1.0), min_rows=2000, needs_val=True)
    return rounded(out, 6, "value")
