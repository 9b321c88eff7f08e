"""Missing data, date grid, outliers and transformations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import GAP_SQL, HOURLY_SQL, ONE, PANEL, PANEL_SQL, RAW_PANEL, RAW_SQL, REVENUE_SQL, gapped, panel, query, raw_events, revenue, rounded, table
from seriesloom.functions import transforms
from seriesloom.operators import clean, outliers
from seriesloom.plans.preprocess import PreprocessConfig, preprocess
from seriesloom.spec import SeriesSpec

ORDERS = SeriesSpec(ts="o_orderdate", y="o_totalprice", group="o_orderpriority", tie="o_orderkey")


@query("missing_summary", f"""
WITH {GAP_SQL}, p AS (SELECT grp, count(*) AS n_rows, count(*) FILTER (y IS NULL) AS missing_values,
  date_diff('day', min(ts), max(ts)) + 1 - count(*) AS missing_dates FROM gap GROUP BY grp)
SELECT 'full grid' AS src, grp, n_rows, missing_values, round(missing_values / n_rows * 100, 6) AS missing_pct, missing_dates FROM p
UNION ALL SELECT 'raw orders', o_orderpriority, count(*), 0, 0.0,
  date_diff('day', min(o_orderdate), max(o_orderdate)) + 1 - count(*) FROM orders GROUP BY o_orderpriority""")
def _(spark, sf):
    a = clean.missing_summary(gapped(spark, sf), PANEL).withColumn("src", F.lit("full grid"))
    raw = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("y"))
    b = clean.missing_summary(raw, PANEL).withColumn("src", F.lit("raw orders"))
    return rounded(a.unionByName(b).select("src", "grp", "n_rows", "missing_values", "missing_pct", "missing_dates"), 6, "missing_pct")


@query("date_gaps", """
WITH r AS (SELECT o_orderpriority AS grp, o_orderdate AS ts FROM orders),
g AS (SELECT grp, count(*) AS n_rows, count(DISTINCT ts) AS n_unique, date_diff('day', min(ts), max(ts)) + 1 AS expected_points FROM r GROUP BY grp),
d AS (SELECT grp, epoch(ts - lag(ts) OVER (PARTITION BY grp ORDER BY ts)) AS s FROM r),
m AS (SELECT grp, s, count(*) AS c FROM d WHERE s IS NOT NULL GROUP BY ALL),
b AS (SELECT grp, arg_min(s, (-c, s)) AS mode_step_seconds FROM m GROUP BY grp)
SELECT grp, n_rows, n_unique, n_rows - n_unique AS n_duplicates, expected_points, expected_points - n_unique AS missing_points,
  CAST(mode_step_seconds AS DOUBLE) AS mode_step_seconds FROM g JOIN b USING (grp)""")
def _(spark, sf):
    raw = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_orderdate").alias("ts"), "o_orderkey")
    return clean.date_gaps(raw, SeriesSpec(group="grp", tie="o_orderkey"))


@query("absent_dates", f"WITH {GAP_SQL} SELECT grp, ts FROM gap WHERE y IS NULL")
def _(spark, sf):
    return clean.absent_dates(panel(spark, sf), PANEL)


@query("fill_missing_dates", f"WITH {GAP_SQL} SELECT grp, ts, round(y, 2) AS y FROM gap")
def _(spark, sf):
    return rounded(gapped(spark, sf), 2, "y")


@query("fill_drop", f"WITH {GAP_SQL} SELECT grp, ts, round(y, 2) AS y FROM gap WHERE y IS NOT NULL")
def _(spark, sf):
    return rounded(clean.fill_drop(gapped(spark, sf), ["y"]), 2, "y")


@query("fill_forward", f"""
WITH {GAP_SQL} SELECT grp, ts, round(last_value(y IGNORE NULLS) OVER (PARTITION BY grp ORDER BY ts ROWS UNBOUNDED PRECEDING), 2) AS y FROM gap""")
def _(spark, sf):
    return rounded(clean.fill_forward(gapped(spark, sf), PANEL), 2, "y")


@query("fill_backward", f"""
WITH {GAP_SQL} SELECT grp, ts, round(first_value(y IGNORE NULLS) OVER (PARTITION BY grp ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 2) AS y FROM gap""")
def _(spark, sf):
    return rounded(clean.fill_backward(gapped(spark, sf), PANEL), 2, "y")


@query("fill_interpolate", f"""
WITH {GAP_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ts) AS k FROM gap),
f AS (SELECT *, last_value(y IGNORE NULLS) OVER p AS a, first_value(y IGNORE NULLS) OVER n AS b,
  last_value(CASE WHEN y IS NOT NULL THEN k END IGNORE NULLS) OVER p AS ka, first_value(CASE WHEN y IS NOT NULL THEN k END IGNORE NULLS) OVER n AS kb
  FROM i WINDOW p AS (PARTITION BY grp ORDER BY ts ROWS UNBOUNDED PRECEDING), n AS (PARTITION BY grp ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT grp, ts, round(CASE WHEN y IS NOT NULL THEN y WHEN a IS NULL THEN NULL WHEN b IS NULL THEN a ELSE a + (b - a) * (k - ka) / (kb - ka) END + 1.23e-5, 3) AS y FROM f""")
def _(spark, sf):
    # Both sides add a little before rounding, so that no value lies half way between two.
    return rounded(clean.fill_interpolate(gapped(spark, sf), PANEL).withColumn("y", F.col("y") + 1.23e-5), 3, "y")


@query("fill_mean", f"WITH {GAP_SQL} SELECT grp, ts, round(coalesce(y, avg(y) OVER (PARTITION BY grp)), 3) AS y FROM gap")
def _(spark, sf):
    return rounded(clean.fill_mean(gapped(spark, sf), PANEL), 3, "y")


@query("fill_median", f"WITH {GAP_SQL} SELECT grp, ts, round(coalesce(y, median(y) OVER (PARTITION BY grp)), 3) AS y FROM gap")
def _(spark, sf):
    return rounded(clean.fill_median(gapped(spark, sf), PANEL), 3, "y")


@query("missing_cells", f"WITH {GAP_SQL} SELECT 'y' AS \"column\", count(*) FILTER (y IS NULL) AS n_missing FROM gap")
def _(spark, sf):
    return clean.missing_cells(gapped(spark, sf), ["y"])


@query("reindex_fill", f"""
WITH last AS (SELECT o_orderpriority AS grp, o_orderdate AS ts, arg_max(o_totalprice, o_orderkey) AS y FROM orders GROUP BY ALL),
e AS (SELECT grp, min(ts) AS a, max(ts) AS b FROM last GROUP BY grp),
g AS (SELECT grp, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS ts FROM e), j AS (SELECT g.grp, g.ts, last.y FROM g LEFT JOIN last USING (grp, ts))
SELECT grp, ts, coalesce(last_value(y IGNORE NULLS) OVER (PARTITION BY grp ORDER BY ts ROWS UNBOUNDED PRECEDING),
  first_value(y IGNORE NULLS) OVER (PARTITION BY grp ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS y FROM j""")
def _(spark, sf):
    raw = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("y"), "o_orderkey")
    return clean.reindex_fill(raw, clean.date_grid(raw, PANEL), SeriesSpec(group="grp", tie="o_orderkey"), ["y"])


_BOUNDS = """, q AS (SELECT grp, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM raw GROUP BY grp),
b AS (SELECT grp, q1 - 1.5e0 * (q3 - q1) AS lower, q3 + 1.5e0 * (q3 - q1) AS upper FROM q),
j AS (SELECT raw.*, lower, upper, y < lower OR y > upper AS is_outlier FROM raw JOIN b USING (grp))"""


@query("outlier_iqr", f"WITH {RAW_SQL}{_BOUNDS} SELECT grp, ts, y, event_id, round(lower, 4) AS lower, round(upper, 4) AS upper, is_outlier FROM j")
def _(spark, sf):
    return rounded(outliers.outlier_iqr(raw_events(spark, sf), RAW_PANEL), 4, "lower", "upper")


@query("outlier_zscore", f"""
WITH {RAW_SQL}, s AS (SELECT grp, avg(y) AS m, stddev_pop(y) AS d FROM raw GROUP BY grp)
SELECT grp, ts, y, event_id, round(abs((y - m) / d), 6) AS zscore, abs((y - m) / d) > 1.5 AS is_outlier FROM raw JOIN s USING (grp)""")
def _(spark, sf):
    return rounded(outliers.outlier_zscore(raw_events(spark, sf), RAW_PANEL), 6, "zscore")


@query("outlier_remove", f"WITH {RAW_SQL}{_BOUNDS} SELECT grp, ts, y, event_id FROM j WHERE NOT is_outlier")
def _(spark, sf):
    return outliers.outlier_remove(raw_events(spark, sf), RAW_PANEL)


@query("outlier_clip", f"WITH {RAW_SQL}{_BOUNDS} SELECT grp, ts, round(greatest(lower, least(upper, y)), 4) AS y, event_id FROM j")
def _(spark, sf):
    return rounded(outliers.outlier_clip(raw_events(spark, sf), RAW_PANEL), 4, "y")


@query("outlier_median", f"""
WITH {RAW_SQL}{_BOUNDS}, m AS (SELECT grp, median(y) AS md FROM raw GROUP BY grp)
SELECT grp, ts, round(CASE WHEN is_outlier THEN md ELSE y END, 4) AS y, event_id FROM j JOIN m USING (grp)""")
def _(spark, sf):
    return rounded(outliers.outlier_median(raw_events(spark, sf), RAW_PANEL), 4, "y")


@query("outlier_winsorize", f"""
WITH {RAW_SQL}{_BOUNDS}, m AS (SELECT grp, quantile_cont(y, 0.05) AS a, quantile_cont(y, 0.95) AS b FROM raw GROUP BY grp)
SELECT grp, ts, round(CASE WHEN is_outlier THEN greatest(a, least(b, y)) ELSE y END, 4) AS y, event_id FROM j JOIN m USING (grp)""")
def _(spark, sf):
    return rounded(outliers.outlier_winsorize(raw_events(spark, sf), RAW_PANEL), 4, "y")


@query("outlier_isolation_forest")
def _(spark, sf):
    return outliers.outlier_isolation_forest(raw_events(spark, sf), RAW_PANEL)


@query("tx_log1p", "SELECT l_orderkey, l_linenumber, round(ln(1 + l_extendedprice), 6) AS l_extendedprice FROM lineitem")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return rounded(transforms.tx_log1p(li, "l_extendedprice"), 6, "l_extendedprice")


@query("tx_signed_sqrt", "SELECT s_suppkey, round(sqrt(abs(s_acctbal)) * sign(s_acctbal), 6) AS s_acctbal FROM supplier")
def _(spark, sf):
    return rounded(transforms.tx_signed_sqrt(table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal"), 6, "s_acctbal")


@query("tx_box_cox", """
WITH g AS (SELECT c_mktsegment, min(c_acctbal) > 0 AS p FROM customer GROUP BY 1), h AS (SELECT o_orderstatus, min(o_totalprice) > 0 AS p FROM orders GROUP BY 1)
SELECT 'c' AS src, c_custkey AS id, round(CASE WHEN p THEN ln(1 + c_acctbal) ELSE c_acctbal END, 6) AS y FROM customer JOIN g USING (c_mktsegment)
UNION ALL SELECT 'o', o_orderkey, round(CASE WHEN p THEN ln(1 + o_totalprice) ELSE o_totalprice END, 6) FROM orders JOIN h USING (o_orderstatus)""")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.lit("c").alias("src"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("grp"), F.col("c_acctbal").alias("y"))
    o = table(spark, sf, "orders").select(F.lit("o").alias("src"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("grp"), F.col("o_totalprice").alias("y"))
    both = [transforms.tx_box_cox(x, SeriesSpec(group="grp")).drop("grp") for x in (c, o)]
    return rounded(both[0].unionByName(both[1]), 6, "y")


@query("tx_yeo_johnson")
def _(spark, sf):
    return transforms.tx_yeo_johnson(raw_events(spark, sf), RAW_PANEL)


@query("tx_standardize", f"""
WITH {PANEL_SQL}, s AS (SELECT grp, avg(y) AS m, stddev_pop(y) AS d FROM pan GROUP BY grp)
SELECT grp, ts, round((y - m) / d, 6) AS y FROM pan JOIN s USING (grp)""")
def _(spark, sf):
    return rounded(transforms.tx_standardize(panel(spark, sf), PANEL), 6, "y")


@query("tx_minmax", f"""
WITH {PANEL_SQL}, s AS (SELECT grp, min(y) AS a, max(y) AS b FROM pan GROUP BY grp)
SELECT grp, ts, round((y - a) / (b - a), 6) AS y FROM pan JOIN s USING (grp)""")
def _(spark, sf):
    return rounded(transforms.tx_minmax(panel(spark, sf), PANEL), 6, "y")


_STEPS_SQL = f"""
WITH {GAP_SQL}, f AS (SELECT grp, ts, last_value(y IGNORE NULLS) OVER (PARTITION BY grp ORDER BY ts ROWS UNBOUNDED PRECEDING) AS y FROM gap),
q AS (SELECT grp, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM f GROUP BY grp),
b AS (SELECT grp, q1 - 1.5e0 * (q3 - q1) AS lower, q3 + 1.5e0 * (q3 - q1) AS upper FROM q),
o AS (SELECT f.*, y < lower OR y > upper AS bad FROM f JOIN b USING (grp)),
t AS (SELECT grp, ts, ln(1 + y) AS y FROM o WHERE NOT bad),
w AS (SELECT *, lag(y, 1) OVER p AS y_lag_1, lag(y, 7) OVER p AS y_lag_7, avg(y) OVER (p ROWS 6 PRECEDING) AS y_rolling_mean_7, stddev_samp(y) OVER (p ROWS 6 PRECEDING) AS y_rolling_std_7
  FROM t WINDOW p AS (PARTITION BY grp ORDER BY ts)),
k AS (SELECT *, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week FROM w WHERE y_lag_7 IS NOT NULL),
d AS (SELECT *, y - lag(y) OVER (PARTITION BY grp ORDER BY ts) AS y_diff_1 FROM k)"""
_STEPS = PreprocessConfig(missing="forward_fill", outliers="iqr", transformation="log", lags=(1, 7), windows=(7,), date_parts=("day_of_week",), diff_order=1)


@query("preprocess_rows", _STEPS_SQL + """
SELECT grp, ts, day_of_week, round(y, 6) AS y, round(y_lag_1, 6) AS y_lag_1, round(y_lag_7, 6) AS y_lag_7, round(y_rolling_mean_7, 6) AS y_rolling_mean_7,
  round(y_rolling_std_7, 6) AS y_rolling_std_7, round(y_diff_1, 6) AS y_diff_1 FROM d WHERE y_diff_1 IS NOT NULL""")
def _(spark, sf):
    out = preprocess(gapped(spark, sf), PANEL, _STEPS)[0]
    return rounded(out, 6, "y", "y_lag_1", "y_lag_7", "y_rolling_mean_7", "y_rolling_std_7", "y_diff_1")


@query("preprocess_report", _STEPS_SQL + """
SELECT (SELECT count(*) FROM gap) AS original_rows, (SELECT count(*) FROM d WHERE y_diff_1 IS NOT NULL) AS processed_rows,
  (SELECT count(*) FROM gap) - (SELECT count(*) FROM d WHERE y_diff_1 IS NOT NULL) AS removed_rows,
  (SELECT count(*) FROM gap WHERE y IS NULL) AS missing_handled, (SELECT count(*) FROM o WHERE bad) AS outliers_handled,
  'y_lag_1,y_lag_7,y_rolling_mean_7,y_rolling_std_7,day_of_week' AS features_created""")
def _(spark, sf):
    return preprocess(gapped(spark, sf), PANEL, _STEPS)[1]
