"""Profiles, autocorrelation, seasonality, stationarity, alerts and model scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import GAP_SQL, HOURLY_SQL, ONE, PANEL, PANEL_SQL, RAW, RAW_PANEL, RAW_SQL, REVENUE_SQL, gapped, hourly, panel, query, raw_events, revenue, rounded, table
from seriesloom.operators import advice, clean, profile, spectral, stationarity
from seriesloom.operators.index import order_series
from seriesloom.operators.joins import series_join
from seriesloom.plans.report import series_report
from seriesloom.session import materialize
from seriesloom.spec import SeriesSpec

_MODE = """, dd AS (SELECT grp, epoch(ts - lag(ts) OVER (PARTITION BY grp ORDER BY ts)) AS s FROM src),
mm AS (SELECT grp, s, count(*) AS c FROM dd WHERE s IS NOT NULL GROUP BY ALL), md AS (SELECT grp, arg_min(s, (-c, s)) AS s FROM mm GROUP BY grp)"""
_FREQ = """CASE WHEN s IS NULL THEN 'unknown' WHEN s = 86400 THEN 'D' WHEN s = 604800 THEN 'W' WHEN s BETWEEN 2419200 AND 2678400 THEN 'M' WHEN s = 3600 THEN 'H'
  WHEN s = 1800 THEN '30T' WHEN s = 900 THEN '15T' WHEN s BETWEEN 89 * 86400 AND 92 * 86400 THEN 'Q' WHEN s BETWEEN 364 * 86400 AND 366 * 86400 THEN 'Y' ELSE 'irregular' END"""
_ALL_SQL = f"{PANEL_SQL}, {HOURLY_SQL}, {RAW_SQL}, src AS (SELECT 'orders ' || grp AS grp, ts FROM pan UNION ALL SELECT 'hourly ' || grp, ts FROM hr UNION ALL SELECT 'raw ' || grp, ts FROM raw UNION ALL SELECT 'month', date_trunc('month', l_shipdate) FROM lineitem GROUP BY ALL)"


@query("date_range_freq", f"""
WITH {_ALL_SQL}{_MODE}, e AS (SELECT grp, min(ts) AS start, max(ts) AS "end" FROM src GROUP BY grp)
SELECT grp, start, "end", CAST(floor(epoch("end" - start) / 86400) AS BIGINT) AS total_days, {_FREQ} AS frequency FROM e LEFT JOIN md USING (grp)""")
def _(spark, sf):
    from seriesloom.operators.series import build_series

    def tagged(df, tag):
        return df.select(F.concat(F.lit(tag), "grp").alias("grp"), "ts")

    month = build_series(table(spark, sf, "lineitem").withColumn("grp", F.lit("month")), "l_shipdate", "l_quantity", "M", ["grp"]).select("grp", "ts")
    src = tagged(panel(spark, sf), "orders ").unionByName(tagged(hourly(spark, sf), "hourly ")).unionByName(tagged(raw_events(spark, sf), "raw ")).unionByName(month)
    return profile.date_range_freq(src, PANEL)


_DESCRIBE = """count(y) AS count, round(avg(y), 4) AS mean, round(stddev_pop(y), 4) AS std, min(y) AS min, max(y) AS max,
  round(skewness(y) * (count(y) - 2) / sqrt(count(y) * (count(y) - 1.0e0)), 6) AS skewness, round(kurtosis_pop(y), 6) AS kurtosis,
  round(quantile_cont(y, 0.25), 4) AS q25, round(median(y), 4) AS median, round(quantile_cont(y, 0.75), 4) AS q75"""
_MOMENTS = ("mean", "std", "q25", "median", "q75")


@query("describe_target", f"WITH {RAW_SQL} SELECT grp, {_DESCRIBE} FROM raw GROUP BY grp")
def _(spark, sf):
    return rounded(rounded(profile.describe_target(raw_events(spark, sf), RAW_PANEL), 4, *_MOMENTS), 6, "skewness", "kurtosis")


@query("describe_one_series", f"WITH {RAW_SQL} SELECT {_DESCRIBE} FROM raw")
def _(spark, sf):
    return rounded(rounded(profile.describe_target(raw_events(spark, sf), RAW), 4, *_MOMENTS), 6, "skewness", "kurtosis")


_LINE_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("numeric_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) FILTER ({c} IS NULL) AS n_null, min({c}) AS min, max({c}) AS max, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std FROM lineitem" for c in _LINE_COLS))
def _(spark, sf):
    return rounded(profile.numeric_profile(table(spark, sf, "lineitem"), _LINE_COLS), 4, "mean", "std")


@query("zero_neg_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} = 0) AS n_zero, count(*) FILTER ({c} < 0) AS n_negative FROM {t}" for c, t in (("value", "events"),))
    + " UNION ALL SELECT 'c_acctbal', count(*) FILTER (c_acctbal = 0), count(*) FILTER (c_acctbal < 0) FROM customer")
def _(spark, sf):
    a = profile.zero_neg_counts(table(spark, sf, "events"), ["value"])
    return a.unionByName(profile.zero_neg_counts(table(spark, sf, "customer"), ["c_acctbal"]))


@query("trend_linear", f"""
WITH {RAW_SQL}, k AS (SELECT grp, y, CAST(row_number() OVER (PARTITION BY grp ORDER BY ts, event_id) - 1 AS DOUBLE) AS x FROM raw),
f AS (SELECT grp, regr_slope(y, x) AS s, regr_intercept(y, x) AS i, regr_r2(y, x) AS r, stddev_pop(y) AS d FROM k GROUP BY grp)
SELECT grp, round(s, 8) AS slope, round(i, 4) AS intercept, round(r, 8) AS r_squared,
  CASE WHEN abs(s) < 0.01 * d THEN 'stable' WHEN s > 0 THEN 'increasing' ELSE 'decreasing' END AS direction FROM f""")
def _(spark, sf):
    return rounded(rounded(profile.trend_linear(raw_events(spark, sf), RAW_PANEL), 8, "slope", "r_squared"), 4, "intercept")


@query("histogram30", f"""
WITH {RAW_SQL}, e AS (SELECT grp, min(y) AS a, max(y) AS b FROM raw GROUP BY grp), w AS (SELECT *, (b - a) / 30 AS z FROM e),
c AS (SELECT grp, CAST(least(floor((y - a) / z), 29) AS INTEGER) AS bin, count(*) AS n FROM raw JOIN w USING (grp) GROUP BY ALL),
f AS (SELECT *, CAST(unnest(generate_series(0, 29)) AS INTEGER) AS bin FROM w)
SELECT grp, bin, round(a + bin * z, 6) AS bin_start, round(a + (bin + 1) * z, 6) AS bin_end, coalesce(n, 0) AS n FROM f LEFT JOIN c USING (grp, bin)""")
def _(spark, sf):
    return rounded(profile.histogram30(raw_events(spark, sf), RAW_PANEL), 6, "bin_start", "bin_end")


_OUT = """, q AS (SELECT grp, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM raw GROUP BY grp),
k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ts, event_id) - 1 AS position FROM raw),
o AS (SELECT k.*, row_number() OVER (PARTITION BY grp ORDER BY position) AS rank FROM k JOIN q USING (grp) WHERE y < q1 - 1.5e0 * (q3 - q1) OR y > q3 + 1.5e0 * (q3 - q1))"""


@query("outlier_positions", f"WITH {RAW_SQL}{_OUT} SELECT grp, rank, position, ts, y FROM o WHERE rank <= 100")
def _(spark, sf):
    return profile.outlier_positions(raw_events(spark, sf), RAW_PANEL).withColumn("rank", F.col("rank").cast("long"))


@query("boxplot_overall", f"""
WITH {RAW_SQL}{_OUT}, l AS (SELECT grp, list(y ORDER BY rank) AS l FROM o WHERE rank <= 50 GROUP BY grp),
b AS (SELECT grp, min(y) AS min, quantile_cont(y, 0.25) AS q1, median(y) AS median, quantile_cont(y, 0.75) AS q3, max(y) AS max FROM raw GROUP BY grp)
SELECT grp, min, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, max, len(l) AS n_listed, round(list_sum(l), 4) AS listed_sum FROM b JOIN l USING (grp)""")
def _(spark, sf):
    box = profile.boxplot_overall(raw_events(spark, sf), RAW_PANEL)
    out = box.select("grp", "min", "q1", "median", "q3", "max", F.size("outliers").cast("long").alias("n_listed"),
                     F.aggregate("outliers", F.lit(0.0), lambda a, v: a + v).alias("listed_sum"))
    return rounded(out, 4, "q1", "median", "q3", "listed_sum")


@query("boxplot_by_month", """
SELECT l_returnflag AS grp, strftime(l_shipdate, '%b') AS month, min(l_extendedprice) AS min, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1,
  round(median(l_extendedprice), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3, max(l_extendedprice) AS max FROM lineitem GROUP BY ALL""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("y"))
    return rounded(profile.boxplot_by_month(li, PANEL), 4, "q1", "median", "q3")


@query("group_profile", f"""
WITH {GAP_SQL}, g AS (SELECT grp, ts, round(y, 2) AS y FROM gap), q AS (SELECT grp, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM g GROUP BY grp),
o AS (SELECT grp, count(*) FILTER (y < q1 - 1.5e0 * (q3 - q1) OR y > q3 + 1.5e0 * (q3 - q1)) AS n_outliers, count(y) AS c FROM g JOIN q USING (grp) GROUP BY grp),
d AS (SELECT grp, {_DESCRIBE.replace(', 4)', ', 2)')}, count(*) AS n_rows, count(*) FILTER (y IS NULL) AS missing_values FROM g GROUP BY grp)
SELECT d.*, n_outliers, round(n_outliers / c * 100, 6) AS outlier_pct, round(missing_values / n_rows * 100, 6) AS missing_pct, 0::BIGINT AS missing_dates FROM d JOIN o USING (grp)""")
def _(spark, sf):
    out = profile.group_profile(rounded(gapped(spark, sf), 2, "y"), PANEL)
    return rounded(rounded(out, 2, *_MOMENTS), 6, "skewness", "kurtosis", "outlier_pct", "missing_pct")


def _acf_sql(lags: int, source: str = "pan") -> str:
    return f"""cc AS (SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY ts) AS i, y - avg(y) OVER (PARTITION BY grp) AS c, count(*) OVER (PARTITION BY grp) AS n FROM {source}),
pp AS (SELECT a.grp, l.lag, any_value(a.n) AS n, sum(a.c * b.c) AS p FROM cc a, (SELECT unnest(generate_series(0, {lags})) AS lag) l, cc b
  WHERE b.grp = a.grp AND b.i = a.i - l.lag GROUP BY ALL),
ac AS (SELECT grp, lag, n, p / first_value(p) OVER (PARTITION BY grp ORDER BY lag) AS r FROM pp)"""


@query("acf", f"WITH {PANEL_SQL}, {_acf_sql(40)} SELECT grp, CAST(lag AS INTEGER) AS lag, round(r, 6) AS acf FROM ac WHERE lag <= least(40, floor(n / 2))")
def _(spark, sf):
    return rounded(spectral.acf(panel(spark, sf), PANEL), 6, "acf")


@query("acf_one_series", f"""
WITH src AS (SELECT 1 AS grp, date_trunc('hour', ts) AS ts, sum(value) AS y FROM events GROUP BY ALL), {_acf_sql(40, 'src')}
SELECT CAST(lag AS INTEGER) AS lag, round(r, 6) AS acf FROM ac WHERE lag <= least(40, floor(n / 2))""")
def _(spark, sf):
    from seriesloom.operators.series import build_series

    return rounded(spectral.acf(build_series(table(spark, sf, "events"), "ts", "value", "H"), ONE), 6, "acf")


@query("pacf")
def _(spark, sf):
    return spectral.pacf(panel(spark, sf), PANEL)


_SEAS_SRC = "src AS (SELECT grp, ts, y FROM pan UNION ALL SELECT grp, ts, y FROM hr)"


@query("seasonality_acf", f"""
WITH {PANEL_SQL}, {HOURLY_SQL}, {_SEAS_SRC}{_MODE}, fr AS (SELECT grp, {_FREQ} AS frequency FROM md),
pe AS (SELECT *, CASE frequency WHEN 'D' THEN 7 WHEN 'H' THEN 24 ELSE 24 END AS period FROM fr), {_acf_sql(26, 'src')},
nr AS (SELECT ac.grp, lag, r FROM ac JOIN pe USING (grp) WHERE lag BETWEEN period - 2 AND period + 2 AND lag <= least(floor(n / 2), period * 3, 100)),
bs AS (SELECT grp, max(r) AS r, arg_max(lag, (r, -lag)) AS lag FROM nr GROUP BY grp)
SELECT grp, frequency, CAST(period AS INTEGER) AS period, r > CASE frequency WHEN 'D' THEN 0.25e0 ELSE 0.15e0 END AS acf_detected,
  CASE WHEN r > CASE frequency WHEN 'D' THEN 0.25e0 ELSE 0.15e0 END THEN CAST(lag AS INTEGER) ELSE 0 END AS acf_period,
  CASE WHEN r > CASE frequency WHEN 'D' THEN 0.25e0 ELSE 0.15e0 END THEN round(r, 6) ELSE 0 END AS acf_confidence FROM pe LEFT JOIN bs USING (grp)""")
def _(spark, sf):
    both = panel(spark, sf).unionByName(hourly(spark, sf))
    return rounded(spectral.seasonality_acf(both, PANEL).na.fill(0, ["acf_period"]), 6, "acf_confidence")


def _decompose_sql(m: int) -> str:
    h = m // 2
    if m % 2:
        ma = f"avg(y) OVER (PARTITION BY grp ORDER BY i ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)"
    else:
        ma = (f"(sum(y) OVER (PARTITION BY grp ORDER BY i ROWS BETWEEN {h - 1} PRECEDING AND {h - 1} FOLLOWING)"
              f" + 0.5e0 * lag(y, {h}) OVER (PARTITION BY grp ORDER BY i) + 0.5e0 * lead(y, {h}) OVER (PARTITION BY grp ORDER BY i)) / {m}")
    return f"""
k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM src),
t AS (SELECT *, CASE WHEN i >= {h} AND i <= n - 1 - {h} THEN {ma} END AS tr FROM k),
fl AS (SELECT grp, regr_slope(tr, i) AS s, regr_intercept(tr, i) AS c FROM t WHERE i >= {h} AND i < least({h} + {m}, n - 1 - {h}) GROUP BY grp),
bl AS (SELECT grp, regr_slope(tr, i) AS s, regr_intercept(tr, i) AS c FROM t WHERE i >= greatest({h}, n - 1 - {h} - {m}) AND i < n - 1 - {h} GROUP BY grp),
e AS (SELECT t.*, coalesce(tr, CASE WHEN i < {h} THEN fl.c + fl.s * i ELSE bl.c + bl.s * i END) AS trend FROM t JOIN fl USING (grp) JOIN bl USING (grp)),
p AS (SELECT grp, i % {m} AS ph, avg(y - trend) AS a FROM e GROUP BY ALL), z AS (SELECT grp, ph, a - avg(a) OVER (PARTITION BY grp) AS seasonal FROM p),
d AS (SELECT e.grp, ts, i, y, trend, seasonal, y - trend - seasonal AS resid FROM e JOIN z ON z.grp = e.grp AND z.ph = e.i % {m})"""


@query("seasonal_decompose", f"""
WITH {PANEL_SQL}, src AS (SELECT * FROM pan), {_decompose_sql(7)}
SELECT grp, ts, i AS idx, round(y, 2) AS y, round(trend, 2) AS trend, round(seasonal, 3) AS seasonal, round(resid, 2) AS resid FROM d""")
def _(spark, sf):
    return rounded(rounded(spectral.seasonal_decompose(panel(spark, sf), PANEL, 7), 2, "y", "trend", "resid"), 3, "seasonal")


@query("seasonal_decompose_even", f"""
WITH {HOURLY_SQL}, src AS (SELECT * FROM hr), {_decompose_sql(24)}
SELECT grp, ts, i AS idx, round(y, 2) AS y, round(trend + 1.23e-7, 5) AS trend, round(seasonal, 6) AS seasonal, round(resid + 1.23e-7, 5) AS resid FROM d""")
def _(spark, sf):
    # Both sides add a little before rounding, so that no value lies half way between two.
    out = spectral.seasonal_decompose(hourly(spark, sf), PANEL, 24).withColumns({c: F.col(c) + 1.23e-7 for c in ("trend", "resid")})
    return rounded(rounded(rounded(out, 5, "trend", "resid"), 6, "seasonal"), 2, "y")


@query("seasonality_decomp", f"""
WITH {HOURLY_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ts DESC) AS j FROM hr),
src AS (SELECT grp, ts, y FROM rk WHERE j <= 240), {_decompose_sql(24)},
v AS (SELECT grp, var_pop(seasonal) / (var_pop(seasonal) + var_pop(resid)) AS s FROM d GROUP BY grp)
SELECT grp, 'H' AS frequency, 24 AS period, s > 0.1e0 AS decomp_detected, CASE WHEN s > 0.1e0 THEN 24 ELSE 0 END AS decomp_period, CASE WHEN s > 0.1e0 THEN round(s, 6) ELSE 0 END AS decomp_strength FROM v""")
def _(spark, sf):
    return rounded(spectral.seasonality_decomp(hourly(spark, sf), PANEL).na.fill(0, ["decomp_period"]), 6, "decomp_strength")


def _strength_sql(m: int) -> str:
    """Seasonal share of the last ten periods of the series of ``src`` that have period m."""
    return f"""(WITH rk AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ts DESC) AS j FROM all_src JOIN pe USING (grp) WHERE period = {m}),
src AS (SELECT grp, ts, y FROM rk WHERE j <= {10 * m}), {_decompose_sql(m)}
SELECT grp, var_pop(seasonal) / (var_pop(seasonal) + var_pop(resid)) AS s FROM d GROUP BY grp)"""


def _hybrid_sql(source: str) -> str:
    """Both halves, and ``hy``: what either of them finds in the series of the select ``source``."""
    return f"""all_src AS ({source}), src AS (SELECT * FROM all_src){_MODE}, fr AS (SELECT grp, {_FREQ} AS frequency FROM md),
pe AS (SELECT *, CASE frequency WHEN 'D' THEN 7 ELSE 24 END AS period FROM fr), {_acf_sql(26, 'src')},
nr AS (SELECT ac.grp, lag, r FROM ac JOIN pe USING (grp) WHERE lag BETWEEN period - 2 AND period + 2 AND lag <= least(floor(n / 2), period * 3, 100)),
bs AS (SELECT grp, max(r) AS r, arg_max(lag, (r, -lag)) AS lag FROM nr GROUP BY grp),
ds AS (SELECT * FROM {_strength_sql(7)} UNION ALL SELECT * FROM {_strength_sql(24)}),
hv AS (SELECT grp, period, coalesce(r > CASE frequency WHEN 'D' THEN 0.25e0 ELSE 0.15e0 END, false) AS ha, r, lag, coalesce(s > 0.1e0, false) AS hd, s FROM pe LEFT JOIN bs USING (grp) LEFT JOIN ds USING (grp)),
hy AS (SELECT grp, ha OR hd AS detected, CASE WHEN ha AND (NOT hd OR r > s) THEN lag WHEN hd THEN period ELSE 0 END AS seasonal_period,
  CASE WHEN ha AND hd THEN greatest(r, s) WHEN ha THEN r WHEN hd THEN s ELSE 0 END AS strength,
  CASE WHEN ha AND hd THEN 'acf_and_decomposition' WHEN ha THEN 'acf' WHEN hd THEN 'decomposition' ELSE 'none' END AS method FROM hv)"""


@query("seasonality_hybrid", f"""
WITH {PANEL_SQL}, {HOURLY_SQL}, {_hybrid_sql('SELECT grp, ts, y FROM pan UNION ALL SELECT grp, ts, y FROM hr')}
SELECT grp, detected, CAST(seasonal_period AS INTEGER) AS seasonal_period, round(strength, 6) AS strength, round(strength * 100, 4) AS confidence, method FROM hy""")
def _(spark, sf):
    out = spectral.seasonality_hybrid(panel(spark, sf).unionByName(hourly(spark, sf)), PANEL)
    return rounded(rounded(out, 6, "strength"), 4, "confidence").na.fill(0, ["seasonal_period"])


@query("stationarity_adf")
def _(spark, sf):
    return stationarity.stationarity_adf(panel(spark, sf), PANEL)


@query("stationarity_kpss", f"""
WITH {PANEL_SQL}, c AS (SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY ts) AS i, y - avg(y) OVER (PARTITION BY grp) AS r, count(*) OVER (PARTITION BY grp) AS n FROM pan),
cum AS (SELECT grp, n, sum(r) OVER (PARTITION BY grp ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM c), eta AS (SELECT grp, any_value(n) AS n, sum(s * s) / (any_value(n) * any_value(n)) AS e FROM cum GROUP BY grp),
pr AS (SELECT a.grp, l.lag, any_value(a.n) AS n, sum(a.r * b.r) AS p FROM c a, (SELECT unnest(generate_series(0, 80)) AS lag) l, c b WHERE b.grp = a.grp AND b.i = a.i - l.lag GROUP BY ALL),
s AS (SELECT grp, any_value(n) AS n, sum(CASE WHEN lag = 0 THEN p / n WHEN lag <= floor(n ** (2.0e0 / 9)) THEN p / (n / 2) ELSE 0 END) AS s0,
  sum(CASE WHEN lag > 0 AND lag <= floor(n ** (2.0e0 / 9)) THEN lag * p / (n / 2) ELSE 0 END) AS s1 FROM pr GROUP BY grp),
b AS (SELECT grp, n, CAST(floor(1.1447e0 * ((s1 / s0) ** 2) ** (1.0e0 / 3) * n ** (1.0e0 / 3)) AS BIGINT) AS l FROM s),
v AS (SELECT pr.grp, any_value(b.l) AS l, sum(CASE WHEN lag = 0 THEN p WHEN lag <= b.l THEN 2 * p * (1 - lag / (b.l + 1.0e0)) ELSE 0 END) / any_value(pr.n) AS w FROM pr JOIN b USING (grp) GROUP BY pr.grp),
k AS (SELECT grp, n, l, e / w AS st FROM eta JOIN v USING (grp)),
q AS (SELECT *, CASE WHEN st < 0.347e0 THEN 0.1e0 WHEN st < 0.463e0 THEN 0.1e0 + (st - 0.347e0) * (-0.05e0 / (0.463e0 - 0.347e0)) WHEN st < 0.574e0 THEN 0.05e0 + (st - 0.463e0) * (-0.025e0 / (0.574e0 - 0.463e0))
  WHEN st < 0.739e0 THEN 0.025e0 + (st - 0.574e0) * (-0.015e0 / (0.739e0 - 0.574e0)) ELSE 0.01e0 END AS pv FROM k)
SELECT grp, n, round(st, 6) AS kpss_stat, round(pv, 6) AS kpss_p, l AS kpss_lags, pv > 0.05e0 AS kpss_stationary FROM q""")
def _(spark, sf):
    return rounded(stationarity.stationarity_kpss(panel(spark, sf), PANEL), 6, "kpss_stat", "kpss_p")


#: Sums of revenue over time: a unit root by construction.
_WALK_SQL = "SELECT 'walk ' || grp AS grp, ts, sum(y) OVER (PARTITION BY grp ORDER BY ts) AS y FROM pan"


def _walk(spark, sf):
    summed = stationarity.running_sum(order_series(panel(spark, sf), PANEL).indexed(), PANEL, "y")
    return summed.select(F.concat(F.lit("walk "), "grp").alias("grp"), "ts", F.col("_cum").alias("y"))


_REPORT_SQL = f"""
WITH {GAP_SQL}, {HOURLY_SQL}, {RAW_SQL},
src AS (SELECT 'orders ' || grp AS grp, ts, round(y, 2) AS y FROM gap UNION ALL SELECT 'raw ' || grp, ts, y FROM raw UNION ALL {_WALK_SQL}
  UNION ALL SELECT 'thin ' || grp, ts, CASE WHEN event_id % 13 <> 0 THEN y END FROM raw UNION ALL SELECT 'steep ' || grp, ts, y * y * y FROM raw
  UNION ALL SELECT 'nation', CAST('2024-01-01' AS TIMESTAMP) + to_days(n_nationkey), CAST(n_regionkey AS DOUBLE) FROM nation),
q AS (SELECT grp, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM src GROUP BY grp),
st AS (SELECT grp, count(y) AS count, count(*) FILTER (y IS NULL) / count(*) * 100 AS missing_pct,
  count(*) FILTER (y < q1 - 1.5e0 * (q3 - q1) OR y > q3 + 1.5e0 * (q3 - q1)) / count(y) * 100 AS outlier_pct, count(*) AS n FROM src JOIN q USING (grp) GROUP BY grp)"""


def _alert_report(spark, sf):
    """Counts, missing and outlier shares and the unit-root test of six kinds of series: with gaps, as they are, sums over time, thinned, steep and short ones."""
    a = rounded(gapped(spark, sf), 2, "y").select(F.concat(F.lit("orders "), "grp").alias("grp"), "ts", "y", F.lit(0).cast("long").alias("event_id"))
    raw = raw_events(spark, sf)
    kinds = {"raw ": F.col("y"), "thin ": F.when(F.col("event_id") % 13 != 0, F.col("y")), "steep ": F.col("y") * F.col("y") * F.col("y")}
    events = raw.select("ts", "event_id", F.explode(F.array(*[F.struct(F.concat(F.lit(k), "grp").alias("grp"), v.alias("y")) for k, v in kinds.items()])).alias("_k"))
    n = table(spark, sf, "nation").select(F.lit("nation").alias("grp"), F.timestamp_add("DAY", F.col("n_nationkey"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("ts"), F.col("n_regionkey").cast("double").alias("y"))
    rows = a.unionByName(events.select("_k.grp", "ts", "_k.y", "event_id"))
    for other in (n, _walk(spark, sf)):
        rows = rows.unionByName(other.withColumn("event_id", F.lit(0).cast("long")))
    rows = materialize(rows)
    out = series_join(profile.describe_target(rows, RAW_PANEL).select("grp", "count"), profile.outlier_share(rows, RAW_PANEL), ["grp"])
    out = series_join(out, clean.missing_summary(rows, RAW_PANEL), ["grp"])
    return series_join(out, stationarity.stationarity_adf(rows, RAW_PANEL).select("grp", "adf_stationary"), ["grp"])


# The unit-root test itself is no SQL, but its outcome is known: sums over time have a unit root, and 25 region numbers are too few to rule one out.
@query("quality_alerts", _REPORT_SQL + """
SELECT grp, 'error' AS level, 'many_missing_values' AS code, round(missing_pct, 6) AS value FROM st WHERE missing_pct > 10
UNION ALL SELECT grp, 'warning', 'missing_values', round(missing_pct, 6) FROM st WHERE missing_pct > 5 AND missing_pct <= 10
UNION ALL SELECT grp, 'info', 'not_stationary', NULL FROM st WHERE grp LIKE 'walk %' OR grp = 'nation'
UNION ALL SELECT grp, 'warning', 'many_outliers', round(outlier_pct, 6) FROM st WHERE outlier_pct > 5
UNION ALL SELECT grp, 'warning', 'few_rows', count FROM st WHERE count < 30""")
def _(spark, sf):
    return rounded(advice.quality_alerts(_alert_report(spark, sf), ["grp"]), 6, "value")


@query("series_report")
def _(spark, sf):
    return series_report(panel(spark, sf), PANEL)


@query("series_report_alerts")
def _(spark, sf):
    return advice.quality_alerts(series_report(panel(spark, sf), PANEL), ["grp"])


_SUGGEST_SRC = f"""
WITH {PANEL_SQL}, {HOURLY_SQL}, {_hybrid_sql(f'SELECT grp, ts, y FROM pan UNION ALL SELECT grp, ts, y FROM hr UNION ALL {_WALK_SQL}')},
st AS (SELECT grp, n, detected AS det, grp NOT LIKE 'walk %' AS steady FROM hy JOIN (SELECT grp, count(*) AS n FROM all_src GROUP BY grp) USING (grp))"""


def _season_report(spark, sf):
    """Row counts, seasonality by both methods and the unit-root test of daily, hourly and summed series."""
    both = materialize(panel(spark, sf).unionByName(hourly(spark, sf)).unionByName(_walk(spark, sf)))
    out = both.groupBy("grp").agg(F.count(F.lit(1)).alias("count"))
    out = series_join(out, spectral.seasonality_hybrid(both, PANEL).select("grp", "detected"), ["grp"])
    return series_join(out, stationarity.stationarity_adf(both, PANEL).select("grp", "adf_stationary"), ["grp"])


@query("model_suggestions", _SUGGEST_SRC + """
SELECT grp, 1 AS priority, 'Prophet' AS model, 'seasonal' AS reason FROM st WHERE det
UNION ALL SELECT grp, 2, 'ARIMA', 'stationary_or_not_seasonal' FROM st WHERE steady OR NOT det
UNION ALL SELECT grp, 3, 'XGBoost', 'enough_rows' FROM st WHERE n > 100 UNION ALL SELECT grp, 4, 'LightGBM', 'enough_rows' FROM st WHERE n > 100
UNION ALL SELECT grp, 5, 'Naive', 'baseline' FROM st UNION ALL SELECT grp, 6, 'Seasonal Naive', 'seasonal_baseline' FROM st WHERE det""")
def _(spark, sf):
    return advice.model_suggestions(_season_report(spark, sf), ["grp"])


@query("model_scoring", _SUGGEST_SRC + """,
m AS (SELECT * FROM (VALUES ('naive', 'baseline', 1, false, false), ('seasonal_naive', 'baseline', 2, false, false), ('arima', 'statistical', 30, false, false),
  ('prophet', 'statistical', 50, true, false), ('xgboost', 'machine_learning', 100, true, true), ('lightgbm', 'machine_learning', 100, true, true),
  ('lstm', 'deep_learning', 1000, true, true)) t(model, category, k, f, g)),
s AS (SELECT grp, model, category, CASE WHEN n < k THEN 0 ELSE 6
  + CASE WHEN NOT det THEN 0 WHEN model IN ('seasonal_naive', 'arima', 'prophet') THEN 2 WHEN model IN ('xgboost', 'lightgbm', 'lstm') THEN 1 ELSE 0 END
  + CASE WHEN f THEN 0 ELSE 0.5e0 END + CASE WHEN g THEN 1.5e0 ELSE -1 END
  + CASE WHEN model IN ('arima', 'prophet') AND n BETWEEN 50 AND 500 THEN 1.5e0 WHEN model IN ('xgboost', 'lightgbm') AND n >= 200 THEN 1.5e0
         WHEN model = 'lstm' AND n >= 1000 THEN 2 WHEN model = 'lstm' AND n < 500 THEN -2 ELSE 0 END
  + CASE WHEN model = 'arima' AND NOT steady THEN 1 ELSE 0 END + CASE WHEN model IN ('naive', 'seasonal_naive') THEN 1 ELSE 0 END END AS score FROM st, m)
SELECT grp, model, category, CAST(score AS DOUBLE) AS score, score >= 7 AS recommended FROM s""")
def _(spark, sf):
    report = _season_report(spark, sf).withColumnRenamed("adf_stationary", "stationary")
    return advice.model_scoring(report, ["grp"], has_features=False, has_groups=True)
