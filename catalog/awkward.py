"""Queries whose input holds a NULL group, NaN or numbers with suffixes, made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import PANEL, panel, query, rounded, table
from seriesloom.functions.features import ewm_feature, rolling_features
from seriesloom.functions.transforms import tx_minmax, tx_standardize
from seriesloom.operators.clean import absent_dates, fill_missing_dates, reindex_fill
from seriesloom.operators.exog import regressor_lookup
from seriesloom.operators.metrics import align_actual_pred
from seriesloom.operators.ranking import rank_models
from seriesloom.sources.tables import numeric_coerce

# The panel with its urgent orders under a NULL group, and NaN on every Monday.
_BAD_SQL = """bad AS (SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderpriority END AS grp, o_orderdate AS ts,
  CASE WHEN isodow(o_orderdate) = 1 THEN NULL ELSE round(sum(o_totalprice), 2) END AS y FROM orders GROUP BY o_orderpriority, o_orderdate)
, ends AS (SELECT grp, min(ts) AS a, max(ts) AS b FROM bad GROUP BY grp)
, grid AS (SELECT grp, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS ts FROM ends)
, full_ AS (SELECT grid.grp, grid.ts, bad.y FROM grid LEFT JOIN bad ON bad.grp IS NOT DISTINCT FROM grid.grp AND bad.ts = grid.ts)"""


def bad(spark, sf):
    df = rounded(panel(spark, sf), 2, "y")
    return df.select(F.when(F.col("grp") != "1-URGENT", F.col("grp")).alias("grp"), "ts", F.when(F.weekday("ts") == 0, float("nan")).otherwise(F.col("y")).alias("y"))


def _plain(df, *columns):
    """NaN as NULL, for the comparison."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


@query("null_group_fill_dates", f"WITH {_BAD_SQL} SELECT grp, ts, y FROM full_")
def _(spark, sf):
    return _plain(fill_missing_dates(bad(spark, sf), PANEL, "D"), "y")


@query("null_group_absent_dates", f"WITH {_BAD_SQL} SELECT grp, ts FROM grid WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.grp IS NOT DISTINCT FROM grid.grp AND bad.ts = grid.ts)")
def _(spark, sf):
    return absent_dates(bad(spark, sf), PANEL, "D").select("grp", "ts")


@query("null_group_reindex", f"""WITH {_BAD_SQL} SELECT grp, ts, coalesce(
  last_value(y IGNORE NULLS) OVER (PARTITION BY grp ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(y IGNORE NULLS) OVER (PARTITION BY grp ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS y FROM full_""")
def _(spark, sf):
    df = bad(spark, sf)
    return reindex_fill(df, fill_missing_dates(df, PANEL, "D").select("grp", "ts"), PANEL, ["y"])


@query("null_group_regressors", f"""WITH {_BAD_SQL} SELECT grp, ts, round(coalesce(
  last_value(y IGNORE NULLS) OVER (PARTITION BY grp ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(y IGNORE NULLS) OVER (PARTITION BY grp ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 2) AS y FROM full_""")
def _(spark, sf):
    df = _plain(bad(spark, sf), "y")
    return rounded(regressor_lookup(fill_missing_dates(df, PANEL, "D").select("grp", "ts"), df, PANEL, ["y"]), 2, "y")


@query("null_group_pairs", f"WITH {_BAD_SQL} SELECT grp, ts, y AS actual, y / 2 AS pred FROM bad WHERE y IS NOT NULL")
def _(spark, sf):
    df = bad(spark, sf)
    return align_actual_pred(df.withColumnRenamed("y", "actual"), df.select("grp", "ts", (F.col("y") / 2).alias("pred")), ["grp", "ts"]).select("grp", "ts", "actual", "pred")


@query("nan_standardize", f"""WITH {_BAD_SQL}, s AS (SELECT grp, avg(y) AS m, stddev_pop(y) AS d FROM bad GROUP BY grp)
SELECT bad.grp, ts, round((y - m) / d, 6) AS y FROM bad JOIN s ON s.grp IS NOT DISTINCT FROM bad.grp""")
def _(spark, sf):
    return rounded(tx_standardize(bad(spark, sf), PANEL), 6, "y")


@query("nan_minmax", f"""WITH {_BAD_SQL}, s AS (SELECT grp, min(y) AS a, max(y) AS b FROM bad GROUP BY grp)
SELECT bad.grp, ts, round((y - a) / (b - a), 6) AS y FROM bad JOIN s ON s.grp IS NOT DISTINCT FROM bad.grp""")
def _(spark, sf):
    return rounded(tx_minmax(bad(spark, sf), PANEL), 6, "y")


@query("nan_rolling", f"""WITH {_BAD_SQL} SELECT grp, ts, CASE WHEN count(y) OVER w = 4 THEN round(avg(y) OVER w, 4) END AS m, CASE WHEN count(y) OVER w = 4 THEN round(stddev_samp(y) OVER w, 2) END AS s
FROM bad WINDOW w AS (PARTITION BY grp ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    out = rolling_features(bad(spark, sf), PANEL, [4])
    return rounded(rounded(out.select("grp", "ts", F.col("y_rolling_mean_4").alias("m"), F.col("y_rolling_std_4").alias("s")), 4, "m"), 2, "s")


@query("nan_ewm", f"""WITH {_BAD_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ts) AS k FROM bad)
SELECT a.grp, a.ts, round(sum(b.y * 0.75e0 ** (a.k - b.k)) / nullif(sum(CASE WHEN b.y IS NOT NULL THEN 0.75e0 ** (a.k - b.k) END), 0), 2) AS e
FROM i a LEFT JOIN i b ON a.grp IS NOT DISTINCT FROM b.grp AND b.k < a.k AND b.k >= a.k - 140 GROUP BY a.grp, a.ts""")
def _(spark, sf):
    return rounded(ewm_feature(bad(spark, sf), PANEL, 7, "e").select("grp", "ts", "e"), 2, "e")


@query("nan_rank", """SELECT o_custkey, o_orderpriority AS model, CASE WHEN count(*) > 1 THEN (max(o_totalprice) - min(o_totalprice)) / max(o_totalprice) END AS r2,
  row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN count(*) > 1 THEN (max(o_totalprice) - min(o_totalprice)) / max(o_totalprice) END DESC NULLS LAST, o_orderpriority) AS rank
FROM orders GROUP BY o_custkey, o_orderpriority""")
def _(spark, sf):
    """Priorities of each customer ranked by the spread of their prices; a single order has none, which is NaN."""
    price = F.col("o_totalprice")
    spread = F.when(F.count("*") > 1, (F.max(price) - F.min(price)) / F.max(price)).otherwise(float("nan"))
    scores = table(spark, sf, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("model")).agg(spread.alias("r2"))
    return _plain(rank_models(scores, "r2", ["o_custkey"]), "r2").withColumn("rank", F.col("rank").cast("long"))


@query("suffix_coerce", """SELECT o_orderkey, CAST(o_custkey AS VARCHAR) || CASE WHEN o_orderkey % 17 = 0 THEN 'F' ELSE '' END AS code, CAST(o_custkey AS DOUBLE) AS plain,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS target FROM orders""")
def _(spark, sf):
    key = F.col("o_custkey").cast("string")
    marked = F.concat(key, F.when(F.col("o_orderkey") % 17 == 0, "F").otherwise(""))
    rows = table(spark, sf, "orders").select("o_orderkey", marked.alias("code"), key.alias("plain"), marked.alias("target"))
    return numeric_coerce(rows, "target")
