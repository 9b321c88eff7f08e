"""Sources, profiling of schema, sinks, filters and relational operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.base import GAP_SQL, ONE, PANEL, PANEL_SQL, RAW_PANEL, RAW_SQL, REVENUE_SQL, gapped, panel, query, raw_events, revenue, rounded, table
from catalog.forecasts import FORECASTS_SQL, NAIVE_SQL, forecasts
from seriesloom.operators import clean, exog, series, splits
from seriesloom.operators.metrics import align_actual_pred
from seriesloom.session import ensure_checkpoint_dir
from seriesloom.sources import sinks, tables
from seriesloom.spec import SeriesSpec


def _shared(spark, name):
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4()}"


@query("load_table", "SELECT * FROM orders")
def _(spark, sf):
    return tables.load_table(spark, f"{sf}/orders.parquet")


@query("numeric_coerce", """
SELECT o_orderkey, CAST(substring(o_orderpriority, 1, 1) AS DOUBLE) AS code, o_orderstatus,
       CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS target FROM orders""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.substring("o_orderpriority", 1, 1).alias("code"), "o_orderstatus",
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice").cast("string")).otherwise(F.col("o_orderstatus")).alias("target"),
    )
    return tables.numeric_coerce(o, target="target")


@query("date_parse", """
SELECT o_orderkey, o_orderdate AS strict_ts, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS lenient_ts FROM orders""")
def _(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    o = table(spark, sf, "orders").select(
        "o_orderkey", day.alias("strict_ts"), F.when(F.col("o_orderstatus") == "F", day).otherwise("n/a").alias("lenient_ts")
    )
    return tables.date_parse(tables.date_parse(o, "strict_ts"), "lenient_ts", strict=False)


@query("table_preview", """
SELECT event_id, ts, event_type, CASE WHEN value > 0 THEN value END AS value FROM events ORDER BY event_id LIMIT 50""")
def _(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", "ts", "event_type", F.when(F.col("value") > 0, F.col("value")).otherwise(float("nan")).alias("value")
    )
    return tables.table_preview(e, ["event_id"], 50)


@query("table_shape", """
SELECT unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']) AS "column",
       unnest(['bigint', 'timestamp_ntz', 'bigint', 'string', 'double', 'string']) AS dtype, n_rows
FROM (SELECT count(*) AS n_rows FROM events)""")
def _(spark, sf):
    return tables.table_shape(table(spark, sf, "events"))


@query("group_candidates", """
WITH c AS (
  SELECT 'o_orderstatus' AS "column", count(DISTINCT o_orderstatus) AS n_unique, count(*) AS n_rows FROM orders
  UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), count(*) FROM orders)
SELECT *, (n_unique BETWEEN 2 AND 50) OR n_unique / n_rows < 0.05 AS is_candidate FROM c""")
def _(spark, sf):
    return tables.group_candidates(table(spark, sf, "orders"))


@query("duplicate_dates", """
SELECT l_returnflag, l_shipdate, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def _(spark, sf):
    return tables.duplicate_dates(table(spark, sf, "lineitem"), ["l_returnflag", "l_shipdate"])


@query("export_long", f"""
WITH {PANEL_SQL}, {FORECASTS_SQL}
SELECT model, grp, ts AS date, round(yhat, 2) AS forecast FROM fc WHERE model = 'seasonal_naive'""")
def _(spark, sf):
    docs = sinks.forecast_documents(forecasts(spark, sf), ["grp"])
    return rounded(sinks.export_long(docs, ["grp"], best="seasonal_naive"), 2, "forecast")


@query("export_with_history", f"""
WITH {PANEL_SQL}, {FORECASTS_SQL}
SELECT model, grp, ts AS date, round(yhat, 2) AS forecast, NULL::DOUBLE AS actual FROM fc
UNION ALL SELECT 'historical', grp, ts, NULL, round(y, 2) FROM pan""")
def _(spark, sf):
    docs = sinks.forecast_documents(forecasts(spark, sf), ["grp"])
    out = sinks.export_with_history(sinks.export_long(docs, ["grp"]), panel(spark, sf), "ts", "y", ["grp"])
    return rounded(out, 2, "forecast", "actual").select("model", "grp", "date", "forecast", "actual")


@query("export_json", f"""
WITH {PANEL_SQL}, {FORECASTS_SQL}
SELECT model, grp, count(*) AS n_steps, round(sum(yhat), 1) AS total FROM fc GROUP BY ALL""")
def _(spark, sf):
    texts = sinks.export_json(forecasts(spark, sf), ["grp"])
    back = F.from_json("document", "values array<double>")["values"]
    total = F.aggregate(back, F.lit(0.0), lambda a, v: a + v)
    return texts.select("model", "grp", F.size(back).cast("long").alias("n_steps"), F.round(total, 1).alias("total"))


@query("write_splits", """
WITH p AS (SELECT o_orderpriority AS grp, o_orderdate AS ts FROM orders GROUP BY ALL),
r AS (SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM p)
SELECT grp, CASE WHEN i < floor(n * 0.7e0) THEN 'train' WHEN i < floor(n * 0.7e0) + floor(n * 0.15e0) THEN 'val' ELSE 'test' END AS split,
       count(*) AS n FROM r GROUP BY ALL""")
def _(spark, sf):
    path = _shared(spark, "splits")
    sinks.write_splits(splits.split_ratio(panel(spark, sf), PANEL), path, ["grp"])
    return spark.read.parquet(path).groupBy("grp", "split").agg(F.count(F.lit(1)).alias("n"))


@query("results_append", """
SELECT run_id, o_orderstatus, count(*) AS n FROM orders, (SELECT unnest(['a', 'b']) AS run_id) GROUP BY ALL""")
def _(spark, sf):
    path = _shared(spark, "results")
    counts = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    sinks.results_append(counts, path, "a")
    sinks.results_append(counts, path, "b")
    return spark.read.parquet(path).select("run_id", "o_orderstatus", "n")


@query("build_series", """
SELECT l_returnflag AS grp, date_trunc('week', l_shipdate) AS ts, round(sum(l_extendedprice), 2) AS y FROM lineitem GROUP BY ALL""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "grp")
    return rounded(series.build_series(li, "l_shipdate", "l_extendedprice", "W", ["grp"]), 2, "y")


@query("date_scope", """
SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate <= TIMESTAMP '1998-06-30'""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return series.date_scope(li, SeriesSpec(ts="l_shipdate"), "1997-01-01", "1998-06-30")


@query("select_groups", "SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def _(spark, sf):
    return series.select_groups(table(spark, sf, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query("select_models", f"""
WITH {PANEL_SQL}, {FORECASTS_SQL}
SELECT model || ' (grp=' || grp || ')' AS model, ts, round(yhat, 2) AS yhat FROM fc WHERE model = 'naive'""")
def _(spark, sf):
    named = forecasts(spark, sf).select(F.concat("model", F.lit(" (grp="), "grp", F.lit(")")).alias("model"), "ts", F.round("yhat", 2).alias("yhat"))
    return sinks.select_models(named, ["naive"])


@query("drop_incomplete", f"WITH {GAP_SQL} SELECT grp, ts, round(y, 2) AS y FROM gap WHERE y IS NOT NULL")
def _(spark, sf):
    return rounded(series.drop_incomplete(gapped(spark, sf)), 2, "y")


@query("sort_series", f"WITH {RAW_SQL} SELECT grp, ts, y, event_id FROM raw ORDER BY grp, ts, event_id")
def _(spark, sf):
    return series.sort_series(raw_events(spark, sf), RAW_PANEL)


@query("head_tail", f"""
WITH {RAW_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ts, event_id) AS a,
  row_number() OVER (PARTITION BY grp ORDER BY ts DESC, event_id DESC) AS b FROM raw)
SELECT grp, ts, y, event_id, 'head' AS part FROM r WHERE a <= 3 UNION ALL SELECT grp, ts, y, event_id, 'tail' FROM r WHERE b <= 3""")
def _(spark, sf):
    return series.head_tail(raw_events(spark, sf), RAW_PANEL, 3).select("grp", "ts", "y", "event_id", "part")


@query("dedupe_keep_last", """
SELECT o_orderpriority AS grp, o_orderdate AS ts, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS y FROM orders GROUP BY ALL""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_orderdate").alias("ts"), "o_orderkey", F.col("o_totalprice").alias("y"))
    return series.dedupe_keep_last(o, SeriesSpec(group="grp", tie="o_orderkey"))


@query("union_parts", """
SELECT o_orderdate AS ts, o_totalprice AS y, 'order' AS src, NULL::DOUBLE AS q FROM orders
UNION ALL SELECT l_shipdate, l_extendedprice, 'line', l_quantity FROM lineitem""")
def _(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("y"), F.lit("order").alias("src"))
    b = table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("y"), F.lit("line").alias("src"), F.col("l_quantity").alias("q"))
    return series.union_parts(a, b)


@query("align_actual_pred", f"""
WITH {PANEL_SQL}, {REVENUE_SQL}
SELECT pan.grp, ts, round(pan.y, 2) AS actual, round(rev.y / 5, 2) AS pred FROM pan JOIN rev USING (ts)""")
def _(spark, sf):
    a = panel(spark, sf).withColumnRenamed("y", "actual")
    p = revenue(spark, sf).select("ts", (F.col("y") / 5).alias("pred"))
    return rounded(align_actual_pred(a, p, ["ts"]).select("grp", "ts", "actual", "pred"), 2, "actual", "pred")


@query("regressor_lookup", f"""
WITH {GAP_SQL}, f AS (SELECT grp, ts,
   last_value(y IGNORE NULLS) OVER (PARTITION BY grp ORDER BY ts ROWS UNBOUNDED PRECEDING) AS p,
   first_value(y IGNORE NULLS) OVER (PARTITION BY grp ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM gap)
SELECT grp, ts, round(coalesce(p, n, 0), 2) AS x FROM f""")
def _(spark, sf):
    regs = panel(spark, sf).withColumnRenamed("y", "x")
    grid = clean.date_grid(panel(spark, sf), PANEL)
    return rounded(exog.regressor_lookup(grid, regs, PANEL, ["x"]).select("grp", "ts", "x"), 2, "x")


@query("carry_exog", f"""
WITH {PANEL_SQL}, ends AS (SELECT grp, max(ts) AS b FROM pan GROUP BY grp),
fut AS (SELECT grp, b + to_days(CAST(h AS INTEGER)) AS ts FROM ends, (SELECT unnest(generate_series(1, 30)) AS h)),
near AS (SELECT fut.grp, fut.ts, arg_min(pan.y, (abs(epoch_us(pan.ts) - epoch_us(fut.ts - INTERVAL 365 DAY)), pan.ts)) AS x
  FROM fut JOIN pan ON pan.grp = fut.grp AND pan.ts BETWEEN fut.ts - INTERVAL 372 DAY AND fut.ts - INTERVAL 358 DAY GROUP BY ALL),
dow AS (SELECT grp, isodow(ts) AS d, arg_max(y, ts) AS x FROM pan GROUP BY ALL)
SELECT fut.grp, fut.ts, round(coalesce(near.x, dow.x), 2) AS x FROM fut LEFT JOIN near USING (grp, ts)
LEFT JOIN dow ON dow.grp = fut.grp AND dow.d = isodow(fut.ts)""")
def _(spark, sf):
    from seriesloom.forecast.baseline import future_dates

    hist = panel(spark, sf).withColumnRenamed("y", "x")
    grid = future_dates(hist, PANEL, 30).select("grp", "ts")
    return rounded(exog.carry_exog(hist, grid, PANEL, ["x"]), 2, "x")


@query("last_value_exog", f"""
WITH {PANEL_SQL}, {NAIVE_SQL}
SELECT grp, ts, round(yhat, 2) AS x, 0.0::DOUBLE AS absent FROM naive""")
def _(spark, sf):
    from seriesloom.forecast.baseline import future_dates

    hist = panel(spark, sf).withColumnRenamed("y", "x")
    grid = future_dates(hist, PANEL, 30).select("grp", "ts")
    return rounded(exog.last_value_exog(hist, grid, PANEL, ["x", "absent"]), 2, "x")
