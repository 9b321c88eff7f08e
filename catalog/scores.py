"""Metrics, ranking and evaluation advice, on the baseline back-test of the panel."""

from __future__ import annotations

from time import perf_counter

from pyspark.sql import functions as F

from catalog.base import HOURLY_SQL, PANEL, PANEL_SQL, hourly, panel, query, rounded, table
from seriesloom.forecast.baseline import fc_naive, fc_seasonal_naive
from seriesloom.operators import metrics, ranking
from seriesloom.plans.backtest import split_with_steps
from seriesloom.session import materialize

BY = ["grp", "model"]

_LABEL = "CASE WHEN i < floor(n * 0.7e0) THEN 'train' WHEN i < floor(n * 0.7e0) + floor(n * 0.15e0) THEN 'val' ELSE 'test' END"
_PAIRS_SQL = f"""
WITH {PANEL_SQL}, {HOURLY_SQL}, src AS (SELECT * FROM pan UNION ALL SELECT * FROM hr),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM src),
s AS (SELECT *, {_LABEL} AS split FROM r),
known AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ts DESC) AS k FROM s WHERE split <> 'test'),
test AS (SELECT grp, ts, y AS actual, row_number() OVER (PARTITION BY grp ORDER BY ts) AS h FROM s WHERE split = 'test'),
p AS (SELECT 'naive' AS model, test.grp, test.ts, test.actual, known.y AS pred FROM test JOIN known ON known.grp = test.grp AND known.k = 1
  UNION ALL SELECT 'seasonal_naive', test.grp, test.ts, test.actual, known.y FROM test JOIN known ON known.grp = test.grp AND known.k = 7 - (test.h - 1) % 7)"""


def pairs(spark, sf, seconds: dict[str, float] | None = None):
    """Actual and predicted test values of two models over daily and hourly series, and the split rows.

    With ``seconds`` each model's predictions are written by themselves, and the time that takes is noted there.
    """
    split = materialize(split_with_steps(panel(spark, sf).unionByName(hourly(spark, sf)), PANEL))
    known, test = split.filter("split <> 'test'"), split.filter("split = 'test'")
    grid = test.select("grp", "h", "ts")
    preds = None
    for name, make in (("naive", fc_naive), ("seasonal_naive", fc_seasonal_naive)):
        start = perf_counter()
        part = make(known, PANEL, grid=grid).withColumn("model", F.lit(name))
        if seconds is not None:
            part = materialize(part)
            seconds[name] = perf_counter() - start
        preds = part if preds is None else preds.unionByName(part)
    actual = test.select("grp", "ts", F.col("y").alias("actual"))
    out = metrics.align_actual_pred(actual, preds.select("model", "grp", "ts", F.col("yhat").alias("pred")), ["grp", "ts"])
    return out.select("model", "grp", "ts", "actual", "pred"), split


_EXPR = {
    "mae": ("avg(abs(actual - pred))", 2),
    "rmse": ("sqrt(avg((actual - pred) ** 2))", 2),
    "r2": ("1 - sum((actual - pred) ** 2) / (var_pop(actual) * count(*))", 6),
    "mape": ("coalesce(avg(CASE WHEN actual <> 0 THEN abs((actual - pred) / actual) END) * 100, 0)", 4),
    "smape": ("coalesce(avg(CASE WHEN abs(actual) + abs(pred) <> 0 THEN 2 * abs(actual - pred) / (abs(actual) + abs(pred)) END) * 100, 0)", 4),
}


def _register(name: str):
    sql, digits = _EXPR[name]
    make = getattr(metrics, f"metric_{name}")

    @query(f"metric_{name}", f"{_PAIRS_SQL} SELECT grp, model, count(*) AS n, round({sql}, {digits}) AS {name} FROM p GROUP BY ALL")
    def _(spark, sf):
        return rounded(make(pairs(spark, sf)[0], BY), digits, name)


for _name in _EXPR:
    _register(_name)


@query("metric_medae", f"{_PAIRS_SQL} SELECT grp, model, round(median(abs(actual - pred)), 3) AS medae FROM p GROUP BY ALL")
def _(spark, sf):
    return rounded(metrics.metric_medae(pairs(spark, sf)[0], BY), 3, "medae")


_SCALE_SQL = """, scale AS (SELECT grp, avg(abs(d)) AS ne FROM (SELECT grp, y - lag(y) OVER (PARTITION BY grp ORDER BY ts) AS d FROM s WHERE split = 'train') GROUP BY grp)"""


@query("metric_mase", f"{_PAIRS_SQL}{_SCALE_SQL} SELECT grp, model, count(*) AS n, round(avg(abs(actual - pred)) / any_value(ne), 6) AS mase FROM p JOIN scale USING (grp) GROUP BY ALL")
def _(spark, sf):
    both, split = pairs(spark, sf)
    return rounded(metrics.metric_mase(both, split.filter("split = 'train'"), PANEL, BY), 6, "mase")


@query("residuals", f"{_PAIRS_SQL} SELECT model, grp, ts, round(actual, 2) AS actual, round(pred, 2) AS pred, CASE WHEN abs(actual - pred) < 5e-5 THEN 0 ELSE round(actual - pred, 2) END AS residual FROM p")
def _(spark, sf):
    return rounded(metrics.residuals(pairs(spark, sf)[0]), 2, "actual", "pred", "residual")


@query("fit_diagnostics", f"""{_PAIRS_SQL} SELECT grp, model, CASE WHEN stddev_pop(actual) > 0 AND stddev_pop(pred) > 1e-9 THEN round(corr(actual, pred), 6) ELSE 0 END AS correlation,
  CASE WHEN stddev_pop(actual) > 0 AND stddev_pop(pred) > 1e-9 THEN round(stddev_pop(pred) / stddev_pop(actual), 6) ELSE 1 END AS std_ratio FROM p GROUP BY ALL""")
def _(spark, sf):
    return rounded(metrics.fit_diagnostics(pairs(spark, sf)[0], BY), 6, "correlation", "std_ratio")


_SCORES_SQL = _PAIRS_SQL + _SCALE_SQL + f""", sc AS (SELECT grp, model, count(*) AS n, {', '.join(f'{sql} AS {name}' for name, (sql, _) in _EXPR.items())},
  median(abs(actual - pred)) AS medae, avg(abs(actual - pred)) / any_value(ne) AS mase FROM p JOIN scale USING (grp) GROUP BY ALL)"""
_ROUNDED_SQL = "round(mae, 2) AS mae, round(rmse, 2) AS rmse, round(mape, 4) AS mape, round(smape, 4) AS smape, round(r2, 6) AS r2, round(medae, 4) AS medae, round(mase, 6) AS mase"


def scores(spark, sf):
    """All metrics per series and model, with the measured training time."""
    seconds: dict[str, float] = {}
    both, split = pairs(spark, sf, seconds)
    out = metrics.score(materialize(both), split.filter("split = 'train'"), PANEL, BY)
    return out.withColumn("training_time", F.element_at(F.create_map(*[F.lit(x) for kv in seconds.items() for x in kv]), F.col("model")))


def _timed(df, column="training_time"):
    """Measured times differ from run to run; what can be compared is that there is one."""
    return df.withColumn("timed", F.col(column) > 0).drop(column)


def _round_scores(df):
    return rounded(rounded(rounded(df, 2, "mae", "rmse"), 4, "mape", "smape", "medae"), 6, "r2", "mase")


@query("rank_models", f"{_SCORES_SQL} SELECT grp, model, n, {_ROUNDED_SQL}, true AS timed, row_number() OVER (PARTITION BY grp ORDER BY r2 DESC, model) AS rank FROM sc")
def _(spark, sf):
    ranked = ranking.rank_models(scores(spark, sf), "r2", ["grp"])
    return _timed(_round_scores(ranked).withColumn("rank", F.col("rank").cast("long")))


_GROUPED_SQL = _SCORES_SQL + """, gr AS (SELECT model, count(*) AS n_series, avg(mae) AS mae, avg(rmse) AS rmse, avg(mape) AS mape, avg(smape) AS smape, avg(r2) AS r2, avg(medae) AS medae,
  avg(mase) AS mase FROM sc GROUP BY model), rk AS (SELECT *, row_number() OVER (ORDER BY rmse, model) AS rank FROM gr)"""


@query("rank_grouped", f"{_GROUPED_SQL} SELECT model, n_series, {_ROUNDED_SQL}, true AS timed, rank FROM rk")
def _(spark, sf):
    return _timed(_round_scores(ranking.rank_grouped(scores(spark, sf))).withColumn("rank", F.col("rank").cast("long")))


_TIMES_SQL = ", tt AS (SELECT model, CAST(sum(n * length(model)) AS DOUBLE) AS training_time FROM sc GROUP BY model)"


@query("eval_summary", f"""{_GROUPED_SQL}{_TIMES_SQL} SELECT CAST(sum(n_series) AS BIGINT) AS total_models, max(CASE WHEN rank = 1 THEN model END) AS best_model, round(max(CASE WHEN rank = 1 THEN rmse END), 2) AS best_value,
  {', '.join(f"round(coalesce(avg(nullif({m}, 0)), 0), {2 if m in ('mae', 'rmse') else 6 if m == 'medae' else 4}) AS avg_{m}" for m in metrics.METRICS)}, sum(training_time) AS total_training_time, true AS timed
  FROM rk JOIN tt USING (model)""")
def _(spark, sf):
    """``total_training_time`` sums a time that SQL can state, test rows times the length of the model's name; ``timed`` is about the measured seconds."""
    measured = materialize(scores(spark, sf))
    seconds = ranking.eval_summary(ranking.rank_grouped(measured)).first()["total_training_time"]
    stated = measured.withColumn("training_time", F.col("n") * F.length("model").cast("double"))
    out = ranking.eval_summary(ranking.rank_grouped(stated))
    out = rounded(rounded(out, 2, "best_value", "avg_mae", "avg_rmse"), 6, "avg_medae")
    return rounded(out, 4, "avg_mape", "avg_smape", "avg_r2", "avg_mase").withColumn("timed", F.lit(seconds).cast("double") > 0)


@query("eval_advice", f"""{_GROUPED_SQL}, t AS (SELECT max(CASE WHEN rank = 1 THEN model END) AS best_model, max(CASE WHEN rank = 1 THEN rmse END) AS m1, max(CASE WHEN rank = 2 THEN rmse END) AS m2,
  max(CASE WHEN rank = 1 THEN mape END) AS mape, max(CASE WHEN rank = 1 THEN r2 END) AS r2 FROM rk)
SELECT best_model, 'best_model' AS rule, round(m1, 2) AS value FROM t
UNION ALL SELECT best_model, 'top_two_are_close', round(abs(m1 - m2) / m2 * 100, 2) FROM t WHERE m2 > 0 AND abs(m1 - m2) / m2 * 100 < 5
UNION ALL SELECT best_model, 'mape_excellent', round(mape, 2) FROM t WHERE mape < 5 UNION ALL SELECT best_model, 'mape_good', round(mape, 2) FROM t WHERE mape >= 5 AND mape < 10
UNION ALL SELECT best_model, 'mape_high', round(mape, 2) FROM t WHERE mape > 20
UNION ALL SELECT best_model, 'r2_low', round(r2, 2) FROM t WHERE r2 < 0.5 UNION ALL SELECT best_model, 'r2_excellent', round(r2, 2) FROM t WHERE r2 > 0.9""")
def _(spark, sf):
    return rounded(ranking.eval_advice(ranking.rank_grouped(scores(spark, sf))), 2, "value")
