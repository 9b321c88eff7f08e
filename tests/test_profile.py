import datetime as dt

import numpy as np
import pytest

from helpers import SPEC, by_group, noise, series
from seriesloom.operators import advice, profile, spectral, stationarity
from seriesloom.plans.report import series_report


def brute_acf(x, lags):
    c = x - x.mean()
    return np.array([c[k:] @ c[: len(c) - k] for k in range(lags + 1)]) / (c @ c)


def brute_adf(x):
    n = len(x)
    limit = min(n // 2 - 2, int(np.ceil(12 * (n / 100) ** 0.25)))
    d = np.diff(x)

    def fit(k, start):
        rows = range(start, n)
        z = np.array([[1, x[t - 1], *[d[t - 1 - i] for i in range(1, k + 1)]] for t in rows])
        y = np.array([d[t - 1] for t in rows])
        beta, *_ = np.linalg.lstsq(z, y, rcond=None)
        rss = ((y - z @ beta) ** 2).sum()
        m = len(y)
        aic = m * (np.log(2 * np.pi) + np.log(rss / m) + 1) + 2 * (k + 2)
        se = np.sqrt(rss / (m - k - 2) * np.linalg.inv(z.T @ z)[1, 1])
        return aic, beta[1] / se

    best = min(range(limit + 1), key=lambda k: fit(k, limit + 1)[0])
    return fit(best, best + 1)[1], best


def brute_kpss(x):
    n = len(x)
    r = x - x.mean()
    cov = int(n ** (2 / 9))
    s0 = r @ r / n + sum(r[i:] @ r[: n - i] / (n / 2) for i in range(1, cov + 1))
    s1 = sum(i * (r[i:] @ r[: n - i]) / (n / 2) for i in range(1, cov + 1))
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    lrv = (r @ r + 2 * sum((1 - i / (lags + 1)) * (r[i:] @ r[: n - i]) for i in range(1, lags + 1))) / n
    return (np.cumsum(r) ** 2).sum() / n**2 / lrv, lags


GROUPS = {"white": noise(120, 1), "walk": np.cumsum(noise(150, 5)), "ar": noise(200, 3, 0.8)}


def test_acf_and_pacf(spark):
    df = series(spark, {**GROUPS, "const": [1.0] * 30})
    a = spectral.acf(df, SPEC, 12).toPandas()
    p = spectral.pacf(df, SPEC, 12).toPandas()
    for g, x in GROUPS.items():
        want = brute_acf(x, 12)
        np.testing.assert_allclose(a[a.grp == g].sort_values("lag")["acf"], want, atol=1e-9)
        direct = [1.0] + [np.linalg.solve(want[np.abs(np.subtract.outer(np.arange(k), np.arange(k)))], want[1:k + 1])[-1] for k in range(1, 13)]
        np.testing.assert_allclose(p[p.grp == g].sort_values("lag")["pacf"], direct, atol=1e-8)
    assert a[a.grp == "const"]["acf"].isna().all()
    adj = spectral.pacf(df, SPEC, 12, adjusted=True).toPandas()
    assert len(adj) == len(p)


def test_unit_root_tests(spark):
    df = series(spark, {**{g: [*v, None] for g, v in GROUPS.items()}, "const": [1.0] * 40, "tiny": [1.0, 2.0]})
    adf = {r["grp"]: r for r in stationarity.stationarity_adf(df, SPEC).collect()}
    kp = {r["grp"]: r for r in stationarity.stationarity_kpss(df, SPEC).collect()}
    for g, x in GROUPS.items():
        stat, lags = brute_adf(x)
        assert adf[g]["adf_stat"] == pytest.approx(stat, rel=1e-6) and adf[g]["adf_lags"] == lags
        stat, lags = brute_kpss(x)
        assert kp[g]["kpss_stat"] == pytest.approx(stat, rel=1e-8) and kp[g]["kpss_lags"] == lags
    assert adf["white"]["adf_stationary"] and not adf["walk"]["adf_stationary"]
    assert not kp["walk"]["kpss_stationary"]
    assert (adf["const"]["adf_stat"], adf["const"]["adf_p"]) == (0.0, 1.0)
    assert (kp["const"]["kpss_stat"], kp["const"]["kpss_p"], kp["const"]["kpss_stationary"]) == (0.0, 1.0, True)
    assert not adf["tiny"]["adf_stationary"]


def test_adf_pvalues_at_published_points():
    assert stationarity.adf_pvalue(-2.86) == pytest.approx(0.05, abs=0.002)
    assert stationarity.adf_pvalue(-3.43) == pytest.approx(0.01, abs=0.001)
    assert stationarity.adf_pvalue(5) == 1.0 and stationarity.adf_pvalue(-30) == 0.0


@pytest.mark.parametrize("m", [1, 4, 7])
def test_decomposition_identity(spark, m):
    x = 3 + 0.2 * np.arange(60) + np.tile(np.arange(m), 60)[:60] + 0.1 * noise(60)
    d = spectral.seasonal_decompose(series(spark, {"a": x, "short": x[: 2 * m - 1]}), SPEC, m).toPandas()
    assert set(d.grp) == {"a"}
    np.testing.assert_allclose(d.trend + d.seasonal + d.resid, d.y, atol=1e-9)
    assert abs(d.groupby(d.idx % m)["seasonal"].first().sum()) < 1e-9
    assert d.trend.notna().all() and d.groupby(d.idx % m)["seasonal"].nunique().max() == 1


def test_seasonality_methods(spark):
    t = np.arange(140)
    df = series(spark, {"weekly": 10 + 3 * np.sin(2 * np.pi * t / 7) + 0.3 * noise(140), "white": noise(140, 9)})
    got = {r["grp"]: r for r in spectral.seasonality_hybrid(df, SPEC).collect()}
    assert got["weekly"]["detected"] and got["weekly"]["seasonal_period"] == 7 and got["weekly"]["method"] == "acf_and_decomposition"
    assert got["weekly"]["confidence"] == pytest.approx(100 * got["weekly"]["strength"])


def test_profiles_of_awkward_series(spark):
    df = series(spark, {"const": [2.0] * 6, "one": [1.0], "none": [None] * 3, "a": [1.0, 2.0, 3.0, 10.0]})
    d = {r["grp"]: r for r in profile.describe_target(df, SPEC).collect()}
    assert "none" not in d and d["one"]["std"] == 0.0 and d["const"]["skewness"] is None
    assert d["a"]["median"] == 2.5
    t = {r["grp"]: r for r in profile.trend_linear(df, SPEC).collect()}
    assert t["a"]["direction"] == "increasing" and t["one"]["direction"] is None
    h = profile.histogram30(df, SPEC).toPandas()
    assert h.groupby("grp")["n"].sum().to_dict() == {"a": 4, "const": 6, "one": 1}
    box = {r["grp"]: r["outliers"] for r in profile.boxplot_overall(df, SPEC).collect()}
    assert box["a"] == [10.0] and box["const"] == []
    assert {r["grp"]: r["frequency"] for r in profile.date_range_freq(df, SPEC).collect()}["one"] == "unknown"


def test_report_and_advice(spark):
    t = np.arange(150)
    groups = {"walk": np.cumsum(noise(150, 5)), "gappy": [None if i % 8 == 0 else v for i, v in enumerate(np.sin(2 * np.pi * t / 7))], "short": noise(20)}
    report = series_report(series(spark, groups), SPEC)
    alerts = {(r["grp"], r["code"]) for r in advice.quality_alerts(report, ["grp"]).collect()}
    assert ("walk", "not_stationary") in alerts and ("gappy", "many_missing_values") in alerts and ("short", "few_rows") in alerts
    picks = {(r["grp"], r["model"]) for r in advice.model_suggestions(report, ["grp"]).collect()}
    assert ("gappy", "Prophet") in picks and ("walk", "XGBoost") in picks and ("short", "XGBoost") not in picks
    scores = {(r["grp"], r["model"]): r["score"] for r in advice.model_scoring(report, ["grp"], has_groups=True).collect()}
    assert scores["short", "arima"] == 0.0 and scores["walk", "arima"] >= 6.0 and len(scores) == 21


def test_hourly_frequency(spark):
    df = series(spark, {"h": range(50)}, dt.timedelta(hours=1))
    assert profile.date_range_freq(df, SPEC).first()["frequency"] == "H"
    assert by_group(df, "y")["h"].shape == (50, 1)


def test_adf_sends_no_lags(spark, monkeypatch):
    """One value per row is shuffled and sent, whatever the lag order, and blocks give the sums of the whole series."""
    from seriesloom.operators import index, stationarity

    groups = {"long": noise(900, 5, 0.6), "walk": np.cumsum(noise(400, 6)), "short": noise(12, 7), "one": [1.0]}
    df = series(spark, groups)
    whole = {r["grp"]: r for r in stationarity.stationarity_adf(df, SPEC).collect()}
    monkeypatch.setattr(index, "BLOCK_ROWS", 64)
    monkeypatch.setattr(stationarity, "LAGGED_BYTES", 1000)
    res = stationarity.stationarity_adf(df, SPEC)
    assert "lag(" not in res._jdf.queryExecution().analyzed().toString()
    for r in res.collect():
        w = whole[r["grp"]]
        assert r["adf_lags"] == w["adf_lags"] and r["adf_stationary"] == w["adf_stationary"]
        assert abs(r["adf_stat"] - w["adf_stat"]) < 1e-8
