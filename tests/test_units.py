"""Hand-made frames (FIXTURES.md section 3) checked against numpy / pandas."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statlens.functions import dist
from statlens.operators import (changepoint, correlation, distribution, evaluation, outliers, pca, profile, quality,
                                rolling, seasonal, states, stationarity, trend)
from statlens.plans.ordered import dense_index, rolling_frame, wide_frame
from statlens.functions.columns import as_double
from statlens.plans.quantiles import exact_quantiles, fence_table


# ---------------------------------------------------------------- distributions

def test_t_quantiles_known_values():
    assert dist.t_ppf(0.975, 55) == pytest.approx(2.0040447832891393, abs=1e-12)
    assert dist.t_ppf(0.975, 1) == pytest.approx(12.706204736174698, abs=1e-9)
    assert dist.t_ppf(0.5, 7) == 0.0
    assert dist.two_sided_z(0.95) == pytest.approx(1.959963984540054, abs=1e-14)
    assert dist.t_sf2(2.0040447832891393, 55) == pytest.approx(0.05, abs=1e-12)


def test_adf_pvalue_anchor():
    assert dist.adf_pvalue(-2.86) == pytest.approx(0.050, abs=2e-3)
    assert dist.adf_pvalue(3.0) == 1.0 and dist.adf_pvalue(-20.0) == 0.0


# ---------------------------------------------------------------- profile / quality

def test_nan_and_null_are_missing(spark):
    rows = [(1, 1.0, None, "a", True), (2, float("nan"), None, None, False), (3, 3.0, None, "c", None)]
    df = spark.createDataFrame(rows, "id int, x double, y double, s string, flag boolean")
    info = {r["column_name"]: r["nulls"] for r in profile.column_info(df).collect()}
    assert info == {"id": 0, "x": 1, "y": 3, "s": 1, "flag": 1}
    roles = {r["column_name"]: r["role"] for r in profile.column_roles(df).collect()}
    assert roles["flag"] == "other" and roles["s"] == "categorical" and roles["x"] == "numerical"
    ms = profile.missing_summary(df).collect()
    assert [r["column_name"] for r in ms] == ["y", "flag", "s", "x"]


def test_duplicates_null_equals_null(spark):
    rows = [(1, "a"), (1, "a"), (None, None), (None, None), (2, None)]
    df = spark.createDataFrame(rows, "a int, b string")
    assert profile.duplicate_count(df).first()["duplicates"] == 2
    assert quality.uniqueness(df).first()["uniqueness_pct"] == pytest.approx(60.0)


def test_validity_names_case_insensitive(spark):
    df = spark.createDataFrame([(-1, 2.0, -3.0, -1.0)], "Age int, price double, SALARY double, other double")
    r = quality.validity_score(df).first()
    assert r["n_invalid_columns"] == 2 and r["validity"] == 80.0


def test_constant_column_zero_outliers(spark):
    df = spark.createDataFrame([(i, 5.0, float(i)) for i in range(20)], "i int, c double, v double")
    rep = {r["column_name"]: r for r in outliers.outlier_report(df, ["c", "v"]).collect()}
    assert rep["c"]["z_outliers"] == 0 and rep["c"]["iqr_outliers"] == 0
    z = outliers.zscore(df, ["c"]).select("z_c").distinct().collect()
    assert z[0]["z_c"] is None


# ---------------------------------------------------------------- quantiles

@pytest.mark.parametrize("parts, limit", [(1, 10**6), (4, 1), (16, 10**6)])  # limit 1: brackets are narrowed
def test_exact_quantiles_match_numpy(spark, parts, limit):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(size=500), np.full(300, 0.25), rng.exponential(size=200)])
    df = spark.createDataFrame([(float(v),) for v in vals], "value double").repartition(parts)
    long = df.select(F.lit("v").alias("k"), "value")
    got = {r["p"]: r["quantile"] for r in exact_quantiles(long, ["k"], "value", [0.0, 0.1, 0.25, 0.5, 0.9, 1.0],
                                                         limit=limit).collect()}
    for p, qv in got.items():
        assert qv == pytest.approx(np.quantile(vals, p), abs=1e-12)


# ---------------------------------------------------------------- ordered plans

@pytest.mark.parametrize("parts, buckets", [(1, 7), (4, 1), (16, 64)])
def test_dense_index_and_frames_any_partitioning(spark, parts, buckets):
    rng = np.random.default_rng(7)
    n = 2000
    v = rng.normal(size=n)
    v[::37] = np.nan
    ts = [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=int(i // 3)) for i in range(n)]  # ties in time
    rows = [(ts[i], i, None if np.isnan(v[i]) else float(v[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, id int, v double").repartition(parts)
    ix = dense_index(df, ["ts", "id"], partitions=buckets).orderBy("idx").select("id", "idx").toPandas()
    assert list(ix["id"]) == list(range(n)) and list(ix["idx"]) == list(range(n))
    s = pd.Series(v)
    r = rolling_frame(df, "v", ["ts", "id"], w=30, partitions=buckets, block=97).toPandas().sort_values("idx")
    exp = s.rolling(30, center=True, min_periods=1)
    full = r["_wcount"].to_numpy() == s.rolling(30, center=True, min_periods=1).count().to_numpy()
    assert full.all()
    np.testing.assert_allclose(r["_wmean"].to_numpy(dtype=float), exp.mean().to_numpy(), atol=1e-12)
    wf = wide_frame(dense_index(df, ["ts", "id"], partitions=buckets), "v", lo=150, hi=149, block=97).toPandas().sort_values("idx")
    pm = s.rolling(300, center=True, min_periods=1).mean().to_numpy()
    ok = ~wf["_wmean"].isna().to_numpy()
    np.testing.assert_allclose(wf["_wmean"].to_numpy(dtype=float)[ok], pm[ok], atol=1e-10)


@pytest.mark.parametrize("n", [10, 11, 19, 20, 23, 24, 49, 50])
def test_rolling_window_rules(spark, n):
    v = [float(i % 7) + 0.5 * i for i in range(n)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "idx0 int, v double")
    r = rolling.rolling(df, "v", ["idx0"]).toPandas().sort_values("idx")
    w = min(30, n // 10) if n > 10 else 0
    if w == 0:
        assert r["rolling_mean"].isna().all()
        return
    exp_m = pd.Series(v).rolling(w, center=True).mean()
    exp_s = pd.Series(v).rolling(w, center=True).std()
    np.testing.assert_allclose(r["rolling_mean"].to_numpy(dtype=float), exp_m.to_numpy(), atol=1e-12)
    np.testing.assert_allclose(r["rolling_std"].to_numpy(dtype=float), exp_s.to_numpy(), atol=1e-12)
    summ = rolling.rolling_summary(df, "v", ["idx0"]).first()
    if w == 1:
        assert summ["volatility_pattern"] == "Insufficient data" and summ["volatility_status"] == "Volatile"


def test_linear_trend_matches_polyfit(spark):
    rng = np.random.default_rng(1)
    y = 3.0 + 0.5 * np.arange(100) + rng.normal(size=100)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(y)], "i int, y double")
    r = trend.linear_trend(df, "y", ["i"]).first()
    slope, icpt = np.polyfit(np.arange(100), y, 1)
    assert r["slope"] == pytest.approx(slope, abs=1e-10) and r["intercept"] == pytest.approx(icpt, abs=1e-9)
    # |slope| = 0.5 < 0.1 * std(y) ~ 1.44 -> Weak by the reference rule
    assert r["trend_strength"] == "Weak" and r["direction"] == "Increasing"
    band = trend.trend_band(df, "y", ["i"]).orderBy("idx").toPandas()
    resid = y - (icpt + slope * np.arange(100))
    sigma = np.std(resid)
    x = np.arange(100)
    se = sigma * np.sqrt(1 / 100 + (x - x.mean()) ** 2 / np.sum((x - x.mean()) ** 2))
    np.testing.assert_allclose(band["half_width"], dist.t_ppf(0.975, 98) * se, rtol=1e-9)


def _decompose_numpy(y, p=12):
    n = len(y)
    t = np.full(n, np.nan)
    h = p // 2
    for k in range(h, n - h):
        t[k] = (0.5 * y[k - h] + y[k - h + 1:k + h].sum() + 0.5 * y[k + h]) / p
    front, back = h, n - 1 - h
    fl = min(front + p, back)
    a, b = np.polyfit(np.arange(front, fl), t[front:fl], 1)
    t[:front] = a * np.arange(front) + b
    bf = max(front, back - p)
    a, b = np.polyfit(np.arange(bf, back), t[bf:back], 1)
    t[back + 1:] = a * np.arange(back + 1, n) + b
    det = y - t
    pa = np.array([det[i::p].mean() for i in range(p)])
    pa -= pa.mean()
    s = np.tile(pa, n // p + 1)[:n]
    return t, s, y - t - s


def test_seasonal_decompose_matches_numpy(spark):
    n = 120
    i = np.arange(n)
    y = 10 + 0.3 * i + 5 * np.sin(2 * np.pi * i / 12) + np.random.default_rng(2).normal(scale=0.1, size=n)
    df = spark.createDataFrame([(int(k), float(v)) for k, v in zip(i, y)], "k int, y double")
    d = seasonal.seasonal_decompose(df, "y", ["k"]).toPandas().sort_values("idx")
    t, s, r = _decompose_numpy(y)
    np.testing.assert_allclose(d["trend"], t, atol=1e-9)
    np.testing.assert_allclose(d["seasonal"], s, atol=1e-9)
    summ = seasonal.seasonal_summary(df, "y", ["k"]).first()
    assert summ["seasonal_label"] == "Strong" and summ["trend_clarity"] == "Clear"
    assert summ["resid_skew"] == pytest.approx(pd.Series(r).skew(), abs=1e-9)


def test_change_points_level_shift(spark):
    v = [0.0] * 60 + [10.0] * 60
    v[30] = 50.0
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, v double")
    cp = changepoint.change_points(df, "v", ["i"]).toPandas()
    s = pd.Series(v)
    w = len(v) // 10
    z = ((s - s.rolling(w, center=True).mean()) / s.rolling(w, center=True).std()).abs()
    assert sorted(cp["idx"]) == list(np.where(z > 2)[0])


def _adf_numpy(x):
    n = len(x)
    maxlag = min(n // 2 - 2, int(math.ceil(12 * (n / 100) ** 0.25)))
    dx = np.diff(x)

    def design(lag):
        nobs = len(dx) - lag
        cols = [np.ones(nobs), x[lag:n - 1]] + [dx[lag - j:len(dx) - j] for j in range(1, lag + 1)]
        return np.column_stack(cols), dx[lag:]

    best, best_aic = 0, None
    Xm, ym = design(maxlag)
    for lag in range(maxlag + 1):
        X = Xm[:, :lag + 2]
        beta, *_ = np.linalg.lstsq(X, ym, rcond=None)
        ssr = ((ym - X @ beta) ** 2).sum()
        nobs = len(ym)
        aic = -2 * (-nobs / 2 * (np.log(2 * np.pi) + np.log(ssr / nobs) + 1)) + 2 * (lag + 2)
        if best_aic is None or aic < best_aic:
            best, best_aic = lag, aic
    X, y = design(best)
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    resid = y - X @ beta
    s2 = resid @ resid / (len(y) - X.shape[1])
    cov = s2 * np.linalg.inv(X.T @ X)
    return best, beta[1] / np.sqrt(cov[1, 1])


@pytest.mark.parametrize("kind", ["random_walk", "white_noise"])
def test_adf_matches_numpy(spark, kind):
    rng = np.random.default_rng(11)
    e = rng.normal(size=400)
    x = np.cumsum(e) if kind == "random_walk" else e
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, v double")
    r = stationarity.adf_test(df, "v", ["i"]).first()
    lag, tau = _adf_numpy(x)
    assert r["used_lag"] == lag
    assert r["adf_stat"] == pytest.approx(tau, abs=1e-8)
    assert r["stationary"] == ("No" if kind == "random_walk" else "Yes")


# ---------------------------------------------------------------- correlation / distribution / pca

def test_corr_edge_cases(spark):
    rows = [(1.0, 2.0, None), (2.0, 4.0, 1.0), (3.0, 6.0, 2.0), (4.0, 8.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    t = {(r["var1"], r["var2"]): r for r in correlation.corr_test(df).collect()}
    assert t[("a", "b")]["corr"] == pytest.approx(1.0) and t[("a", "b")]["ci_high"] == pytest.approx(1.0)
    assert t[("a", "c")]["n"] == 2 and t[("a", "c")]["corr"] is None and t[("a", "c")]["p_value"] is None
    assert t[("a", "a")]["corr"] == 1.0 and t[("a", "a")]["p_value"] is None


def test_corr_pvalue_matches_t(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=60)
    y = 0.3 * x + rng.normal(size=60)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    r = [row for row in correlation.corr_test(df).collect() if row["var1"] == "x" and row["var2"] == "y"][0]
    rr = np.corrcoef(x, y)[0, 1]
    t = rr * math.sqrt(58 / (1 - rr * rr))
    assert r["corr"] == pytest.approx(rr, abs=1e-12)
    assert r["p_value"] == pytest.approx(dist.t_sf2(t, 58), abs=1e-12)
    lo = math.tanh(math.atanh(rr) - 1.959963984540054 / math.sqrt(57))
    assert r["ci_low"] == pytest.approx(lo, abs=1e-12)


def test_histogram_matches_numpy_auto(spark):
    rng = np.random.default_rng(9)
    for vals in (rng.normal(size=5000), rng.exponential(size=200), rng.normal(size=50)):
        df = spark.createDataFrame([(float(v),) for v in vals], "v double")
        h = distribution.histogram(df, "v").orderBy("bin").toPandas()
        counts, edges = np.histogram(vals, bins="auto")
        assert len(h) == len(counts)
        assert list(h["count"]) == list(counts)


def test_kde_matches_direct_sum(spark):
    rng = np.random.default_rng(4)
    vals = rng.normal(size=300)
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    k = distribution.kde_curve(df, "v").orderBy("point").toPandas()
    h = vals.std(ddof=1) * len(vals) ** (-0.2)
    grid = np.linspace(vals.min(), vals.max(), 200)
    dens = np.exp(-0.5 * ((grid[:, None] - vals[None, :]) / h) ** 2).sum(axis=1) / (len(vals) * h * np.sqrt(2 * np.pi))
    np.testing.assert_allclose(k["density"], dens, rtol=1e-10)


def test_mean_ci_and_box(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    m = distribution.mean_ci(df, "v").first()
    se = np.std(vals, ddof=1) / math.sqrt(5)
    assert m["ci_upper"] == pytest.approx(np.mean(vals) + dist.t_ppf(0.975, 4) * se, abs=1e-10)
    b = distribution.box_stats(df, "v").first()
    assert (b["q1"], b["median"], b["q3"]) == (2.0, 3.0, 4.0)
    assert b["whisker_high"] == 4.0 and b["n_fliers"] == 1
    one = distribution.mean_ci(spark.createDataFrame([(7.0,)], "v double"), "v").first()
    assert one["ci_lower"] == one["ci_upper"] == 7.0


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 3))
    x[:, 1] = x[:, 0] * 2 + 0.1 * x[:, 1]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    v = pca.pca_variance(df).orderBy("component").toPandas()
    z = (x - x.mean(0)) / x.std(0)
    ev = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    np.testing.assert_allclose(v["explained_variance_ratio"], ev / ev.sum(), atol=1e-10)
    assert pca.pca_n95(df).first()["n_components"] == int(np.argmax(np.cumsum(ev / ev.sum()) >= 0.95) + 1)
    sc = pca.pca_scores(df).toPandas()
    np.testing.assert_allclose(np.var(sc["pc1"]) / 1.0, ev[0] * 499 / 500, rtol=1e-8)


def test_adf_level_constant_groups_and_blocks(spark, monkeypatch):
    """The statistic is that of any level and block size; no variance gives NULL; NULL keys are groups."""
    from statlens.operators import stationarity as S

    rng = np.random.default_rng(12)
    walk = np.cumsum(rng.normal(size=400))
    rows = [("a", i, float(walk[i])) for i in range(400)] + [(None, i, float(walk[i]) + 1e8) for i in range(400)]
    rows += [("m", i, float(walk[i]) + 1e6) for i in range(400)] + [("c", i, 5.0) for i in range(30)] + [("s", i, float(i)) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    alone = S.adf_test(df.where("k = 'a'").drop("k"), "v", ["i"]).first()
    monkeypatch.setattr(S, "BLOCK", 37)
    got = {r["k"]: r for r in S.adf_test(df, "v", ["i"], by=["k"]).collect()}
    for k in ("a", "m", None):
        assert got[k]["adf_stat"] == pytest.approx(alone["adf_stat"], abs=1e-8 if k != None else 1e-5)  # noqa: E711
        assert got[k]["used_lag"] == alone["used_lag"] and got[k]["n_obs"] == alone["n_obs"]
    assert got["c"]["adf_stat"] is None and got["c"]["n"] == 30 and got["s"]["adf_stat"] is None


def test_index_of_nan_null_and_tied_keys(spark):
    """NULL sorts first and NaN last, and ties are ordered alike, at any number of partitions."""
    rng = np.random.default_rng(4)
    keys = [None] * 7 + [float("nan")] * 9 + [float(x) for x in rng.integers(0, 12, 150)]
    rows = [(k, f"r{i}") for i, k in enumerate(keys)]
    seen = []
    for parts in (1, 7, 64):
        df = spark.createDataFrame(rows, "k double, name string").repartition(3)
        got = dense_index(df, ["k"], partitions=parts, size="n").orderBy("idx").collect()
        assert [r["idx"] for r in got] == list(range(len(rows))) and {r["n"] for r in got} == {len(rows)}
        order = [r["k"] for r in got]
        assert order[:7] == [None] * 7 and all(np.isnan(x) for x in order[-9:]) and order[7:-9] == sorted(order[7:-9])
        seen.append([r["name"] for r in got])
    assert seen[0] == seen[1] == seen[2]


def test_null_keys_are_groups(spark):
    rows = [(None if i % 3 == 0 else "ab"[i % 2], i, float(i % 17)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    from statlens.operators import changepoint, distribution, outliers, rolling, trend
    assert rolling.row_index(df, ["i"], ["g"]).count() == 300
    assert rolling.rolling(df, "v", ["i"], ["g"]).count() == 300
    assert trend.trend_band(df, "v", ["i"], ["g"]).count() == 300
    for r in (outliers.outlier_report(df, ["v"], ["g"]), distribution.box_stats(df, "v", ["g"]), distribution.mean_ci(df, "v", by=["g"]),
              changepoint.change_point_count(df, "v", ["i"], ["g"]), distribution.histogram(df, "v", ["g"]).select("g").distinct(),
              distribution.kde_curve(df, "v", by=["g"]).select("g").distinct()):
        assert sorted(str(x["g"]) for x in r.collect()) == ["None", "a", "b"]
    short = changepoint.change_points(df.limit(5), "v", ["i"])
    assert short.count() == 0 and short.columns == changepoint.change_points(df, "v", ["i"]).columns


def test_correlation_of_many_columns(spark):
    from statlens.operators import correlation

    rng = np.random.default_rng(9)
    a = rng.normal(size=(300, 60)) + 1e6
    a[:, 1] = a[:, 0] * 2
    a[:, 2] = 5.0
    a[rng.random(a.shape) < 0.1] = np.nan
    names = [f"c{j}" for j in range(60)]
    df = spark.createDataFrame(pd.DataFrame(a, columns=names))
    got = {(r["var1"], r["var2"]): r for r in correlation.corr_matrix(df, names).collect()}
    assert len(got) == 3600
    want = pd.DataFrame(a, columns=names).corr()
    for i, j in [(0, 1), (3, 40), (59, 7), (1, 0)]:
        assert got[names[i], names[j]]["corr"] == pytest.approx(want.iloc[i, j], abs=1e-9)
        assert got[names[i], names[j]]["n"] == int((~np.isnan(a[:, i]) & ~np.isnan(a[:, j])).sum())
    assert got["c2", "c5"]["corr"] is None and got["c4", "c4"]["corr"] == 1.0


def test_histogram_of_an_extreme_value_says_so(spark):
    from statlens.operators import distribution

    df = spark.createDataFrame([(float(x),) for x in np.random.default_rng(0).random(2000)] + [(1e12,)], "v double")
    with pytest.raises(Exception, match="raise max_bins"):
        distribution.histogram(df, "v").collect()


def test_t_quantiles_of_many_groups(spark):
    from statlens.operators import distribution

    df = spark.range(100_000).selectExpr("id % 40000 AS g", "cast(id AS double) AS v")
    got = distribution.mean_ci(df, "v", by=["g"])
    assert got.count() == 40_000 and got.where("ci_lower > ci_upper").count() == 0


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_wide_fences_against_numpy(spark, limit):
    """Quartiles, fences and counts of many columns: few and many rows, ties, gaps, extremes, NULL keys."""
    rng = np.random.default_rng(5)
    frames = []
    for g, n in (("a", 1), ("b", 2), ("c", 6), ("d", 399), ("e", 2_003), (None, 30_001)):
        x = pd.DataFrame({"g": [g] * n, "normal": rng.normal(size=n), "ties": rng.integers(0, 4, n).astype(float), "flat": 7.0,
                          "heavy": rng.standard_cauchy(n), "gaps": np.where(rng.random(n) < 0.4, np.nan, rng.exponential(size=n)),
                          "none": np.nan, "whole": rng.integers(-50, 50, n) ** 3})
        x.loc[0, "normal"] = 1e12
        frames.append(x)
    pdf = pd.concat(frames, ignore_index=True)
    df = spark.createDataFrame(pdf).withColumn("g", F.when(F.col("g") != "NaN", F.col("g")))
    cols = [c for c in pdf.columns if c != "g"]
    for by in ([], ["g"]):
        got = {(r["g"] if by else 0, r["c"]): r for r in fence_table(df, [(c, as_double(c)) for c in cols], by, "c", limit=limit).collect()}
        groups = [(0, pdf)] if not by else [(None if isinstance(k, float) else k, p) for k, p in pdf.groupby("g", dropna=False)]
        assert len(got) == len(groups) * len(cols)
        for key, part in groups:
            for c in cols:
                r, x = got[key, c], part[c].dropna().to_numpy(float)
                assert (r["n"], r["n_rows"]) == (len(x), len(part))
                if not len(x):
                    assert (r["q1"], r["z_outliers"], r["iqr_outliers"]) == (None, 0, 0)
                    continue
                q1, q3 = np.quantile(x, [0.25, 0.75])
                assert math.isclose(r["q1"], q1, rel_tol=1e-12, abs_tol=1e-12) and math.isclose(r["q3"], q3, rel_tol=1e-12, abs_tol=1e-12), (key, c)
                low, high = r["lower"], r["upper"]
                assert r["iqr_outliers"] == ((x < low) | (x > high)).sum(), (key, c)
                sd = x.std()
                assert r["z_outliers"] == (0 if sd == 0 else (abs((x - x.mean()) / sd) > 3).sum()), (key, c)


def test_lagged_products_by_fft():
    """Against a sum for each lag, next to values up to 1e12 and with ends that have no partner."""
    rng = np.random.default_rng(8)
    for n, most, extreme in ((1, 3, 1.0), (5, 9, 1.0), (4000, 700, 1.0), (4000, 700, 1e6), (4000, 50, 1e9), (4000, 50, 1e12)):
        u, v = rng.normal(size=n), rng.normal(size=n)
        u[n // 2] *= extreme
        v[n // 3] *= extreme
        got = stationarity.lagged_products(u, v, most)
        want = np.array([u[h:] @ v[:n - h] if h < n else 0.0 for h in range(most + 1)])
        scale = np.array([np.abs(u[h:]) @ np.abs(v[:n - h]) if h < n else 1.0 for h in range(most + 1)])
        assert (np.abs(got - want) <= 1e-12 * scale).all(), (n, most, extreme)


@pytest.mark.parametrize("level", [0.0, 1e6, 1e9])
def test_adf_many_lags_in_blocks(spark, monkeypatch, level):
    """All lags of a longer series, in blocks, against least squares at any level."""
    rng = np.random.default_rng(13)
    x = np.cumsum(rng.normal(size=3000)) * 0.1 + rng.normal(size=3000)
    monkeypatch.setattr(stationarity, "BLOCK", 256)
    df = spark.createDataFrame([(i, float(v) + level) for i, v in enumerate(x)], "i int, v double")
    r = stationarity.adf_test(df, "v", ["i"]).first()
    lag, tau = _adf_numpy(x + level - (x + level).mean())
    assert (r["max_lag"], r["used_lag"]) == (29, lag) and r["adf_stat"] == pytest.approx(tau, abs=1e-8)


def test_correlations_in_tiles(spark, monkeypatch):
    """Many columns in tiles and several scans against pandas, with gaps, groups and a NULL group."""
    rng = np.random.default_rng(21)
    monkeypatch.setattr(correlation, "SIDE", 16)
    monkeypatch.setattr(correlation, "TILES", 4)  # squares of 2 x 2 tiles: 10 scans
    x = rng.normal(size=(300, 100)) @ rng.normal(size=(100, 100)) + 1e6
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 7] = 3.0
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(100)])
    pdf["g"] = ["a", "b", None] * 100
    df = spark.createDataFrame(pdf).withColumn("g", F.when(F.col("g") != "NaN", F.col("g")))
    assert len(correlation._tile_groups(100)) == 10
    for by, groups in (([], {0: pdf}), (["g"], {None if isinstance(k, float) else k: p for k, p in pdf.groupby("g", dropna=False)})):
        got = correlation.corr_matrix(df, [f"c{i}" for i in range(100)], by).toPandas()
        assert len(got) == 10_000 * len(groups)
        for key, part in groups.items():
            r = got if not by else got[got["g"].isna()] if key is None else got[got["g"] == key]
            m = r.pivot(index="var1", columns="var2", values="corr")
            want = part.drop(columns="g").corr()
            np.fill_diagonal(want.values, 1.0)
            want = want.loc[m.index, m.columns]
            assert (m.isna() == want.isna()).all().all()
            assert np.nanmax(np.abs(m.to_numpy(float) - want.to_numpy())) < 1e-9
            n = r.pivot(index="var1", columns="var2", values="n")
            there = part[list(n.index)].notna().to_numpy(float)
            assert (n.to_numpy() == there.T @ there).all()


@pytest.mark.parametrize("basis", [160, 20])  # 20: the iteration starts again from its best vectors
def test_pca_of_many_columns(spark, monkeypatch, basis):
    """Leading components from products with few vectors against the decomposed matrix, and against Spark ML's PCA."""
    from pyspark.ml.feature import PCA, VectorAssembler

    rng = np.random.default_rng(31)
    x = rng.normal(size=(400, 6)) @ rng.normal(size=(6, 120)) + 2.0 * rng.normal(size=(400, 120)) + 1e4
    x[:, 11] = 5.0
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i:03}" for i in range(120)]))
    with_gap = df.withColumn("c005", F.when(F.col("c000") < 1e9, F.col("c005"))).unionByName(df.limit(3).withColumn("c001", F.lit(None).cast("double")))
    monkeypatch.setattr(pca, "SMALL", 10)
    monkeypatch.setattr(pca, "BASIS", basis)
    ml = PCA(k=5, inputCol="v", outputCol="p").fit(VectorAssembler(inputCols=df.columns, outputCol="v").transform(pca.standardize(df)))
    got = pca.pca_variance(with_gap).toPandas()
    np.testing.assert_allclose(got["explained_variance_ratio"], ml.explainedVariance.toArray(), atol=1e-9)
    values, vectors = pca._Correlations(with_gap, df.columns).components(5)
    want = ml.pc.toArray()
    np.testing.assert_allclose(np.abs((vectors * want).sum(axis=0)), 1.0, atol=1e-9)
    np.testing.assert_allclose(np.abs(vectors), np.abs(want), atol=1e-6)
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1.0)
    full = np.sort(np.linalg.eigvalsh(z.T @ z))[::-1]
    assert pca.pca_n95(with_gap).first()["n_components"] == int(np.argmax(np.cumsum(full / full.sum()) >= 0.95) + 1)
    scores = pca.pca_scores(df, components=2).toPandas().to_numpy()
    np.testing.assert_allclose(np.sort(np.abs(scores), axis=0), np.sort(np.abs(z @ want[:, :2]), axis=0), atol=1e-5)


def test_profile_states_of_halves_merge_to_the_whole(spark, tmp_path):
    """Exact parts equal those of the whole table; estimates stay within the sketches' errors."""
    rng = np.random.default_rng(41)
    n = 40_000
    pdf = pd.DataFrame({"part": rng.integers(0, 7, n), "age": rng.normal(1e9, 1.0, n), "price": np.where(rng.random(n) < 0.3, np.nan, rng.exponential(size=n)),
                        "kind": rng.choice(["a", "b", "c"], n), "name": [f"n{v}" for v in rng.integers(0, 15_000, n)], "none": None})
    pdf["kind"] = pdf["kind"].where(rng.random(n) < 0.9, None)
    df = spark.createDataFrame(pdf, "part long, age double, price double, kind string, name string, none string")
    df = df.unionByName(df.where("part = 3"))  # repeated rows
    path = str(tmp_path / "states")
    states_ = states.profile_state(df.drop("part"))
    for part in range(7):
        states.append_state(df.where(F.col("part") == part), path, ["part"])
    stored = states.load_states(spark, path)
    whole, merged = (states.state_info(s).toPandas().sort_values("position") for s in (states_, stored))
    for c in ("column_name", "n_rows", "non_null", "nulls", "least", "most"):
        assert whole[c].fillna(-1).tolist() == merged[c].fillna(-1).tolist()
    all_rows = pd.concat([pdf, pdf[pdf["part"] == 3]])
    got = merged.set_index("column_name")
    for c in ("age", "price"):
        assert got.loc[c, "mean"] == pytest.approx(all_rows[c].mean(), rel=1e-14)
        assert got.loc[c, "std"] == pytest.approx(all_rows[c].std(), rel=1e-7)
    info = profile.column_info(df.drop("part")).toPandas().set_index("column_name")
    assert (info["nulls"] == got["nulls"]).all()
    assert states.state_missing(stored).collect() == profile.missing_summary(df.drop("part")).collect()
    exact = profile.table_profile(df.drop("part")).first()
    est = states.state_profile(stored).first()
    assert all(est[c] == pytest.approx(exact[c]) for c in ("n_rows", "n_columns", "n_numerical", "n_categorical", "size_mb", "total_missing", "completeness_pct"))
    rows = exact["n_rows"]
    assert abs(est["approx_duplicates"] - exact["duplicates"]) <= 4 * 0.0163 * rows
    d = {r["column_name"]: r["approx_distinct"] for r in states.state_distinct(stored).collect()}
    real = {r["column_name"]: r["n_distinct"] for r in quality.distinct_counts(df.drop("part")).collect()}
    assert d["kind"] == 3 and d["none"] == 0 and abs(d["name"] - real["name"]) <= 4 * 0.0163 * real["name"]
    for r in states.state_quantiles(stored).collect():
        x = np.sort(all_rows[r["column_name"]].dropna())
        assert abs(np.searchsorted(x, r["approx_quantile"]) / len(x) - r["p"]) < 0.0133 * 1.5
    q1, q2 = states.state_quality(stored).first(), quality.quality_summary(df.drop("part")).first()
    assert q1["completeness"] == pytest.approx(q2["completeness"]) and q1["validity"] == q2["validity"] and q1["approx_consistency"] == q2["consistency"]
    assert q1["approx_uniqueness"] == pytest.approx(q2["uniqueness"], abs=6.5)
    by_part = {r["part"]: r["n_rows"] for r in states.state_info(stored, ["part"]).where("column_name = 'age'").collect()}
    assert by_part == (all_rows["part"].value_counts()).to_dict()


def test_histogram_runs(spark):
    """The bins of the full list where that exists; any spread; a range of bins by demand."""
    rng = np.random.default_rng(51)
    pdf = pd.DataFrame({"g": ["a"] * 3000 + [None] * 500, "v": np.concatenate([rng.normal(size=2990), [30.0] * 9, [41.5], rng.exponential(size=500)])})
    df = spark.createDataFrame(pdf, "g string, v double")
    full = distribution.histogram(df, "v", ["g"]).toPandas()
    runs = distribution.histogram_runs(df, "v", ["g"])
    got = distribution.expand_runs(runs, 0, 10**6).toPandas()
    assert len(got) == len(full) and (full["count"] == 0).sum() > 20
    a, b = (x.sort_values(["g", "bin"], na_position="first").reset_index(drop=True) for x in (got, full))
    assert (a["count"] == b["count"]).all() and np.allclose(a[["lower", "upper"]], b[["lower", "upper"]], atol=1e-9)
    rows = runs.toPandas()
    empty = rows[rows["count"] == 0]
    assert len(empty) < 20 and (rows[rows["count"] > 0]["first_bin"] == rows[rows["count"] > 0]["last_bin"]).all()
    wide = spark.createDataFrame([(float(v),) for v in rng.random(20_000)] + [(1e12,)], "v double")
    r = distribution.histogram_runs(wide, "v").toPandas().sort_values("first_bin")
    assert r["count"].sum() == 20_001 and r["upper"].iloc[-1] == pytest.approx(1e12) and r["last_bin"].iloc[-1] > 10**12
    assert (r["first_bin"].iloc[1:].to_numpy() == r["last_bin"].iloc[:-1].to_numpy() + 1).all()
    assert distribution.expand_runs(distribution.histogram_runs(wide, "v"), 10**11, 10**11 + 4).toPandas()["count"].tolist() == [0] * 5
    assert distribution.histogram_runs(wide.limit(0), "v").count() == 0
    assert distribution.histogram_runs(wide.limit(3).select(F.lit(2.0).alias("v")), "v").first()["count"] == 3


def test_written_tables_are_released(spark):
    from statlens import session

    session.release(spark)
    before = session.checkpoint_dir(spark)
    got = rolling.rolling(spark.range(40).selectExpr("id", "id * 1.5D AS v"), "v", ["id"]).count()
    assert got == 40 and session.release(spark) >= 1 and session.release(spark) == 0
    assert session.checkpoint_dir(spark) == before


GROUPED = [lambda d, by: profile.shape(d, by), lambda d, by: profile.column_info(d, by), lambda d, by: profile.missing_summary(d, by),
           lambda d, by: profile.missing_topk(d, 1, by), lambda d, by: profile.completeness(d, by), lambda d, by: profile.missing_pattern(d, by=by),
           lambda d, by: profile.duplicate_count(d, by), lambda d, by: profile.logical_size(d, by), lambda d, by: profile.table_profile(d, by),
           lambda d, by: quality.uniqueness(d, by), lambda d, by: quality.distinct_counts(d, by=by), lambda d, by: quality.consistency_score(d, by=by),
           lambda d, by: quality.validity_score(d, by=by), lambda d, by: quality.quality_summary(d, by=by),
           lambda d, by: evaluation.confusion_matrix(d, "label", "guess", by), lambda d, by: evaluation.class_report(d, "label", "guess", by),
           lambda d, by: evaluation.roc_curve(d, "label", "price", by), lambda d, by: evaluation.roc_auc(d, "label", "price", by),
           lambda d, by: evaluation.regression_metrics(d, "label", "price", by)]


@pytest.mark.parametrize("report", range(len(GROUPED)))
def test_reports_by_group_equal_those_of_each_group(spark, report):
    rng = np.random.default_rng(61)
    rows = [(g, int(rng.integers(0, 2)), int(rng.integers(0, 2)), [None, -1.5, 2.0, 3.0][rng.integers(0, 4)], [None, "x", "y"][rng.integers(0, 3)], f"n{rng.integers(0, 40)}")
            for g in ["a"] * 60 + ["b"] * 25 + [None] * 15]
    df = spark.createDataFrame(rows, "g string, label int, guess int, price double, kind string, name string")
    got = GROUPED[report](df, ["g"])
    columns = [c for c in got.columns if c != "g"]
    for g in ("a", "b", None):
        own = df.where(F.col("g").eqNullSafe(F.lit(g))).drop("g")
        want = GROUPED[report](own, [])
        assert sorted(want.columns) == sorted(columns)
        there = got.where(F.col("g").eqNullSafe(F.lit(g))).select(*want.columns)
        assert sorted(map(str, there.collect())) == sorted(map(str, want.collect())), g


def test_t_tails_of_many_numbers():
    """The same as one by one, from the centre to where they vanish."""
    rng = np.random.default_rng(71)
    t = np.concatenate([rng.normal(size=400), 10.0 ** rng.uniform(-8, 4, 400), [0.0, -2.5, np.inf, np.nan, 1.0, 1.0]])
    nu = np.concatenate([rng.integers(1, 50, 400).astype(float), 10.0 ** rng.uniform(0, 7, 400), [5.0, 5.0, 5.0, 5.0, 0.0, np.nan]])
    got = dist.t_sf2_many(t, nu)
    for a, b, p in zip(t, nu, got):
        want = float("nan") if math.isnan(a) or math.isnan(b) or b <= 0 else dist.t_sf2(float(a), float(b))
        assert (math.isnan(p) and math.isnan(want)) or math.isclose(p, want, rel_tol=1e-10, abs_tol=1e-15), (a, b, p, want)
