"""Dickey-Fuller tests.

``df_test``: the lag-0 regression  dy_t = a + g * y_{t-1}: one regression
aggregate per group, tau = g / se(g).

``adf_test``: augmented regression with constant and lag chosen by AIC, as
in the usual implementation: max lag ceil(12 (n/100)^(1/4)) (at most
n//2 - 2), every lag fitted on the common sample, best lag refitted on its
larger sample; tau = t of the y_{t-1} term, p-value after MacKinnon (1994).
The sums of lagged products come from blocks of consecutive rows (with the rows before
them): all lags of a block at once, as a correlation by FFT, so a series of n rows costs
n log n whatever the number of lags.  X'X follows from these and the series' first
and last values, so a group is solved from a few thousand numbers whatever its
length.  All nested lag models share one Cholesky factor.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statlens.functions.columns import as_double, as_list, join_on, q
from statlens.functions.dist import adf_pvalue
from statlens.functions.udfs import adf_p
from statlens.plans.ordered import BLOCK, dense_index, framed


def _series(df, value, order_by, by):
    by, order_by = as_list(by), as_list(order_by)
    keep = list(dict.fromkeys(by + order_by))
    base = (df.select(*[q(c) for c in keep], as_double(value).alias("y"))
            .where(F.col("y").isNotNull()))
    return base, by, order_by


def df_test(df: DataFrame, value: str, order_by: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Dickey-Fuller without lags: (n, gamma, se, tau, p_value) per group."""
    base, by, order_by = _series(df, value, order_by, by)
    y = F.col("y")
    fr = framed(base, order_by, by, lo=1, hi=0,
                aggs=lambda w: {"_c": F.count(y).over(w), "_prev": F.first(y).over(w)})
    pairs = fr.where(F.col("_c") == 2).select(*by, (y - F.col("_prev")).alias("dy"), F.col("_prev"))
    dy, x = F.col("dy"), F.col("_prev")
    agg = pairs.groupBy(*[q(b) for b in by]).agg(
        F.regr_count(dy, x).alias("n"), F.regr_slope(dy, x).alias("gamma"),
        F.regr_sxx(dy, x).alias("_sxx"), F.regr_syy(dy, x).alias("_syy"), F.regr_r2(dy, x).alias("_r2"))
    sse = F.col("_syy") * (1 - F.col("_r2"))
    se = F.sqrt(F.try_divide(F.try_divide(sse, (F.col("n") - 2).cast("double")), F.col("_sxx")))
    tau = F.try_divide(F.col("gamma"), se)
    return agg.select(*[q(b) for b in by], "n", "gamma", se.alias("se"), tau.alias("tau"))


def df_test_pvalue(df: DataFrame, value: str, order_by: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    t = df_test(df, value, order_by, by)
    return t.withColumn("p_value", adf_p(F.col("tau")))


#: A difference this many times the usual one is summed by itself: beside it, rounding in an FFT would hide the others.
EXTREME = 1e3


def lagged_products(u: np.ndarray, v: np.ndarray, most: int) -> np.ndarray:
    """Sums over t of u[t] * v[t - h] for h = 0 .. ``most``.

    By FFT over the ordinary values; products with an extreme one directly."""
    def split(x):
        usual = np.median(np.abs(x[x != 0])) if x.any() else 0.0
        far = np.flatnonzero(np.abs(x) > EXTREME * usual)
        near = x.copy()
        near[far] = 0.0
        return near, far

    (a, far_u), (b, far_v) = split(u), split(v)
    size = 1 << (len(u) + most).bit_length()
    out = np.fft.irfft(np.fft.rfft(a, size) * np.conj(np.fft.rfft(b, size)), size)[:most + 1]
    for t in far_u:  # with all of v
        h = min(most, t)
        out[:h + 1] += u[t] * v[t - h:t + 1][::-1]
    for t in far_v:  # with the ordinary values of u
        w = a[t:t + most + 1]
        out[:len(w)] += w * v[t]
    return out


def _lag_sums(keys: list[str], most: int):
    """Per task and group, from blocks with the rows before them: for each lag h
    the sums of d_t * d_(t-h) and y_(t-1) * d_(t-h), and of y_(t-1) and its square."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, np.ndarray] = {}
        held: list[pd.DataFrame] = []

        def add(g: pd.DataFrame) -> None:
            y = g["_y"].to_numpy(dtype=float)
            first = max(int(np.argmax(g["_own"].to_numpy())), 1)  # the first own row with a row before it
            d, before = np.diff(y, prepend=y[0]), np.zeros(len(y))
            before[first:] = y[first - 1:-1]
            own = np.where(np.arange(len(y)) >= first, d, 0.0)
            part = np.zeros((2, most + 2))
            part[0, :-1], part[1, :-1] = lagged_products(own, d, most), lagged_products(before, d, most)
            part[:, -1] = before.sum(), before @ before
            key = tuple(None if pd.isna(x) else x for x in g[keys].iloc[0]) if keys else ()
            total[key] = total.get(key, 0.0) + part

        for pdf in batches:
            if len(pdf) == 0:
                continue
            held.append(pdf)
            if pdf["_run"].iloc[0] != pdf["_run"].iloc[-1] or held[0]["_run"].iloc[0] != pdf["_run"].iloc[0]:
                rows = pd.concat(held)
                runs = rows["_run"].to_numpy()
                cuts = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])
                for i, j in zip(cuts, cuts[1:]):
                    add(rows.iloc[i:j])
                held = [rows.iloc[cuts[-1]:]]
        if held:
            add(pd.concat(held))
        out = [(*k, h, float(p[0, h]), float(p[1, h])) for k, p in total.items() for h in range(most + 2)]
        yield pd.DataFrame(out, columns=[*keys, "pos", "a", "x"])

    return run


def _gram(y0: np.ndarray, yn: np.ndarray, n: int, a: np.ndarray, x: np.ndarray, s1: float, s2: float, lags: int, start: int) -> np.ndarray:
    """X'X of [1, y_(t-1), d_(t-1) .. d_(t-lags), d_t] over t >= start, from lag
    sums over all t and the series' first and last values."""
    head = np.diff(y0, prepend=y0[0])  # d_0 .. ; d_0 is no difference
    tail = np.diff(yn)  # the last differences
    order = [*range(1, lags + 1), 0]

    def d_at(s):  # d_s near either end
        return head[s] if s < len(head) else tail[len(tail) - (n - s)]

    k = lags + 3
    g = np.zeros((k, k))
    m = n - start
    early = y0[: start - 1]  # y_(t-1) of the rows left out
    g[0, 0], g[0, 1], g[1, 1] = m, s1 - early.sum(), s2 - early @ early
    for p, i in enumerate(order, 2):
        g[0, p] = yn[len(yn) - 1 - i] - y0[start - i - 1]
        t = np.arange(i + 1, start)
        g[1, p] = x[i] - (y0[t - 1] @ head[t - i] if len(t) else 0.0)
    for p, i in enumerate(order, 2):
        for r, j in enumerate(order[p - 2:], p):
            lo, h = min(i, j), abs(i - j)
            s = np.arange(h + 1, start - lo)
            cut = head[s] @ head[s - h] if len(s) else 0.0
            for late in range(n - lo, n):
                cut += d_at(late) * d_at(late - h)
            g[p, r] = a[h] - cut
    return g + np.triu(g, 1).T


def _solve(n: int, wanted: int, autolag: bool, y0, yn, a, x, s1, s2):
    """(used_lag, n_obs, tau) or None for a series without variance."""
    used = wanted
    if autolag and wanted > 0:
        g = _gram(y0, yn, n, a, x, s1, s2, wanted, wanted + 1)
        low = np.linalg.cholesky(g[:-1, :-1])  # the models are nested: one factor serves all lags
        w = np.linalg.solve(low, g[:-1, -1])
        ssr = g[-1, -1] - np.cumsum(w * w)[1:]
        m = n - wanted - 1
        aic = m * np.log(np.maximum(ssr, 1e-300) / m) + 2.0 * np.arange(2, wanted + 3)
        used = int(np.argmin(aic))
    g = _gram(y0, yn, n, a, x, s1, s2, used, used + 1)
    p, m = used + 2, n - used - 1
    inv = np.linalg.inv(np.linalg.cholesky(g[:p, :p]))
    inv = inv.T @ inv
    beta = inv @ g[:p, -1]
    ssr = g[-1, -1] - beta @ g[:p, -1]
    if m <= p or ssr <= 1e-14 * g[-1, -1]:
        return None
    return used, m, float(beta[1] / math.sqrt(ssr / (m - p) * inv[1, 1]))


def adf_test(df: DataFrame, value: str, order_by: Sequence[str], by: Sequence[str] = (), max_lag: int | None = None,
             autolag: bool = True) -> DataFrame:
    """One row (per group): n, max_lag, used_lag, n_obs, adf_stat, p_value, stationary.

    NULL statistic for fewer than 4 values or a series without variance.  The
    series is centred first, so its level doesn't matter.
    """
    base, by, order_by = _series(df, value, order_by, by)
    keys = [q(b) for b in by]
    ix = dense_index(base, order_by, by, size="_n")
    lags = F.ceil(12.0 * F.pow(F.col("_n") / 100.0, 0.25)) if max_lag is None else F.lit(max_lag)
    ix = ix.withColumn("_lags", F.greatest(F.lit(0), F.least(F.floor(F.col("_n") / 2) - 2, lags)).cast("int"))
    ix = join_on(ix, ix.groupBy(*keys).agg(F.avg("y").alias("_mu")), by).select(*keys, "idx", "_n", "_lags", (F.col("y") - F.col("_mu")).alias("_y"))
    most = ix.agg(F.max("_lags")).first()[0] or 0
    size = max(BLOCK, 4 * (most + 2))
    own = F.floor(F.col("idx") / size).cast("long")
    sent = ix.select("*", F.explode(F.array_compact(F.array(own, F.when(F.pmod("idx", F.lit(size)) >= size - most - 2, own + 1)))).alias("_blk"))
    sent = sent.withColumn("_own", F.col("_blk") == own).withColumn("_run", F.xxhash64(*keys, "_blk"))
    sums = (sent.repartition(*keys, "_blk").sortWithinPartitions(*keys, "_blk", "idx").select(*keys, "idx", "_y", "_own", "_run")
            .mapInPandas(_lag_sums(by, most), T.StructType([ix.schema[b] for b in by] + [
                T.StructField("pos", T.IntegerType()), T.StructField("a", T.DoubleType()), T.StructField("x", T.DoubleType())]))
            .groupBy(*keys, "pos").agg(F.sum("a").alias("a"), F.sum("x").alias("x")))
    near = ix.where((F.col("idx") <= most + 1) | (F.col("idx") >= F.col("_n") - most - 2))
    ends = near.select(*keys, F.lit(1).alias("kind"), "idx", "_n", "_lags", F.col("_y").alias("a"), F.lit(0.0).alias("x"))
    lagged = sums.select(*keys, F.lit(0).alias("kind"), F.col("pos").cast("long").alias("idx"), F.lit(0).cast("long").alias("_n"), F.lit(0).alias("_lags"), "a", "x")

    def finish(g: pd.DataFrame) -> pd.DataFrame:
        end, lag = g[g["kind"] == 1].sort_values("idx"), g[g["kind"] == 0].sort_values("idx")
        n, wanted = int(end["_n"].iloc[0]), int(end["_lags"].iloc[0])
        key = [None if pd.isna(end[b].iloc[0]) else end[b].iloc[0] for b in by]
        got = None
        if n >= 4:
            y, at = end["a"].to_numpy(dtype=float), end["idx"].to_numpy()
            y0, yn = y[at <= wanted + 1], y[at >= n - wanted - 2]
            a, x = lag["a"].to_numpy(dtype=float), lag["x"].to_numpy(dtype=float)
            try:
                got = _solve(n, wanted, autolag, y0, yn, a[:-1], x[:-1], a[-1], x[-1])
            except np.linalg.LinAlgError:
                got = None
        used, m, tau = got or (None, None, None)
        pval = None if tau is None else adf_pvalue(tau)
        row = (*key, n, wanted if n >= 4 else None, used, m, tau, pval, None if pval is None else "Yes" if pval < 0.05 else "No")
        return pd.DataFrame([row], columns=[*by, "n", "max_lag", "used_lag", "n_obs", "adf_stat", "p_value", "stationary"]).astype(
            {"max_lag": "Int32", "used_lag": "Int32", "n_obs": "Int64"})

    schema = T.StructType([ix.schema[b] for b in by] + T._parse_datatype_string(
        "n long, max_lag int, used_lag int, n_obs long, adf_stat double, p_value double, stationary string").fields)
    both = lagged.unionByName(ends)  # a few thousand numbers a group
    if not by:
        return both.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(finish, schema)
    return both.groupBy(*keys).applyInPandas(finish, schema)
