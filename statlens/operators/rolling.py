"""Rolling statistics over an ordered series.

The reference uses a centred window of ``w = min(30, n // 10)`` rows, only
when n > 10, and a value only where all w observations are present.  With
``by`` keys each group gets its own n and w.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statlens.functions.columns import as_double, as_list, q
from statlens.functions.dist import two_sided_z
from statlens.plans.ordered import dense_index, frame_bounds, rolling_frame, wide_frame

MAX_WINDOW = 30


def default_window(n: int) -> int:
    return min(MAX_WINDOW, n // 10) if n > 10 else 0


def _window_col(n: Column) -> Column:
    return F.when(n > 10, F.least(F.lit(MAX_WINDOW).cast("long"), F.floor(n / 10)).cast("int")).otherwise(F.lit(0))


def row_index(df: DataFrame, order_by: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Dense 0-based position in ``order_by`` (per ``by`` group)."""
    return dense_index(df, as_list(order_by), as_list(by))


def _series(df: DataFrame, value: str, order_by, by) -> DataFrame:
    by, order_by = as_list(by), as_list(order_by)
    keep = list(dict.fromkeys(by + order_by))
    return df.select(*[q(c) for c in keep], as_double(value).alias("value"))


def rolling_raw(df: DataFrame, value: str, order_by: Sequence[str], by: Sequence[str] = (),
                window: int | None = None) -> DataFrame:
    """idx, window and frame count/mean/std (before min-period rules)."""
    by, order_by = as_list(by), as_list(order_by)
    base = _series(df, value, order_by, by)
    if not by or window is not None:
        w = window if window is not None else default_window(base.count())
        r = rolling_frame(base, "value", order_by, by, w=max(w, 1))
        return r.withColumn("window_size", F.lit(w))
    # each group has its own window
    ix = dense_index(base, order_by, by, size="_n")
    ix = ix.withColumn("window_size", _window_col(F.col("_n"))).drop("_n")
    w1 = F.greatest(F.col("window_size"), F.lit(1))
    return wide_frame(ix, "value", by, lo=F.floor(w1 / 2), hi=F.floor((w1 - 1) / 2))


def rolling(df: DataFrame, value: str, order_by: Sequence[str], by: Sequence[str] = (),
            window: int | None = None, level: float = 0.95) -> DataFrame:
    """Per row ``rolling_mean``, ``rolling_std`` (ddof 1) and the band
    mean +- z * std / sqrt(w)."""
    by, order_by = as_list(by), as_list(order_by)
    z = two_sided_z(level)
    r = rolling_raw(df, value, order_by, by, window)
    full = (F.col("window_size") > 0) & (F.col("_wcount") == F.col("window_size"))
    mean = F.when(full, F.col("_wmean"))
    std = F.when(full, F.col("_wstd"))
    half = z * std / F.sqrt(F.col("window_size").cast("double"))
    keep = list(dict.fromkeys(by + order_by))
    return r.select(*[q(c) for c in keep], "idx", "value", "window_size",
                    mean.alias("rolling_mean"), std.alias("rolling_std"),
                    (mean - half).alias("ci_lower"), (mean + half).alias("ci_upper"))


def _first_last(value: Column, idx: Column):
    s = F.when(value.isNotNull(), F.struct(idx.alias("i"), value.alias("v")))
    return F.min(s)["v"], F.max(s)["v"], F.count(value)


def rolling_summary(df: DataFrame, value: str, order_by: Sequence[str], by: Sequence[str] = (),
                    window: int | None = None, level: float = 0.95) -> DataFrame:
    """Band width in % of the mean, Stable/Volatile, trend direction
    and volatility pattern from first / last defined rolling values."""
    by = as_list(by)
    r = rolling(df, value, order_by, by, window, level)
    fm, lm, nm = _first_last(F.col("rolling_mean"), F.col("idx"))
    fs, ls, ns = _first_last(F.col("rolling_std"), F.col("idx"))
    agg = r.groupBy(*[q(b) for b in by]).agg(
        F.max("window_size").alias("window_size"),
        F.avg("rolling_mean").alias("_mm"), F.avg("rolling_std").alias("_ms"),
        F.avg(F.col("ci_upper") - F.col("ci_lower")).alias("_mw"),
        fm.alias("_fm"), lm.alias("_lm"), nm.alias("_nm"),
        fs.alias("_fs"), ls.alias("_ls"), ns.alias("_ns"))
    width = F.when(F.col("_mm") != 0, F.col("_mw") / F.col("_mm") * 100.0).otherwise(F.lit(0.0))
    # Label texts and thresholds (shares of the first value).
    direction = (F.when(F.col("_nm") < 2, "Insufficient data")
                 .when(F.col("_lm") > F.col("_fm") * 1.1, "Strongly Increasing")
                 .when(F.col("_lm") > F.col("_fm") * 1.02, "Moderately Increasing")
                 .when(F.col("_lm") < F.col("_fm") * 0.9, "Strongly Decreasing")
                 .when(F.col("_lm") < F.col("_fm") * 0.98, "Moderately Decreasing")
                 .otherwise("Relatively Stable"))
    pattern = (F.when(F.col("_ns") < 2, "Insufficient data")
               .when(F.col("_ls") > F.col("_fs") * 1.1, "Increasing")
               .when(F.col("_ls") < F.col("_fs") * 0.9, "Decreasing")
               .otherwise("Stable"))
    stable = F.when(F.col("_ms") < F.col("_mm") * 0.1, "Stable").otherwise("Volatile")
    return agg.select(*[q(b) for b in by], "window_size", F.col("_mm").alias("mean_rolling_mean"),
                      F.col("_ms").alias("mean_rolling_std"), width.alias("ci_width_pct"),
                      stable.alias("volatility_status"), direction.alias("trend_direction"),
                      pattern.alias("volatility_pattern"))


__all__ = ["row_index", "rolling", "rolling_summary", "default_window", "frame_bounds"]
