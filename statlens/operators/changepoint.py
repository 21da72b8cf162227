"""Change points (W16-W17): values far from their own centred window.

The series is the non-null values in order; the window is n // 10 rows,
so it grows with the data: the frame statistics are merged from the ends of
stretches (``wide_frame``) instead of an O(n * w) sliding window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statlens.functions.columns import as_double, as_list, join_on, q
from statlens.plans.ordered import dense_index, wide_frame

MIN_N = 20


def _frames(df, value, order_by, by, window):
    by, order_by = as_list(by), as_list(order_by)
    keep = list(dict.fromkeys(by + order_by))
    base = (df.select(*[q(c) for c in keep], as_double(value).alias("value"))
            .where(F.col("value").isNotNull()))
    w_col = F.lit(window) if window is not None else F.floor(F.col("_n") / 10)
    ix = (dense_index(base, order_by, by, size="_n").where(F.col("_n") >= MIN_N)
          .withColumn("window_size", w_col.cast("long")).where(F.col("window_size") >= 1).drop("_n"))
    r = wide_frame(ix, "value", by, lo=F.floor(F.col("window_size") / 2), hi=F.floor((F.col("window_size") - 1) / 2))
    return r, keep, by


def change_points(df: DataFrame, value: str, order_by: Sequence[str], by: Sequence[str] = (),
                  window: int | None = None, k: float = 2.0) -> DataFrame:
    """Rows with |x - rolling mean| / rolling std > k (n >= 20; a shorter
    series has none)."""
    r, keep, by = _frames(df, value, order_by, by, window)
    full = F.col("_wcount") == F.col("window_size")
    mean = F.when(full, F.col("_wmean"))
    std = F.when(full, F.col("_wstd"))
    z = F.abs(F.try_divide(F.col("value") - mean, std))
    return (r.select(*[q(c) for c in keep], "idx", "value", "window_size", mean.alias("rolling_mean"),
                     std.alias("rolling_std"), z.alias("z"))
            .where(F.col("z") > k))


def change_point_count(df: DataFrame, value: str, order_by: Sequence[str], by: Sequence[str] = (),
                       window: int | None = None, k: float = 2.0) -> DataFrame:
    """Number of change points (per group; a group without any has 0)."""
    by = as_list(by)
    cp = (change_points(df, value, order_by, by, window, k)
          .groupBy(*[q(b) for b in by]).agg(F.count(F.lit(1)).alias("n_change_points")))
    if not by:
        return cp
    groups = df.select(*[q(b) for b in by]).distinct()
    return join_on(groups, cp, by, "left").select(
        *[q(b) for b in by], F.coalesce("n_change_points", F.lit(0).cast("long")).alias("n_change_points"))
