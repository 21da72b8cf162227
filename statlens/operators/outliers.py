"""Outliers: z-scores (population std), IQR fences, the per-column report.

Counts and fences of all columns come from wide aggregates (one row per group, a
few numbers per column), and only the cells that can decide a quartile or a fence
become rows of their own (:func:`statlens.plans.quantiles.fence_table`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statlens.functions.columns import as_double, as_list, join_on, numeric_columns, q, unpivot_numeric
from statlens.plans.quantiles import fence_table

KEY = "column_name"


def _long(df: DataFrame, columns, by) -> tuple[DataFrame, list[str], list[str]]:
    by = as_list(by)
    cols = as_list(columns) or numeric_columns(df, exclude=by)
    return unpivot_numeric(df, cols, keep=by, column_name=KEY), cols, by


def moments(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Per column: rows (incl. nulls), n, mean, population std, sample std."""
    long, _, by = _long(df, columns, by)
    return long.groupBy(*by, KEY).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n"),
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std_pop"),
        F.stddev_samp("value").alias("std"))


def zscore(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Q1: the input rows plus ``z_<col>`` = (x - mean) / population std.

    NULL where x is NULL or the column is constant.  The statistics are one
    row (per group), joined by broadcast.
    """
    by = as_list(by)
    cols = as_list(columns) or numeric_columns(df, exclude=by)
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(as_double(c)).alias(f"_mu{i}"), F.stddev_pop(as_double(c)).alias(f"_sd{i}")]
    stats = df.groupBy(*[q(b) for b in by]).agg(*aggs)
    joined = join_on(df, stats, by)
    zs = [F.try_divide(as_double(c) - F.col(f"_mu{i}"), F.col(f"_sd{i}")).alias(f"z_{c}")
          for i, c in enumerate(cols)]
    return joined.select(*[q(c) for c in df.columns], *zs)


def _columns(df: DataFrame, columns, by) -> tuple[list[tuple[str, Column]], list[str]]:
    by = as_list(by)
    cols = as_list(columns) or numeric_columns(df, exclude=by)
    if not cols:
        raise ValueError("no numeric columns")
    return [(c, as_double(c)) for c in cols], by


def zscore_outliers(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = (),
                    k: float = 3.0) -> DataFrame:
    """Q2: per column, values with |z| > k (constant column: 0)."""
    cols, by = _columns(df, columns, by)
    keys, aggs, counts = [q(b) for b in by], [], []
    wide = df.select(*keys, *[c.alias(f"_v{i}") for i, (_, c) in enumerate(cols)])
    for i, (name, _) in enumerate(cols):
        v = F.col(f"_v{i}")
        aggs += [F.avg(v).alias(f"_mu{i}"), F.stddev_pop(v).alias(f"_sd{i}")]
        counts.append(F.count_if(F.abs(F.try_divide(v - F.col(f"_mu{i}"), F.col(f"_sd{i}"))) > k).alias(f"_z{i}"))
    found = join_on(wide, wide.groupBy(*keys).agg(*aggs), by).groupBy(*keys).agg(*counts)
    return found.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias(KEY), F.col(f"_z{i}").alias("z_outliers"))
                                                  for i, (c, _) in enumerate(cols)])))


def iqr_bounds(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = (),
               k: float = 1.5) -> DataFrame:
    """Q3: Q1, Q3, IQR and the fences Q1 - k*IQR, Q3 + k*IQR per column
    (exact linear-interpolated quantiles, nulls skipped; no row without values)."""
    cols, by = _columns(df, columns, by)
    return fence_table(df, cols, by, KEY, iqr_k=k).where("n > 0").select(
        *[q(b) for b in by], KEY, "n", "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"), "lower", "upper")


def iqr_outliers(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = (),
                 k: float = 1.5) -> DataFrame:
    """Q4: per column, values strictly outside the IQR fences."""
    cols, by = _columns(df, columns, by)
    return fence_table(df, cols, by, KEY, iqr_k=k).select(*[q(b) for b in by], KEY, "iqr_outliers")


def outlier_report(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = (),
                   z_k: float = 3.0, iqr_k: float = 1.5) -> DataFrame:
    """Q5: per column z and IQR outlier counts, share of all rows (nulls
    included) in %, rounded to 2, and High (> 5) / Medium (> 1) / Low."""
    cols, by = _columns(df, columns, by)
    counts = fence_table(df, cols, by, KEY, z_k=z_k, iqr_k=iqr_k)
    pct = F.try_divide(F.greatest("z_outliers", "iqr_outliers").cast("double"), F.col("n_rows")) * 100.0
    return counts.select(
        *[q(b) for b in by], KEY, "z_outliers", "iqr_outliers", F.round(pct, 2).alias("outlier_pct"),
        F.when(pct > 5, "High").when(pct > 1, "Medium").otherwise("Low").alias("outlier_status"))


def outlier_flags(df: DataFrame, column: str, by: Sequence[str] = (), k: float = 1.5) -> DataFrame:
    """Q6: the rows of ``df`` whose ``column`` lies outside the IQR fences,
    with the fences and the side ('low' / 'high')."""
    by = as_list(by)
    b = iqr_bounds(df, [column], by, k).select(*by, "lower", "upper")
    joined = join_on(df, b, by)
    x = as_double(column)
    return (joined.where((x < F.col("lower")) | (x > F.col("upper")))
            .withColumn("side", F.when(x < F.col("lower"), "low").otherwise("high")))
