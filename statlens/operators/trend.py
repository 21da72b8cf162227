"""Linear trend on position (W9-W11): one regression aggregate per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statlens.functions.columns import as_double, as_list, join_on, q
from statlens.functions.udfs import two_sided_t_col
from statlens.plans.ordered import dense_index


def _indexed(df, value, order_by, by):
    by, order_by = as_list(by), as_list(order_by)
    keep = list(dict.fromkeys(by + order_by))
    base = df.select(*[q(c) for c in keep], as_double(value).alias("value"))
    return dense_index(base, order_by, by), by, keep


def _fit(ix: DataFrame, by: list[str]) -> DataFrame:
    y, x = F.col("value"), F.col("idx").cast("double")
    return ix.groupBy(*[q(b) for b in by]).agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r_squared"),
        F.regr_avgx(y, x).alias("_xbar"), F.regr_sxx(y, x).alias("_sxx"),
        F.regr_syy(y, x).alias("_syy"), F.stddev_pop(y).alias("std_pop"))


def linear_trend(df: DataFrame, value: str, order_by: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Slope, intercept, R^2 of value on position; Strong if
    |slope| > 0.1 * population std of the values; direction by sign."""
    ix, by, _ = _indexed(df, value, order_by, by)
    fit = _fit(ix, by)
    strength = F.when(F.abs(F.col("slope")) > F.col("std_pop") * 0.1, "Strong").otherwise("Weak")
    direction = (F.when(F.col("slope") > 0, "Increasing").when(F.col("slope") < 0, "Decreasing")
                 .otherwise("Stable"))
    return fit.select(*[q(b) for b in by], "n", "slope", "intercept", "r_squared", "std_pop",
                      strength.alias("trend_strength"), direction.alias("direction"))


def trend_band(df: DataFrame, value: str, order_by: Sequence[str], by: Sequence[str] = (),
               level: float = 0.95, residual_ddof: int = 0) -> DataFrame:
    """Per row fitted value, residual and the confidence band
    t(n-2) * sigma * sqrt(1/n + (x - xbar)^2 / Sxx), sigma the residual std
    with ``residual_ddof`` (0 as in the reference, 2 for the textbook band)."""
    ix, by, keep = _indexed(df, value, order_by, by)
    fit = _fit(ix, by)
    sse = F.col("_syy") * (1 - F.coalesce(F.col("r_squared"), F.lit(1.0)))
    fit = fit.select(*[q(b) for b in by], "n", "slope", "intercept", "_xbar", "_sxx",
                     F.sqrt(F.try_divide(sse, (F.col("n") - residual_ddof).cast("double"))).alias("_sigma"),
                     two_sided_t_col(level, F.col("n") - 2).alias("_t"))
    joined = join_on(ix, fit, by)
    x = F.col("idx").cast("double")
    fitted = F.col("intercept") + F.col("slope") * x
    half = F.col("_t") * F.col("_sigma") * F.sqrt(
        1.0 / F.col("n") + F.try_divide((x - F.col("_xbar")) ** 2, F.col("_sxx")))
    return joined.select(*[q(c) for c in keep], "idx", "value", fitted.alias("fitted"),
                         (F.col("value") - fitted).alias("residual"),
                         half.alias("half_width"), (fitted - half).alias("lower"),
                         (fitted + half).alias("upper"))
