"""Classical additive decomposition.

trend    : centred moving average of ``period`` (2 x p for even p) as a
           window frame; the p//2 undefined points at each end are filled
           from a least-squares line through the nearest p defined points.
seasonal : mean of (value - trend) per phase ``idx mod p``, centred to 0.
resid    : value - trend - seasonal.
The series is the non-null values in order.  Every step is a window frame,
a grouped aggregate over <= p phases, or a join of that small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statlens.functions.columns import as_double, as_list, bias_corrected_skew, join_on, q
from statlens.plans.ordered import framed

MIN_ROWS = 50
DEFAULT_PERIOD = 12


def seasonal_decompose(df: DataFrame, value: str, order_by: Sequence[str], by: Sequence[str] = (),
                       period: int | None = None) -> DataFrame:
    """Rows (by..., order..., idx, observed, trend, seasonal, resid)."""
    by, order_by = as_list(by), as_list(order_by)
    keep = list(dict.fromkeys(by + order_by))
    p = period or DEFAULT_PERIOD
    rows = df.select(*[q(c) for c in keep], as_double(value).alias("observed"))
    sizes_all = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    base = rows.where(F.col("observed").isNotNull())
    half = p // 2
    v = F.col("observed")
    if p % 2 == 0:
        def aggs(fr):
            return {"_fc": F.count(v).over(fr),
                    "_ma": (F.sum(v).over(fr) - 0.5 * F.first(v).over(fr) - 0.5 * F.last(v).over(fr)) / p}
        full = p + 1
    else:
        def aggs(fr):
            return {"_fc": F.count(v).over(fr), "_ma": F.sum(v).over(fr) / p}
        full = p
    ma = framed(base, order_by, by, lo=half, hi=half, aggs=aggs, size="_n")
    ma = ma.withColumn("_t", F.when(F.col("_fc") == full, F.col("_ma"))).drop("_fc", "_ma")

    ma = join_on(ma, sizes_all, by).where((F.col("_rows") >= MIN_ROWS) & (F.col("_n") >= 2 * p))
    front, back = F.lit(half), F.col("_n") - 1 - half
    x = F.col("idx").cast("double")
    in_front = (F.col("idx") >= front) & (F.col("idx") < F.least(front + p, back))
    in_back = (F.col("idx") >= F.greatest(front, back - p)) & (F.col("idx") < back)
    t = F.col("_t")
    ends = ma.groupBy(*by).agg(
        F.regr_slope(F.when(in_front, t), x).alias("_fs"), F.regr_intercept(F.when(in_front, t), x).alias("_fi"),
        F.regr_slope(F.when(in_back, t), x).alias("_bs"), F.regr_intercept(F.when(in_back, t), x).alias("_bi"))
    tr = join_on(ma, ends, by).withColumn(
        "trend", F.when(t.isNotNull(), t)
        .when(F.col("idx") < front, F.col("_fi") + F.col("_fs") * x)
        .otherwise(F.col("_bi") + F.col("_bs") * x))
    tr = tr.withColumn("_phase", F.pmod(F.col("idx"), F.lit(p)))
    phases = tr.groupBy(*by, "_phase").agg(F.avg(F.col("observed") - F.col("trend")).alias("_pa"))
    centre = phases.groupBy(*by).agg(F.avg("_pa").alias("_pm"))
    phases = join_on(phases, centre, by).select(*by, "_phase", (F.col("_pa") - F.col("_pm")).alias("seasonal"))
    # <= p rows per group: broadcast when ungrouped
    out = join_on(tr, phases, by + ["_phase"], small=not by)
    return out.select(*[q(c) for c in keep], "idx", "observed", "trend", "seasonal",
                      (F.col("observed") - F.col("trend") - F.col("seasonal")).alias("resid"))


def seasonal_summary(df: DataFrame, value: str, order_by: Sequence[str], by: Sequence[str] = (),
                     period: int | None = None) -> DataFrame:
    """Seasonal strength max(0, 1 - var(resid)/var(observed)) with
    Strong (> 0.6) / Moderate (> 0.3) / Weak; trend Clear if std(trend) >
    0.1 std(observed); residuals Random if |skew| < 1 (bias-corrected)."""
    by = as_list(by)
    d = seasonal_decompose(df, value, order_by, by, period)
    agg = d.groupBy(*[q(b) for b in by]).agg(
        F.count(F.lit(1)).alias("n"), F.var_samp("resid").alias("_vr"), F.var_samp("observed").alias("_vo"),
        F.stddev_samp("trend").alias("_st"), F.stddev_samp("observed").alias("_so"),
        F.skewness("resid").alias("_g1"))
    strength = F.greatest(F.lit(0.0), 1 - F.try_divide(F.col("_vr"), F.col("_vo")))
    skew = bias_corrected_skew(F.col("_g1"), F.col("n"))
    return agg.select(
        *[q(b) for b in by], "n", F.lit(period or DEFAULT_PERIOD).alias("period"),
        strength.alias("seasonal_strength"),
        F.when(strength > 0.6, "Strong").when(strength > 0.3, "Moderate").otherwise("Weak")
        .alias("seasonal_label"),
        F.when(F.col("_st") > F.col("_so") * 0.1, "Clear").otherwise("Subtle").alias("trend_clarity"),
        skew.alias("resid_skew"),
        F.when(F.abs(skew) < 1, "Random").otherwise("Systematic").alias("residual_pattern"))
