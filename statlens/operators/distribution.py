"""Distribution of one column (D1-D4): mean interval, histogram, density,
box statistics.  Each is a couple of aggregates; the quantiles use the exact
selection plan; nothing collects rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statlens.functions.columns import as_double, as_list, join_on, q
from statlens.functions.udfs import two_sided_t_col
from statlens.plans.ordered import framed
from statlens.plans.quantiles import quantile_table

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def mean_ci(df: DataFrame, column: str, level: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """N, mean, std (ddof 1), se and the t interval; n = 1 -> mean."""
    by = as_list(by)
    x = as_double(column)
    agg = df.groupBy(*[q(b) for b in by]).agg(F.count(x).alias("n"), F.avg(x).alias("mean"),
                                             F.stddev_samp(x).alias("std"))
    se = F.col("std") / F.sqrt(F.col("n").cast("double"))
    t = two_sided_t_col(level, F.col("n") - 1)
    half = F.when(F.col("n") > 1, t * se).otherwise(F.lit(0.0))
    return agg.select(*[q(b) for b in by], "n", "mean", "std", F.when(F.col("n") > 1, se).alias("se"),
                      (F.col("mean") - half).alias("ci_lower"), (F.col("mean") + half).alias("ci_upper"))


def _long(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    return df.select(*[q(b) for b in by], F.lit(column).alias("column_name"), as_double(column).alias("value"))


def _binned(df: DataFrame, column: str, by: list[str], max_bins: int | None) -> tuple[DataFrame, DataFrame]:
    """Bins like numpy's ``bins='auto'``: per group (lo, hi, bins), and the counts of the filled ones."""
    integral = isinstance(df.schema[column].dataType, INTEGRAL)
    long = _long(df, column, by)
    keys = by + ["column_name"]
    qt = quantile_table(long, keys, "value", [0.25, 0.75], ["q1", "q3"], small_keys=not by)
    mm = long.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    st = join_on(qt, mm, keys)
    rng = F.col("hi") - F.col("lo")
    n = F.col("n").cast("double")
    sturges = rng / (F.log2(n) + 1.0)
    fd = 2.0 * (F.col("q3") - F.col("q1")) * F.pow(n, -1.0 / 3.0)
    width = F.when(fd > 0, F.least(sturges, fd)).otherwise(sturges)
    if integral:
        width = F.greatest(width, F.lit(1.0))
    wanted = F.when(rng > 0, F.ceil(rng / width)).otherwise(F.lit(1.0))
    most, hint = (max_bins, f"raise max_bins ({max_bins}), use histogram_runs or drop extreme values") if max_bins else (2 ** 53, "more than doubles can number")
    bins = F.when(wanted <= most, wanted.cast("long")).otherwise(F.raise_error(F.concat(
        F.lit(f"histogram of {column}: "), wanted.cast("string"), F.lit(f" bins; {hint}"))).cast("long"))
    st = st.select(*keys, "n", "lo", "hi", bins.alias("bins"))
    # numpy: a constant column spans [x - 0.5, x + 0.5]
    lo = F.when(F.col("hi") > F.col("lo"), F.col("lo")).otherwise(F.col("lo") - 0.5)
    hi = F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("hi") + 0.5)
    st = st.select(*keys, "n", "bins", lo.alias("lo"), hi.alias("hi"))
    b = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins")).cast("long"),
                F.col("bins") - 1)
    per_key = st.select(*keys, "lo", "hi", "bins")
    counts = (join_on(long.where(F.col("value").isNotNull()), per_key, keys, small=not by)
              .groupBy(*keys, "lo", "hi", "bins", b.alias("bin")).agg(F.count(F.lit(1)).alias("count")))
    return st, counts


_STEP = "(hi - lo) / bins"


def histogram(df: DataFrame, column: str, by: Sequence[str] = (), max_bins: int = 10_000_000) -> DataFrame:
    """Counts in equal-width bins chosen like numpy's ``bins='auto'``
    (the smaller of the Sturges and Freedman-Diaconis widths); empty bins
    are listed with 0.  A column whose spread asks for more than ``max_bins``
    bins raises an error that says so (an extreme value makes bins without
    number; :func:`histogram_runs` tells them in as many rows as are filled); nothing is cut."""
    by = as_list(by)
    keys = by + ["column_name"]
    st, counts = _binned(df, column, by, max_bins)
    # bins are made a thousand at a time, so no row holds all of them
    grid = (st.select(*keys, "lo", "hi", "bins", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1, F.lit(1000).cast("long"))).alias("_from"))
            .select(*keys, "lo", "hi", "bins", F.explode(F.sequence("_from", F.least(F.col("_from") + 999, F.col("bins") - 1))).alias("bin")))
    step = F.expr(_STEP)
    return (join_on(grid, counts.drop("lo", "hi", "bins"), keys + ["bin"], "left")
            .select(*by, "bin", (F.col("lo") + F.col("bin") * step).alias("lower"),
                    (F.col("lo") + (F.col("bin") + 1) * step).alias("upper"),
                    F.coalesce(F.col("count"), F.lit(0).cast("bigint")).alias("count")))


def histogram_runs(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """D2 for any spread: the bins of :func:`histogram`, a run of empty ones as one row.

    Rows (by..., first_bin, last_bin, lower, upper, count): a filled bin by itself, and between two
    filled bins that aren't neighbours one row with count 0.  As many rows as twice the filled bins,
    however many bins there are (up to 2^53); :func:`expand_runs` lists a range of them."""
    by = as_list(by)
    _, counts = _binned(df, column, by, None)
    # the first and the last bin hold the least and the largest value, so every run lies between two filled bins
    nxt = framed(counts, ["bin"], by, lo=0, hi=1, aggs=lambda w: {"_next": F.max("bin").over(w)})
    none = F.lit(0).cast("bigint")
    runs = F.array(F.struct(F.col("bin").alias("first_bin"), F.col("bin").alias("last_bin"), F.col("count").alias("count")),
                   F.when(F.col("_next") > F.col("bin") + 1, F.struct((F.col("bin") + 1).alias("first_bin"), (F.col("_next") - 1).alias("last_bin"), none.alias("count"))))
    out = nxt.select(*[q(b) for b in by], "lo", "hi", "bins", F.inline(F.array_compact(runs)))
    step = F.expr(_STEP)
    return out.select(*[q(b) for b in by], "first_bin", "last_bin", (F.col("lo") + F.col("first_bin") * step).alias("lower"),
                      (F.col("lo") + (F.col("last_bin") + 1) * step).alias("upper"), "count")


def expand_runs(runs: DataFrame, first: int, last: int) -> DataFrame:
    """The bins ``first`` .. ``last`` of :func:`histogram_runs`, one row each (columns as :func:`histogram`)."""
    cut = runs.where((F.col("last_bin") >= first) & (F.col("first_bin") <= last))
    width = (F.col("upper") - F.col("lower")) / (F.col("last_bin") - F.col("first_bin") + 1)
    bins = cut.select("*", width.alias("_width"), F.explode(F.sequence(
        F.greatest("first_bin", F.lit(first)), F.least("last_bin", F.lit(last)))).alias("bin"))
    by = [c for c in runs.columns if c not in ("first_bin", "last_bin", "lower", "upper", "count")]
    at = F.col("bin") - F.col("first_bin")
    return bins.select(*[q(b) for b in by], "bin", (F.col("lower") + at * F.col("_width")).alias("lower"),
                       (F.col("lower") + (at + 1) * F.col("_width")).alias("upper"), "count")


def _kde_partials(by: list[str], grid: int):
    """Per task: kernel sums of its bins at every grid point (numpy on an Arrow
    batch), one row per (group, point)."""
    import numpy as np
    import pandas as pd

    def run(batches):
        acc: dict = {}
        for pdf in batches:
            if len(pdf) == 0:
                continue
            groups = pdf.groupby(by, dropna=False, sort=False) if by else [((), pdf)]
            for key, g in groups:
                lo, hi, h = float(g["lo"].iloc[0]), float(g["hi"].iloc[0]), float(g["h"].iloc[0])
                pts = lo + np.arange(grid) * ((hi - lo) / (grid - 1))
                x, n, v = (g[c].to_numpy(dtype=float) for c in ("_x", "_w", "_v"))
                part = np.zeros(grid)
                for at in range(0, len(x), 4096):
                    u2 = ((pts[:, None] - x[None, at:at + 4096]) / h) ** 2
                    # the bin's spread enters by the kernel's second derivative
                    part += np.exp(-0.5 * u2) * (1 + 0.5 * (v[at:at + 4096] / h ** 2) * (u2 - 1)) @ n[at:at + 4096]
                k = key if isinstance(key, tuple) else (key,)
                k = tuple(None if pd.isna(x) else x for x in k)
                acc[k] = acc.get(k, 0.0) + part
        rows = [(*k, j, float(part[j])) for k, part in acc.items() for j in range(grid)]
        yield pd.DataFrame(rows, columns=[*by, "point", "_ksum"])
    return run


def kde_curve(df: DataFrame, column: str, grid: int = 200, by: Sequence[str] = (), exact: bool = False) -> DataFrame:
    """D3: Gaussian kernel density on ``grid`` points from min to max,
    bandwidth n^(-1/5) * sample std (Scott).

    Values are grouped in bins of a 256th of the bandwidth, kept with their
    count, mean and variance: the density differs by less than 1e-9 of its
    largest value, and only as many bins as are filled cross to Python.
    ``exact=True`` groups equal values only."""
    by = as_list(by)
    keys = [q(b) for b in by]
    x = as_double(column)
    st = df.groupBy(*keys).agg(
        F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.stddev_samp(x).alias("sd"))
    st = st.withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), -0.2))
    rows = join_on(df.select(*keys, x.alias("_x")).where(F.col("_x").isNotNull()), st.select(*keys, "lo", "hi", "h"), by)
    place = F.col("_x") if exact else F.floor(F.try_divide(F.col("_x") - F.col("lo"), F.col("h") / 256.0))
    bins = (rows.where(F.col("h") > 0).groupBy(*keys, "lo", "hi", "h", place.alias("_bin"))
            .agg(F.avg("_x").alias("_x"), F.count(F.lit(1)).alias("_w"), F.var_pop("_x").alias("_v")))
    key_fields = [f for f in df.schema.fields if f.name in by]
    schema = T.StructType(key_fields + [T.StructField("point", T.IntegerType()),
                                        T.StructField("_ksum", T.DoubleType())])
    sums = (bins.select(*[q(f.name) for f in key_fields], "_x", "_w", "_v", "lo", "hi", "h")
            .mapInPandas(_kde_partials([f.name for f in key_fields], grid), schema)
            .groupBy(*keys, "point").agg(F.sum("_ksum").alias("_ksum")))
    out = join_on(sums, st.select(*keys, "n", "lo", "hi", "h"), by)
    step = (F.col("hi") - F.col("lo")) / float(grid - 1)
    norm = F.col("n") * F.col("h") * math.sqrt(2 * math.pi)
    return out.select(*keys, "point", F.col("h").alias("bandwidth"), (F.col("lo") + F.col("point") * step).alias("x"),
                      (F.col("_ksum") / norm).alias("density"))


def box_stats(df: DataFrame, column: str, by: Sequence[str] = (), k: float = 1.5) -> DataFrame:
    """Q1, median, Q3, whisker ends (most extreme values inside the
    fences) and number of fliers."""
    by = as_list(by)
    long = _long(df, column, by)
    keys = by + ["column_name"]
    qt = quantile_table(long, keys, "value", [0.25, 0.5, 0.75], ["q1", "median", "q3"], small_keys=not by)
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - k * iqr, F.col("q3") + k * iqr
    v = F.col("value")
    inside = (v >= lo_f) & (v <= hi_f)
    joined = join_on(long.where(v.isNotNull()), qt, keys, small=not by)
    agg = joined.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("q1").alias("q1"), F.max("median").alias("median"), F.max("q3").alias("q3"),
        F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).alias("n_fliers"))
    return agg.select(*by, "column_name", "n", "q1", "median", "q3", (F.col("q3") - F.col("q1")).alias("iqr"),
                      "whisker_low", "whisker_high", "n_fliers")
