"""Arrow-batched helpers for distribution functions Spark lacks.

They run on result tables (one row per column pair or per group), never on
the raw rows, so the Python work is proportional to the number of results.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statlens.functions import dist


@F.pandas_udf(T.DoubleType())
def t_quantile(p: pd.Series, nu: pd.Series) -> pd.Series:
    known: dict[tuple, float | None] = {}  # groups of one size share a value
    for key in set(zip(p, nu)):
        pi, ni = key
        bad = pd.isna(pi) or pd.isna(ni) or ni <= 0 or not 0 < pi < 1
        known[key] = None if bad else dist.t_ppf(float(pi), float(ni))
    return pd.Series([known.get(k) for k in zip(p, nu)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_two_sided_p(t: pd.Series, nu: pd.Series) -> pd.Series:
    p = pd.Series(dist.t_sf2_many(t.to_numpy(float, na_value=float("nan")), nu.to_numpy(float, na_value=float("nan"))))
    return p.astype(object).where(p.notna(), None)


@F.pandas_udf(T.DoubleType())
def adf_p(tau: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else dist.adf_pvalue(float(x)) for x in tau], dtype="float64")


def two_sided_t_col(level: float, nu: Column) -> Column:
    """Critical value t_{(1+level)/2}(nu) per row of a small table."""
    return t_quantile(F.lit(1.0 - (1.0 - level) / 2.0), nu.cast("double"))
