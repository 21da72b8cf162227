"""Schema walks and column expressions shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
STRING_TYPES = (T.StringType, T.CharType, T.VarcharType)
DATE_TYPES = (T.DateType, T.TimestampNTZType, T.TimestampType)


def role_of(dtype: T.DataType) -> str:
    """numerical / categorical / date / other, decided by storage type only.

    Booleans are in no role, as with pandas' dtype selection.
    """
    if isinstance(dtype, NUMERIC_TYPES):
        return "numerical"
    if isinstance(dtype, STRING_TYPES):
        return "categorical"
    if isinstance(dtype, DATE_TYPES):
        return "date"
    return "other"


def columns_with_role(df: DataFrame, role: str, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if role_of(f.dataType) == role and f.name not in skip]


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    return columns_with_role(df, "numerical", exclude)


def categorical_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    return columns_with_role(df, "categorical", exclude)


def date_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    return columns_with_role(df, "date", exclude)


def q(name: str) -> Column:
    """Column by exact name (names may hold dots or spaces)."""
    return F.col("`" + name.replace("`", "``") + "`")


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
            small: bool = False) -> DataFrame:
    """Equi-join on ``keys`` where NULL equals NULL (a group whose key is NULL
    is a group like any other); the result has the left side's keys.

    Without keys the right side is one row.  ``small`` states a bound on the
    right side that the caller proves; else AQE chooses by the measured size.
    """
    keys = list(keys)
    if not keys:
        return left.crossJoin(F.broadcast(right))
    names = {k: f"_right_key_{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(names)
    cond = None
    for k, n in names.items():
        same = q(k).eqNullSafe(q(n))
        cond = same if cond is None else cond & same
    return left.join(F.broadcast(right) if small else right, cond, how).drop(*names.values())


def as_list(cols: str | Sequence[str] | None) -> list[str]:
    if cols is None:
        return []
    if isinstance(cols, str):
        return [cols]
    return list(cols)


def nan_to_null(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Turn NaN into NULL in float/double columns, so that every null-skipping
    aggregate behaves like pandas' skipna (Spark counts NaN and sorts it last).
    A projection: runs inside the scan's codegen stage.
    """
    wanted = None if cols is None else set(cols)
    out = []
    changed = False
    for f in df.schema.fields:
        c = q(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)) and (wanted is None or f.name in wanted):
            out.append(F.when(~F.isnan(c), c).alias(f.name))
            changed = True
        else:
            out.append(c)
    return df.select(*out) if changed else df


def as_double(name: str) -> Column:
    """Numeric column as double with NaN as NULL."""
    c = q(name).cast("double")
    return F.when(~F.isnan(c), c)


def bias_corrected_skew(g1: Column, n: Column) -> Column:
    """Adjusted Fisher-Pearson skewness from Spark's population skewness."""
    nd = n.cast("double")
    return F.when(n > 2, g1 * F.sqrt(nd * (nd - 1)) / (nd - 2))


def unpivot_numeric(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (),
                    column_name: str = "column", value_name: str = "value") -> DataFrame:
    """Long form (keep..., column, value double) with nulls kept; one row per cell.

    ``unpivot`` plans as one Expand on top of the scan: no shuffle.
    """
    if not cols:
        raise ValueError("no columns to unpivot")
    wide = df.select(*[q(k) for k in keep], *[as_double(c).alias(c) for c in cols])
    return wide.unpivot(ids=[q(k) for k in keep], values=[q(c) for c in cols],
                        variableColumnName=column_name, valueColumnName=value_name)
