"""Table profiling: shape, roles, null counts, duplicates, size, previews.

All null counts for all columns come from ONE aggregate (one scan, partial
aggregation, one row per task into the final merge); the long-form views are
unpivots of that single row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statlens.functions.columns import (as_list, categorical_columns, date_columns, join_on,
                                        nan_to_null, numeric_columns, q, role_of)
from statlens.plans.ordered import dense_index

_FIXED_WIDTH = {
    T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4,
    T.DateType: 4, T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8, T.TimestampNTZType: 8,
    T.DecimalType: 16,
}


def column_roles(df: DataFrame) -> DataFrame:
    """(position, column_name, data_type, role) from the schema alone."""
    rows = [(i, f.name, f.dataType.simpleString(), role_of(f.dataType))
            for i, f in enumerate(df.schema.fields)]
    schema = "position int, column_name string, data_type string, role string"
    return df.sparkSession.createDataFrame(rows, schema)


def _others(df: DataFrame, by: Sequence[str]) -> list[str]:
    """The columns a report is about: all but those that name the group."""
    return [c for c in df.columns if c not in by]


def shape(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row (per group) with n_rows and n_columns."""
    by = as_list(by)
    return df.groupBy(*[q(b) for b in by]).agg(F.count(F.lit(1)).alias("n_rows")).select(
        *[q(b) for b in by], "n_rows", F.lit(len(_others(df, by))).alias("n_columns"))


def _null_agg(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One aggregate: n_rows and nulls per column (NaN counted as missing)."""
    by = as_list(by)
    d = nan_to_null(df)
    cols = [c for c in d.columns if c not in by]
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.count_if(q(c).isNull()).alias(f"_null_{i}") for i, c in enumerate(cols)]
    agg = d.groupBy(*[q(b) for b in by]).agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"),
                               F.lit(d.schema[c].dataType.simpleString()).alias("data_type"),
                               F.col(f"_null_{i}").alias("nulls"))
                      for i, c in enumerate(cols)])
    return agg.select(*[q(b) for b in by], F.col("_n").alias("n_rows"), F.inline(pairs))


def column_info(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per column type, non-null and null counts."""
    by = as_list(by)
    return _null_agg(df, by).select(
        *[q(b) for b in by], "position", "column_name", "data_type",
        (F.col("n_rows") - F.col("nulls")).alias("non_null"), "nulls")


def missing_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Columns with missing values: count and % of rows, largest first."""
    by = as_list(by)
    return (_null_agg(df, by)
            .where(F.col("nulls") > 0)
            .select(*[q(b) for b in by], "column_name", F.col("nulls").alias("missing"),
                    (F.try_divide(F.col("nulls"), F.col("n_rows")) * 100.0).alias("missing_pct"))
            .orderBy(*[q(b) for b in by], F.desc("missing_pct"), "column_name"))


def missing_topk(df: DataFrame, k: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """The k columns (of each group) with the most missing values (ties by name)."""
    by = as_list(by)
    if not by:
        return missing_summary(df).limit(k)
    place = Window.partitionBy(*[q(b) for b in by]).orderBy(F.desc("missing_pct"), "column_name")
    return missing_summary(df, by).withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= k).drop("_place")


def completeness(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean over columns of the non-null share, in percent."""
    by = as_list(by)
    return (_null_agg(df, by)
            .groupBy(*[q(b) for b in by])
            .agg(F.avg(F.try_divide(F.col("n_rows") - F.col("nulls"), F.col("n_rows")) * 100.0)
                 .alias("completeness_pct")))


def missing_pattern(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """P10: the null/not-null matrix, aggregated: one row per distinct pattern
    ('1' = missing, in column order) with its row count.  Partial aggregation
    collapses the patterns map-side, so the result is small at any size."""
    d, keys = nan_to_null(df), [q(b) for b in as_list(by)]
    cols = as_list(columns) or _others(d, as_list(by))
    pattern = F.concat(*[F.when(q(c).isNull(), F.lit("1")).otherwise(F.lit("0")) for c in cols])
    return (d.select(*keys, pattern.alias("pattern"))
            .groupBy(*keys, "pattern").agg(F.count(F.lit(1)).alias("n_rows"))
            .select(*keys, "pattern", "n_rows",
                    F.expr("length(pattern) - length(replace(pattern, '1', ''))").cast("int")
                    .alias("n_missing")))


def missing_by_bucket(df: DataFrame, order_by: Sequence[str], buckets: int = 50,
                      columns: Sequence[str] | None = None) -> DataFrame:
    """P10, the heat map's cells: share of missing values per column in each of
    ``buckets`` stretches of rows in ``order_by`` (bucket = idx * buckets // n)."""
    order_by = as_list(order_by)
    d = nan_to_null(df)
    cols = as_list(columns) or d.columns
    flags = d.select(*[q(c) for c in order_by], *[q(c).isNull().alias(f"_null_{i}") for i, c in enumerate(cols)])
    ix = dense_index(flags, order_by, size="_n")
    agg = (ix.groupBy(F.floor(F.col("idx") * buckets / F.col("_n")).cast("int").alias("bucket"))
           .agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(f"_null_{i}").alias(f"_null_{i}") for i in range(len(cols))]))
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_null_{i}").alias("missing")) for i, c in enumerate(cols)])
    return (agg.select("bucket", "n_rows", F.inline(cells))
            .select("bucket", "column_name", "n_rows", "missing", (F.col("missing") / F.col("n_rows")).alias("missing_share")))


def _groupable(df: DataFrame) -> DataFrame:
    """Map columns are not valid grouping keys: compare them as JSON."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.MapType):
            out.append(F.to_json(q(f.name)).alias(f.name))
        else:
            out.append(q(f.name))
    return df.select(*out)


def duplicate_count(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows equal to an earlier row (of the group) on all columns (NULL = NULL, NaN = NaN).

    Rows are first counted by a 128-bit hash of themselves (two longs go through
    the shuffle instead of whole rows); only rows whose hash was seen twice are
    grouped by their values, so the result is exact.
    """
    by = as_list(by)
    keys = [q(b) for b in by]
    d = _groupable(nan_to_null(df))
    # + 0.0: negative zero equals zero
    cells = [q(f.name) + F.lit(0.0).cast(f.dataType) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else q(f.name)
             for f in d.schema.fields]
    h1, h2 = F.xxhash64(*cells), F.xxhash64(F.lit(1), *cells)
    seen = d.select(*keys, h1.alias("_h1"), h2.alias("_h2")).groupBy(*keys, "_h1", "_h2").agg(F.count(F.lit(1)).alias("_c"))
    rows = seen.groupBy(*keys).agg(F.coalesce(F.sum("_c"), F.lit(0)).cast("bigint").alias("n_rows"))
    twice = seen.where("_c > 1").select("_h1", "_h2").distinct()
    again = d.join(twice, (h1 == F.col("_h1")) & (h2 == F.col("_h2")), "left_semi")
    dups = (again.groupBy(*[q(c) for c in d.columns]).agg((F.count(F.lit(1)) - 1).alias("_c")).groupBy(*keys)
            .agg(F.coalesce(F.sum("_c"), F.lit(0)).cast("bigint").alias("duplicates")))
    if not by:
        return dups.crossJoin(F.broadcast(rows))
    none = F.lit(0).cast("bigint")
    return join_on(rows, dups, by, "left").select(*keys, F.coalesce("duplicates", none).alias("duplicates"), "n_rows")


def _cell_bytes(f: T.StructField):
    c = q(f.name)
    t = f.dataType
    for k, width in _FIXED_WIDTH.items():
        if isinstance(t, k):
            return F.when(c.isNotNull(), F.lit(width)).otherwise(F.lit(0))
    if isinstance(t, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0))
    return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))


def logical_size(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Data size per column in bytes (fixed width for fixed types, UTF-8
    bytes for strings); one aggregate."""
    keys = [q(b) for b in as_list(by)]
    fields = [df.schema[c] for c in _others(df, as_list(by))]
    agg = df.groupBy(*keys).agg(*[F.sum(_cell_bytes(f)).cast("bigint").alias(f"_s{i}") for i, f in enumerate(fields)])
    pairs = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column_name"),
                               F.coalesce(F.col(f"_s{i}"), F.lit(0).cast("bigint")).alias("bytes"))
                      for i, f in enumerate(fields)])
    return agg.select(*keys, F.inline(pairs))


def table_profile(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row (per group): rows, columns, numerical, categorical, duplicates, size in
    MB, total missing cells, completeness %.  Null counts and sizes are one
    aggregate; duplicates are ``duplicate_count``."""
    by = as_list(by)
    keys = [q(b) for b in by]
    d, names = nan_to_null(df), _others(df, by)
    one = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(q(c).isNull()).alias(f"_null_{i}") for i, c in enumerate(names)],
                               *[F.sum(_cell_bytes(df.schema[c])).alias(f"_size_{i}") for i, c in enumerate(names)])
    nulls = [F.col(f"_null_{i}") for i in range(len(names))]
    share = sum((F.try_divide(F.col("n_rows") - x, F.col("n_rows")) for x in nulls), F.lit(0.0)) * 100.0 / len(names)
    size = sum((F.coalesce(F.col(f"_size_{i}"), F.lit(0)) for i in range(len(names))), F.lit(0)) / (1024.0 * 1024.0)
    dups = duplicate_count(df, by).drop("n_rows")
    return join_on(one, dups, by).select(
        *keys, F.col("n_rows").cast("bigint").alias("n_rows"), F.lit(len(names)).alias("n_columns"),
        F.lit(len(numeric_columns(df, by))).alias("n_numerical"), F.lit(len(categorical_columns(df, by))).alias("n_categorical"),
        "duplicates", size.alias("size_mb"), sum(nulls, F.lit(0)).cast("bigint").alias("total_missing"),
        share.alias("completeness_pct"))


def head(df: DataFrame, n: int = 10, order_by: Sequence[str] = ()) -> DataFrame:
    """P5: first n rows in ``order_by`` (TakeOrderedAndProject: top-n per task)."""
    return df.orderBy(*[q(c) for c in as_list(order_by)]).limit(n)


def tail(df: DataFrame, n: int = 10, order_by: Sequence[str] = ()) -> DataFrame:
    """Last n rows in ``order_by``, returned in ascending order."""
    cols = as_list(order_by)
    last = df.orderBy(*[q(c).desc() for c in cols]).limit(n)
    return last.orderBy(*[q(c) for c in cols])


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with no missing value (NULL or NaN) in ``columns``."""
    cols = as_list(columns) or df.columns
    return nan_to_null(df, cols).na.drop(how="any", subset=cols)


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Projection (pruned down to the scan by Catalyst)."""
    return df.select(*[q(c) for c in as_list(columns)])


def sort_by_date(df: DataFrame, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Rows ordered by the first date column, then ``tiebreak``."""
    dates = date_columns(df)
    if not dates:
        raise ValueError("no date column")
    return df.orderBy(q(dates[0]), *[q(c) for c in as_list(tiebreak)])
