"""Quality scores: uniqueness, consistency, validity and their summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statlens.functions.columns import as_list, categorical_columns, join_on, numeric_columns, q
from statlens.operators.profile import completeness, duplicate_count

# Lower-cased column names that must not hold negative values.
NON_NEGATIVE_NAMES = ("age", "price", "salary")


def uniqueness(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Q7: (1 - duplicates / rows) * 100, of the table or each group."""
    return duplicate_count(df, by).select(
        *[q(b) for b in as_list(by)], "duplicates", "n_rows",
        ((1.0 - F.try_divide(F.col("duplicates"), F.col("n_rows"))) * 100.0).alias("uniqueness_pct"))


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None,
                    approx: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Q8: non-null distinct values per string column (and group).

    Exact: unpivot to (column, value) and group twice; the first grouping is
    combined map-side, so a value repeated a billion times costs one row per
    task.  ``approx=True`` uses HyperLogLog++ in one aggregate instead.
    """
    by = as_list(by)
    keys = [q(b) for b in by]
    cols = as_list(columns) or categorical_columns(df, by)
    if not cols:
        raise ValueError("no string columns")
    if approx:
        agg = df.groupBy(*keys).agg(*[F.approx_count_distinct(q(c)).alias(f"_d{i}") for i, c in enumerate(cols)])
        pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_d{i}").alias("n_distinct"))
                          for i, c in enumerate(cols)])
        return agg.select(*keys, F.inline(pairs))
    long = (df.select(*keys, *[q(c).cast("string").alias(c) for c in cols])
            .unpivot(ids=keys, values=[q(c) for c in cols], variableColumnName="column_name",
                     valueColumnName="value")
            .where(F.col("value").isNotNull()))
    found = (long.groupBy(*keys, "column_name", "value").agg(F.count(F.lit(1)).alias("_c"))
             .groupBy(*keys, "column_name").agg(F.count(F.lit(1)).alias("n_distinct")))
    if by:  # each column of each group, also where it has no value
        names = df.select(*keys).distinct().select("*", F.explode(F.array(*[F.lit(c) for c in cols])).alias("column_name"))
    else:
        names = F.broadcast(df.sparkSession.createDataFrame([(c,) for c in cols], "column_name string"))
    return (join_on(names, found, by + ["column_name"], "left")
            .select(*keys, "column_name", F.coalesce("n_distinct", F.lit(0).cast("bigint")).alias("n_distinct")))


def consistency_score(df: DataFrame, share: float = 0.5, penalty: float = 5.0, by: Sequence[str] = ()) -> DataFrame:
    """Q9: 100 minus ``penalty`` per string column whose distinct count exceeds
    ``share`` of the rows (of the group); at least 0."""
    by = as_list(by)
    keys = [q(b) for b in by]
    cols = categorical_columns(df, by)
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    if not cols:
        return n.select(*keys, "n_rows", F.lit(0).cast("bigint").alias("n_high_cardinality"),
                        F.lit(100.0).alias("consistency"))
    d = distinct_counts(df, cols, by=by)
    flagged = (join_on(d, n, by).groupBy(*keys)
               .agg(F.max("n_rows").alias("n_rows"),
                    F.count_if(F.col("n_distinct") > F.col("n_rows") * share).alias("n_high_cardinality")))
    return flagged.select(*keys, "n_rows", "n_high_cardinality",
                          F.greatest(F.lit(100.0) - penalty * F.col("n_high_cardinality"), F.lit(0.0))
                          .alias("consistency"))


def validity_score(df: DataFrame, non_negative: Sequence[str] = NON_NEGATIVE_NAMES,
                   penalty: float = 10.0, by: Sequence[str] = ()) -> DataFrame:
    """Q10: 100 minus ``penalty`` per numeric column named (case-insensitive)
    in ``non_negative`` that holds a negative value (in the group); at least 0."""
    by = as_list(by)
    keys = [q(b) for b in by]
    names = {s.lower() for s in non_negative}
    checked = [c for c in numeric_columns(df, by) if c.lower() in names]
    if not checked:
        fine = [F.lit(0).cast("bigint").alias("n_invalid_columns"), F.lit(100.0).alias("validity")]
        return df.select(*keys).distinct().select(*keys, *fine) if by else df.sparkSession.range(1).select(*fine)
    flags = df.groupBy(*keys).agg(*[F.coalesce(F.bool_or(q(c) < 0), F.lit(False)).alias(f"_neg{i}")
                                    for i, c in enumerate(checked)])
    bad = sum(F.col(f"_neg{i}").cast("bigint") for i in range(len(checked)))
    return flags.select(*keys, bad.alias("n_invalid_columns"),
                        F.greatest(F.lit(100.0) - penalty * bad, F.lit(0.0)).alias("validity"))


def quality_summary(df: DataFrame, non_negative: Sequence[str] = NON_NEGATIVE_NAMES, by: Sequence[str] = ()) -> DataFrame:
    """Q11: completeness, uniqueness, consistency, validity, their plain mean,
    and Excellent (>= 90) / Good (>= 75) / Poor; of the table or each group."""
    by = as_list(by)
    keys = [q(b) for b in by]
    parts = completeness(df, by).withColumnRenamed("completeness_pct", "completeness")
    for part in (uniqueness(df, by).select(*keys, F.col("uniqueness_pct").alias("uniqueness")),
                 consistency_score(df, by=by).select(*keys, "consistency"), validity_score(df, non_negative, by=by).select(*keys, "validity")):
        parts = join_on(parts, part, by)
    overall = (F.col("completeness") + F.col("uniqueness") + F.col("consistency") + F.col("validity")) / 4.0
    return parts.select(*keys, "completeness", "uniqueness", "consistency", "validity",
                        overall.alias("overall"),
                        F.when(overall >= 90, "Excellent").when(overall >= 75, "Good")
                        .otherwise("Poor").alias("verdict"))
