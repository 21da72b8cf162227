"""

``entry(spark)`` runs the flagship query (per-column outlier report over the
numeric columns of ``lineitem``) at sf0.001.  ``queries()`` maps each
operator of the library to a query over the given tables (or over data Spark
derives from them); ``oracle_sql()`` holds the DuckDB twin of each query.

Doubles are rounded to 6 decimals on both sides; counts are BIGINT.
Missing values and duplicates do not occur in the given tables, so the
queries that test them derive them the same way in Spark and in SQL
(a value is blanked when ``event_id`` is a multiple of 7 or 11; rows are
projected to a few columns, which repeats them).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statlens.session import scratch_path
from statlens.sources import files
from statlens.operators import (changepoint, correlation, distribution, evaluation, modelling, outliers, pca, profile, quality,
                                rolling, seasonal, states, stationarity, trend)

try:  # the operators of statlens.llm and the pipeline are optional; the rest works without them
    import corpus_pipeline
    from statlens.llm import queries as llm
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "statlens.llm"):
        raise
    corpus_pipeline = llm = None

SF0001 = "/root/testdata/sf0.001"


# --------------------------------------------------------------------------
# inputs


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events_dirty(spark: SparkSession, sf: str) -> DataFrame:
    ev = _t(spark, sf, "events")
    return ev.select("event_id", "ts", "user_id", "event_type",
                     F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
                     F.when(F.col("event_id") % 11 != 0, F.col("props")).alias("props"))


EVENTS_DIRTY_SQL = """(SELECT event_id, ts, user_id, event_type,
    CASE WHEN event_id % 7 <> 0 THEN value END AS value,
    CASE WHEN event_id % 11 <> 0 THEN props END AS props FROM events)"""


def events_dup(spark: SparkSession, sf: str) -> DataFrame:
    ev = _t(spark, sf, "events")
    return ev.select("user_id", "event_type",
                     F.when(F.col("event_id") % 7 != 0, F.floor(F.col("value") / 10)).alias("v10"))


EVENTS_DUP_SQL = """(SELECT user_id, event_type,
    CASE WHEN event_id % 7 <> 0 THEN floor(value / 10) END AS v10 FROM events)"""


def events_null_key(spark: SparkSession, sf: str) -> DataFrame:
    """Events whose group key is NULL in every fifth row; one value is extreme."""
    ev = _t(spark, sf, "events")
    return ev.select("event_id", "ts", F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("event_type"),
                     F.when(F.col("event_id") == 77, F.lit(1e12)).otherwise(F.col("value")).alias("value"))


EVENTS_NULL_KEY_SQL = """(SELECT event_id, ts, CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type,
    CASE WHEN event_id = 77 THEN 1e12 ELSE value END AS value FROM events)"""
PLAIN_NULL_KEY_SQL = """(SELECT event_id, ts, CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type, value FROM events)"""


def events_plain_null_key(spark: SparkSession, sf: str) -> DataFrame:
    ev = _t(spark, sf, "events")
    return ev.select("event_id", "ts", F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("event_type"), "value")


def daily_quantity(spark: SparkSession, sf: str) -> DataFrame:
    """Daily shipped quantity: integer-valued, so sums are exact on both sides."""
    li = _t(spark, sf, "lineitem")
    return li.groupBy("l_shipdate").agg(F.sum("l_quantity").alias("qty"))


DAILY_QTY_SQL = "(SELECT l_shipdate, sum(l_quantity) AS qty FROM lineitem GROUP BY l_shipdate)"
EV_ORDER = ["ts", "event_id"]
Z95 = 1.959963984540054


def _t_sql(nu: str, z: float = Z95) -> str:
    """Student t quantile as a series in 1/nu around the normal quantile z
    (Abramowitz & Stegun 26.7.5); error < 1e-9 for nu > 50."""
    z = f"CAST({z!r} AS DOUBLE)"
    g1 = f"(({z})^3 + {z}) / 4"
    g2 = f"(5 * ({z})^5 + 16 * ({z})^3 + 3 * {z}) / 96"
    g3 = f"(3 * ({z})^7 + 19 * ({z})^5 + 17 * ({z})^3 - 15 * {z}) / 384"
    g4 = f"(79 * ({z})^9 + 776 * ({z})^7 + 1482 * ({z})^5 - 1920 * ({z})^3 - 945 * {z}) / 92160"
    v = f"CAST({nu} AS DOUBLE)"
    return f"({z} + {g1} / {v} + {g2} / ({v})^2 + {g3} / ({v})^3 + {g4} / ({v})^4)"


CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "unit_price"]


def lineitem_corr(spark: SparkSession, sf: str) -> DataFrame:
    """Numeric lineitem columns plus a derived one with gaps (pairwise-complete rows)."""
    li = _t(spark, sf, "lineitem")
    return li.select("l_quantity", "l_extendedprice", "l_discount", "l_tax",
                     F.when(F.col("l_orderkey") % 5 != 0, F.col("l_extendedprice") / F.col("l_quantity"))
                     .alias("unit_price"))


LINEITEM_CORR_SQL = """(SELECT l_quantity, l_extendedprice, l_discount, l_tax,
    CASE WHEN l_orderkey % 5 <> 0 THEN l_extendedprice / l_quantity END AS unit_price FROM lineitem)"""


LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax"]


def _lineitem_long_sql() -> str:
    cols = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in LINEITEM_NUMERIC)
    return f"(UNPIVOT (SELECT {cols} FROM lineitem) ON COLUMNS(*) INTO NAME column_name VALUE value)"


def _eigen_sql(cols: list[str], source: str) -> str:
    """CTEs ending in eig(component, ev, cum, v0, v1, ...): eigenpairs of the
    correlation matrix of the complete rows, by Jacobi rotations."""
    k = len(cols)
    corr = {(i, j): f"corr({cols[i]}, {cols[j]})" if i != j else "1.0" for i in range(k) for j in range(i, k)}
    whole = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    steps = ["j0 AS MATERIALIZED (SELECT " + ", ".join(f"CAST({x} AS DOUBLE) AS a{i}{j}" for (i, j), x in corr.items()) + ", "
             + ", ".join(f"CAST({int(i == j)} AS DOUBLE) AS v{i}{j}" for i in range(k) for j in range(k)) + f" FROM {source} src WHERE {whole})"]

    def a(i, j):
        return f"a{min(i, j)}{max(i, j)}"

    n = 0
    for _ in range(7):
        for p in range(k):
            for r in range(p + 1, k):
                steps.append(f"""t{n} AS MATERIALIZED (SELECT *, CASE WHEN abs({a(p, r)}) < 1e-200 THEN 0.0 ELSE
                    (CASE WHEN {a(r, r)} >= {a(p, p)} THEN 1 ELSE -1 END) / (abs(({a(r, r)} - {a(p, p)}) / (2 * {a(p, r)}))
                    + sqrt((({a(r, r)} - {a(p, p)}) / (2 * {a(p, r)})) ^ 2 + 1)) * sign({a(p, r)}) END AS t FROM j{n})""")
                steps.append(f"c{n} AS MATERIALIZED (SELECT *, 1 / sqrt(t * t + 1) AS c, t / sqrt(t * t + 1) AS s FROM t{n})")
                new = {a(p, p): f"{a(p, p)} - t * {a(p, r)}", a(r, r): f"{a(r, r)} + t * {a(p, r)}", a(p, r): "0.0"}
                for m in range(k):
                    if m not in (p, r):
                        new[a(m, p)] = f"c * {a(m, p)} - s * {a(m, r)}"
                        new[a(m, r)] = f"s * {a(m, p)} + c * {a(m, r)}"
                    new[f"v{m}{p}"] = f"c * v{m}{p} - s * v{m}{r}"
                    new[f"v{m}{r}"] = f"s * v{m}{p} + c * v{m}{r}"
                names = [f"a{i}{j}" for (i, j) in corr] + [f"v{i}{j}" for i in range(k) for j in range(k)]
                n += 1
                steps.append(f"j{n} AS MATERIALIZED (SELECT " + ", ".join(f"{new.get(x, x)} AS {x}" for x in names) + f" FROM c{n - 1})")
    rows = " UNION ALL ".join(f"SELECT a{i}{i} AS ev, " + ", ".join(f"v{m}{i} AS v{m}" for m in range(k)) + f" FROM j{n}" for i in range(k))
    big = "greatest(" + ", ".join(f"abs(v{m})" for m in range(k)) + ")"
    sign = "CASE " + " ".join(f"WHEN abs(v{m}) = {big} THEN sign(v{m})" for m in range(k)) + " END"
    steps.append(f"pairs AS ({rows})")
    steps.append("eig AS (SELECT CAST(row_number() OVER (ORDER BY ev DESC) AS INTEGER) AS component, ev, sum(ev) OVER (ORDER BY ev DESC) / sum(ev) OVER () AS cum, "
                 + ", ".join(f"v{m} * ({sign}) AS v{m}" for m in range(k)) + " FROM pairs)")
    return ", ".join(steps)


def r6(df: DataFrame) -> DataFrame:
    """Round every double column to 6 decimals (both sides of the oracle do)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(c.cast("double"), 6).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def r10(df: DataFrame) -> DataFrame:
    """:func:`r6`, and 10 significant digits of doubles from a million on (of an extreme value's own frames)."""
    def digits(c):
        return F.when(F.abs(c) < 1e6, F.round(c, 6)).otherwise(F.format_string("%.9e", c).try_cast("double"))

    return df.select(*[digits(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def _r10_sql(sql: str, columns: str) -> str:
    """Twin of :func:`r10` for a query whose doubles are rounded like ``round(x, 6)``."""
    kept = [f"CASE WHEN abs({c}) < 1e6 THEN round({c}, 6) ELSE CAST(printf('%.9e', {c}) AS DOUBLE) END AS {c}" for c in columns.split()]
    return f"SELECT * REPLACE ({', '.join(kept)}) FROM ({re.sub(r'round[(]([a-z_ +-]+), 6[)]', r'(\1)', sql)}) AS exact"


# Spark simpleString of the DuckDB types found in the given tables
_SPARK_TYPE_SQL = """CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
    WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
    WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(data_type) END"""


def _role_sql() -> str:
    return """CASE WHEN data_type IN ('BIGINT','INTEGER','DOUBLE','FLOAT','SMALLINT','TINYINT')
      OR data_type LIKE 'DECIMAL%' THEN 'numerical'
    WHEN data_type = 'VARCHAR' THEN 'categorical'
    WHEN data_type IN ('TIMESTAMP','DATE') THEN 'date' ELSE 'other' END"""


# --------------------------------------------------------------------------
# queries


def q_outlier_report(spark, sf):
    return r6(outliers.outlier_report(_t(spark, sf, "lineitem"), LINEITEM_NUMERIC))


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: outlier report over the numeric columns of lineitem, sf0.001."""
    return q_outlier_report(spark, SF0001)


def _queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

    Q["column_roles"] = lambda s, sf: profile.column_roles(_t(s, sf, "lineitem"))
    Q["shape"] = lambda s, sf: profile.shape(_t(s, sf, "lineitem"))
    Q["table_profile"] = lambda s, sf: r6(profile.table_profile(events_dirty(s, sf)))
    Q["column_info"] = lambda s, sf: profile.column_info(events_dirty(s, sf))
    Q["missing_summary"] = lambda s, sf: r6(profile.missing_summary(events_dirty(s, sf)))
    Q["missing_topk"] = lambda s, sf: r6(profile.missing_topk(events_dirty(s, sf), 10))
    Q["missing_pattern"] = lambda s, sf: profile.missing_pattern(events_dirty(s, sf))
    Q["missing_by_bucket"] = lambda s, sf: r6(profile.missing_by_bucket(events_dirty(s, sf), EV_ORDER, 20))
    Q["completeness"] = lambda s, sf: r6(profile.completeness(events_dirty(s, sf)))
    Q["duplicate_count"] = lambda s, sf: profile.duplicate_count(events_dup(s, sf))
    Q["logical_size"] = lambda s, sf: profile.logical_size(events_dirty(s, sf))
    def day_states(s, sf):
        """The state of each day of events with gaps, merged as one table."""
        d = events_dirty(s, sf).withColumn("day", F.to_date("ts"))
        return states.profile_state(d, ["day"])
    Q["state_info"] = lambda s, sf: r6(states.state_info(day_states(s, sf)))
    Q["state_missing"] = lambda s, sf: r6(states.state_missing(day_states(s, sf)))
    Q["state_profile"] = lambda s, sf: r6(states.state_profile(day_states(s, sf)).drop("approx_duplicates"))
    Q["state_distinct"] = lambda s, sf: states.state_distinct(day_states(s, sf)).where("column_name = 'event_type'")
    Q["head"] = lambda s, sf: r6(profile.head(_t(s, sf, "events"), 10, ["ts", "event_id"]))
    Q["tail"] = lambda s, sf: r6(profile.tail(_t(s, sf, "events"), 10, ["ts", "event_id"]))
    Q["drop_missing"] = lambda s, sf: r6(profile.drop_missing(events_dirty(s, sf)))
    Q["select_columns"] = lambda s, sf: r6(profile.select_columns(_t(s, sf, "lineitem"),
                                                                   ["l_orderkey", "l_linenumber", "l_quantity"]))
    Q["sort_by_date"] = lambda s, sf: r6(profile.sort_by_date(_t(s, sf, "orders"), ["o_orderkey"]))

    def zscore(s, sf):
        z = outliers.zscore(_t(s, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
        return r6(z.select("l_orderkey", "l_linenumber", "z_l_quantity", "z_l_extendedprice", "z_l_discount"))
    Q["zscore"] = zscore
    Q["zscore_outliers"] = lambda s, sf: outliers.zscore_outliers(_t(s, sf, "lineitem"), LINEITEM_NUMERIC)
    Q["iqr_bounds"] = lambda s, sf: r6(outliers.iqr_bounds(_t(s, sf, "lineitem"), LINEITEM_NUMERIC))
    Q["iqr_outliers"] = lambda s, sf: outliers.iqr_outliers(_t(s, sf, "lineitem"), LINEITEM_NUMERIC)
    Q["outlier_report"] = q_outlier_report

    def flags(s, sf):
        f = outliers.outlier_flags(_t(s, sf, "events"), "value")
        return r6(f.select("event_id", "value", "lower", "upper", "side"))
    Q["outlier_flags"] = flags

    Q["uniqueness"] = lambda s, sf: r6(quality.uniqueness(events_dup(s, sf)))
    Q["distinct_counts"] = lambda s, sf: quality.distinct_counts(events_dirty(s, sf))
    Q["consistency_score"] = lambda s, sf: r6(quality.consistency_score(_t(s, sf, "part")))
    Q["validity_score"] = lambda s, sf: r6(quality.validity_score(_t(s, sf, "customer"), ["c_acctbal"]))
    Q["quality_summary"] = lambda s, sf: r6(quality.quality_summary(events_dirty(s, sf)))

    def ev(s, sf):
        return _t(s, sf, "events")
    Q["row_index"] = lambda s, sf: rolling.row_index(ev(s, sf), EV_ORDER).select("event_id", "idx")
    Q["row_index_by_user"] = lambda s, sf: rolling.row_index(ev(s, sf), EV_ORDER, ["user_id"]).select(
        "event_id", "user_id", "idx")
    Q["rolling"] = lambda s, sf: r6(rolling.rolling(ev(s, sf), "value", EV_ORDER))
    Q["rolling_by_user"] = lambda s, sf: r6(rolling.rolling(ev(s, sf), "value", EV_ORDER, ["user_id"]))
    Q["rolling_summary"] = lambda s, sf: r6(rolling.rolling_summary(ev(s, sf), "value", EV_ORDER))
    Q["linear_trend"] = lambda s, sf: r6(trend.linear_trend(ev(s, sf), "value", EV_ORDER))
    Q["trend_band"] = lambda s, sf: r6(trend.trend_band(ev(s, sf), "value", EV_ORDER))
    Q["seasonal_decompose"] = lambda s, sf: r6(seasonal.seasonal_decompose(
        daily_quantity(s, sf), "qty", ["l_shipdate"]))
    Q["seasonal_summary"] = lambda s, sf: r6(seasonal.seasonal_summary(
        daily_quantity(s, sf), "qty", ["l_shipdate"]))
    Q["change_points"] = lambda s, sf: r6(changepoint.change_points(ev(s, sf), "value", EV_ORDER))
    Q["change_point_count"] = lambda s, sf: changepoint.change_point_count(ev(s, sf), "value", EV_ORDER)
    Q["change_points_by_type"] = lambda s, sf: r6(changepoint.change_points(ev(s, sf), "value", EV_ORDER,
                                                                          by=["event_type"]))
    Q["df_test"] = lambda s, sf: r6(stationarity.df_test(ev(s, sf), "value", EV_ORDER))
    Q["adf_test_lag1"] = lambda s, sf: r6(stationarity.adf_test(events_plain_null_key(s, sf), "value", EV_ORDER, ["event_type"],
                                                               max_lag=1, autolag=False))
    Q["adf_test"] = lambda s, sf: r6(stationarity.adf_test(daily_quantity(s, sf), "qty", ["l_shipdate"]))

    # group keys that are NULL are groups; an extreme value doesn't disturb quantiles
    by = ["event_type"]
    Q["row_index_null_key"] = lambda s, sf: rolling.row_index(events_plain_null_key(s, sf), EV_ORDER, by).select(
        "event_id", "event_type", "idx")
    Q["rolling_null_key"] = lambda s, sf: r10(rolling.rolling(events_null_key(s, sf), "value", EV_ORDER, by))
    Q["trend_band_null_key"] = lambda s, sf: r6(trend.trend_band(events_plain_null_key(s, sf), "value", EV_ORDER, by))
    Q["change_points_null_key"] = lambda s, sf: r10(changepoint.change_points(events_null_key(s, sf), "value", EV_ORDER, by, window=30))
    Q["change_points_extreme"] = lambda s, sf: r10(changepoint.change_points(events_null_key(s, sf), "value", EV_ORDER, window=30))
    Q["change_point_count_by_user"] = lambda s, sf: changepoint.change_point_count(ev(s, sf), "value", EV_ORDER, ["user_id"], k=2.5)
    Q["outlier_report_null_key"] = lambda s, sf: r6(outliers.outlier_report(events_null_key(s, sf), ["value"], by))
    Q["box_stats_null_key"] = lambda s, sf: r6(distribution.box_stats(events_null_key(s, sf), "value", by))
    Q["histogram_null_key"] = lambda s, sf: r6(distribution.histogram(events_plain_null_key(s, sf), "value", by))
    Q["histogram_runs"] = lambda s, sf: r10(distribution.histogram_runs(events_null_key(s, sf), "value"))
    Q["histogram_runs_null_key"] = lambda s, sf: r10(distribution.histogram_runs(events_null_key(s, sf), "value", by))
    Q["iqr_bounds_extreme"] = lambda s, sf: r6(outliers.iqr_bounds(events_null_key(s, sf), ["value"]))

    def csv_roundtrip(s, sf):
        src = ev(s, sf).select("event_id", F.col("ts").alias("event_time"), "user_id", "event_type", "value", "props")
        path = files.export_csv(src, scratch_path(s, "events-csv"))
        return r6(files.load_csv(s, path, dates=True))
    Q["csv_roundtrip"] = csv_roundtrip

    def csv_documents(s, sf):
        """Texts with line breaks and quotes, out to CSV and back."""
        src = _t(s, sf, "documents")
        return files.load_csv(s, files.export_csv(src, scratch_path(s, "documents-csv")))
    Q["csv_documents"] = csv_documents

    def us_dates(s, sf):
        d = _t(s, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "MM/dd/yyyy").alias("order_date"),
                                       F.date_format("o_orderdate", "dd.MM.yyyy HH:mm").alias("ship_time"))
        return files.infer_dates(d)
    Q["infer_dates_us"] = us_dates

    def dates(s, sf):
        text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        d = ev(s, sf).select("event_id", text.alias("event_time"),
                             F.when(F.col("event_id") % 97 == 0, F.lit("not a date")).otherwise(text).alias("bad_date"))
        return files.infer_dates(d)
    Q["infer_dates"] = dates
    Q["load_any"] = lambda s, sf: r6(files.load_any(s, f"{sf}/lineitem.parquet"))

    def labelled(s, sf):
        return _t(s, sf, "labels").join(_t(s, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    Q["confusion_matrix"] = lambda s, sf: evaluation.confusion_matrix(_t(s, sf, "labels"), "quality", "toxic")
    Q["class_report"] = lambda s, sf: r6(evaluation.class_report(_t(s, sf, "labels"), "quality", "toxic"))
    Q["roc_curve"] = lambda s, sf: r6(evaluation.roc_curve(labelled(s, sf), "quality", "n_chars"))
    Q["roc_auc"] = lambda s, sf: r6(evaluation.roc_auc(labelled(s, sf), "quality", "n_chars"))

    def reg(s, sf):
        li = _t(s, sf, "lineitem").join(_t(s, sf, "part").select("p_partkey", "p_retailprice"),
                                        F.col("l_partkey") == F.col("p_partkey"))
        m = evaluation.regression_metrics(li.withColumn("pred", F.col("l_quantity") * F.col("p_retailprice")),
                                          "l_extendedprice", "pred")
        return r6(m.withColumn("mse", F.round("mse", 2)))
    Q["regression_metrics"] = reg

    def forest(s, sf):
        """The quality label from numbers of the document and its language."""
        text = F.coalesce("text", F.lit(""))
        letters = F.length(F.regexp_replace(text, r"[^\p{L} ]", ""))
        d = _t(s, sf, "documents").select("doc_id", "lang", "n_chars", F.size(F.split(text, " ")).alias("n_words"), F.size(F.split(text, "\n")).alias("n_lines"),
                                          F.try_divide(letters, F.length(text)).alias("letters"),
                                          F.try_divide(F.length(text), F.size(F.split(text, " "))).alias("word_length"))
        return r6(modelling.fit_evaluate(_t(s, sf, "labels").select("doc_id", "quality").join(d, "doc_id"), "quality", "doc_id"))
    Q["fit_evaluate"] = forest
    # whole-table reports of each group
    Q["duplicate_count_by_type"] = lambda s, sf: profile.duplicate_count(events_dup(s, sf), by)
    Q["distinct_counts_by_type"] = lambda s, sf: quality.distinct_counts(events_dirty(s, sf), by=by)
    Q["table_profile_by_type"] = lambda s, sf: r6(profile.table_profile(events_dirty(s, sf), by))
    Q["quality_summary_by_type"] = lambda s, sf: r6(quality.quality_summary(events_dirty(s, sf), by=by))
    Q["roc_auc_by_lang"] = lambda s, sf: r6(evaluation.roc_auc(
        _t(s, sf, "labels").join(_t(s, sf, "documents").select("doc_id", "n_chars", "lang"), "doc_id"), "quality", "n_chars", ["lang"]))
    Q["regression_metrics_by_flag"] = lambda s, sf: r6(evaluation.regression_metrics(
        _t(s, sf, "lineitem").withColumn("pred", F.col("l_quantity") * 1400.0), "l_extendedprice", "pred", ["l_returnflag"]).withColumn("mse", F.round("mse", 2)))
    Q["k_fold"] = lambda s, sf: evaluation.k_fold(_t(s, sf, "orders"), "o_orderkey").groupBy("fold").count()
    Q["train_test_split"] = lambda s, sf: (evaluation.train_test_split(_t(s, sf, "orders"), "o_orderkey")
                                           .groupBy("is_test").count())

    Q["corr_matrix"] = lambda s, sf: r6(correlation.corr_matrix(lineitem_corr(s, sf), CORR_COLS))
    Q["corr_ci"] = lambda s, sf: r6(correlation.corr_test(lineitem_corr(s, sf), CORR_COLS).drop("p_value"))
    Q["corr_pvalue"] = lambda s, sf: r6(correlation.corr_test(lineitem_corr(s, sf), CORR_COLS))
    Q["significant_corrs"] = lambda s, sf: r6(correlation.significant_corrs(lineitem_corr(s, sf), CORR_COLS)
                                              .drop("p_value"))
    Q["mean_ci"] = lambda s, sf: r6(distribution.mean_ci(ev(s, sf), "value"))
    Q["mean_ci_by_type"] = lambda s, sf: r6(distribution.mean_ci(ev(s, sf), "value", by=["event_type"]))
    Q["histogram"] = lambda s, sf: r6(distribution.histogram(ev(s, sf), "value"))
    Q["kde_curve"] = lambda s, sf: r6(distribution.kde_curve(ev(s, sf), "value"))
    Q["box_stats"] = lambda s, sf: r6(distribution.box_stats(ev(s, sf), "value"))
    Q["box_stats_by_type"] = lambda s, sf: r6(distribution.box_stats(ev(s, sf), "value", by=["event_type"]))
    Q["standardize"] = lambda s, sf: r6(pca.standardize(_t(s, sf, "lineitem"),
                                                        ["l_quantity", "l_extendedprice", "l_discount"],
                                                        keep=["l_orderkey", "l_linenumber"]))
    Q["pca_variance"] = lambda s, sf: r6(pca.pca_variance(_t(s, sf, "lineitem"), ["l_quantity", "l_extendedprice"]))
    PCA_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    Q["pca_loadings"] = lambda s, sf: pca.pca_loadings(_t(s, sf, "lineitem"), PCA_COLS)
    Q["pca_scores"] = lambda s, sf: pca.pca_scores(_t(s, sf, "lineitem"), PCA_COLS, keep=["l_orderkey", "l_linenumber"]).select(
        "l_orderkey", "l_linenumber", *[F.round(f"pc{j}", 4).alias(f"pc{j}") for j in range(1, 5)])
    Q["pca_n95"] = lambda s, sf: pca.pca_n95(_t(s, sf, "lineitem"), PCA_COLS)
    return Q


# SURVEY section 2 keys that are columns of a combined operator: the query is
# the projection of that operator's result (and the oracle the same
# projection of its SQL twin).
PROJECTIONS = {
    "rolling_mean": ("rolling", ["ts", "event_id", "idx", "rolling_mean"]),
    "rolling_std": ("rolling", ["ts", "event_id", "idx", "rolling_std"]),
    "rolling_ci": ("rolling", ["ts", "event_id", "idx", "ci_lower", "ci_upper"]),
    "rolling_ci_width": ("rolling_summary", ["ci_width_pct"]),
    "volatility_status": ("rolling_summary", ["volatility_status"]),
    "trend_direction": ("rolling_summary", ["trend_direction"]),
    "volatility_pattern": ("rolling_summary", ["volatility_pattern"]),
    "trend_strength": ("linear_trend", ["slope", "std_pop", "trend_strength", "direction"]),
    "seasonal_strength": ("seasonal_summary", ["seasonal_strength", "seasonal_label"]),
    "trend_clarity": ("seasonal_summary", ["trend_clarity"]),
    "residual_pattern": ("seasonal_summary", ["resid_skew", "residual_pattern"]),
    "corr_heatmap": ("corr_ci", ["var1", "var2", "corr", "ci_low", "ci_high"]),
    "load_csv": ("csv_roundtrip", ["event_id", "event_time", "user_id", "event_type", "value", "props"]),
    "export_csv": ("csv_roundtrip", ["event_id", "value"]),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    Q = _queries()
    if llm:
        Q |= llm.QUERIES | {"pipeline": corpus_pipeline.run}
    for name, (base, cols) in PROJECTIONS.items():
        Q[name] = (lambda b, c: lambda s, sf: Q[b](s, sf).select(*c))(base, cols)
    return Q


def oracle_sql() -> dict[str, str]:
    """DuckDB twins of ``queries()`` (views over the parquet tables)."""
    S = _oracle_sql()
    if llm:
        S |= llm.ORACLE_SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
    for name, (base, cols) in PROJECTIONS.items():
        S[name] = f"SELECT {', '.join(cols)} FROM ({S[base]}) AS t"
    return S


def _oracle_sql() -> dict[str, str]:
    D = EVENTS_DIRTY_SQL
    U = EVENTS_DUP_SQL
    L = _lineitem_long_sql()
    S: dict[str, str] = {}

    S["column_roles"] = f"""SELECT CAST(ordinal_position - 1 AS INTEGER) AS position, column_name,
        {_SPARK_TYPE_SQL} AS data_type, {_role_sql()} AS role
        FROM information_schema.columns WHERE table_name = 'lineitem'"""
    S["shape"] = """SELECT (SELECT count(*) FROM lineitem) AS n_rows,
        (SELECT CAST(count(*) AS INTEGER) FROM information_schema.columns WHERE table_name = 'lineitem') AS n_columns"""

    nulls = f"""nulls AS (
        SELECT 0 AS position, 'event_id' AS column_name, 'bigint' AS data_type, count(*) FILTER (WHERE event_id IS NULL) AS nulls, count(*) AS n_rows FROM {D} d
        UNION ALL SELECT 1, 'ts', 'timestamp_ntz', count(*) FILTER (WHERE ts IS NULL), count(*) FROM {D} d
        UNION ALL SELECT 2, 'user_id', 'bigint', count(*) FILTER (WHERE user_id IS NULL), count(*) FROM {D} d
        UNION ALL SELECT 3, 'event_type', 'string', count(*) FILTER (WHERE event_type IS NULL), count(*) FROM {D} d
        UNION ALL SELECT 4, 'value', 'double', count(*) FILTER (WHERE value IS NULL), count(*) FROM {D} d
        UNION ALL SELECT 5, 'props', 'string', count(*) FILTER (WHERE props IS NULL), count(*) FROM {D} d)"""
    sizes = f"""sizes AS (
        SELECT 0 AS position, 'event_id' AS column_name, CAST(8 * count(event_id) AS BIGINT) AS bytes FROM {D} d
        UNION ALL SELECT 1, 'ts', CAST(8 * count(ts) AS BIGINT) FROM {D} d
        UNION ALL SELECT 2, 'user_id', CAST(8 * count(user_id) AS BIGINT) FROM {D} d
        UNION ALL SELECT 3, 'event_type', CAST(coalesce(sum(strlen(event_type)), 0) AS BIGINT) FROM {D} d
        UNION ALL SELECT 4, 'value', CAST(8 * count(value) AS BIGINT) FROM {D} d
        UNION ALL SELECT 5, 'props', CAST(coalesce(sum(strlen(props)), 0) AS BIGINT) FROM {D} d)"""
    dupd = f"""dupd AS (SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicates FROM
        (SELECT count(*) AS c FROM {D} d GROUP BY ALL_COLS_D))"""
    dupd = dupd.replace("ALL_COLS_D", "event_id, ts, user_id, event_type, value, props")
    S["table_profile"] = f"""WITH {nulls}, {sizes}, {dupd}
        SELECT (SELECT max(n_rows) FROM nulls) AS n_rows, 6 AS n_columns, 3 AS n_numerical,
          2 AS n_categorical, (SELECT duplicates FROM dupd) AS duplicates,
          round((SELECT sum(bytes) FROM sizes) / (1024.0 * 1024.0), 6) AS size_mb,
          CAST((SELECT sum(nulls) FROM nulls) AS BIGINT) AS total_missing,
          round((SELECT avg((n_rows - nulls) / n_rows * 100.0) FROM nulls), 6) AS completeness_pct"""
    S["column_info"] = f"""WITH {nulls} SELECT position, column_name, data_type,
        n_rows - nulls AS non_null, nulls FROM nulls"""
    S["missing_summary"] = f"""WITH {nulls} SELECT column_name, nulls AS missing,
        round(nulls / n_rows * 100.0, 6) AS missing_pct FROM nulls WHERE nulls > 0"""
    moments = {"event_id": "event_id", "user_id": "user_id", "value": "value"}
    S["state_info"] = f"WITH {nulls}, m AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, avg({c}) AS mean, stddev_samp({c}) AS std, min({c})::DOUBLE AS least, max({c})::DOUBLE AS most FROM {D} d" for c in moments) + """)
        SELECT position, column_name, data_type, n_rows, n_rows - nulls AS non_null, nulls, round(mean, 6) AS mean, round(std, 6) AS std,
          round(least, 6) AS least, round(most, 6) AS most FROM nulls LEFT JOIN m USING (column_name)"""
    S["state_missing"] = S["missing_summary"]
    S["state_profile"] = f"""WITH {nulls}, {sizes} SELECT (SELECT max(n_rows) FROM nulls) AS n_rows, 6::BIGINT AS n_columns, 3::BIGINT AS n_numerical, 2::BIGINT AS n_categorical,
          round((SELECT sum(bytes) FROM sizes) / (1024.0 * 1024.0), 6) AS size_mb, CAST((SELECT sum(nulls) FROM nulls) AS BIGINT) AS total_missing,
          round((SELECT avg((n_rows - nulls) / n_rows * 100.0) FROM nulls), 6) AS completeness_pct"""
    S["state_distinct"] = f"SELECT 'event_type' AS column_name, count(DISTINCT event_type) AS approx_distinct FROM {D} d"
    S["missing_topk"] = f"""WITH {nulls} SELECT column_name, nulls AS missing,
        round(nulls / n_rows * 100.0, 6) AS missing_pct FROM nulls WHERE nulls > 0
        ORDER BY missing_pct DESC, column_name LIMIT 10"""
    S["missing_pattern"] = f"""SELECT pattern, count(*) AS n_rows,
        CAST(length(pattern) - length(replace(pattern, '1', '')) AS INTEGER) AS n_missing FROM (
        SELECT (CASE WHEN event_id IS NULL THEN '1' ELSE '0' END) || (CASE WHEN ts IS NULL THEN '1' ELSE '0' END)
          || (CASE WHEN user_id IS NULL THEN '1' ELSE '0' END) || (CASE WHEN event_type IS NULL THEN '1' ELSE '0' END)
          || (CASE WHEN value IS NULL THEN '1' ELSE '0' END) || (CASE WHEN props IS NULL THEN '1' ELSE '0' END) AS pattern
        FROM {D} d) GROUP BY pattern"""
    S["completeness"] = f"""WITH {nulls} SELECT round(avg((n_rows - nulls) / n_rows * 100.0), 6) AS completeness_pct FROM nulls"""
    S["duplicate_count"] = f"""SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicates,
        CAST(coalesce(sum(c), 0) AS BIGINT) AS n_rows FROM
        (SELECT count(*) AS c FROM {U} u GROUP BY user_id, event_type, v10)"""
    S["logical_size"] = f"WITH {sizes} SELECT position, column_name, bytes FROM sizes"
    S["head"] = "SELECT event_id, ts, user_id, event_type, round(value, 6) AS value, props FROM events ORDER BY ts, event_id LIMIT 10"
    S["tail"] = "SELECT event_id, ts, user_id, event_type, round(value, 6) AS value, props FROM events ORDER BY ts DESC, event_id DESC LIMIT 10"
    S["drop_missing"] = f"""SELECT event_id, ts, user_id, event_type, round(value, 6) AS value, props FROM {D} d
        WHERE event_id IS NOT NULL AND ts IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL
          AND value IS NOT NULL AND props IS NOT NULL"""
    S["select_columns"] = "SELECT l_orderkey, l_linenumber, round(l_quantity, 6) AS l_quantity FROM lineitem"
    S["sort_by_date"] = """SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice,
        o_orderdate, o_orderpriority FROM orders ORDER BY o_orderdate, o_orderkey"""
    S["zscore"] = """WITH s AS (SELECT avg(l_quantity) mq, stddev_pop(l_quantity) sq, avg(l_extendedprice) me,
          stddev_pop(l_extendedprice) se, avg(l_discount) md, stddev_pop(l_discount) sd FROM lineitem)
        SELECT l_orderkey, l_linenumber,
          round(CASE WHEN sq <> 0 THEN (l_quantity - mq) / sq END, 6) AS z_l_quantity,
          round(CASE WHEN se <> 0 THEN (l_extendedprice - me) / se END, 6) AS z_l_extendedprice,
          round(CASE WHEN sd <> 0 THEN (l_discount - md) / sd END, 6) AS z_l_discount
        FROM lineitem, s"""
    stats = f"""long AS {L}, st AS (SELECT column_name, count(value) AS n, avg(value) AS mu, stddev_pop(value) AS sd,
          quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY column_name),
        cnt AS (SELECT l.column_name,
          count(*) FILTER (WHERE st.sd <> 0 AND abs((l.value - st.mu) / st.sd) > 3) AS z_outliers,
          count(*) FILTER (WHERE l.value < st.q1 - 1.5 * (st.q3 - st.q1) OR l.value > st.q3 + 1.5 * (st.q3 - st.q1)) AS iqr_outliers
          FROM long l JOIN st USING (column_name) GROUP BY l.column_name)"""
    S["zscore_outliers"] = f"WITH {stats} SELECT column_name, z_outliers FROM cnt"
    S["iqr_outliers"] = f"WITH {stats} SELECT column_name, iqr_outliers FROM cnt"
    S["iqr_bounds"] = f"""WITH {stats} SELECT column_name, n, round(q1, 6) AS q1, round(q3, 6) AS q3,
        round(q3 - q1, 6) AS iqr, round(q1 - 1.5 * (q3 - q1), 6) AS lower, round(q3 + 1.5 * (q3 - q1), 6) AS upper FROM st"""
    S["outlier_report"] = f"""WITH {stats}, pc AS (SELECT column_name, z_outliers, iqr_outliers,
          greatest(z_outliers, iqr_outliers) / (SELECT count(*) FROM lineitem) * 100.0 AS pct FROM cnt)
        SELECT column_name, z_outliers, iqr_outliers, round(round(pct, 2), 6) AS outlier_pct,
          CASE WHEN pct > 5 THEN 'High' WHEN pct > 1 THEN 'Medium' ELSE 'Low' END AS outlier_status FROM pc"""
    S["outlier_flags"] = """WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
        f AS (SELECT event_id, value, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM events, b)
        SELECT event_id, round(value, 6) AS value, round(lower, 6) AS lower,
          round(upper, 6) AS upper, CASE WHEN value < lower THEN 'low' ELSE 'high' END AS side
        FROM f WHERE value < lower OR value > upper"""
    S["duplicate_count_by_type"] = f"""SELECT event_type, CAST(sum(c - 1) AS BIGINT) AS duplicates, CAST(sum(c) AS BIGINT) AS n_rows FROM
        (SELECT event_type, count(*) AS c FROM {U} u GROUP BY user_id, event_type, v10) GROUP BY event_type"""
    S["distinct_counts_by_type"] = f"SELECT event_type, 'props' AS column_name, count(DISTINCT props) AS n_distinct FROM {D} d GROUP BY event_type"
    kept = ["event_id", "ts", "user_id", "value", "props"]
    full = " + ".join(f"count({c})" for c in kept) + ""
    S["table_profile_by_type"] = f"""SELECT event_type, count(*) AS n_rows, 5 AS n_columns, 3 AS n_numerical, 1 AS n_categorical, CAST(count(*) - count(DISTINCT event_id) AS BIGINT) AS duplicates,
          round((8 * (count(event_id) + count(ts) + count(user_id) + count(value)) + sum(coalesce(strlen(props), 0))) / (1024.0 * 1024.0), 6) AS size_mb,
          CAST(5 * count(*) - ({full}) AS BIGINT) AS total_missing, round(({full}) / (5.0 * count(*)) * 100.0, 6) AS completeness_pct FROM {D} d GROUP BY event_type"""
    S["quality_summary_by_type"] = f"""WITH g AS (SELECT event_type, ({full}) / (5.0 * count(*)) * 100.0 AS completeness,
          CASE WHEN count(DISTINCT props) > count(*) * 0.5 THEN 95.0 ELSE 100.0 END AS consistency FROM {D} d GROUP BY event_type),
        o AS (SELECT *, (completeness + 100.0 + consistency + 100.0) / 4.0 AS overall FROM g)
        SELECT event_type, round(completeness, 6) AS completeness, 100.0::DOUBLE AS uniqueness, consistency::DOUBLE AS consistency, 100.0::DOUBLE AS validity,
          round(overall, 6) AS overall, CASE WHEN overall >= 90 THEN 'Excellent' WHEN overall >= 75 THEN 'Good' ELSE 'Poor' END AS verdict FROM o"""
    S["roc_auc_by_lang"] = """WITH pts AS (SELECT lang, n_chars, count(*) FILTER (WHERE quality = 1) AS pos, count(*) FILTER (WHERE quality <> 1) AS neg
          FROM labels JOIN documents USING (doc_id) GROUP BY ALL),
        cum AS (SELECT *, sum(pos) OVER (PARTITION BY lang ORDER BY n_chars DESC) AS cp FROM pts)
        SELECT lang, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
          round(sum(neg * (cp - pos + 0.5 * pos)) / nullif(sum(pos) * sum(neg), 0), 6) AS auc FROM cum GROUP BY lang"""
    S["regression_metrics_by_flag"] = """WITH p AS (SELECT l_returnflag, l_extendedprice AS y, l_extendedprice - l_quantity * 1400.0::DOUBLE AS e FROM lineitem)
        SELECT l_returnflag, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(avg(e * e), 2) AS mse, round(sqrt(avg(e * e)), 6) AS rmse,
          round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2 FROM p GROUP BY l_returnflag"""
    S["uniqueness"] = f"""WITH g AS (SELECT count(*) AS c FROM {U} u GROUP BY user_id, event_type, v10),
        t AS (SELECT CAST(sum(c - 1) AS BIGINT) AS duplicates, CAST(sum(c) AS BIGINT) AS n_rows FROM g)
        SELECT duplicates, n_rows, round((1.0 - duplicates / n_rows) * 100.0, 6) AS uniqueness_pct FROM t"""
    S["distinct_counts"] = f"""SELECT 'event_type' AS column_name, count(DISTINCT event_type) AS n_distinct FROM {D} d
        UNION ALL SELECT 'props', count(DISTINCT props) FROM {D} d"""
    S["consistency_score"] = """WITH n AS (SELECT count(*) AS n_rows FROM part),
        d AS (SELECT count(DISTINCT p_name) AS a, count(DISTINCT p_brand) AS b, count(DISTINCT p_type) AS c FROM part),
        f AS (SELECT n_rows, CAST((a > n_rows * 0.5)::INT + (b > n_rows * 0.5)::INT + (c > n_rows * 0.5)::INT AS BIGINT) AS k FROM n, d)
        SELECT n_rows, k AS n_high_cardinality, round(greatest(100.0 - 5.0 * k, 0.0), 6) AS consistency FROM f"""
    S["validity_score"] = """WITH f AS (SELECT CAST(coalesce(bool_or(c_acctbal < 0), false) AS BIGINT) AS k FROM customer)
        SELECT k AS n_invalid_columns, round(greatest(100.0 - 10.0 * k, 0.0), 6) AS validity FROM f"""
    S["quality_summary"] = f"""WITH {nulls}, {dupd},
        comp AS (SELECT avg((n_rows - nulls) / n_rows * 100.0) AS completeness FROM nulls),
        uniq AS (SELECT (1.0 - (SELECT duplicates FROM dupd) / (SELECT count(*) FROM {D} d)) * 100.0 AS uniqueness),
        nn AS (SELECT count(*) AS n FROM {D} d),
        cons AS (SELECT greatest(100.0 - 5.0 * (
            CAST((SELECT count(DISTINCT event_type) FROM {D} d) > (SELECT n FROM nn) * 0.5 AS INT)
          + CAST((SELECT count(DISTINCT props) FROM {D} d) > (SELECT n FROM nn) * 0.5 AS INT)), 0.0) AS consistency),
        al AS (SELECT completeness, uniqueness, consistency, 100.0 AS validity FROM comp, uniq, cons)
        SELECT round(completeness, 6) AS completeness, round(uniqueness, 6) AS uniqueness,
          round(consistency, 6) AS consistency, round(validity, 6) AS validity,
          round((completeness + uniqueness + consistency + validity) / 4.0, 6) AS overall,
          CASE WHEN (completeness + uniqueness + consistency + validity) / 4.0 >= 90 THEN 'Excellent'
               WHEN (completeness + uniqueness + consistency + validity) / 4.0 >= 75 THEN 'Good' ELSE 'Poor' END AS verdict
        FROM al"""

    ordered = """(SELECT ts, event_id, user_id, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx,
        count(*) OVER () AS n FROM events)"""
    S["row_index"] = "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx FROM events"
    S["row_index_by_user"] = """SELECT event_id, user_id,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events"""
    roll = f"""b AS (SELECT ts, event_id, user_id, value, row_number() OVER (PARTITION BY _PK_ ORDER BY ts, event_id) - 1 AS idx,
          count(*) OVER (PARTITION BY _PK_) AS n FROM events),
        c AS (SELECT *, CASE WHEN n > 10 THEN least(30, n // 10) ELSE 0 END AS w FROM b),
        r AS (SELECT *, count(value) OVER fr AS wc, avg(value) OVER fr AS wm, stddev_samp(value) OVER fr AS ws FROM c
          WINDOW fr AS (PARTITION BY _PK_ ORDER BY idx ROWS BETWEEN greatest(w, 1) // 2 PRECEDING AND (greatest(w, 1) - 1) // 2 FOLLOWING)),
        m AS (SELECT *, CASE WHEN w > 0 AND wc = w THEN wm END AS rm, CASE WHEN w > 0 AND wc = w THEN ws END AS rs FROM r),
        o AS (SELECT *, rm - {Z95} * rs / sqrt(w) AS lo, rm + {Z95} * rs / sqrt(w) AS hi FROM m)"""
    cols = """ts, event_id, idx, round(value, 6) AS value, w AS window_size,
        round(rm, 6) AS rolling_mean, round(rs, 6) AS rolling_std, round(lo, 6) AS ci_lower, round(hi, 6) AS ci_upper"""
    S["rolling"] = f"WITH {roll.replace('PARTITION BY _PK_', '').replace('(PARTITION BY _PK_)', '()')} SELECT {cols} FROM o"
    S["rolling_by_user"] = f"WITH {roll.replace('_PK_', 'user_id')} SELECT user_id, {cols} FROM o"
    S["rolling_summary"] = f"""WITH {roll.replace('PARTITION BY _PK_', '')},
        f AS (SELECT max(w) AS w, avg(rm) AS mm, avg(rs) AS ms, avg(hi - lo) AS mw,
          arg_min(rm, idx) FILTER (WHERE rm IS NOT NULL) AS fm, arg_max(rm, idx) FILTER (WHERE rm IS NOT NULL) AS lm, count(rm) AS nm,
          arg_min(rs, idx) FILTER (WHERE rs IS NOT NULL) AS fs, arg_max(rs, idx) FILTER (WHERE rs IS NOT NULL) AS ls, count(rs) AS ns FROM o)
        SELECT w AS window_size, round(mm, 6) AS mean_rolling_mean, round(ms, 6) AS mean_rolling_std,
          round(CASE WHEN mm <> 0 THEN mw / mm * 100.0 ELSE 0.0 END, 6) AS ci_width_pct,
          CASE WHEN ms < mm * 0.1 THEN 'Stable' ELSE 'Volatile' END AS volatility_status,
          CASE WHEN nm < 2 THEN 'Insufficient data' WHEN lm > fm * 1.1 THEN 'Strongly Increasing'
            WHEN lm > fm * 1.02 THEN 'Moderately Increasing' WHEN lm < fm * 0.9 THEN 'Strongly Decreasing'
            WHEN lm < fm * 0.98 THEN 'Moderately Decreasing' ELSE 'Relatively Stable' END AS trend_direction,
          CASE WHEN ns < 2 THEN 'Insufficient data' WHEN ls > fs * 1.1 THEN 'Increasing'
            WHEN ls < fs * 0.9 THEN 'Decreasing' ELSE 'Stable' END AS volatility_pattern FROM f"""
    fit = f"""fit AS (SELECT CAST(regr_count(value, idx) AS BIGINT) AS n, regr_slope(value, idx) AS slope,
          regr_intercept(value, idx) AS intercept, regr_r2(value, idx) AS r2, regr_avgx(value, idx) AS xbar,
          regr_sxx(value, idx) AS sxx, regr_syy(value, idx) AS syy, stddev_pop(value) AS sp FROM {ordered} o)"""
    S["linear_trend"] = f"""WITH {fit} SELECT n, round(slope, 6) AS slope, round(intercept, 6) AS intercept,
        round(r2, 6) AS r_squared, round(sp, 6) AS std_pop,
        CASE WHEN abs(slope) > sp * 0.1 THEN 'Strong' ELSE 'Weak' END AS trend_strength,
        CASE WHEN slope > 0 THEN 'Increasing' WHEN slope < 0 THEN 'Decreasing' ELSE 'Stable' END AS direction FROM fit"""
    S["trend_band"] = f"""WITH {fit}, g AS (SELECT *, sqrt(syy * (1 - r2) / n) AS sigma, {_t_sql('n - 2')} AS t FROM fit),
        rows AS (SELECT o.ts, o.event_id, o.idx, o.value, g.intercept + g.slope * o.idx AS fitted,
          g.t * g.sigma * sqrt(1.0 / g.n + (o.idx - g.xbar) ^ 2 / g.sxx) AS half FROM {ordered} o, g)
        SELECT ts, event_id, idx, round(value, 6) AS value, round(fitted, 6) AS fitted, round(value - fitted, 6) AS residual,
          round(half, 6) AS half_width, round(fitted - half, 6) AS lower, round(fitted + half, 6) AS upper FROM rows"""
    dec = f"""b AS (SELECT l_shipdate, qty AS observed, row_number() OVER (ORDER BY l_shipdate) - 1 AS idx,
          count(*) OVER () AS n FROM {DAILY_QTY_SQL} d WHERE qty IS NOT NULL),
        ma AS (SELECT *, CASE WHEN count(observed) OVER fr = 13 THEN (sum(observed) OVER fr - 0.5 * first_value(observed) OVER fr
            - 0.5 * last_value(observed) OVER fr) / 12 END AS t FROM b
          WINDOW fr AS (ORDER BY idx ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)),
        ends AS (SELECT regr_slope(t, idx) FILTER (WHERE idx >= 6 AND idx < least(18, n - 7)) AS fs,
          regr_intercept(t, idx) FILTER (WHERE idx >= 6 AND idx < least(18, n - 7)) AS fi,
          regr_slope(t, idx) FILTER (WHERE idx >= greatest(6, n - 7 - 12) AND idx < n - 7) AS bs,
          regr_intercept(t, idx) FILTER (WHERE idx >= greatest(6, n - 7 - 12) AND idx < n - 7) AS bi FROM ma),
        tr AS (SELECT ma.*, CASE WHEN t IS NOT NULL THEN t WHEN idx < 6 THEN fi + fs * idx ELSE bi + bs * idx END AS trend
          FROM ma, ends),
        ph AS (SELECT idx % 12 AS phase, avg(observed - trend) AS pa FROM tr GROUP BY 1),
        ph2 AS (SELECT phase, pa - (SELECT avg(pa) FROM ph) AS seasonal FROM ph),
        dd AS (SELECT tr.l_shipdate, tr.idx, tr.observed, tr.trend, ph2.seasonal, tr.observed - tr.trend - ph2.seasonal AS resid
          FROM tr JOIN ph2 ON tr.idx % 12 = ph2.phase)"""
    S["seasonal_decompose"] = f"""WITH {dec} SELECT l_shipdate, idx, round(observed, 6) AS observed, round(trend, 6) AS trend,
        round(seasonal, 6) AS seasonal, round(resid, 6) AS resid FROM dd"""
    S["seasonal_summary"] = f"""WITH {dec}, a AS (SELECT count(*) AS n, var_samp(resid) AS vr, var_samp(observed) AS vo,
          stddev_samp(trend) AS st, stddev_samp(observed) AS so, skewness(resid) AS sk FROM dd),
        b2 AS (SELECT *, greatest(0.0, 1 - vr / vo) AS ss FROM a)
        SELECT n, 12 AS period, round(ss, 6) AS seasonal_strength,
          CASE WHEN ss > 0.6 THEN 'Strong' WHEN ss > 0.3 THEN 'Moderate' ELSE 'Weak' END AS seasonal_label,
          CASE WHEN st > so * 0.1 THEN 'Clear' ELSE 'Subtle' END AS trend_clarity, round(sk, 6) AS resid_skew,
          CASE WHEN abs(sk) < 1 THEN 'Random' ELSE 'Systematic' END AS residual_pattern FROM b2"""
    cp = """b AS (SELECT ts, event_id, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx, count(*) OVER () AS n
          FROM events WHERE value IS NOT NULL),
        c AS (SELECT *, n // 10 AS w FROM b WHERE n >= 20),
        r AS (SELECT *, count(value) OVER fr AS wc, avg(value) OVER fr AS wm, stddev_samp(value) OVER fr AS ws FROM c
          WINDOW fr AS (ORDER BY idx ROWS BETWEEN w // 2 PRECEDING AND (w - 1) // 2 FOLLOWING)),
        m AS (SELECT *, CASE WHEN wc = w THEN wm END AS rm, CASE WHEN wc = w THEN ws END AS rs FROM r),
        z AS (SELECT *, CASE WHEN rs <> 0 THEN abs((value - rm) / rs) END AS z FROM m)"""
    S["change_points"] = f"""WITH {cp} SELECT ts, event_id, idx, round(value, 6) AS value, w AS window_size,
        round(rm, 6) AS rolling_mean, round(rs, 6) AS rolling_std, round(z, 6) AS z FROM z WHERE z > 2"""
    S["change_point_count"] = f"WITH {cp} SELECT count(*) AS n_change_points FROM z WHERE z > 2"
    S["change_points_by_type"] = """WITH b AS (SELECT event_type, ts, event_id, value,
          row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx,
          count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
        c AS (SELECT *, n // 10 AS w FROM b WHERE n >= 20),
        r AS (SELECT *, count(value) OVER fr AS wc, avg(value) OVER fr AS wm, stddev_samp(value) OVER fr AS ws FROM c
          WINDOW fr AS (PARTITION BY event_type ORDER BY idx ROWS BETWEEN w // 2 PRECEDING AND (w - 1) // 2 FOLLOWING)),
        m AS (SELECT *, CASE WHEN wc = w THEN wm END AS rm, CASE WHEN wc = w THEN ws END AS rs FROM r),
        z AS (SELECT *, CASE WHEN rs <> 0 THEN abs((value - rm) / rs) END AS z FROM m)
        SELECT event_type, ts, event_id, idx, round(value, 6) AS value, w AS window_size,
          round(rm, 6) AS rolling_mean, round(rs, 6) AS rolling_std, round(z, 6) AS z FROM z WHERE z > 2"""
    S["df_test"] = """WITH b AS (SELECT value AS y, lag(value) OVER (ORDER BY ts, event_id) AS prev FROM events WHERE value IS NOT NULL),
        p AS (SELECT y - prev AS dy, prev FROM b WHERE prev IS NOT NULL),
        a AS (SELECT CAST(regr_count(dy, prev) AS BIGINT) AS n, regr_slope(dy, prev) AS g, regr_sxx(dy, prev) AS sxx,
          regr_syy(dy, prev) AS syy, regr_r2(dy, prev) AS r2 FROM p),
        s AS (SELECT *, sqrt(syy * (1 - r2) / (n - 2) / sxx) AS se FROM a)
        SELECT n, round(g, 6) AS gamma, round(se, 6) AS se, round(g / se, 6) AS tau FROM s"""

    S["csv_roundtrip"] = """SELECT event_id, ts AS event_time, user_id, event_type, round(value, 6) AS value, props FROM events"""
    S["infer_dates"] = """SELECT event_id, ts AS event_time,
        CASE WHEN event_id % 97 = 0 THEN 'not a date' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS bad_date FROM events"""
    S["load_any"] = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_quantity, 6) AS l_quantity,
        round(l_extendedprice, 6) AS l_extendedprice, round(l_discount, 6) AS l_discount, round(l_tax, 6) AS l_tax,
        l_returnflag, l_linestatus, l_shipdate FROM lineitem"""

    S["confusion_matrix"] = "SELECT quality AS label, toxic AS prediction, count(*) AS count FROM labels GROUP BY ALL"
    S["class_report"] = """WITH cm AS (SELECT quality AS l, toxic AS p, count(*) AS c FROM labels GROUP BY ALL),
        cls AS (SELECT DISTINCT CAST(l AS VARCHAR) AS class FROM cm UNION SELECT DISTINCT CAST(p AS VARCHAR) FROM cm),
        per AS (SELECT class, coalesce((SELECT sum(c) FROM cm WHERE CAST(l AS VARCHAR) = class), 0) AS support,
          coalesce((SELECT sum(c) FROM cm WHERE CAST(p AS VARCHAR) = class), 0) AS predicted,
          coalesce((SELECT sum(c) FROM cm WHERE l = p AND CAST(l AS VARCHAR) = class), 0) AS tp FROM cls),
        acc AS (SELECT sum(c) FILTER (WHERE l = p) / sum(c) AS accuracy FROM cm)
        SELECT class, CAST(support AS BIGINT) AS support, round(CASE WHEN predicted > 0 THEN tp / predicted END, 6) AS precision,
          round(CASE WHEN support > 0 THEN tp / support END, 6) AS recall,
          round(CASE WHEN predicted > 0 AND support > 0 AND tp > 0 THEN 2 * (tp / predicted) * (tp / support) / (tp / predicted + tp / support) END, 6) AS f1,
          round(accuracy, 6) AS accuracy FROM per, acc"""
    roc = """pts AS (SELECT CAST(n_chars AS DOUBLE) AS threshold, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS pos,
          sum(CASE WHEN quality = 1 THEN 0 ELSE 1 END) AS neg FROM labels JOIN documents USING (doc_id) GROUP BY 1),
        cum AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn FROM pts
          WINDOW w AS (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
    S["roc_curve"] = f"""WITH {roc} SELECT round(threshold, 6) AS threshold, round(cn / (SELECT sum(neg) FROM pts), 6) AS fpr,
        round(cp / (SELECT sum(pos) FROM pts), 6) AS tpr FROM cum"""
    S["roc_auc"] = f"""WITH {roc} SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
        round(sum(neg * (cp - pos + 0.5 * pos)) / (sum(pos) * sum(neg)), 6) AS auc FROM cum"""
    S["regression_metrics"] = """WITH e AS (SELECT l_extendedprice AS y, l_extendedprice - l_quantity * p_retailprice AS e
          FROM lineitem JOIN part ON l_partkey = p_partkey)
        SELECT count(*) AS n, round(avg(abs(e)), 6) AS mae, round(avg(e * e), 2) AS mse, round(sqrt(avg(e * e)), 6) AS rmse,
          round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2 FROM e"""

    C = LINEITEM_CORR_SQL
    pairs = [(a, b) for a in CORR_COLS for b in CORR_COLS if a != b]
    corr_rows = " UNION ALL ".join(
        f"""SELECT '{a}' AS var1, '{b}' AS var2, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n,
            corr({a}, {b}) AS r FROM {C} c""" for a, b in pairs)
    diag_rows = " UNION ALL ".join(
        f"SELECT '{a}' AS var1, '{a}' AS var2, count({a}) AS n, 1.0 AS r FROM {C} c" for a in CORR_COLS)
    S["corr_matrix"] = f"""SELECT var1, var2, n, round(CASE WHEN n >= 3 THEN greatest(-1.0, least(1.0, r)) END, 6) AS corr
        FROM ({corr_rows} UNION ALL {diag_rows})"""
    ci = f"""cr AS (SELECT var1, var2, n, CASE WHEN n >= 3 THEN greatest(-1.0, least(1.0, r)) END AS r FROM ({corr_rows})),
        ci AS (SELECT *, CASE WHEN n = 3 THEN -1.0 ELSE tanh(atanh(r) - {Z95} / sqrt(n - 3)) END AS lo,
          CASE WHEN n = 3 THEN 1.0 ELSE tanh(atanh(r) + {Z95} / sqrt(n - 3)) END AS hi FROM cr)"""
    S["corr_ci"] = f"""WITH {ci} SELECT var1, var2, n, round(r, 6) AS corr, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high FROM ci
        UNION ALL SELECT var1, var2, n, 1.0, NULL, NULL FROM ({diag_rows})"""
    order = ", ".join(f"'{c}'" for c in CORR_COLS)
    S["significant_corrs"] = f"""WITH {ci}, ordn AS (SELECT unnest([{order}]) AS name, generate_subscripts([{order}], 1) AS pos)
        SELECT var1, var2, n, round(r, 6) AS corr, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high FROM ci
        JOIN ordn a ON a.name = var1 JOIN ordn b ON b.name = var2
        WHERE a.pos < b.pos AND r IS NOT NULL
          AND (abs(r) = 1 OR abs(r * sqrt((n - 2) / (1 - r * r))) > {_t_sql('n - 2')})"""
    mci = f"""SELECT CAST(count(value) AS BIGINT) AS n, avg(value) AS m, stddev_samp(value) AS sd FROM events"""
    mci_cols = f"""n, round(m, 6) AS mean, round(sd, 6) AS std, round(CASE WHEN n > 1 THEN sd / sqrt(n) END, 6) AS se,
        round(m - CASE WHEN n > 1 THEN {_t_sql('n - 1')} * sd / sqrt(n) ELSE 0 END, 6) AS ci_lower,
        round(m + CASE WHEN n > 1 THEN {_t_sql('n - 1')} * sd / sqrt(n) ELSE 0 END, 6) AS ci_upper"""
    S["mean_ci"] = f"SELECT {mci_cols} FROM ({mci})"
    S["mean_ci_by_type"] = f"SELECT event_type, {mci_cols} FROM ({mci.replace('FROM events', ', event_type FROM events GROUP BY event_type')})"
    S["histogram"] = """WITH v AS (SELECT value FROM events WHERE value IS NOT NULL),
        st AS (SELECT count(*) AS n, min(value) AS lo0, max(value) AS hi0, quantile_cont(value, 0.25) AS q1,
          quantile_cont(value, 0.75) AS q3 FROM v),
        w AS (SELECT *, (hi0 - lo0) / (log2(n) + 1.0) AS sturges, 2.0 * (q3 - q1) * pow(n, CAST(-1 AS DOUBLE) / 3.0) AS fd FROM st),
        b AS (SELECT CASE WHEN hi0 > lo0 THEN CAST(ceil((hi0 - lo0) / CASE WHEN fd > 0 THEN least(sturges, fd) ELSE sturges END) AS BIGINT)
            ELSE 1 END AS bins, CASE WHEN hi0 > lo0 THEN lo0 ELSE lo0 - 0.5 END AS lo,
            CASE WHEN hi0 > lo0 THEN hi0 ELSE hi0 + 0.5 END AS hi FROM w),
        c AS (SELECT least(CAST(floor((value - lo) / (hi - lo) * bins) AS BIGINT), bins - 1) AS bin, count(*) AS cnt FROM v, b GROUP BY 1),
        g AS (SELECT unnest(generate_series(0, bins - 1)) AS bin, lo, hi, bins FROM b)
        SELECT g.bin, round(lo + bin * ((hi - lo) / bins), 6) AS lower, round(lo + (bin + 1) * ((hi - lo) / bins), 6) AS upper,
          CAST(coalesce(cnt, 0) AS BIGINT) AS count FROM g LEFT JOIN c USING (bin)"""
    S["kde_curve"] = """WITH v AS (SELECT value AS x FROM events WHERE value IS NOT NULL),
        st AS (SELECT count(*) AS n, min(x) AS lo, max(x) AS hi, stddev_samp(x) * pow(count(*), -0.2) AS h FROM v),
        g AS (SELECT CAST(generate_series AS INTEGER) AS point FROM generate_series(0, 199))
        SELECT point, round(h, 6) AS bandwidth, round(lo + point * ((hi - lo) / 199.0), 6) AS x,
          round(sum(exp(-0.5 * pow((lo + point * ((hi - lo) / 199.0) - x) / h, 2))) / (n * h * sqrt(2 * pi())), 6) AS density
        FROM g, st, v GROUP BY point, lo, hi, h, n"""
    box = """WITH q AS (SELECT GKEY count(value) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med,
          quantile_cont(value, 0.75) AS q3 FROM events GBY),
        j AS (SELECT e.value, q.* FROM events e JOIN q ON JCOND WHERE e.value IS NOT NULL)
        SELECT GKEY 'value' AS column_name, CAST(max(n) AS BIGINT) AS n, round(max(q1), 6) AS q1, round(max(med), 6) AS median,
          round(max(q3), 6) AS q3, round(max(q3) - max(q1), 6) AS iqr,
          round(min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_low,
          round(max(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
          count(*) FILTER (WHERE NOT (value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1))) AS n_fliers FROM j GBY2"""
    S["box_stats"] = box.replace("GKEY ", "").replace("GBY2", "").replace("GBY", "").replace("JCOND", "true")
    S["box_stats_by_type"] = (box.replace("GKEY ", "event_type, ").replace("GBY2", "GROUP BY event_type")
                              .replace("GBY", "GROUP BY event_type").replace("JCOND", "e.event_type = q.event_type")
                              .replace("SELECT e.value, q.*", "SELECT e.value, q.n, q.q1, q.med, q.q3, q.event_type"))
    S["standardize"] = """WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount FROM lineitem
          WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND l_discount IS NOT NULL),
        s AS (SELECT avg(l_quantity) mq, stddev_pop(l_quantity) sq, avg(l_extendedprice) me, stddev_pop(l_extendedprice) se,
          avg(l_discount) md, stddev_pop(l_discount) sd FROM b)
        SELECT l_orderkey, l_linenumber, round(coalesce((l_quantity - mq) / nullif(sq, 0), 0), 6) AS l_quantity,
          round(coalesce((l_extendedprice - me) / nullif(se, 0), 0), 6) AS l_extendedprice,
          round(coalesce((l_discount - md) / nullif(sd, 0), 0), 6) AS l_discount FROM b, s"""
    S["pca_variance"] = """WITH r AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS a FROM lineitem
          WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL)
        SELECT 1 AS component, round((1 + a) / 2, 6) AS explained_variance_ratio, round((1 + a) / 2, 6) AS cumulative_ratio FROM r
        UNION ALL SELECT 2, round((1 - a) / 2, 6), 1.0 FROM r"""
    N, X = PLAIN_NULL_KEY_SQL, EVENTS_NULL_KEY_SQL
    S["row_index_null_key"] = f"""SELECT event_id, event_type,
        row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx FROM {N} e"""
    by_type = roll.replace("_PK_", "event_type").replace("event_id, user_id,", "event_id, event_type,").replace("FROM events", f"FROM {N} e")
    S["rolling_null_key"] = _r10_sql(f"WITH {by_type} SELECT event_type, {cols} FROM o".replace(f"FROM {N} e", f"FROM {X} e"),
                                     "value rolling_mean rolling_std ci_lower ci_upper")
    S["trend_band_null_key"] = f"""WITH o AS (SELECT ts, event_id, event_type, value,
          row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx FROM {N} e),
        fit AS (SELECT event_type, CAST(regr_count(value, idx) AS BIGINT) AS n, regr_slope(value, idx) AS slope,
          regr_intercept(value, idx) AS intercept, regr_r2(value, idx) AS r2, regr_avgx(value, idx) AS xbar,
          regr_sxx(value, idx) AS sxx, regr_syy(value, idx) AS syy FROM o GROUP BY event_type),
        g AS (SELECT *, sqrt(syy * (1 - r2) / n) AS sigma, {_t_sql('n - 2')} AS t FROM fit),
        rows AS (SELECT o.event_type, o.ts, o.event_id, o.idx, o.value, g.intercept + g.slope * o.idx AS fitted,
          g.t * g.sigma * sqrt(1.0 / g.n + (o.idx - g.xbar) ^ 2 / g.sxx) AS half FROM o JOIN g ON o.event_type IS NOT DISTINCT FROM g.event_type)
        SELECT event_type, ts, event_id, idx, round(value, 6) AS value, round(fitted, 6) AS fitted, round(value - fitted, 6) AS residual,
          round(half, 6) AS half_width, round(fitted - half, 6) AS lower, round(fitted + half, 6) AS upper FROM rows"""
    extreme = "value rolling_mean rolling_std z"
    S["change_points_null_key"] = _r10_sql(S["change_points_by_type"].replace("FROM events", f"FROM {X} e").replace("n // 10 AS w", "CAST(30 AS BIGINT) AS w"), extreme)
    S["change_points_extreme"] = _r10_sql(S["change_points"].replace("FROM events", f"FROM {X} e").replace("n // 10 AS w", "CAST(30 AS BIGINT) AS w"), extreme)
    S["change_point_count_by_user"] = (S["change_points_by_type"].replace("event_type", "user_id").split("SELECT user_id, ts, event_id, idx, round")[0]
        + "SELECT e.user_id, count(z.user_id) AS n_change_points FROM (SELECT DISTINCT user_id FROM events) e LEFT JOIN (SELECT * FROM z WHERE z > 2.5) z USING (user_id) GROUP BY e.user_id")
    S["outlier_report_null_key"] = f"""WITH e AS {X}, st AS (SELECT event_type, count(*) AS n, avg(value) AS mu, stddev_pop(value) AS sd,
          quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM e GROUP BY event_type),
        c AS (SELECT st.event_type, max(st.n) AS n, count(*) FILTER (WHERE sd <> 0 AND abs((value - mu) / sd) > 3) AS z_outliers,
          count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS iqr_outliers
          FROM e JOIN st ON e.event_type IS NOT DISTINCT FROM st.event_type GROUP BY st.event_type),
        p AS (SELECT *, greatest(z_outliers, iqr_outliers) / n * 100.0 AS pct FROM c)
        SELECT event_type, 'value' AS column_name, z_outliers, iqr_outliers, round(round(pct, 2), 6) AS outlier_pct,
          CASE WHEN pct > 5 THEN 'High' WHEN pct > 1 THEN 'Medium' ELSE 'Low' END AS outlier_status FROM p"""
    S["box_stats_null_key"] = (S["box_stats_by_type"].replace("FROM events e", f"FROM {X} e").replace("FROM events GROUP", f"FROM {X} x GROUP")
                               .replace("e.event_type = q.event_type", "e.event_type IS NOT DISTINCT FROM q.event_type"))
    S["histogram_null_key"] = f"""WITH v AS (SELECT event_type, value FROM {N} e WHERE value IS NOT NULL),
        st AS (SELECT event_type, count(*) AS n, min(value) AS lo0, max(value) AS hi0, quantile_cont(value, 0.25) AS q1,
          quantile_cont(value, 0.75) AS q3 FROM v GROUP BY event_type),
        w AS (SELECT *, (hi0 - lo0) / (log2(n) + 1.0) AS sturges, 2.0 * (q3 - q1) * pow(n, CAST(-1 AS DOUBLE) / 3.0) AS fd FROM st),
        b AS (SELECT event_type, CASE WHEN hi0 > lo0 THEN CAST(ceil((hi0 - lo0) / CASE WHEN fd > 0 THEN least(sturges, fd) ELSE sturges END) AS BIGINT)
            ELSE 1 END AS bins, CASE WHEN hi0 > lo0 THEN lo0 ELSE lo0 - 0.5 END AS lo,
            CASE WHEN hi0 > lo0 THEN hi0 ELSE hi0 + 0.5 END AS hi FROM w),
        c AS (SELECT v.event_type, least(CAST(floor((value - lo) / (hi - lo) * bins) AS BIGINT), bins - 1) AS bin, count(*) AS cnt
          FROM v JOIN b ON v.event_type IS NOT DISTINCT FROM b.event_type GROUP BY 1, 2),
        g AS (SELECT event_type, unnest(generate_series(0, bins - 1)) AS bin, lo, hi, bins FROM b)
        SELECT g.event_type, g.bin, round(lo + g.bin * ((hi - lo) / bins), 6) AS lower, round(lo + (g.bin + 1) * ((hi - lo) / bins), 6) AS upper,
          CAST(coalesce(cnt, 0) AS BIGINT) AS count FROM g LEFT JOIN c ON g.event_type IS NOT DISTINCT FROM c.event_type AND g.bin = c.bin"""
    def runs(key, same):
        return _r10_sql(f"""WITH v AS (SELECT {key} value FROM {X} e WHERE value IS NOT NULL),
        st AS (SELECT {key} count(*) AS n, min(value) AS lo0, max(value) AS hi0, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM v GROUP BY {key or "()"}),
        w AS (SELECT *, (hi0 - lo0) / (log2(n) + 1.0) AS sturges, 2.0 * (q3 - q1) * pow(n, CAST(-1 AS DOUBLE) / 3.0) AS fd FROM st),
        b AS (SELECT *, CASE WHEN hi0 > lo0 THEN CAST(ceil((hi0 - lo0) / CASE WHEN fd > 0 THEN least(sturges, fd) ELSE sturges END) AS BIGINT)
            ELSE 1 END AS bins, CASE WHEN hi0 > lo0 THEN lo0 ELSE lo0 - 0.5 END AS lo, CASE WHEN hi0 > lo0 THEN hi0 ELSE hi0 + 0.5 END AS hi FROM w),
        c AS (SELECT {same[0]} lo, hi, bins, least(CAST(floor((value - lo) / (hi - lo) * bins) AS BIGINT), bins - 1) AS bin, count(*) AS cnt FROM v JOIN b ON {same[1]} GROUP BY ALL),
        l AS (SELECT *, lead(bin) OVER (PARTITION BY {key} 1 ORDER BY bin) AS nxt FROM c),
        r AS (SELECT *, bin AS first_bin, bin AS last_bin FROM l
          UNION ALL SELECT * REPLACE (0 AS cnt), bin + 1, nxt - 1 FROM l WHERE nxt > bin + 1)
        SELECT {key} first_bin, last_bin, lo + first_bin * ((hi - lo) / bins) AS lower, lo + (last_bin + 1) * ((hi - lo) / bins) AS upper, cnt AS count FROM r""", "lower upper")
    S["histogram_runs"] = runs("", ("", "true")).replace("GROUP BY ()", "")
    S["histogram_runs_null_key"] = runs("event_type,", ("v.event_type,", "v.event_type IS NOT DISTINCT FROM b.event_type")).replace("GROUP BY event_type,", "GROUP BY event_type")
    S["iqr_bounds_extreme"] = f"""WITH st AS (SELECT 'value' AS column_name, count(value) AS n, quantile_cont(value, 0.25) AS q1,
          quantile_cont(value, 0.75) AS q3 FROM {X} e)
        SELECT column_name, n, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr,
          round(q1 - 1.5 * (q3 - q1), 6) AS lower, round(q3 + 1.5 * (q3 - q1), 6) AS upper FROM st"""
    S["csv_documents"] = "SELECT doc_id, text, lang, source, n_chars FROM documents"
    S["infer_dates_us"] = """SELECT o_orderkey, date_trunc('day', o_orderdate) AS order_date, date_trunc('minute', o_orderdate) AS ship_time
        FROM orders"""
    # two-sided p of Student's t: one minus Simpson's rule over the density on [0, |t|]
    S["corr_pvalue"] = f"""WITH {ci}, tt AS (SELECT *, abs(r) * sqrt((n - 2) / (1 - r * r)) AS t, CAST(n - 2 AS DOUBLE) AS v FROM ci),
        g AS (SELECT var1, var2, least(t, 60.0) AS t, v, least(t, 60.0) / 4000 AS h, CAST(unnest(generate_series(0, 4000)) AS INTEGER) AS i
          FROM tt WHERE abs(r) < 1),
        p AS (SELECT var1, var2, greatest(1 - 2 * sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
            * exp(lgamma((v + 1) / 2) - lgamma(v / 2) - (v + 1) / 2 * ln(1 + (i * h) * (i * h) / v)) / sqrt(v * pi())) * max(h) / 3, 0) AS p
          FROM g GROUP BY var1, var2)
        SELECT tt.var1, tt.var2, tt.n, round(r, 6) AS corr, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high,
          round(CASE WHEN abs(r) = 1 THEN 0.0 ELSE p.p END, 6) AS p_value FROM tt LEFT JOIN p ON tt.var1 = p.var1 AND tt.var2 = p.var2
        UNION ALL SELECT var1, var2, n, 1.0, NULL, NULL, NULL FROM ({diag_rows})"""
    draw = "CAST('0x' || left(md5('42:' || o_orderkey), 8) AS BIGINT)"
    S["k_fold"] = f"SELECT CAST({draw} % 5 AS INTEGER) AS fold, count(*) AS count FROM orders GROUP BY 1"
    S["train_test_split"] = f"SELECT {draw} < {int(0.2 * 2**32)} AS is_test, count(*) AS count FROM orders GROUP BY 1"
    P4 = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    eig = _eigen_sql(P4, "lineitem")
    S["pca_loadings"] = f"WITH {eig} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, component, round(v{m}, 3) AS loading FROM eig" for m, c in enumerate(P4))
    S["pca_n95"] = f"WITH {eig} SELECT min(component) AS n_components FROM eig WHERE cum >= 0.95 - 1e-12"
    z = ", ".join(f"coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0) AS z{m}" for m, c in enumerate(P4))
    S["pca_scores"] = f"""WITH {eig}, z AS (SELECT l_orderkey, l_linenumber, {z} FROM lineitem WHERE {" AND ".join(f"{c} IS NOT NULL" for c in P4)})
        SELECT l_orderkey, l_linenumber, """ + ", ".join(
        "round(" + " + ".join(f"z{m} * e{j}.v{m}" for m in range(4)) + f", 4) AS pc{j}" for j in range(1, 5)) + " FROM z, " + ", ".join(
        f"(SELECT * FROM eig WHERE component = {j}) e{j}" for j in range(1, 5))
    S["adf_test_lag1"] = f"""WITH o AS (SELECT event_type, value - avg(value) OVER (PARTITION BY event_type) AS y, row_number() OVER w AS i,
          count(*) OVER (PARTITION BY event_type) AS n FROM {N} e WHERE value IS NOT NULL WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
        l AS (SELECT *, lag(y) OVER w AS y1, lag(y, 2) OVER w AS y2 FROM o WINDOW w AS (PARTITION BY event_type ORDER BY i)),
        m AS (SELECT event_type, max(n) AS n, count(*) AS k, regr_sxx(y - y1, y1) AS a, regr_sxx(y, y1 - y2) AS c, regr_sxx(y, y - y1) AS g,
          regr_sxy(y1, y1 - y2) AS b, regr_sxy(y - y1, y1) AS e, regr_sxy(y - y1, y1 - y2) AS f FROM l WHERE y2 IS NOT NULL GROUP BY event_type),
        s AS (SELECT *, a * c - b * b AS det, (e * c - f * b) / (a * c - b * b) AS bl, (f * a - e * b) / (a * c - b * b) AS bd FROM m),
        r AS (SELECT event_type, n, k, bl / sqrt((g - bl * e - bd * f) / (k - 3) * c / det) AS tau FROM s),
        p AS (SELECT *, CASE WHEN tau <= -1.61 THEN 2.1659 + 1.4412 * tau + 0.038269 * tau ^ 2
          ELSE 1.7339 + 0.93202 * tau - 0.12745 * tau ^ 2 - 0.010368 * tau ^ 3 END AS x FROM r),
        q AS (SELECT event_type, sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5 * (x * i / 2000.0) ^ 2)) * x / 2000 / 3
          / sqrt(2 * pi()) AS half FROM (SELECT event_type, x, CAST(unnest(generate_series(0, 2000)) AS INTEGER) AS i FROM p) u GROUP BY event_type, x)
        SELECT p.event_type, n, CAST(1 AS INTEGER) AS max_lag, CAST(1 AS INTEGER) AS used_lag, k AS n_obs, round(tau, 6) AS adf_stat,
          round(CASE WHEN tau > 2.74 THEN 1.0 WHEN tau < -18.83 THEN 0.0 ELSE 0.5 + half END, 6) AS p_value,
          CASE WHEN tau < -18.83 OR (tau <= 2.74 AND 0.5 + half < 0.05) THEN 'Yes' ELSE 'No' END AS stationary
        FROM p LEFT JOIN q ON p.event_type IS NOT DISTINCT FROM q.event_type"""
    # X'X of [1, y1, d1 .. dk, d]; eliminating its columns one by one leaves each model's residual sum in the corner.
    # The model with the least AIC is fitted again on its own rows, y1 last but one.
    def gram(name, rows, variables):
        return f"""{name}x AS ({variables}), {name}g AS (SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM {name}x a JOIN {name}x b USING (t) GROUP BY ALL),
        {name}(p, g) AS (SELECT 0, list(r ORDER BY i) FROM (SELECT i, list(v ORDER BY j) AS r FROM {name}g GROUP BY i)
          UNION ALL SELECT p + 1, list_transform(range(1, len(g) + 1), lambda a: list_transform(range(1, len(g) + 1),
            lambda b: g[a][b] - g[a][p + 1] * g[p + 1][b] / g[p + 1][p + 1])) FROM {name} WHERE p < {rows})"""
    fit = gram("f", "len(g) - 1", """SELECT t, 0 AS i, 1.0 AS v FROM d, par WHERE t > k UNION ALL SELECT t, 1, y1 FROM d, par WHERE t > k
          UNION ALL SELECT t, k + 2, d FROM d, par WHERE t > k
          UNION ALL SELECT a.t, 1 + h, b.d FROM (SELECT t, unnest(range(1, k + 1)) AS h FROM d, par WHERE t > k) a JOIN d b ON b.t = a.t - a.h""")
    again = gram("s", "len(g) - 2", """SELECT t, 0 AS i, 1.0 AS v FROM d, best WHERE t > lag UNION ALL SELECT t, lag + 1, y1 FROM d, best WHERE t > lag
          UNION ALL SELECT t, lag + 2, d FROM d, best WHERE t > lag
          UNION ALL SELECT a.t, h, b.d FROM (SELECT t, unnest(range(1, lag + 1)) AS h FROM d, best WHERE t > lag) a JOIN d b ON b.t = a.t - a.h""")
    S["adf_test"] = f"""WITH RECURSIVE o AS (SELECT qty - avg(qty) OVER () AS y, row_number() OVER (ORDER BY l_shipdate) - 1 AS t FROM {DAILY_QTY_SQL} q WHERE qty IS NOT NULL),
        d AS (SELECT t, y - lag(y) OVER (ORDER BY t) AS d, lag(y) OVER (ORDER BY t) AS y1 FROM o),
        par AS (SELECT count(*) AS n, CAST(least(count(*) // 2 - 2, ceil(12 * (count(*) / 100.0) ^ 0.25)) AS INTEGER) AS k FROM o),
        {fit},
        best AS (SELECT CAST(arg_min(p - 2, (n - k - 1) * ln(g[k + 3][k + 3] / (n - k - 1)) + 2 * p) AS INTEGER) AS lag FROM f, par WHERE p >= 2),
        {again},
        r AS (SELECT n, k, lag, n - lag - 1 AS m, g[lag + 2][lag + 2] AS a, g[lag + 2][lag + 3] AS b, g[lag + 3][lag + 3] AS c FROM s, best, par WHERE p = lag + 1),
        u AS (SELECT *, b / a / sqrt((c - b * b / a) / (m - lag - 2) / a) AS tau FROM r),
        p AS (SELECT *, CASE WHEN tau <= -1.61 THEN 2.1659 + 1.4412 * tau + 0.038269 * tau ^ 2
          ELSE 1.7339 + 0.93202 * tau - 0.12745 * tau ^ 2 - 0.010368 * tau ^ 3 END AS x FROM u),
        q AS (SELECT sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5 * (x * i / 2000.0) ^ 2)) * max(x) / 2000 / 3
          / sqrt(2 * pi()) AS half FROM (SELECT x, CAST(unnest(generate_series(0, 2000)) AS INTEGER) AS i FROM p) z)
        SELECT n, k AS max_lag, lag AS used_lag, m AS n_obs, round(tau, 6) AS adf_stat,
          round(CASE WHEN tau > 2.74 THEN 1.0 WHEN tau < -18.83 THEN 0.0 ELSE 0.5 + half END, 6) AS p_value,
          CASE WHEN tau < -18.83 OR (tau <= 2.74 AND 0.5 + half < 0.05) THEN 'Yes' ELSE 'No' END AS stationary FROM p, q"""
    heat_cols = ["event_id", "ts", "user_id", "event_type", "value", "props"]
    S["missing_by_bucket"] = f"""WITH o AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx, count(*) OVER () AS n FROM {D} d),
        b AS (SELECT *, CAST(idx * 20 // n AS INTEGER) AS bucket FROM o)
        """ + " UNION ALL ".join(f"""SELECT bucket, '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER (WHERE {c} IS NULL) AS missing,
          round(count(*) FILTER (WHERE {c} IS NULL) / count(*)::DOUBLE, 6) AS missing_share FROM b GROUP BY bucket""" for c in heat_cols)
    return S
