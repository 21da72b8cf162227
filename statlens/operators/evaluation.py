"""Model evaluation.

The reference only declares this phase (classification / regression and a
target column); these are the metrics it names, over a table of labels,
predictions and scores.  All are grouped aggregates; the ROC curve uses the
distributed running sums of ``dense_index`` over the distinct scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statlens.functions.columns import as_list, join_on, q
from statlens.plans.ordered import dense_index, running_sums


def confusion_matrix(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows (by..., label, prediction, count)."""
    return (df.groupBy(*[q(b) for b in as_list(by)], q(label).alias("label"), q(prediction).alias("prediction"))
            .agg(F.count(F.lit(1)).alias("count")))


def class_report(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Per class (and group) precision, recall, F1 and support, plus accuracy."""
    by = as_list(by)
    keys = [q(b) for b in by]
    cm = confusion_matrix(df, label, prediction, by)
    cells = cm.select(*keys, F.explode(F.array(
        F.struct(F.col("label").cast("string").alias("cls"), F.col("count").alias("support"),
                 F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(0).alias("tp")),
        F.struct(F.col("prediction").cast("string").alias("cls"), F.lit(0).cast("bigint").alias("support"),
                 F.col("count").alias("predicted"), F.lit(0).cast("bigint").alias("tp")))).alias("c"))
    per = cells.groupBy(*keys, F.col("c.cls").alias("class")).agg(
        F.sum("c.support").alias("support"), F.sum("c.predicted").alias("predicted"), F.sum("c.tp").alias("tp"))
    total = cm.groupBy(*keys).agg(F.sum("count").alias("_n"),
                                  F.sum(F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(0)).alias("_ok"))
    p = F.try_divide(F.col("tp"), F.col("predicted"))
    r = F.try_divide(F.col("tp"), F.col("support"))
    f1 = F.try_divide(2 * p * r, p + r)
    return (join_on(per, total, by)
            .select(*keys, "class", "support", p.alias("precision"), r.alias("recall"), f1.alias("f1"),
                    F.try_divide(F.col("_ok"), F.col("_n")).alias("accuracy")))


def _roc_points(df: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    pos = F.when(q(label) == 1, 1).otherwise(0)
    per_score = (df.where(q(score).isNotNull() & q(label).isNotNull())
                 .groupBy(*[q(b) for b in by], q(score).cast("double").alias("threshold"))
                 .agg(F.sum(pos).cast("bigint").alias("pos"), F.sum(1 - pos).cast("bigint").alias("neg"))
                 .withColumn("_desc", -F.col("threshold")))
    return running_sums(dense_index(per_score, ["_desc"], by), ["pos", "neg"], by)


def roc_curve(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """ROC points per distinct score (descending; of each group), ties grouped."""
    by = as_list(by)
    keys = [q(b) for b in by]
    pts = _roc_points(df, label, score, by)
    tot = pts.groupBy(*keys).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_q"))
    return (join_on(pts, tot, by)
            .select(*keys, "threshold", F.try_divide(F.col("cum_neg"), F.col("_q")).alias("fpr"),
                    F.try_divide(F.col("cum_pos"), F.col("_p")).alias("tpr")))


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve (of each group) by the trapezoid rule."""
    by = as_list(by)
    keys = [q(b) for b in by]
    pts = _roc_points(df, label, score, by)
    before = F.col("cum_pos") - F.col("pos")
    return pts.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
                                  F.sum(F.col("neg") * (before + 0.5 * F.col("pos"))).alias("_area")).select(
        *keys, "n_pos", "n_neg", F.try_divide(F.col("_area"), (F.col("n_pos") * F.col("n_neg")).cast("double")).alias("auc"))


def regression_metrics(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    """N, MAE, MSE, RMSE, R^2 (of each group) in one aggregate."""
    keys = [q(b) for b in as_list(by)]
    e = q(y) - q(yhat)
    agg = df.where(q(y).isNotNull() & q(yhat).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
        F.sum(e * e).alias("_sse"), F.var_pop(q(y)).alias("_vy"))
    return agg.select(*keys, "n", "mae", "mse", F.sqrt("mse").alias("rmse"),
                      (1 - F.try_divide(F.col("_sse"), F.col("_vy") * F.col("n"))).alias("r2"))


def _draw(key: str, seed: int):
    """A whole number below 2**32 from md5 of seed and key, the same anywhere."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(q(key).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def k_fold(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """E5: ``fold`` = hash of (seed, key) mod k: the same rows land in the
    same fold on any cluster, partitioning or retry (and in other engines)."""
    return df.withColumn("fold", (_draw(key, seed) % k).cast("int"))


def train_test_split(df: DataFrame, key: str, test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """E5: ``is_test`` from the same hash (deterministic, no shuffle)."""
    return df.withColumn("is_test", _draw(key, seed) < int(test_fraction * 2**32))
