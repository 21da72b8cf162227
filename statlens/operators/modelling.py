"""A forest on a target column, cross-validated.

Spark ML does the work: text columns are label-encoded, numbers are imputed by
their mean, and a random forest is fitted for each setting and fold.  The folds
are the library's own hashes of a key column (:func:`evaluation.k_fold`), so
they are the same in every run and engine.  What is scored are predictions of rows
that the model has not seen: each fold by the forest of the others.

A forest needs the table a few times, so the encoded rows are written once.  The
driver holds the labels of the encoded columns (at most ``max_categories`` each)
and the trees.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statlens.functions.columns import as_double, as_list, categorical_columns, numeric_columns, q
from statlens.operators.evaluation import class_report, k_fold, regression_metrics, roc_auc
from statlens.session import written

MAX_CATEGORIES = 1000


def _encoded(df: DataFrame, target: str, key: str, features: Sequence[str], classes: bool, folds: int, seed: int,
             max_categories: int) -> tuple[DataFrame, list[str], int]:
    """Rows (key, fold, label, target, features), the classes in the order of their labels, and the bins a forest needs."""
    named = as_list(features)
    numbers = [c for c in (named or numeric_columns(df)) if c in numeric_columns(df) and c not in (target, key)]
    texts = [c for c in (named or categorical_columns(df)) if c in categorical_columns(df) and c not in (target, key)]
    unknown = set(named) - {*numbers, *texts}
    if unknown:
        raise ValueError(f"neither numeric nor text, or target or key: {sorted(unknown)}")
    rows = df.where(q(target).isNotNull())
    if texts:  # a text column with more values isn't a category
        seen = rows.agg(*[F.approx_count_distinct(q(c)).alias(f"_d{i}") for i, c in enumerate(texts)]).first()
        many = [c for i, c in enumerate(texts) if seen[i] > max_categories]
        if set(many) & set(named):
            raise ValueError(f"more than {max_categories} values: {many}")
        texts = [c for c in texts if c not in many]
    if not numbers and not texts:
        raise ValueError("no features")
    base = k_fold(rows.select(q(key).alias("_key"), q(target).alias("_target"), *[as_double(c).alias(f"_x{i}") for i, c in enumerate(numbers)],
                              *[q(c).cast("string").alias(f"_s{i}") for i, c in enumerate(texts)]), "_key", folds, seed)
    label = F.col("_target").cast("string") if classes else F.col("_target").cast("double")
    base = base.withColumn("_answer", label)
    there = base.agg(*[F.count(f"_x{i}").alias(f"_n{i}") for i in range(len(numbers))], F.count(F.lit(1)).alias("_rows")).first()
    used = [f"_x{i}" for i in range(len(numbers)) if there[f"_n{i}"]]  # a column without values says nothing
    codes = [f"_c{i}" for i in range(len(texts))]
    steps = []
    if used:
        steps.append(Imputer(inputCols=used, outputCols=[c + "f" for c in used]))
    if texts:
        steps.append(StringIndexer(inputCols=[f"_s{i}" for i in range(len(texts))], outputCols=codes, handleInvalid="keep"))
    if classes:
        steps.append(StringIndexer(inputCol="_answer", outputCol="_label"))
    steps.append(VectorAssembler(inputCols=[c + "f" for c in used] + codes, outputCol="_features"))
    model = Pipeline(stages=steps).fit(base)
    names = list(model.stages[-2].labels) if classes else []
    ready = model.transform(base)
    if not classes:
        ready = ready.withColumn("_label", F.col("_answer"))
    return written(ready.select("_key", "fold", "_target", "_label", "_features"), "encoded"), names, max(32, max_categories + 2 if texts else 32)


def cross_predictions(df: DataFrame, target: str, key: str, features: Sequence[str] = (), problem: str = "classification", folds: int = 5,
                      seed: int = 42, trees: int = 40, depths: Sequence[int] = (4, 8), max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """(key, fold, target, prediction, score): each row predicted by a forest of the other folds.

    Of ``depths`` the one with the best cross-validated F1 (classes) or RMSE is used.
    ``score`` is the probability of the second of two classes (in the order of their frequency; NULL
    with more classes, and the prediction itself for numbers).  Rows without a target are left out."""
    if problem not in ("classification", "regression"):
        raise ValueError("problem is 'classification' or 'regression'")
    classes = problem == "classification"
    rows, names, bins = _encoded(df, target, key, features, classes, folds, seed, max_categories)
    forest = (RandomForestClassifier if classes else RandomForestRegressor)(
        labelCol="_label", featuresCol="_features", numTrees=trees, seed=seed, maxBins=bins)
    by = MulticlassClassificationEvaluator(labelCol="_label", metricName="f1") if classes else RegressionEvaluator(labelCol="_label", metricName="rmse")
    grid = ParamGridBuilder().addGrid(forest.maxDepth, list(depths)).build()
    search = CrossValidator(estimator=forest, estimatorParamMaps=grid, evaluator=by, foldCol="fold", numFolds=folds, seed=seed, collectSubModels=True)
    fitted = search.fit(rows)
    best = (max if by.isLargerBetter() else min)(range(len(grid)), key=lambda i: fitted.avgMetrics[i])
    out = None
    for fold in range(folds):
        # A fitted forest of classes carries its training summary, and with it the session, to the tasks; a copy doesn't.
        seen = fitted.subModels[fold][best].copy().transform(rows.where(F.col("fold") == fold))
        if classes:
            guess = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("prediction").cast("int") + 1)
            score = vector_to_array("probability")[1] if len(names) == 2 else F.lit(None).cast("double")
        else:
            guess, score = F.col("prediction"), F.col("prediction")
        part = seen.select(F.col("_key").alias(key), "fold", F.col("_target").alias(target), guess.alias("prediction"), score.alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


def fit_evaluate(df: DataFrame, target: str, key: str, features: Sequence[str] = (), problem: str = "classification", **kw) -> DataFrame:
    """(metric, class, value) of the cross-validated predictions: for classes accuracy, precision, recall, F1 and
    support of each, and the area under the ROC curve of two; for numbers MAE, MSE, RMSE and R^2."""
    got = written(cross_predictions(df, target, key, features, problem, **kw), "predictions")

    def long(table: DataFrame, metrics: Sequence[str], cls) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(m).alias("metric"), cls.alias("class"), q(m).cast("double").alias("value")) for m in metrics])
        return table.select(F.inline(pairs))

    none = F.lit(None).cast("string")
    if problem == "regression":
        return long(regression_metrics(got.withColumn(target, as_double(target)), target, "prediction"), ["n", "mae", "mse", "rmse", "r2"], none)
    report = class_report(got.withColumn(target, q(target).cast("string")), target, "prediction")
    out = long(report, ["support", "precision", "recall", "f1"], F.col("class")).unionByName(
        long(report.agg(F.max("accuracy").alias("accuracy")), ["accuracy"], none))
    if not got.where(F.col("score").isNotNull()).isEmpty():
        # the second class is the rarer one (by name where both are as frequent)
        rare = got.groupBy(q(target).cast("string").alias("c")).agg(F.count(F.lit(1)).alias("n")).orderBy("n", F.desc("c")).first()["c"]
        marked = got.withColumn("_is", (q(target).cast("string") == rare).cast("int"))
        out = out.unionByName(long(roc_auc(marked, "_is", "score"), ["auc"], none))
    return out
