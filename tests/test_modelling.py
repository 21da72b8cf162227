"""The cross-validated forest: folds, leakage, metrics against a plain count."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

import __spark_entry__ as E
from statlens.operators import evaluation, modelling


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    n = 600
    x, y, kind = rng.normal(size=n), rng.normal(size=n), rng.choice(["a", "b", "c"], n)
    target = np.where((x + (kind == "b") * 1.5 + 0.3 * rng.normal(size=n)) > 0.8, "yes", "no")
    pdf = pd.DataFrame({"id": range(n), "x": np.where(rng.random(n) < 0.1, np.nan, x), "y": y, "kind": kind, "note": [f"n{i}" for i in range(n)],
                        "empty": np.nan, "target": target, "value": 3 * x + (kind == "c") * 2 + 0.2 * rng.normal(size=n)})
    pdf.loc[5, "target"] = None
    return spark.createDataFrame(pdf, "id long, x double, y double, kind string, note string, empty double, target string, value double")


def test_classes(spark, table):
    d = table.drop("value")
    got = modelling.cross_predictions(d, "target", "id", max_categories=50, trees=15, folds=4)
    rows = got.collect()
    assert len(rows) == 599 and len({r["id"] for r in rows}) == 599
    folds = {r["id"]: r["fold"] for r in evaluation.k_fold(table, "id", 4).collect()}
    assert all(folds[r["id"]] == r["fold"] for r in rows)
    right = np.mean([r["target"] == r["prediction"] for r in rows])
    assert right > 0.85
    report = {(r["metric"], r["class"]): r["value"] for r in modelling.fit_evaluate(d, "target", "id", max_categories=50, trees=15, folds=4).collect()}
    assert report["accuracy", None] == pytest.approx(right, abs=0.02)
    assert report["support", "yes"] + report["support", "no"] == 599 and report["auc", None] > 0.9
    with pytest.raises(ValueError, match="more than 50 values"):
        modelling.cross_predictions(d, "target", "id", features=["note"], max_categories=50)
    # targets dealt anew can't be learnt: the predicted rows were not seen
    noise = d.withColumn("target", F.when(F.xxhash64("id") % 2 == 0, "yes").otherwise("no"))
    blind = {(r["metric"], r["class"]): r["value"] for r in modelling.fit_evaluate(noise, "target", "id", features=["x", "y", "kind"], trees=10, depths=(4,), folds=3).collect()}
    assert blind["accuracy", None] < 0.62


def test_numbers(spark, table):
    report = {r["metric"]: r["value"] for r in modelling.fit_evaluate(table, "value", "id", features=["x", "kind", "y", "empty"], problem="regression", trees=15, folds=3).collect()}
    assert report["n"] == 600 and report["r2"] > 0.75 and report["rmse"] == pytest.approx(report["mse"] ** 0.5)


def test_quality_of_documents(spark):
    got = {(r["metric"], r["class"]): r["value"] for r in E.queries()["fit_evaluate"](spark, "/root/testdata/sf0.01").collect()}
    assert got["accuracy", None] > 0.9 and got["auc", None] > 0.9 and got["f1", "0"] > 0.7


def test_classes_in_a_session_that_has_observed(spark, table):
    """Once a session has observed a query it can't be sent to tasks, so no model may bring it along."""
    seen = Observation()
    assert table.observe(seen, F.count(F.lit(1)).alias("n")).count() == 600 and seen.get["n"] == 600
    got = modelling.cross_predictions(table, "target", "id", features=["x", "y", "kind"], trees=3, depths=(3,), folds=2).collect()
    assert len(got) == 599 and all(0 <= r["score"] <= 1 for r in got)
