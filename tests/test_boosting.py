"""The block-wise boosted trees against Spark ML's, and the explanations of their leaves."""

import os
import threading

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from keelson.functions.features import FEATURES_CATEGORICAL, FEATURES_NUMERIC
from keelson.operators import boosting, ml, tree_shap

TREES = 6


@pytest.fixture(scope="module")
def rows(spark):
    """Continuous columns (more values than bins, so no ties), a constant column, missing labels of the regressor."""
    rng = np.random.default_rng(5)
    n = 1500
    numbers = rng.normal(size=(n, len(FEATURES_NUMERIC)))
    numbers[:, 3] = 1.0
    kinds = rng.integers(0, 4, (n, len(FEATURES_CATEGORICAL)))
    late = (numbers[:, 0] + numbers[:, 1] * numbers[:, 2] + (kinds[:, 0] == 2) + rng.normal(size=n) > 0.8).astype(int)
    days = np.where(late, 3 + numbers[:, 5] + kinds[:, 1], 0.0)
    data = [(i, *map(float, numbers[i]), *(f"k{k}" for k in kinds[i]), int(late[i]), None if i % 50 == 3 else float(days[i])) for i in range(n)]
    names = ["Order_ID", *FEATURES_NUMERIC, *FEATURES_CATEGORICAL, "Is_Delayed", "Delay_Days"]
    types = ["long", *["double"] * len(FEATURES_NUMERIC), *["string"] * len(FEATURES_CATEGORICAL), "int", "double"]
    return spark.createDataFrame(data, ", ".join(f"{a} {t}" for a, t in zip(names, types))).coalesce(3)


def _odd(rows):
    """The same rows, some with a missing number, an unknown or a missing category."""
    key = F.col("Order_ID")
    return (rows.withColumn("Origin_City", F.when(key % 7 == 0, "new").when(key % 7 == 1, None).otherwise(F.col("Origin_City")))
            .withColumn("Scheduled_Lead_Time_Days", F.when(key % 40 != 1, F.col("Scheduled_Lead_Time_Days"))))


@pytest.fixture(scope="module")
def classifier(rows):
    return ml.fit_classifier(rows, n_trees=TREES)


def test_the_classifier_is_spark_mls(rows, classifier):
    gbt = GBTClassifier(featuresCol="features", labelCol="Is_Delayed", weightCol="w", maxIter=TREES, maxDepth=4, stepSize=0.05, seed=42)
    other = Pipeline(stages=ml.feature_stages() + [gbt]).fit(ml.with_class_weight(rows))
    both = ml.positive_probability(classifier, ml.positive_probability(other, _odd(rows), "theirs"), "ours").select("theirs", "ours").toPandas()
    assert np.abs(both.theirs - both.ours).max() < 1e-9 and both.ours.nunique() > 50


def test_the_regressor_is_spark_mls(rows):
    ours = ml.fit_regressor(rows, n_trees=TREES)
    gbt = GBTRegressor(featuresCol="features", labelCol="Delay_Days", maxIter=TREES, maxDepth=4, stepSize=0.05, seed=42)
    other = Pipeline(stages=ml.feature_stages() + [gbt]).fit(rows.where("Delay_Days IS NOT NULL"))
    both = ml.predict_days(ours, other.transform(_odd(rows)).select(*rows.columns, "prediction"), "days").select("prediction", "days").toPandas()
    assert np.abs(both.prediction.clip(lower=0) - both.days).max() < 1e-9


def test_margins_from_the_start_again_are_the_same(rows, classifier, monkeypatch):
    monkeypatch.setattr(boosting, "REBUILD", 2)
    again = ml.fit_classifier(rows, n_trees=TREES)
    both = ml.positive_probability(classifier, ml.positive_probability(again, rows, "a"), "b").select("a", "b").toPandas()
    assert np.abs(both.a - both.b).max() < 1e-9


def test_every_row_is_in_the_leaves(rows, classifier):
    assert classifier.leaf_rows.shape == (TREES, 16) and set(classifier.leaf_rows.sum(axis=1)) == {rows.count()}


def test_contributions_add_up_to_the_log_odds(rows, classifier):
    arrays, bias = tree_shap.tree_contributions(classifier, _odd(rows))
    got = arrays.select("Order_ID", F.expr("aggregate(contribs, 0D, (a, c) -> a + c.value)").alias("s"))
    p = F.col("p")
    both = ml.positive_probability(classifier, _odd(rows).where("Scheduled_Lead_Time_Days IS NOT NULL"), "p").join(got, "Order_ID")
    assert both.agg(F.max(F.abs(F.col("s") + bias - F.log(p / (1 - p))))).first()[0] < 1e-9


def test_patterns_give_what_the_leaves_give():
    rng = np.random.default_rng(2)
    tables = []
    for _ in range(60):
        feats = rng.choice(6, rng.integers(1, 5), replace=False)
        ends = [(-np.inf, 1.0), (0.0, np.inf), (-1.0, 2.0)]
        tables.append(([(int(f), *ends[rng.integers(3)]) for f in feats], tree_shap.mask_table(float(rng.normal()), rng.uniform(0.1, 0.9, len(feats)).tolist())))
    x = rng.integers(-3, 4, (80, 6)).astype(float)
    x[3, 2] = np.nan
    got = tree_shap.row_contributions(x, tables, tree_shap.pattern_tables(tables))
    assert np.allclose(got, tree_shap.leaf_contributions(x, tables), atol=1e-12)


def test_thresholds_of_few_and_of_many_values():
    assert boosting.column_thresholds(np.array([3.0, 1.0, 1.0, np.nan]), np.ones(4)).tolist() == [2.0]
    assert boosting.column_thresholds(np.arange(64.0), np.ones(64)).tolist() == [2.0 * k + 1.5 for k in range(31)]


def test_missing_numbers_are_refused(rows):
    with pytest.raises(ValueError, match="38 rows have a missing"):
        ml.fit_classifier(_odd(rows), n_trees=1)


def test_a_sister_is_what_remains_of_the_parent():
    """The tables of two sister nodes add up to their parent's: only one of them is counted."""
    rng = np.random.default_rng(3)
    sizes, weights = [7, 5, 4], (1.0, 2.5)
    codes = [rng.integers(0, size, 400).astype(np.uint8) for size in sizes]
    blocks = [(codes, rng.choice([-1, 1], 400).astype(np.int8), rng.normal(size=400))]
    tree = boosting.Tree.empty(2, 1.0)
    root, = boosting.level_tables(blocks, tree, 0, None, sizes, weights, True)
    tree.column[0], tree.first[0], tree.many[0] = boosting.best_split(root[:, 0], sizes, 2, weights)[:3]
    sisters, = boosting.level_tables(blocks, tree, 1, [0, 1], sizes, weights, True)
    assert (sisters[:2].sum(axis=1) == root[:2, 0]).all() and np.allclose(sisters.sum(axis=1), root[:, 0], atol=1e-9)
    only, = boosting.level_tables(blocks, tree, 1, [1], sizes, weights, False)
    assert only.shape == (1, 1, sum(sizes)) and (only[0, 0] == sisters[2, 1]).all()


def test_of_equal_gains_the_first_is_taken():
    """Two columns that say the same, the second with what rounding adds."""
    table = np.array([[6.0, 4.0, 6.0, 4.0], [3.0, -3.0, 3.0 + 1e-15, -3.0 - 1e-15]])
    assert boosting.best_split(table, [2, 2], 2, None)[:3] == (0, 1, 1)


def test_models_are_fitted_at_the_same_time(spark, monkeypatch):
    from keelson.plans import catalog_models
    both = threading.Barrier(2, timeout=30)   # neither goes on before the other has begun
    monkeypatch.setattr(catalog_models, "_split", lambda *_: None)
    monkeypatch.setattr(catalog_models, "_model", lambda *_: both.wait())
    catalog_models._models(spark, "no such folder", "gbt", "reg")


def test_margins_not_yet_stored_count_in_a_level(rows, monkeypatch):
    """Trees since the stored margins are added row by row: the tables and the trees are those of margins stored after every tree."""
    rng = np.random.default_rng(4)
    sizes, weights = [5, 3], (1.0, 2.0)
    codes, y, margin = [rng.integers(0, n, 300).astype(np.uint8) for n in sizes], np.where(rng.random(300) < 0.4, 1, -1).astype(np.int8), rng.normal(size=300)
    trees = [boosting.Tree(rng.integers(0, 2, 3), np.ones(3, np.int64), np.ones(3, np.int64), rng.normal(size=4), 0.5) for _ in range(3)]
    for before in (margin, None):
        stored, = boosting._advance([(codes, y, before)], trees, 2)
        for level, nodes in ((0, None), (1, [0, 1]), (1, [1])):
            want, = boosting.level_tables([stored], trees[0], level, nodes, sizes, weights, True)
            got, = boosting.level_tables([(codes, y, before)], trees[0], level, nodes, sizes, weights, True, trees, 2)
            assert (got == want).all()
    found = []
    for stored, rebuild in ((1, 100), (2, 4)):
        monkeypatch.setattr(boosting, "STORED", stored)
        monkeypatch.setattr(boosting, "REBUILD", rebuild)
        model = ml.fit_regressor(rows, n_trees=TREES)
        found.append([(t.column.tolist(), t.first.tolist(), t.many.tolist(), t.value.tolist()) for t in model.trees])
    assert found[0] == found[1] and len(found[0]) == TREES


def test_the_strongest_contributions_are_those_of_the_whole_arrays(rows, classifier):
    """The memo's drivers, taken in the task, are what sorting every row's whole array gives: rows that repeat an id, missing and unknown values, ties at 0."""
    odd = _odd(rows).where("Order_ID < 400").unionAll(rows.where("Order_ID < 5"))
    whole, _ = tree_shap.tree_contributions(classifier, odd)
    for k in (3, 60):   # there are fewer than 60 features
        ranked = "sort_array(transform(contribs, c -> struct(-abs(c.value) AS k, c.feature AS feature, c.value AS value)))"
        want = whole.selectExpr("Order_ID", f"transform(slice({ranked}, 1, {k}), c -> struct(c.feature, c.value)) AS contribs")
        top, contribs = tree_shap.strongest_contributions(classifier, odd, k)
        assert sorted(map(str, top.select("Order_ID", contribs.alias("contribs")).collect())) == sorted(map(str, want.collect()))


def test_rows_that_are_not_where_a_task_runs_are_read_again(rows, classifier, monkeypatch):
    """A lost folder, lost margins or lost rows of an executor cost time, not results; nothing is left behind."""
    grow, fits = boosting.grow, []

    def losing(kept, trees, *rest):
        fit, at, stored = kept.fit, len(trees), kept.stored

        def lose(parts):
            for part in parts:
                shelf = boosting.Shelf(fit, part)
                if at == 2:
                    shelf.clear()
                elif at == 3:
                    shelf.drop(stored)
                elif at == 4 and part == 0:
                    os.remove(f"{shelf.folder}/index")
        fits.append(kept)
        kept.held.foreachPartition(lose)
        return grow(kept, trees, *rest)
    monkeypatch.setattr(boosting, "grow", losing)
    again = ml.fit_classifier(rows, n_trees=TREES)
    for a, b in zip(classifier.trees, again.trees, strict=True):
        assert a.column.tolist() == b.column.tolist() and a.first.tolist() == b.first.tolist() and np.allclose(a.value, b.value, atol=1e-12)
    assert (classifier.leaf_rows == again.leaf_rows).all() and len(fits) == TREES
    fit = fits[0].fit
    left = fits[0].parts.mapPartitionsWithIndex(lambda part, found: [os.path.exists(boosting.Shelf(fit, part).folder) for _ in [list(found)]]).collect()
    assert left and not any(left)
