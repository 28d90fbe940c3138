"""The memo's text, also for values that have no plain tenths."""

from pyspark.sql import functions as F

from keelson.operators import scoring


def test_one_decimal_is_the_formatted_value(spark):
    values = [0.0, -0.0, 0.04, 0.05, 0.15, 0.25, 12.349, 99.95, 100.0, -0.04, -1.25, 1e7 + 0.1, 123456789012.3, 1e15, 1e300, float("nan"), float("inf"), None]
    values += [k / 40 for k in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select("x", scoring.one_decimal(F.col("x")).alias("a"), F.format_string("%.1f", scoring.round_half_even(F.col("x"), 1)).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and got[4].a == "0.2"


def test_memos_with_and_without_drivers(spark):
    rows = [(1, "High", 0.4567, 2.35, 33.333, [("num__A_B", -0.1), ("cat__C_d", 0.3), ("num__E", 0.2), ("num__F", 0.05)]),
            (2, "Low", 0.0, 0.0, None, [("num__A_B", 0.0)]), (3, "Medium", 1.0, 10.05, 0.0, [("num__b", -1.0), ("num__a", -1.0)]), (4, "Low", 0.5, 1.0, 100.0, None)]
    df = spark.createDataFrame(rows, "id int, t string, p double, d double, r double, c array<struct<feature: string, value: double>>")
    memo = scoring.underwriting_memo(F.lit("here"), F.col("t"), F.col("p"), F.col("d"), F.col("r"), F.col("c"))
    got = {r.id: r.memo for r in df.select("id", memo.alias("memo")).collect()}

    def head(tier, p, d, rate):
        return (f"Shipment (here) is scored in the **{tier.upper()}** risk tier, with a predicted delay probability of {p}% and an expected delay of {d} day(s). "
                f"Historically, shipments in the {tier} tier were delayed {rate} of the time.")
    assert got[1] == f"{head('High', '45.7', '2.4', '33.3%')} Risk is primarily driven up by: C d, E. Risk is partially offset by: A B. {scoring.REC_HIGH}"
    assert got[2] == f"{head('Low', '0.0', '0.0', 'n/a')} {scoring.REC_LOW}"
    assert got[3] == f"{head('Medium', '100.0', '10.0', '0.0%')} Risk is partially offset by: a, b. {scoring.REC_MEDIUM}"
    assert got[4] == f"{head('Low', '50.0', '1.0', '100.0%')} {scoring.REC_LOW}"


def test_the_memo_query_keeps_no_whole_contributions(spark, tmp_path, monkeypatch):
    """Only the strongest contributions leave the tasks: nothing but predictions and scores is written once the models are there; one memo a shipment."""
    from keelson.operators import ml
    from keelson.plans import catalog_models as cm
    from keelson.plans import materialize as mz
    from keelson.plans import scored as sc
    from table_dirs import SMALL
    fit_classifier, fit_regressor, written = ml.fit_classifier, ml.fit_regressor, []
    where = f"{SMALL}/../sf0.001"   # a name that no other test keeps models under
    monkeypatch.setattr(ml, "fit_classifier", lambda train, n_trees: fit_classifier(train, n_trees=2))
    monkeypatch.setattr(ml, "fit_regressor", lambda train, n_trees: fit_regressor(train, n_trees=2))
    for module in (cm, sc):
        monkeypatch.setattr(module, "materialize", lambda df, name: written.append(name) or mz.materialize(df, name))
    memos = cm.q_model_memo(spark, where)
    assert "tree-contrib" not in written and written.count("with_days") == 1 and "two_models" not in written
    assert memos.count() == sc.featured(spark, where).count()
    assert cm._two_models(spark, where).columns[-2:] == ["p_boosted", "p_logistic"] and "two_models" not in written
