"""SURVEY §5 invariants over the scored table and skewed inputs."""

import random

import numpy as np
from pyspark.sql import functions as F

from table_dirs import SMALL
from keelson.functions.stats import exact_quantiles
from keelson.operators import portfolio as pf
from keelson.plans import scored as sc
from keelson.plans.catalog import FACETS


def test_tier_counts_sum_to_n(spark):
    s = sc.scored(spark, SMALL)
    split = pf.tier_split(s).agg(F.sum("shipments")).collect()[0][0]
    assert split == s.where(F.col("Risk_Tier").isNotNull()).count()
    assert s.where(F.col("Risk_Tier").isNull() & F.col("Shipment_Risk_Score").isNotNull()).count() == 0


def test_facet_counts_agree_with_filter(spark):
    s = sc.scored(spark, SMALL)
    c = pf.facet_counts(s, **FACETS).collect()[0]
    assert c.shown == pf.faceted_filter(s, **FACETS).count() and c.total == s.count()
    empty = pf.faceted_filter(s, modes=["Rail"])
    split = {r.Risk_Tier: r.shipments for r in pf.tier_split(empty).collect()}
    assert split == {"Low": 0, "Medium": 0, "High": 0, "Severe": 0}
    assert all(r.delay_rate is None for r in pf.tier_calibration(empty).collect())


def test_quantiles_with_a_hot_group(spark):
    """One group holds a third of all rows (with heavy ties); results still equal numpy."""
    rnd = random.Random(11)
    rows = [("hot", float(rnd.choice([1.0, 2.0, 2.0, 3.5]))) for _ in range(3000)]
    rows += [(f"g{i % 50}", rnd.random()) for i in range(6000)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r.k: r for r in exact_quantiles(df, {"p50": ("x", 0.5), "p99": ("x", 0.99)}, by=["k"],
                                           accuracy=200).collect()}
    for k in ("hot", "g0", "g17"):
        vals = [x for kk, x in rows if kk == k]
        assert abs(got[k].p50 - np.quantile(vals, 0.5)) < 1e-12
        assert abs(got[k].p99 - np.quantile(vals, 0.99)) < 1e-12


def test_identical_edges_normalise_to_zero(spark):
    """K8: a graph whose edges are all identical gives Balanced weight 0."""
    from keelson.operators.routes import priority_weights
    e = spark.createDataFrame([("Sea", "A", i, i + 1, 100.0, 3.0, 4250.0, 0.2) for i in range(4)],
                              "mode string, category string, a_port_idx int, b_port_idx int, distance_km double, "
                              "transit_days double, cost_usd double, delay_probability double")
    w = {r.priority: r.weight for r in priority_weights(e).collect()}
    assert w["Balanced"] == 0.0 and w["Cheapest"] == 4250.0


def test_identical_clusters_radar_half(spark):
    """A measure constant across clusters scales to 0.5."""
    from keelson.operators.clusters import RADAR_MEASURES, radar
    prof = spark.createDataFrame([(c, *[1.0] * len(RADAR_MEASURES)) for c in range(3)],
                                 "Cluster int, " + ", ".join(f"{m} double" for m in RADAR_MEASURES))
    for r in radar(prof).collect():
        assert all(r[f"{m}_norm"] == 0.5 for m in RADAR_MEASURES)


def test_empty_portfolio_has_no_simulations(spark):
    """H1: an empty (filtered) portfolio yields no simulation rows."""
    from keelson.operators.exposure import simulate
    s = pf.faceted_filter(sc.scored(spark, SMALL), modes=["Rail"])
    assert simulate(s, 500, 42).count() == 0
    assert simulate(sc.scored(spark, SMALL), 500, 42).count() == 500


def test_zero_days_give_a_null_score(spark):
    """A portfolio whose p99 of days is zero has null scores and does not fail."""
    from keelson.operators.scoring import portfolio_score
    df = spark.createDataFrame([(1, 0.5, 0.0, 0.2), (2, 0.1, 0.0, 0.9)],
                               "Order_ID long, Predicted_Delay_Probability double, Predicted_Delay_Days double, External_Risk_Pressure double")
    assert [r.Shipment_Risk_Score for r in portfolio_score(df).collect()] == [None, None]


def test_forest_draws_rows_of_the_whole_table(spark):
    """Above 20,000 rows every tree still draws from all of them."""
    from keelson.operators import anomaly as an
    df = spark.range(30_000).selectExpr("id AS Order_ID", *[f"CAST(id AS DOUBLE) AS {c}" for c in an.ANOMALY_NUMERIC])
    drawn = an.draw_samples(df, 8, an.PSI, 42, "Order_ID", an.ANOMALY_NUMERIC, 30_000).groupBy("tree").agg(
        F.count(F.lit(1)).alias("n"), (F.max(F.get("x", F.lit(0))) - F.min(F.get("x", F.lit(0)))).alias("span")).collect()
    assert len(drawn) == 8 and all(r.n == an.PSI and r.span > 27_000 for r in drawn)
    nodes = an.fit_forest(df, n_trees=8).nodes
    leaves = nodes.where("feature < 0").groupBy("tree").agg(F.sum("size").alias("n")).collect()
    assert [r.n for r in leaves] == [an.PSI] * 8 and nodes.agg(F.max("depth")).first()[0] <= 8


def test_forest_on_odd_tables(spark):
    """Ties, constant features, missing values, repeated keys, one row, no rows; an outlier has the highest score."""
    from keelson.operators import anomaly as an
    names = ", ".join(f"{c} double" for c in an.ANOMALY_NUMERIC)
    rnd = random.Random(3)
    rows = [(i, 1.0, *[float(rnd.choice([0, 1, 1, 2])) for _ in range(6)], None if i % 9 == 0 else 3.0) for i in range(400)]
    rows += [(400, 1.0, *[50.0] * 6, 3.0), (7, 1.0, *[1.0] * 6, 3.0)]
    df = spark.createDataFrame(rows, "Order_ID long, " + names)
    a = an.anomaly_scores(df, an.fit_forest(df, n_trees=40)).collect()
    assert len(a) == len(rows) and max(a, key=lambda r: r.Anomaly_Score).Order_ID == 400
    for few in (rows[:1], []):
        d = spark.createDataFrame(few, "Order_ID long, " + names)
        assert an.path_scores(d, an.fit_forest(d, n_trees=5)).count() == len(few)


def test_forest_walk_equals_a_plain_walk(spark):
    """Path lengths by look-ups equal a walk of the node table in Python."""
    from keelson.operators import anomaly as an
    from keelson.plans import scored as sc
    s = sc.scored(spark, SMALL)
    forest = an.fit_forest(s, n_trees=6, psi=64)
    table = {(r.tree, r.node): r for r in forest.nodes.collect()}
    got = {r.Order_ID: r.s for r in an.path_scores(s, forest).collect()}
    for r in s.limit(200).collect():
        x, total = [float(r[c]) for c in an.ANOMALY_NUMERIC], 0.0
        for t in range(6):
            n = table[t, 1]
            while n.feature >= 0:
                n = table[t, 2 * n.node + (0 if x[n.feature] <= n.threshold else 1)]
            total += n.depth + an.c_factor(n["size"])
        assert abs(got[r.Order_ID] - 2 ** (-total / 6 / an.c_factor(64))) < 1e-8
