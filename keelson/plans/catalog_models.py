"""Registered model queries: Spark ML delay models (G1-G11, G16, K7), isolation-forest
anomalies (U1-U5, C3), K-means archetypes (U6-U11).  Trained-model outputs get a
rows-only check; the deterministic parts (indices, scaler, split, weights, metrics
on given scores, profiles on fixed cluster ids) have DuckDB twins."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import date

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from keelson.functions.features import FEATURES_CATEGORICAL, FEATURES_NUMERIC, request_features
from keelson.functions.stats import exact_quantiles
from keelson.operators import anomaly as an
from keelson.operators import clusters as cl
from keelson.operators import ml
from keelson.operators import portfolio as pf
from keelson.operators import routes as rt
from keelson.operators import scoring
from keelson.plans import scored as sc
from keelson.plans.catalog import FACET_SQL, FACETS, REQUESTS_SQL, _bin_sql, _edges, _legs, shipment_requests
from keelson.plans.materialize import materialize
from keelson.plans.oracle import with_ctes
from keelson.plans.oracle_forest import FOREST_CTES, score_sql, walk_sql
from keelson.plans.registry import register

N_TREES = 200   # G6, G7 and G16
_MODELS: dict = {}


def _split(spark, sf):
    """The features with ``is_test``: written once, read by every fit, score and count."""
    return sc._memo(spark, sf, "split", lambda: ml.with_split(sc.featured(spark, sf)))


def _model(spark, sf, kind: str, n_trees: int = N_TREES):
    k = (spark.sparkContext.applicationId, sf, kind, n_trees)
    if k not in _MODELS:
        train = _split(spark, sf).where(~F.col("is_test"))
        if kind == "gbt":
            _MODELS[k] = ml.fit_classifier(train, n_trees=n_trees)
        elif kind == "lr":
            _MODELS[k] = ml.fit_second_model(train)
        elif kind == "reg":
            _MODELS[k] = ml.fit_regressor(train, n_trees=n_trees)
    return _MODELS[k]


def _models(spark, sf, *kinds: str) -> None:
    """The models of these kinds, fitted at the same time: a fit is a row of short jobs, whose waits the others fill."""
    _split(spark, sf)   # written before the fits begin
    with ThreadPoolExecutor(len(kinds)) as fits:
        list(fits.map(lambda kind: _model(spark, sf, kind), kinds))


# ---------------------------------------------------------------- deterministic model parts (oracle)
@register("category_indices", with_ctes(
    ", vals AS (" + " UNION ALL ".join(
        f"SELECT DISTINCT '{c}' AS feature_column, {c} AS value FROM features WHERE {c} IS NOT NULL"
        for c in FEATURES_CATEGORICAL) + ")"
    " SELECT feature_column, value, CAST(dense_rank() OVER (PARTITION BY feature_column ORDER BY value) - 1 AS INTEGER)"
    " AS index, CAST(COUNT(*) OVER (PARTITION BY feature_column) AS INTEGER) AS unknown_slot FROM vals", "features"))
def q_cat_idx(spark, sf):
    return ml.category_indices(sc.featured(spark, sf))


@register("encoded_categories", with_ctes(
    ", vals AS (" + " UNION ALL ".join(
        f"SELECT DISTINCT '{c}' AS feature_column, {c} AS value FROM features WHERE {c} IS NOT NULL"
        for c in FEATURES_CATEGORICAL) + "), slots AS (SELECT feature_column, value, CAST(dense_rank() OVER (PARTITION BY feature_column"
    " ORDER BY value) - 1 AS INTEGER) AS slot FROM vals)"
    " SELECT * FROM slots UNION ALL SELECT DISTINCT feature_column, 'unseen value', CAST(NULL AS INTEGER) FROM vals", "features"))
def q_encoded(spark, sf):
    """G1: the one-hot slot of every category; an unseen one has none (all zeros)."""
    f = sc.featured(spark, sf)
    model = Pipeline(stages=ml.feature_stages(numeric=FEATURES_NUMERIC[:1])).fit(f)
    values = ml.category_indices(f).select("feature_column", "value")
    values = values.unionAll(values.select("feature_column", F.lit("unseen value")).distinct())
    given = values.select("feature_column", "value", F.lit(0).alias(FEATURES_NUMERIC[0]),
                          *[F.when(F.col("feature_column") == c, F.col("value")).otherwise(F.lit("unseen value")).alias(c) for c in FEATURES_CATEGORICAL])
    out = model.transform(given)
    slot = F.coalesce(*[F.when(F.col("feature_column") == c, F.nullif(F.array_position(vector_to_array(f"{c}__ohe"), 1.0), F.lit(0)) - 1)
                        for c in FEATURES_CATEGORICAL])
    return out.select("feature_column", "value", slot.cast("int").alias("slot"))


@register("scaler_stats", with_ctes(
    " SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, ROUND(AVG({c}), 9) AS mean, ROUND(stddev_pop({c}), 9) AS std,"
        f" ROUND(CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1e0 END, 9) AS scale FROM features"
        for c in FEATURES_NUMERIC) + ")", "features"))
def q_scaler(spark, sf):
    s = ml.scaler_stats(sc.featured(spark, sf), FEATURES_NUMERIC)
    return s.select("feature", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"),
                    F.round("scale", 9).alias("scale"))


_U_SQL = ("CAST(('0x' || substr(md5(CAST(Order_ID AS VARCHAR) || '|split|42'), 1, 13))::BIGINT AS DOUBLE)"
          " / 4503599627370496e0")
# exact stratified split: per label the ceil(0.2 n) smallest uniforms (ties broken by id) are the test set
_SPLIT_CTE = (", su AS (SELECT features.*, " + _U_SQL + " AS u FROM features),"
              " sr AS (SELECT su.*, row_number() OVER (PARTITION BY Is_Delayed ORDER BY u, Order_ID) AS rn,"
              " COUNT(*) OVER (PARTITION BY Is_Delayed) AS n FROM su),"
              " split AS (SELECT sr.* EXCLUDE (u, rn, n), rn <= CAST(ceil(0.2e0 * n) AS BIGINT) AS is_test FROM sr)")


@register("stratified_split_counts", with_ctes(
    _SPLIT_CTE + " SELECT Is_Delayed, is_test, COUNT(*) AS n FROM split GROUP BY 1, 2", "features"))
def q_split(spark, sf):
    return _split(spark, sf).groupBy("Is_Delayed", "is_test").agg(F.count(F.lit(1)).alias("n"))


@register("class_weight", with_ctes(
    _SPLIT_CTE + ", tr AS (SELECT * FROM split WHERE NOT is_test)"
    " SELECT COUNT(*) FILTER (WHERE Is_Delayed = 0) AS negatives, COUNT(*) FILTER (WHERE Is_Delayed = 1) AS positives,"
    " CAST(COUNT(*) FILTER (WHERE Is_Delayed = 0) AS DOUBLE) / GREATEST(COUNT(*) FILTER (WHERE Is_Delayed = 1), 1)"
    " AS pos_weight FROM tr", "features"))
def q_class_weight(spark, sf):
    tr = _split(spark, sf).where(~F.col("is_test"))
    return tr.agg(F.count_if(F.col("Is_Delayed") == 0).alias("negatives"),
                  F.count_if(F.col("Is_Delayed") == 1).alias("positives"),
                  (F.count_if(F.col("Is_Delayed") == 0).cast("double")
                   / F.greatest(F.count_if(F.col("Is_Delayed") == 1), F.lit(1))).alias("pos_weight"))


@register("auc_given_scores", with_ctes(
    ", g AS (SELECT Predicted_Delay_Probability AS s, COUNT(*) FILTER (WHERE Is_Delayed = 1) AS pos,"
    " COUNT(*) FILTER (WHERE Is_Delayed <> 1) AS neg FROM scored GROUP BY 1),"
    " cum AS (SELECT g.*, COALESCE(SUM(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb,"
    " COALESCE(SUM(pos) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb FROM g),"
    " t AS (SELECT SUM(pos) AS P, SUM(neg) AS N FROM g)"
    " SELECT ROUND((SUM(pos * nb) + 0.5e0 * SUM(pos * neg)) / (MAX(P) * MAX(N)), 10) AS roc_auc,"
    " ROUND(SUM(CAST(pos AS DOUBLE) / P * ((P - pb) / ((P - pb) + (N - nb)))), 10) AS average_precision"
    " FROM cum CROSS JOIN t"))
def q_auc_given(spark, sf):
    m = ml.evaluate(sc.scored(spark, sf), "Predicted_Delay_Probability")
    return m.select(F.round("roc_auc", 10).alias("roc_auc"), F.round("average_precision", 10).alias("average_precision"))


_FIXED_CLUSTER = "CAST(Order_ID % 5 AS INTEGER)"
_PROFILE_SQL = f""",
cd AS (SELECT scored.*, {_FIXED_CLUSTER} AS Cluster FROM scored),
modes AS (SELECT Cluster, Transportation_Mode AS v, row_number() OVER (PARTITION BY Cluster ORDER BY COUNT(*) DESC,
          Transportation_Mode) AS r FROM cd GROUP BY Cluster, Transportation_Mode),
cats AS (SELECT Cluster, Product_Category AS v, row_number() OVER (PARTITION BY Cluster ORDER BY COUNT(*) DESC,
         Product_Category) AS r FROM cd GROUP BY Cluster, Product_Category),
prof AS (
  SELECT cd.Cluster, COUNT(*) AS size,
    CAST(SUM(Risk_Score_Tenths) AS DOUBLE) / COUNT(Risk_Score_Tenths) / 1e1 AS avg_risk_score,
    CAST(SUM(Is_Delayed) AS DOUBLE) / COUNT(*) AS delay_rate, AVG(Shipping_Cost_USD) AS avg_cost,
    AVG(Cost_Per_Kg) AS avg_cost_per_kg, AVG(Base_Lead_Time_Days) AS avg_base_lead,
    AVG(Geopolitical_Risk_Index) AS avg_geo_risk
  FROM cd GROUP BY cd.Cluster),
profile AS (
  SELECT p.*, m.v AS dominant_mode, c.v AS dominant_category,
    CASE WHEN avg_risk_score >= 40 THEN 'High-Risk' WHEN avg_risk_score >= 20 THEN 'Elevated' ELSE 'Low-Risk' END
    || ': ' || m.v || ', ' || CASE WHEN avg_cost_per_kg >= 3 THEN 'High-Cost/kg' ELSE 'Low-Cost/kg' END
    || ', mostly ' || c.v AS archetype_label
  FROM prof p JOIN modes m ON p.Cluster = m.Cluster AND m.r = 1 JOIN cats c ON p.Cluster = c.Cluster AND c.r = 1)"""


def _fixed_clusters(spark, sf):
    return sc.scored(spark, sf).select("Order_ID", (F.col("Order_ID") % 5).cast("int").alias("Cluster"))


@register("cluster_profile_fixed", with_ctes(
    _PROFILE_SQL + " SELECT Cluster, size, ROUND(avg_risk_score, 6) AS avg_risk_score, ROUND(delay_rate, 9) AS delay_rate,"
    " ROUND(avg_cost, 4) AS avg_cost, ROUND(avg_cost_per_kg, 6) AS avg_cost_per_kg, dominant_mode, dominant_category,"
    " archetype_label FROM profile"))
def q_profile_fixed(spark, sf):
    p = cl.cluster_profile(sc.scored(spark, sf), _fixed_clusters(spark, sf))
    return p.select("Cluster", "size", F.round("avg_risk_score", 6).alias("avg_risk_score"),
                    F.round("delay_rate", 9).alias("delay_rate"), F.round("avg_cost", 4).alias("avg_cost"),
                    F.round("avg_cost_per_kg", 6).alias("avg_cost_per_kg"), "dominant_mode", "dominant_category",
                    "archetype_label")


@register("cluster_radar_fixed", with_ctes(
    _PROFILE_SQL + " SELECT Cluster, " + ", ".join(
        f"ROUND(CASE WHEN MAX({m}) OVER () - MIN({m}) OVER () > 0 THEN ({m} - MIN({m}) OVER ())"
        f" / (MAX({m}) OVER () - MIN({m}) OVER ()) ELSE 0.5e0 END, 6) AS {m}_norm" for m in cl.RADAR_MEASURES)
    + " FROM profile"))
def q_radar_fixed(spark, sf):
    r = cl.radar(cl.cluster_profile(sc.scored(spark, sf), _fixed_clusters(spark, sf)))
    return r.select("Cluster", *[F.round(f"{m}_norm", 6).alias(f"{m}_norm") for m in cl.RADAR_MEASURES])


# ---------------------------------------------------------------- trained models (rows-only checks)
@register("delay_model_auc", None)
def q_model_auc(spark, sf):
    """G6 + G8 evaluated on the same hash split."""
    test = _two_models(spark, sf).where(F.col("is_test"))
    out = None
    for name, col in (("boosted_trees", "p_boosted"), ("logistic", "p_logistic")):
        m = ml.evaluate(test, col).select(F.lit(name).alias("model"), "roc_auc", "average_precision")
        out = m if out is None else out.unionByName(m)
    return out.crossJoin(test.agg(F.count(F.lit(1)).alias("n_test")))


@register("delay_days_model", None)
def q_days_model(spark, sf):
    """Clipped regressor predictions for every shipment."""
    return _with_days(spark, sf).select("Order_ID", "Delay_Days", F.col("days").alias("Predicted_Delay_Days"))


def _both_probabilities(spark, sf):
    """The models are chained over the same rows; no join by id."""
    d = ml.positive_probability(_model(spark, sf, "gbt"), _split(spark, sf), "p_boosted")
    return ml.positive_probability(_model(spark, sf, "lr"), d, "p_logistic")


def _two_models(spark, sf):
    """Both probabilities, at least with the columns ``CARRIED``."""
    def build():
        _models(spark, sf, "gbt", "lr")
        return _both_probabilities(spark, sf)
    if sc._written(spark, sf, "with_days"):   # it has these columns too
        return _with_days(spark, sf).drop("days")
    return sc._memo(spark, sf, "two_models", build)


#: what the queries on the predictions need of a shipment beside them; the features stay in the split
CARRIED = ["Order_ID", "Route", "Transportation_Mode", "Product_Category", "External_Risk_Pressure", "Is_Delayed", "Delay_Days", "is_test"]


def _with_days(spark, sf):
    """Both probabilities and the regressor's clipped days for every shipment, written in one pass."""
    def build():
        _models(spark, sf, "gbt", "lr", "reg")
        d = _two_models(spark, sf) if sc._written(spark, sf, "two_models") else _both_probabilities(spark, sf)
        return ml.predict_days(_model(spark, sf, "reg"), d, "days").select(*CARRIED, "p_boosted", "p_logistic", "days")
    return sc._memo(spark, sf, "with_days", build)


@register("two_model_agreement", None)
def q_agreement(spark, sf):
    """G9 + D5: both models on every shipment, agreement label and review flag."""
    t = _two_models(spark, sf)
    return t.select("Order_ID", "p_boosted", "p_logistic",
                    scoring.model_agreement(F.col("p_boosted"), F.col("p_logistic")).alias("agreement"),
                    scoring.needs_review(F.col("p_boosted"), F.col("p_logistic")).alias("needs_review"))


@register("model_agreement_rule", with_ctes(
    ", r AS (SELECT Order_ID, Predicted_Delay_Probability AS p1, combo_r.rate AS p2 FROM scored"
    " JOIN combo_r USING (Route_Type, Transportation_Mode, Product_Category))"
    " SELECT Order_ID, CASE WHEN abs(p1 - p2) < 0.15 THEN 'Close' WHEN abs(p1 - p2) < 0.40 THEN 'Some Disagreement'"
    " ELSE 'High Disagreement' END AS agreement, abs(p1 - p2) >= 0.40 AS needs_review FROM r"))
def q_agreement_rule(spark, sf):
    """D5 on given probabilities: fallback rate vs raw combo rate."""
    from keelson.operators.rates import combo_rates
    s = sc.scored(spark, sf)
    c = combo_rates(sc.featured(spark, sf)).select("Route_Type", "Transportation_Mode", "Product_Category",
                                                    F.col("delay_rate").alias("p2"))
    j = s.join(c, ["Route_Type", "Transportation_Mode", "Product_Category"])
    return j.select("Order_ID", scoring.model_agreement(F.col("Predicted_Delay_Probability"), F.col("p2")).alias("agreement"),
                    scoring.needs_review(F.col("Predicted_Delay_Probability"), F.col("p2")).alias("needs_review"))


DEPARTURE = date(2024, 1, 1)


def _edge_classifier(spark, sf, departure: date = DEPARTURE):
    """K3 + K7: every edge's synthetic shipment on the departure date, scored by the classifier in one batch."""
    e = _edges(spark, sf)
    req = e.select("mode", "category", "a_port_idx", "b_port_idx", "a_port", "b_port", "route_type",
                   F.col("transit_days").alias("base_lead_time"), F.col("scheduled_lead_time"),
                   F.col("geo_risk"), F.col("weather_risk"), F.col("inflation"), F.col("cost_usd").alias("shipping_cost"),
                   F.lit(rt.DEFAULT_ORDER_WEIGHT_KG).alias("order_weight"), F.lit(departure.month).alias("order_month"),
                   F.lit(departure.weekday()).alias("day_of_week"), F.col("a_port").alias("origin"), F.col("b_port").alias("destination"))
    feats = request_features(req.withColumnRenamed("route_type", "_rt").withColumn("route_type", F.col("_rt")))
    return ml.positive_probability(_model(spark, sf, "gbt"), feats, "classifier_probability")


@register("edge_classifier_probability", None)
def q_edge_clf(spark, sf):
    """K7: the classifier's probability for each route edge."""
    return _edge_classifier(spark, sf).select(
        F.col("Transportation_Mode").alias("mode"), F.col("Product_Category").alias("category"),
        F.col("Origin_City").alias("a_port"), F.col("Destination_City").alias("b_port"), "classifier_probability")


@register("route_legs_classifier", None)
def q_legs_clf(spark, sf):
    """The legs of every best route with the base rate's and the classifier's probability."""
    p = materialize(_edge_classifier(spark, sf).select(
        F.col("Transportation_Mode").alias("_m"), F.col("Product_Category").alias("_c"), F.col("a_port_idx").alias("_a"),
        F.col("b_port_idx").alias("_b"), "classifier_probability"), "edge-classifier")   # 465 edges a graph
    legs = _legs(spark, sf)
    return legs.join(p, (F.col("mode") == F.col("_m")) & (F.col("category") == F.col("_c"))
                     & (F.least("from_idx", "to_idx") == F.col("_a")) & (F.greatest("from_idx", "to_idx") == F.col("_b"))).select(
        "mode", "category", "priority", "src", "dst", "leg_no", "from_idx", "to_idx", "delay_probability", "classifier_probability")


@register("weather_uplift", None)
def q_uplift(spark, sf):
    """Baseline vs weather-extended classifier on rows complete in the 3 real-weather columns."""
    from keelson.operators.weather import REAL_LABELS, merge_weather
    from keelson.plans.catalog_landed import _wx_rows_ledger
    from keelson.sources import landing
    real = list(REAL_LABELS)
    rows, _ = _wx_rows_ledger(spark, sf)
    valid = materialize(merge_weather(sc.featured(spark, sf), rows, landing.weather_requests(spark)).na.drop(subset=real), "uplift-rows")
    n = valid.count()
    if n < 500:
        return spark.createDataFrame([(n, None, None, None, "not enough rows")],
                                     "n_valid long, auc_base double, auc_ext double, uplift double, verdict string")
    d = materialize(ml.with_split(valid), "uplift-split")
    tr, te = d.where(~F.col("is_test")), d.where(F.col("is_test"))

    def auc(numeric):
        m = ml.fit_classifier(tr, n_trees=N_TREES, numeric=numeric)
        return ml.roc_auc(ml.positive_probability(m, te, "p"), "p").collect()[0][0]
    with ThreadPoolExecutor(2) as fits:   # both at the same time, as in _models
        aucs = list(fits.map(auc, (FEATURES_NUMERIC, FEATURES_NUMERIC + real)))
    up = aucs[1] - aucs[0]
    return spark.createDataFrame([(n, aucs[0], aucs[1], up, "uplift" if up > 0.01 else "no meaningful uplift")],
                                 "n_valid long, auc_base double, auc_ext double, uplift double, verdict string")


# ---------------------------------------------------------------- anomalies
def _forest(spark, sf):
    k = (spark.sparkContext.applicationId, sf, "forest")
    if k not in _MODELS:
        _MODELS[k] = an.fit_forest(sc.scored(spark, sf))
    return _MODELS[k]


def _anomalies(spark, sf):
    carry = ("Order_ID", "Route", "Route_Type", "Transportation_Mode", "Product_Category", "Cost_Per_Kg",
             "Shipment_Risk_Score", "Risk_Tier")
    return sc._memo(spark, sf, "anomalies", lambda: an.anomaly_scores(sc.scored(spark, sf), _forest(spark, sf), carry))


@register("anomaly_scores", with_ctes(FOREST_CTES + " SELECT Order_ID, ROUND(Anomaly_Score, 9) AS Anomaly_Score, Is_Anomaly FROM anomalies"))
def q_anomaly_scores(spark, sf):
    """U1 + U2: score and flag for every shipment (about 5 % flagged)."""
    return _anomalies(spark, sf).select("Order_ID", F.round("Anomaly_Score", 9).alias("Anomaly_Score"), "Is_Anomaly")


@register("forest_nodes", with_ctes(
    FOREST_CTES + " SELECT tree, node, feature, ROUND(threshold, 9) AS threshold, size, depth, length FROM nodes"))
def q_forest_nodes(spark, sf):
    """The fitted forest."""
    n = _forest(spark, sf).nodes
    return n.select(F.col("tree").cast("bigint").alias("tree"), "node", "feature", F.round("threshold", 9).alias("threshold"), "size", "depth", "length")


@register("anomaly_summary", with_ctes(
    FOREST_CTES + " SELECT COUNT(*) FILTER (WHERE Is_Anomaly) AS anomalies, ROUND(AVG(CAST(Is_Anomaly AS DOUBLE)) * 100, 1) AS anomaly_pct,"
    f" COUNT(*) FILTER (WHERE Is_Anomaly AND Risk_Tier = 'Low') AS anomaly_low_tier FROM anomalies WHERE {FACET_SQL}"))
def q_anomaly_summary(spark, sf):
    """U4 on the faceted filter."""
    return an.anomaly_kpis(pf.faceted_filter(_anomalies(spark, sf), **FACETS))


_FLAGGED = ("Order_ID, Route, Transportation_Mode, Product_Category, Cost_Per_Kg, Shipment_Risk_Score, Risk_Tier,"
            " ROUND(Anomaly_Score, 9) AS Anomaly_Score")


def _rounded(df):
    return df.withColumn("Anomaly_Score", F.round("Anomaly_Score", 9))


@register("top_flagged_anomalies", with_ctes(
    FOREST_CTES + f" SELECT {_FLAGGED} FROM anomalies a WHERE Is_Anomaly ORDER BY a.Anomaly_Score DESC, Order_ID LIMIT 50"))
def q_top_flagged(spark, sf):
    """50 flagged shipments with the highest anomaly score."""
    return _rounded(an.top_flagged(_anomalies(spark, sf), 50))


@register("top_flagged_anomalies_filtered", with_ctes(
    FOREST_CTES + f" SELECT {_FLAGGED} FROM anomalies a WHERE Is_Anomaly AND {FACET_SQL} ORDER BY a.Anomaly_Score DESC, Order_ID LIMIT 50"))
def q_top_flagged_filtered(spark, sf):
    """C3 on the faceted filter."""
    return _rounded(an.top_flagged(pf.faceted_filter(_anomalies(spark, sf), **FACETS), 50))


@register("flagged_points", with_ctes(
    FOREST_CTES + " SELECT Order_ID, Cost_Per_Kg, Shipment_Risk_Score, Risk_Tier, ROUND(Anomaly_Score, 9) AS Anomaly_Score,"
    f" Route || ', ' || Transportation_Mode || ', ' || Product_Category AS label FROM anomalies WHERE Is_Anomaly AND {FACET_SQL}"))
def q_flagged_points(spark, sf):
    """The flagged points with labels, on the faceted filter."""
    return _rounded(an.flagged_points(pf.faceted_filter(_anomalies(spark, sf), **FACETS)))


@register("anomaly_density", with_ctes(
    FOREST_CTES + f", d AS (SELECT * FROM anomalies WHERE NOT Is_Anomaly AND Cost_Per_Kg IS NOT NULL AND Shipment_Risk_Score IS NOT NULL AND {FACET_SQL}),"
    " mm AS (SELECT MIN(Cost_Per_Kg) AS xlo, MAX(Cost_Per_Kg) AS xhi, MIN(Shipment_Risk_Score) AS ylo, MAX(Shipment_Risk_Score) AS yhi FROM d)"
    f" SELECT {_bin_sql('Cost_Per_Kg', 'xlo', 'xhi', 25)} AS x_bin, {_bin_sql('Shipment_Risk_Score', 'ylo', 'yhi', 25)} AS y_bin, COUNT(*) AS shipments"
    " FROM d CROSS JOIN mm GROUP BY 1, 2"))
def q_anomaly_density(spark, sf):
    """Density of normal rows on cost/kg x score, on the faceted filter."""
    s = pf.faceted_filter(_anomalies(spark, sf), **FACETS).where(~F.col("Is_Anomaly"))
    return pf.density_2d(s, "Cost_Per_Kg", "Shipment_Risk_Score", 25)


@register("request_anomalies", with_ctes(
    REQUESTS_SQL + FOREST_CTES + walk_sql("req", "req_features") + ", rs AS (SELECT Order_ID, " + score_sql("len_sum") + " AS s FROM req_total)"
    " SELECT Order_ID AS request_id, ROUND(s - (SELECT off FROM cutoff), 9) AS anomaly_score, s > (SELECT off FROM cutoff) AS is_anomaly FROM rs"))
def q_request_anomalies(spark, sf):
    """Hypothetical-shipment requests scored against the fitted forest and offset."""
    forest = _forest(spark, sf)
    offset = _anomalies(spark, sf).select("anomaly_offset").limit(1).collect()[0][0]
    req = request_features(shipment_requests(spark, sf)).withColumnRenamed("Order_ID", "request_id")
    return an.score_requests(req, forest, offset, key="request_id").withColumn("anomaly_score", F.round("anomaly_score", 9))


# ---------------------------------------------------------------- clusters
def _clusters(spark, sf):
    return sc._memo(spark, sf, "clusters", lambda: cl.fit_clusters(sc.featured(spark, sf), k=5, n_init=10))


@register("cluster_assignments", None)
def q_cluster_assign(spark, sf):
    """U6 + U7: cluster id (size-ordered) and PCA coordinates per shipment."""
    return _clusters(spark, sf)


@register("cluster_profile", None)
def q_cluster_profile(spark, sf):
    """U8 + U9 on K-means clusters."""
    return cl.cluster_profile(sc.scored(spark, sf), _clusters(spark, sf)).orderBy(F.desc("avg_risk_score"))


@register("cluster_radar", None)
def q_cluster_radar(spark, sf):
    """U10 on K-means clusters."""
    return cl.radar(cl.cluster_profile(sc.scored(spark, sf), _clusters(spark, sf)))


@register("cluster_map", None)
def q_cluster_map(spark, sf):
    """PCA density per cluster on the filtered rows."""
    s = sc.scored(spark, sf)
    return cl.cluster_map(_clusters(spark, sf), pf.faceted_filter(s, **FACETS))


# ---------------------------------------------------------------- explanations (linear stand-in)
from keelson.operators import explain as xp  # noqa: E402
from keelson.plans.oracle import pct1  # noqa: E402

_F = FEATURES_NUMERIC


def _contrib(spark, sf):
    return sc._memo(spark, sf, "contrib", lambda: xp.linear_contributions(sc.scored(spark, sf), _F))


def _label_sql(expr: str) -> str:
    return f"replace(replace(replace({expr}, 'num__', ''), 'cat__', ''), '_', ' ')"


_CONTRIB_SQL = (
    ", cstat AS (SELECT " + ", ".join(
        f"corr(CAST({c} AS DOUBLE), CAST(Is_Delayed AS DOUBLE)) AS c{i}, AVG({c}) AS m{i}, stddev_pop({c}) AS s{i}"
        for i, c in enumerate(_F)) + " FROM scored),"
    " contrib AS (" + " UNION ALL ".join(
        f"SELECT Order_ID, 'num__{c}' AS feature, ROUND(COALESCE(c{i}, 0e0) * ((CAST({c} AS DOUBLE) - m{i})"
        f" / CASE WHEN s{i} > 0 THEN s{i} ELSE 1e0 END), 9) AS value, CAST({c} AS DOUBLE) AS x FROM scored CROSS JOIN cstat"
        for i, c in enumerate(_F)) + ")")


@register("feature_labels", with_ctes(
    ", names AS (SELECT * FROM (VALUES " + ", ".join(f"('num__{c}')" for c in _F) + ") AS t(feature)"
    " UNION ALL SELECT DISTINCT 'cat__Origin_City_' || Origin_City FROM features"
    " UNION ALL SELECT DISTINCT 'cat__Transportation_Mode_' || Transportation_Mode FROM features)"
    f" SELECT feature, {_label_sql('feature')} AS label FROM names", "features"))
def q_feature_labels(spark, sf):
    """Readable labels for the model's feature names (numeric and one-hot)."""
    f = sc.featured(spark, sf)
    names = (spark.createDataFrame([(f"num__{c}",) for c in _F], "feature string")
             .unionByName(f.select(F.concat(F.lit("cat__Origin_City_"), "Origin_City").alias("feature")).distinct())
             .unionByName(f.select(F.concat(F.lit("cat__Transportation_Mode_"), "Transportation_Mode")
                                   .alias("feature")).distinct()))
    return names.select("feature", scoring.clean_feature_label(F.col("feature")).alias("label"))


@register("global_importance", with_ctes(
    _CONTRIB_SQL + f" SELECT {_label_sql('feature')} AS label, feature, ROUND(AVG(abs(value)), 9) AS mean_abs"
    " FROM contrib GROUP BY feature ORDER BY mean_abs DESC, feature LIMIT 15"))
def q_global_importance(spark, sf):
    g = xp.global_importance(_contrib(spark, sf), 15)
    return g.select("label", "feature", F.round("mean_abs", 9).alias("mean_abs"))


@register("top_drivers", with_ctes(
    _CONTRIB_SQL + ", r AS (SELECT contrib.*, row_number() OVER (PARTITION BY Order_ID ORDER BY abs(value) DESC,"
    " feature) AS abs_rank FROM contrib), t AS (SELECT * FROM r WHERE abs_rank <= 10)"
    " SELECT Order_ID, abs_rank, row_number() OVER (PARTITION BY Order_ID ORDER BY value, feature) AS signed_rank,"
    f" {_label_sql('feature')} AS label, value FROM t"))
def q_top_drivers(spark, sf):
    arrays = xp.linear_contribution_arrays(sc.scored(spark, sf), _F)
    return xp.top_drivers_rowwise(arrays, 10)


@register("beeswarm", with_ctes(
    _CONTRIB_SQL + ", keep AS (SELECT feature FROM contrib GROUP BY feature ORDER BY AVG(abs(value)) DESC, feature"
    " LIMIT 12), c2 AS (SELECT contrib.* FROM contrib JOIN keep USING (feature)),"
    " mm AS (SELECT feature, MIN(x) AS lo, MAX(x) AS hi FROM c2 GROUP BY feature)"
    f" SELECT Order_ID, {_label_sql('c2.feature')} AS label, value,"
    " ROUND((x - lo) / (hi - lo + 1e-9), 9) AS color_value FROM c2 JOIN mm USING (feature)"))
def q_beeswarm(spark, sf):
    return xp.beeswarm(_contrib(spark, sf), 12)


_REC = (f"CASE WHEN Risk_Tier IN ('High', 'Severe') THEN '{scoring.REC_HIGH}'"
        f" WHEN Risk_Tier = 'Medium' THEN '{scoring.REC_MEDIUM}' ELSE '{scoring.REC_LOW}' END")


@register("underwriting_memo", with_ctes(
    _CONTRIB_SQL + ", r AS (SELECT contrib.*, row_number() OVER (PARTITION BY Order_ID ORDER BY abs(value) DESC,"
    " feature) AS k FROM contrib), t3 AS (SELECT * FROM r WHERE k <= 3),"
    f" up AS (SELECT Order_ID, string_agg({_label_sql('feature')}, ', ' ORDER BY k) AS u FROM t3 WHERE value > 0 GROUP BY 1),"
    f" dn AS (SELECT Order_ID, string_agg({_label_sql('feature')}, ', ' ORDER BY k) AS d FROM t3 WHERE value < 0 GROUP BY 1),"
    " tr AS (SELECT Risk_Tier, CAST(SUM(Is_Delayed) AS DOUBLE) / COUNT(*) * 1e2 AS rate FROM scored GROUP BY 1)"
    " SELECT s.Order_ID, concat_ws(' ',"
    " 'Shipment (' || concat_ws(', ', s.Origin_City || ' -> ' || s.Destination_City, s.Transportation_Mode,"
    " s.Product_Category) || ') is scored in the **' || upper(s.Risk_Tier) || '** risk tier, with a predicted delay"
    " probability of ' || printf('%.1f', round_even(s.Predicted_Delay_Probability * 1e2 * 1e1, 0) / 1e1)"
    " || '% and an expected delay of ' || printf('%.1f', round_even(s.Predicted_Delay_Days * 1e1, 0) / 1e1)"
    " || ' day(s). Historically, shipments in the ' || s.Risk_Tier || ' tier were delayed '"
    " || COALESCE(printf('%.1f', round_even(tr.rate * 1e1, 0) / 1e1) || '%', 'n/a') || ' of the time.',"
    " 'Risk is primarily driven up by: ' || up.u || '.', 'Risk is partially offset by: ' || dn.d || '.', "
    + _REC.replace("Risk_Tier", "s.Risk_Tier") + ") AS memo"
    " FROM scored s LEFT JOIN up ON s.Order_ID = up.Order_ID LEFT JOIN dn ON s.Order_ID = dn.Order_ID"
    " LEFT JOIN tr ON s.Risk_Tier = tr.Risk_Tier WHERE s.Risk_Tier IS NOT NULL"))
def q_memo(spark, sf):
    s = sc.scored(spark, sf)
    return xp.memos(xp.with_contribution_array(s, _F), pf.tier_calibration(s))


# ---------------------------------------------------------------- G12: exact tree contributions
from keelson.operators import tree_shap  # noqa: E402


def _tree_contrib(spark, sf):
    k = (spark.sparkContext.applicationId, sf, "tree_contrib")
    if k not in _MODELS:
        arrays, bias = tree_shap.tree_contributions(_model(spark, sf, "gbt"), _split(spark, sf))
        _MODELS[k] = (materialize(arrays, "tree-contrib"), bias)   # one row per shipment
    return _MODELS[k]


@register("tree_contributions", None)
def q_tree_contrib(spark, sf):
    """Log-odds contribution of every model feature for every shipment."""
    return xp.exploded(_tree_contrib(spark, sf)[0]).select("Order_ID", "feature", "value")


def _tree_error(spark, sf):
    arrays, bias = _tree_contrib(spark, sf)
    total = F.aggregate("contribs", F.lit(0.0), lambda a, c: a + c["value"])
    p = _two_models(spark, sf).select("Order_ID", F.col("p_boosted").alias("p"))
    margin = F.log(F.col("p") / (F.lit(1.0) - F.col("p")))
    return (arrays.select("Order_ID", total.alias("_sum")).join(p, "Order_ID")
            .agg(F.count(F.lit(1)).alias("rows"), F.lit(bias).alias("bias"),
                 F.max(F.abs(F.lit(bias) + F.col("_sum") - margin)).alias("max_abs_error")))


@register("tree_contribution_additivity", None)
def q_tree_additivity(spark, sf):
    """G12 check: bias + sum of contributions equals the model's log-odds margin for every row."""
    return _tree_error(spark, sf)


@register("tree_global_importance", None)
def q_tree_importance(spark, sf):
    """G13 over the exact tree contributions (whole table, no sample)."""
    return xp.global_importance_of_arrays(_tree_contrib(spark, sf)[0], 15)


@register("tree_top_drivers", None)
def q_tree_drivers(spark, sf):
    """G14 on the model: the ten strongest tree contributions of every shipment."""
    return xp.top_drivers_rowwise(_tree_contrib(spark, sf)[0], 10)


@register("tree_beeswarm", None)
def q_tree_beeswarm(spark, sf):
    """G15 on the model, one-hot features included."""
    return xp.beeswarm(xp.exploded(_tree_contrib(spark, sf)[0]), 12)


# ---------------------------------------------------------------- the model-scored portfolio and requests
def _model_scored(spark, sf):
    """G6 probability and G7 days -> D1 -> D2; no outcome column feeds a prediction."""
    def build():
        d = _with_days(spark, sf).withColumn("Predicted_Delay_Probability", F.col("p_boosted")).withColumn("Predicted_Delay_Days", F.col("days"))
        return scoring.portfolio_score(d)
    return sc._memo(spark, sf, "model_scored", build)


@register("model_scored_portfolio", None)
def q_model_scored(spark, sf):
    """D1 + D2 on the models' predictions for every shipment."""
    return _model_scored(spark, sf).select("Order_ID", "Predicted_Delay_Probability", "Predicted_Delay_Days", "Shipment_Risk_Score", "Risk_Tier")


@register("model_tier_calibration", None)
def q_model_calibration(spark, sf):
    """E4 on the model-scored portfolio."""
    return pf.tier_calibration(_model_scored(spark, sf))


@register("model_underwriting_memo", None)
def q_model_memo(spark, sf):
    """D7 on the model: its prediction, its tier and its own drivers."""
    s = _model_scored(spark, sf)
    top, contribs = tree_shap.strongest_contributions(_model(spark, sf, "gbt"), _split(spark, sf), scoring.MEMO_DRIVERS)
    rows = s.select("Order_ID", "Route", "Transportation_Mode", "Product_Category", "Risk_Tier", "Predicted_Delay_Probability",
                    "Predicted_Delay_Days").join(top, "Order_ID").withColumn("contribs", contribs)
    return xp.memos(rows, pf.tier_calibration(s))


def _model_requests(spark, sf):
    def build():
        req = request_features(shipment_requests(spark, sf))
        _models(spark, sf, "gbt", "lr", "reg")
        d = ml.positive_probability(_model(spark, sf, "gbt"), req, "first_probability")
        d = ml.positive_probability(_model(spark, sf, "lr"), d, "second_probability")
        d = ml.predict_days(_model(spark, sf, "reg"), d, "expected_delay_days").withColumnRenamed("first_probability", "probability")
        d = scoring.score_requests(d)
        return d.withColumns({"agreement": scoring.model_agreement(F.col("probability"), F.col("second_probability")),
                              "needs_review": scoring.needs_review(F.col("probability"), F.col("second_probability")),
                              "note": scoring.underwriting_note(F.col("risk_tier"))})
    return sc._memo(spark, sf, "model_requests", build)


@register("model_request_scores", None)
def q_model_requests(spark, sf):
    """G6 + G7 + G8 -> D3 -> D4 -> D5 -> D6 for every hypothetical shipment, one row each."""
    return _model_requests(spark, sf).select("Order_ID", "probability", "second_probability", "expected_delay_days", "risk_score",
                                             "risk_tier", "agreement", "needs_review", "note")


# ---------------------------------------------------------------- invariants of the model queries, with exact twins
def _holds(cond):
    return F.coalesce(F.min(cond.cast("int")) == 1, F.lit(True))


_COUNT_SQL = "SELECT COUNT(*) AS n_rows, "


@register("delay_model_invariants", with_ctes(
    _SPLIT_CTE + " SELECT COUNT(*) AS n_test, true AS auc_above_floor, true AS ap_above_rate FROM split WHERE is_test", "features"))
def q_model_invariants(spark, sf):
    """Both models rank the held-out rows far better than chance."""
    test = _two_models(spark, sf).where(F.col("is_test"))
    rate = test.agg(F.avg(F.col("Is_Delayed").cast("double")).alias("rate"), F.count(F.lit(1)).alias("n_test"))
    m = q_model_auc(spark, sf).crossJoin(F.broadcast(rate.select("rate")))
    ok = m.agg(_holds(F.col("roc_auc") > 0.6).alias("auc_above_floor"), _holds(F.col("average_precision") > F.col("rate")).alias("ap_above_rate"))
    return rate.select("n_test").crossJoin(ok)


@register("model_prediction_invariants", with_ctes(
    " " + _COUNT_SQL + "true AS probabilities_hold, true AS days_hold, true AS agreement_holds FROM features", "features"))
def q_prediction_invariants(spark, sf):
    """Probabilities in [0, 1], clipped days, labels by the gap; one row per shipment."""
    d = _with_days(spark, sf)
    gap = F.abs(F.col("p_boosted") - F.col("p_logistic"))
    label = scoring.model_agreement(F.col("p_boosted"), F.col("p_logistic"))
    want = F.when(gap >= 0.40, "High Disagreement").when(gap >= 0.15, "Some Disagreement").otherwise("Close")
    return d.agg(F.count(F.lit(1)).alias("n_rows"), _holds(F.col("p_boosted").between(0, 1) & F.col("p_logistic").between(0, 1)).alias("probabilities_hold"),
                 _holds(F.col("days") >= 0).alias("days_hold"), _holds(label == want).alias("agreement_holds"))


@register("model_score_rule", with_ctes(
    " " + _COUNT_SQL + "true AS scores_hold, true AS tiers_hold FROM features", "features"))
def q_score_rule(spark, sf):
    """D1, D2 on the model-scored table: scores and tiers recomputed from the stored predictions by other means."""
    s = _model_scored(spark, sf)
    q = exact_quantiles(s, {"dq": ("Predicted_Delay_Days", 0.99), "eq": ("External_Risk_Pressure", 0.99)})
    d = s.crossJoin(F.broadcast(q))   # a 1-row statistic
    raw = 100 * (0.5 * F.col("Predicted_Delay_Probability") + 0.3 * F.least(F.col("Predicted_Delay_Days") / F.col("dq"), F.lit(1.0))
                 + 0.2 * F.least(F.greatest(F.col("External_Risk_Pressure") / F.col("eq"), F.lit(0.0)), F.lit(1.0)))
    x = F.col("Shipment_Risk_Score")
    tier = F.when(x <= 20, "Low").when(x <= 40, "Medium").when(x <= 65, "High").otherwise("Severe")
    place = 0.99 * (F.count(F.lit(1)) - 1)

    def in_place(value: str, quantile: str):
        """As many rows lie below and up to the quantile as its place asks for, by counting."""
        return (F.count_if(F.col(value) < F.col(quantile)) <= F.ceil(place)) & (F.count_if(F.col(value) <= F.col(quantile)) > F.floor(place))
    return d.agg(F.count(F.lit(1)).alias("n_rows"),
                 (_holds(F.abs(x - raw) <= 0.0500001) & in_place("Predicted_Delay_Days", "dq") & in_place("External_Risk_Pressure", "eq")).alias("scores_hold"),
                 _holds(tier == F.col("Risk_Tier")).alias("tiers_hold"))


@register("tree_additivity_holds", with_ctes(" " + _COUNT_SQL + "true AS additive FROM features", "features"))
def q_additivity_holds(spark, sf):
    return _tree_error(spark, sf).select(F.col("rows").alias("n_rows"), (F.col("max_abs_error") < 1e-9).alias("additive"))


@register("anomaly_invariants", with_ctes(
    " " + _COUNT_SQL + "true AS share_holds, true AS flags_hold FROM features", "features"))
def q_anomaly_invariants(spark, sf):
    """Five per cent are flagged (ties aside), exactly those with a positive score."""
    a = _anomalies(spark, sf)
    return a.agg(F.count(F.lit(1)).alias("n_rows"), (F.abs(F.avg(F.col("Is_Anomaly").cast("double")) - an.CONTAMINATION) < 0.005).alias("share_holds"),
                 _holds(F.col("Is_Anomaly") == (F.col("Anomaly_Score") > 0)).alias("flags_hold"))


@register("cluster_invariants", with_ctes(
    " SELECT CAST(COUNT(*) AS BIGINT) AS n_rows, 5 AS n_clusters, true AS sizes_descend FROM features", "features"))
def q_cluster_invariants(spark, sf):
    """Every shipment is in one of five clusters, numbered by size."""
    sizes = _clusters(spark, sf).groupBy("Cluster").agg(F.count(F.lit(1)).alias("n"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("Cluster", "n"))), lambda s: s["n"])   # five rows
    return sizes.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).cast("int").alias("n_clusters"), ordered.alias("s")).select(
        "n_rows", "n_clusters", (F.col("s") == F.reverse(F.array_sort("s"))).alias("sizes_descend"))
