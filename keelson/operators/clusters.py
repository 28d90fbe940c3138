"""Risk archetypes: K-means + PCA."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.operators.ml import standardize
from keelson.operators.portfolio import density_2d
from keelson.plans.materialize import materialize

# Clustering features, archetype thresholds.
CLUSTER_NUMERIC = [
    "Base_Lead_Time_Days", "Cost_Per_Kg", "Order_Weight_Kg", "Geopolitical_Risk_Index",
    "Weather_Severity_Index", "Shipping_Cost_USD", "Schedule_Buffer_Days",
]
#: rows that the starts running at once may keep in memory together; each keeps a copy of its own
ROWS_IN_MEMORY = 40_000_000
RADAR_MEASURES = ["avg_cost_per_kg", "avg_base_lead", "avg_geo_risk", "delay_rate", "avg_risk_score"]


def starts_at_once(rows: int) -> int:
    """Four starts of a small table fill the executors; of a large one a single start does, and more would not stay in memory."""
    return max(1, min(4, ROWS_IN_MEMORY // max(1, rows)))


def fit_clusters(df: DataFrame, k: int = 5, n_init: int = 10, seed: int = 42, key: str = "Order_ID") -> DataFrame:
    """U6 + U7: best-of-n_init K-means on standardised features, clusters relabelled by size
    (largest = 0), plus a 2-component PCA of the centred standardised features."""
    if not 3 <= k <= 8:
        raise ValueError("k must be in 3..8")
    z = standardize(df, CLUSTER_NUMERIC)
    vec = VectorAssembler(inputCols=[f"z_{c}" for c in CLUSTER_NUMERIC], outputCol="zvec").transform(z)
    vec = materialize(vec.select(key, "zvec"), "cluster-vectors")  # read by every start and by PCA

    def fit(i: int):
        m = KMeans(k=k, seed=seed + i, featuresCol="zvec", predictionCol="raw_cluster", maxIter=50).fit(vec)
        return m.summary.trainingCost, i, m

    # the n_init starts are independent Spark jobs: submit some together so they share the executors
    with ThreadPoolExecutor(max_workers=min(n_init, starts_at_once(vec.count()))) as pool:
        results = list(pool.map(fit, range(n_init)))
    _, _, best = min(results, key=lambda r: (r[0], r[1]))
    assigned = best.transform(vec)
    pca = PCA(k=2, inputCol="zvec", outputCol="pc").fit(vec)
    comps = pca.pc.toArray()
    signs = [1.0 if comps[abs(comps[:, j]).argmax(), j] >= 0 else -1.0 for j in range(2)]
    out = pca.transform(assigned).select(key, "raw_cluster", vector_to_array("pc").alias("_pc"))
    sizes = out.groupBy("raw_cluster").agg(F.count(F.lit(1)).alias("_n"))
    relabel = sizes.select("raw_cluster", (F.row_number().over(Window.orderBy(F.desc("_n"), "raw_cluster")) - 1)
                           .alias("Cluster"))
    return out.join(F.broadcast(relabel), "raw_cluster").select(
        key, "Cluster", (F.col("_pc")[0] * F.lit(signs[0])).alias("PCA_1"), (F.col("_pc")[1] * F.lit(signs[1])).alias("PCA_2"))


def archetype_label(score: Column, cpk: Column, mode: Column, category: Column) -> Column:
    """U9: "{risk}: {mode}, {cost}, mostly {category}"."""
    risk = F.when(score >= 40, "High-Risk").when(score >= 20, "Elevated").otherwise("Low-Risk")
    cost = F.when(cpk >= 3, "High-Cost/kg").otherwise("Low-Cost/kg")
    return F.format_string("%s: %s, %s, mostly %s", risk, mode, cost, category)


def cluster_profile(scored: DataFrame, clusters: DataFrame, key: str = "Order_ID") -> DataFrame:
    """U8 + U9: per cluster size, mean score, delay rate, mean cost, mean cost/kg, dominant mode and
    category (ties -> alphabetically first), label; sorted by mean score descending."""
    d = scored.join(clusters.select(key, "Cluster"), key)
    p = d.groupBy("Cluster").agg(
        F.count(F.lit(1)).alias("size"),
        (F.sum("Risk_Score_Tenths").cast("double") / F.count("Risk_Score_Tenths") / F.lit(10.0)).alias("avg_risk_score"),
        (F.sum("Is_Delayed").cast("double") / F.count(F.lit(1))).alias("delay_rate"),
        F.avg("Shipping_Cost_USD").alias("avg_cost"), F.avg("Cost_Per_Kg").alias("avg_cost_per_kg"),
        F.mode("Transportation_Mode", deterministic=True).alias("dominant_mode"),
        F.mode("Product_Category", deterministic=True).alias("dominant_category"),
        F.avg("Base_Lead_Time_Days").alias("avg_base_lead"), F.avg("Geopolitical_Risk_Index").alias("avg_geo_risk"))
    return p.withColumn("archetype_label", archetype_label(F.col("avg_risk_score"), F.col("avg_cost_per_kg"),
                                                          F.col("dominant_mode"), F.col("dominant_category")))


def radar(profile: DataFrame) -> DataFrame:
    """Five measures min-max scaled across clusters (k rows); constant measure -> 0.5."""
    w = Window.partitionBy(F.lit(1))
    cols = []
    for m in RADAR_MEASURES:
        lo, hi = F.min(m).over(w), F.max(m).over(w)
        cols.append(F.when(hi - lo > 0, (F.col(m) - lo) / (hi - lo)).otherwise(F.lit(0.5)).alias(f"{m}_norm"))
    return profile.select("Cluster", *cols)


def cluster_map(clusters: DataFrame, filtered_ids: DataFrame, key: str = "Order_ID", nbins: int = 25) -> DataFrame:
    """Per-cluster 2-D density of PCA coordinates on the filtered rows; clusters under 5 rows skipped."""
    c = clusters.join(filtered_ids.select(key), key, "left_semi")
    big = c.groupBy("Cluster").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 5).select("Cluster")
    return density_2d(c.join(big, "Cluster", "left_semi"), "PCA_1", "PCA_2", nbins, by=["Cluster"])
