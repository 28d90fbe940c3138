"""Delay models with Spark ML.

Feature pipeline = StringIndexer(alphabetAsc, keep) -> OneHotEncoder(dropLast)
-> VectorAssembler; the split is exact and stratified (a hash threshold per
class from the quantile helper); metrics are computed with aggregations and
bucketed prefix sums so no step puts the whole table in one task.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions.features import FEATURES_CATEGORICAL, FEATURES_NUMERIC
from keelson.functions.stats import exact_quantiles
from keelson.operators import boosting
from keelson.plans.materialize import materialize

LABEL = "Is_Delayed"
TEST_FRACTION = 0.2
SEED = 42


def feature_stages(numeric=FEATURES_NUMERIC, categorical=FEATURES_CATEGORICAL, out: str = "features") -> list:
    """Categorical index with the unknown slot = number of classes, one-hot, assemble."""
    idx = StringIndexer(inputCols=list(categorical), outputCols=[f"{c}__idx" for c in categorical],
                        stringOrderType="alphabetAsc", handleInvalid="keep")   # one pass for all columns
    ohe = OneHotEncoder(inputCols=[f"{c}__idx" for c in categorical], outputCols=[f"{c}__ohe" for c in categorical],
                        dropLast=True)   # the unknown slot is the last one: an unseen category is all zeros
    asm = VectorAssembler(inputCols=list(numeric) + [f"{c}__ohe" for c in categorical], outputCol=out,
                          handleInvalid="keep")
    return [idx, ohe, asm]


def category_indices(df: DataFrame, categorical=FEATURES_CATEGORICAL) -> DataFrame:
    """G2 as a table: value -> alphabetical index; unknown slot = number of classes."""
    parts = []
    for c in categorical:
        d = df.select(F.lit(c).alias("feature_column"), F.col(c).alias("value")).where(F.col("value").isNotNull()).distinct()
        parts.append(d)
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    w = Window.partitionBy("feature_column").orderBy("value")
    return (u.withColumn("index", (F.dense_rank().over(w) - 1).cast("int"))
            .withColumn("unknown_slot", F.count(F.lit(1)).over(Window.partitionBy("feature_column")).cast("int")))


def standardize(df: DataFrame, cols, prefix: str = "z_") -> DataFrame:
    """(x - mean) / population std; zero variance -> scale 1 (1-row statistic, broadcast)."""
    st = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    d = df.crossJoin(F.broadcast(st))
    for c in cols:
        scale = F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(F.lit(1.0))
        d = d.withColumn(f"{prefix}{c}", (F.col(c) - F.col(f"_m_{c}")) / scale)
    return d.drop(*[f"_m_{c}" for c in cols], *[f"_s_{c}" for c in cols])


def scaler_stats(df: DataFrame, cols) -> DataFrame:
    """G3 as a table: feature, mean, population std, scale used."""
    st = df.agg(*[F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"))
                  .alias(f"s{i}") for i, c in enumerate(cols)])
    return (st.select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(cols))])).alias("s"))
            .select("s.feature", "s.mean", "s.std",
                    F.when(F.col("s.std") > 0, F.col("s.std")).otherwise(F.lit(1.0)).alias("scale")))


def split_uniform(key: Column, seed: int = SEED) -> Column:
    """52-bit uniform from md5('key|split|seed'): reproducible, partition- and retry-independent."""
    h = F.md5(F.concat_ws("|", key.cast("string"), F.lit("split"), F.lit(str(seed))))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def with_split(df: DataFrame, key: str = "Order_ID", seed: int = SEED, label: str = LABEL,
               test_fraction: float = TEST_FRACTION) -> DataFrame:
    """Exact stratified split: per label, the ceil(fraction * n) rows with the smallest hash
    uniform are the test set.  The per-label threshold is an exact order statistic from the
    bracketed quantile helper, so no task ever orders a whole class."""
    d = df.withColumn("_u", split_uniform(F.col(key), seed))
    thr = exact_quantiles(d, {"_thr": ("_u", test_fraction, "rank")}, by=[label])
    return (d.join(F.broadcast(thr), label, "left")   # one row per label value
            .withColumn("is_test", F.coalesce(F.col("_u") <= F.col("_thr"), F.lit(False)))
            .drop("_u", "_thr"))


def with_class_weight(train: DataFrame, label: str = LABEL) -> DataFrame:
    """Positives weighted negatives / max(positives, 1) (1-row statistic)."""
    w = train.agg(F.count_if(F.col(label) == 0).alias("_neg"), F.count_if(F.col(label) == 1).alias("_pos"))
    pw = (F.col("_neg").cast("double") / F.greatest(F.col("_pos"), F.lit(1))).alias("pos_weight")
    return (train.crossJoin(F.broadcast(w.select(pw)))
            .withColumn("w", F.when(F.col(label) == 1, F.col("pos_weight")).otherwise(F.lit(1.0))))


def fit_classifier(train: DataFrame, n_trees: int = 200, depth: int = 4, step: float = 0.05,
                   seed: int = SEED, numeric=FEATURES_NUMERIC) -> boosting.BoostedTrees:
    """Boosted trees with class weight."""
    return boosting.fit(train, feature_stages(numeric=numeric), numeric, FEATURES_CATEGORICAL, LABEL, True, n_trees, depth, step, seed)


def fit_regressor(train: DataFrame, n_trees: int = 200, depth: int = 4, step: float = 0.05,
                  seed: int = SEED) -> boosting.BoostedTrees:
    """Delay-days regressor (its prediction is clipped at 0 by ``predict_days``)."""
    known = train.where(F.col("Delay_Days").isNotNull())
    return boosting.fit(known, feature_stages(), FEATURES_NUMERIC, FEATURES_CATEGORICAL, "Delay_Days", False, n_trees, depth, step, seed)


def fit_second_model(train: DataFrame, seed: int = SEED) -> PipelineModel:
    """An independent weighted logistic model on standardised numerics (G3: population std) + one-hot categories."""
    st = {r.feature: r for r in scaler_stats(train, FEATURES_NUMERIC).collect()}   # one row per numeric feature
    scaled = ", ".join(f"(CAST({c} AS DOUBLE) - {st[c]['mean']!r}D) / {st[c]['scale']!r}D AS z_{c}" for c in FEATURES_NUMERIC)
    scale = SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__")
    lr = LogisticRegression(featuresCol="features", labelCol=LABEL, weightCol="w", maxIter=100, regParam=1e-3)
    stages = feature_stages(numeric=[f"z_{c}" for c in FEATURES_NUMERIC])
    return Pipeline(stages=[scale, *stages, lr]).fit(with_class_weight(train))


def positive_probability(model: PipelineModel | boosting.BoostedTrees, df: DataFrame, out: str) -> DataFrame:
    if isinstance(model, boosting.BoostedTrees):   # the trees' margin is half the log-odds
        return model.with_margin(df, out).withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * F.col(out))))
    scored = model.transform(df)
    keep = [c for c in df.columns]
    return scored.select(*keep, vector_to_array("probability")[1].alias(out))


def predict_days(model: boosting.BoostedTrees, df: DataFrame, out: str = "Predicted_Delay_Days") -> DataFrame:
    """G7 inference: clipped at 0."""
    return model.with_margin(df, out).withColumn(out, F.greatest(F.col(out), F.lit(0.0)))


def _score_counts(df: DataFrame, score: str, label: str, buckets: int | None = None) -> DataFrame:
    """Distinct scores with positive/negative counts and exclusive prefix sums (ascending score).

    Distinct scores are range-partitioned (sampled, balanced boundaries) and the partition
    id is the bucket, so every bucket holds a similar number of distinct scores whatever their
    distribution; prefix sums = per-bucket totals (tiny) + a window inside each bucket.  The
    bucketed counts are written once, so both uses see the same boundaries.
    """
    spark = df.sparkSession
    n = buckets or max(2, 2 * spark.sparkContext.defaultParallelism)
    g = (df.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
         .repartitionByRange(n, score).withColumn("bucket", F.spark_partition_id()))
    g = materialize(g, "score-counts")
    bt = g.groupBy("bucket").agg(F.sum("pos").alias("bpos"), F.sum("neg").alias("bneg"))
    wb = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bt = bt.select("bucket", F.coalesce(F.sum("bpos").over(wb), F.lit(0)).alias("pos_before_bucket"),
                   F.coalesce(F.sum("bneg").over(wb), F.lit(0)).alias("neg_before_bucket"))
    wi = Window.partitionBy("bucket").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    return (g.join(F.broadcast(bt), "bucket")
            .withColumn("neg_below", F.col("neg_before_bucket") + F.coalesce(F.sum("neg").over(wi), F.lit(0)))
            .withColumn("pos_below", F.col("pos_before_bucket") + F.coalesce(F.sum("pos").over(wi), F.lit(0))))


def roc_auc(df: DataFrame, score: str, label: str = LABEL, buckets: int | None = None) -> DataFrame:
    """ROC-AUC = P(score_pos > score_neg) + 0.5 P(tie) (equals the average-rank formula)."""
    return _roc_auc(_score_counts(df, score, label, buckets))


def _roc_auc(c: DataFrame) -> DataFrame:
    return c.agg(((F.sum(F.col("pos") * F.col("neg_below")) + F.lit(0.5) * F.sum(F.col("pos") * F.col("neg")))
                  / (F.sum("pos") * F.sum("neg"))).alias("roc_auc"))


def average_precision(df: DataFrame, score: str, label: str = LABEL, buckets: int | None = None) -> DataFrame:
    """Step-wise AP = sum over thresholds (descending) of (recall gain) x precision."""
    return _average_precision(_score_counts(df, score, label, buckets))


def _average_precision(c: DataFrame) -> DataFrame:
    tot = c.agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    c = c.crossJoin(F.broadcast(tot))
    tp = F.col("_P") - F.col("pos_below")
    fp = F.col("_N") - F.col("neg_below")
    return c.agg(F.sum(F.col("pos") / F.col("_P") * (tp / (tp + fp))).alias("average_precision"))


def evaluate(df: DataFrame, score: str, label: str = LABEL) -> DataFrame:
    c = _score_counts(df, score, label)   # one table of counts for both metrics
    return _roc_auc(c).crossJoin(_average_precision(c))
