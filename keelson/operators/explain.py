"""Explanations over per-row additive contributions.

Contributions are a long table (Order_ID, feature, value).  ``linear_contributions``
builds them as coefficient x standardised value with the coefficient = the
feature's correlation with the label (a data-derived linear stand-in that SQL can
restate); tree contributions can feed the same operators unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.operators.scoring import clean_feature_label, underwriting_memo

CONTRIB_DIGITS = 9


def linear_contributions(df: DataFrame, features: list[str], label: str = "Is_Delayed",
                         key: str = "Order_ID") -> DataFrame:
    """(key, feature 'num__X', value) with value = corr(X, label) * (X - mean) / std_pop."""
    return (linear_contribution_arrays(df, features, label, key)
            .select(key, F.explode("contribs").alias("t")).select(key, "t.feature", "t.value", "t.x"))


def linear_contribution_arrays(df: DataFrame, features: list[str], label: str = "Is_Delayed",
                               key: str = "Order_ID") -> DataFrame:
    """One row per input row: (key, contribs array<struct<feature, value, x>>)."""
    return with_contribution_array(df.select(key, label, *features), features, label).select(key, "contribs")


def with_contribution_array(df: DataFrame, features: list[str], label: str = "Is_Delayed") -> DataFrame:
    """``df`` plus a ``contribs`` array column (1-row statistics broadcast; no shuffle of the rows)."""
    y = F.col(label).cast("double")
    st = df.agg(*[F.corr(F.col(c).cast("double"), y).alias(f"_c{i}") for i, c in enumerate(features)],
                *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(features)],
                *[F.stddev_pop(c).alias(f"_s{i}") for i, c in enumerate(features)])
    d = df.crossJoin(F.broadcast(st))
    parts = []
    for i, c in enumerate(features):
        scale = F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}")).otherwise(F.lit(1.0))
        v = F.coalesce(F.col(f"_c{i}"), F.lit(0.0)) * ((F.col(c).cast("double") - F.col(f"_m{i}")) / scale)
        parts.append(F.struct(F.lit(f"num__{c}").alias("feature"), F.round(v, CONTRIB_DIGITS).alias("value"),
                              F.col(c).cast("double").alias("x")))
    return d.withColumn("contribs", F.array(*parts)).drop(*[c for c in st.columns])


def exploded(arrays: DataFrame, key: str = "Order_ID") -> DataFrame:
    """The long form (key, feature, value, x) of a table with a ``contribs`` array."""
    return arrays.select(key, F.explode("contribs").alias("c")).select(key, "c.feature", "c.value", "c.x")


def global_importance_of_arrays(arrays: DataFrame, top: int = 15) -> DataFrame:
    """G13 over contribution arrays: the long rows only live between the explode and the partial average."""
    return global_importance(exploded(arrays), top)


def global_importance(contrib: DataFrame, top: int = 15) -> DataFrame:
    """Mean |contribution| per feature over all rows (no sample needed on Spark), top k."""
    g = contrib.groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs"))
    return (g.orderBy(F.desc("mean_abs"), "feature").limit(top)
            .select(clean_feature_label(F.col("feature")).alias("label"), "feature", "mean_abs"))


def top_drivers_rowwise(arrays: DataFrame, k: int = 10, key: str = "Order_ID") -> DataFrame:
    """G14 without a shuffle: each row's contribution array is sorted in place (|value| desc,
    then feature), cut to k, re-sorted by signed value, and exploded."""
    # structs sort by their fields in order, so no comparator is called per pair
    by_size = F.sort_array(F.transform("contribs", lambda s: F.struct((-F.abs(s["value"])).alias("k"), s["feature"].alias("feature"),
                                                                      s["value"].alias("value"))))
    ranked = F.transform(F.slice(by_size, 1, k), lambda s, i: F.struct(s["value"].alias("value"), s["feature"].alias("feature"),
                                                                       (i + 1).cast("bigint").alias("abs_rank")))
    signed = F.sort_array(ranked)
    return (arrays.select(key, F.posexplode(signed).alias("pos", "t"))
            .select(key, F.col("t.abs_rank").alias("abs_rank"), (F.col("pos") + 1).cast("bigint").alias("signed_rank"),
                    clean_feature_label(F.col("t.feature")).alias("label"), F.col("t.value").alias("value")))


def top_drivers(contrib: DataFrame, k: int = 10, key: str = "Order_ID") -> DataFrame:
    """G14 over a long contribution table (e.g. tree contributions): per-row window."""
    w = Window.partitionBy(key).orderBy(F.desc(F.abs("value")), "feature")
    top = contrib.withColumn("abs_rank", F.row_number().over(w)).where(F.col("abs_rank") <= k)
    w2 = Window.partitionBy(key).orderBy("value", "feature")
    return top.withColumn("signed_rank", F.row_number().over(w2)).select(
        key, "abs_rank", "signed_rank", clean_feature_label(F.col("feature")).alias("label"), "value")


def beeswarm(contrib: DataFrame, top: int = 12, key: str = "Order_ID") -> DataFrame:
    """For the top features, each row's contribution and its min-max scaled feature value."""
    keep = global_importance(contrib, top).select("feature")
    c = contrib.join(F.broadcast(keep), "feature")
    mm = c.groupBy("feature").agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    return c.join(F.broadcast(mm), "feature").select(
        key, clean_feature_label(F.col("feature")).alias("label"), "value",
        F.round((F.col("x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + F.lit(1e-9)), 9).alias("color_value"))


def memos(with_contribs: DataFrame, tier_rates: DataFrame, key: str = "Order_ID") -> DataFrame:
    """D7 for every shipment: top-3 drivers, the tier's historical delay rate (E4), recommendation.

    ``with_contribs`` is the scored table with its ``contribs`` array column, so each memo is built
    row-locally; only the 4-row tier-rate table is joined (broadcast)."""
    rates = F.broadcast(tier_rates.select("Risk_Tier", (F.col("delay_rate") * F.lit(100.0)).alias("_rate_pct")))
    d = with_contribs.join(rates, "Risk_Tier", "left")
    desc = F.concat_ws(", ", F.col("Route"), F.col("Transportation_Mode"), F.col("Product_Category"))
    memo = underwriting_memo(desc, F.col("Risk_Tier"), F.col("Predicted_Delay_Probability"),
                             F.col("Predicted_Delay_Days"), F.col("_rate_pct"), F.col("contribs"))
    return d.where(F.col("Risk_Tier").isNotNull()).select(key, memo.alias("memo"))
