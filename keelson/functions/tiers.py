"""Risk tiers: two conventions on purpose (D2 right-closed, D4 left-closed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tier names in rank order.
TIERS = ["Low", "Medium", "High", "Severe"]


def portfolio_tier(score: Column) -> Column:
    """(-0.01,20] Low, (20,40] Medium, (40,65] High, (65,100] Severe; else null."""
    return (F.when((score > -0.01) & (score <= 20), "Low")
            .when((score > 20) & (score <= 40), "Medium")
            .when((score > 40) & (score <= 65), "High")
            .when((score > 65) & (score <= 100), "Severe"))


def request_tier(score: Column) -> Column:
    """<20 Low, <40 Medium, <65 High, else Severe."""
    return (F.when(score < 20, "Low").when(score < 40, "Medium")
            .when(score < 65, "High").otherwise("Severe"))


def tier_dim(spark: SparkSession) -> DataFrame:
    """4-row dimension (tier, tier_rank) for fixed ordering and zero-fill."""
    return spark.createDataFrame([(t, i) for i, t in enumerate(TIERS)], "Risk_Tier string, tier_rank int")


def tier_dim_sql() -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{t}', {i})" for i, t in enumerate(TIERS)) + \
        ") AS t(Risk_Tier, tier_rank)"
