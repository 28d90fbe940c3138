"""Historical-weather validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Feature labels of the correlation table and the signal threshold.
SYNTHETIC_LABEL = "Weather_Severity_Index (synthetic)"
REAL_LABELS = {
    "real_wind_speed_max_kmh": "Real Wind Speed Max (Open-Meteo, historical)",
    "real_wind_gusts_max_kmh": "Real Wind Gusts Max (Open-Meteo, historical)",
    "real_precipitation_sum_mm": "Real Precipitation Sum (Open-Meteo, historical)",
}
NO_SIGNAL_THRESHOLD = 0.03


def order_date_ranges(df: DataFrame) -> DataFrame:
    """min/max order date overall ('ALL') and per origin."""
    per = df.groupBy(F.col("Origin_City").alias("scope")).agg(F.min("Order_Date").alias("min_date"),
                                                              F.max("Order_Date").alias("max_date"))
    overall = df.agg(F.lit("ALL").alias("scope"), F.min("Order_Date").alias("min_date"),
                     F.max("Order_Date").alias("max_date"))
    return overall.unionByName(per)


def merge_weather(shipments: DataFrame, weather_rows: DataFrame, requested_cities: DataFrame) -> DataFrame:
    """Keep origins that were requested (semi join), then left join weather on (origin, date).

    A requested port that failed has no rows, so its shipments get nulls.  Repeated rows of one
    (city, date) are made one first (the least), so the join never duplicates shipments.
    With no requested city at all the input is returned unchanged (reference behaviour).
    """
    req = requested_cities.select(F.col("city").alias("Origin_City")).distinct()
    kept = shipments.join(F.broadcast(req), "Origin_City", "left_semi")
    w = weather_rows.select(F.col("city").alias("Origin_City"), F.col("wx_date").alias("Order_Date"),
                            F.struct(*REAL_LABELS.keys()).alias("_wx"))
    w = w.groupBy("Origin_City", "Order_Date").agg(F.min("_wx").alias("_wx")).select("Origin_City", "Order_Date", "_wx.*")
    merged = kept.join(w, ["Origin_City", "Order_Date"], "left")
    # the requested list is small (ports); when it is empty the reference returns the input unchanged
    nothing_requested = requested_cities.limit(1).count() == 0
    if nothing_requested:
        return shipments
    return merged


def origin_coverage(shipments: DataFrame, requested_cities: DataFrame) -> DataFrame:
    """How many shipments and origins the requested ports keep, and how many they leave out."""
    req = requested_cities.select(F.col("city").alias("Origin_City"), F.lit(True).alias("_asked")).distinct()
    d = shipments.groupBy("Origin_City").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(req), "Origin_City", "left")
    asked = F.coalesce(F.col("_asked"), F.lit(False))
    return d.agg(F.coalesce(F.sum(F.when(asked, F.col("n"))), F.lit(0)).alias("kept_shipments"),
                 F.coalesce(F.sum(F.when(~asked, F.col("n"))), F.lit(0)).alias("dropped_shipments"),
                 F.count_if(~asked).alias("dropped_origins"))


def weather_correlation(merged: DataFrame) -> DataFrame:
    """R of each feature with Is_Delayed (pairwise complete) and its non-null count; absent columns omitted."""
    feats = [("Weather_Severity_Index", SYNTHETIC_LABEL, 0)] + [
        (c, lab, i + 1) for i, (c, lab) in enumerate(REAL_LABELS.items()) if c in merged.columns]
    y = F.col("Is_Delayed").cast("double")
    aggs = []
    for c, _, i in feats:
        x = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        aggs += [F.corr(x, y).alias(f"r{i}"), F.count(x).alias(f"n{i}")]
    one = merged.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(lab).alias("feature"), F.col(f"r{i}").alias("r"),
                              F.col(f"n{i}").alias("n")) for c, lab, i in feats])
    return one.select(F.explode(rows).alias("t")).select(
        "t.ord", "t.feature", F.round("t.r", 8).alias("correlation_with_delay"), F.col("t.n").alias("n_shipments"))


def weather_verdict(corr: DataFrame) -> DataFrame:
    """Max |r| over the real features; below 0.03 -> no signal."""
    m = corr.where(F.col("feature") != SYNTHETIC_LABEL).agg(F.max(F.abs("correlation_with_delay")).alias("max_real_abs_r"))
    return m.select("max_real_abs_r",
                    F.when(F.col("max_real_abs_r") < NO_SIGNAL_THRESHOLD, "no signal")
                    .when(F.col("max_real_abs_r").isNotNull(), "stronger signal").alias("verdict"))
