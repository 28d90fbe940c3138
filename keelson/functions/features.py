"""Shipment feature derivation (B1-B11) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.stats import exact_percentiles
from keelson.plans.materialize import materialize

# Model feature lists (numeric, categorical) and the outcome columns
# that must never be used as features.
FEATURES_NUMERIC = [
    "Base_Lead_Time_Days", "Scheduled_Lead_Time_Days", "Schedule_Buffer_Days",
    "Schedule_Buffer_Ratio", "Geopolitical_Risk_Index", "Weather_Severity_Index",
    "Inflation_Rate_Pct", "Shipping_Cost_USD", "Order_Weight_Kg", "Cost_Per_Kg",
    "External_Risk_Pressure", "Order_Month", "Order_Quarter", "Order_DayOfWeek",
]
FEATURES_CATEGORICAL = [
    "Origin_City", "Destination_City", "Route_Type", "Transportation_Mode", "Product_Category",
]
LEAKAGE_COLUMNS = ["Delay_Days", "Delivery_Status", "Is_Delayed", "Disruption_Event",
                   "Actual_Lead_Time_Days", "Actual_Lead_Time"]


def clip_delay_days(c: Column) -> Column:
    """B1: negative delay -> 0, null stays null (``greatest`` would turn null into 0)."""
    return F.when(c < 0, F.lit(0)).otherwise(c)


def is_delayed(status: Column) -> Column:
    """B2: trimmed, case-insensitive 'late'; null status -> 0."""
    return F.coalesce(F.lower(F.trim(status)) == F.lit("late"), F.lit(False)).cast("int")


def buffer_ratio(buffer_days: Column, base: Column) -> Column:
    """Buffer / base, 0 when base is 0 or null."""
    return F.coalesce(F.try_divide(buffer_days.cast("double"), F.nullif(base, F.lit(0)).cast("double")),
                      F.lit(0.0))


def external_pressure(geo: Column, weather: Column) -> Column:
    """0.5 * geo + 0.5 * weather / 10."""
    return F.lit(0.5) * geo + F.lit(0.5) * (weather / F.lit(10.0))


def engineer_features(df: DataFrame) -> DataFrame:
    """B1-B7 over a shipments table.

    Cost per kg for zero/null weights is imputed with the exact median over the
    whole (unfiltered) table; the median is a one-row statistic cross-joined in.
    """
    d = df.withColumns({
        "Delay_Days": clip_delay_days(F.col("Delay_Days")),
        "Is_Delayed": is_delayed(F.col("Delivery_Status")),
        "Order_Month": F.month("Order_Date"),
        "Order_Quarter": F.quarter("Order_Date"),
        "Order_Year": F.year("Order_Date"),
        "Order_DayOfWeek": F.weekday("Order_Date"),
        "Order_YearMonth": F.date_format("Order_Date", "yyyy-MM"),
        "Schedule_Buffer_Days": F.col("Scheduled_Lead_Time_Days") - F.col("Base_Lead_Time_Days"),
    }).withColumns({
        "Schedule_Buffer_Ratio": buffer_ratio(F.col("Schedule_Buffer_Days"), F.col("Base_Lead_Time_Days")),
        "Route": F.concat(F.col("Origin_City"), F.lit(" -> "), F.col("Destination_City")),
        "_cpk": F.try_divide(F.col("Shipping_Cost_USD"),
                             F.nullif(F.col("Order_Weight_Kg"), F.lit(0)).cast("double")),
        "External_Risk_Pressure": external_pressure(F.col("Geopolitical_Risk_Index"),
                                                    F.col("Weather_Severity_Index")),
    })
    med = materialize(exact_percentiles(d, "_cpk", {"_cpk_median": 0.5}), "cost-median")
    return (d.crossJoin(F.broadcast(med))
            .withColumn("Cost_Per_Kg", F.coalesce(F.col("_cpk"), F.col("_cpk_median")))
            .drop("_cpk", "_cpk_median"))


def request_features(df: DataFrame) -> DataFrame:
    """Serving-path features for a table of hypothetical shipments.

    Input columns: base_lead_time, scheduled_lead_time, geo_risk, weather_risk,
    inflation, shipping_cost, order_weight, order_month, day_of_week, origin,
    destination, route_type, mode, category.
    """
    base = F.col("base_lead_time").cast("double")
    buf = F.col("scheduled_lead_time") - F.col("base_lead_time")
    weight = F.greatest(F.col("order_weight").cast("double"), F.lit(1.0))
    keep = [c for c in df.columns if c not in {
        "base_lead_time", "scheduled_lead_time", "geo_risk", "weather_risk", "inflation",
        "shipping_cost", "order_weight", "order_month", "day_of_week", "origin", "destination",
        "route_type", "mode", "category"}]
    return df.select(
        *keep,
        base.alias("Base_Lead_Time_Days"),
        F.col("scheduled_lead_time").cast("double").alias("Scheduled_Lead_Time_Days"),
        buf.cast("double").alias("Schedule_Buffer_Days"),
        F.when((base == 0) | base.isNull(), F.lit(0.0)).otherwise(F.try_divide(buf, base))
         .alias("Schedule_Buffer_Ratio"),
        F.col("geo_risk").cast("double").alias("Geopolitical_Risk_Index"),
        F.col("weather_risk").cast("double").alias("Weather_Severity_Index"),
        F.col("inflation").cast("double").alias("Inflation_Rate_Pct"),
        F.col("shipping_cost").cast("double").alias("Shipping_Cost_USD"),
        weight.alias("Order_Weight_Kg"),
        F.try_divide(F.col("shipping_cost").cast("double"), weight).alias("Cost_Per_Kg"),
        external_pressure(F.col("geo_risk"), F.col("weather_risk")).alias("External_Risk_Pressure"),
        F.col("order_month").cast("int").alias("Order_Month"),
        (F.floor((F.col("order_month") - 1) / 3) + 1).cast("int").alias("Order_Quarter"),
        F.col("day_of_week").cast("int").alias("Order_DayOfWeek"),
        F.col("origin").alias("Origin_City"),
        F.col("destination").alias("Destination_City"),
        F.col("route_type").alias("Route_Type"),
        F.col("mode").alias("Transportation_Mode"),
        F.col("category").alias("Product_Category"),
    )


def leading_indicators(df: DataFrame, keep: tuple[str, ...] = ("Order_ID",)) -> DataFrame:
    """Project the 19 model features (plus keys); refuses outcome columns."""
    cols = list(keep) + FEATURES_NUMERIC + FEATURES_CATEGORICAL
    bad = set(cols) & set(LEAKAGE_COLUMNS)
    if bad:
        raise ValueError(f"outcome-adjacent columns may not be features: {sorted(bad)}")
    return df.select(*cols)


def with_port_coordinates(df: DataFrame, ports: DataFrame) -> DataFrame:
    """origin/destination coordinates from the (broadcast) port dimension; unmatched -> null."""
    o = F.broadcast(ports.select(F.col("port").alias("_op"), F.col("lat").alias("Origin_Lat"),
                                 F.col("lon").alias("Origin_Lon")))
    d = F.broadcast(ports.select(F.col("port").alias("_dp"), F.col("lat").alias("Dest_Lat"),
                                 F.col("lon").alias("Dest_Lon")))
    return (df.join(o, F.col("Origin_City") == F.col("_op"), "left")
            .join(d, F.col("Destination_City") == F.col("_dp"), "left")
            .drop("_op", "_dp"))


def facet_values(df: DataFrame) -> DataFrame:
    """Sorted distinct modes, route types and categories (one row)."""
    return df.agg(
        F.array_join(F.array_sort(F.collect_set("Transportation_Mode")), "|").alias("modes"),
        F.array_join(F.array_sort(F.collect_set("Route_Type")), "|").alias("route_types"),
        F.array_join(F.array_sort(F.collect_set("Product_Category")), "|").alias("categories"),
    )
