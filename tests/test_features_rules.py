"""Hand-made edge frames for features, tiers, conditions and rates (FIXTURES.md §3)."""

import math

from pyspark.sql import functions as F

from keelson.functions.features import buffer_ratio, clip_delay_days, engineer_features, is_delayed
from keelson.functions.geo import infer_route_type
from keelson.functions.tiers import portfolio_tier, request_tier
from keelson.operators.conditions import condition_level, implied_severity
from keelson.operators.rates import with_fallback_rate


def test_status_and_delay(spark):
    df = spark.createDataFrame([(None, -2), (" LATE ", None), ("On Time", 5)], "s string, d int")
    got = df.select(is_delayed(F.col("s")).alias("y"), clip_delay_days(F.col("d")).alias("d")).collect()
    assert [(r.y, r.d) for r in got] == [(0, 0), (1, None), (0, 5)]


def test_buffer_ratio_zero_and_null_base(spark):
    df = spark.createDataFrame([(3, 0), (3, None), (3, 6)], "b int, base int")
    got = [r.r for r in df.select(buffer_ratio(F.col("b"), F.col("base")).alias("r")).collect()]
    assert got == [0.0, 0.0, 0.5]


def test_zero_weight_gets_table_median(spark):
    rows = [(i, 10.0 * (i + 1), (0 if i == 0 else i)) for i in range(5)]
    df = spark.createDataFrame(
        [(i, None, "A", "B", "Suez", "Sea", "Textiles", 10, 12, 1, "On Time", 0.5, 5.0, 1.0, c, w)
         for i, c, w in rows],
        "Order_ID long, Order_Date date, Origin_City string, Destination_City string, Route_Type string, "
        "Transportation_Mode string, Product_Category string, Base_Lead_Time_Days int, "
        "Scheduled_Lead_Time_Days int, Delay_Days int, Delivery_Status string, Geopolitical_Risk_Index double, "
        "Weather_Severity_Index double, Inflation_Rate_Pct double, Shipping_Cost_USD double, Order_Weight_Kg long")
    out = {r.Order_ID: r.Cost_Per_Kg for r in engineer_features(df).collect()}
    others = sorted(10.0 * (i + 1) / i for i in range(1, 5))
    med = (others[1] + others[2]) / 2
    assert math.isclose(out[0], med)


def test_tier_conventions(spark):
    df = spark.createDataFrame([(20.0,), (40.0,), (65.0,), (-5.0,)], "s double")
    got = df.select(portfolio_tier(F.col("s")).alias("p"), request_tier(F.col("s")).alias("r")).collect()
    assert [(r.p, r.r) for r in got] == [("Low", "Medium"), ("Medium", "High"), ("High", "Severe"), (None, "Low")]


def test_condition_levels_and_severity(spark):
    df = spark.createDataFrame([(None, None), (1.0, None), (4.0, 10.0), (0.0, 39.0)], "w double, v double")
    got = df.select(condition_level(F.col("w"), F.col("v")).alias("l"),
                    implied_severity(F.col("w"), F.col("v")).alias("s")).collect()
    assert [r.l for r in got] == ["Unknown", "Calm", "Rough — Elevated Risk", "Moderate"]
    assert got[0].s == 0.0


def test_route_type_pairs(spark):
    df = spark.createDataFrame([("east_asia", "sea_asia"), ("east_asia", "east_asia"), ("n_europe", "us_east"),
                                ("middle_east", "n_europe"), (None, "n_europe"), ("sea_asia", "us_west")],
                               "a string, b string")
    got = [r.t for r in df.select(infer_route_type(F.col("a"), F.col("b")).alias("t")).collect()]
    assert got == ["Commodity", "Intra-Asia", "Atlantic", "Suez", "Commodity", "Pacific"]


def test_fallback_rate_thresholds(spark):
    hist = spark.createDataFrame([("Suez", "Sea", "A", i % 2) for i in range(99)]
                                 + [("Suez", "Sea", "B", 1) for _ in range(100)]
                                 + [("Pacific", "Air", "A", 0) for _ in range(10)],
                                 "Route_Type string, Transportation_Mode string, Product_Category string, Is_Delayed int")
    req = spark.createDataFrame([("Suez", "Sea", "A"), ("Suez", "Sea", "B"), ("Atlantic", "Sea", "A")],
                                "Route_Type string, Transportation_Mode string, Product_Category string")
    got = {(r.Route_Type, r.Product_Category): r.base_rate for r in with_fallback_rate(req, hist).collect()}
    suez_rate = (49 + 100) / 199
    assert math.isclose(got[("Suez", "A")], suez_rate)  # 99 rows < 100 -> route-type rate
    assert got[("Suez", "B")] == 1.0
    assert math.isclose(got[("Atlantic", "A")], 149 / 209)  # unknown route type -> global
