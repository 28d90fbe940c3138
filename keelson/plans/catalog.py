"""Registered queries: name -> (spark builder, oracle SQL or None).

Each builder takes (spark, sf_dir) and returns a DataFrame over the given
tables.  Stages that several queries share are written to the checkpoint folder
on first use, and single-row statistics are read by the driver; data rows are
never collected.  Oracle SQL runs in DuckDB over the same tables as views.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions import features as feat
from keelson.operators import portfolio as pf
from keelson.operators import rates, scoring
from keelson.plans import scored as sc
from keelson.plans.oracle import pct1, rhe1, with_ctes
from keelson.plans.registry import register
from keelson.session import ensure_checkpoint_dir
from keelson.sources import shipments as ship


# Example facet selection used by the filtered-view queries.
FACETS = dict(modes=["Sea"], route_types=["Suez", "Pacific", "Atlantic", "Commodity"],
              categories=["Auto Parts", "Consumer Electronics", "Perishable Foods", "Pharmaceuticals",
                          "Raw Materials", "Semiconductors"],
              tiers=["Medium", "High", "Severe"])


def _sql_in(vals) -> str:
    return "(" + ", ".join(f"'{v}'" for v in vals) + ")"


FACET_SQL = (f"Transportation_Mode IN {_sql_in(FACETS['modes'])} AND Route_Type IN {_sql_in(FACETS['route_types'])}"
             f" AND Product_Category IN {_sql_in(FACETS['categories'])} AND Risk_Tier IN {_sql_in(FACETS['tiers'])}")

SHIPMENT_COLS = ("Order_ID, Order_Date, Origin_City, Destination_City, Route_Type, Transportation_Mode, "
                 "Product_Category, Base_Lead_Time_Days, Scheduled_Lead_Time_Days, Delay_Days, Delivery_Status, "
                 "Geopolitical_Risk_Index, Weather_Severity_Index, Inflation_Rate_Pct, Shipping_Cost_USD, "
                 "Order_Weight_Kg")


# ---------------------------------------------------------------- A, B: scan + features
# Date columns of registered outputs are rendered as ISO 'yyyy-MM-dd' text on both sides so
# result comparison does not depend on how a client library maps DATE values.
@register("shipments_scan", with_ctes(
    " SELECT " + SHIPMENT_COLS.replace("Order_Date,", "strftime(Order_Date, '%Y-%m-%d') AS Order_Date,")
    + " FROM shipments", "shipments"))
def q_shipments(spark, sf):
    return sc.base_shipments(spark, sf).withColumn("Order_Date", F.date_format("Order_Date", "yyyy-MM-dd"))


_SCAN_SQL = with_ctes(
    " SELECT " + SHIPMENT_COLS.replace("Order_Date,", "strftime(Order_Date, '%Y-%m-%d') AS Order_Date,")
    + " FROM shipments", "shipments")


@register("shipments_csv_scan", _SCAN_SQL)
def q_csv_scan(spark, sf):
    """A1 + A6: the shipments exported as CSV and scanned again with the declared schema."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/keelson-csv-{uuid.uuid4().hex}"
    ship.export_scored(sc.base_shipments(spark, sf), path, fmt="csv")
    return ship.read_shipments(spark, path).withColumn("Order_Date", F.date_format("Order_Date", "yyyy-MM-dd"))


FEATURE_OUT = ("Order_ID, Delay_Days, Is_Delayed, Order_Month, Order_Quarter, Order_Year, Order_DayOfWeek, "
               "Order_YearMonth, Schedule_Buffer_Days, Schedule_Buffer_Ratio, Route, Cost_Per_Kg, "
               "External_Risk_Pressure")


@register("shipment_features", with_ctes(f" SELECT {FEATURE_OUT} FROM features", "features"))
def q_features(spark, sf):
    return sc.featured(spark, sf).select(*[c.strip() for c in FEATURE_OUT.split(",")])


def shipment_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Hypothetical-shipment requests derived from the shipments table (one per order)."""
    return sc.base_shipments(spark, sf).select(
        "Order_ID",
        F.col("Base_Lead_Time_Days").cast("double").alias("base_lead_time"),
        F.col("Scheduled_Lead_Time_Days").cast("double").alias("scheduled_lead_time"),
        F.col("Geopolitical_Risk_Index").alias("geo_risk"), F.col("Weather_Severity_Index").alias("weather_risk"),
        F.col("Inflation_Rate_Pct").alias("inflation"), F.col("Shipping_Cost_USD").alias("shipping_cost"),
        F.col("Order_Weight_Kg").cast("double").alias("order_weight"),
        F.month("Order_Date").alias("order_month"), F.weekday("Order_Date").alias("day_of_week"),
        F.col("Origin_City").alias("origin"), F.col("Destination_City").alias("destination"),
        F.col("Route_Type").alias("route_type"), F.col("Transportation_Mode").alias("mode"),
        F.col("Product_Category").alias("category"))


REQUESTS_SQL = """,
requests AS (
  SELECT Order_ID, CAST(Base_Lead_Time_Days AS DOUBLE) AS base_lead_time,
    CAST(Scheduled_Lead_Time_Days AS DOUBLE) AS scheduled_lead_time, Geopolitical_Risk_Index AS geo_risk,
    Weather_Severity_Index AS weather_risk, Inflation_Rate_Pct AS inflation, Shipping_Cost_USD AS shipping_cost,
    CAST(Order_Weight_Kg AS DOUBLE) AS order_weight, CAST(month(Order_Date) AS INTEGER) AS order_month,
    CAST(isodow(Order_Date) - 1 AS INTEGER) AS day_of_week, Origin_City AS origin, Destination_City AS destination,
    Route_Type AS route_type, Transportation_Mode AS mode, Product_Category AS category
  FROM shipments),
req_features AS (
  SELECT Order_ID, base_lead_time AS Base_Lead_Time_Days, scheduled_lead_time AS Scheduled_Lead_Time_Days,
    scheduled_lead_time - base_lead_time AS Schedule_Buffer_Days,
    CASE WHEN base_lead_time = 0 OR base_lead_time IS NULL THEN 0e0
         ELSE (scheduled_lead_time - base_lead_time) / base_lead_time END AS Schedule_Buffer_Ratio,
    geo_risk AS Geopolitical_Risk_Index, weather_risk AS Weather_Severity_Index, inflation AS Inflation_Rate_Pct,
    shipping_cost AS Shipping_Cost_USD, GREATEST(order_weight, 1e0) AS Order_Weight_Kg,
    shipping_cost / GREATEST(order_weight, 1e0) AS Cost_Per_Kg,
    0.5e0 * geo_risk + 0.5e0 * (weather_risk / 1e1) AS External_Risk_Pressure,
    order_month AS Order_Month, CAST(floor((order_month - 1) / 3) + 1 AS INTEGER) AS Order_Quarter,
    day_of_week AS Order_DayOfWeek, origin AS Origin_City, destination AS Destination_City,
    route_type AS Route_Type, mode AS Transportation_Mode, category AS Product_Category
  FROM requests)"""


@register("request_features", with_ctes(REQUESTS_SQL + " SELECT * FROM req_features", "shipments"))
def q_request_features(spark, sf):
    return feat.request_features(shipment_requests(spark, sf))


@register("leading_indicators", with_ctes(
    " SELECT Order_ID, " + ", ".join(feat.FEATURES_NUMERIC + feat.FEATURES_CATEGORICAL) + " FROM features",
    "features"))
def q_leading(spark, sf):
    return feat.leading_indicators(sc.featured(spark, sf))


@register("shipment_coordinates", with_ctes(
    " SELECT Order_ID, Origin_Lat, Origin_Lon, Dest_Lat, Dest_Lon FROM scored"))
def q_coords(spark, sf):
    return sc.scored(spark, sf).select("Order_ID", "Origin_Lat", "Origin_Lon", "Dest_Lat", "Dest_Lon")


@register("facet_values", with_ctes(
    " SELECT array_to_string(list_sort(list(DISTINCT Transportation_Mode)), '|') AS modes,"
    " array_to_string(list_sort(list(DISTINCT Route_Type)), '|') AS route_types,"
    " array_to_string(list_sort(list(DISTINCT Product_Category)), '|') AS categories FROM shipments", "shipments"))
def q_facets(spark, sf):
    return feat.facet_values(sc.base_shipments(spark, sf))


# ---------------------------------------------------------------- C: filters, top-k
@register("facet_counts", with_ctes(
    f" SELECT COUNT(*) FILTER (WHERE {FACET_SQL}) AS shown, COUNT(*) AS total FROM scored"))
def q_facet_counts(spark, sf):
    return pf.facet_counts(sc.scored(spark, sf), **FACETS)


@register("top_risk_shipments", with_ctes(
    " SELECT Order_ID, Origin_City || ' -> ' || Destination_City AS Route, Transportation_Mode, Product_Category,"
    f" {rhe1('Predicted_Delay_Probability * 1e2')} AS p_delay_pct, Predicted_Delay_Days AS expected_delay_days,"
    " Shipment_Risk_Score, Risk_Tier, Is_Delayed FROM scored"
    " ORDER BY Shipment_Risk_Score DESC NULLS LAST, Order_ID LIMIT 200"))
def q_top_risk(spark, sf):
    return pf.top_risk(sc.scored(spark, sf), 200)


# ---------------------------------------------------------------- D: scores and rules
@register("risk_scores", with_ctes(
    " SELECT Order_ID, Predicted_Delay_Probability, Predicted_Delay_Days, External_Risk_Pressure,"
    " Shipment_Risk_Score, Risk_Tier FROM scored"))
def q_risk_scores(spark, sf):
    return sc.scored(spark, sf).select("Order_ID", "Predicted_Delay_Probability", "Predicted_Delay_Days",
                                       "External_Risk_Pressure", "Shipment_Risk_Score", "Risk_Tier")


@register("underwriting_notes", with_ctes(
    " SELECT Order_ID, Risk_Tier, CASE WHEN Risk_Tier IN ('High', 'Severe') THEN '" + scoring.NOTE_HAIRCUT +
    "' ELSE '" + scoring.NOTE_STANDARD + "' END AS note FROM scored"))
def q_notes(spark, sf):
    s = sc.scored(spark, sf)
    return s.select("Order_ID", "Risk_Tier", scoring.underwriting_note(F.col("Risk_Tier")).alias("note"))


# ---------------------------------------------------------------- E: aggregations
_LOW = "CAST(SUM(CASE WHEN Risk_Tier = 'Low' THEN Is_Delayed END) AS DOUBLE) / COUNT(*) FILTER (WHERE Risk_Tier = 'Low')"
_SEV = ("CAST(SUM(CASE WHEN Risk_Tier = 'Severe' THEN Is_Delayed END) AS DOUBLE)"
        " / COUNT(*) FILTER (WHERE Risk_Tier = 'Severe')")
_HS = "CAST(COUNT(*) FILTER (WHERE Risk_Tier IN ('High', 'Severe')) AS DOUBLE) / COUNT(*)"


@register("board_numbers", with_ctes(
    " SELECT ROUND(SUM(Shipping_Cost_USD), 2) AS total_value_usd,"
    f" {pct1(_LOW)} AS low_tier_late_pct,"
    f" {pct1(_SEV)} AS severe_tier_late_pct,"
    " ROUND(SUM(Predicted_Delay_Probability), 4) AS expected_delayed,"
    " ROUND(SUM(Predicted_Delay_Probability * Shipping_Cost_USD), 2) AS expected_exposure_usd FROM scored"))
def q_board(spark, sf):
    return pf.board_numbers(sc.scored(spark, sf))


@register("kpi_strip", with_ctes(
    f" SELECT COUNT(*) AS shipments, {pct1('CAST(SUM(Is_Delayed) AS DOUBLE) / COUNT(*)')} AS delay_pct,"
    f" {rhe1('CAST(SUM(Risk_Score_Tenths) AS DOUBLE) / COUNT(Risk_Score_Tenths) / 1e1')} AS avg_risk_score,"
    f" {pct1(_HS)} AS high_severe_pct"
    f" FROM scored WHERE {FACET_SQL}"))
def q_kpi(spark, sf):
    return pf.kpi_strip(pf.faceted_filter(sc.scored(spark, sf), **FACETS))


@register("tier_split", with_ctes(
    " SELECT t.Risk_Tier, t.tier_rank, COALESCE(c.n, 0) AS shipments FROM tier_dim t"
    " LEFT JOIN (SELECT Risk_Tier, COUNT(*) AS n FROM scored GROUP BY Risk_Tier) c ON t.Risk_Tier = c.Risk_Tier"))
def q_tier_split(spark, sf):
    return pf.tier_split(sc.scored(spark, sf))


CALIB_SQL = (" SELECT t.Risk_Tier, t.tier_rank, c.delay_rate FROM tier_dim t LEFT JOIN"
             " (SELECT Risk_Tier, CAST(SUM(Is_Delayed) AS DOUBLE) / COUNT(*) AS delay_rate FROM scored"
             " GROUP BY Risk_Tier) c ON t.Risk_Tier = c.Risk_Tier")


@register("tier_calibration", with_ctes(CALIB_SQL))
def q_calibration(spark, sf):
    return pf.tier_calibration(sc.scored(spark, sf))


@register("calibration_monotone", with_ctes(
    ", cal AS (" + CALIB_SQL + "), lagged AS (SELECT *, LAG(delay_rate) OVER (ORDER BY tier_rank) AS prev FROM cal)"
    " SELECT bool_and(CASE WHEN prev IS NULL THEN delay_rate IS NOT NULL"
    " ELSE COALESCE(delay_rate >= prev, false) END) AS is_monotone, COUNT(delay_rate) AS tiers_with_rows FROM lagged"))
def q_monotone(spark, sf):
    return pf.calibration_monotone(sc.scored(spark, sf))


@register("flow_mode_route", with_ctes(
    " SELECT Transportation_Mode, Route_Type, COUNT(*) AS shipments FROM scored GROUP BY 1, 2"))
def q_flow1(spark, sf):
    return pf.flow_mode_route(sc.scored(spark, sf))


@register("flow_mode_route_tier", with_ctes(
    " SELECT Transportation_Mode, Route_Type, Risk_Tier, COUNT(*) AS shipments FROM scored GROUP BY 1, 2, 3"))
def q_flow2(spark, sf):
    return pf.flow_mode_route_tier(sc.scored(spark, sf))


@register("category_risk", with_ctes(
    " SELECT Product_Category, COUNT(*) AS volume, CAST(SUM(Is_Delayed) AS DOUBLE) / COUNT(*) AS delay_rate"
    " FROM scored GROUP BY 1"))
def q_category(spark, sf):
    return pf.category_risk(sc.scored(spark, sf))


@register("delay_rate_by_mode", with_ctes(
    " SELECT Transportation_Mode, CAST(SUM(Is_Delayed) AS DOUBLE) / COUNT(*) AS delay_rate FROM scored"
    " GROUP BY 1 ORDER BY delay_rate DESC"))
def q_by_mode(spark, sf):
    return pf.delay_rate_by_mode(sc.scored(spark, sf))


@register("monthly_trend", with_ctes(
    " SELECT Order_YearMonth, CAST(SUM(Is_Delayed) AS DOUBLE) / COUNT(*) AS delay_rate, COUNT(*) AS volume"
    " FROM scored GROUP BY 1 ORDER BY 1"))
def q_monthly(spark, sf):
    return pf.monthly_trend(sc.scored(spark, sf))


@register("lane_summary", with_ctes(
    " SELECT Origin_City || ' → ' || Destination_City AS Route,"
    f" {rhe1('CAST(SUM(Risk_Score_Tenths) AS DOUBLE) / COUNT(Risk_Score_Tenths) / 1e1')} AS avg_risk_score,"
    f" {pct1('CAST(SUM(Is_Delayed) AS DOUBLE) / COUNT(*)')} AS delay_rate_pct, COUNT(*) AS volume"
    " FROM scored GROUP BY Origin_City, Destination_City ORDER BY avg_risk_score DESC, Route"))
def q_lanes(spark, sf):
    return pf.lane_summary(sc.scored(spark, sf))


def _bin_sql(x: str, lo: str, hi: str, n: int) -> str:
    return (f"CASE WHEN {hi} - {lo} > 0 THEN LEAST(CAST({n - 1} AS BIGINT), CAST(floor(({x} - {lo}) / ({hi} - {lo})"
            f" * {float(n)}e0) AS BIGINT)) ELSE CAST(0 AS BIGINT) END")


@register("geo_score_density", with_ctes(
    ", d AS (SELECT * FROM scored WHERE Geopolitical_Risk_Index IS NOT NULL AND Shipment_Risk_Score IS NOT NULL),"
    " mm AS (SELECT MIN(Geopolitical_Risk_Index) AS xlo, MAX(Geopolitical_Risk_Index) AS xhi,"
    " MIN(Shipment_Risk_Score) AS ylo, MAX(Shipment_Risk_Score) AS yhi FROM d)"
    f" SELECT {_bin_sql('Geopolitical_Risk_Index', 'xlo', 'xhi', 25)} AS x_bin,"
    f" {_bin_sql('Shipment_Risk_Score', 'ylo', 'yhi', 25)} AS y_bin, COUNT(*) AS shipments"
    " FROM d CROSS JOIN mm GROUP BY 1, 2"))
def q_density(spark, sf):
    return pf.density_2d(sc.scored(spark, sf), "Geopolitical_Risk_Index", "Shipment_Risk_Score", 25)


@register("tier_score_distribution", with_ctes(
    " SELECT Risk_Tier, COUNT(*) AS n, MIN(Shipment_Risk_Score) AS min_score,"
    " ROUND(quantile_cont(Shipment_Risk_Score, 0.25), 6) AS q1, ROUND(quantile_cont(Shipment_Risk_Score, 0.5), 6) AS median,"
    " ROUND(quantile_cont(Shipment_Risk_Score, 0.75), 6) AS q3, MAX(Shipment_Risk_Score) AS max_score,"
    " ROUND(CAST(SUM(Risk_Score_Tenths) AS DOUBLE) / COUNT(Risk_Score_Tenths) / 1e1, 6) AS mean_score"
    " FROM scored WHERE Risk_Tier IS NOT NULL GROUP BY Risk_Tier"))
def q_tier_dist(spark, sf):
    return pf.tier_score_distribution(sc.scored(spark, sf))


@register("tier_score_density", with_ctes(
    ", d AS (SELECT * FROM scored WHERE Risk_Tier IS NOT NULL AND Shipment_Risk_Score IS NOT NULL),"
    " mm AS (SELECT Risk_Tier, MIN(Shipment_Risk_Score) AS lo, MAX(Shipment_Risk_Score) AS hi FROM d GROUP BY 1)"
    f" SELECT d.Risk_Tier, {_bin_sql('Shipment_Risk_Score', 'lo', 'hi', 50)} AS bin, COUNT(*) AS n"
    " FROM d JOIN mm ON d.Risk_Tier = mm.Risk_Tier GROUP BY 1, 2"))
def q_tier_density(spark, sf):
    return pf.tier_score_density(sc.scored(spark, sf))


def _role_sql(role: str, col: str) -> str:
    return (f"(SELECT {col} AS port, COUNT(*) AS n, SUM(Is_Delayed) AS nd, SUM(Risk_Score_Tenths) AS st,"
            f" COUNT(Risk_Score_Tenths) AS ns FROM scored GROUP BY 1) {role}")


@register("port_statistics", with_ctes(
    " SELECT p.port_idx, p.port, p.lat, p.lon, p.region_label,"
    " COALESCE(o.n, 0) AS origin_shipments,"
    f" {pct1('CAST(o.nd AS DOUBLE) / o.n')} AS origin_delay_pct,"
    f" {rhe1('CAST(o.st AS DOUBLE) / o.ns / 1e1')} AS origin_avg_score,"
    " COALESCE(d.n, 0) AS destination_shipments,"
    f" {pct1('CAST(d.nd AS DOUBLE) / d.n')} AS destination_delay_pct,"
    f" {rhe1('CAST(d.st AS DOUBLE) / d.ns / 1e1')} AS destination_avg_score,"
    " COALESCE(o.n, 0) + COALESCE(d.n, 0) > 0 AS in_dataset"
    f" FROM ports_dim p LEFT JOIN {_role_sql('o', 'Origin_City')} ON p.port = o.port"
    f" LEFT JOIN {_role_sql('d', 'Destination_City')} ON p.port = d.port"))
def q_port_stats(spark, sf):
    return pf.port_statistics(sc.scored(spark, sf))


@register("dataset_ports", with_ctes(
    " SELECT port FROM (SELECT Origin_City AS port FROM shipments UNION SELECT Destination_City FROM shipments)"
    " WHERE port IS NOT NULL", "shipments"))
def q_dataset_ports(spark, sf):
    return pf.dataset_ports(sc.base_shipments(spark, sf))


@register("lane_arcs", with_ctes(
    ", g AS (SELECT Origin_City, Destination_City, COUNT(*) AS n, SUM(Is_Delayed) AS nd,"
    " CAST(SUM(Risk_Score_Tenths) AS DOUBLE) / COUNT(Risk_Score_Tenths) / 1e1 AS score FROM scored GROUP BY 1, 2)"
    " SELECT g.Origin_City, g.Destination_City, po.lat AS start_lat, po.lon AS start_lng, pd.lat AS end_lat,"
    f" pd.lon AS end_lng, {rhe1('score')} AS avg_score, n AS volume,"
    f" {pct1('CAST(nd AS DOUBLE) / n')} AS delay_rate_pct,"
    " CASE WHEN score < 20 THEN '#2dd4bf' WHEN score < 40 THEN '#f5b942' WHEN score < 65 THEN '#ff8c42'"
    " ELSE '#ef4444' END AS color,"
    " g.Origin_City || ' &rarr; ' || g.Destination_City || ': ' ||"
    f" printf('%.1f', {pct1('CAST(nd AS DOUBLE) / n')}) || '% delayed, ' || format('{{:,}}', n) || ' shipments' AS label"
    " FROM g JOIN ports_dim po ON g.Origin_City = po.port JOIN ports_dim pd ON g.Destination_City = pd.port"))
def q_arcs(spark, sf):
    return pf.lane_arcs(sc.scored(spark, sf))


@register("port_points", with_ctes(
    ", ds AS (SELECT Origin_City AS port FROM shipments UNION SELECT Destination_City FROM shipments)"
    " SELECT p.port_idx, p.port, p.lat, p.lon, ds.port IS NOT NULL AS in_dataset,"
    " CASE WHEN ds.port IS NOT NULL THEN '#2dd4bf' ELSE '#5b8def' END AS color,"
    " CASE WHEN ds.port IS NOT NULL THEN 0.45e0 ELSE 0.3e0 END AS size"
    " FROM ports_dim p LEFT JOIN ds ON p.port = ds.port"))
def q_points(spark, sf):
    return pf.port_points(sc.base_shipments(spark, sf))


# ---------------------------------------------------------------- F: rate tables
@register("combo_rates", with_ctes(
    " SELECT Route_Type, Transportation_Mode, Product_Category, rate AS delay_rate, n AS count FROM combo_r",
    "rates"))
def q_combo(spark, sf):
    return rates.combo_rates(sc.featured(spark, sf))


@register("route_rates", with_ctes(
    " SELECT r.Route_Type, r.rate AS delay_rate, g.rate AS global_rate FROM route_r r CROSS JOIN global_r g",
    "rates"))
def q_route_rates(spark, sf):
    f = sc.featured(spark, sf)
    return rates.route_rates(f).select("Route_Type", "delay_rate").crossJoin(rates.global_rate(f))


@register("fallback_rates", with_ctes(
    ", combos AS (SELECT DISTINCT Route_Type, Transportation_Mode, Product_Category FROM features)"
    " SELECT k.Route_Type, k.Transportation_Mode, k.Product_Category,"
    " COALESCE(CASE WHEN cr.n >= 100 THEN cr.rate END, rr.rate, g.rate) AS base_rate,"
    " CASE WHEN cr.n >= 100 THEN 'combo' WHEN rr.rate IS NOT NULL THEN 'route_type' ELSE 'global' END AS source"
    " FROM combos k LEFT JOIN combo_r cr ON k.Route_Type = cr.Route_Type"
    " AND k.Transportation_Mode = cr.Transportation_Mode AND k.Product_Category = cr.Product_Category"
    " LEFT JOIN route_r rr ON k.Route_Type = rr.Route_Type CROSS JOIN global_r g", "rates"))
def q_fallback(spark, sf):
    f = sc.featured(spark, sf)
    combos = f.select("Route_Type", "Transportation_Mode", "Product_Category").distinct()
    out = rates.with_fallback_rate(combos, f)
    counts = rates.combo_rates(f).select("Route_Type", "Transportation_Mode", "Product_Category",
                                         F.col("count").alias("_n"))
    j = out.join(counts, ["Route_Type", "Transportation_Mode", "Product_Category"], "left")
    route_known = rates.route_rates(f).select("Route_Type", F.lit(True).alias("_rk"))
    j = j.join(route_known, "Route_Type", "left")
    src = F.when(F.col("_n") >= rates.MIN_SAMPLES, "combo").when(F.col("_rk"), "route_type").otherwise("global")
    return j.select("Route_Type", "Transportation_Mode", "Product_Category", "base_rate", src.alias("source"))



# ---------------------------------------------------------------- K: route choice
from keelson.operators import routes as rt  # noqa: E402
from keelson.plans import oracle_routes as orr  # noqa: E402
from keelson.sources.ports import ports as port_dim  # noqa: E402


def _graphs(spark, sf):
    f = sc.featured(spark, sf)
    return (f.select(F.col("Transportation_Mode").alias("mode")).distinct()
            .crossJoin(f.select(F.col("Product_Category").alias("category")).distinct()))


def _edges(spark, sf):
    return sc._memo(spark, sf, "route_edges",
                    lambda: rt.route_edges(port_dim(spark), _graphs(spark, sf), sc.featured(spark, sf)))


def _best(spark, sf):
    return sc._memo(spark, sf, "best_routes", lambda: rt.all_pairs_best(rt.priority_weights(_edges(spark, sf))))


def _legs(spark, sf):
    return sc._memo(spark, sf, "route_legs", lambda: rt.route_legs(_best(spark, sf), _edges(spark, sf)))


def _totals(spark, sf):
    return sc._memo(spark, sf, "route_totals", lambda: rt.route_totals(_best(spark, sf), _legs(spark, sf), port_dim(spark)))


@register("route_legs", orr.legs_sql())
def q_route_legs(spark, sf):
    """The legs of every best route with their edge's figures."""
    return _legs(spark, sf).select("mode", "category", "priority", "src", "dst", F.col("leg_no").cast("int").alias("leg_no"), "from_idx", "to_idx",
                                   "route_type", F.round("distance_km", 6).alias("distance_km"), F.round("transit_days", 6).alias("transit_days"),
                                   "cost_usd", F.round("delay_probability", 9).alias("delay_probability"), "risk_tier")


@register("route_edges", orr.edges_sql())
def q_route_edges(spark, sf):
    e = _edges(spark, sf)
    return e.select("mode", "category", "a_port", "b_port", "route_type",
                    F.round("great_circle_km", 6).alias("great_circle_km"), F.round("distance_km", 6).alias("distance_km"),
                    F.round("transit_days", 6).alias("transit_days"), "cost_usd", "delay_probability",
                    "expected_delay_days", "risk_score", "risk_tier")


@register("priority_weights", orr.weights_sql())
def q_priority_weights(spark, sf):
    return rt.priority_weights(_edges(spark, sf)).select("mode", "category", "priority", "a_port_idx",
                                                         "b_port_idx", "w")


@register("best_routes", orr.best_routes_sql())
def q_best_routes(spark, sf):
    t = _totals(spark, sf)
    return t.select("mode", "category", "priority", "origin", "destination", "route", "hops",
                    F.round("total_distance_km", 6).alias("total_distance_km"),
                    F.round("total_cost_usd", 6).alias("total_cost_usd"),
                    F.round("total_transit_days", 6).alias("total_transit_days"),
                    F.round("overall_delay_probability", 9).alias("overall_delay_probability"))


@register("priority_comparison", orr.compare_sql("Shanghai, CN", "Rotterdam, NL"))
def q_compare(spark, sf):
    return rt.compare_priorities(_totals(spark, sf), "Shanghai, CN", "Rotterdam, NL")



# ---------------------------------------------------------------- K12: door-to-door
DOOR_ORIGIN, DOOR_MODE, DOOR_CATEGORY, DOOR_PRIORITY = "Shanghai, CN", "Sea", "Consumer Electronics", "Balanced"


def door_to_door(totals: DataFrame, legs: DataFrame) -> DataFrame:
    """Trunk km (best route from the fixed origin to the arrival port) + road km per delivery.

    Deliveries whose arrival port is the origin itself have no trunk leg (0 km)."""
    t = totals.where((F.col("origin") == DOOR_ORIGIN) & (F.col("mode") == DOOR_MODE)
                     & (F.col("category") == DOOR_CATEGORY) & (F.col("priority") == DOOR_PRIORITY)) \
        .select(F.col("destination").alias("arrival_port"), "total_distance_km")
    j = legs.where("ok").join(F.broadcast(t), "arrival_port", "left")  # at most 31 trunk rows
    trunk = F.when(F.col("arrival_port") == DOOR_ORIGIN, F.lit(0.0)).otherwise(F.col("total_distance_km"))
    return j.select("delivery_id", "arrival_port", F.round(trunk, 6).alias("trunk_km"),
                    F.round(F.col("distance_km"), 6).alias("road_km"),
                    F.round(trunk + F.col("distance_km"), 6).alias("door_to_door_km"))


@register("door_to_door", orr.with_ctes(orr.BEST_CTES + f"""
 , trunk AS (SELECT destination AS arrival_port, total_distance_km FROM totals WHERE origin = '{DOOR_ORIGIN}'
   AND mode = '{DOOR_MODE}' AND category = '{DOOR_CATEGORY}' AND priority = '{DOOR_PRIORITY}'),
 road AS (SELECT c_custkey AS delivery_id, p.port AS arrival_port, CAST((c_custkey * 37) % 250000 AS DOUBLE) / 1e3 AS road_km
   FROM customer JOIN ports_dim p ON CAST(c_custkey % 31 AS INTEGER) = p.port_idx WHERE c_custkey % 13 <> 0)
 SELECT r.delivery_id, r.arrival_port,
   ROUND(CASE WHEN r.arrival_port = '{DOOR_ORIGIN}' THEN 0e0 ELSE t.total_distance_km END, 6) AS trunk_km,
   ROUND(r.road_km, 6) AS road_km,
   ROUND(CASE WHEN r.arrival_port = '{DOOR_ORIGIN}' THEN 0e0 ELSE t.total_distance_km END + r.road_km, 6) AS door_to_door_km
 FROM road r LEFT JOIN trunk t ON r.arrival_port = t.arrival_port"""))
def q_door(spark, sf):
    from keelson.sources import landing, payloads
    return door_to_door(_totals(spark, sf), payloads.decode_road_legs(landing.road_leg_payloads(spark, sf)))


# ---------------------------------------------------------------- D3, D4: request-path scoring
@register("request_scores", with_ctes(REQUESTS_SQL.replace("FROM shipments)", "FROM shipments)", 1) + """,
rates_req AS (SELECT r.Order_ID, r.External_Risk_Pressure,
    COALESCE(CASE WHEN cr.n >= 100 THEN cr.rate END, rr.rate, g.rate) AS probability
  FROM req_features r
  LEFT JOIN combo_r cr ON r.Route_Type = cr.Route_Type AND r.Transportation_Mode = cr.Transportation_Mode
       AND r.Product_Category = cr.Product_Category
  LEFT JOIN route_r rr ON r.Route_Type = rr.Route_Type CROSS JOIN global_r g),
sc_req AS (SELECT Order_ID, probability, probability * 8e0 AS expected_delay_days,
    round_even((0.5e0 * probability + 0.3e0 * LEAST(GREATEST(probability * 8e0, 0e0) / 12e0, 1e0)
      + 0.2e0 * LEAST(External_Risk_Pressure / 0.95e0, 1e0)) * 1e2 * 1e1, 0) / 1e1 AS risk_score FROM rates_req)
 SELECT Order_ID, probability, expected_delay_days, risk_score,
   CASE WHEN risk_score < 20 THEN 'Low' WHEN risk_score < 40 THEN 'Medium' WHEN risk_score < 65 THEN 'High'
        ELSE 'Severe' END AS risk_tier FROM sc_req""", "rates"))
def q_request_scores(spark, sf):
    """D3 + D4: hypothetical shipments scored with fixed normalisers and the left-closed tier; the
    probability is the request combo's fallback historical rate and expected days = 8 x probability."""
    req = feat.request_features(shipment_requests(spark, sf))
    p = rates.with_fallback_rate(req, sc.featured(spark, sf), out_col="probability")
    p = p.withColumn("expected_delay_days", F.col("probability") * F.lit(8.0))
    return scoring.score_requests(p).select("Order_ID", "probability", "expected_delay_days", "risk_score",
                                            "risk_tier")
