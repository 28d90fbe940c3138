"""DuckDB/ANSI SQL twins of the registered queries (the correctness oracle).

``SCORED_CTES`` restates, in plain SQL, the scored-shipments chain built by
``keelson.plans.scored``: the FIXTURES.md shipments statement, features,
fallback rates, score and tier.  Every portfolio oracle starts from it.
"""

from __future__ import annotations

from keelson.functions.tiers import tier_dim_sql
from keelson.sources.ports import ports_values_sql

SHIPMENTS_CTES = """
li AS (
  SELECT l_orderkey, CAST(SUM(l_quantity) AS BIGINT) AS qty, MIN(l_suppkey) AS sk, MIN(l_partkey) AS pk,
         SUM(CAST(ROUND(l_extendedprice * 1e2) AS BIGINT)) AS cents
  FROM lineitem GROUP BY l_orderkey),
b AS (
  SELECT o.o_orderkey AS id, CAST(o.o_orderdate AS DATE) AS dt, o.o_custkey AS ck, li.qty, li.cents,
         CAST(li.sk % 6 AS INT) AS lane, li.pk % 5 = 0 AS air, CAST((li.pk + li.sk) % 7 AS INT) AS cat
  FROM orders o JOIN li ON o.o_orderkey = li.l_orderkey),
c AS (
  SELECT b.*, CASE WHEN air THEN 2 + lane ELSE 12 + 3 * lane END AS base_lead,
         CASE WHEN cat IN (0, 3) THEN 45 WHEN cat IN (1, 5) THEN 20 ELSE 5 END
         + CASE WHEN lane IN (0, 4) THEN 25 ELSE 0 END + CASE WHEN air THEN -15 ELSE 0 END AS pct
  FROM b),
shipments AS (
SELECT id AS Order_ID, dt AS Order_Date,
  CASE lane WHEN 0 THEN 'Shenzhen, CN' WHEN 1 THEN 'Shanghai, CN' WHEN 2 THEN 'Hamburg, DE'
            WHEN 3 THEN 'Tokyo, JP' WHEN 4 THEN 'Mumbai, IN' ELSE 'Santos, BR' END AS Origin_City,
  CASE lane WHEN 0 THEN 'Rotterdam, NL' WHEN 1 THEN 'Los Angeles, US' WHEN 2 THEN 'New York, US'
            WHEN 3 THEN 'Singapore, SG' WHEN 4 THEN 'Felixstowe, UK' ELSE 'Shanghai, CN' END AS Destination_City,
  CASE lane WHEN 0 THEN 'Suez' WHEN 1 THEN 'Pacific' WHEN 2 THEN 'Atlantic'
            WHEN 3 THEN 'Intra-Asia' WHEN 4 THEN 'Suez' ELSE 'Commodity' END AS Route_Type,
  CASE WHEN air THEN 'Air' ELSE 'Sea' END AS Transportation_Mode,
  CASE cat WHEN 0 THEN 'Auto Parts' WHEN 1 THEN 'Consumer Electronics' WHEN 2 THEN 'Perishable Foods'
           WHEN 3 THEN 'Pharmaceuticals' WHEN 4 THEN 'Raw Materials' WHEN 5 THEN 'Semiconductors'
           ELSE 'Textiles' END AS Product_Category,
  CAST(base_lead AS INT) AS Base_Lead_Time_Days,
  CAST(base_lead + 1 + id % 3 AS INT) AS Scheduled_Lead_Time_Days,
  CAST(CASE WHEN (id * 37) % 100 < pct THEN 1 + id % 9 ELSE id % 3 - 2 END AS INT) AS Delay_Days,
  CASE WHEN (id * 37) % 100 < pct THEN CASE WHEN id % 2 = 0 THEN 'Late' ELSE ' late ' END
       WHEN id % 50 = 7 THEN NULL ELSE 'On Time' END AS Delivery_Status,
  CAST(ck % 101 AS DOUBLE) / 1e2 AS Geopolitical_Risk_Index,
  CAST((id * 7) % 101 AS DOUBLE) / 1e1 AS Weather_Severity_Index,
  CAST(qty % 91 - 10 AS DOUBLE) / 1e1 AS Inflation_Rate_Pct,
  CAST(cents AS DOUBLE) / CASE WHEN air THEN 1e3 ELSE 5e3 END AS Shipping_Cost_USD,
  CASE WHEN id % 97 = 0 THEN CAST(0 AS BIGINT) ELSE qty * 25 END AS Order_Weight_Kg
FROM c)"""

FEATURE_CTES = """
f0 AS (
  SELECT Order_ID, Order_Date, Origin_City, Destination_City, Route_Type, Transportation_Mode, Product_Category,
    Base_Lead_Time_Days, Scheduled_Lead_Time_Days,
    CASE WHEN Delay_Days < 0 THEN 0 ELSE Delay_Days END AS Delay_Days,
    Delivery_Status, Geopolitical_Risk_Index, Weather_Severity_Index, Inflation_Rate_Pct, Shipping_Cost_USD,
    Order_Weight_Kg,
    CAST(COALESCE(lower(trim(Delivery_Status)) = 'late', false) AS INTEGER) AS Is_Delayed,
    CAST(month(Order_Date) AS INTEGER) AS Order_Month,
    CAST(quarter(Order_Date) AS INTEGER) AS Order_Quarter,
    CAST(year(Order_Date) AS INTEGER) AS Order_Year,
    CAST(isodow(Order_Date) - 1 AS INTEGER) AS Order_DayOfWeek,
    strftime(Order_Date, '%Y-%m') AS Order_YearMonth,
    Scheduled_Lead_Time_Days - Base_Lead_Time_Days AS Schedule_Buffer_Days,
    COALESCE(CAST(Scheduled_Lead_Time_Days - Base_Lead_Time_Days AS DOUBLE)
             / CAST(NULLIF(Base_Lead_Time_Days, 0) AS DOUBLE), 0e0) AS Schedule_Buffer_Ratio,
    Origin_City || ' -> ' || Destination_City AS Route,
    Shipping_Cost_USD / CAST(NULLIF(Order_Weight_Kg, 0) AS DOUBLE) AS cpk0,
    0.5e0 * Geopolitical_Risk_Index + 0.5e0 * (Weather_Severity_Index / 1e1) AS External_Risk_Pressure
  FROM shipments),
features AS (
  SELECT f0.* EXCLUDE (cpk0), COALESCE(cpk0, m.med) AS Cost_Per_Kg
  FROM f0 CROSS JOIN (SELECT quantile_cont(cpk0, 0.5) AS med FROM f0) m)"""

RATE_CTES = """
combo_r AS (
  SELECT Route_Type, Transportation_Mode, Product_Category, CAST(SUM(Is_Delayed) AS DOUBLE) / COUNT(*) AS rate,
         COUNT(*) AS n
  FROM features GROUP BY Route_Type, Transportation_Mode, Product_Category),
route_r AS (SELECT Route_Type, CAST(SUM(Is_Delayed) AS DOUBLE) / COUNT(*) AS rate FROM features GROUP BY Route_Type),
global_r AS (SELECT CAST(SUM(Is_Delayed) AS DOUBLE) / COUNT(*) AS rate FROM features)"""

SCORED_CTES = """
probs AS (
  SELECT f.*, COALESCE(CASE WHEN cr.n >= 100 THEN cr.rate END, rr.rate, g.rate) AS Predicted_Delay_Probability,
         CAST(f.Delay_Days AS DOUBLE) AS Predicted_Delay_Days
  FROM features f
  LEFT JOIN combo_r cr ON f.Route_Type = cr.Route_Type AND f.Transportation_Mode = cr.Transportation_Mode
       AND f.Product_Category = cr.Product_Category
  LEFT JOIN route_r rr ON f.Route_Type = rr.Route_Type
  CROSS JOIN global_r g),
p99 AS (SELECT quantile_cont(Predicted_Delay_Days, 0.99) AS p99d, quantile_cont(External_Risk_Pressure, 0.99) AS p99e
        FROM probs),
raw AS (
  SELECT probs.*,
    (0.5e0 * Predicted_Delay_Probability
     + 0.3e0 * (CASE WHEN Predicted_Delay_Days / NULLIF(p99d, 0) < 0 THEN 0e0
                     WHEN Predicted_Delay_Days / NULLIF(p99d, 0) > 1 THEN 1e0
                     ELSE Predicted_Delay_Days / NULLIF(p99d, 0) END)
     + 0.2e0 * (CASE WHEN External_Risk_Pressure / NULLIF(p99e, 0) < 0 THEN 0e0
                     WHEN External_Risk_Pressure / NULLIF(p99e, 0) > 1 THEN 1e0
                     ELSE External_Risk_Pressure / NULLIF(p99e, 0) END)) * 1e2 AS raw_score
  FROM probs CROSS JOIN p99),
ports_dim AS (""" + ports_values_sql() + """),
tier_dim AS (""" + tier_dim_sql() + """),
scored AS (
  SELECT raw.* EXCLUDE (raw_score),
    CAST(round_even(raw_score * 1e1, 0) AS BIGINT) AS Risk_Score_Tenths,
    round_even(raw_score * 1e1, 0) / 1e1 AS Shipment_Risk_Score,
    CASE WHEN round_even(raw_score * 1e1, 0) / 1e1 > -0.01e0 AND round_even(raw_score * 1e1, 0) / 1e1 <= 20 THEN 'Low'
         WHEN round_even(raw_score * 1e1, 0) / 1e1 > 20 AND round_even(raw_score * 1e1, 0) / 1e1 <= 40 THEN 'Medium'
         WHEN round_even(raw_score * 1e1, 0) / 1e1 > 40 AND round_even(raw_score * 1e1, 0) / 1e1 <= 65 THEN 'High'
         WHEN round_even(raw_score * 1e1, 0) / 1e1 > 65 AND round_even(raw_score * 1e1, 0) / 1e1 <= 100 THEN 'Severe'
    END AS Risk_Tier,
    po.lat AS Origin_Lat, po.lon AS Origin_Lon, pd.lat AS Dest_Lat, pd.lon AS Dest_Lon
  FROM raw LEFT JOIN ports_dim po ON raw.Origin_City = po.port
           LEFT JOIN ports_dim pd ON raw.Destination_City = pd.port)"""


def with_ctes(body: str, level: str = "scored") -> str:
    """Prefix ``body`` (a SELECT, optionally starting with more CTEs after a comma) with the chain."""
    chain = {"shipments": [SHIPMENTS_CTES],
             "features": [SHIPMENTS_CTES, FEATURE_CTES],
             "rates": [SHIPMENTS_CTES, FEATURE_CTES, RATE_CTES],
             "scored": [SHIPMENTS_CTES, FEATURE_CTES, RATE_CTES, SCORED_CTES]}[level]
    return "WITH " + ",".join(chain) + body


def pct1(expr: str) -> str:
    """SQL twin of ``pct_1dp``."""
    return f"round_even(({expr}) * 1e2 * 1e1, 0) / 1e1"


def rhe1(expr: str) -> str:
    return f"round_even(({expr}) * 1e1, 0) / 1e1"
