"""Oracle SQL for the route queries: edges, priority weights, min-plus doubling CTEs."""

from __future__ import annotations

from keelson.operators.routes import ROUTE_TYPE_CIRCUITY
from keelson.plans.oracle import with_ctes


def _rad(x: str) -> str:
    return f"radians({x})"


_HAV = ("12742e0 * asin(sqrt(sin(radians(b_lat - a_lat) / 2) * sin(radians(b_lat - a_lat) / 2)"
        " + cos(radians(a_lat)) * cos(radians(b_lat)) * (sin(radians(b_lon - a_lon) / 2) * sin(radians(b_lon - a_lon) / 2))))")

_ASIA = "('east_asia', 'sea_asia', 'south_asia')"
_EUR = "('n_europe', 'med_europe')"
_RT = (f"CASE WHEN a_region IS NULL OR b_region IS NULL THEN 'Commodity'"
       f" WHEN a_region = b_region AND a_region IN {_ASIA} THEN 'Intra-Asia'"
       f" WHEN (a_region IN {_ASIA} AND b_region IN {_EUR}) OR (b_region IN {_ASIA} AND a_region IN {_EUR}) THEN 'Suez'"
       f" WHEN (a_region IN {_ASIA} AND b_region = 'us_west') OR (b_region IN {_ASIA} AND a_region = 'us_west') THEN 'Pacific'"
       f" WHEN (a_region IN {_EUR} AND b_region = 'us_east') OR (b_region IN {_EUR} AND a_region = 'us_east') THEN 'Atlantic'"
       f" WHEN (a_region = 'middle_east' OR b_region = 'middle_east') AND (a_region IN {_EUR} OR b_region IN {_EUR}"
       f" OR a_region IN {_ASIA} OR b_region IN {_ASIA}) THEN 'Suez' ELSE 'Commodity' END")
_CIRC = ("CASE WHEN mode = 'Air' THEN 1e0 ELSE CASE route_type "
         + " ".join(f"WHEN '{k}' THEN {v!r}e0" for k, v in ROUTE_TYPE_CIRCUITY.items()) + " ELSE 1.3e0 END END")

EDGE_CTES = f""",
graphs AS (SELECT m.mode, c.category FROM (SELECT DISTINCT Transportation_Mode AS mode FROM features) m
           CROSS JOIN (SELECT DISTINCT Product_Category AS category FROM features) c),
pairs AS (SELECT a.port_idx AS a_port_idx, a.port AS a_port, a.lat AS a_lat, a.lon AS a_lon, a.region AS a_region,
                 b.port_idx AS b_port_idx, b.port AS b_port, b.lat AS b_lat, b.lon AS b_lon, b.region AS b_region
          FROM ports_dim a JOIN ports_dim b ON a.port_idx < b.port_idx),
e0 AS (SELECT pairs.*, graphs.mode, graphs.category, {_HAV} AS great_circle_km, {_RT} AS route_type
       FROM pairs CROSS JOIN graphs),
e1 AS (SELECT e0.*, great_circle_km * {_CIRC} AS distance_km FROM e0),
e2 AS (SELECT e1.*, GREATEST(distance_km / CASE WHEN mode = 'Sea' THEN 650e0 ELSE 7000e0 END, 1e0) AS transit_days,
              CASE WHEN mode = 'Sea' THEN 0.85e0 ELSE 8.5e0 END * 5000e0 AS cost_usd FROM e1),
edges AS MATERIALIZED (
  SELECT e2.*, LEAST(GREATEST(COALESCE(CASE WHEN cr.n >= 100 THEN cr.rate END, rr.rate, g.rate)
                 + (5e0 - 5e0) / 5e0 * 0.15e0, 0.01e0), 0.99e0) AS delay_probability
  FROM e2 LEFT JOIN combo_r cr ON e2.route_type = cr.Route_Type AND e2.mode = cr.Transportation_Mode
       AND e2.category = cr.Product_Category
  LEFT JOIN route_r rr ON e2.route_type = rr.Route_Type CROSS JOIN global_r g),
mm AS (SELECT mode, category, MIN(distance_km) AS dlo, MAX(distance_km) AS dhi, MIN(cost_usd) AS clo,
              MAX(cost_usd) AS chi, MIN(delay_probability) AS plo, MAX(delay_probability) AS phi
       FROM edges GROUP BY 1, 2),
pw AS (
  SELECT e.mode, e.category, e.a_port_idx, e.b_port_idx, p.priority,
    CASE p.priority WHEN 'Fastest' THEN transit_days WHEN 'Cheapest' THEN cost_usd
         WHEN 'Safest' THEN delay_probability
         ELSE 0.4e0 * (CASE WHEN dhi > dlo THEN (distance_km - dlo) / (dhi - dlo) ELSE 0e0 END)
            + 0.3e0 * (CASE WHEN chi > clo THEN (cost_usd - clo) / (chi - clo) ELSE 0e0 END)
            + 0.3e0 * (CASE WHEN phi > plo THEN (delay_probability - plo) / (phi - plo) ELSE 0e0 END) END AS weight
  FROM edges e JOIN mm ON e.mode = mm.mode AND e.category = mm.category
  CROSS JOIN (VALUES ('Fastest'), ('Cheapest'), ('Safest'), ('Balanced')) AS p(priority)),
pwi AS MATERIALIZED (SELECT pw.*, CAST(ROUND(weight * 1e9) AS BIGINT) AS w FROM pw)"""


def _double(src: str, dst: str) -> str:
    """One doubling: the least (cost, hops, path) of a pair is the least of their fixed-width texts."""
    return f""",
{dst} AS MATERIALIZED (
  SELECT mode, category, priority, src, dst, CAST(substr(k, 1, 20) AS BIGINT) AS cost,
         CAST(substr(k, 21, 3) AS INTEGER) AS hops, substr(k, 24) AS path
  FROM (SELECT mode, category, priority, src, dst, MIN(printf('%020d', cost) || printf('%03d', hops) || path) AS k
        FROM (SELECT * FROM {src}
              UNION ALL
              SELECT x.mode, x.category, x.priority, x.src, y.dst, x.cost + y.cost, x.hops + y.hops,
                     x.path || substr(y.path, 3)
              FROM {src} x JOIN {src} y ON x.mode = y.mode AND x.category = y.category AND x.priority = y.priority
                   AND x.dst = y.src AND x.src <> y.dst)
        GROUP BY mode, category, priority, src, dst))"""


BEST_CTES = EDGE_CTES + """,
w1 AS MATERIALIZED (
  SELECT mode, category, priority, a_port_idx AS src, b_port_idx AS dst, w AS cost, 1 AS hops,
         printf('%02d%02d', a_port_idx, b_port_idx) AS path FROM pwi
  UNION ALL
  SELECT mode, category, priority, b_port_idx, a_port_idx, w, 1, printf('%02d%02d', b_port_idx, a_port_idx) FROM pwi)""" + \
    _double("w1", "w2") + _double("w2", "w4") + _double("w4", "w8") + _double("w8", "w16") + """,
names AS (SELECT list(port ORDER BY port_idx) AS nm FROM ports_dim),
legs AS (
  SELECT mode, category, priority, src, dst, i, CAST(substr(path, 2 * i - 1, 2) AS INTEGER) AS f,
         CAST(substr(path, 2 * i + 1, 2) AS INTEGER) AS t
  FROM (SELECT *, unnest(range(1, hops + 1)) AS i FROM w16)),
tot AS (
  SELECT l.mode, l.category, l.priority, l.src, l.dst, SUM(e.distance_km) AS total_distance_km,
    SUM(e.cost_usd) AS total_cost_usd, SUM(e.transit_days) AS total_transit_days,
    1e0 - product(1e0 - e.delay_probability) AS overall_delay_probability
  FROM legs l JOIN edges e ON l.mode = e.mode AND l.category = e.category
       AND LEAST(l.f, l.t) = e.a_port_idx AND GREATEST(l.f, l.t) = e.b_port_idx
  GROUP BY 1, 2, 3, 4, 5),
totals AS (
  SELECT b.mode, b.category, b.priority, b.src, b.dst, names.nm[b.src + 1] AS origin, names.nm[b.dst + 1] AS destination,
    array_to_string(list_transform(range(0, b.hops + 1), lambda i: names.nm[CAST(substr(b.path, 2 * i + 1, 2) AS INTEGER) + 1]), ' → ') AS route, b.hops,
    t.total_distance_km, t.total_cost_usd, t.total_transit_days, t.overall_delay_probability
  FROM w16 b JOIN tot t ON b.mode = t.mode AND b.category = t.category AND b.priority = t.priority
       AND b.src = t.src AND b.dst = t.dst CROSS JOIN names)"""


def edges_sql() -> str:
    return with_ctes(EDGE_CTES + """
 SELECT mode, category, a_port, b_port, route_type, ROUND(great_circle_km, 6) AS great_circle_km,
   ROUND(distance_km, 6) AS distance_km, ROUND(transit_days, 6) AS transit_days, cost_usd,
   delay_probability, delay_probability * 8e0 AS expected_delay_days,
   round_even(delay_probability * 1e2 * 1e1, 0) / 1e1 AS risk_score,
   CASE WHEN round_even(delay_probability * 1e2 * 1e1, 0) / 1e1 < 20 THEN 'Low'
        WHEN round_even(delay_probability * 1e2 * 1e1, 0) / 1e1 < 40 THEN 'Medium'
        WHEN round_even(delay_probability * 1e2 * 1e1, 0) / 1e1 < 65 THEN 'High' ELSE 'Severe' END AS risk_tier
 FROM edges""")


_TIER = ("CASE WHEN round_even(delay_probability * 1e2 * 1e1, 0) / 1e1 < 20 THEN 'Low'"
         " WHEN round_even(delay_probability * 1e2 * 1e1, 0) / 1e1 < 40 THEN 'Medium'"
         " WHEN round_even(delay_probability * 1e2 * 1e1, 0) / 1e1 < 65 THEN 'High' ELSE 'Severe' END")


def legs_sql() -> str:
    return with_ctes(BEST_CTES + f"""
 SELECT l.mode, l.category, l.priority, l.src, l.dst, CAST(l.i - 1 AS INTEGER) AS leg_no, l.f AS from_idx, l.t AS to_idx,
   e.route_type, ROUND(e.distance_km, 6) AS distance_km, ROUND(e.transit_days, 6) AS transit_days, e.cost_usd,
   ROUND(e.delay_probability, 9) AS delay_probability, {_TIER} AS risk_tier
 FROM legs l JOIN edges e ON l.mode = e.mode AND l.category = e.category
      AND LEAST(l.f, l.t) = e.a_port_idx AND GREATEST(l.f, l.t) = e.b_port_idx""")


def live_weather_sql(before: str, conditions: str) -> str:
    """Best routes over edges whose risk follows the live readings (CTE ``wedges`` of ``conditions``)."""
    head, tail = EDGE_CTES.split(",\nmm AS", 1)
    tail = (",\nmm AS" + tail + BEST_CTES[len(EDGE_CTES):]).replace("FROM edges", "FROM wedges").replace("JOIN edges", "JOIN wedges")
    return with_ctes(before + head + conditions + tail + """
 SELECT mode, category, priority, origin, destination, route, hops,
   ROUND(overall_delay_probability, 9) AS overall_delay_probability
 FROM totals""")


def weights_sql() -> str:
    return with_ctes(EDGE_CTES + " SELECT mode, category, priority, a_port_idx, b_port_idx, w FROM pwi")


def best_routes_sql() -> str:
    return with_ctes(BEST_CTES + """
 SELECT mode, category, priority, origin, destination, route, hops,
   ROUND(total_distance_km, 6) AS total_distance_km, ROUND(total_cost_usd, 6) AS total_cost_usd,
   ROUND(total_transit_days, 6) AS total_transit_days,
   ROUND(overall_delay_probability, 9) AS overall_delay_probability
 FROM totals""")


def compare_sql(origin: str, destination: str) -> str:
    return with_ctes(BEST_CTES + f"""
 SELECT mode, category, priority, route, hops,
   round_even(total_distance_km, 0) AS distance_km, round_even(total_transit_days * 1e1, 0) / 1e1 AS transit_days,
   round_even(total_cost_usd, 0) AS cost_usd,
   round_even(overall_delay_probability * 1e4, 0) / 1e4 AS delay_probability
 FROM totals WHERE origin = '{origin}' AND destination = '{destination}'""")
