"""Route choice over the port network (K3-K12), all pairs and priorities at once.

The reference builds one graph per (mode, category) and runs one Dijkstra per
question.  Here every (mode, category) graph is an edge table, and the best
path for every (graph, priority, src, dst) comes from min-plus *doubling*
joins: round r combines best paths of <= 2^(r-1) hops, so 31 ports converge in
<= 5 rounds.  Weights are put on an integer grid (1e-9) so sums are exact and
ties are broken deterministically by hop count, then by the port-index path.
Each round's table is written to the shared checkpoint folder (lineage cut).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.geo import haversine_km, infer_route_type
from keelson.functions.tiers import request_tier
from keelson.operators.rates import with_fallback_rate
from keelson.operators.scoring import round_half_even
from keelson.plans.materialize import materialize

# Transit speed (km/day) and cost per kg by mode, default order
# weight, neutral geo/weather/inflation, circuity by route type, delay-day scale.
MODE_SPEED_KM_PER_DAY = {"Sea": 650.0, "Air": 7000.0}
MODE_BASE_COST_PER_KG = {"Sea": 0.85, "Air": 8.5}
DEFAULT_ORDER_WEIGHT_KG = 5000.0
DEFAULT_GEO_RISK = 0.497
DEFAULT_WEATHER_RISK = 5.0
DEFAULT_INFLATION = 3.5
ROUTE_TYPE_CIRCUITY = {"Intra-Asia": 1.3, "Pacific": 1.2, "Atlantic": 1.15, "Suez": 2.2, "Commodity": 1.4}
WEATHER_NUDGE = 0.15
EXPECTED_DELAY_SCALE = 8.0
PRIORITIES = ["Fastest", "Cheapest", "Safest", "Balanced"]
WEIGHT_GRID = 1e9


def _lookup(mapping: dict, key: Column, default: float | None = None) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def port_pairs(ports: DataFrame) -> DataFrame:
    """K5: each undirected pair once (a.port_idx < b.port_idx): 31 ports -> 465 rows."""
    a = ports.select(*[F.col(c).alias(f"a_{c}") for c in ("port_idx", "port", "lat", "lon", "region")])
    b = ports.select(*[F.col(c).alias(f"b_{c}") for c in ("port_idx", "port", "lat", "lon", "region")])
    return a.join(F.broadcast(b), F.col("a_port_idx") < F.col("b_port_idx"))


def edge_features(pairs: DataFrame, graphs: DataFrame) -> DataFrame:
    """K1-K3 for every pair x (mode, category) graph in ``graphs``."""
    e = pairs.crossJoin(F.broadcast(graphs))
    gc = haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    rt = infer_route_type(F.col("a_region"), F.col("b_region"))
    e = e.withColumns({"great_circle_km": gc, "route_type": rt})
    circuity = F.when(F.col("mode") == "Air", F.lit(1.0)).otherwise(
        _lookup(ROUTE_TYPE_CIRCUITY, F.col("route_type"), 1.3))
    e = e.withColumn("distance_km", F.col("great_circle_km") * circuity)
    lead = F.greatest(F.col("distance_km") / _lookup(MODE_SPEED_KM_PER_DAY, F.col("mode")), F.lit(1.0))
    return e.withColumns({
        "transit_days": lead,
        "scheduled_lead_time": lead * F.lit(1.08),
        "cost_usd": _lookup(MODE_BASE_COST_PER_KG, F.col("mode")) * F.lit(DEFAULT_ORDER_WEIGHT_KG),
        "geo_risk": F.lit(DEFAULT_GEO_RISK),
        "inflation": F.lit(DEFAULT_INFLATION),
    })


def edge_weather(edges: DataFrame, conditions: DataFrame | None) -> DataFrame:
    """K4: mean over usable endpoint readings of min(10, 1.8*wave + wind/15); default 5.0.

    ``conditions``: (port, ok, current_wave_height_m, current_wind_kmh), one row per port.
    """
    if conditions is None:
        return edges.withColumn("weather_risk", F.lit(DEFAULT_WEATHER_RISK))
    c = conditions.where(F.col("ok")).select(
        "port", F.least(F.lit(10.0), F.coalesce(F.col("current_wave_height_m"), F.lit(0.0)) * F.lit(1.8)
                        + F.coalesce(F.col("current_wind_kmh"), F.lit(0.0)) / F.lit(15.0)).alias("reading"))
    ca = F.broadcast(c.select(F.col("port").alias("a_port"), F.col("reading").alias("_ra")))
    cb = F.broadcast(c.select(F.col("port").alias("b_port"), F.col("reading").alias("_rb")))
    n = F.when(F.col("_ra").isNotNull(), 1).otherwise(0) + F.when(F.col("_rb").isNotNull(), 1).otherwise(0)
    mean = (F.coalesce(F.col("_ra"), F.lit(0.0)) + F.coalesce(F.col("_rb"), F.lit(0.0))) / n
    return (edges.join(ca, "a_port", "left").join(cb, "b_port", "left")
            .withColumn("weather_risk", F.when(n > 0, mean).otherwise(F.lit(DEFAULT_WEATHER_RISK)))
            .drop("_ra", "_rb"))


def edge_risk(edges: DataFrame, history: DataFrame) -> DataFrame:
    """K6: fallback historical rate + bounded weather nudge, clipped to [0.01, 0.99]."""
    e = with_fallback_rate(edges, history, out_col="base_rate", route_col="route_type",
                           mode_col="mode", cat_col="category")
    adj = (F.col("weather_risk") - F.lit(DEFAULT_WEATHER_RISK)) / F.lit(DEFAULT_WEATHER_RISK) * F.lit(WEATHER_NUDGE)
    p = F.least(F.greatest(F.col("base_rate") + adj, F.lit(0.01)), F.lit(0.99))
    return (e.withColumn("delay_probability", p)
            .withColumn("expected_delay_days", F.col("delay_probability") * F.lit(EXPECTED_DELAY_SCALE))
            .withColumn("risk_score", round_half_even(F.col("delay_probability") * F.lit(100.0), 1))
            .withColumn("risk_tier", request_tier(F.col("risk_score"))))


def route_edges(ports: DataFrame, graphs: DataFrame, history: DataFrame,
                conditions: DataFrame | None = None) -> DataFrame:
    """K1-K6: the attributed edge table, one row per undirected edge per graph."""
    return edge_risk(edge_weather(edge_features(port_pairs(ports), graphs), conditions), history)


def _mm(c: str) -> Column:
    lo, hi = F.col(f"_min_{c}"), F.col(f"_max_{c}")
    return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.lit(0.0))


def priority_weights(edges: DataFrame) -> DataFrame:
    """K8: one row per edge and priority with a real weight and its integer grid value.

    Min/max normalisation is over all edges of the same (mode, category) graph.
    """
    g = ["mode", "category"]
    mm = edges.groupBy(*g).agg(*[f(c).alias(f"_{f.__name__}_{c}") for c in ("distance_km", "cost_usd",
                                                                            "delay_probability")
                                 for f in (F.min, F.max)])
    e = edges.join(F.broadcast(mm), g)
    balanced = (F.lit(0.4) * _mm("distance_km") + F.lit(0.3) * _mm("cost_usd")
                + F.lit(0.3) * _mm("delay_probability"))
    w = F.array(F.struct(F.lit("Fastest").alias("priority"), F.col("transit_days").alias("weight")),
                F.struct(F.lit("Cheapest").alias("priority"), F.col("cost_usd").alias("weight")),
                F.struct(F.lit("Safest").alias("priority"), F.col("delay_probability").alias("weight")),
                F.struct(F.lit("Balanced").alias("priority"), balanced.alias("weight")))
    return (e.select(*g, "a_port_idx", "b_port_idx", F.explode(w).alias("pw"))
            .select(*g, "a_port_idx", "b_port_idx", "pw.priority", "pw.weight",
                    F.round(F.col("pw.weight") * F.lit(WEIGHT_GRID)).cast("bigint").alias("w")))


def _directed(weights: DataFrame) -> DataFrame:
    g = ["mode", "category", "priority"]
    fwd = weights.select(*g, F.col("a_port_idx").alias("src"), F.col("b_port_idx").alias("dst"), "w")
    back = weights.select(*g, F.col("b_port_idx").alias("src"), F.col("a_port_idx").alias("dst"), "w")
    return fwd.unionByName(back)


def all_pairs_best(weights: DataFrame, n_ports: int = 31) -> DataFrame:
    """K9: best path for every (mode, category, priority, src, dst) by min-plus doubling.

    A path has fewer hops than there are ports, so log2(n_ports) rounds reach every path and one
    more finds nothing new; more ports in the edges than ``n_ports`` raise an error.

    Order: total integer weight, then hops, then the port-index path (lexicographic).
    Returns columns mode, category, priority, src, dst, cost, hops, path (array<int>).
    """
    g = ["mode", "category", "priority"]
    best = _directed(weights).select(*g, "src", "dst", F.col("w").alias("cost"), F.lit(1).alias("hops"),
                                     F.array(F.col("src"), F.col("dst")).alias("path"))
    best = materialize(best, "routes-r0")
    if weights.select(F.greatest("a_port_idx", "b_port_idx").alias("p")).agg(F.max("p")).first()[0] not in (None, *range(n_ports)):
        raise ValueError(f"the edges name more than {n_ports} ports")
    for r in range(1, math.ceil(math.log2(max(2, n_ports))) + 2):
        x = best.alias("x")
        y = best.alias("y")
        comb = (x.join(y, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in g] + [F.col("x.dst") == F.col("y.src"),
                                                                             F.col("x.src") != F.col("y.dst")])
                .select(*[F.col(f"x.{c}") for c in g], F.col("x.src"), F.col("y.dst"),
                        (F.col("x.cost") + F.col("y.cost")).alias("cost"),
                        (F.col("x.hops") + F.col("y.hops")).alias("hops"),
                        F.concat(F.col("x.path"), F.slice(F.col("y.path"), 2, 1 << 20)).alias("path"),
                        F.lit(1).alias("is_new")))
        # old rows carry is_new = 0, so an equal candidate keeps the old row and only a strictly
        # better path marks the pair as changed: convergence is a scan, not a join
        nxt = (best.withColumn("is_new", F.lit(0)).unionByName(comb).groupBy(*g, "src", "dst")
               .agg(F.min(F.struct("cost", "hops", "path", "is_new")).alias("b"))
               .select(*g, "src", "dst", "b.cost", "b.hops", "b.path", "b.is_new"))
        nxt = materialize(nxt, f"routes-r{r}")
        changed = nxt.where(F.col("is_new") == 1).limit(1).count()
        best = nxt.drop("is_new")
        if changed == 0:
            return best
    raise RuntimeError("best routes did not converge")


def route_legs(best: DataFrame, edges: DataFrame) -> DataFrame:
    """K10 legs: one row per consecutive port pair on each best path, joined to its edge."""
    g = ["mode", "category", "priority"]
    legs = best.select(*g, "src", "dst", F.posexplode(F.arrays_zip(
        F.slice(F.col("path"), 1, F.size("path") - 1).alias("f"),
        F.slice(F.col("path"), 2, F.size("path") - 1).alias("t"))).alias("leg_no", "leg"))
    legs = legs.select(*g, "src", "dst", "leg_no", F.col("leg.f").alias("from_idx"), F.col("leg.t").alias("to_idx"))
    e = edges.select("mode", "category", "a_port_idx", "b_port_idx", "distance_km", "transit_days", "cost_usd",
                     "delay_probability", "risk_score", "risk_tier", "route_type")
    cond = ((F.col("l.mode") == F.col("e.mode")) & (F.col("l.category") == F.col("e.category"))
            & (F.least(F.col("l.from_idx"), F.col("l.to_idx")) == F.col("e.a_port_idx"))
            & (F.greatest(F.col("l.from_idx"), F.col("l.to_idx")) == F.col("e.b_port_idx")))
    return legs.alias("l").join(e.alias("e"), cond).select(
        "l.*", "e.distance_km", "e.transit_days", "e.cost_usd", "e.delay_probability", "e.risk_score",
        "e.risk_tier", "e.route_type")


def route_totals(best: DataFrame, legs: DataFrame, ports: DataFrame) -> DataFrame:
    """K10 totals: km, cost, days summed; delay = 1 - prod(1 - p); hops; path text."""
    g = ["mode", "category", "priority", "src", "dst"]
    tot = legs.groupBy(*g).agg(
        F.sum("distance_km").alias("total_distance_km"), F.sum("cost_usd").alias("total_cost_usd"),
        F.sum("transit_days").alias("total_transit_days"),
        (F.lit(1.0) - F.product(F.lit(1.0) - F.col("delay_probability"))).alias("overall_delay_probability"))
    names = F.broadcast(ports.select("port_idx", "port"))
    idx_map = F.map_from_entries(F.collect_list(F.struct("port_idx", "port")))
    lookup = names.agg(idx_map.alias("_names"))
    j = best.join(tot, g).crossJoin(lookup)
    return j.select(*g, F.col("_names")[F.col("src")].alias("origin"), F.col("_names")[F.col("dst")].alias("destination"),
                    F.array_join(F.transform("path", lambda i: F.col("_names")[i]), " → ").alias("route"),
                    "hops", "total_distance_km", "total_cost_usd", "total_transit_days", "overall_delay_probability")


def compare_priorities(totals: DataFrame, origin: str, destination: str) -> DataFrame:
    """The four priorities side by side for one port pair (per graph), reference rounding."""
    return totals.where((F.col("origin") == origin) & (F.col("destination") == destination)).select(
        "mode", "category", "priority", "route", "hops",
        round_half_even(F.col("total_distance_km"), 0).alias("distance_km"),
        round_half_even(F.col("total_transit_days"), 1).alias("transit_days"),
        round_half_even(F.col("total_cost_usd"), 0).alias("cost_usd"),
        round_half_even(F.col("overall_delay_probability"), 4).alias("delay_probability"))
