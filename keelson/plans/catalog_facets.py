"""Registered queries on the faceted filter (C1, C2, E3-E17, H1-H4): the portfolio's questions answered from the
facet cube alone, and those that need single shipments on the filtered table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.operators import exposure as ex
from keelson.operators import facet_cube as fc
from keelson.operators import portfolio as pf
from keelson.plans import catalog, catalog_landed  # noqa: F401  (their SQL is restated on the filter below)
from keelson.plans import scored as sc
from keelson.plans.catalog import FACET_SQL, FACETS
from keelson.plans.catalog_landed import ORACLE_SIMS, SIM_SQL, markers_sql, simulations_sql
from keelson.plans.oracle import with_ctes
from keelson.plans.registry import REGISTRY, register
from keelson.session import ensure_checkpoint_dir
from keelson.sources import shipments as ship


def _chosen(name: str, sql: str | None = None) -> str:
    """The given or registered SQL of a question on the scored table, on the filter's rows."""
    prefix = with_ctes("")
    sql = sql or REGISTRY[name][1]
    assert sql.startswith(prefix) and "FROM scored" in sql[len(prefix):], name
    return prefix + f", chosen AS (SELECT * FROM scored WHERE {FACET_SQL})" + sql[len(prefix):].replace("FROM scored", "FROM chosen")


_CUBES: dict[tuple[str, str], fc.FacetCube] = {}


def _cube(spark: SparkSession, sf: str) -> fc.FacetCube:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _CUBES:
        _CUBES[key] = fc.build(sc.scored(spark, sf))
    return _CUBES[key]


#: question -> (its name on the whole table, its answer from a chosen cube)
FROM_CUBE: dict[str, Callable[[fc.FacetCube], DataFrame]] = {
    "tier_split": lambda c: pf.tier_split(c.lanes),
    "tier_calibration": lambda c: pf.tier_calibration(c.lanes),
    "calibration_monotone": lambda c: pf.calibration_monotone(c.lanes),
    "flow_mode_route": lambda c: pf.flow_mode_route(c.lanes),
    "flow_mode_route_tier": lambda c: pf.flow_mode_route_tier(c.lanes),
    "category_risk": lambda c: pf.category_risk(c.lanes),
    "delay_rate_by_mode": lambda c: pf.delay_rate_by_mode(c.lanes),
    "monthly_trend": lambda c: pf.monthly_trend(c.lanes),
    "lane_summary": lambda c: pf.lane_summary(c.lanes),
    "geo_score_density": lambda c: pf.density_2d(c.values, "Geopolitical_Risk_Index", "Shipment_Risk_Score", 25),
    "tier_score_distribution": lambda c: c.tier_score_distribution(),
    "tier_score_density": lambda c: pf.tier_score_density(c.values),
    "port_statistics": lambda c: pf.port_statistics(c.lanes),
    "lane_arcs": lambda c: pf.lane_arcs(c.lanes),
}


def _register_from_cube(name: str, answer: Callable[[fc.FacetCube], DataFrame]) -> None:
    @register(f"{name}_filtered", _chosen(name))
    def query(spark, sf):
        return answer(_cube(spark, sf).choose(**FACETS))
    query.__doc__ = f"{name} on the faceted filter, from the facet cube."


for _name, _answer in FROM_CUBE.items():
    _register_from_cube(_name, _answer)


@register("facet_cube_lanes", with_ctes(
    " SELECT Transportation_Mode, Route_Type, Product_Category, Risk_Tier, Order_YearMonth, Origin_City, Destination_City, COUNT(*) AS cell_rows,"
    " CAST(SUM(Is_Delayed) AS BIGINT) AS cell_late, CAST(SUM(Risk_Score_Tenths) AS BIGINT) AS cell_tenths, COUNT(Risk_Score_Tenths) AS cell_scored"
    " FROM scored GROUP BY ALL"))
def q_cube(spark, sf):
    """The cube's cells under the four facets, the month and the lane."""
    return _cube(spark, sf).lanes


@register("facet_counts_by_choice", with_ctes(
    ", shown AS (SELECT Transportation_Mode, Route_Type, COUNT(*) AS n FROM scored GROUP BY 1, 2)"
    " SELECT Transportation_Mode, Route_Type, n AS shown, (SELECT COUNT(*) FROM scored) AS total FROM shown"))
def q_counts_by_choice(spark, sf):
    """C1: 'showing x of y' of every mode x route type choice at once, from the cube."""
    lanes = _cube(spark, sf).lanes
    total = lanes.agg(F.sum(pf.CELL_ROWS).alias("total"))
    return pf.flow_mode_route(lanes).select("Transportation_Mode", "Route_Type", F.col("shipments").alias("shown")).crossJoin(F.broadcast(total))  # a 1-row total


@register("dataset_ports_filtered", with_ctes(
    f", chosen AS (SELECT * FROM scored WHERE {FACET_SQL})"
    " SELECT port FROM (SELECT Origin_City AS port FROM chosen UNION SELECT Destination_City FROM chosen) WHERE port IS NOT NULL"))
def q_ports_filtered(spark, sf):
    return pf.dataset_ports(_cube(spark, sf).choose(**FACETS).lanes)


# ---------------------------------------------------------------- questions about single shipments
def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return pf.faceted_filter(sc.scored(spark, sf), **FACETS)


@register("top_risk_shipments_filtered", _chosen("top_risk_shipments"))
def q_top_filtered(spark, sf):
    return pf.top_risk(_rows(spark, sf), 200)


def _sims(spark, sf):
    return sc._memo(spark, sf, "sims-filtered", lambda: ex.simulate(_rows(spark, sf), ORACLE_SIMS, 42))


@register("exposure_simulations_filtered", _chosen("exposure_simulations", simulations_sql(SIM_SQL)))
def q_sims_filtered(spark, sf):
    """H1 on the faceted filter."""
    return _sims(spark, sf)


@register("exposure_expectation_filtered", _chosen("exposure_expectation"))
def q_expect_filtered(spark, sf):
    """H2 on the faceted filter."""
    e = ex.expectation(_rows(spark, sf))
    return e.select(F.round("expected_delayed", 6).alias("expected_delayed"), F.round("expected_exposure_usd", 2).alias("expected_exposure_usd"))


@register("exposure_histogram_filtered", _chosen("exposure_histogram"))
def q_hist_filtered(spark, sf):
    """H4 on the faceted filter."""
    h = ex.histograms(_sims(spark, sf))
    return h.select("metric", "bin", "n", F.round("bin_from", 6).alias("bin_from"), F.round("bin_to", 6).alias("bin_to"))


@register("exposure_markers_filtered", _chosen("exposure_markers", markers_sql(SIM_SQL)))
def q_markers_filtered(spark, sf):
    """H4: the expected and p95 lines on the faceted filter."""
    m = ex.markers(_rows(spark, sf), _sims(spark, sf))
    return m.select("metric", F.when(F.col("metric") == "exposure_usd", F.round("expected", 2)).otherwise(F.round("expected", 6)).alias("expected"),
                    F.round("p95", 6).alias("p95"))


# ---------------------------------------------------------------- A6: month-partitioned export
#: the month that is written anew, and the months that are read back
REWRITTEN, READ_BACK = "1995-03", ["1995-02", "1995-03"]


def _export(spark: SparkSession, sf: str) -> str:
    """The filtered rows by month, one month of them replaced by the whole table's."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/keelson-export-{uuid.uuid4().hex}"
    ship.export_scored(_rows(spark, sf), path)
    ship.replace_months(sc.scored(spark, sf), path, [REWRITTEN])
    return path


@register("scored_export_by_month", with_ctes(
    f" SELECT Order_ID, Order_YearMonth, Transportation_Mode, Shipment_Risk_Score, Risk_Tier FROM scored WHERE Order_YearMonth = '{REWRITTEN}'"
    f" OR (Order_YearMonth IN ('{READ_BACK[0]}') AND {FACET_SQL})"))
def q_export_by_month(spark, sf):
    """Two months read back from the export after one of them was written anew."""
    return ship.read_months(spark, _export(spark, sf), READ_BACK).select("Order_ID", "Order_YearMonth", "Transportation_Mode", "Shipment_Risk_Score", "Risk_Tier")


@register("scored_export_months", with_ctes(
    f" SELECT Order_YearMonth, COUNT(*) AS shipments FROM scored WHERE Order_YearMonth = '{REWRITTEN}' OR ({FACET_SQL}) GROUP BY 1"))
def q_export_months(spark, sf):
    """The whole export, by month."""
    return ship.read_months(spark, _export(spark, sf)).groupBy("Order_YearMonth").agg(F.count(F.lit(1)).alias("shipments"))
