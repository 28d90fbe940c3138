"""The facet cube answers every choice as a scan of the filtered table does."""

import random

import pytest
from pyspark.sql import functions as F

from keelson.operators import facet_cube as fc
from keelson.operators import portfolio as pf
from keelson.plans import scored as sc
from keelson.plans.catalog_facets import FROM_CUBE
from table_dirs import SMALL

SCAN = {
    "geo_score_density": lambda s: pf.density_2d(s, "Geopolitical_Risk_Index", "Shipment_Risk_Score", 25),
    "tier_score_distribution": pf.tier_score_distribution, "tier_score_density": pf.tier_score_density,
}


@pytest.fixture(scope="module")
def table(spark):
    """The scored shipments with some tiers and scores missing, and a hot lane."""
    s = sc.scored(spark, SMALL)
    no_score = F.col("Order_ID") % 17 == 0
    s = s.withColumn("Risk_Tier", F.when(~no_score, F.col("Risk_Tier")))
    for c in ("Risk_Score_Tenths", "Shipment_Risk_Score"):
        s = s.withColumn(c, F.when(~no_score, F.col(c)))
    return sc.materialize(s, "facet-test"), fc.build(s)


def choices():
    rng = random.Random(4)
    modes, routes = ["Air", "Sea"], ["Suez", "Pacific", "Atlantic", "Intra-Asia", "Commodity"]
    categories, tiers = ["Auto Parts", "Textiles", "Semiconductors", "Raw Materials"], ["Low", "Medium", "High", "Severe"]
    out = [{}, dict(modes=[]), dict(modes=modes, route_types=routes, tiers=tiers), dict(modes=["Rail"])]
    for _ in range(3):
        out.append({k: rng.sample(v, rng.randint(1, len(v))) for k, v in
                    (("modes", modes), ("route_types", routes), ("categories", categories), ("tiers", tiers)) if rng.random() < 0.7})
    return out


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


@pytest.mark.parametrize("choice", choices(), ids=str)
def test_cube_equals_scan(table, choice):
    scored, cube = table
    chosen, scan = cube.choose(**choice), pf.faceted_filter(scored, **choice)
    for name, answer in FROM_CUBE.items():
        assert rows(answer(chosen)) == rows(SCAN.get(name, getattr(pf, name, None))(scan)), name
    assert rows(pf.kpi_strip(chosen.lanes)) == rows(pf.kpi_strip(scan))
    assert rows(pf.facet_counts(cube.lanes, **choice)) == rows(pf.facet_counts(scored, **choice))


def test_cube_is_bounded_by_its_grids(table):
    scored, cube = table
    assert cube.values.count() <= scored.select(*fc.FACET_COLUMNS, "Geopolitical_Risk_Index", "Risk_Score_Tenths").distinct().count()
    assert cube.lanes.agg(F.sum(pf.CELL_ROWS)).first()[0] == scored.count() == cube.values.agg(F.sum(pf.CELL_ROWS)).first()[0]
