"""A cube of mergeable measures under the dashboard's four facets: any choice is rolled up without a second scan of the shipments.

Two written tables hold it:

* ``lanes``, a row per mode x route type x category x tier x month x lane, with the shipments, the late ones, the sum of
  the scores' tenths and how many have a score;
* ``values``, a row per mode x route type x category x tier x distinct (geopolitical index, score tenths), with
  the shipments.  Scores lie on a grid of 1,001 tenths and the index on a grid of hundredths, so the table is
  bounded by the grids; it holds what minima, maxima, quantiles and histograms of a choice need, exactly.

Both have the scored table's facet columns, so a choice is the same filter (:func:`~keelson.operators.portfolio.faceted_filter`), and
the portfolio's questions read ``CELL_ROWS`` and its companions in place of single rows.  Counts and sums of whole numbers
merge without rounding, so every answer equals the scan's.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.operators import portfolio as pf
from keelson.plans.materialize import materialize

FACET_COLUMNS = ["Transportation_Mode", "Route_Type", "Product_Category", "Risk_Tier"]


@dataclass
class FacetCube:
    lanes: DataFrame
    values: DataFrame

    def choose(self, modes: Sequence[str] | None = None, route_types: Sequence[str] | None = None,
               categories: Sequence[str] | None = None, tiers: Sequence[str] | None = None) -> FacetCube:
        return FacetCube(*(pf.faceted_filter(t, modes, route_types, categories, tiers) for t in (self.lanes, self.values)))

    def tier_score_distribution(self) -> DataFrame:
        """E13 from the distinct scores: at most 1,001 a tier, whatever the number of shipments."""
        s = self.values.where(F.col("Risk_Tier").isNotNull() & F.col("Risk_Score_Tenths").isNotNull())
        per_score = s.groupBy("Risk_Tier", "Risk_Score_Tenths").agg(F.sum(pf.CELL_ROWS).alias("_n"))
        w = Window.partitionBy("Risk_Tier").orderBy("Risk_Score_Tenths")
        upto = per_score.withColumn("_upto", F.sum("_n").over(w)).withColumn("_all", F.sum("_n").over(Window.partitionBy("Risk_Tier")))

        def ranked(q: float):
            """Score at the quantile's place by linear interpolation between its two neighbours."""
            place = (F.col("_all") - 1) * F.lit(q)
            lo, hi = F.floor(place), F.ceil(place)

            def at(rank):  # the score that holds the 0-based rank
                held = (rank >= F.col("_upto") - F.col("_n")) & (rank < F.col("_upto"))
                return F.max(F.when(held, F.col("Risk_Score_Tenths") / F.lit(10.0)))
            return at(lo), at(hi), F.max(place - lo)

        quantiles = {name: ranked(q) for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))}
        columns = [c.alias(f"_{name}{k}") for name, parts in quantiles.items() for k, c in enumerate(parts)]
        got = upto.groupBy("Risk_Tier").agg(
            F.sum("_n").alias("n"), (F.min("Risk_Score_Tenths") / F.lit(10.0)).alias("min_score"), (F.max("Risk_Score_Tenths") / F.lit(10.0)).alias("max_score"),
            F.sum(F.col("_n") * F.col("Risk_Score_Tenths")).alias("_st"), *columns)
        # shipments without a score count in n, as in a scan
        every = self.lanes.where(F.col("Risk_Tier").isNotNull()).groupBy("Risk_Tier").agg(F.sum(pf.CELL_ROWS).alias("_rows"))

        def value(name):
            lo, hi, part = (F.col(f"_{name}{k}") for k in range(3))
            return F.round(lo + (hi - lo) * part, 6).alias(name)
        return got.join(every, "Risk_Tier").select(
            "Risk_Tier", F.col("_rows").alias("n"), "min_score", value("q1"), value("median"), value("q3"), "max_score",
            F.round(pf.mean_score(F.col("_st"), F.col("n")), 6).alias("mean_score"))


def build(df: DataFrame) -> FacetCube:
    """The cube of a scored table: two aggregations, combined before their shuffles."""
    lanes = df.groupBy(*FACET_COLUMNS, "Order_YearMonth", "Origin_City", "Destination_City").agg(
        F.count(F.lit(1)).alias(pf.CELL_ROWS), F.sum("Is_Delayed").alias(pf.CELL_LATE), F.sum("Risk_Score_Tenths").alias(pf.CELL_TENTHS),
        F.count("Risk_Score_Tenths").alias(pf.CELL_SCORED))
    values = df.groupBy(*FACET_COLUMNS, "Geopolitical_Risk_Index", "Risk_Score_Tenths", "Shipment_Risk_Score").agg(F.count(F.lit(1)).alias(pf.CELL_ROWS))
    return FacetCube(materialize(lanes, "facet-lanes"), materialize(values, "facet-values"))
