"""Portfolio questions over the scored shipments.

Every aggregate is a single groupBy (partial aggregation before the shuffle);
rates are computed as integer sums over counts and mean scores from the exact
tenths grid, so results do not depend on partitioning or summation order.
Dimensions (31 ports, 4 tiers) are broadcast; they are fixed-size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions.stats import exact_percentiles
from keelson.functions.tiers import TIERS, tier_dim
from keelson.operators.scoring import round_half_even
from keelson.sources.ports import ports


def delay_rate(n_delayed: Column, n: Column) -> Column:
    """Share of late shipments; null where there are none (an empty choice)."""
    return n_delayed.cast("double") / F.nullif(n, F.lit(0))


def pct_1dp(rate: Column) -> Column:
    """Rate as a percentage rounded half-even to one decimal."""
    return round_half_even(rate * F.lit(100.0), 1)


def mean_score(sum_tenths: Column, n: Column) -> Column:
    return sum_tenths.cast("double") / F.nullif(n, F.lit(0)) / F.lit(10.0)


#: measures of a cell that stands for many shipments (:mod:`keelson.operators.facet_cube`)
CELL_ROWS, CELL_LATE, CELL_TENTHS, CELL_SCORED = "cell_rows", "cell_late", "cell_tenths", "cell_scored"


def _rows(df: DataFrame) -> Column:
    """How many shipments a group holds: its rows, or the sum over its cells."""
    return F.coalesce(F.sum(CELL_ROWS), F.lit(0)) if CELL_ROWS in df.columns else F.count(F.lit(1))


def _late(df: DataFrame) -> Column:
    return F.sum(CELL_LATE if CELL_LATE in df.columns else "Is_Delayed")


def _rows_where(df: DataFrame, cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col(CELL_ROWS))), F.lit(0)) if CELL_ROWS in df.columns else F.count_if(cond)


def _aggs(df: DataFrame) -> list[Column]:
    """n, _nd (late), _st (sum of score tenths) and _ns (shipments with a score), of rows or of cells."""
    cells = CELL_ROWS in df.columns
    return [_rows(df).alias("n"), _late(df).alias("_nd"), F.sum(CELL_TENTHS if cells else "Risk_Score_Tenths").alias("_st"),
            (F.sum(CELL_SCORED) if cells else F.count("Risk_Score_Tenths")).alias("_ns")]


def faceted_filter(df: DataFrame, modes: Sequence[str] | None = None, route_types: Sequence[str] | None = None,
                   categories: Sequence[str] | None = None, tiers: Sequence[str] | None = None) -> DataFrame:
    """Four IN sets ANDed; ``None`` means every value.  A null tier never matches a tier set."""
    cond = _facet_condition(modes, route_types, categories, tiers)
    return df if cond is None else df.where(cond)


def _facet_condition(modes, route_types, categories, tiers) -> Column | None:
    cond = None
    for col, vals in (("Transportation_Mode", modes), ("Route_Type", route_types),
                      ("Product_Category", categories), ("Risk_Tier", tiers)):
        if vals is not None:
            c = F.col(col).isin(list(vals))
            cond = c if cond is None else cond & c
    return cond


def facet_counts(df: DataFrame, **facets) -> DataFrame:
    """C1: 'showing x of y' in one pass over the unfiltered table."""
    cond = _facet_condition(facets.get("modes"), facets.get("route_types"),
                            facets.get("categories"), facets.get("tiers"))
    shown = _rows(df) if cond is None else _rows_where(df, F.coalesce(cond, F.lit(False)))
    return df.agg(shown.alias("shown"), _rows(df).alias("total"))


def top_risk(df: DataFrame, k: int = 200) -> DataFrame:
    """The k riskiest shipments (TakeOrdered; Order_ID breaks ties)."""
    return (df.orderBy(F.col("Shipment_Risk_Score").desc_nulls_last(), F.col("Order_ID"))
            .limit(k)
            .select("Order_ID", "Route", "Transportation_Mode", "Product_Category",
                    round_half_even(F.col("Predicted_Delay_Probability") * F.lit(100.0), 1).alias("p_delay_pct"),
                    F.col("Predicted_Delay_Days").alias("expected_delay_days"),
                    "Shipment_Risk_Score", "Risk_Tier", "Is_Delayed"))


def board_numbers(df: DataFrame) -> DataFrame:
    """Value analysed, Low/Severe tier late %, and computed expected exposure (no literals)."""
    t = F.col("Risk_Tier")
    return df.agg(
        F.round(F.sum("Shipping_Cost_USD"), 2).alias("total_value_usd"),
        pct_1dp(delay_rate(F.sum(F.when(t == "Low", F.col("Is_Delayed"))), F.count_if(t == "Low")))
        .alias("low_tier_late_pct"),
        pct_1dp(delay_rate(F.sum(F.when(t == "Severe", F.col("Is_Delayed"))), F.count_if(t == "Severe")))
        .alias("severe_tier_late_pct"),
        F.round(F.sum("Predicted_Delay_Probability"), 4).alias("expected_delayed"),
        F.round(F.sum(F.col("Predicted_Delay_Probability") * F.col("Shipping_Cost_USD")), 2)
        .alias("expected_exposure_usd"),
    )


def kpi_strip(df: DataFrame) -> DataFrame:
    """Count, delay %, mean score, High+Severe share on the (filtered) table."""
    return df.agg(*_aggs(df), _rows_where(df, F.col("Risk_Tier").isin("High", "Severe")).alias("_hs")).select(
        F.col("n").alias("shipments"),
        pct_1dp(delay_rate(F.col("_nd"), F.col("n"))).alias("delay_pct"),
        round_half_even(mean_score(F.col("_st"), F.col("_ns")), 1).alias("avg_risk_score"),
        pct_1dp(delay_rate(F.col("_hs"), F.col("n"))).alias("high_severe_pct"))


def tier_split(df: DataFrame) -> DataFrame:
    """Shipments per tier in fixed order, missing tiers zero-filled."""
    counts = df.groupBy("Risk_Tier").agg(_rows(df).alias("_n"))
    return (tier_dim(df.sparkSession).join(F.broadcast(counts), "Risk_Tier", "left")   # a row per tier
            .select("Risk_Tier", "tier_rank", F.coalesce(F.col("_n"), F.lit(0)).alias("shipments")))


def tier_calibration(df: DataFrame) -> DataFrame:
    """Actual delay rate per tier in fixed order; empty tier -> null."""
    rates = df.groupBy("Risk_Tier").agg(delay_rate(_late(df), _rows(df)).alias("delay_rate"))
    return tier_dim(df.sparkSession).join(F.broadcast(rates), "Risk_Tier", "left") \
        .select("Risk_Tier", "tier_rank", "delay_rate")


def calibration_monotone(df: DataFrame) -> DataFrame:
    """E5: does the delay rate rise (non-strictly) from Low to Severe?  Empty tiers fail the check."""
    w = Window.orderBy("tier_rank")
    cal = tier_calibration(df).withColumn("_prev", F.lag("delay_rate").over(w))
    ok = F.when(F.col("_prev").isNull(), F.col("delay_rate").isNotNull()) \
        .otherwise(F.coalesce(F.col("delay_rate") >= F.col("_prev"), F.lit(False)))
    return cal.agg(F.bool_and(ok).alias("is_monotone"), F.count("delay_rate").alias("tiers_with_rows"))


def flow_mode_route(df: DataFrame) -> DataFrame:
    """Shipment counts mode -> route type."""
    return df.groupBy("Transportation_Mode", "Route_Type").agg(_rows(df).alias("shipments"))


def flow_mode_route_tier(df: DataFrame) -> DataFrame:
    """Counts mode x route type x tier (only non-empty groups exist)."""
    return df.groupBy("Transportation_Mode", "Route_Type", "Risk_Tier").agg(_rows(df).alias("shipments"))


def category_risk(df: DataFrame) -> DataFrame:
    """Per category volume and delay rate."""
    return df.groupBy("Product_Category").agg(
        _rows(df).alias("volume"), delay_rate(_late(df), _rows(df)).alias("delay_rate"))


def delay_rate_by_mode(df: DataFrame) -> DataFrame:
    """Delay rate per mode, descending."""
    return df.groupBy("Transportation_Mode").agg(
        delay_rate(_late(df), _rows(df)).alias("delay_rate")).orderBy(F.desc("delay_rate"))


def monthly_trend(df: DataFrame) -> DataFrame:
    """Delay rate and volume per yyyy-MM, ascending."""
    return df.groupBy("Order_YearMonth").agg(
        delay_rate(_late(df), _rows(df)).alias("delay_rate"),
        _rows(df).alias("volume")).orderBy("Order_YearMonth")


def lane_summary(df: DataFrame) -> DataFrame:
    """Per lane mean score (1 dp), delay % (1 dp), volume, sorted by score desc."""
    return (df.groupBy("Origin_City", "Destination_City").agg(*_aggs(df))
            .select(F.concat_ws(" → ", "Origin_City", "Destination_City").alias("Route"),
                    round_half_even(mean_score(F.col("_st"), F.col("_ns")), 1).alias("avg_risk_score"),
                    pct_1dp(delay_rate(F.col("_nd"), F.col("n"))).alias("delay_rate_pct"),
                    F.col("n").alias("volume"))
            .orderBy(F.desc("avg_risk_score"), "Route"))


def equi_width_bin(x: Column, lo: Column, hi: Column, nbins: int) -> Column:
    """Bin index 0..nbins-1 over [lo, hi]; the maximum falls in the last bin; constant column -> 0."""
    width = hi - lo
    idx = F.floor((x - lo) / F.when(width > 0, width) * F.lit(float(nbins)))
    return F.when(width > 0, F.least(F.lit(nbins - 1).cast("bigint"), idx)).otherwise(F.lit(0).cast("bigint"))


def _cell(df: DataFrame) -> list[Column]:
    return [F.col(CELL_ROWS)] if CELL_ROWS in df.columns else []


def density_2d(df: DataFrame, x: str, y: str, nbins: int = 25, by: Sequence[str] = ()) -> DataFrame:
    """E12 (and U5/U11): equi-width 2-D histogram; min/max are a broadcast 1-row (or per-group) statistic."""
    by = list(by)
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    mm = d.groupBy(*by).agg(F.min(x).alias("_xlo"), F.max(x).alias("_xhi"),
                            F.min(y).alias("_ylo"), F.max(y).alias("_yhi"))
    j = d.join(F.broadcast(mm), by) if by else d.crossJoin(F.broadcast(mm))
    return (j.select(*by, equi_width_bin(F.col(x), F.col("_xlo"), F.col("_xhi"), nbins).alias("x_bin"),
                     equi_width_bin(F.col(y), F.col("_ylo"), F.col("_yhi"), nbins).alias("y_bin"), *_cell(df))
            .groupBy(*by, "x_bin", "y_bin").agg(_rows(df).alias("shipments")))


def histogram_1d(df: DataFrame, x: str, nbins: int, by: Sequence[str] = ()) -> DataFrame:
    """1-D equi-width histogram (E13 density, H4)."""
    by = list(by)
    d = df.where(F.col(x).isNotNull())
    mm = d.groupBy(*by).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    j = d.join(F.broadcast(mm), by) if by else d.crossJoin(F.broadcast(mm))
    return (j.select(*by, equi_width_bin(F.col(x), F.col("_lo"), F.col("_hi"), nbins).alias("bin"),
                     F.col("_lo"), F.col("_hi"), *_cell(df))
            .groupBy(*by, "bin").agg(_rows(df).alias("n"), F.first("_lo").alias("lo"),
                                      F.first("_hi").alias("hi")))


def tier_score_distribution(df: DataFrame) -> DataFrame:
    """Per non-empty tier n, min, quartiles, max, mean of the score."""
    s = df.where(F.col("Risk_Tier").isNotNull())
    basic = s.groupBy("Risk_Tier").agg(
        F.count(F.lit(1)).alias("n"), F.min("Shipment_Risk_Score").alias("min_score"),
        F.max("Shipment_Risk_Score").alias("max_score"),
        F.sum("Risk_Score_Tenths").alias("_st"), F.count("Risk_Score_Tenths").alias("_ns"))
    q = exact_percentiles(s, "Shipment_Risk_Score", {"q1": 0.25, "median": 0.5, "q3": 0.75}, by=["Risk_Tier"])
    return basic.join(q, "Risk_Tier").select(
        "Risk_Tier", "n", "min_score", F.round("q1", 6).alias("q1"), F.round("median", 6).alias("median"),
        F.round("q3", 6).alias("q3"), "max_score", F.round(mean_score(F.col("_st"), F.col("_ns")), 6).alias("mean_score"))


def tier_score_density(df: DataFrame, nbins: int = 50) -> DataFrame:
    """50-bin density of the score inside each non-empty tier."""
    return histogram_1d(df.where(F.col("Risk_Tier").isNotNull()), "Shipment_Risk_Score", nbins, by=["Risk_Tier"]) \
        .select("Risk_Tier", "bin", "n")


def _port_roles(df: DataFrame) -> DataFrame:
    measures = [CELL_ROWS, CELL_LATE, CELL_TENTHS, CELL_SCORED] if CELL_ROWS in df.columns else ["Is_Delayed", "Risk_Score_Tenths"]
    return df.select(
        F.explode(F.array(
            F.struct(F.col("Origin_City").alias("port"), F.lit("origin").alias("role")),
            F.struct(F.col("Destination_City").alias("port"), F.lit("destination").alias("role")))).alias("pr"),
        *measures).select("pr.port", "pr.role", *measures)


def port_statistics(df: DataFrame) -> DataFrame:
    """For all 31 ports, as-origin and as-destination volume, delay %, mean score; in-dataset flag."""
    roles = _port_roles(df)
    n, nd, st, ns = _aggs(roles)
    g = roles.groupBy("port").pivot("role", ["origin", "destination"]).agg(n.alias("n"), nd.alias("nd"), st.alias("st"), ns.alias("ns"))
    out = ports(df.sparkSession).join(g, "port", "left")
    cols = ["port_idx", "port", "lat", "lon", "region_label"]
    for role in ("origin", "destination"):
        n = F.coalesce(F.col(f"{role}_n"), F.lit(0))
        cols += [n.alias(f"{role}_shipments"),
                 pct_1dp(delay_rate(F.col(f"{role}_nd"), F.col(f"{role}_n"))).alias(f"{role}_delay_pct"),
                 round_half_even(mean_score(F.col(f"{role}_st"), F.col(f"{role}_ns")), 1).alias(f"{role}_avg_score")]
    in_ds = (F.coalesce(F.col("origin_n"), F.lit(0)) + F.coalesce(F.col("destination_n"), F.lit(0))) > 0
    return out.select(*cols, in_ds.alias("in_dataset"))


def dataset_ports(df: DataFrame) -> DataFrame:
    """Distinct origins UNION distinct destinations."""
    return df.select(F.col("Origin_City").alias("port")).union(
        df.select(F.col("Destination_City").alias("port"))).distinct().where(F.col("port").isNotNull())


def score_color(score: Column) -> Column:
    # Arc colours by mean-score band.
    return (F.when(score < 20, "#2dd4bf").when(score < 40, "#f5b942")
            .when(score < 65, "#ff8c42").otherwise("#ef4444"))


def lane_arcs(df: DataFrame) -> DataFrame:
    """Per-lane arcs with both endpoints' coordinates (lanes with an unknown port dropped)."""
    p = ports(df.sparkSession)
    o = F.broadcast(p.select(F.col("port").alias("Origin_City"), F.col("lat").alias("start_lat"),
                             F.col("lon").alias("start_lng")))
    d = F.broadcast(p.select(F.col("port").alias("Destination_City"), F.col("lat").alias("end_lat"),
                             F.col("lon").alias("end_lng")))
    g = df.groupBy("Origin_City", "Destination_City").agg(*_aggs(df))
    score = mean_score(F.col("_st"), F.col("_ns"))
    rate_pct = pct_1dp(delay_rate(F.col("_nd"), F.col("n")))
    label = F.format_string("%s &rarr; %s: %s%% delayed, %s shipments", F.col("Origin_City"),
                            F.col("Destination_City"), F.format_string("%.1f", rate_pct),
                            F.format_number(F.col("n"), 0))
    return (g.join(o, "Origin_City").join(d, "Destination_City")
            .select("Origin_City", "Destination_City", "start_lat", "start_lng", "end_lat", "end_lng",
                    round_half_even(score, 1).alias("avg_score"), F.col("n").alias("volume"),
                    rate_pct.alias("delay_rate_pct"), score_color(score).alias("color"), label.alias("label")))


def port_points(df: DataFrame) -> DataFrame:
    """Every port's point; colour and size by data-set membership."""
    ds = dataset_ports(df).withColumn("_in", F.lit(True))
    j = ports(df.sparkSession).join(ds, "port", "left")
    in_ds = F.coalesce(F.col("_in"), F.lit(False))
    # Point colours and sizes for in-dataset / tracking-only ports.
    return j.select("port_idx", "port", "lat", "lon", in_ds.alias("in_dataset"),
                    F.when(in_ds, "#2dd4bf").otherwise("#5b8def").alias("color"),
                    F.when(in_ds, F.lit(0.45)).otherwise(F.lit(0.3)).alias("size"))
