"""Historical delay-rate tables.

All three granularities come from one ``rollup`` pass over the shipments: one
scan, one partial+final aggregation, one small result (bounded by the
route-type x mode x category vocabulary).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.plans.materialize import materialize

KEYS = ["Route_Type", "Transportation_Mode", "Product_Category"]
MIN_SAMPLES = 100
#: rows of the rate rollup that are broadcast
BROADCAST_RATES = 100_000


def rate_rollup(df: DataFrame) -> DataFrame:
    """(Route_Type, Mode, Category) rollup of delay rate and count with its grouping level."""
    return (df.rollup(*KEYS)
            .agg(F.sum("Is_Delayed").alias("n_delayed"), F.count(F.lit(1)).alias("n"),
                 F.grouping_id().alias("level"))
            .withColumn("rate", F.col("n_delayed") / F.col("n")))


def combo_rates(df: DataFrame) -> DataFrame:
    """delay rate and count per (route type, mode, category); null keys dropped like pandas."""
    r = rate_rollup(df).where(F.col("level") == 0)
    for k in KEYS:
        r = r.where(F.col(k).isNotNull())
    return r.select(*KEYS, F.col("rate").alias("delay_rate"), F.col("n").alias("count"))


def route_rates(df: DataFrame) -> DataFrame:
    """delay rate per route type."""
    return (rate_rollup(df).where((F.col("level") == 3) & F.col("Route_Type").isNotNull())
            .select("Route_Type", F.col("rate").alias("delay_rate"), F.col("n").alias("count")))


def global_rate(df: DataFrame) -> DataFrame:
    """overall delay rate (one row)."""
    return rate_rollup(df).where(F.col("level") == 7).select(F.col("rate").alias("global_rate"))


def with_fallback_rate(requests: DataFrame, history: DataFrame, out_col: str = "base_rate",
                       route_col: str = "Route_Type", mode_col: str = "Transportation_Mode",
                       cat_col: str = "Product_Category", min_samples: int = MIN_SAMPLES) -> DataFrame:
    """combo rate when the combo has >= ``min_samples`` rows, else route-type rate, else global.

    The rollup is computed once and written; it is broadcast if its measured size is small, so the
    requests are not shuffled by their few keys, and joined by a shuffle otherwise.
    """
    roll = materialize(rate_rollup(history), "rates")
    sized = F.broadcast if roll.count() <= BROADCAST_RATES else (lambda t: t)
    combo = roll.where(F.col("level") == 0).select(
        F.col("Route_Type").alias("_c_rt"), F.col("Transportation_Mode").alias("_c_m"),
        F.col("Product_Category").alias("_c_c"), F.col("rate").alias("_c_rate"), F.col("n").alias("_c_n"))
    route = roll.where(F.col("level") == 3).select(
        F.col("Route_Type").alias("_r_rt"), F.col("rate").alias("_r_rate"))
    glob = F.broadcast(roll.where(F.col("level") == 7).select(F.col("rate").alias("_g_rate")))
    out = (requests
           .join(sized(combo), (F.col(route_col) == F.col("_c_rt")) & (F.col(mode_col) == F.col("_c_m"))
                 & (F.col(cat_col) == F.col("_c_c")), "left")
           .join(sized(route), F.col(route_col) == F.col("_r_rt"), "left")
           .crossJoin(glob))
    rate = F.coalesce(F.when(F.col("_c_n") >= min_samples, F.col("_c_rate")), F.col("_r_rate"), F.col("_g_rate"))
    return out.withColumn(out_col, rate).drop("_c_rt", "_c_m", "_c_c", "_c_rate", "_c_n", "_r_rt",
                                              "_r_rate", "_g_rate")
