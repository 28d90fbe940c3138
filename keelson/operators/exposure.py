"""Portfolio exposure distribution (H1-H4) as a distributed Bernoulli simulation.

The reference draws an (n_sims x n_shipments) matrix in memory.  Here each
task draws for its own rows, a block and a simulation at a time (n_sims <= 5,000 by
parameter), each draw is a hash-derived uniform (retry- and partition-independent,
unlike ``rand``), and a task returns its hits summed per simulation, so no
draw matrix is ever materialised.  Money is summed
on an integer cent grid so totals do not depend on summation order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.stats import exact_quantiles
from keelson.operators.hashed_draws import hits_per_simulation
from keelson.operators.portfolio import histogram_1d

ALLOWED_SIMS = (500, 1000, 2000, 5000)
UNIFORMS = ("md5", "md5_each", "xxhash")
TWO_POW_32 = 4294967296.0


#: one md5 gives this many uniforms of 32 bits
PARTS = 4
#: draws of a task: the rows are spread anew, as a compact table has few files for so much work
TASK_DRAWS = 100_000_000


def hex_threshold(p: Column) -> Column:
    """Eight hex digits t such that a uniform of eight hex digits h is below p exactly if h < t as text."""
    least = F.ceil(p * F.lit(TWO_POW_32)).cast("bigint")
    return F.when(least >= 1 << 32, "g").otherwise(F.lpad(F.lower(F.hex(least)), 8, "0"))


def md5_hits(df: DataFrame, n_sims: int, seed: int, p: str, key: str, parts: int, tasks: int) -> DataFrame:
    """sim_id, _n and _c of every task's rows: draw d takes part d % parts of md5('key|d div parts|seed').

    Portable to SQL engines: eight hex digits h are below p exactly if h < ceil(p * 2^32)."""
    least = F.ceil(F.col(p) * F.lit(TWO_POW_32)).cast("bigint")
    rows = df.select(F.col(key).cast("string").alias("_key"), (F.when(least > 1 << 32, 1 << 32).otherwise(least) - 1).alias("_most"),
                     F.coalesce("_cents", F.lit(0)).alias("_cents")).where(F.col("_most") >= 0).repartition(tasks)

    def draw(batches):
        return hits_per_simulation(batches, n_sims, seed, parts)
    return rows.mapInPandas(draw, "sim_id long, _n long, _c long")


def xxhash_uniform(*parts: Column) -> Column:
    """Faster uniform from xxhash64 (JVM-native), for large runs."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def simulate(df: DataFrame, n_sims: int = 2000, seed: int = 42, uniform: str = "md5",
             p: str = "Predicted_Delay_Probability", cost: str = "Shipping_Cost_USD", key: str = "Order_ID") -> DataFrame:
    """H1: one row per simulation: delayed count and exposed cost.  Empty input -> no rows.

    ``uniform``: "md5_each" takes one md5 for every draw, "md5" one for four draws, "xxhash" Spark's own hash.
    Every task sends at most n_sims small rows.
    """
    spark = df.sparkSession
    if n_sims not in ALLOWED_SIMS:
        raise ValueError(f"n_sims must be one of {ALLOWED_SIMS}")
    if uniform not in UNIFORMS:
        raise ValueError(f"uniform must be one of {UNIFORMS}")
    cents = F.round(F.col(cost) * F.lit(100.0)).cast("bigint")
    shipments = df.count()
    if uniform == "xxhash":
        draws = df.select(key, p, cents.alias("_cents"),
                          F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_sims - 1).cast("bigint"))).alias("sim_id"))
        drawn = draws.where(xxhash_uniform(F.col(key), F.col("sim_id"), F.lit(seed)) < F.col(p))
        hits = drawn.groupBy("sim_id").agg(F.count(F.lit(1)).alias("_n"), F.sum("_cents").alias("_c"))
    else:
        tasks = max(spark.sparkContext.defaultParallelism, -(-shipments * n_sims // TASK_DRAWS))
        drawn = md5_hits(df.select(key, p, cents.alias("_cents")), n_sims, seed, p, key, PARTS if uniform == "md5" else 1, tasks)
        hits = drawn.groupBy("sim_id").agg(F.sum("_n").alias("_n"), F.sum("_c").alias("_c"))
    sims = spark.range(n_sims).withColumnRenamed("id", "sim_id")
    if shipments == 0:      # nothing for an empty portfolio
        sims = sims.limit(0)
    # every simulation exists (count 0 when nothing hit); the hit table has <= n_sims rows
    return (sims.join(F.broadcast(hits), "sim_id", "left")
            .select("sim_id", F.coalesce(F.col("_n"), F.lit(0)).alias("delayed_count"),
                    (F.coalesce(F.col("_c"), F.lit(0)).cast("double") / F.lit(100.0)).alias("exposure_usd")))


def expectation(df: DataFrame, p: str = "Predicted_Delay_Probability", cost: str = "Shipping_Cost_USD") -> DataFrame:
    """H2: closed-form expected delayed count and expected exposure."""
    return df.agg(F.sum(p).alias("expected_delayed"), F.sum(F.col(p) * F.col(cost)).alias("expected_exposure_usd"))


def tail_summary(sims: DataFrame) -> DataFrame:
    """H3: p95 count, p95 and p99 exposure (linear interpolation) over the simulations."""
    return exact_quantiles(sims, {"p95_delayed": ("delayed_count", 0.95), "p95_exposure_usd": ("exposure_usd", 0.95),
                                  "p99_exposure_usd": ("exposure_usd", 0.99)})


def histograms(sims: DataFrame, nbins: int = 40) -> DataFrame:
    """H4: 40-bin histograms of delayed count and exposure, with each bin's edges."""
    def one(metric: str) -> DataFrame:
        step = (F.col("hi") - F.col("lo")).cast("double") / nbins
        return histogram_1d(sims, metric, nbins).select(
            F.lit(metric).alias("metric"), "bin", "n", (F.col("lo") + F.col("bin") * step).alias("bin_from"),
            (F.col("lo") + (F.col("bin") + 1) * step).alias("bin_to"))
    return one("delayed_count").unionByName(one("exposure_usd"))


def markers(df: DataFrame, sims: DataFrame) -> DataFrame:
    """H4: the expected and p95 lines of both histograms."""
    e, t = expectation(df), tail_summary(sims)
    rows = F.array(F.struct(F.lit("delayed_count").alias("metric"), F.col("expected_delayed").alias("expected"), F.col("p95_delayed").alias("p95")),
                   F.struct(F.lit("exposure_usd").alias("metric"), F.col("expected_exposure_usd").alias("expected"),
                            F.col("p95_exposure_usd").alias("p95")))
    return e.crossJoin(t).select(F.explode(rows).alias("m")).select("m.*")   # two 1-row results
