"""Landed inputs derived from the driver's tables (FIXTURES.md §2 and §8.6).

The reference fetches weather, routes and geocodes over HTTP.  Here the same
shapes are landed from the given tables so every query's work grows with them:
historical weather per (origin port, order date), port observations from
``events``, and road-leg / geocode payloads from ``customer``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.sources.ports import ports
from keelson.sources.tables import table

# Ports the historical-weather fixture has data for (position i).
WEATHER_PORTS = ["Shenzhen, CN", "Shanghai, CN", "Hamburg, DE", "Tokyo, JP", "Mumbai, IN"]
# Requested ports per landed batch: (batch_id, position, city).  Santos is requested but fails.
WEATHER_REQUESTS = [(0, 0, "Shenzhen, CN"), (0, 1, "Shanghai, CN"), (0, 2, "Hamburg, DE"),
                    (1, 0, "Tokyo, JP"), (2, 0, "Mumbai, IN"), (2, 1, "Santos, BR")]


def historical_weather_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily weather per fixture port and distinct order date (FIXTURES.md historical weather)."""
    d = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("dt")).distinct()
    p = spark.createDataFrame(list(enumerate(WEATHER_PORTS)), "i int, city string")
    g = d.crossJoin(F.broadcast(p)).withColumn(
        "n", F.year("dt") * 372 + F.month("dt") * 31 + F.dayofmonth("dt"))
    n, i = F.col("n"), F.col("i")
    return g.where(n % 11 != 0).select(
        "city", F.col("dt").alias("wx_date"),
        ((n * (i + 3)) % 97).cast("double").alias("real_wind_speed_max_kmh"),
        F.when(n % 13 == 0, F.lit(None).cast("double")).otherwise(((n * (i + 5)) % 131).cast("double"))
        .alias("real_wind_gusts_max_kmh"),
        (((n * (i + 7)) % 53).cast("double") / F.lit(2.0)).alias("real_precipitation_sum_mm"))


def weather_requests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WEATHER_REQUESTS, "batch_id int, pos int, city string")


def historical_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed batched responses (batch_id, payload): list for batches 0 and 2, one object for batch 1."""
    flat = historical_weather_flat(spark, sf_dir)
    per_city = flat.groupBy("city").agg(F.sort_array(F.collect_list(F.struct(
        "wx_date", "real_wind_speed_max_kmh", "real_wind_gusts_max_kmh", "real_precipitation_sum_mm"))).alias("s"))
    daily = F.struct(
        F.coalesce(F.transform("s", lambda x: F.date_format(x["wx_date"], "yyyy-MM-dd")),
                   F.array().cast("array<string>")).alias("time"),
        F.coalesce(F.transform("s", lambda x: x["real_wind_speed_max_kmh"]), F.array().cast("array<double>"))
        .alias("wind_speed_10m_max"),
        F.coalesce(F.transform("s", lambda x: x["real_wind_gusts_max_kmh"]), F.array().cast("array<double>"))
        .alias("wind_gusts_10m_max"),
        F.coalesce(F.transform("s", lambda x: x["real_precipitation_sum_mm"]), F.array().cast("array<double>"))
        .alias("precipitation_sum"))
    req = weather_requests(spark).join(per_city, "city", "left").select(
        "batch_id", "pos", F.struct(daily.alias("daily")).alias("obj"))
    b = req.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("pos", "obj"))).alias("objs"))
    objs = F.transform("objs", lambda x: x["obj"])
    return b.select("batch_id", F.when(F.size(objs) == 1, F.to_json(objs[0])).otherwise(F.to_json(objs))
                    .alias("payload"))


def port_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Port readings from ``events`` (FIXTURES.md port observations) with the port name."""
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    obs = e.select(
        eid, (F.col("user_id") % 31).cast("int").alias("port_idx"), F.col("ts").cast("timestamp").alias("obs_ts"),
        F.when(eid % 23 == 0, F.lit(None).cast("double"))
        .otherwise(F.round(F.col("value") * F.lit(1e2)).cast("bigint").cast("double") / F.lit(6e3))
        .alias("wave_height_m"),
        F.when(eid % 17 == 0, F.lit(None).cast("double")).otherwise((eid % 80).cast("double"))
        .alias("wind_speed_kmh"),
        (F.col("event_type") != "error").alias("ok"))
    return obs.join(F.broadcast(ports(spark).select("port_idx", "port")), "port_idx")


def road_leg_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed road-routing responses, one per customer delivery: (delivery_id, arrival_port, payload)."""
    c = table(spark, sf_dir, "customer")
    k, nk = F.col("c_custkey"), F.col("c_nationkey")
    route = F.struct(((k * 37) % 250000).alias("distanceMeters"),
                     F.concat((nk * 611 + k % 997).cast("string"), F.lit("s")).alias("duration"))
    payload = F.when(k % 13 == 0, F.lit('{"routes": []}')).otherwise(
        F.to_json(F.struct(F.array(route).alias("routes"))))
    names = F.broadcast(ports(spark).select(F.col("port_idx").alias("_pi"), F.col("port").alias("arrival_port")))
    return c.select(k.alias("delivery_id"), (k % 31).cast("int").alias("_pi"), payload.alias("payload")) \
        .join(names, "_pi").drop("_pi")


def geocode_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed geocoding responses per customer address: (address_id, address, payload)."""
    c = table(spark, sf_dir, "customer")
    k, nk = F.col("c_custkey"), F.col("c_nationkey")
    status = (F.when(k % 10 == 0, "ZERO_RESULTS").when(k % 10 == 1, "OVER_QUERY_LIMIT")
              .when(k % 10 == 2, "UNKNOWN_ERROR").otherwise("OK"))
    loc = F.struct(((k % 180) - 90 + F.lit(0.5)).alias("lat"), ((nk * 7) % 360 - 180 + F.lit(0.25)).alias("lng"))
    result = F.struct(F.struct(loc.alias("location")).alias("geometry"), F.col("c_name").alias("formatted_address"))
    payload = F.to_json(F.struct(status.alias("status"),
                                 F.when(status == "OK", F.array(result)).otherwise(F.array()).alias("results")))
    return c.select(k.alias("address_id"), F.col("c_name").alias("address"), payload.alias("payload"))
