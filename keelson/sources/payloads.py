"""Landed API payloads decoded with from_json.

The reference calls HTTP APIs per request; here the responses are landed as
JSON text columns and decoded in bulk with built-in functions.  Positions in a
batched response are matched to the requested ports by array position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAILY_VARS = {"wind_speed_10m_max": "real_wind_speed_max_kmh",
              "wind_gusts_10m_max": "real_wind_gusts_max_kmh",
              "precipitation_sum": "real_precipitation_sum_mm"}
HISTORICAL_SCHEMA = T.StructType([T.StructField("daily", T.StructType(
    [T.StructField("time", T.ArrayType(T.StringType()))]
    + [T.StructField(k, T.ArrayType(T.DoubleType())) for k in DAILY_VARS]))])

MARINE_VARS = {"wave_height": "wave_height_m", "wave_period": "wave_period_s", "swell_wave_height": "swell_height_m"}
WIND_VARS = {"wind_speed_10m": "wind_speed_kmh", "precipitation": "precipitation_mm"}
MARINE_SCHEMA = T.StructType([T.StructField("hourly", T.StructType(
    [T.StructField("time", T.ArrayType(T.StringType()))]
    + [T.StructField(k, T.ArrayType(T.DoubleType())) for k in MARINE_VARS]))])
WIND_SCHEMA = T.StructType([
    T.StructField("hourly", T.StructType([T.StructField(k, T.ArrayType(T.DoubleType())) for k in WIND_VARS])),
    T.StructField("current", T.StructType([T.StructField(k, T.DoubleType()) for k in WIND_VARS]))])

ROAD_SCHEMA = T.StructType([T.StructField("routes", T.ArrayType(T.StructType([
    T.StructField("distanceMeters", T.LongType()), T.StructField("duration", T.StringType())])))])
GEOCODE_SCHEMA = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("results", T.ArrayType(T.StructType([
        T.StructField("geometry", T.StructType([T.StructField("location", T.StructType([
            T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType())]))])),
        T.StructField("formatted_address", T.StringType())])))])

# Error texts.
ERR_PARSE = "Could not parse response for "
ERR_LENGTHS = ": All arrays must be of the same length"
ERR_SHAPE = "Unexpected response shape"
ERR_GEOCODE_SHAPE = "Unexpected geocoding response shape"
ERR_EMPTY_DAILY = "Empty response (no daily data returned)."
ERR_EMPTY_HOURLY = "Empty response from Open-Meteo (no hourly data returned)."
ERR_NO_ROUTE = ("No driving route found between these points (they may not be road-connected — e.g. separated "
                "by water with no bridge/ferry, or one point isn't reachable by road).")
GEOCODE_ERRORS = {
    "ZERO_RESULTS": "No location found for '%s'.",
    "REQUEST_DENIED": "Request denied — check that your API key is valid and the Geocoding API is enabled for it.",
    "OVER_QUERY_LIMIT": "Google Maps quota exceeded for this key.",
    "INVALID_REQUEST": "Invalid geocoding request.",
}


def as_list_json(payload: Column) -> Column:
    """A single JSON object or a list of objects -> always a list."""
    return F.when(F.ltrim(payload).startswith("["), payload).otherwise(F.concat(F.lit("["), payload, F.lit("]")))


def _positions(payloads: DataFrame, requested: DataFrame, schema: T.StructType, key: str = "batch_id") -> DataFrame:
    """One row per requested (batch, position, port) with its decoded object (null when absent)."""
    locs = payloads.select(key, F.posexplode(F.from_json(as_list_json(F.col("payload")), T.ArrayType(schema)))
                           .alias("pos", "loc"))
    return requested.join(locs, [key, "pos"], "left")


def decode_historical(payloads: DataFrame, requested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A3 + A5: (rows, ledger).

    payloads: (batch_id, payload string); requested: (batch_id, pos, city).
    rows: city, wx_date, real_wind_speed_max_kmh, real_wind_gusts_max_kmh, real_precipitation_sum_mm.
    ledger: batch_id, pos, city, ok, error, n_days.  A missing variable gives a null column;
    arrays whose length differs from ``time`` make the port fail (the reference's frame build raises).
    """
    p = _positions(payloads, requested, HISTORICAL_SCHEMA)
    t = F.col("loc.daily.time")
    n = F.coalesce(F.size(t), F.lit(0))
    bad_len = F.lit(False)
    for k in DAILY_VARS:
        a = F.col(f"loc.daily.{k}")
        bad_len = bad_len | (a.isNotNull() & (F.size(a) != n))
    ok = F.col("loc").isNotNull() & (n > 0) & ~bad_len
    err = (F.when(F.col("loc").isNull(), F.concat(F.lit(ERR_PARSE), F.col("city"),
                                                 F.lit(": missing position")))
           .when(n == 0, F.lit(ERR_EMPTY_DAILY))
           .when(bad_len, F.concat(F.lit(ERR_PARSE), F.col("city"),
                                   F.lit(ERR_LENGTHS))))
    p = p.withColumns({"ok": ok, "error": err, "n_days": F.when(ok, n).otherwise(F.lit(0))})
    ledger = p.select("batch_id", "pos", "city", "ok", "error", "n_days")
    filled = [F.coalesce(F.col(f"loc.daily.{k}"), F.array_repeat(F.lit(None).cast("double"), n)).alias(k)
              for k in DAILY_VARS]
    rows = (p.where("ok").select("city", F.explode(F.arrays_zip(t.alias("time"), *filled)).alias("d"))
            .select("city", F.to_date(F.col("d.time")).alias("wx_date"),
                    *[F.col(f"d.{k}").alias(v) for k, v in DAILY_VARS.items()]))
    return rows, ledger


def decode_live(marine: DataFrame, wind: DataFrame, requested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A4 + A5: hourly rows aligned by array position and a per-port ledger with current readings.

    marine, wind: (batch_id, payload); requested: (batch_id, pos, port).
    Any array except wave_height whose length differs from ``time`` becomes all null; an empty
    ``time`` or ``wave_height`` fails the port.  A wrong-length wave_height also fails the port
    (the reference raises there).
    """
    m = _positions(marine, requested, MARINE_SCHEMA).withColumnRenamed("loc", "m")
    w = _positions(wind, requested, WIND_SCHEMA).select("batch_id", "pos", F.col("loc").alias("w"))
    p = m.join(w, ["batch_id", "pos"], "left")
    t = F.col("m.hourly.time")
    n = F.coalesce(F.size(t), F.lit(0))
    wave = F.col("m.hourly.wave_height")
    nw = F.coalesce(F.size(wave), F.lit(0))
    ok = F.col("m").isNotNull() & F.col("w").isNotNull() & (n > 0) & (nw > 0) & (nw == n)
    err = (F.when(F.col("m").isNull() | F.col("w").isNull(),
                  F.concat(F.lit(ERR_PARSE), F.col("port")))
           .when((n == 0) | (nw == 0), F.lit(ERR_EMPTY_HOURLY))
           .when(nw != n, F.concat(F.lit(ERR_PARSE), F.col("port"),
                                   F.lit(": wave_height length differs from time"))))

    def aligned(a: Column) -> Column:
        return F.when(F.size(a) == n, a).otherwise(F.array_repeat(F.lit(None).cast("double"), n))

    arrays = ([wave.alias("wave_height")]
              + [aligned(F.col(f"m.hourly.{k}")).alias(k) for k in MARINE_VARS if k != "wave_height"]
              + [aligned(F.col(f"w.hourly.{k}")).alias(k) for k in WIND_VARS])
    p = p.withColumns({"ok": ok, "error": err})
    ledger = p.select("batch_id", "pos", "port", "ok", "error",
                      F.when(ok, wave[0]).alias("current_wave_height_m"),
                      F.when(ok, F.col("w.current.wind_speed_10m")).alias("current_wind_kmh"),
                      F.when(ok, F.col("w.current.precipitation")).alias("current_precip_mm"))
    rows = (p.where("ok").select("port", F.posexplode(F.arrays_zip(t.alias("time"), *arrays)).alias("hour_no", "h"))
            .select("port", "hour_no", F.to_timestamp(F.col("h.time")).alias("ts"),
                    *[F.col(f"h.{k}").alias(v) for k, v in {**MARINE_VARS, **WIND_VARS}.items()]))
    return rows, ledger


def failure_summary(ledger: DataFrame, name_col: str = "port") -> DataFrame:
    """A5: failed count, sorted failed list, all-failed flag (one row)."""
    return ledger.agg(F.count_if(~F.col("ok")).alias("failed"), F.count(F.lit(1)).alias("requested"),
                      F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col(name_col)))), ", ")
                      .alias("failed_ports"),
                      F.bool_and(~F.col("ok")).alias("all_failed"))


def decode_road_legs(df: DataFrame) -> DataFrame:
    """km = distanceMeters/1000, minutes = seconds in '5024s' / 60, hours = minutes/60; no route -> failed."""
    r = F.from_json(F.col("payload"), ROAD_SCHEMA)["routes"]
    first = F.get(r, 0)
    secs = F.expr("try_cast(rtrim('s', payload_duration) AS double)")
    d = df.withColumns({"_first": first}).withColumn("payload_duration", F.col("_first.duration"))
    ok = F.col("_first").isNotNull() & F.col("_first.distanceMeters").isNotNull() & secs.isNotNull()
    out = d.select(*[c for c in df.columns if c != "payload"], ok.alias("ok"),
                   F.when(F.col("_first").isNull(), F.lit(ERR_NO_ROUTE))
                   .when(~ok, F.lit(ERR_SHAPE)).alias("error"),
                   F.when(ok, F.col("_first.distanceMeters") / F.lit(1000.0)).alias("distance_km"),
                   F.when(ok, secs / F.lit(60.0)).alias("duration_minutes"))
    return out.withColumn("duration_hours", F.col("duration_minutes") / F.lit(60.0))


def decode_geocode(df: DataFrame, address_col: str = "address") -> DataFrame:
    """First result's lat/lng/formatted address; status -> message map, default 'Geocoding failed: <status>'."""
    g = F.from_json(F.col("payload"), GEOCODE_SCHEMA)
    first = F.get(g["results"], 0)
    status = g["status"]
    msg = F.concat(F.lit("Geocoding failed: "), F.coalesce(status, F.lit("None")))
    for k, v in GEOCODE_ERRORS.items():
        text = F.format_string(v, F.col(address_col)) if "%s" in v else F.lit(v)
        msg = F.when(status == k, text).otherwise(msg)
    ok_status = status == "OK"
    ok = ok_status & first.isNotNull() & first["geometry"]["location"]["lat"].isNotNull()
    err = (F.when(~F.coalesce(ok_status, F.lit(False)), msg)
           .when(~ok, F.lit(ERR_GEOCODE_SHAPE)))
    return df.select(*[c for c in df.columns if c != "payload"], F.coalesce(ok, F.lit(False)).alias("ok"),
                     err.alias("error"),
                     F.when(ok, first["geometry"]["location"]["lat"]).alias("lat"),
                     F.when(ok, first["geometry"]["location"]["lng"]).alias("lon"),
                     F.when(ok, F.coalesce(first["formatted_address"], F.col(address_col))).alias("formatted_address"))
