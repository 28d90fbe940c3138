"""Port conditions in batch (P1-P5, P7 and the batch twins of P6, P8).

Readings are first reduced to one per (port, hour bucket) by aggregation
(partial aggregation absorbs hot ports); the per-port hourly series is then
bounded by the hours in the time range, so the first-72-rows window stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.operators.scoring import round_half_even

# Wave (m) / wind (km/h) thresholds, labels and colours.
ROUGH_WAVE, ROUGH_WIND = 4.0, 62.0
MODERATE_WAVE, MODERATE_WIND = 2.5, 39.0
LEVEL_UNKNOWN, LEVEL_ROUGH, LEVEL_MODERATE, LEVEL_CALM = "Unknown", "Rough — Elevated Risk", "Moderate", "Calm"
LEVEL_COLORS = {LEVEL_UNKNOWN: "#8b93a7", LEVEL_ROUGH: "#ef4444", LEVEL_MODERATE: "#f5b942", LEVEL_CALM: "#2dd4bf"}
PEAK_WINDOW_ROWS = 72


def condition_level(wave: Column, wind: Column) -> Column:
    """Wave null -> Unknown; wave >= 4 or wind >= 62 Rough; >= 2.5 or >= 39 Moderate; else Calm."""
    return (F.when(wave.isNull(), LEVEL_UNKNOWN)
            .when((wave >= ROUGH_WAVE) | F.coalesce(wind >= ROUGH_WIND, F.lit(False)), LEVEL_ROUGH)
            .when((wave >= MODERATE_WAVE) | F.coalesce(wind >= MODERATE_WIND, F.lit(False)), LEVEL_MODERATE)
            .otherwise(LEVEL_CALM))


def implied_severity(wave: Column, wind: Column) -> Column:
    """least(10, round(1.8 * wave + wind / 15, 1)); nulls count as 0."""
    raw = F.coalesce(wave, F.lit(0.0)) * F.lit(1.8) + F.coalesce(wind, F.lit(0.0)) / F.lit(15.0)
    return F.least(F.lit(10.0), round_half_even(raw, 1))


def hourly_readings(obs: DataFrame) -> DataFrame:
    """P7 (batch) + P5: one reading per (port, hour bucket): the first by (obs_ts, event_id)."""
    first = F.min(F.struct("obs_ts", "event_id", "wave_height_m", "wind_speed_kmh"))
    return (obs.where("ok").withColumn("hour", F.date_trunc("hour", "obs_ts"))
            .groupBy("port_idx", "port", "hour").agg(first.alias("f"))
            .select("port_idx", "port", "hour", F.col("f.event_id").alias("event_id"),
                    F.col("f.wave_height_m").alias("wave_height_m"), F.col("f.wind_speed_kmh").alias("wind_speed_kmh")))


def port_conditions(obs: DataFrame, ports: DataFrame) -> DataFrame:
    """P1-P4 for every port: current (first-hour) wave and wind, 72-row peaks, level, implied severity."""
    h = hourly_readings(obs).withColumn("rn", F.row_number().over(Window.partitionBy("port_idx").orderBy("hour")))
    agg = h.groupBy("port_idx").agg(
        F.count(F.lit(1)).alias("n_hours"),
        F.min(F.struct("rn", "wave_height_m", "wind_speed_kmh")).alias("cur"),
        F.max(F.when(F.col("rn") <= PEAK_WINDOW_ROWS, F.col("wave_height_m"))).alias("peak_wave_72h_m"),
        F.max(F.when(F.col("rn") <= PEAK_WINDOW_ROWS, F.col("wind_speed_kmh"))).alias("peak_wind_72h_kmh"))
    j = ports.select("port_idx", "port").join(agg, "port_idx", "left")
    ok = F.coalesce(F.col("n_hours"), F.lit(0)) > 0
    wave, wind = F.col("cur.wave_height_m"), F.col("cur.wind_speed_kmh")
    return j.select("port_idx", "port", ok.alias("ok"), F.coalesce(F.col("n_hours"), F.lit(0)).alias("n_hours"),
                    wave.alias("current_wave_height_m"), wind.alias("current_wind_kmh"),
                    "peak_wave_72h_m", "peak_wind_72h_kmh",
                    F.when(ok, condition_level(wave, wind)).alias("level"),
                    F.when(ok, implied_severity(wave, wind)).alias("implied_severity"))


def conditions_of_responses(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """P1-P4 from decoded responses: the ledger's separate current reading (wind, precipitation and first wave
    height), peaks over the first 72 hourly rows; a failed port has neither."""
    first = F.col("hour_no") < PEAK_WINDOW_ROWS
    peaks = rows.where(first).groupBy(F.col("port").alias("_p")).agg(
        F.max("wave_height_m").alias("peak_wave_72h_m"), F.max("wind_speed_kmh").alias("peak_wind_72h_kmh"))
    wave, wind = F.col("current_wave_height_m"), F.col("current_wind_kmh")
    return ledger.join(peaks, F.col("port") == F.col("_p"), "left").select(
        "port", "ok", wave, wind, "current_precip_mm", "peak_wave_72h_m", "peak_wind_72h_kmh",
        F.when(F.col("ok"), condition_level(wave, wind)).alias("level"), F.when(F.col("ok"), implied_severity(wave, wind)).alias("implied_severity"))


def window_stats(obs: DataFrame, interval: str = "10 minutes") -> DataFrame:
    """P6 (batch twin): per port and tumbling window, count and first/latest/max readings."""
    return (obs.where("ok").groupBy("port", F.window("obs_ts", interval).alias("w"))
            .agg(F.count(F.lit(1)).alias("readings"),
                 F.min(F.struct("obs_ts", "event_id", "wave_height_m")).alias("first"),
                 F.max(F.struct("obs_ts", "event_id", "wave_height_m")).alias("latest"),
                 F.max("wave_height_m").alias("max_wave_height_m"), F.max("wind_speed_kmh").alias("max_wind_kmh"))
            .select("port", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "readings",
                    F.col("first.wave_height_m").alias("first_wave_height_m"),
                    F.col("latest.wave_height_m").alias("latest_wave_height_m"),
                    "max_wave_height_m", "max_wind_kmh"))


def alerts(obs: DataFrame, port_stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P8 (batch twin): level + severity per good reading, enriched with the port's historical stats;
    failed readings go to a side table."""
    stats = F.broadcast(port_stats.select("port", "origin_shipments", "origin_delay_pct", "destination_shipments",
                                          "destination_delay_pct"))
    good = obs.where("ok").join(stats, "port", "left").select(
        "event_id", "port", "obs_ts", "wave_height_m", "wind_speed_kmh",
        condition_level(F.col("wave_height_m"), F.col("wind_speed_kmh")).alias("level"),
        implied_severity(F.col("wave_height_m"), F.col("wind_speed_kmh")).alias("implied_severity"),
        "origin_shipments", "origin_delay_pct", "destination_shipments", "destination_delay_pct")
    failed = obs.where(~F.col("ok")).select("event_id", "port", "obs_ts")
    return good, failed
