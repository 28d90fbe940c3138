"""Registered queries over landed response files (A3-A5, A7, A8, P1 with a separate current reading).

The files are derived from the given tables and landed once a session: lists and single objects, arrays of the wrong length, missing
positions, and broken files and lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.operators import conditions as cond
from keelson.plans import scored as sc
from keelson.plans.catalog_landed import _LEVEL, _SEV, OBS_SQL, WX_FLAT_SQL, _obs
from keelson.plans.oracle import with_ctes
from keelson.plans.registry import REGISTRY, register
from keelson.sources import landing, payloads
from keelson.sources import payload_files as files
from keelson.sources.ports import ports as port_dim

_FOLDERS: dict[tuple[str, str, str], str] = {}
#: ports asked in one request, the port asked alone, and the batch whose wind file is cut short
PORTS_A_BATCH, LONE_PORT, BROKEN_BATCH = 4, 30, 5
#: one port's wave heights, and every seventh port's swell heights, lack their last hour
SHORT_WAVES_PORT, SHORT_SWELL_MOD = 11, 3
#: a weather response that is cut short: (batch_id, pos, city)
BROKEN_WEATHER = (3, 0, "Santos, BR")
BROKEN_LINE_MOD = 50   # of 101 customers one has a line that is cut short


def _landed(spark: SparkSession, sf: str, name: str, write) -> str:
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _FOLDERS:
        _FOLDERS[key] = write(files.landing_folder(spark, name))
    return _FOLDERS[key]


def _cut_short(text: Column, broken: Column) -> Column:
    return F.when(broken, F.substr(text, F.lit(1), F.length(text) - 5)).otherwise(text)


# ---------------------------------------------------------------- A4: live batches
def _live_requests(spark: SparkSession) -> DataFrame:
    lone = F.col("port_idx") == LONE_PORT
    return port_dim(spark).select(
        F.when(lone, LONE_PORT // PORTS_A_BATCH + 1).otherwise(F.floor(F.col("port_idx") / PORTS_A_BATCH)).cast("int").alias("batch_id"),
        F.when(lone, 0).otherwise(F.col("port_idx") % PORTS_A_BATCH).cast("int").alias("pos"), "port", "port_idx")


def _responses(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """(batch_id, payload): marine or wind responses for batches of ports, from the hourly series."""
    h = cond.hourly_readings(_obs(spark, sf))
    e = F.col("event_id")
    h = h.select("port_idx", F.struct(
        "hour", "wave_height_m", "wind_speed_kmh", ((e % 13).cast("double") / 2.0 + 3.0).alias("period"), ((e % 40).cast("double") / 10.0).alias("swell"),
        ((e % 29).cast("double") / 4.0).alias("precip")).alias("x"))
    series = h.groupBy("port_idx").agg(F.sort_array(F.collect_list("x")).alias("s"))   # a port's hours
    rows = _live_requests(spark).join(series, "port_idx", "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<hour:timestamp,"
        "wave_height_m:double,wind_speed_kmh:double,period:double,swell:double,precip:double>>")))

    def values(field: str, short: Column | None = None) -> Column:
        every = F.transform("s", lambda x: x[field])
        return every if short is None else F.when(short & (F.size(every) > 0), F.slice(every, F.lit(1), F.greatest(F.size(every) - 1, F.lit(0)))).otherwise(every)
    if kind == "marine":
        hourly = F.struct(F.transform("s", lambda x: F.date_format(x["hour"], "yyyy-MM-dd'T'HH:mm")).alias("time"),
                          values("wave_height_m", F.col("port_idx") == SHORT_WAVES_PORT).alias("wave_height"), values("period").alias("wave_period"),
                          values("swell", F.col("port_idx") % 7 == SHORT_SWELL_MOD).alias("swell_wave_height"))
        obj = F.struct(hourly.alias("hourly"))
    else:
        last = F.get(F.reverse("s"), F.lit(0))   # the current reading is the latest, not the first of the series
        current = F.struct(last["wind_speed_kmh"].alias("wind_speed_10m"), last["precip"].alias("precipitation"))
        obj = F.struct(F.struct(values("wind_speed_kmh").alias("wind_speed_10m"), values("precip").alias("precipitation")).alias("hourly"), current.alias("current"))
    batches = rows.select("batch_id", F.struct("pos", obj.alias("obj")).alias("o")).groupBy("batch_id").agg(F.sort_array(F.collect_list("o")).alias("o"))
    objs = F.transform("o", lambda x: x["obj"])
    text = F.when(F.size(objs) == 1, F.to_json(F.get(objs, F.lit(0)))).otherwise(F.to_json(objs))
    broken = (F.col("batch_id") == BROKEN_BATCH) & F.lit(kind == "wind")
    return batches.select("batch_id", _cut_short(text, broken).alias("payload"))


def _live_files(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return files.scan_batches(spark, _landed(spark, sf, f"live-{kind}", lambda folder: files.land_batches(_responses(spark, sf, kind), folder)))


def _live(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    asked = _live_requests(spark).drop("port_idx")
    return payloads.decode_live(_live_files(spark, sf, "marine"), _live_files(spark, sf, "wind"), asked)


_LIVE_SQL = OBS_SQL + f""",
lreq AS (SELECT port_idx, port, CASE WHEN port_idx = {LONE_PORT} THEN {LONE_PORT // PORTS_A_BATCH + 1} ELSE port_idx // {PORTS_A_BATCH} END AS batch_id,
  CASE WHEN port_idx = {LONE_PORT} THEN 0 ELSE port_idx % {PORTS_A_BATCH} END AS pos FROM ports_dim),
lcount AS (SELECT r.*, COALESCE(c.n, 0) AS n, COALESCE(c.n, 0) - CASE WHEN r.port_idx = {SHORT_WAVES_PORT} AND COALESCE(c.n, 0) > 0 THEN 1 ELSE 0 END AS nw
  FROM lreq r LEFT JOIN (SELECT port_idx, COUNT(*) AS n FROM hseries GROUP BY 1) c ON r.port_idx = c.port_idx),
lerr AS (SELECT *, CASE WHEN batch_id = {BROKEN_BATCH} THEN '{payloads.ERR_PARSE}' || port WHEN n = 0 OR nw = 0 THEN '{payloads.ERR_EMPTY_HOURLY}'
  WHEN nw <> n THEN '{payloads.ERR_PARSE}' || port || ': wave_height length differs from time' END AS error FROM lcount),
llast AS (SELECT port_idx, wind_speed_kmh, CAST(event_id % 29 AS DOUBLE) / 4e0 AS precip FROM
  (SELECT hseries.*, row_number() OVER (PARTITION BY port_idx ORDER BY hour DESC) AS back FROM hseries) WHERE back = 1)"""


@register("landed_live_rows", with_ctes(
    _LIVE_SQL + " SELECT h.port, CAST(rn - 1 AS INTEGER) AS hour_no, strftime(hour, '%Y-%m-%d %H:%M:%S') AS ts, wave_height_m,"
    " CAST(event_id % 13 AS DOUBLE) / 2e0 + 3e0 AS wave_period_s,"
    f" CASE WHEN h.port_idx % 7 <> {SHORT_SWELL_MOD} THEN CAST(event_id % 40 AS DOUBLE) / 1e1 END AS swell_height_m,"
    " wind_speed_kmh, CAST(event_id % 29 AS DOUBLE) / 4e0 AS precipitation_mm"
    " FROM hseries h JOIN lerr ON h.port_idx = lerr.port_idx WHERE error IS NULL", "scored"))
def q_landed_rows(spark, sf):
    """A4: hourly rows of the scanned marine and wind files."""
    return _live(spark, sf)[0].withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@register("landed_live_ledger", with_ctes(
    _LIVE_SQL + " SELECT CAST(batch_id AS INTEGER) AS batch_id, CAST(pos AS INTEGER) AS pos, e.port, error IS NULL AS ok, error,"
    " CASE WHEN error IS NULL THEN h.wave_height_m END AS current_wave_height_m,"
    " CASE WHEN error IS NULL THEN l.wind_speed_kmh END AS current_wind_kmh, CASE WHEN error IS NULL THEN l.precip END AS current_precip_mm"
    " FROM lerr e LEFT JOIN (SELECT * FROM hseries WHERE rn = 1) h ON e.port_idx = h.port_idx LEFT JOIN llast l ON e.port_idx = l.port_idx", "scored"))
def q_landed_ledger(spark, sf):
    """A5: every requested port, with its error or its current reading."""
    return _live(spark, sf)[1]


@register("landed_file_ledger", with_ctes(
    _LIVE_SQL + ", k AS (SELECT 'marine' AS kind UNION ALL SELECT 'wind') SELECT kind, CAST(batch_id AS INTEGER) AS batch_id,"
    f" NOT (kind = 'wind' AND batch_id = {BROKEN_BATCH}) AS ok, CAST(CASE WHEN kind = 'wind' AND batch_id = {BROKEN_BATCH} THEN 0 ELSE COUNT(*) END AS INTEGER)"
    f" AS n_objects, CASE WHEN kind = 'wind' AND batch_id = {BROKEN_BATCH} THEN '{files.ERR_BROKEN_FILE}' END AS error"
    " FROM lreq CROSS JOIN k GROUP BY kind, batch_id", "scored"))
def q_file_ledger(spark, sf):
    """A5: every landed file; the broken one is a row."""
    both = [files.file_ledger(_live_files(spark, sf, kind), kind, schema) for kind, schema in (("marine", payloads.MARINE_SCHEMA), ("wind", payloads.WIND_SCHEMA))]
    return both[0].unionAll(both[1]).drop("path")


@register("landed_port_conditions", with_ctes(
    _LIVE_SQL + ", peak AS (SELECT port_idx, MAX(CASE WHEN rn <= 72 THEN wave_height_m END) AS pw, MAX(CASE WHEN rn <= 72 THEN wind_speed_kmh END) AS pv"
    " FROM hseries GROUP BY 1), lcond AS (SELECT e.port_idx, e.port, error IS NULL AS ok, h.wave_height_m AS cw, l.wind_speed_kmh AS cv, l.precip AS cp, pw, pv"
    " FROM lerr e LEFT JOIN (SELECT * FROM hseries WHERE rn = 1) h ON e.port_idx = h.port_idx LEFT JOIN llast l ON e.port_idx = l.port_idx"
    " LEFT JOIN peak p ON e.port_idx = p.port_idx)"
    " SELECT port, ok, CASE WHEN ok THEN cw END AS current_wave_height_m, CASE WHEN ok THEN cv END AS current_wind_kmh,"
    " CASE WHEN ok THEN cp END AS current_precip_mm, CASE WHEN ok THEN pw END AS peak_wave_72h_m, CASE WHEN ok THEN pv END AS peak_wind_72h_kmh,"
    " CASE WHEN ok THEN " + _LEVEL.format(w="cw", v="cv") + " END AS level, CASE WHEN ok THEN " + _SEV.format(w="cw", v="cv") + " END AS implied_severity FROM lcond",
    "scored"))
def q_landed_conditions(spark, sf):
    """The current reading is the response's own, the peaks are of the first 72 hourly rows."""
    rows, ledger = _live(spark, sf)
    return cond.conditions_of_responses(rows, ledger)


# ---------------------------------------------------------------- A3: historical weather batches
def _weather_requests(spark: SparkSession) -> DataFrame:
    return landing.weather_requests(spark).unionAll(spark.createDataFrame([BROKEN_WEATHER], "batch_id int, pos int, city string"))


def _weather_files(spark: SparkSession, sf: str) -> DataFrame:
    def write(folder: str) -> str:
        good = landing.historical_payloads(spark, sf)
        broken = good.where("batch_id = 1").select(F.lit(BROKEN_WEATHER[0]).alias("batch_id"), _cut_short(F.col("payload"), F.lit(True)).alias("payload"))
        return files.land_batches(good.unionAll(broken), folder)
    return files.scan_batches(spark, _landed(spark, sf, "weather", write))


@register("landed_weather_rows", REGISTRY["historical_weather_rows"][1])
def q_landed_weather(spark, sf):
    """A3: daily rows of the scanned files."""
    rows, _ = payloads.decode_historical(_weather_files(spark, sf), _weather_requests(spark))
    return rows.withColumn("wx_date", F.date_format("wx_date", "yyyy-MM-dd"))


@register("landed_weather_ledger", with_ctes(
    WX_FLAT_SQL + f" SELECT * FROM wledger UNION ALL SELECT {BROKEN_WEATHER[0]}, {BROKEN_WEATHER[1]}, '{BROKEN_WEATHER[2]}', false,"
    f" '{payloads.ERR_PARSE}{BROKEN_WEATHER[2]}: missing position', 0", "features"))
def q_landed_weather_ledger(spark, sf):
    """A5: every requested city; the one in the broken file failed."""
    return payloads.decode_historical(_weather_files(spark, sf), _weather_requests(spark))[1]


# ---------------------------------------------------------------- A7, A8: lines of road legs and geocodes
def _lines(spark: SparkSession, sf: str, name: str, responses: DataFrame, key: str) -> DataFrame:
    envelope = F.to_json(F.struct(key, "payload"))
    lines = responses.select(_cut_short(envelope, F.col(key) % 101 == BROKEN_LINE_MOD).alias("value"))
    return files.scan_lines(spark, _landed(spark, sf, name, lambda folder: files.land_lines(lines, folder)), key)


def _road_lines(spark, sf):
    return _lines(spark, sf, "road", landing.road_leg_payloads(spark, sf), "delivery_id")


@register("landed_road_legs", REGISTRY["road_legs"][1].replace(
    "c_custkey % 13 <> 0", f"(c_custkey % 13 <> 0 AND c_custkey % 101 <> {BROKEN_LINE_MOD})").replace(
    "CASE WHEN c_custkey % 13 = 0 THEN", f"CASE WHEN c_custkey % 101 = {BROKEN_LINE_MOD} THEN '{payloads.ERR_PARSE}delivery ' || c_custkey WHEN c_custkey % 13 = 0 THEN"))
def q_landed_road(spark, sf):
    """Every delivery's road leg from the scanned lines; one whose line is broken has failed."""
    lines = _road_lines(spark, sf)
    asked = landing.road_leg_payloads(spark, sf).drop("payload")
    legs = payloads.decode_road_legs(files.answered(asked, lines, "delivery_id", '{"routes": []}'))
    error = F.when(~F.col("answered"), F.concat(F.lit(payloads.ERR_PARSE + "delivery "), F.col("delivery_id").cast("string"))).otherwise(F.col("error"))
    return legs.withColumn("error", error).drop("answered")


@register("landed_line_ledger", f"SELECT COUNT(*) AS lines, COUNT(*) FILTER (WHERE c_custkey % 101 = {BROKEN_LINE_MOD}) AS corrupt FROM customer")
def q_line_ledger(spark, sf):
    """A5: how many landed lines could not be read."""
    return files.line_ledger(_road_lines(spark, sf), "delivery_id")


@register("landed_geocodes", REGISTRY["geocodes"][1].replace(
    "status = 'OK' AS ok", f"status = 'OK' AND c_custkey % 101 <> {BROKEN_LINE_MOD} AS ok").replace(
    "CASE WHEN status <> 'OK' THEN", f"CASE WHEN c_custkey % 101 = {BROKEN_LINE_MOD} THEN '{payloads.ERR_PARSE}address ' || c_custkey WHEN status <> 'OK' THEN").replace(
    "CASE WHEN status = 'OK' THEN", f"CASE WHEN status = 'OK' AND c_custkey % 101 <> {BROKEN_LINE_MOD} THEN"))
def q_landed_geocodes(spark, sf):
    """Every address from the scanned lines."""
    responses = landing.geocode_payloads(spark, sf)
    lines = _lines(spark, sf, "geocode", responses, "address_id")
    found = payloads.decode_geocode(files.answered(responses.drop("payload"), lines, "address_id", "{}"))
    error = F.when(~F.col("answered"), F.concat(F.lit(payloads.ERR_PARSE + "address "), F.col("address_id").cast("string"))).otherwise(F.col("error"))
    return found.withColumn("error", error).drop("answered")
