"""Registered queries over landed inputs: historical weather (A3-A5, W1-W4), port
observations (P1-P8 batch twins, A4), road legs and geocodes (A7, A8), exposure (H1-H4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.operators import conditions as cond
from keelson.operators import exposure as ex
from keelson.operators import portfolio as pf
from keelson.operators import weather as wx
from keelson.operators.count_distribution import delayed_count_summary, probability_groups
from keelson.plans import scored as sc
from keelson.plans.catalog import FACET_SQL, FACETS, _bin_sql
from keelson.plans.oracle import with_ctes
from keelson.plans.registry import register
from keelson.sources import landing, payloads
from keelson.sources.ports import ports as port_dim
from keelson.sources.ports import ports_values_sql

WX_FLAT_SQL = """,
wd AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS dt FROM orders),
wp AS (SELECT 0 AS i, 'Shenzhen, CN' AS city UNION ALL SELECT 1, 'Shanghai, CN' UNION ALL SELECT 2, 'Hamburg, DE'
      UNION ALL SELECT 3, 'Tokyo, JP' UNION ALL SELECT 4, 'Mumbai, IN'),
wg AS (SELECT city, i, dt, YEAR(dt) * 372 + MONTH(dt) * 31 + DAY(dt) AS n FROM wd CROSS JOIN wp),
wx AS (
SELECT city, dt AS wx_date, CAST((n * (i + 3)) % 97 AS DOUBLE) AS real_wind_speed_max_kmh,
  CASE WHEN n % 13 = 0 THEN NULL ELSE CAST((n * (i + 5)) % 131 AS DOUBLE) END AS real_wind_gusts_max_kmh,
  CAST((n * (i + 7)) % 53 AS DOUBLE) / 2e0 AS real_precipitation_sum_mm
FROM wg WHERE n % 11 <> 0),
wreq AS (SELECT * FROM (VALUES """ + ", ".join(f"({b}, {p}, '{c}')" for b, p, c in landing.WEATHER_REQUESTS) + \
    """) AS t(batch_id, pos, city)),
wledger AS (
  SELECT r.batch_id, r.pos, r.city, COALESCE(c.n, 0) > 0 AS ok,
    CASE WHEN COALESCE(c.n, 0) = 0 THEN '""" + payloads.ERR_EMPTY_DAILY + """' END AS error,
    CAST(COALESCE(c.n, 0) AS INTEGER) AS n_days
  FROM wreq r LEFT JOIN (SELECT city, COUNT(*) AS n FROM wx GROUP BY city) c ON r.city = c.city),
wmerged AS (
  SELECT f.Order_ID, f.Origin_City, f.Order_Date, f.Is_Delayed, f.Weather_Severity_Index,
    w.real_wind_speed_max_kmh, w.real_wind_gusts_max_kmh, w.real_precipitation_sum_mm
  FROM features f LEFT JOIN wx w ON f.Origin_City = w.city AND f.Order_Date = w.wx_date
  WHERE f.Origin_City IN (SELECT city FROM wreq)),
wcorr AS (
  SELECT * FROM (VALUES (0, '""" + wx.SYNTHETIC_LABEL + """'), """ + ", ".join(
    f"({i + 1}, '{lab}')" for i, lab in enumerate(wx.REAL_LABELS.values())) + """) AS t(ord, feature)),
wstats AS (
  SELECT corr(Weather_Severity_Index, CAST(Is_Delayed AS DOUBLE)) AS r0, COUNT(Weather_Severity_Index) AS n0,
    corr(real_wind_speed_max_kmh, CAST(Is_Delayed AS DOUBLE)) AS r1, COUNT(real_wind_speed_max_kmh) AS n1,
    corr(real_wind_gusts_max_kmh, CAST(Is_Delayed AS DOUBLE)) AS r2, COUNT(real_wind_gusts_max_kmh) AS n2,
    corr(real_precipitation_sum_mm, CAST(Is_Delayed AS DOUBLE)) AS r3, COUNT(real_precipitation_sum_mm) AS n3
  FROM wmerged),
wtable AS (
  SELECT c.ord, c.feature,
    ROUND(CASE c.ord WHEN 0 THEN r0 WHEN 1 THEN r1 WHEN 2 THEN r2 ELSE r3 END, 8) AS correlation_with_delay,
    CASE c.ord WHEN 0 THEN n0 WHEN 1 THEN n1 WHEN 2 THEN n2 ELSE n3 END AS n_shipments
  FROM wcorr c CROSS JOIN wstats)"""


def _wx_rows_ledger(spark, sf):
    return payloads.decode_historical(landing.historical_payloads(spark, sf), landing.weather_requests(spark))


def _wx_merged(spark, sf):
    rows, _ = _wx_rows_ledger(spark, sf)
    f = sc.featured(spark, sf).select("Order_ID", "Origin_City", "Order_Date", "Is_Delayed", "Weather_Severity_Index")
    return wx.merge_weather(f, rows, landing.weather_requests(spark))


@register("historical_weather_rows", with_ctes(
    WX_FLAT_SQL + " SELECT * REPLACE (strftime(wx_date, '%Y-%m-%d') AS wx_date) FROM wx", "features"))
def q_wx_rows(spark, sf):
    return _wx_rows_ledger(spark, sf)[0].withColumn("wx_date", F.date_format("wx_date", "yyyy-MM-dd"))


@register("weather_fetch_ledger", with_ctes(WX_FLAT_SQL + " SELECT * FROM wledger", "features"))
def q_wx_ledger(spark, sf):
    return _wx_rows_ledger(spark, sf)[1]


@register("weather_fetch_failures", with_ctes(
    WX_FLAT_SQL + " SELECT COUNT(*) FILTER (WHERE NOT ok) AS failed, COUNT(*) AS requested,"
    " COALESCE(array_to_string(list_sort(list(city) FILTER (WHERE NOT ok)), ', '), '') AS failed_ports,"
    " bool_and(NOT ok) AS all_failed FROM wledger", "features"))
def q_wx_failures(spark, sf):
    return payloads.failure_summary(_wx_rows_ledger(spark, sf)[1], "city")


@register("order_date_ranges", with_ctes(
    ", r AS (SELECT 'ALL' AS scope, MIN(Order_Date) AS min_date, MAX(Order_Date) AS max_date FROM features"
    " UNION ALL SELECT Origin_City, MIN(Order_Date), MAX(Order_Date) FROM features GROUP BY Origin_City)"
    " SELECT scope, strftime(min_date, '%Y-%m-%d') AS min_date, strftime(max_date, '%Y-%m-%d') AS max_date FROM r",
    "features"))
def q_date_ranges(spark, sf):
    return wx.order_date_ranges(sc.featured(spark, sf)).withColumns({
        "min_date": F.date_format("min_date", "yyyy-MM-dd"), "max_date": F.date_format("max_date", "yyyy-MM-dd")})


@register("weather_join", with_ctes(
    WX_FLAT_SQL + " SELECT * REPLACE (strftime(Order_Date, '%Y-%m-%d') AS Order_Date) FROM wmerged", "features"))
def q_wx_join(spark, sf):
    return _wx_merged(spark, sf).withColumn("Order_Date", F.date_format("Order_Date", "yyyy-MM-dd"))


@register("weather_correlation", with_ctes(WX_FLAT_SQL + " SELECT * FROM wtable", "features"))
def q_wx_corr(spark, sf):
    return wx.weather_correlation(_wx_merged(spark, sf))


@register("weather_verdict", with_ctes(
    WX_FLAT_SQL + ", m AS (SELECT MAX(abs(correlation_with_delay)) AS max_real_abs_r FROM wtable WHERE ord > 0)"
    " SELECT max_real_abs_r, CASE WHEN max_real_abs_r < 0.03 THEN 'no signal'"
    " WHEN max_real_abs_r IS NOT NULL THEN 'stronger signal' END AS verdict FROM m", "features"))
def q_wx_verdict(spark, sf):
    return wx.weather_verdict(wx.weather_correlation(_wx_merged(spark, sf)))


# ---------------------------------------------------------------- P: port conditions (batch twins)
OBS_SQL = """,
obs AS (
  SELECT e.event_id, CAST(e.user_id % 31 AS INTEGER) AS port_idx, CAST(e.ts AS TIMESTAMP) AS obs_ts,
    CASE WHEN e.event_id % 23 = 0 THEN NULL
         ELSE CAST(CAST(ROUND(e.value * 1e2) AS BIGINT) AS DOUBLE) / 6e3 END AS wave_height_m,
    CASE WHEN e.event_id % 17 = 0 THEN NULL ELSE CAST(e.event_id % 80 AS DOUBLE) END AS wind_speed_kmh,
    e.event_type <> 'error' AS ok, p.port
  FROM events e JOIN ports_dim p ON CAST(e.user_id % 31 AS INTEGER) = p.port_idx),
hourly AS (
  SELECT port_idx, port, hour, event_id, wave_height_m, wind_speed_kmh FROM (
    SELECT obs.*, date_trunc('hour', obs_ts) AS hour,
      row_number() OVER (PARTITION BY port_idx, date_trunc('hour', obs_ts) ORDER BY obs_ts, event_id) AS rn
    FROM obs WHERE ok) WHERE rn = 1),
hseries AS (SELECT hourly.*, row_number() OVER (PARTITION BY port_idx ORDER BY hour) AS rn FROM hourly)"""

_LEVEL = ("CASE WHEN {w} IS NULL THEN 'Unknown'"
          " WHEN {w} >= 4.0e0 OR COALESCE({v} >= 62e0, false) THEN '" + cond.LEVEL_ROUGH + "'"
          " WHEN {w} >= 2.5e0 OR COALESCE({v} >= 39e0, false) THEN 'Moderate' ELSE 'Calm' END")
_SEV = "LEAST(10e0, round_even((COALESCE({w}, 0e0) * 1.8e0 + COALESCE({v}, 0e0) / 15e0) * 1e1, 0) / 1e1)"


def _obs(spark, sf):
    return sc._memo(spark, sf, "observations", lambda: landing.port_observations(spark, sf))


@register("port_hourly_series", with_ctes(
    OBS_SQL + " SELECT port_idx, port, strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, event_id, wave_height_m,"
    " wind_speed_kmh FROM hourly", "scored"))
def q_hourly(spark, sf):
    return cond.hourly_readings(_obs(spark, sf)).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm:ss"))


@register("port_conditions", with_ctes(
    OBS_SQL + ", agg AS (SELECT port_idx, COUNT(*) AS n_hours,"
    " MAX(CASE WHEN rn = 1 THEN wave_height_m END) AS cw, MAX(CASE WHEN rn = 1 THEN wind_speed_kmh END) AS cv,"
    " MAX(CASE WHEN rn <= 72 THEN wave_height_m END) AS peak_wave_72h_m,"
    " MAX(CASE WHEN rn <= 72 THEN wind_speed_kmh END) AS peak_wind_72h_kmh FROM hseries GROUP BY port_idx)"
    " SELECT p.port_idx, p.port, COALESCE(a.n_hours, 0) > 0 AS ok, COALESCE(a.n_hours, 0) AS n_hours,"
    " a.cw AS current_wave_height_m, a.cv AS current_wind_kmh, a.peak_wave_72h_m, a.peak_wind_72h_kmh,"
    " CASE WHEN COALESCE(a.n_hours, 0) > 0 THEN " + _LEVEL.format(w="a.cw", v="a.cv") + " END AS level,"
    " CASE WHEN COALESCE(a.n_hours, 0) > 0 THEN " + _SEV.format(w="a.cw", v="a.cv") + " END AS implied_severity"
    " FROM ports_dim p LEFT JOIN agg a ON p.port_idx = a.port_idx", "scored"))
def q_conditions(spark, sf):
    return cond.port_conditions(_obs(spark, sf), port_dim(spark))


@register("port_window_stats", with_ctes(
    OBS_SQL + ", wb AS (SELECT obs.*, time_bucket(INTERVAL '10 minutes', obs_ts) AS ws FROM obs WHERE ok),"
    " ranked AS (SELECT wb.*, row_number() OVER (PARTITION BY port, ws ORDER BY obs_ts, event_id) AS r1,"
    " row_number() OVER (PARTITION BY port, ws ORDER BY obs_ts DESC, event_id DESC) AS r2 FROM wb)"
    " SELECT port, strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start,"
    " strftime(ws + INTERVAL '10 minutes', '%Y-%m-%d %H:%M:%S') AS window_end, COUNT(*) AS readings,"
    " MAX(CASE WHEN r1 = 1 THEN wave_height_m END) AS first_wave_height_m,"
    " MAX(CASE WHEN r2 = 1 THEN wave_height_m END) AS latest_wave_height_m,"
    " MAX(wave_height_m) AS max_wave_height_m, MAX(wind_speed_kmh) AS max_wind_kmh FROM ranked GROUP BY port, ws",
    "scored"))
def q_window_stats(spark, sf):
    return cond.window_stats(_obs(spark, sf)).withColumns({
        "window_start": F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"),
        "window_end": F.date_format("window_end", "yyyy-MM-dd HH:mm:ss")})


_PSTATS = """,
pstats AS (
  SELECT p.port, COALESCE(o.n, 0) AS origin_shipments,
    round_even(CAST(o.nd AS DOUBLE) / o.n * 1e2 * 1e1, 0) / 1e1 AS origin_delay_pct,
    COALESCE(d.n, 0) AS destination_shipments,
    round_even(CAST(d.nd AS DOUBLE) / d.n * 1e2 * 1e1, 0) / 1e1 AS destination_delay_pct
  FROM ports_dim p
  LEFT JOIN (SELECT Origin_City AS port, COUNT(*) AS n, SUM(Is_Delayed) AS nd FROM scored GROUP BY 1) o ON p.port = o.port
  LEFT JOIN (SELECT Destination_City AS port, COUNT(*) AS n, SUM(Is_Delayed) AS nd FROM scored GROUP BY 1) d
    ON p.port = d.port)"""


def _alerts(spark, sf):
    return cond.alerts(_obs(spark, sf), pf.port_statistics(sc.scored(spark, sf)))


@register("port_alerts", with_ctes(
    OBS_SQL + _PSTATS + " SELECT o.event_id, o.port, strftime(o.obs_ts, '%Y-%m-%d %H:%M:%S') AS obs_ts,"
    " o.wave_height_m, o.wind_speed_kmh, " + _LEVEL.format(w="o.wave_height_m", v="o.wind_speed_kmh") + " AS level, "
    + _SEV.format(w="o.wave_height_m", v="o.wind_speed_kmh") + " AS implied_severity,"
    " s.origin_shipments, s.origin_delay_pct, s.destination_shipments, s.destination_delay_pct"
    " FROM obs o LEFT JOIN pstats s ON o.port = s.port WHERE o.ok"))
def q_alerts(spark, sf):
    return _alerts(spark, sf)[0].withColumn("obs_ts", F.date_format("obs_ts", "yyyy-MM-dd HH:mm:ss"))


@register("failed_readings", with_ctes(
    OBS_SQL + " SELECT event_id, port, strftime(obs_ts, '%Y-%m-%d %H:%M:%S') AS obs_ts FROM obs WHERE NOT ok",
    "scored"))
def q_failed(spark, sf):
    return _alerts(spark, sf)[1].withColumn("obs_ts", F.date_format("obs_ts", "yyyy-MM-dd HH:mm:ss"))


def _live_payloads(spark, sf):
    """A4 input: per-port marine and wind responses built from the hourly series (one batch per port)."""
    h = cond.hourly_readings(_obs(spark, sf))
    per = h.groupBy("port_idx").agg(F.sort_array(F.collect_list(F.struct("hour", "wave_height_m", "wind_speed_kmh")))
                                    .alias("s"))
    req = port_dim(spark).select(F.col("port_idx").alias("batch_id"), F.lit(0).alias("pos"), "port")
    j = req.join(per, req.batch_id == per.port_idx, "left")
    times = F.coalesce(F.transform("s", lambda x: F.date_format(x["hour"], "yyyy-MM-dd'T'HH:mm")),
                       F.array().cast("array<string>"))
    waves = F.coalesce(F.transform("s", lambda x: x["wave_height_m"]), F.array().cast("array<double>"))
    winds = F.coalesce(F.transform("s", lambda x: x["wind_speed_kmh"]), F.array().cast("array<double>"))
    marine = j.select("batch_id", F.to_json(F.struct(F.struct(times.alias("time"), waves.alias("wave_height"))
                                                     .alias("hourly"))).alias("payload"))
    current = F.struct(F.get(winds, 0).alias("wind_speed_10m"))
    wind = j.select("batch_id", F.to_json(F.struct(F.struct(winds.alias("wind_speed_10m")).alias("hourly"),
                                                   current.alias("current"))).alias("payload"))
    return marine, wind, req


@register("live_hourly_rows", with_ctes(
    OBS_SQL + " SELECT port, CAST(rn - 1 AS INTEGER) AS hour_no, strftime(hour, '%Y-%m-%d %H:%M:%S') AS ts,"
    " wave_height_m, CAST(NULL AS DOUBLE) AS wave_period_s, CAST(NULL AS DOUBLE) AS swell_height_m,"
    " wind_speed_kmh, CAST(NULL AS DOUBLE) AS precipitation_mm FROM hseries", "scored"))
def q_live_rows(spark, sf):
    m, w, req = _live_payloads(spark, sf)
    rows, _ = payloads.decode_live(m, w, req)
    return rows.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@register("live_port_ledger", with_ctes(
    OBS_SQL + " SELECT p.port_idx AS batch_id, 0 AS pos, p.port, h.port IS NOT NULL AS ok,"
    " CASE WHEN h.port IS NULL THEN '" + payloads.ERR_EMPTY_HOURLY + "' END AS error,"
    " h.wave_height_m AS current_wave_height_m, h.wind_speed_kmh AS current_wind_kmh,"
    " CAST(NULL AS DOUBLE) AS current_precip_mm"
    " FROM ports_dim p LEFT JOIN (SELECT * FROM hseries WHERE rn = 1) h ON p.port_idx = h.port_idx", "scored"))
def q_live_ledger(spark, sf):
    m, w, req = _live_payloads(spark, sf)
    return payloads.decode_live(m, w, req)[1]


# ---------------------------------------------------------------- A7, A8: road legs, geocodes
@register("road_legs", """
SELECT c_custkey AS delivery_id, p.port AS arrival_port, c_custkey % 13 <> 0 AS ok,
  CASE WHEN c_custkey % 13 = 0 THEN '""" + payloads.ERR_NO_ROUTE.replace("'", "''") + """' END AS error,
  CASE WHEN c_custkey % 13 <> 0 THEN CAST((c_custkey * 37) % 250000 AS DOUBLE) / 1e3 END AS distance_km,
  CASE WHEN c_custkey % 13 <> 0 THEN CAST(c_nationkey * 611 + c_custkey % 997 AS DOUBLE) / 60e0 END AS duration_minutes,
  CASE WHEN c_custkey % 13 <> 0 THEN CAST(c_nationkey * 611 + c_custkey % 997 AS DOUBLE) / 60e0 / 60e0 END
    AS duration_hours
FROM customer JOIN (""" + ports_values_sql() + """) p ON CAST(c_custkey % 31 AS INTEGER) = p.port_idx""")
def q_road_legs(spark, sf):
    return payloads.decode_road_legs(landing.road_leg_payloads(spark, sf))


_GEO_MSG = ("CASE status WHEN 'ZERO_RESULTS' THEN 'No location found for ''' || c_name || '''.'"
            + "".join(" WHEN '" + k + "' THEN '" + v.replace("'", "''") + "'"
                      for k, v in payloads.GEOCODE_ERRORS.items() if k != "ZERO_RESULTS")
            + " ELSE 'Geocoding failed: ' || status END")


@register("geocodes", """
WITH g AS (SELECT *, CASE WHEN c_custkey % 10 = 0 THEN 'ZERO_RESULTS' WHEN c_custkey % 10 = 1 THEN 'OVER_QUERY_LIMIT'
                          WHEN c_custkey % 10 = 2 THEN 'UNKNOWN_ERROR' ELSE 'OK' END AS status FROM customer)
SELECT c_custkey AS address_id, c_name AS address, status = 'OK' AS ok,
  CASE WHEN status <> 'OK' THEN """ + _GEO_MSG + """ END AS error,
  CASE WHEN status = 'OK' THEN CAST(c_custkey % 180 - 90 AS DOUBLE) + 0.5e0 END AS lat,
  CASE WHEN status = 'OK' THEN CAST((c_nationkey * 7) % 360 - 180 AS DOUBLE) + 0.25e0 END AS lon,
  CASE WHEN status = 'OK' THEN c_name END AS formatted_address
FROM g""")
def q_geocodes(spark, sf):
    return payloads.decode_geocode(landing.geocode_payloads(spark, sf))


# ---------------------------------------------------------------- H: exposure
ORACLE_SIMS = 500
def sim_sql(n_sims: int) -> str:
    """CTEs down to ``simres``: a draw takes a quarter of the md5 of its row and its group of four draws."""
    return f""",
simd AS (SELECT Order_ID, Predicted_Delay_Probability AS p, CAST(ROUND(Shipping_Cost_USD * 1e2) AS BIGINT) AS cents
         FROM scored),
sims AS (SELECT range AS sim_id FROM range({n_sims})),
digests AS (
  SELECT p, cents, g, md5(CAST(Order_ID AS VARCHAR) || '|' || CAST(g AS VARCHAR) || '|42') AS dg
  FROM simd CROSS JOIN (SELECT range AS g FROM range({n_sims // ex.PARTS}))),
draws AS (
  SELECT g * {ex.PARTS} + k AS sim_id, p, cents,
    CAST(('0x' || substr(dg, CAST(8 * k + 1 AS INTEGER), 8))::BIGINT AS DOUBLE) / 4294967296e0 AS u
  FROM digests CROSS JOIN (SELECT range AS k FROM range({ex.PARTS}))),
simres AS (
  SELECT s.sim_id, COALESCE(a.n, 0) AS delayed_count, CAST(COALESCE(a.c, 0) AS DOUBLE) / 1e2 AS exposure_usd
  FROM sims s LEFT JOIN (SELECT sim_id, COUNT(*) AS n, CAST(SUM(cents) AS BIGINT) AS c FROM draws WHERE u < p
                         GROUP BY 1) a ON s.sim_id = a.sim_id)"""


SIM_SQL = sim_sql(ORACLE_SIMS)
#: every draw takes the first eight digits of its own md5
EACH_SQL = f""",
simd AS (SELECT Order_ID, Predicted_Delay_Probability AS p, CAST(ROUND(Shipping_Cost_USD * 1e2) AS BIGINT) AS cents
         FROM scored),
sims AS (SELECT range AS sim_id FROM range({ORACLE_SIMS})),
draws AS (
  SELECT sim_id, p, cents,
    CAST(('0x' || substr(md5(CAST(Order_ID AS VARCHAR) || '|' || CAST(sim_id AS VARCHAR) || '|42'), 1, 8))::BIGINT
         AS DOUBLE) / 4294967296e0 AS u
  FROM simd CROSS JOIN sims),
simres AS (
  SELECT s.sim_id, COALESCE(a.n, 0) AS delayed_count, CAST(COALESCE(a.c, 0) AS DOUBLE) / 1e2 AS exposure_usd
  FROM sims s LEFT JOIN (SELECT sim_id, COUNT(*) AS n, CAST(SUM(cents) AS BIGINT) AS c FROM draws WHERE u < p
                         GROUP BY 1) a ON s.sim_id = a.sim_id)"""


def _sims(spark, sf):
    return sc._memo(spark, sf, f"sims{ORACLE_SIMS}", lambda: ex.simulate(sc.scored(spark, sf), ORACLE_SIMS, 42))


def _sims_each(spark, sf):
    return sc._memo(spark, sf, f"sims{ORACLE_SIMS}-each", lambda: ex.simulate(sc.scored(spark, sf), ORACLE_SIMS, 42, uniform="md5_each"))


def simulations_sql(sims: str) -> str:
    return with_ctes(sims + " SELECT * FROM simres")


@register("exposure_simulations", simulations_sql(EACH_SQL))
def q_sims(spark, sf):
    return _sims_each(spark, sf)


@register("exposure_expectation", with_ctes(
    " SELECT ROUND(SUM(Predicted_Delay_Probability), 6) AS expected_delayed,"
    " ROUND(SUM(Predicted_Delay_Probability * Shipping_Cost_USD), 2) AS expected_exposure_usd FROM scored"))
def q_expect(spark, sf):
    e = ex.expectation(sc.scored(spark, sf))
    return e.select(F.round("expected_delayed", 6).alias("expected_delayed"),
                    F.round("expected_exposure_usd", 2).alias("expected_exposure_usd"))


@register("exposure_tail", with_ctes(
    EACH_SQL + " SELECT quantile_cont(CAST(delayed_count AS DOUBLE), 0.95) AS p95_delayed,"
    " ROUND(quantile_cont(exposure_usd, 0.95), 6) AS p95_exposure_usd,"
    " ROUND(quantile_cont(exposure_usd, 0.99), 6) AS p99_exposure_usd FROM simres"))
def q_tail(spark, sf):
    t = ex.tail_summary(_sims_each(spark, sf))
    return t.select("p95_delayed", F.round("p95_exposure_usd", 6).alias("p95_exposure_usd"),
                    F.round("p99_exposure_usd", 6).alias("p99_exposure_usd"))


@register("exposure_histogram", with_ctes(
    SIM_SQL + ", mm AS (SELECT MIN(delayed_count) AS clo, MAX(delayed_count) AS chi, MIN(exposure_usd) AS elo,"
    " MAX(exposure_usd) AS ehi FROM simres)"
    f", h AS (SELECT 'delayed_count' AS metric, {_bin_sql('delayed_count', 'clo', 'chi', 40)} AS bin, COUNT(*) AS n,"
    " MAX(clo)::DOUBLE AS lo, MAX(chi)::DOUBLE AS hi FROM simres CROSS JOIN mm GROUP BY 1, 2 UNION ALL"
    f" SELECT 'exposure_usd', {_bin_sql('exposure_usd', 'elo', 'ehi', 40)}, COUNT(*), MAX(elo), MAX(ehi) FROM simres CROSS JOIN mm"
    " GROUP BY 1, 2) SELECT metric, bin, n, ROUND(lo + bin * ((hi - lo) / 40), 6) AS bin_from,"
    " ROUND(lo + (bin + 1) * ((hi - lo) / 40), 6) AS bin_to FROM h"))
def q_hist(spark, sf):
    h = ex.histograms(_sims(spark, sf))
    return h.select("metric", "bin", "n", F.round("bin_from", 6).alias("bin_from"), F.round("bin_to", 6).alias("bin_to"))


def markers_sql(sims: str) -> str:
    return with_ctes(
        sims + " SELECT 'delayed_count' AS metric, ROUND((SELECT SUM(Predicted_Delay_Probability) FROM scored), 6) AS expected,"
        " ROUND(quantile_cont(CAST(delayed_count AS DOUBLE), 0.95), 6) AS p95 FROM simres UNION ALL SELECT 'exposure_usd',"
        " ROUND((SELECT SUM(Predicted_Delay_Probability * Shipping_Cost_USD) FROM scored), 2),"
        " ROUND(quantile_cont(exposure_usd, 0.95), 6) FROM simres")


@register("exposure_markers", markers_sql(EACH_SQL))
def q_markers(spark, sf):
    """H4: the expected and p95 lines of the histograms."""
    m = ex.markers(sc.scored(spark, sf), _sims_each(spark, sf))
    return m.select("metric", F.when(F.col("metric") == "exposure_usd", F.round("expected", 2)).otherwise(F.round("expected", 6)).alias("expected"),
                    F.round("p95", 6).alias("p95"))


@register("exposure_tail_filtered", with_ctes(
    EACH_SQL.replace("FROM scored)", f"FROM scored WHERE {FACET_SQL})", 1)
    + " SELECT quantile_cont(CAST(delayed_count AS DOUBLE), 0.95) AS p95_delayed,"
    " ROUND(quantile_cont(exposure_usd, 0.95), 6) AS p95_exposure_usd,"
    " ROUND(quantile_cont(exposure_usd, 0.99), 6) AS p99_exposure_usd FROM simres"))
def q_tail_filtered(spark, sf):
    """H1 + H3 on the faceted filter."""
    s = pf.faceted_filter(sc.scored(spark, sf), **FACETS)
    t = ex.tail_summary(sc._memo(spark, sf, "sims-filtered-each", lambda: ex.simulate(s, ORACLE_SIMS, 42, uniform="md5_each")))
    return t.select("p95_delayed", F.round("p95_exposure_usd", 6).alias("p95_exposure_usd"),
                    F.round("p99_exposure_usd", 6).alias("p99_exposure_usd"))


@register("exposure_simulations_default", with_ctes(sim_sql(2000) + " SELECT * FROM simres"))
def q_sims_default(spark, sf):
    """H1 at the default 2,000 draws."""
    return ex.simulate(sc.scored(spark, sf), 2000, 42)


@register("exposure_count_exact", None)
def q_count_exact(spark, sf):
    """H3: the delayed count's exact mean, deviation and quantiles beside the simulated p95."""
    exact = delayed_count_summary(sc.scored(spark, sf), {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return exact.crossJoin(ex.tail_summary(_sims(spark, sf)).select(F.col("p95_delayed").alias("simulated_p95")))   # two 1-row results


@register("exposure_count_groups", with_ctes(
    " SELECT ROUND(Predicted_Delay_Probability, 12) AS p, COUNT(*) AS n FROM scored WHERE Predicted_Delay_Probability IS NOT NULL GROUP BY Predicted_Delay_Probability"))
def q_count_groups(spark, sf):
    """H3: the groups of equal probability that the exact distribution is made of."""
    return probability_groups(sc.scored(spark, sf)).select(F.round("p", 12).alias("p"), "n")


@register("board_exposure", with_ctes(
    EACH_SQL + " SELECT ROUND((SELECT SUM(Predicted_Delay_Probability * Shipping_Cost_USD) FROM scored), 2)"
    " AS exposed_value_usd, ROUND(quantile_cont(exposure_usd, 0.95), 2) AS bad_month_p95_usd,"
    " ROUND(quantile_cont(exposure_usd, 0.99), 2) AS bad_month_p99_usd FROM simres"))
def q_board_exposure(spark, sf):
    """E1 with H2/H3: the board's 'value exposed to delay risk' and 'worst case in a bad month'
    computed from the portfolio instead of the reference's two literals."""
    e = ex.expectation(sc.scored(spark, sf)).select(F.round("expected_exposure_usd", 2).alias("exposed_value_usd"))
    t = ex.tail_summary(_sims_each(spark, sf)).select(F.round("p95_exposure_usd", 2).alias("bad_month_p95_usd"),
                                                 F.round("p99_exposure_usd", 2).alias("bad_month_p99_usd"))
    return e.crossJoin(t)   # two 1-row results


# ---------------------------------------------------------------- K4: route edges with live port weather
from keelson.operators import routes as rt  # noqa: E402
from keelson.plans.catalog import _graphs  # noqa: E402
from keelson.plans.oracle_routes import EDGE_CTES, live_weather_sql  # noqa: E402

_COND_SQL = (", pagg AS (SELECT port_idx, COUNT(*) AS n_hours,"
             " MAX(CASE WHEN rn = 1 THEN wave_height_m END) AS cw, MAX(CASE WHEN rn = 1 THEN wind_speed_kmh END) AS cv"
             " FROM hseries GROUP BY port_idx),"
             " pcond AS (SELECT p.port, LEAST(10e0, COALESCE(a.cw, 0e0) * 1.8e0 + COALESCE(a.cv, 0e0) / 15e0) AS reading"
             " FROM ports_dim p JOIN pagg a ON p.port_idx = a.port_idx WHERE a.n_hours > 0),"
             " we AS (SELECT e2.*, ra.reading AS ra, rb.reading AS rb FROM e2"
             " LEFT JOIN pcond ra ON e2.a_port = ra.port LEFT JOIN pcond rb ON e2.b_port = rb.port),"
             " we2 AS (SELECT we.*, CASE WHEN ra IS NULL AND rb IS NULL THEN 5e0 ELSE (COALESCE(ra, 0e0) + COALESCE(rb, 0e0))"
             " / ((CASE WHEN ra IS NULL THEN 0 ELSE 1 END) + (CASE WHEN rb IS NULL THEN 0 ELSE 1 END)) END AS weather_risk FROM we),"
             " wedges AS (SELECT we2.*, LEAST(GREATEST(COALESCE(CASE WHEN cr.n >= 100 THEN cr.rate END, rr.rate, g.rate)"
             " + (weather_risk - 5e0) / 5e0 * 0.15e0, 0.01e0), 0.99e0) AS delay_probability"
             " FROM we2 LEFT JOIN combo_r cr ON we2.route_type = cr.Route_Type AND we2.mode = cr.Transportation_Mode"
             " AND we2.category = cr.Product_Category LEFT JOIN route_r rr ON we2.route_type = rr.Route_Type"
             " CROSS JOIN global_r g)")


@register("route_edges_live_weather", with_ctes(
    OBS_SQL + EDGE_CTES + _COND_SQL + " SELECT mode, category, a_port, b_port, ROUND(weather_risk, 9) AS weather_risk,"
    " ROUND(delay_probability, 9) AS delay_probability FROM wedges"))
def q_edges_weather(spark, sf):
    """K4 + K6: edge weather = mean over usable endpoint readings (P1 current conditions from the
    observations), default 5.0, nudging the historical rate by a bounded amount."""
    conds = cond.port_conditions(_obs(spark, sf), port_dim(spark))
    e = rt.route_edges(port_dim(spark), _graphs(spark, sf), sc.featured(spark, sf), conditions=conds)
    return e.select("mode", "category", "a_port", "b_port", F.round("weather_risk", 9).alias("weather_risk"),
                    F.round("delay_probability", 9).alias("delay_probability"))


@register("best_routes_live_weather", live_weather_sql(OBS_SQL, _COND_SQL))
def q_best_live(spark, sf):
    """K9 over the live-weather edges: the best routes under the current port readings."""
    def build():
        conds = cond.port_conditions(_obs(spark, sf), port_dim(spark))
        e = sc.materialize(rt.route_edges(port_dim(spark), _graphs(spark, sf), sc.featured(spark, sf), conditions=conds), "live-edges")
        best = rt.all_pairs_best(rt.priority_weights(e))
        return rt.route_totals(best, rt.route_legs(best, e), port_dim(spark))
    t = sc._memo(spark, sf, "live_totals", build)
    return t.select("mode", "category", "priority", "origin", "destination", "route", "hops",
                    F.round("overall_delay_probability", 9).alias("overall_delay_probability"))
