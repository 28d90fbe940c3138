"""Landed payload decoding edge cases and the streaming twin of the port window statistics."""

import json
import tempfile

from pyspark.sql import functions as F

from keelson.sources import payloads


def test_historical_single_object_missing_variable_and_empty(spark):
    good = {"daily": {"time": ["2024-01-01", "2024-01-02"], "wind_speed_10m_max": [1.0, 2.0],
                      "precipitation_sum": [0.5, None]}}
    empty = {"daily": {"time": []}}
    p = spark.createDataFrame([(0, json.dumps(good)), (1, json.dumps([good, empty]))], "batch_id int, payload string")
    req = spark.createDataFrame([(0, 0, "A"), (1, 0, "B"), (1, 1, "C"), (1, 2, "D")], "batch_id int, pos int, city string")
    rows, ledger = payloads.decode_historical(p, req)
    r = sorted((x.city, str(x.wx_date), x.real_wind_gusts_max_kmh) for x in rows.collect())
    assert r == [("A", "2024-01-01", None), ("A", "2024-01-02", None), ("B", "2024-01-01", None),
                 ("B", "2024-01-02", None)]
    led = {x.city: (x.ok, x.error) for x in ledger.collect()}
    assert led["C"] == (False, payloads.ERR_EMPTY_DAILY)
    assert led["D"][0] is False  # position missing from the response
    s = payloads.failure_summary(ledger, "city").collect()[0]
    assert (s.failed, s.failed_ports, s.all_failed) == (2, "C, D", False)


def test_live_mismatched_lengths(spark):
    marine = {"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "wave_height": [1.0, 2.0],
                         "wave_period": [5.0]}}
    wind = {"hourly": {"wind_speed_10m": [10.0]}, "current": {"wind_speed_10m": 12.0}}
    m = spark.createDataFrame([(0, json.dumps(marine)), (1, json.dumps({"hourly": {"time": []}}))], "batch_id int, payload string")
    w = spark.createDataFrame([(0, json.dumps(wind)), (1, json.dumps(wind))], "batch_id int, payload string")
    req = spark.createDataFrame([(0, 0, "P"), (1, 0, "Q")], "batch_id int, pos int, port string")
    rows, ledger = payloads.decode_live(m, w, req)
    got = sorted((r.hour_no, r.wave_height_m, r.wave_period_s, r.wind_speed_kmh) for r in rows.collect())
    assert got == [(0, 1.0, None, None), (1, 2.0, None, None)]
    led = {r.port: r for r in ledger.collect()}
    assert led["P"].ok and led["P"].current_wave_height_m == 1.0 and led["P"].current_wind_kmh == 12.0
    assert not led["Q"].ok


def test_road_and_geocode_decode(spark):
    d = spark.createDataFrame([(1, '{"routes": [{"distanceMeters": 5000, "duration": "5024s"}]}'),
                               (2, '{"routes": []}')], "delivery_id int, payload string")
    r = {x.delivery_id: x for x in payloads.decode_road_legs(d).collect()}
    assert r[1].distance_km == 5.0 and abs(r[1].duration_hours - 5024 / 3600) < 1e-12 and not r[2].ok
    g = spark.createDataFrame([(1, "x", '{"status": "ZERO_RESULTS", "results": []}'),
                               (2, "y", '{"status": "WEIRD"}')], "address_id int, address string, payload string")
    e = {x.address_id: x.error for x in payloads.decode_geocode(g).collect()}
    assert e == {1: "No location found for 'x'.", 2: "Geocoding failed: WEIRD"}


def test_stream_window_stats_equal_batch(spark):
    from table_dirs import SMALL
    from keelson.operators.conditions import window_stats
    from keelson.sources.landing import port_observations
    from keelson.streaming.port_stream import read_observations, windowed_stats
    obs = port_observations(spark, SMALL).select("event_id", "port_idx", "obs_ts", "wave_height_m",
                                                 "wind_speed_kmh", "ok", "port")
    src = tempfile.mkdtemp(prefix="keelson-obs-")
    obs.repartition(4, "event_id").write.mode("overwrite").parquet(src)
    ck = tempfile.mkdtemp(prefix="keelson-stream-ck-")
    q = (windowed_stats(read_observations(spark, src, 1)).writeStream.outputMode("complete").format("memory")
         .queryName("port_windows").option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.table("port_windows")
    want = window_stats(obs)
    cols = sorted(want.columns)
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0
    assert want.select(cols).exceptAll(got.select(cols)).count() == 0


def test_stream_dedupe_and_alert_sinks(spark):
    """P7 + P8: one reading per port per bucket; good readings and failures land in two sinks."""
    from table_dirs import SMALL
    from keelson.operators import portfolio as pf
    from keelson.plans import scored as sc
    from keelson.sources.landing import port_observations
    from keelson.streaming.port_stream import alert_sink, one_per_bucket, publish_statistics, read_observations
    obs = port_observations(spark, SMALL).select("event_id", "port_idx", "obs_ts", "wave_height_m",
                                                 "wind_speed_kmh", "ok", "port")
    src = tempfile.mkdtemp(prefix="keelson-obs2-")
    obs.write.mode("overwrite").parquet(src)
    ck = tempfile.mkdtemp(prefix="keelson-ck2-")
    q = (one_per_bucket(read_observations(spark, src, 1), "10 minutes").writeStream.format("memory")
         .queryName("dedup_obs").option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.table("dedup_obs")
    buckets = obs.where("ok").select("port", F.window("obs_ts", "10 minutes").start.alias("b")).distinct().count()
    assert got.count() == buckets
    assert got.groupBy("port", "bucket").count().where("count > 1").count() == 0
    out_a, out_f = tempfile.mkdtemp(prefix="keelson-alerts-"), tempfile.mkdtemp(prefix="keelson-failed-")
    ck2 = tempfile.mkdtemp(prefix="keelson-ck3-")
    publish_statistics(pf.port_statistics(sc.scored(spark, SMALL)), out_a + "/stats")
    q2 = (read_observations(spark, src, 1).writeStream.foreachBatch(alert_sink(out_a + "/stats", out_a + "/a", out_f + "/f"))
          .option("checkpointLocation", ck2).trigger(availableNow=True).start())
    q2.awaitTermination(300)
    a = spark.read.parquet(out_a + "/a")
    f = spark.read.parquet(out_f + "/f")
    assert a.count() == obs.where("ok").count() and f.count() == obs.where("not ok").count()
    assert a.where(F.col("level").isNull()).count() == 0


def test_export_scored_csv_round_trip(spark):
    """Filtered scored rows export with a header and read back whole."""
    from table_dirs import SMALL
    from keelson.operators.portfolio import faceted_filter
    from keelson.plans import scored as sc
    from keelson.sources.shipments import export_scored
    df = faceted_filter(sc.scored(spark, SMALL), modes=["Sea"])
    out = tempfile.mkdtemp(prefix="keelson-export-") + "/csv"
    export_scored(df, out, fmt="csv")
    back = spark.read.option("header", True).csv(out)
    assert back.count() == df.count() and set(back.columns) == set(df.columns)
    pq = tempfile.mkdtemp(prefix="keelson-export-") + "/pq"
    export_scored(df, pq)
    assert spark.read.parquet(pq).count() == df.count()


def test_csv_scan_with_declared_schema(spark):
    """A1: a landed shipments CSV read with the declared schema (no inference) keeps types and values."""
    from table_dirs import SMALL
    from keelson.plans import scored as sc
    from keelson.sources.shipments import SHIPMENT_SCHEMA, read_shipments
    base = sc.base_shipments(spark, SMALL)
    out = tempfile.mkdtemp(prefix="keelson-csv-") + "/ship"
    base.write.option("header", True).csv(out)
    back = read_shipments(spark, out, "csv")
    # file sources read every column as nullable; names and types must match the declaration
    assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in SHIPMENT_SCHEMA]
    cols = [f.name for f in SHIPMENT_SCHEMA.fields if f.name != "Delivery_Status"]
    assert back.select(cols).exceptAll(base.select(cols)).count() == 0


def test_refresh_stream_append_mode(spark):
    """P6 in append mode: every emitted window equals its batch twin; only windows the watermark
    has passed are emitted; a bad interval is refused."""
    import pytest

    from table_dirs import SMALL
    from keelson.operators.conditions import window_stats
    from keelson.sources.landing import port_observations
    from keelson.streaming.port_stream import start_refresh_stream
    obs = port_observations(spark, SMALL).select("event_id", "port_idx", "obs_ts", "wave_height_m",
                                                 "wind_speed_kmh", "ok", "port")
    src = tempfile.mkdtemp(prefix="keelson-obs3-") + "/landed"
    # readings land in time order: three slices, each appended after the previous one
    lo, hi = obs.agg(F.min("obs_ts"), F.max("obs_ts")).collect()[0]
    step = (hi - lo) / 3
    for i in range(3):
        a, b = lo + step * i, (lo + step * (i + 1) if i < 2 else hi)
        cond = (F.col("obs_ts") >= F.lit(a)) & ((F.col("obs_ts") < F.lit(b)) if i < 2 else (F.col("obs_ts") <= F.lit(b)))
        obs.where(cond).coalesce(1).write.mode("append").parquet(src)
    sink = tempfile.mkdtemp(prefix="keelson-sink-") + "/w"
    ck = tempfile.mkdtemp(prefix="keelson-ck4-")
    q = start_refresh_stream(spark, src, sink, ck, "10 minutes", available_now=True)
    q.awaitTermination(300)
    got = spark.read.parquet(sink)
    want = window_stats(obs)
    cols = sorted(want.columns)
    assert got.count() > 0
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0
    max_ts = obs.agg(F.max("obs_ts")).collect()[0][0]
    assert got.where(F.col("window_end") > F.lit(max_ts)).count() == 0
    with pytest.raises(ValueError):
        start_refresh_stream(spark, src, sink, ck, "7 minutes")


def test_csv_export_keeps_blanks(spark):
    """Leading and trailing blanks survive the CSV export; every column is compared."""
    from table_dirs import SMALL
    from keelson.plans import scored as sc
    from keelson.sources.shipments import SHIPMENT_SCHEMA, export_scored, read_shipments
    base = sc.base_shipments(spark, SMALL)
    out = tempfile.mkdtemp(prefix="keelson-csv-") + "/ship"
    export_scored(base, out, fmt="csv")
    cols = [f.name for f in SHIPMENT_SCHEMA.fields]
    back = read_shipments(spark, out, "csv").select(cols)
    assert base.where("Delivery_Status = ' late '").count() > 0
    assert back.exceptAll(base.select(cols)).count() == 0 and base.select(cols).exceptAll(back).count() == 0


def test_export_replaces_one_month_and_prunes(spark):
    """Other months' files stay as they are; a month filter reads its folder alone."""
    import os

    from table_dirs import SMALL
    from keelson.plans import scored as sc
    from keelson.sources.shipments import export_scored, read_months, replace_months
    df = sc.scored(spark, SMALL)
    out = tempfile.mkdtemp(prefix="keelson-export-") + "/pq"
    export_scored(df, out)

    def files(month):
        return {f for f in os.listdir(f"{out}/Order_YearMonth={month}") if f.startswith("part")}
    before = {m: files(m) for m in ("1995-02", "1995-03")}
    replace_months(df.where("Transportation_Mode = 'Sea'"), out, ["1995-03"])
    assert files("1995-02") == before["1995-02"] and files("1995-03").isdisjoint(before["1995-03"])
    got = read_months(spark, out)
    assert got.count() == df.where("Order_YearMonth <> '1995-03' OR Transportation_Mode = 'Sea'").count()
    one = read_months(spark, out, ["1995-03"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    assert one.count() == df.where("Order_YearMonth = '1995-03' AND Transportation_Mode = 'Sea'").count()


def test_replayed_alert_batch_leaves_the_same_rows(spark):
    """A replay agrees with the first run also after new statistics; later batches take them; rows equal the batch twin."""
    from table_dirs import SMALL
    from keelson.operators import conditions as cond
    from keelson.operators import portfolio as pf
    from keelson.plans import scored as sc
    from keelson.sources.landing import port_observations
    from keelson.streaming.port_stream import STATISTICS, alert_sink, publish_statistics
    obs = port_observations(spark, SMALL)
    scored = sc.scored(spark, SMALL)
    out = tempfile.mkdtemp(prefix="keelson-alerts-")
    whole, part = pf.port_statistics(scored), pf.port_statistics(pf.faceted_filter(scored, modes=["Sea"]))
    assert publish_statistics(whole, out + "/stats") == 1
    write = alert_sink(out + "/stats", out + "/a", out + "/f")
    write(obs, 0)
    assert publish_statistics(part, out + "/stats") == 2
    for batch_id in (1, 0):
        write(obs, batch_id)
    cols = ["event_id", "port", "level", "implied_severity", *STATISTICS]
    for batch_id, stats in ((0, whole), (1, part)):
        got = spark.read.parquet(out + "/a").where(F.col("batch_id") == batch_id).select(cols)
        want = cond.alerts(obs, stats)[0].select(cols)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert {tuple(r) for r in spark.read.parquet(out + "/a").select("batch_id", "statistics_version").distinct().collect()} == {(0, 1), (1, 2)}
    assert spark.read.parquet(out + "/f").count() == 2 * obs.where("not ok").count()


def test_weather_rows_are_made_unique_and_coverage_is_told(spark):
    from keelson.operators.weather import REAL_LABELS, merge_weather, origin_coverage
    cols = list(REAL_LABELS)
    ship = spark.createDataFrame([(1, "A", "2024-01-01"), (2, "B", "2024-01-01"), (3, "C", "2024-01-01")], "Order_ID long, Origin_City string, d string") \
        .withColumn("Order_Date", F.to_date("d"))
    rows = spark.createDataFrame([("A", "2024-01-01", *[float(i) for i in range(len(cols))]), ("A", "2024-01-01", *[9.0] * len(cols))],
                                 "city string, d string, " + ", ".join(f"{c} double" for c in cols)).withColumn("wx_date", F.to_date("d")).drop("d")
    asked = spark.createDataFrame([("A",), ("B",)], "city string")
    got = merge_weather(ship, rows, asked).orderBy("Order_ID").collect()
    assert [r.Order_ID for r in got] == [1, 2] and got[0][cols[0]] == 0.0 and got[1][cols[0]] is None
    assert tuple(origin_coverage(ship, asked).first()) == (2, 1, 1)


def test_unseen_category_is_all_zeros(spark):
    """G1: an unseen category gives zeros, not a slot of its own."""
    from pyspark.ml import Pipeline

    from keelson.operators.ml import feature_stages
    seen = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "k string, x double")
    model = Pipeline(stages=feature_stages(numeric=["x"], categorical=["k"])).fit(seen)
    new = spark.createDataFrame([("zzz", 5.0), ("b", 6.0)], "k string, x double")
    assert [r.features.toArray().tolist() for r in model.transform(new).collect()] == [[5.0, 0.0, 0.0, 0.0], [6.0, 0.0, 1.0, 0.0]]
