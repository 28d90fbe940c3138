"""Keyed stream state: hours by event time under shuffled, late and restarted input; statistics by version."""

import random
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from keelson.operators.conditions import hourly_readings
from keelson.streaming.hourly_state import start_first_readings
from keelson.streaming.port_stream import OBSERVATION_SCHEMA, read_observations

START = datetime(2024, 3, 1)


@pytest.fixture()
def state_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    yield
    spark.conf.set(name, before)


def readings(seed):
    """Two days of four ports; port D is silent for hours, some readings fail, ties share a time, values can be missing."""
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        at = START + timedelta(minutes=rng.randint(0, 2 * 24 * 60 - 1))
        port = rng.choice("ABC") if at.hour % 6 or rng.random() < 0.7 else "D"
        rows.append((i, "ABCD".index(port), at, rng.choice([None, rng.random() * 6]), rng.choice([None, rng.random() * 90]), rng.random() > 0.1, port))
    return rows


def land(spark, rows, path):
    spark.createDataFrame(rows, OBSERVATION_SCHEMA).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("restart", [False, True])
def test_stream_hours_equal_the_batch(spark, state_store, restart):
    rows = readings(5)
    rng = random.Random(6)
    # slices of six hours; within the watermark's delay readings come in any order and a tenth comes a slice late
    slices = [[] for _ in range(9)]
    for r in rows:
        k = int((r[2] - START).total_seconds() // (6 * 3600))
        slices[k + (rng.random() < 0.1)].append(r)
    end = [(9999, 0, START + timedelta(days=4), 1.0, 1.0, True, "A")]   # moves the watermark past every hour
    base = tempfile.mkdtemp(prefix="keelson-state-")
    src, sink, ck = f"{base}/in", f"{base}/out", f"{base}/ck"
    parts = [slices[:4], [*slices[4:], end]] if restart else [[*slices, end]]
    for part in parts:
        for s in part:
            rng.shuffle(s)
            if s:
                land(spark, s, src)
        q = start_first_readings(spark, read_observations(spark, src, 1), sink, ck, "8 hours", available_now=True)
        q.awaitTermination(600)
        assert q.exception() is None
    got = spark.read.parquet(sink).where(F.col("hour") < F.lit(START + timedelta(days=2))).cache()
    cols = ["port", "hour", "event_id", "wave_height_m", "wind_speed_kmh"]
    want = hourly_readings(spark.createDataFrame(rows, OBSERVATION_SCHEMA)).select(cols)
    good = got.where("ok").select(cols)
    assert good.exceptAll(want).count() == 0 and want.exceptAll(good).count() == 0
    # silent hours between a port's first reading and the end are failed rows, each hour once
    assert got.groupBy("port", "hour").count().where("count > 1").count() == 0
    first = want.groupBy("port").agg(F.min("hour").alias("h"))
    hours = first.select("port", F.explode(F.sequence("h", F.lit(START + timedelta(hours=47)), F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    silent = hours.join(want, ["port", "hour"], "left_anti")
    failed = got.where("NOT ok").select("port", "hour")
    assert failed.exceptAll(silent).count() == 0 and silent.exceptAll(failed).count() == 0
