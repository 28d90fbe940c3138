"""One reading per port and hour as keyed state with event-time timers (P5, P7, A5 on the stream).

The state of a port is its earliest good reading, by event time, of every hour the watermark has not passed.  A timer stands at the end of the
port's oldest open hour; when the watermark passes it, the hours that ended are emitted in order and forgotten: the hour's reading, or a
failed row for an hour in which the port stayed silent.  So the rows equal the batch's whatever order readings arrive in, as long as none is later than the
watermark allows, and state is bounded by ports x hours of that delay.

State lives in RocksDB under the query's checkpoint folder; a restart goes on from the last finished batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOUR_MS = 3_600_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "port string, hour timestamp, event_id long, wave_height_m double, wind_speed_kmh double, ok boolean"
_READING = "obs_us long, event_id long, wave_height_m double, wind_speed_kmh double"


def _number(x) -> float | None:
    return None if x is None or x != x else float(x)


class FirstReadings(StatefulProcessor):
    """The state of one port: hour (ms) -> earliest good reading, and the oldest hour not yet emitted."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.readings = handle.getMapState("readings", "hour long", _READING)
        self.open_hour = handle.getValueState("open_hour", "hour long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            pdf = pdf[pdf["ok"]].sort_values(["obs_us", "event_id"], kind="stable")
            first = pdf.drop_duplicates("hour_ms")
            for hour, us, event, wave, wind in zip(first.hour_ms, first.obs_us, first.event_id, first.wave_height_m, first.wind_speed_kmh):
                hour, reading = (int(hour),), (int(us), int(event), _number(wave), _number(wind))
                if hour[0] + HOUR_MS <= passed:
                    continue  # its row is out already
                if not self.readings.containsKey(hour) or self.readings.getValue(hour)[:2] > reading[:2]:
                    self.readings.updateValue(hour, reading)
                now = self.open_hour.get()
                if now is None or hour[0] < now[0]:
                    if now is not None:
                        self.handle.deleteTimer(now[0] + HOUR_MS)
                    self.open_hour.update(hour)
                    self.handle.registerTimer(hour[0] + HOUR_MS)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        hour, out = self.open_hour.get()[0], []
        while hour + HOUR_MS <= passed:
            if self.readings.containsKey((hour,)):
                _, event, wave, wind = self.readings.getValue((hour,))
                self.readings.removeKey((hour,))
                out.append((key[0], pd.Timestamp(hour, unit="ms"), event, wave, wind, True))
            else:
                out.append((key[0], pd.Timestamp(hour, unit="ms"), None, None, None, False))
            hour += HOUR_MS
        self.open_hour.update((hour,))
        self.handle.registerTimer(hour + HOUR_MS)
        frame = pd.DataFrame(out, columns=["port", "hour", "event_id", "wave_height_m", "wind_speed_kmh", "ok"])
        yield frame.astype({"event_id": "Int64", "wave_height_m": "float64", "wind_speed_kmh": "float64", "ok": "bool"})

    def close(self) -> None:
        pass


def first_readings(stream: DataFrame, watermark: str = "2 hours") -> DataFrame:
    """The stream's ``OUTPUT`` rows, each hour of a port once.  Needs the RocksDB state store (:func:`use_rocksdb`)."""
    rows = stream.withWatermark("obs_ts", watermark).select(
        "port", "obs_ts", "event_id", "wave_height_m", "wind_speed_kmh", F.coalesce("ok", F.lit(False)).alias("ok"),
        F.unix_micros("obs_ts").alias("obs_us"), (F.unix_seconds(F.date_trunc("hour", "obs_ts")) * 1000).alias("hour_ms"))
    return rows.groupBy("port").transformWithStateInPandas(
        statefulProcessor=FirstReadings(), outputStructType=OUTPUT, outputMode="append", timeMode="eventTime")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def start_first_readings(spark: SparkSession, source: DataFrame, sink: str, checkpoint: str, watermark: str = "2 hours", available_now: bool = False):
    """The job: rows are appended to a Parquet sink exactly once per finished batch."""
    use_rocksdb(spark)
    writer = first_readings(source, watermark).writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()
