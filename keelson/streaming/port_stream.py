"""Structured Streaming port conditions.

The reference polls an API every few minutes with a cache bucket; here the
readings land as files and a stream keeps per-port tumbling-window statistics
(bounded state via a watermark), drops repeat readings inside a bucket, and
routes each micro-batch to an alert sink and a failed-reading sink.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.operators.conditions import condition_level, implied_severity

OBSERVATION_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("port_idx", T.IntegerType()),
    T.StructField("obs_ts", T.TimestampType()), T.StructField("wave_height_m", T.DoubleType()),
    T.StructField("wind_speed_kmh", T.DoubleType()), T.StructField("ok", T.BooleanType()),
    T.StructField("port", T.StringType())])


def read_observations(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return (spark.readStream.schema(OBSERVATION_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
            .parquet(path))


def windowed_stats(stream: DataFrame, interval: str = "10 minutes", watermark: str = "1 hour") -> DataFrame:
    """Per (port, tumbling window) count, max wave/wind and first/latest wave (struct min/max)."""
    return (stream.where("ok").withWatermark("obs_ts", watermark)
            .groupBy("port", F.window("obs_ts", interval).alias("w"))
            .agg(F.count(F.lit(1)).alias("readings"),
                 F.min(F.struct("obs_ts", "event_id", "wave_height_m")).alias("first"),
                 F.max(F.struct("obs_ts", "event_id", "wave_height_m")).alias("latest"),
                 F.max("wave_height_m").alias("max_wave_height_m"), F.max("wind_speed_kmh").alias("max_wind_kmh"))
            .select("port", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "readings",
                    F.col("first.wave_height_m").alias("first_wave_height_m"),
                    F.col("latest.wave_height_m").alias("latest_wave_height_m"),
                    "max_wave_height_m", "max_wind_kmh"))


def one_per_bucket(stream: DataFrame, bucket: str = "10 minutes", watermark: str = "1 hour") -> DataFrame:
    """P7 at low latency: repeat good readings of a port inside one cache bucket are the same reading; a failed
    reading never takes the bucket.  The first to arrive stands for it at once; the first by event time
    takes state until the watermark passes (:mod:`keelson.streaming.hourly_state`)."""
    return (stream.where("ok").withColumn("bucket", F.date_trunc("hour", "obs_ts") if bucket == "1 hour"
                              else F.window("obs_ts", bucket).start)
            .withWatermark("obs_ts", watermark)
            .dropDuplicatesWithinWatermark(["port", "bucket"]))


STATISTICS = ["origin_shipments", "origin_delay_pct", "destination_shipments", "destination_delay_pct"]


def _versions(spark: SparkSession, path: str, column: str) -> list[int]:
    """Values of a partition column in a folder; none where nothing was written yet."""
    try:
        found = spark.read.parquet(path).select(F.col(column).cast("int")).distinct().collect()   # one row a version or batch
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(r[0] for r in found)


def publish_statistics(port_stats: DataFrame, path: str) -> int:
    """Adds a version of the ports' statistics (31 rows) to a slowly changing dimension; older ones stay readable."""
    version = max(_versions(port_stats.sparkSession, path, "version"), default=0) + 1
    port_stats.select("port", *STATISTICS).withColumn("version", F.lit(version)).coalesce(1).write.mode("append").partitionBy("version").parquet(path)
    return version


def version_of_batch(spark: SparkSession, statistics_path: str, ledger_path: str, batch_id: int) -> int:
    """The statistics' version of a micro-batch: the newest when it first ran, the same whenever it is replayed."""
    if batch_id in _versions(spark, ledger_path, "batch_id"):
        return spark.read.parquet(ledger_path).where(F.col("batch_id") == batch_id).first()["version"]
    version = max(_versions(spark, statistics_path, "version"))
    spark.createDataFrame([(batch_id, version)], "batch_id int, version int").coalesce(1).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(ledger_path)
    return version


def alert_sink(statistics_path: str, alert_path: str, failed_path: str):
    """A foreachBatch writer: good readings enriched with the ports' statistics of the batch's version (31 rows,
    re-read in every batch), failed readings to a side table.  The version is kept beside the alerts before they are written, and
    each batch overwrites its own ``batch_id`` partition, so a replay leaves the same rows, also after a new version."""
    ledger_path = alert_path.rstrip("/") + "_versions"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version = version_of_batch(spark, statistics_path, ledger_path, batch_id)
        stats = F.broadcast(spark.read.parquet(statistics_path).where(F.col("version") == version).select("port", *STATISTICS))
        batch.persist()   # read by both sinks
        good = batch.where("ok").join(stats, "port", "left").select(
            "event_id", "port", "obs_ts", "wave_height_m", "wind_speed_kmh",
            condition_level(F.col("wave_height_m"), F.col("wind_speed_kmh")).alias("level"),
            implied_severity(F.col("wave_height_m"), F.col("wind_speed_kmh")).alias("implied_severity"),
            *STATISTICS, F.lit(version).alias("statistics_version")).withColumn("batch_id", F.lit(batch_id))
        failed = batch.where(~F.coalesce("ok", F.lit(False))).select("event_id", "port", "obs_ts").withColumn("batch_id", F.lit(batch_id))
        for rows, path in ((good, alert_path), (failed, failed_path)):
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
        batch.unpersist()
    return write


REFRESH_INTERVALS = ("5 minutes", "10 minutes", "15 minutes", "30 minutes")


def start_refresh_stream(spark: SparkSession, source: str, sink: str, checkpoint: str,
                         interval: str = "10 minutes", watermark: str = "1 hour", available_now: bool = False):
    """P6 as a running job: per-port tumbling windows at the refresh interval, append mode.

    Append mode emits each window once, after the watermark passes its end, so state stays
    bounded by the watermark delay; the Parquet sink and the checkpoint folder make the job
    restartable after executor or driver loss.
    """
    if interval not in REFRESH_INTERVALS:
        raise ValueError(f"interval must be one of {REFRESH_INTERVALS}")
    stats = windowed_stats(read_observations(spark, source, files_per_trigger=1), interval, watermark)
    writer = (stats.writeStream.outputMode("append").format("parquet").option("path", sink)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()
