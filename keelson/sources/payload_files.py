"""Landed response files: written once, scanned in bulk.

Two layouts, as responses arrive:

* a batch's response is one file under ``batch_id=<n>/``: a list of objects, or one object for one location.  The scan reads files whole,
  takes the batch from the path, and matches objects to the requested locations by their position; a file that is
  no JSON gives no objects;
* single responses are lines of JSON-lines files, an envelope with the request's key and the response's text.  A line
  that cannot be read is a corrupt record.

Every file and every unreadable line is a row of a ledger; a request without a readable response is a failed row of its own
ledger, never an error of the job.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.session import ensure_checkpoint_dir
from keelson.sources import payloads

ERR_BROKEN_FILE = "not a JSON response"
CORRUPT = "_corrupt"


def landing_folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/keelson-landed-{name}-{uuid.uuid4().hex}"


def land_batches(responses: DataFrame, folder: str) -> str:
    """Writes (batch_id, payload) as one text file a batch."""
    responses.select("batch_id", F.col("payload").alias("value")).repartition("batch_id").write.partitionBy("batch_id").text(folder)
    return folder


def scan_batches(spark: SparkSession, folder: str) -> DataFrame:
    """batch_id, payload and path of every landed file."""
    files = spark.read.schema("value string, batch_id int").text(folder, wholetext=True)
    return files.select("batch_id", F.col("value").alias("payload"), F.col("_metadata.file_path").alias("path"))


def file_ledger(files: DataFrame, kind: str, schema: T.StructType) -> DataFrame:
    """One row a file: kind, batch_id, whether it is a response, and how many objects it holds."""
    objects = F.from_json(payloads.as_list_json(F.col("payload")), T.ArrayType(schema))
    n = F.coalesce(F.size(objects), F.lit(0))
    ok = objects.isNotNull()
    return files.select(F.lit(kind).alias("kind"), "batch_id", "path", ok.alias("ok"), F.when(ok, n).otherwise(0).alias("n_objects"),
                        F.when(~ok, ERR_BROKEN_FILE).alias("error"))


def land_lines(lines: DataFrame, folder: str) -> str:
    """Writes a column ``value`` of envelope lines; the files' number follows the table's partitions."""
    lines.select("value").write.text(folder)
    return folder


def scan_lines(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """key, payload, path and the corrupt line (null for readable ones) of every line."""
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("payload", T.StringType()), T.StructField(CORRUPT, T.StringType())])
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", CORRUPT).option("mode", "PERMISSIVE").json(folder)
    return rows.select(key, "payload", CORRUPT, F.col("_metadata.file_path").alias("path"))


def line_ledger(lines: DataFrame, key: str) -> DataFrame:
    """One row: lines, corrupt ones, and files that hold any."""
    broken = F.col(CORRUPT).isNotNull() | F.col(key).isNull()
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.count_if(broken).alias("corrupt"))


def answered(requests: DataFrame, lines: DataFrame, key: str, empty: str) -> DataFrame:
    """Every request with its response's text; ``empty`` stands for one without a readable response.

    Requests and lines are both as many as the table's rows: a shuffled join on the key.  Of repeated responses the first by text counts.
    """
    got = lines.where(F.col(CORRUPT).isNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min("payload").alias("payload"))
    joined = requests.join(got, F.col(key) == F.col("_k"), "left")
    return joined.withColumns({"answered": F.col("payload").isNotNull(), "payload": F.coalesce("payload", F.lit(empty))}).drop("_k")
