"""Cut lineage by writing a stage as a Parquet table in the shared checkpoint folder.

Reading the table back gives a small logical plan (a file scan) that still
prunes columns and pushes filters, unlike an RDD checkpoint; the files live in
the cluster's shared ``spark.checkpoint.dir``, so lost executors recompute
nothing upstream.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from keelson.session import ensure_checkpoint_dir


def materialize(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/keelson-{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
