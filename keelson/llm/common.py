"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.plans.materialize import materialize

__all__ = ["b32_sha1", "drop_rows", "keyed", "materialize", "parallelism", "same_row", "table", "text_bytes", "text_key"]

#: RFC 4648 base32 alphabet, and the digits that ``conv(..., 32)`` writes for the same values (fixed values)
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; null counts as the empty text."""
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def b32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: eight groups of 20 bits, four base32 digits each."""
    digits = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), CONV32, BASE32)


def text_key() -> Column:
    """Digest of a row's text: with doc_id it names a row (rows equal in both are decided alike)."""
    return F.md5(text_bytes(F.col("text")))


def keyed(keys: DataFrame) -> DataFrame:
    """Row keys (doc_id, th) as the hashed side of a shuffled join.

    What a filter removes is a share of the corpus, so it is never broadcast: the plan is the same at every size, and
    only keys are held in memory, a partition's at a time.
    """
    return keys.select(F.col("doc_id").alias("_kl_id"), F.col("th").alias("_kl_th")).hint("shuffle_hash")


def same_row(key: Column) -> Column:
    return F.col("doc_id").eqNullSafe(F.col("_kl_id")) & (key == F.col("_kl_th"))


def drop_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id and text key are in ``keys`` (doc_id, th)."""
    return docs.join(keyed(keys), same_row(text_key()), "left_anti")
