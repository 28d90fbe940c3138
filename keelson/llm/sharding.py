"""Jump consistent hashing: stable keys to shards without a ring table (DataFrame functions only).

``jump_shards`` follows the jumps of Lamping and Veach: a 64-bit linear congruential sequence seeded
by the key decides at which shard counts the key moves, so with one more shard a key either stays or
moves into the new shard.  The key is the XXH64 of the id's text, so ids of any type and width decide alike.

Defined cases: a null id is hashed as the empty key; a null text has size 1 and CRC 0; rows that repeat
an id share its shard and get slots of their own; an empty table gives no rows; other columns are ignored
by :func:`shard_documents` and kept by :func:`with_shard`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.llm.common import materialize, table, text_bytes

MULTIPLIER = 2862933555777941757  # of the published jump hash (fixed value)
WORD = 1 << 64


def _big(value: int) -> Column:
    return F.lit(str(value)).cast("decimal(20,0)")


#: jumps followed before the (practically never taken) loop over the full shard count
FIRST_JUMPS = 48


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _next_state(key: Column) -> Column:
    """key * MULTIPLIER + 1 modulo 2**64, as a signed 64-bit value (decimals hold the full product)."""
    product = F.pmod(key.cast("decimal(20,0)") * F.lit(MULTIPLIER).cast("decimal(19,0)") + F.lit(1), _big(WORD))
    return _let(product, lambda p: F.when(p >= _big(WORD // 2), p - _big(WORD)).otherwise(p).cast("bigint"))


def stable_key(key: Column) -> Column:
    return F.xxhash64(F.coalesce(key.cast("string"), F.lit("")))


def jump_shards(key: Column, counts: list[int]) -> list[Column]:
    """The shard of each 64-bit key for every shard count in ``counts`` (ascending), from one walk."""
    if sorted(counts) != list(counts) or not counts or counts[0] < 1:
        raise ValueError("shard counts must be positive and ascending")
    most = counts[-1]

    def state(k, j, kept):
        return F.struct(k.alias("k"), j.alias("j"), *[c.alias(f"s{i}") for i, c in enumerate(kept)])

    def jump(acc, _):
        def moved(k):
            far = F.lit(float(1 << 31)) / (F.shiftrightunsigned(k, 33) + 1).cast("double")
            to = ((acc["j"] + 1).cast("double") * far).cast("bigint")
            return _let(to, lambda t: state(k, t, [F.when(t < n, t).otherwise(acc[f"s{i}"]) for i, n in enumerate(counts)]))
        return F.when(acc["j"] >= most, acc).otherwise(_let(_next_state(acc["k"]), moved))

    zero = F.lit(0).cast("bigint")
    start = state(key, zero, [zero] * len(counts))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(min(most, FIRST_JUMPS))), start, jump)
    if most > FIRST_JUMPS:
        walk = _let(walk, lambda s: F.when(s["j"] >= most, s).otherwise(
            F.aggregate(F.sequence(F.lit(1), F.lit(most)), s, jump)))
    return [walk[f"s{i}"].cast("int") for i in range(len(counts))]


def with_shard(df: DataFrame, key_col: str, shards: int, shard_col: str = "shard") -> DataFrame:
    """All rows and columns of ``df`` plus the shard of ``key_col``."""
    return df.withColumn(shard_col, jump_shards(stable_key(F.col(key_col)), [shards])[0])


def assign_slots(df: DataFrame, shard_col: str, id_cols: list[str], slot_col: str = "slot", buckets: int = 4096) -> DataFrame:
    """Gapless slots from 0 in every shard.

    Equal rows are counted before the shuffle, so a row repeated without bound is one row here.  Each
    shard is split into hash ``buckets``; a running sum over the bucket totals gives every bucket its
    first slot, and rows are ordered inside their bucket only, so no task ever holds a shard.
    """
    keys = [shard_col, *id_cols]
    groups = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_bucket", F.pmod(F.xxhash64(*id_cols), F.lit(buckets)).cast("int")))
    groups = materialize(groups, "slot-groups")
    totals = groups.groupBy(shard_col, "_bucket").agg(F.sum("_n").alias("_total"))
    before = Window.partitionBy(shard_col).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(shard_col, "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(shard_col, "_bucket").orderBy(*id_cols).rowsBetween(Window.unboundedPreceding, -1)
    placed = (groups.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
              .join(offsets, [shard_col, "_bucket"]))
    return placed.select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("_i"), "_first", "_before") \
        .select(*keys, (F.col("_first") + F.col("_before") + F.col("_i")).alias(slot_col))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Contract of the query: one row per document with its shard, slot and shard after growth by one."""
    payload = text_bytes(F.col("text"))
    now, grown = jump_shards(stable_key(F.col("doc_id")), [shards, shards + 1])
    rows = docs.select("doc_id", (F.octet_length(payload) + 1).cast("bigint").alias("size"),
                       F.crc32(payload).cast("bigint").alias("text_crc32"), now.alias("shard"), grown.alias("grown_shard"))
    slots = assign_slots(rows, "shard", ["doc_id", "size", "text_crc32", "grown_shard"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                        F.col("slot").cast("bigint").alias("slot"), "grown_shard")


def op9_jump_consistent_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
