"""Chat formatting after cumulative-snapshot collapse (DataFrame functions only).

Chat logs often hold a conversation again each time it grows.  Every turn gets two 64-bit hashes of its position,
role and text; their running sums (kept as exact 32-bit halves) are rolling hashes of the turn prefixes: two prefixes of
equal length and hashes hold the same turns.  Of conversations with the same turns the smallest conv_id
stays; an anti-join then drops those that are a proper prefix of another one, and the rest are rendered turn by turn.

Running sums go by blocks of turn numbers, so a conversation with a large share of all rows is never one group:
block sums are combined before the shuffle, and a window holds one block.  Both sides of the anti-join are distinct
(length, hash) keys, so a conversation that is logged thousands of times is one row there.

Defined cases: turns are ordered by turn (nulls first), then role, then text; equal rows (conv_id, turn, role, text) are one turn;
null role and text count as empty, like empty ones; a null conv_id is a conversation of its own that comes last in ties;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.llm.common import materialize, table

BLOCK_TURNS = 256
#: ChatML turn markers (fixed values)
START, END = "<|im_start|>", "<|im_end|>"
HALVES = ("h0", "h1", "h2", "h3")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), role, text, the rolling hash of the turns up to pos, and the rendered length before pos."""
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    rows = rows.withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS)).withColumn("chars", F.length(rendered()))
    rows = materialize(rows, "turns")
    by_block = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)

    def add_base(df, sums):
        totals = df.groupBy("conv_id", "block").agg(*[F.sum(c).alias(f"t_{c}") for c in sums])
        base = totals.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"),
                             *[F.coalesce(F.sum(f"t_{c}").over(by_block), F.lit(0)).alias(f"b_{c}") for c in sums])
        return df.join(base, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("block").eqNullSafe(F.col("_b"))).drop("_c", "_b")

    rows = add_base(rows.withColumn("one", F.lit(1)), ["one", "chars"])
    rows = rows.withColumn("pos", F.col("b_one") + F.row_number().over(inside) - 1).withColumn(
        "char_start", F.col("b_chars") + F.coalesce(F.sum("chars").over(before), F.lit(0)))
    for k in (0, 1):
        h = F.xxhash64(F.lit(k), "pos", "role", "text")
        rows = rows.withColumn(f"h{2 * k}", h.bitwiseAND(F.lit(0xFFFFFFFF))).withColumn(f"h{2 * k + 1}", F.shiftrightunsigned(h, 32))
    rows = materialize(rows.drop("b_one", "b_chars", "one", "chars"), "turn-hashes")
    rows = add_base(rows, list(HALVES))
    return rows.select("conv_id", "pos", "role", "text", "char_start",
                       *[(F.col(f"b_{h}") + F.sum(h).over(upto)).alias(h) for h in HALVES])


def rendered():
    return F.concat(F.lit(START), F.col("role"), F.lit("\n"), F.col("text"), F.lit(END + "\n"))


def collapse(prefixes: DataFrame) -> DataFrame:
    """conv_id and n_turns of the maximal conversations: the smallest id of equal ones, and no proper prefix of another."""
    sizes = materialize(prefixes.groupBy("conv_id").agg(F.max("pos").alias("last")), "conversation-sizes")
    rows = prefixes.select("conv_id", "pos", *HALVES).join(sizes.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")))
    key = ["pos", *HALVES]
    finals = rows.where("pos = last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    longer = rows.where("pos < last").select(*key).distinct()
    return finals.join(longer, key, "left_anti").select("conv_id", (F.col("pos") + 1).cast("int").alias("n_turns"))


def format_maximal(turns: DataFrame) -> DataFrame:
    """One row per turn of the maximal conversations: its rendering and where it starts in the rendered conversation."""
    prefixes = materialize(prefix_hashes(turns), "turn-prefixes")
    kept = materialize(collapse(prefixes), "maximal").withColumnRenamed("conv_id", "_c")
    rows = prefixes.join(kept, F.col("conv_id").eqNullSafe(F.col("_c")))
    return rows.select("conv_id", F.col("pos").cast("int").alias("pos"), "n_turns", F.col("char_start").cast("bigint").alias("char_start"),
                       rendered().alias("rendered"))


def op2_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_maximal(table(spark, sf_dir, "conversations"))


SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
     p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos,
                  '{START}' || role || chr(10) || text || '{END}' || chr(10) AS rendered FROM t),
     c AS (SELECT conv_id, list(md5(role) || md5(text) ORDER BY pos) AS turns, count(*) AS n FROM p GROUP BY conv_id),
     f AS (SELECT min(conv_id) AS conv_id, turns, n FROM c GROUP BY turns, n),
     proper AS (SELECT DISTINCT list_slice(turns, 1, k) AS turns FROM (SELECT turns, unnest(range(1, n)) AS k FROM f)),
     kept AS (SELECT conv_id, n FROM f WHERE turns NOT IN (SELECT turns FROM proper))
SELECT conv_id, pos::INT AS pos, n::INT AS n_turns,
       (sum(length(rendered)) OVER (PARTITION BY conv_id ORDER BY pos) - length(rendered))::BIGINT AS char_start, rendered
FROM p JOIN kept USING (conv_id)
"""
