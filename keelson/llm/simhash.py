"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are 64-bit majority votes over the XXH64 of word shingles.  Distinct fingerprints are sorted
into tiles of one population count; numpy compares each pair of tiles by exclusive-or and bit counts.  Two
fingerprints within ``radius`` bits differ in population count by at most ``radius``, so other tile pairs are
skipped and no link is lost.  A tile pair returns its links as stars (each local component's members linked
to its least member), at most one edge per fingerprint, however many copies lie close together.

Texts are read as UTF-8 bytes with only A-Z lower-cased.  Defined cases: null, empty and blank texts have
fingerprint zero, linked like any other; fewer words than a shingle count as one shingle; rows that repeat
a doc_id keep their own fingerprints; a null doc_id never names a component unless it holds only such rows;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import drop_rows, keyed, materialize, parallelism, same_row, table, text_bytes, text_key
from keelson.llm.components import connected_components

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
TILE = 8192
#: shingle hashes voted on at once: bounds the memory a very long text takes
VOTE_BLOCK = 1 << 16
#: links held before they are reduced to stars
LINK_BLOCK = 1 << 20


def fingerprint(text: bytes, shingle: int = SHINGLE_WORDS) -> int:
    """64-bit fingerprint of one text (bit set: set in over half of the shingle hashes)."""
    words = text.lower().split()  # of bytes: A-Z only, and exactly \x20 \x09-\x0D separate words
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, VOTE_BLOCK):
        spans = zip(starts[at:min(n, at + VOTE_BLOCK)].tolist(), last[at:at + VOTE_BLOCK].tolist())
        h = np.array([digest(joined[s:e], SEED) for s, e in spans], dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, th (the text's key) and fp, the fingerprint as a signed 64-bit value."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))], names=["doc_id", "th", "fp"])
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes(F.col("text")).alias("text"), text_key().alias("th"))
    return rows.mapInArrow(run, "doc_id bigint, th string, fp bigint")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def stars(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The links (u, v) among n nodes as (node, least node of its component), for nodes that are not the least."""
    least = np.arange(n)
    while True:
        a, b = least[u], least[v]
        apart = a != b
        if not apart.any():
            break
        u, v = u[apart], v[apart]
        np.minimum.at(least, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (to := least[least]).tolist() != least.tolist():
            least = to
    nodes = np.flatnonzero(least != np.arange(n))
    return nodes, least[nodes]


def tile_links(a: np.ndarray, b: np.ndarray, radius: int, rows: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Star edges among the distinct fingerprints of two tiles (uint64; b may be a itself)."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    values = a if b is a else np.concatenate((a, b))
    held, offset = 0, len(values) - len(b)
    for at in range(0, len(a), rows):
        near = np.bitwise_count(a[at:at + rows, None] ^ b[None, :]) <= radius
        if b is a or near.any():
            i, j = np.nonzero(near)
            i += at
            j += offset
            apart = i < j
            if apart.any():
                found.append((i[apart], j[apart]))
                held += int(apart.sum())
        if held > LINK_BLOCK:
            found = [stars(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]), len(values))]
            held = len(found[0][0])
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    u, v = stars(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]), len(values))
    return values[u], values[v]


def near_links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints of ``fps`` (column fp) as their links do."""
    spark = fps.sparkSession
    pc = F.bit_count("fp").cast("int")
    counts = fps.groupBy(pc.alias("pc")).agg(F.count(F.lit(1)).alias("n")).select("pc", F.ceil(F.col("n") / tile).cast("int").alias("blocks"))
    counts = F.broadcast(materialize(counts, "tile-counts"))  # at most 65 rows, one per population count
    tiles = (fps.withColumn("pc", pc).join(counts, "pc")
             .groupBy("pc", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("block"))
             .agg(F.collect_list("fp").alias("fps")))  # about `tile` fingerprints, by an even hash of distinct values
    tiles = materialize(tiles, "tiles")
    # each tile is sent to itself and to later tiles of population counts within the radius
    other = counts.select(F.col("pc").alias("to_pc"), "blocks")
    sent = (tiles.join(F.broadcast(other), (F.col("to_pc") >= F.col("pc")) & (F.col("to_pc") <= F.col("pc") + radius))
            .withColumn("to_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .where((F.col("to_pc") > F.col("pc")) | (F.col("to_block") >= F.col("block"))))
    n = 4 * parallelism(spark)  # the work grows with the product of the tiles, so it is spread wider than its bytes ask
    pairs = (sent.select(F.col("to_pc"), F.col("to_block"), F.col("fps").alias("a"),
                         ((F.col("pc") == F.col("to_pc")) & (F.col("block") == F.col("to_block"))).alias("same"))
             .repartition(n, "to_pc", "to_block")
             .join(tiles.select(F.col("pc").alias("to_pc"), F.col("block").alias("to_block"), F.col("fps").alias("b")).hint("shuffle_hash"),
                   ["to_pc", "to_block"]))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (batch.column(k)[i].values.to_numpy(zero_copy_only=False).view(np.uint64) for k in (0, 1))
                u, v = tile_links(a, a if batch.column(2)[i].as_py() else b, radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return pairs.select("a", "b", "same").mapInArrow(compare, "u bigint, v bigint")


def simhash_components(docs: DataFrame, shingle: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, th, fingerprint (hex), component_id (the least doc_id that links reach) and root (the component's least fingerprint)."""
    rows = materialize(with_fingerprints(docs, shingle), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fps")
    linked = connected_components(near_links(fps.select("fp"), radius))
    linked = materialize(linked, "fp-components")
    joined = fps.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    roots = materialize(joined.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r"), "fp-roots")
    named = materialize(joined.join(roots, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "root", "component_id"), "fp-names")
    return rows.join(named, F.col("fp") == F.col("f"), "left").select(
        "doc_id", "th", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id", "root")


def keep_one(docs: DataFrame, shingle: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` for each component: that with the least doc_id (then the least text key; null ids last)."""
    rows = materialize(simhash_components(docs, shingle, radius).select("doc_id", "th", "root"), "near-duplicates")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "th")).alias("k"))
    best = materialize(best.select(F.col("root").alias("r"), "k.doc_id", "k.th"), "near-best").withColumnsRenamed({"doc_id": "b_id", "th": "b_th"})
    stays = F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("th") == F.col("b_th"))
    gone = materialize(rows.join(best, F.col("root") == F.col("r")).where(~stays).select("doc_id", "th").distinct(), "near-gone")
    # a kept row that is repeated as it stands is kept once
    again = materialize(rows.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "th"), "near-again")
    left = drop_rows(docs, gone)
    if again.isEmpty():
        return left
    once = left.withColumn("_kl_key", text_key()).join(keyed(again), same_row(F.col("_kl_key")), "left_semi")
    return drop_rows(left, again).unionAll(once.dropDuplicates(["doc_id", "_kl_key"]).drop("_kl_key"))


def op7_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
