"""Conflict-constrained best-fit packing of documents into training sequences.

A document is as long as its words; one longer than ``CAPACITY`` fills whole sequences with its first pieces, and only
the rest is packed.  Rows are dealt evenly into blocks by a row number written beforehand, so neither a hot source nor
a large group of copies makes a block large, and every block is packed on its own: decreasing lengths, bins ordered by
residual, each bin with a bitmap of the sources and one of the duplicate clusters it holds.  The search starts at the
tightest bin that fits and moves to the next residual until a bin holds neither the document's source nor its
cluster; if there is none, a bin is opened.  Duplicate clusters are the classes of :mod:`keelson.llm.near_copies`: texts
that are equal up to case and spacing, or near copies (five-word shingles with a Jaccard index of at least 0.8).

Defined cases: null and empty texts have length 0 and are packed like any other; a null source conflicts with nothing;
empty texts form no cluster; rows that repeat a doc_id are packed one by one (equal texts never share a bin);
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import materialize, parallelism, table
from keelson.llm.near_copies import Bands, near_classes, text_node

CAPACITY = 1024
BLOCK_ROWS = 4096


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item; no bin holds a source or a cluster twice (None: conflicts with nothing)."""
    bits: dict = {}
    often = Counter(c for c in clusters if c is not None)
    source_bit = [0 if s is None else 1 << bits.setdefault(s, len(bits)) for s in sources]
    bits = {}
    cluster_bit = [0 if c is None or often[c] < 2 else 1 << bits.setdefault(c, len(bits)) for c in clusters]
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    bins: list[tuple[int, int]] = []  # (residual, bin), ascending
    held: list[tuple[int, int]] = []  # each bin's bitmaps of sources and clusters
    bin_of, offset = [0] * len(sizes), [0] * len(sizes)
    for i in order:
        size, s, c = sizes[i], source_bit[i], cluster_bit[i]
        at = bisect_left(bins, (size, -1))
        while at < len(bins):
            has_s, has_c = held[bins[at][1]]
            if not (has_s & s or has_c & c):
                break
            at += 1
        if at < len(bins):
            residual, b = bins.pop(at)
        else:
            residual, b = capacity, len(held)
            held.append((0, 0))
        held[b] = (held[b][0] | s, held[b][1] | c)
        bin_of[i], offset[i] = b, capacity - residual
        insort(bins, (residual - size, b))
    return bin_of, offset


def lengths(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, source, cluster (of exact copies), node, bands and rid, a row number: one scan, no text kept."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands()
        for batch in batches:
            texts = [t.as_py().split() for t in batch.column(0)]  # of bytes: \x20 \x09-\x0D
            joined = [b" ".join(ws) for ws in texts]
            nodes = [text_node(j) if j else None for j in joined]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([len(ws) for ws in texts], pa.int64()), batch.column(2),
                 pa.array([hashlib.md5(j, usedforsecurity=False).hexdigest() if j else None for j in joined], pa.string()), pa.array(nodes, pa.int64()),
                 pa.array([bands.of(ws, n) if ws else None for ws, n in zip(texts, nodes)], pa.list_(pa.int64())), batch.column(3)],
                names=["doc_id", "n_words", "source", "cluster", "node", "bands", "rid"])

    text = F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("binary")
    rows = docs.select(text.alias("text"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.monotonically_increasing_id().alias("rid"))
    return rows.mapInArrow(measure, "doc_id bigint, n_words bigint, source string, cluster string, node bigint, bands array<bigint>, rid bigint")


def with_near_copies(sizes: DataFrame, classes: DataFrame) -> DataFrame:
    """``sizes`` with one cluster for all texts of a class (node, root)."""
    named = classes.select(F.col("node").alias("k"), F.lower(F.lpad(F.hex("root"), 16, "0")).alias("near")).hint("shuffle_hash")
    # texts without words are dealt by their row number; they are in no cluster
    rows = sizes.join(named, F.coalesce("node", "rid") == F.col("k"), "left")
    return rows.withColumn("cluster", F.when(F.col("cluster").isNotNull(), F.coalesce("near", "cluster"))).drop("k", "near", "node", "bands")


def pack(sizes: DataFrame, capacity: int = CAPACITY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per piece: bin_id, bin_offset, doc_id, piece, first_word, n_words, source, cluster.

    ``sizes`` has doc_id, n_words, source, cluster and a row number rid that is stable when read again.
    """
    blocks = max(1, -(-sizes.count() // block_rows))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rid", ignore_index=True)
        full, rest = pdf.n_words // capacity, pdf.n_words % capacity
        loose = (full == 0) | (rest > 0)
        items = pdf[loose]
        nothing = [None] * len(items)
        bins, offsets = best_fit(rest[loose].tolist(), [x if isinstance(x, str) else None for x in items.source] if len(items) else nothing,
                                 [x if isinstance(x, str) else None for x in items.cluster] if len(items) else nothing, capacity)
        used = max(bins, default=-1) + 1
        pdf["bin"] = pd.array([None] * len(pdf), dtype="Int64")
        pdf.loc[loose, "bin"] = pd.array(bins, dtype="Int64")
        pdf["bin_offset"] = 0
        pdf.loc[loose, "bin_offset"] = offsets
        pdf["full"] = full
        pdf["full_from"] = used + full.cumsum() - full
        return pdf[["block", "doc_id", "n_words", "source", "cluster", "bin", "bin_offset", "full", "full_from"]]

    dealt = sizes.withColumn("doc_id", F.col("doc_id").cast("bigint")).withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks)))
    placed = dealt.repartition(max(parallelism(sizes.sparkSession), blocks), "block").groupBy("block").applyInPandas(
        fit, "block bigint, doc_id bigint, n_words bigint, source string, cluster string, bin bigint, bin_offset bigint, full bigint, full_from bigint")
    # whole pieces are told apart here, so a very long text never makes a block's frame large
    last = F.when(F.col("bin").isNotNull(), F.col("full") + 1).otherwise(F.col("full"))
    pieces = placed.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last - 1)))
    whole = F.col("piece") < F.col("full")
    return pieces.select(
        (F.col("block") * F.lit(1 << 32) + F.when(whole, F.col("full_from") + F.col("piece")).otherwise(F.col("bin"))).alias("bin_id"),
        F.when(whole, F.lit(0)).otherwise(F.col("bin_offset")).cast("bigint").alias("bin_offset"), "doc_id", "piece",
        (F.col("piece") * capacity).alias("first_word"),
        F.when(whole, F.lit(capacity)).otherwise(F.col("n_words") - F.col("full") * capacity).cast("bigint").alias("n_words"), "source", "cluster")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    sizes = materialize(lengths(docs), "lengths")
    return pack(materialize(with_near_copies(sizes, near_classes(sizes)), "sizes"), capacity)


def op4_conflict_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
