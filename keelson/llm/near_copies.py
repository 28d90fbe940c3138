"""Classes of near copies: texts with alike sets of five-word shingles share one.

Each text has a MinHash signature of ``BANDS`` x ``ROWS`` least shingle hashes.  Texts that agree in all rows of a band are linked: each
band's texts to its least text, so a band is as many links as it has texts, however many are alike.  A class is a connected
component of the links.  Two texts with a Jaccard index of J share a band with probability 1 - (1 - J^ROWS)^BANDS: 0.997 at 0.8, 0.99999
at 0.9, 0.12 at 0.5, 0.002 at 0.3.  No link is checked again: a class may hold less alike texts besides, directly or over chains, which costs the packing
that asks for classes only a few more conflicts.

The least text of a band is combined before its shuffle and written before it is joined back, so Spark can split a band that a third of all texts
share.  Copies are one text (equal up to case and spacing).

Defined cases: null, empty and blank texts are in no class; a text of fewer than five words has its whole sequence as its shingle, so it is
alike only to its copies; rows that repeat an id or a text are one text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import materialize
from keelson.llm.components import connected_components
from keelson.llm.recompression import BASES, WordHashes, _mix

SHINGLE = 5
BANDS = 32
ROWS = 8
SEED = 42
MEMO_TEXTS = 1 << 20
#: shingles hashed at once
BLOCK = 512
_RNG = np.random.default_rng(SEED)
_TIMES = (_RNG.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1))[:, None]


def text_node(joined: bytes) -> int:
    """The number of a text up to case and spacing, signed."""
    return int(np.uint64(xxhash.xxh64_intdigest(joined, SEED)).view(np.int64))


def shingle_hashes(words: list[bytes], memo: WordHashes) -> np.ndarray:
    """Hashes of the text's shingles; the text must have words."""
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - SHINGLE + 1)
    sums = np.zeros(n, np.uint64)
    for j in range(min(SHINGLE, len(h))):
        sums = sums * np.uint64(BASES[0]) + h[j:j + n]
    return _mix(sums)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least of the shingles' hashes, turned by each of BANDS x ROWS odd factors (bijections of 32 bits)."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, np.uint32(0xFFFFFFFF))
    for at in range(0, len(low), BLOCK):
        np.minimum(least, (low[None, at:at + BLOCK] * _TIMES).min(axis=1), out=least)
    return least


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band: its number and its rows."""
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        keys = _mix(keys * np.uint64(BASES[1]) + rows[:, r])
    return keys


class Bands:
    """Band keys of a task's texts; none for a text that the task has met before (copies are one text)."""

    def __init__(self):
        self.memo, self.seen = WordHashes(), set()

    def of(self, words: list[bytes], node: int) -> np.ndarray | None:
        if node in self.seen:
            return None
        if len(self.seen) >= MEMO_TEXTS:
            self.seen.clear()
        self.seen.add(node)
        return band_keys(signature(shingle_hashes(words, self.memo))).view(np.int64)


def near_classes(texts: DataFrame) -> DataFrame:
    """(node, root) of the texts that have near copies; root is the least node of the class.

    ``texts`` is a written table of node and bands (an array of keys, or null), read twice.
    """
    sent = texts.where("bands IS NOT NULL").select("node", F.explode("bands").alias("band"))
    least = sent.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    least = materialize(least.select(F.col("band").alias("at"), "least"), "near-least")
    links = sent.join(least, F.col("band") == F.col("at")).where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    return materialize(connected_components(links).select("node", F.col("component").alias("root")), "near-classes")
