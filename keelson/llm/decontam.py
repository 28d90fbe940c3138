"""Benchmark decontamination: a BM25 inverted index of test items, searched with block-max WAND.

Items are indexed in shards of at most ``SHARD_ITEMS`` (the only thing broadcast; more items mean more passes over the
documents, not a larger index); item count, document frequencies, mean length and longest item are those of the whole benchmark,
so the results do not depend on the shards.  Every text, whole, is cut into passages of two strides, so that each run of
words as long as the longest item lies inside one passage.  A passage is a query of its distinct terms:

* WAND: the sum of its terms' largest impacts must reach the least threshold of any item;
* block-max: for each block of items the sum of the terms' largest impacts in that block must reach the block's least threshold;
* the items of the blocks left are scored exactly through the postings of those blocks alone (the postings of other blocks are
  skipped), and all at or above their threshold are candidates.

An item's threshold is its own score less its m largest impacts, m being the number of shingles that verification lets be
missing; a missing word costs at least one shingle, so no pair that would be verified is lost.  Verification asks that
``OVERLAP`` of the five-word shingles of both the question (the item without its last sentence) and the answer (its last
sentence; a single sentence is all question) occur in the passage, or as many of the item's as one run of words: a changed
word in a short answer, which leaves none of the answer's shingles, does not hide a copy of the rest.

Words are runs of letters and digits, lower-cased.  Defined cases: null and empty texts match nothing; items of
fewer than ``MIN_WORDS`` words cannot be verified and match nothing; a question or answer shorter than a shingle counts as one;
rows that repeat an id give their own rows; null ids are kept; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import drop_rows, materialize, table, text_key

SHINGLE = 5
OVERLAP = 0.8
MIN_WORDS = 5
K1, B = 1.2, 0.75
SHARD_ITEMS = 5000
ITEM_BLOCKS = 32
MIN_STRIDE = 64
#: words of a text held at once
TEXT_BLOCK = 1 << 14
WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"[.!?]+\s+|\n+")
SCHEMA = "doc_id bigint, th string, item_id bigint, first_word bigint, score double, question_overlap double, answer_overlap double, item_overlap double"
TYPES = {n: {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}[t] for n, t in (c.split() for c in SCHEMA.split(", "))}


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def question_answer(text: str | None) -> tuple[list[str], list[str]]:
    """The words of all but the last sentence, and of the last one; a single sentence is all question."""
    parts = [p for p in (words(s) for s in SENTENCE.split(text or "")) if p]
    if len(parts) < 2:
        return (parts[0] if parts else []), []
    return [w for p in parts[:-1] for w in p], parts[-1]


def shingles(ws: list[str]) -> set[tuple[str, ...]]:
    if not ws:
        return set()
    return {tuple(ws[i:i + SHINGLE]) for i in range(max(1, len(ws) - SHINGLE + 1))}


def _covered(part: set[tuple[str, ...]], found: set[tuple[str, ...]], ws: list[str]) -> float:
    if not part:
        return 1.0
    short = next(iter(part))
    if len(short) < SHINGLE:  # fewer words than a shingle: as a run of words
        n = len(short)
        return float(any(tuple(ws[i:i + n]) == short for i in range(len(ws) - n + 1)))
    return len(part & found) / len(part)


class Whole(NamedTuple):
    """What a shard must know of the whole benchmark: items, their words, the longest item's, and the items each of its terms is in."""

    n: int
    words: int
    longest: int
    df: dict[str, int]


class Index:
    """Impacts of the terms in the items, by term, with the largest impact of each term in each block of items.

    ``whole`` holds the benchmark's statistics if ``items`` are a shard of it.
    """

    def __init__(self, items: list[tuple[int | None, str | None]], whole: Whole | None = None):
        split = [(i, question_answer(t)) for i, t in items]
        split = [(i, q, a) for i, (q, a) in split if len(q) + len(a) >= MIN_WORDS]
        self.ids = [i for i, _, _ in split]
        self.questions = [shingles(q) for _, q, _ in split]
        self.answers = [shingles(a) for _, _, a in split]
        texts = [q + a for _, q, a in split]
        self.wholes = [shingles(ws) for ws in texts]
        n = len(texts)
        df = Counter(t for ws in texts for t in set(ws))
        if whole is None:
            whole = Whole(n, sum(map(len, texts)), max(map(len, texts), default=0), df)
        self.stride = max(MIN_STRIDE, whole.longest)
        mean = max(1.0, whole.words / max(1, whole.n))
        self.terms = {t: k for k, t in enumerate(sorted(df))}  # an item's impacts are added in one order in any shard
        idf = {t: np.log(1 + (whole.n - whole.df[t] + 0.5) / (whole.df[t] + 0.5)) for t in df}
        postings: list[list[tuple[int, float]]] = [[] for _ in df]
        self.thresholds = np.zeros(n)
        for i, ws in enumerate(texts):
            norm = K1 * (1 - B + B * len(ws) / mean)
            impacts = {t: idf[t] * c * (K1 + 1) / (c + norm) for t, c in Counter(ws).items()}
            for t, x in impacts.items():
                postings[self.terms[t]].append((i, x))
            spare = [int((1 - OVERLAP) * len(s) + 1e-9) for s in (self.questions[i], self.answers[i], self.wholes[i])]
            missing = max(spare[0] + spare[1], spare[2])
            self.thresholds[i] = sum(sorted(impacts.values())[:max(0, len(impacts) - missing)]) - 1e-6
        self.per_block = max(1, -(-n // ITEM_BLOCKS))
        blocks = -(-n // self.per_block) if n else 0
        self.block_max = np.zeros((len(df), blocks), np.float32)
        for k, plist in enumerate(postings):
            for i, x in plist:
                self.block_max[k, i // self.per_block] = max(self.block_max[k, i // self.per_block], np.float32(x) * np.float32(1 + 1e-6))
        self.term_max = self.block_max.max(axis=1, initial=0)
        self.block_threshold = np.array([self.thresholds[b * self.per_block:(b + 1) * self.per_block].min() for b in range(blocks)])
        # postings of all terms one after another, by item; starts[t, b] is where those of term t from block b on begin
        self.items = np.array([i for plist in postings for i, _ in plist], np.int64)
        self.impacts = np.array([x for plist in postings for _, x in plist])
        sizes = np.zeros((len(df), blocks + 1), np.int64)
        for k, plist in enumerate(postings):
            for i, _ in plist:
                sizes[k, i // self.per_block + 1] += 1
            sizes[k, 0] = len(postings[k - 1]) if k else 0
        sizes[:, 0] = np.cumsum(sizes[:, 0])
        self.starts = np.cumsum(sizes, axis=1)

    def candidates(self, known: np.ndarray, at: np.ndarray, passages: int) -> Iterator[tuple[int, int, float]]:
        """(passage, item, score) at or above the items' thresholds; known: term numbers, at: their word positions."""
        v = len(self.terms)
        if not len(known) or not len(self.ids):
            return
        key = np.concatenate((at // self.stride, at // self.stride - 1)) * v + np.concatenate((known, known))
        key = np.unique(key[key >= 0])
        passage, term = key // v, key % v
        keep = passage < passages
        passage, term = passage[keep], term[keep]
        if not len(passage):
            return
        first = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
        wand = np.add.reduceat(self.term_max[term], first) >= self.block_threshold.min() - 1e-4
        if not wand.any():
            return
        bounds = np.add.reduceat(self.block_max[term], first, axis=0)
        ends = np.r_[first[1:], len(term)]
        alive = (bounds >= self.block_threshold[None, :] - 1e-4) & wand[:, None]
        for w in np.flatnonzero(alive.any(axis=1)):
            blocks = np.flatnonzero(alive[w])
            begin = self.starts[term[first[w]:ends[w], None], blocks].ravel()
            size = self.starts[term[first[w]:ends[w], None], blocks + 1].ravel() - begin
            at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())  # term by term, so sums are added in one order
            scores = np.bincount(self.items[at], self.impacts[at], len(self.ids))
            live = np.repeat(alive[w], self.per_block)[:len(self.ids)]
            for i in np.flatnonzero(live & (scores >= self.thresholds)):
                yield int(passage[first[w]]), int(i), float(scores[i])

    def matches(self, text: str | None) -> dict[int, tuple[int, float, float, float, float]]:
        """Verified items of a whole text: item -> first word of the passage, score, question, answer and item overlap."""
        found: dict[int, tuple[int, float, float, float, float]] = {}
        text = (text or "").lower()
        stream = iter(WORD.findall(text)) if len(text) < 4 * TEXT_BLOCK else (m.group() for m in WORD.finditer(text))
        held, base = [], 0
        block = max(3, -(-TEXT_BLOCK // self.stride)) * self.stride
        while True:
            more = list(islice(stream, block))
            held += more
            if not held:
                return found
            last = len(more) < block
            # a passage starts every stride; those that reach past the held words wait for the next block, which holds at
            # least two strides before it unless the text has ended
            passages = max(1, -(-len(held) // self.stride)) if last else len(held) // self.stride - 1
            ids = np.fromiter(map(self.terms.get, held, repeat(-1)), np.int64, len(held))
            at = np.flatnonzero(ids >= 0)
            for p, i, score in self.candidates(ids[at], at, passages):
                ws = held[p * self.stride:(p + 2) * self.stride]
                have = shingles(ws)
                q, a, whole = (_covered(part[i], have, ws) for part in (self.questions, self.answers, self.wholes))
                if (min(q, a) >= OVERLAP or whole >= OVERLAP) and (i not in found or (q + a + whole, score) > (sum(found[i][2:]), found[i][1])):
                    found[i] = (base + p * self.stride, score, q, a, whole)
            if last:
                return found
            held, base = held[passages * self.stride:], base + passages * self.stride


def _item_terms(items: DataFrame) -> DataFrame:
    """shard, words and distinct terms of each item that can be verified."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [(s, [w for part in question_answer(t.as_py()) for w in part]) for s, t in zip(batch.column(0), batch.column(1))]
            parts = [(s.as_py(), len(ws), sorted(set(ws))) for s, ws in parts if len(ws) >= MIN_WORDS]
            columns = zip(*parts) if parts else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.string())))], names=["shard", "words", "terms"])

    return items.select("shard", "text").mapInArrow(split, "shard bigint, words bigint, terms array<string>")


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """doc_id, th (the text's key), item_id, the passage's first word, its BM25 score and the overlaps: the best passage of each verified pair."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    shards = max(1, -(-items.count() // shard_items))
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("bigint"))
    if shards > 1:  # a shard is scored as part of the whole benchmark, so the results are those of one index
        per_item = materialize(_item_terms(items), "item-terms")
        total = per_item.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.coalesce(F.max("words"), F.lit(0)).alias("longest")).first()
        in_shard = materialize(per_item.select("shard", F.explode("terms").alias("term")).groupBy("shard", "term").agg(F.count(F.lit(1)).alias("n")), "shard-terms")
        df = materialize(in_shard.groupBy("term").agg(F.sum("n").alias("df")).withColumnRenamed("term", "t"), "item-df")
    out = None
    for s in range(shards):
        whole = None
        if shards > 1:  # the terms of about shard_items rows
            known = in_shard.where(F.col("shard") == s).join(df, F.col("term") == F.col("t")).select("term", "df").collect()
            whole = Whole(total.n, total.words, total.longest, {r.term: r.df for r in known})
        index = Index(sorted(((r.item_id, r.text) for r in items.where(F.col("shard") == s).collect()), key=str), whole)  # about shard_items rows

        def search(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            names = list(TYPES)
            for batch in batches:
                rows = []
                for d, th, t in zip(batch.column(0), batch.column(1), batch.column(2)):
                    rows += [(d.as_py(), th.as_py(), index.ids[i], *m) for i, m in sorted(index.matches(t.as_py()).items())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, TYPES[n]) for n, c in zip(names, zip(*rows))], names=names)

        found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("th"), F.col("text").cast("string").alias("text")).mapInArrow(search, SCHEMA)
        out = found if out is None else out.unionAll(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a test item."""
    return drop_rows(docs, materialize(contaminated_pairs(docs, benchmark).select("doc_id", "th").distinct(), "leaks"))


def op3_bmw_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")
