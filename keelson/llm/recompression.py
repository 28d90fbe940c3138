"""Substring removal by recompression.

A text is a sequence of words.  Rounds of recompression shorten it: a maximal run of one symbol gets a name made of
symbol and length, then every pair of neighbours whose first symbol is in the round's left class and whose second is in
its right class gets a name made of both.  Names are 64-bit hashes of what they stand for and classes are bits of names,
so equal substrings get equal symbols anywhere in the corpus, without a dictionary to share.  Each symbol carries
its support, the words that decided how it was parsed: an equal stretch of words holds the same symbol at the same place.

Three Spark passes over the documents:

1. In each window of ``WINDOW`` words, the symbol of the last round whose support lies in the window and whose support's
   words have the least hash is the window's anchor (equal windows have equal anchors).  Anchors are counted over the
   corpus; one that occurs once proves its windows to be unique.
2. Only the other windows are compared, by 95 bits of hash of their words, and the smallest document of each is found.  Which windows those
   are goes along as bits, so the third pass parses nothing again.
3. A window that starts earlier in its document, or is held by a smaller document, is removed with its words.

All counts and minima are combined before their shuffles and only results that name one row are sent back, so a
passage that a third of all documents share is one row in each.  Rows are named by doc_id and text, so what is sent to a row is
bounded by its text also where many rows share a doc_id (or have none).

Defined cases: null texts have no words; texts of fewer words than a window keep them all; rows that share a doc_id are none
of them earlier than another (the start decides within a row only); a null doc_id comes after all others; empty tables give no rows;
other columns are ignored.  A text must fit in a worker's memory several times over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import materialize, table, text_bytes

WINDOW = 20
ROUNDS = 4
#: words parsed at once (whole texts; a longer text is parsed alone)
PARSE_WORDS = 1 << 18
MEMO_WORDS = 1 << 20
LAST_ID = (1 << 63) - 1
NONE = np.uint64((1 << 64) - 1)
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """XXH64 of words, remembered up to MEMO_WORDS of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def word_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of words (its digest is big-endian)."""
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)


class Segments:
    """Hashes of any stretch of a hash sequence, from one prefix sum."""

    def __init__(self, h: np.ndarray, base: int):
        def powers(x: int) -> np.ndarray:
            steps = np.full(len(h) + 1, x, np.uint64)
            steps[0] = 1
            return np.cumprod(steps, dtype=np.uint64)

        self.powers = powers(base)
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * powers(pow(base, -1, 1 << 64))[:-1], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.powers[end]


def recompress(h: np.ndarray, gap: np.ndarray, rounds: int = ROUNDS):
    """Symbols after ``rounds``: names and support (start, end) in words; ``gap`` marks the places between texts.

    ``h`` begins and ends with a gap; gaps never join a run or a pair.
    """
    sym = h.copy()
    sym[gap] = _mix(np.arange(len(h), dtype=np.uint64) + np.uint64(1))[gap]
    wall = gap.copy()
    start = np.arange(len(h))
    end = start + 1
    low, high = start.copy(), end.copy()
    for r in range(rounds):
        # runs
        first = np.flatnonzero(np.concatenate(([True], (sym[1:] != sym[:-1]) | wall[1:] | wall[:-1])))
        count = np.diff(np.append(first, len(sym)))
        last = first + count - 1
        s, e = start[first], end[last]
        before, after = np.maximum(first - 1, 0), np.minimum(last + 1, len(sym) - 1)
        # the neighbour is another symbol: one differing word shows it, else its own support does
        left = np.where(h[np.maximum(s - 1, 0)] != h[e - 1], s - 1, low[before])
        right = np.where(h[np.minimum(e, len(h) - 1)] != h[s], e + 1, high[after])
        low, high = np.minimum(low[first], np.maximum(left, 0)), np.maximum(high[last], np.minimum(right, len(h)))
        sym = np.where(count > 1, _mix(sym[first] + count.astype(np.uint64) * np.uint64(BASES[0])), sym[first])
        start, end, wall = s, e, wall[first]
        # pairs
        right_class = ((_mix(sym + np.uint64(r + 1)) >> np.uint64(17)) & np.uint64(1)).astype(bool)
        joins = np.zeros(len(sym), bool)
        joins[:-1] = ~right_class[:-1] & right_class[1:] & ~wall[:-1] & ~wall[1:]
        joined = np.concatenate(([False], joins[:-1]))
        nxt, prv = np.minimum(np.arange(len(sym)) + 1, len(sym) - 1), np.maximum(np.arange(len(sym)) - 1, 0)
        # what stays alone does so because of its right (left class) or left (right class) neighbour
        other = np.where(joins | ~right_class, nxt, prv)
        low2, high2 = np.minimum(low, low[other]), np.maximum(high, high[other])
        sym = np.where(joins, _mix(sym * np.uint64(BASES[1]) + _mix(sym[nxt] + np.uint64(BASES[0]))), sym)
        end = np.where(joins, end[nxt], end)
        keep = ~joined
        sym, start, end, low, high, wall = sym[keep], start[keep], end[keep], low2[keep], high2[keep], wall[keep]
    return sym, low, high, wall


def spread_minimum(first: np.ndarray, last: np.ndarray, key: np.ndarray, size: int, longest: int) -> np.ndarray:
    """At every place the least key of the ranges (``first`` to ``last``, at most ``longest`` places) that hold it, else NONE."""
    step = _step(last - first + 1)
    best = np.full(size, NONE)
    for k in range(int(longest).bit_length() - 1, -1, -1):   # best: of ranges of 2 << k places from there, then of 1 << k
        half = 1 << k
        if 2 * half <= size:
            best[half:] = np.minimum(best[half:], best[:-half])
        some = np.flatnonzero(step == k)
        np.minimum.at(best, first[some], key[some])
        np.minimum.at(best, last[some] - half + 1, key[some])
    return best


def range_maximum(first: np.ndarray, last: np.ndarray, value: np.ndarray, longest: int) -> np.ndarray:
    """The greatest value of each range (``first`` to ``last``, at most ``longest`` places)."""
    step = _step(last - first + 1)
    out, most = np.zeros(len(first), value.dtype), value
    for k in range(int(longest).bit_length()):   # most: of 1 << k places from there
        half = 1 << k
        some = np.flatnonzero(step == k)
        out[some] = np.maximum(most[first[some]], most[last[some] - half + 1])
        if 2 * half > len(value):
            break
        most = np.maximum(most[:-half], most[half:])
    return out


def _step(length: np.ndarray) -> np.ndarray:
    """The greatest k with 1 << k places in a range."""
    return np.frexp(length.astype(np.float64))[1] - 1


class Windows:
    """The windows of a batch of texts: where they start and the hashes of their words."""

    def __init__(self, hashes: list[np.ndarray], window: int):
        none = np.zeros(1, np.uint64)
        self.h = np.concatenate([x for part in hashes for x in (none, part)] + [none])
        self.sizes = np.array([len(x) for x in hashes], np.int64)
        self.begin = np.cumsum(self.sizes + 1) - self.sizes  # of each text's words
        self.window = window
        per = np.maximum(self.sizes - window + 1, 0)
        self.owner = np.repeat(np.arange(len(per)), per)
        self.first = np.cumsum(per) - per  # of each text's windows
        self.place = np.arange(per.sum()) - np.repeat(self.first, per)
        self.starts = self.place + np.repeat(self.begin, per)
        self.segments = Segments(self.h, BASES[0])

    def window_hashes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = self.starts[which]
        second = Segments(self.h, BASES[1]).of(s, s + self.window)
        return _mix(self.segments.of(s, s + self.window)), (_mix(second) >> np.uint64(33)).astype(np.int32)

    def words_of_bits(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, number and bits of every 64 windows of which ``mask`` holds any."""
        if not len(mask):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        word = self.place >> 6
        new = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (self.owner[1:] != self.owner[:-1]))))
        bits = np.add.reduceat(mask.astype(np.uint64) << (self.place & 63).astype(np.uint64), new)
        some = bits != 0
        return self.owner[new][some], word[new][some], bits[some]

    def mask_of(self, words: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The mask whose bits are ``words`` (numbers and bits, for each text)."""
        mask = np.zeros(len(self.starts), bool)
        if words:
            begin = np.repeat(self.first, [len(number) for number, _ in words])
            number = np.concatenate([number for number, _ in words]).astype(np.int64)
            bits = np.concatenate([bits for _, bits in words]).astype("<i8")
            word, bit = np.nonzero(np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            mask[begin[word] + 64 * number[word] + bit] = True
        return mask


class Parsed(Windows):
    """Windows with their anchors and the anchors' places."""

    def __init__(self, hashes: list[np.ndarray], window: int, rounds: int):
        super().__init__(hashes, window)
        gap = np.ones(len(self.h), bool)
        for b, n in zip(self.begin, self.sizes):
            gap[b:b + n] = False
        name, low, high, wall = recompress(self.h, gap, rounds)
        gaps = np.concatenate(([0], np.cumsum(gap)))
        usable = ~wall & (gaps[high] == gaps[low]) & (high - low <= window)
        low, high = low[usable], high[usable]
        key = _mix(self.segments.of(low, high) ^ _mix(name[usable]))
        key[key == NONE] = 0
        first = np.maximum(high - window, 0)   # the windows that hold a support begin there to ``low``
        best = spread_minimum(first, low, key, len(self.h) + 1, window)
        starts = np.zeros(len(self.h) + 2, np.int64)
        starts[self.starts + 1] = 1
        starts = np.cumsum(starts)
        at_starts = np.zeros(len(self.h) + 1, np.uint64)
        at_starts[self.starts] = best[self.starts]
        # no key of a range is above its own there
        chosen = (starts[low + 1] > starts[first]) & (range_maximum(first, low, at_starts, window) == key)
        self.anchor = best[self.starts]
        self.keys, at = key[chosen], low[chosen]
        self.key_owner = np.searchsorted(self.begin, at, "right") - 1

    def compared(self, unique: np.ndarray) -> np.ndarray:
        """Which windows are not proven unique by the (sorted) anchors that occur once."""
        if not len(unique):
            return np.ones(len(self.starts), bool)
        at = np.minimum(np.searchsorted(unique, self.anchor), len(unique) - 1)
        return (unique[at] != self.anchor) | (self.anchor == NONE)


def _batches(batches: Iterator[pa.RecordBatch], text_at: int, keep_words: bool = False):
    """(rows, their words if kept, their hashes): whole texts, about PARSE_WORDS words at a time."""
    rows, words, hashes, held = [], [], [], 0
    for batch in batches:
        others = [batch.column(k) for k in range(batch.num_columns) if k != text_at]
        for i, text in enumerate(batch.column(text_at)):
            ws = text.as_py().split()  # of bytes: \x20 \x09-\x0D
            rows.append([c[i] for c in others])
            if keep_words:
                words.append(ws)
            hashes.append(word_hashes(ws))
            held += len(ws)
            if held >= PARSE_WORDS:
                yield rows, words, hashes
                rows, words, hashes, held = [], [], [], 0
    if rows:
        yield rows, words, hashes


def _least_equal(owner: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first entry that equals each in (owner, a, b); ``a`` alone tells nearly all apart."""
    order = np.argsort(a)
    o, x, y = owner[order], a[order], b[order]
    run = np.concatenate(([True], x[1:] != x[:-1]))[:len(order)]
    new = run.copy()
    new[1:] |= (o[1:] != o[:-1]) | (y[1:] != y[:-1])
    mixed = np.logical_or.reduceat(new & ~run, np.flatnonzero(run))[np.cumsum(run) - 1] if len(order) else run
    if mixed.any():   # only these are sorted by all three
        at = np.flatnonzero(mixed)
        part = np.lexsort((y[at], o[at], x[at]))
        order[at] = order[at][part]
        o, x, y = owner[order], a[order], b[order]
        new[1:] = (x[1:] != x[:-1]) | (o[1:] != o[:-1]) | (y[1:] != y[:-1])
    least = np.empty(len(order), np.int64)
    if len(order):
        least[order] = np.minimum.reduceat(order, np.flatnonzero(new))[np.cumsum(new) - 1]
    return least


def _firsts(owner: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which entries are the first of their (owner, a, b)."""
    return _least_equal(owner, a, b) == np.arange(len(a))


def _list_values(cell) -> np.ndarray:
    return cell.values.to_numpy(zero_copy_only=False) if cell.is_valid else np.empty(0, np.int64)


#: Spark deletes the shuffle files of a finished execution
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_cleaned(spark: SparkSession):
    """Stages written here leave no shuffle files behind; what reads them reads the written tables."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def remove_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) of every row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("did"),
                       text_bytes(F.col("text")).alias("text"))
    rows = rows.withColumn("rk", F.xxhash64("did", "text"))
    with _shuffles_cleaned(spark):
        info = materialize(_unique_anchors(rows, window, rounds), "anchors-once")
        least = _least_windows(rows, info, window, rounds)
    return _cut(rows, least, window, keep_text)


def _unique_anchors(rows: DataFrame, window: int, rounds: int) -> DataFrame:
    """rk, the row's anchors that occur once in the corpus, and whether other texts share its doc_id."""
    def anchors(batches):
        for got, _, hashes in _batches(batches, 1):
            p = Parsed(hashes, window, rounds)
            rk = np.array([r[0].as_py() for r in got], np.int64)
            if len(p.keys):
                yield pa.RecordBatch.from_arrays([pa.array(p.keys.view(np.int64)), pa.array(rk[p.key_owner])], names=["k", "rk"])

    once = rows.select("rk", "text").mapInArrow(anchors, "k bigint, rk bigint").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("rk").alias("rk")).where("n = 1")
    ids = materialize(rows.select("did", "rk"), "row-keys")
    shared = ids.groupBy("did").agg(F.min("rk").alias("lo"), F.max("rk").alias("hi")).where("lo < hi").select(F.col("did").alias("of"))
    marks = ids.join(shared, F.col("did") == F.col("of")).select(F.lit(None).cast("bigint").alias("k"), "rk").distinct()
    # a text's own anchors
    return once.select("k", "rk").unionAll(marks).groupBy("rk").agg(F.collect_list("k").alias("once"), F.max(F.col("k").isNull()).alias("many")).withColumnRenamed("rk", "of")


def _compared(rows: DataFrame, info: DataFrame, window: int, rounds: int) -> DataFrame:
    """Rows of two kinds: a window to compare (a, b, did) and, with b < 0, 64 bits of which windows of row ``a`` are compared.

    did is in d1 for rows whose doc_id other texts share, else in d0.
    """
    def windows(batches):
        for got, _, hashes in _batches(batches, 2):
            p = Parsed(hashes, window, rounds)
            unique = np.sort(np.concatenate([_list_values(r[2]) for r in got]).view(np.uint64))
            mask = p.compared(unique)
            which = np.flatnonzero(mask)
            a, b = p.window_hashes(which)
            own = p.owner[which]
            first = _firsts(own, a, b)
            did, rk = (np.array([r[k].as_py() for r in got], np.int64) for k in (0, 1))
            many = np.array([bool(r[3].as_py()) for r in got])
            owner, word, bits = p.words_of_bits(mask)
            holder = np.concatenate((own[first], owner))
            if len(holder):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((a[first].view(np.int64), rk[owner]))), pa.array(np.concatenate((b[first], -1 - word)).astype(np.int32)),
                     pa.array(did[holder], mask=many[holder]), pa.array(did[holder], mask=~many[holder]),
                     pa.array(np.concatenate((np.zeros(int(first.sum()), np.int64), bits.view(np.int64))))], names=["a", "b", "d0", "d1", "w"])

    known = rows.join(info, F.col("rk") == F.col("of"), "left")
    return known.select("did", "rk", "text", "once", "many").mapInArrow(windows, "a bigint, b int, d0 bigint, d1 bigint, w bigint")


def _least_windows(rows: DataFrame, info: DataFrame, window: int, rounds: int) -> DataFrame:
    """of (a row's rk), its compared windows as bits (word, bits), and those of which its doc_id is the least holder (la, lb)."""
    least = _compared(rows, info, window, rounds).groupBy("a", "b").agg(F.min("d0").alias("d0"), F.min("d1").alias("d1"), F.max("w").alias("w"))
    shared = info.where("many").select("of")
    some_share = not shared.isEmpty()
    if some_share:
        least = materialize(least, "windows-all")
    is_window = F.col("b") >= 0
    ours = F.col("d1").isNotNull() & (F.col("d0").isNull() | (F.col("d1") < F.col("d0")))   # the least holder shares its doc_id with other texts
    nothing = F.lit(None)
    # rows that share a doc_id are grouped by their own key, the others by their doc_id, which names one text
    row_of = F.when(F.col("d1").isNotNull(), F.col("a")).otherwise(0)
    parts = least.where(~is_window | ~ours).select(
        F.coalesce("d0", "d1").alias("did"), F.when(is_window, 0).otherwise(row_of).alias("r"), F.when(~is_window, F.col("a")).alias("rk"),
        F.when(is_window, F.col("a")).alias("a"), F.when(is_window, F.col("b")).alias("b"),
        F.when(~is_window, -1 - F.col("b")).alias("word"), F.when(~is_window, F.col("w")).alias("bits"))
    if some_share:
        held = rows.join(shared, F.col("rk") == F.col("of"), "left_semi")
        own = materialize(_held_windows(held, info, window, rounds), "windows-shared").select(F.col("a").alias("ha"), F.col("b").alias("hb"), "did", "rk")
        found = least.where(is_window & ours).join(own, (F.col("a") == F.col("ha")) & (F.col("b") == F.col("hb")) & (F.col("d1") == F.col("did")))
        parts = parts.unionAll(found.select("did", F.col("rk").alias("r"), nothing.cast("bigint").alias("rk"), "a", "b",
                                            nothing.cast("int").alias("word"), nothing.cast("bigint").alias("bits")))
    # the windows of one text
    lists = parts.groupBy("did", "r").agg(F.max("rk").alias("of"), F.collect_list("a").alias("la"), F.collect_list("b").alias("lb"),
                                          F.collect_list("word").alias("word"), F.collect_list("bits").alias("bits"))
    return materialize(lists.drop("did", "r"), "windows-least")


def _held_windows(rows: DataFrame, info: DataFrame, window: int, rounds: int) -> DataFrame:
    """a, b, did and rk of the compared windows of rows that share their doc_id."""
    def windows(batches):
        for got, _, hashes in _batches(batches, 2):
            p = Parsed(hashes, window, rounds)
            which = np.flatnonzero(p.compared(np.sort(np.concatenate([_list_values(r[2]) for r in got]).view(np.uint64))))
            a, b = p.window_hashes(which)
            own = p.owner[which]
            first = _firsts(own, a, b)
            did, rk = (np.array([r[k].as_py() for r in got], np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a[first].view(np.int64)), pa.array(b[first]), pa.array(did[own[first]]), pa.array(rk[own[first]])],
                                             names=["a", "b", "did", "rk"])

    known = rows.dropDuplicates(["rk"]).join(info, F.col("rk") == F.col("of"), "left")
    return known.select("did", "rk", "text", "once").mapInArrow(windows, "a bigint, b int, did bigint, rk bigint")


def _cut(rows: DataFrame, least: DataFrame, window: int, keep_text: bool) -> DataFrame:
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept_text string" if keep_text else "")

    def cut(batches):
        for got, words, hashes in _batches(batches, 1, keep_words=True):
            p = Windows(hashes, window)
            mask = p.mask_of([(_list_values(r[3]), _list_values(r[4])) for r in got])
            which = np.flatnonzero(mask)
            a, b = p.window_hashes(which)
            # the windows of which a row's document is the least holder, as (row, a, b)
            lists = [(_list_values(r[1]), _list_values(r[2])) for r in got]
            size = [len(x) for x, _ in lists]
            own = np.concatenate((np.repeat(np.arange(len(got)), size), p.owner[which]))
            ka = np.concatenate([x for x, _ in lists] + [a.view(np.int64)]).view(np.uint64)
            kb = np.concatenate([y for _, y in lists] + [b]).astype(np.int32)
            stays = _listed(own, ka, kb, sum(size))[sum(size):] & _firsts(p.owner[which], a, b)
            gone = which[~stays]
            edge = np.zeros(len(p.h) + 1, np.int64)
            np.add.at(edge, p.starts[gone], 1)
            np.add.at(edge, p.starts[gone] + window, -1)
            removed = np.cumsum(edge) > 0
            out = []
            for i, ws in enumerate(words):
                drop = removed[p.begin[i]:p.begin[i] + len(ws)]
                n = int(drop.sum())
                kept = b" ".join(ws if not n else [w for w, d in zip(ws, drop.tolist()) if not d])
                out.append((got[i][0].as_py(), len(ws), n, hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "replace")] if keep_text else [])))
            names = [c.split()[0] for c in schema.split(", ")]
            types = [pa.int64()] * 3 + [pa.string()] * (len(names) - 3)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    final = rows.join(least, F.col("rk") == F.col("of"), "left")
    return final.select("doc_id", "text", "la", "lb", "word", "bits").mapInArrow(cut, schema)


def _listed(owner: np.ndarray, a: np.ndarray, b: np.ndarray, lists: int) -> np.ndarray:
    """Which entries have an equal (owner, a, b) among the first ``lists`` entries."""
    return _least_equal(owner, a, b) < lists


def op6_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
     s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS beg FROM t WHERE len(ws) >= 20),
     w AS (SELECT doc_id, beg, md5(array_to_string(ws[beg:beg + 19], ' ')) AS h FROM s),
     d AS (SELECT doc_id, beg FROM (SELECT doc_id, beg, row_number() OVER (PARTITION BY h ORDER BY doc_id, beg) AS r FROM w) WHERE r > 1),
     c AS (SELECT DISTINCT doc_id, unnest(range(beg, beg + 20)) AS pos FROM d),
     p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM t WHERE len(ws) > 0),
     k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM p ANTI JOIN c USING (doc_id, pos) GROUP BY doc_id)
SELECT t.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN k USING (doc_id)
"""
