"""Periodic runs of words by recursive frequency splitting.

A run is a stretch of words of one text that repeats with a smallest period, is at least ``MIN_LENGTH`` words and two periods
long, and ends where the repetition ends.

Splitting: each word of a run occurs at least twice in it, so in a segment of a text a word that occurs once is in
no run of the segment and splits it, and so does the end of the text.  Parts shorter than a run go.  In a smaller
segment more words occur once; the segments of all texts of a batch are split together until none changes.

Lag scan of the surviving segments: a run of period q is a stretch of at least max(MIN_LENGTH - q, q) places whose word equals the one
q places on.  Small lags compare every place.  A stretch of a larger lag q is at least q long, so it holds a multiple of q, and half a lag of
equal words on one side of it: only the multiples of each lag are looked at (about m log m in a segment of m words), by the
hash of the half lag on either side.  Stretches grow from there to their ends by comparing hashes of doubling and halving lengths,
and every run is at last compared word by word; words are compared by their numbers in a dictionary of the batch, never by a hash.
Equal stretches have equal hashes, so hashes lose no run; a segment where different words had one hash is compared place by place.

The rows are never shuffled and a text is bounded only by a worker's memory.

Defined cases: a null text has no words; texts without a run have nulls for the longest run, the digest of the empty
text for the list of runs, and keep all words; null and repeated doc_ids are kept row by row; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import table, text_bytes

MIN_LENGTH = 12
#: lags up to this compare every place
SMALL_LAG = 16
#: words of texts looked at together (a longer text alone), and places of larger lags looked at together
BATCH_WORDS = 1 << 18
PLACES = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
WS = r"\x20\x09-\x0D"


def split_segments(ids: np.ndarray, begin: np.ndarray, size: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the segments that survive: no word occurs once in its own, none is shorter than ``min_length``.

    ``ids`` are the words' numbers; ``begin`` and ``size`` the texts in it, which are the first segments.
    """
    done_start, done_size = [], []
    while len(begin):
        long = size >= min_length
        begin, size = begin[long], size[long]
        owner = np.repeat(np.arange(len(size)), size)
        first = np.cumsum(size) - size
        place = np.arange(size.sum()) - first[owner] + begin[owner]
        # occurrences of each word in its own segment
        key = owner * (int(ids.max(initial=0)) + 1) + ids[place]
        order = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])) if len(order) else np.zeros(0, bool))
        count = np.diff(np.append(new, len(order)))
        rare = np.zeros(len(key), bool)
        rare[order[new[count < 2]]] = True
        broken = np.zeros(len(size), bool)
        broken[owner[rare]] = True
        done_start.append(begin[~broken])
        done_size.append(size[~broken])
        # the stretches between the rare words of the broken segments
        stays = ~rare & broken[owner]
        opens = stays & np.concatenate(([True], ~stays[:-1] | (owner[1:] != owner[:-1])))[:len(stays)]
        closes = stays & np.concatenate((~stays[1:] | (owner[1:] != owner[:-1]), [True]))[:len(stays)]
        begin = place[opens]
        size = place[closes] - begin + 1
    start = np.concatenate(done_start) if done_start else np.zeros(0, np.int64)
    length = np.concatenate(done_size) if done_size else np.zeros(0, np.int64)
    order = np.argsort(start, kind="stable")
    return start[order], length[order]


class _Hashes:
    """Hashes of any stretch of the words, from one prefix sum."""

    def __init__(self, ids: np.ndarray):
        x = ids.astype(np.uint64) + np.uint64(1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        steps = np.full(len(ids) + 1, MIX, np.uint64)
        steps[0] = 1
        self.power = np.cumprod(steps, dtype=np.uint64)
        back = np.full(len(ids) + 1, np.uint64(pow(int(MIX), -1, 1 << 64)))
        back[0] = 1
        self.sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(x * np.cumprod(back, dtype=np.uint64)[:-1], dtype=np.uint64, out=self.sums[1:])

    def same(self, at: np.ndarray, lag: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the ``n`` words from ``at`` and from ``at + lag`` have equal hashes."""
        near = self.sums[at + n] - self.sums[at]
        far = self.sums[at + lag + n] - self.sums[at + lag]
        return near == far * self.power[lag]


def _grow(same, room: np.ndarray) -> np.ndarray:
    """The greatest n <= room with same(n, which), for a test that holds for all smaller n."""
    n = np.zeros(len(room), np.int64)
    step = 1 << max(0, int(room.max(initial=0)).bit_length() - 1)
    while step:
        fits = np.flatnonzero(n + step <= room)
        fits = fits[same(n[fits] + step, fits)]
        n[fits] += step
        step >>= 1
    return n


def _small_lags(ids: np.ndarray, segment: np.ndarray, lags: range, min_length: int):
    """(start, end, lag) of the stretches of runs at small lags: every place is compared; ``segment`` is -1 outside the segments."""
    for q in lags:
        if q >= len(ids):
            return
        equal = np.zeros(len(ids) - q + 2, np.int8)
        equal[1:-1] = (ids[q:] == ids[:-q]) & (segment[q:] == segment[:-q]) & (segment[q:] >= 0)
        turn = np.diff(equal)
        start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        enough = end - start >= max(min_length - q, q)
        yield start[enough], end[enough] + q, np.full(int(enough.sum()), q, np.int64)


def _places(start: np.ndarray, size: np.ndarray, first_lag: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of (segment, lag, place): the multiples of each larger lag in each segment, about PLACES at a time."""
    for s in np.flatnonzero(size >= 2 * first_lag):
        lag = np.arange(first_lag, size[s] // 2 + 1)
        per = size[s] // lag
        edge = np.searchsorted(np.cumsum(per), np.arange(0, int(per.sum()) + PLACES, PLACES)[1:], "left") + 1
        lo = 0
        for hi in np.unique(np.minimum(edge, len(lag))):
            q = np.repeat(lag[lo:hi], per[lo:hi])
            k = np.arange(len(q)) - np.repeat(np.cumsum(per[lo:hi]) - per[lo:hi], per[lo:hi])
            yield np.full(len(q), s), q, start[s] + k * q
            lo = hi


def _merged(blocks: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    held, rows = [], 0
    for block in blocks:
        held.append(block)
        rows += len(block[0])
        if rows >= PLACES:
            yield tuple(np.concatenate(c) for c in zip(*held))
            held, rows = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def _large_lags(ids: np.ndarray, start: np.ndarray, size: np.ndarray, first_lag: int):
    """(start, end, lag) of the runs at larger lags, from the multiples of each lag."""
    if not (size >= 2 * first_lag).any():
        return
    hashes = _Hashes(ids)
    for seg, q, at in _merged(_places(start, size, first_lag)):
        lo, hi = start[seg], start[seg] + size[seg] - q  # places that have a partner
        at_end = at >= hi
        equal = np.zeros(len(at), bool)
        equal[~at_end] = ids[at[~at_end]] == ids[(at + q)[~at_end]]
        seg, q, at, lo, hi = (x[equal] for x in (seg, q, at, lo, hi))
        half = q // 2
        right = at + half <= hi
        right[right] = hashes.same(at[right], q[right], half[right])
        left = at - half >= lo
        left[left] = hashes.same((at - half)[left], q[left], half[left])
        q, at, lo, hi = (x[left | right] for x in (q, at, lo, hi))
        end = at + _grow(lambda n, i: hashes.same(at[i], q[i], n), hi - at)
        begin = at - _grow(lambda n, i: hashes.same(at[i] - n, q[i], n), at - lo)
        enough = end - begin >= q
        yield begin[enough], (end + q)[enough], q[enough]


def _smallest(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """The smallest lag of each stretch: multiples of a run's period find the same one."""
    s, e, q = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    first = np.concatenate(([True], (s[1:] != s[:-1]) | (e[1:] != e[:-1])))[:len(s)]
    return s[first], e[first], q[first]


def find_runs(ids: np.ndarray, begin: np.ndarray, size: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs of the texts (``begin``, ``size``) in ``ids``, by start and period."""
    start, length = split_segments(ids, begin, size, min_length)
    segment = np.full(len(ids), -1, np.int64)
    for i, (s, n) in enumerate(zip(start.tolist(), length.tolist())):
        segment[s:s + n] = i
    # only the segments are scanned, one after the other with a gap between them
    place = np.flatnonzero(segment >= 0)
    compact, owner = ids[place], segment[place]
    at = np.cumsum(length) - length
    last = min(SMALL_LAG, int(length.max(initial=0)) // 2)
    found = list(_small_lags(compact, owner, range(1, last + 1), min_length))
    # a larger lag must reach its own length before min_length decides
    found += list(_large_lags(compact, at, length, max(SMALL_LAG, min_length // 2) + 1))
    for q in range(SMALL_LAG + 1, min_length // 2 + 1):
        found += list(_small_lags(compact, owner, range(q, q + 1), min_length))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    s, e, q = _smallest(found)
    false = [a for a, b, lag in zip(s.tolist(), e.tolist(), q.tolist()) if not np.array_equal(compact[a:b - lag], compact[a + lag:b])]
    if false:  # different words of one hash: their segments are compared place by place
        again = np.unique(owner[false])
        stays = ~np.isin(owner[s], again)
        for i in np.flatnonzero(np.isin(np.arange(len(start)), again)):
            part = slice(at[i], at[i] + length[i])
            exact = _small_lags(compact[part], owner[part], range(1, int(length[i]) // 2 + 1), min_length)
            s, e, q = (np.concatenate(c) for c in zip((s[stays], e[stays], q[stays]), *((a + at[i], b + at[i], lag) for a, b, lag in exact)))
            stays = np.ones(len(s), bool)
        s, e, q = _smallest([(s, e, q)])
    shift = (place[s] - s) if len(s) else s
    order = np.lexsort((q, s))
    return (s + shift)[order], (e + shift)[order], q[order]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[bytes]]]]:
    """(doc_ids, words) of whole texts, about BATCH_WORDS words at a time."""
    ids, words, held = [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0), batch.column(1)):
            ws = text.as_py().split()  # of bytes: \x20 \x09-\x0D
            ids.append(i.as_py())
            words.append(ws)
            held += len(ws)
            if held >= BATCH_WORDS:
                yield ids, words
                ids, words, held = [], [], 0
    if ids:
        yield ids, words


SCHEMA = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
DETAILS = "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, details: bool = True) -> DataFrame:
    """Every row's runs and its longest run; with ``details`` also the list of runs and the text with each run cut to its first period."""
    columns = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    fields = [(c, pa.int64()) for c in columns[:6]] + [(c, pa.string()) for c in columns[6:]]
    if details:
        fields += [("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())]
    schema = pa.schema(fields)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, words in _texts(batches):
            number: dict[bytes, int] = {}
            size = np.array([len(ws) for ws in words], np.int64)
            ids = np.fromiter((number.setdefault(w, len(number)) for ws in words for w in ws), np.int64, int(size.sum()))
            begin = np.cumsum(size) - size
            s, e, q = find_runs(ids, begin, size, min_length)
            owner = np.searchsorted(begin + size, s, "right")
            edge = np.zeros(len(ids) + 1, np.int64)
            np.add.at(edge, s + q, 1)
            np.add.at(edge, e, -1)
            dropped = np.cumsum(edge) > 0
            bounds = np.searchsorted(owner, np.arange(len(words) + 1))
            out = []
            for i, ws in enumerate(words):
                b = int(begin[i])
                here = slice(bounds[i], bounds[i + 1])
                runs = list(zip((s[here] - b).tolist(), (e[here] - s[here]).tolist(), q[here].tolist()))
                if runs:
                    ws = [w for w, d in zip(ws, dropped[b:b + len(ws)].tolist()) if not d]
                kept = b" ".join(ws)
                longest = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
                listed = "".join(f"{a},{n},{p}\n" for a, n, p in runs)
                more = ([dict(zip(("start", "length", "period"), r)) for r in runs], kept.decode("utf-8", "replace")) if details else ()
                out.append((doc_ids[i], len(runs), *longest, 1000 * longest[1] // longest[2] if runs else None,
                            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), *more))
            yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(k).type) for k, c in enumerate(zip(*out))], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes(F.col("text")).alias("text")).mapInArrow(scan, f"{SCHEMA}, {DETAILS}" if details else SCHEMA)


def with_repeats(docs: DataFrame) -> DataFrame:
    """The query's input: texts whose doc_id has a hash of 0 (mod 10) repeat from one of their words on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), f"[{WS}]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words).alias("w"))
    n = F.size("w")
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    period = (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    rows = rows.withColumn("p", F.when(F.col("a").isNotNull(), period))
    times = F.ceil((n - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), times)), F.lit(1), n - F.col("a"))
    repeated: Column = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document of its (for some doc_ids repeated) text; a null doc_id leaves the text as it is."""
    return periodic_runs(with_repeats(table(spark, sf_dir, "documents")), details=False)
