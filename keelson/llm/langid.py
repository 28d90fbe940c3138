"""Language identification with a byte convolutional network.

Every text, whole, is cut into windows of ``WINDOW`` UTF-8 bytes (the last one ends with the text and is padded if the
text is shorter).  Filters of several widths slide over a window's bytes; max pooling keeps each filter's
strongest answer, and a softmax layer turns the pooled answers into language scores.  A text's score is
the softmax of its windows' mean logits, weighted by their bytes.  The network is trained in numpy by
backpropagation on windows of a bounded sample: ``SAMPLE_PER_LANG`` labelled texts of each language in expectation (a
hash threshold, so any number of rows gives the same sample size) and at most ``WINDOWS_PER_TEXT`` windows of each.

Defined cases: null texts and texts without a letter are ``und`` with score 0; with no usable label every text is
``und``; a null doc_id counts as the empty id in the fold; repeated rows are predicted alike, one row each; of languages with equal
scores the first by name is taken; a very long text is read in blocks of windows, whole; an empty table gives no rows;
extra columns, also with the names of result columns, are ignored; lang, source and doc_id are never inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import drop_rows, materialize, table, text_bytes, text_key

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
SAMPLE_PER_LANG = 400
WINDOWS_PER_TEXT = 4
EPOCHS = 12
BATCH = 128
RATE = 0.02
SEED = 42
UNDETERMINED = "und"
#: a text whose best language is less likely than this is rejected by the filter
MIN_SCORE = 0.5
#: windows pushed through the network at once: bounds the memory that a very long text takes
BLOCK = 256


#: by filter width: (offset, answers by byte or by byte pair)
Tables = dict[int, list[tuple[int, np.ndarray]]]


@dataclass
class Network:
    """filters[w][k] holds the answer of each filter of width w to each byte value at offset k."""
    langs: list[str]
    filters: dict[int, np.ndarray]  # width -> (width, 256, FILTERS)
    bias: np.ndarray  # (len(WIDTHS) * FILTERS,)
    dense: np.ndarray  # (len(WIDTHS) * FILTERS, langs)
    out_bias: np.ndarray

    def single(self) -> Tables:
        """Answers to single bytes: what training changes."""
        return {w: [(k, f[k]) for k in range(w)] for w, f in self.filters.items()}

    def tables(self) -> Tables:
        """Answers to byte pairs, so that a width-w filter costs ceil(w / 2) look-ups a position."""
        return {w: [(k, (f[k][:, None, :] + f[k + 1][None, :, :]).reshape(65536, -1) if k + 1 < w else f[k]) for k in range(0, w, 2)]
                for w, f in self.filters.items()}


def _pool(windows: np.ndarray, tables: Tables, arg: bool = False):
    """Max-pooled answers of the windows (n, WINDOW) uint8, and where each was found if ``arg``."""
    codes = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
    pooled, places = [], []
    for width, tabs in tables.items():
        n = windows.shape[1] - width + 1
        answer = None
        for k, tab in tabs:
            got = tab.take(codes[:, k:k + n] if len(tab) > 256 else windows[:, k:k + n], axis=0)
            answer = got if answer is None else np.add(answer, got, out=answer)
        if arg:
            places.append(answer.argmax(axis=1))
        pooled.append(answer.max(axis=1))
    return np.concatenate(pooled, axis=1), (np.concatenate(places, axis=1) if arg else None)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], weights: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Fit the network by Adam on windows (n, WINDOW) uint8 and their class numbers."""
    rng = np.random.default_rng(seed)
    p = {w: (rng.normal(0, 0.1, (w, 256, FILTERS))).astype(np.float32) for w in WIDTHS}
    hidden = FILTERS * len(WIDTHS)
    p |= {"bias": np.zeros(hidden, np.float32), "dense": rng.normal(0, 0.2, (hidden, len(langs))).astype(np.float32), "out": np.zeros(len(langs), np.float32)}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    net = Network(langs, {w: p[w] for w in WIDTHS}, p["bias"], p["dense"], p["out"])
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            pick = order[at:at + BATCH]
            x, y, weight = windows[pick], labels[pick], weights[pick]
            raw, place = _pool(x, net.single(), arg=True)
            h = np.maximum(raw + p["bias"], 0)
            g = _softmax(h @ p["dense"] + p["out"])
            g[np.arange(len(y)), y] -= 1
            g *= (weight / weight.sum())[:, None]
            grads = {"dense": h.T @ g, "out": g.sum(axis=0)}
            back = (g @ p["dense"].T) * (h > 0)
            grads["bias"] = back.sum(axis=0)
            rows = np.arange(len(x))[:, None]
            for i, w in enumerate(WIDTHS):
                d, at_w = back[:, i * FILTERS:(i + 1) * FILTERS], place[:, i * FILTERS:(i + 1) * FILTERS]
                grad = np.zeros_like(p[w])
                for k in range(w):
                    np.add.at(grad[k], (x[rows, at_w + k], np.arange(FILTERS)[None, :]), d)
                grads[w] = grad
            step += 1
            for k, gk in grads.items():
                m[k] += 0.1 * (gk - m[k])
                v[k] += 0.01 * (gk * gk - v[k])
                p[k] -= (RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return net


def cut(text: bytes) -> np.ndarray:
    """The windows of a whole text (n, WINDOW): full ones and one for the rest, zero-padded."""
    n = -(-len(text) // WINDOW)
    return np.frombuffer(text.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def predict(net: Network, texts: list[bytes], tables: Tables) -> np.ndarray:
    """Class probabilities of each (not empty) text, from all its windows."""
    sizes = np.array([len(t) for t in texts], np.int64)
    total = np.zeros((len(texts), len(net.langs)), np.float64)
    windows, owner = [], []
    held = 0

    def flush():
        x, own = np.concatenate(windows), np.concatenate(owner)
        for at in range(0, len(x), BLOCK):
            h = np.maximum(_pool(x[at:at + BLOCK], tables)[0] + net.bias, 0)
            # unit by unit: a matrix product rounds a row by its place in the block, and equal texts have equal scores
            z = sum((h[:, k, None] * net.dense[k] for k in range(h.shape[1])), net.out_bias).astype(np.float64)
            o = own[at:at + BLOCK]
            part = (x[at:at + BLOCK] != 0).sum(axis=1)
            np.add.at(total, o, z * part[:, None])
    for i, text in enumerate(texts):
        x = cut(text)
        windows.append(x)
        owner.append(np.full(len(x), i))
        held += len(x)
        if held >= 4 * BLOCK:
            flush()
            windows, owner, held = [], [], 0
    if held:
        flush()
    return _softmax(total / np.maximum(sizes, 1)[:, None])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def has_letter(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"\p{L}")


def training_sample(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, windows: int = WINDOWS_PER_TEXT) -> pd.DataFrame:
    """(lang, window bytes) of a hash sample of the rows with a label outside the held-out fold.

    The driver gets about per_lang * windows * WINDOW bytes a language, whatever the size of the table.
    """
    usable = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & has_letter(F.col("text"))).select("doc_id", "lang", "text")
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    position = (F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 11) / F.lit(float(1 << 53)))
    chosen = usable.join(F.broadcast(counts), "lang").where(position < F.lit(float(per_lang)) / F.col("rows"))  # a row per language
    size = F.octet_length("b")
    starts = F.transform(F.sequence(F.lit(0), F.lit(windows - 1)),
                         lambda i: F.floor(F.greatest(size - WINDOW, F.lit(0)) * i / max(1, windows - 1)).cast("int"))
    cuts = chosen.select("doc_id", "lang", text_bytes(F.col("text")).alias("b")).select(
        "doc_id", "lang", F.array_distinct(F.transform(starts, lambda s: F.substr(F.col("b"), s + 1, F.lit(WINDOW)))).alias("windows"))
    return cuts.select("doc_id", "lang", F.explode("windows").alias("window")).toPandas()


def fit(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> Network | None:
    """The network learned from ``docs`` (columns doc_id, text, lang), or None without usable labels."""
    sample = training_sample(docs, per_lang)
    if sample.empty:
        return None
    sample = sample.sort_values(["lang", "doc_id", "window"], kind="stable")
    langs = sorted(sample.lang.unique())
    labels = np.searchsorted(langs, sample.lang.to_numpy(dtype=object))
    per_class = np.bincount(labels, minlength=len(langs))
    x = np.concatenate([cut(bytes(w))[:1] for w in sample.window])
    # texts are often shorter than a window: every window is also learned as its first part
    rng = np.random.default_rng(SEED)
    short = x.copy()
    keep = rng.integers(12, WINDOW, len(x))
    short[np.arange(WINDOW)[None, :] >= keep[:, None]] = 0
    weights = (1.0 / per_class[labels]).astype(np.float32)
    return train(np.concatenate((x, short)), np.concatenate((labels, labels)), langs, np.concatenate((weights, weights)))


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, th (the text's key), the predicted language and its probability, for every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), has_letter(F.col("text")).alias("letters"),
                       text_bytes(F.col("text")).alias("b"), text_key().alias("th"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else {}
        for batch in batches:
            letters = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            lang, score = np.full(batch.num_rows, UNDETERMINED, object), np.zeros(batch.num_rows)
            at = np.flatnonzero(letters)
            if net and len(at):
                p = predict(net, [batch.column(2)[int(i)].as_py() for i in at], tables)
                best = p.argmax(axis=1)
                lang[at], score[at] = np.array(net.langs, object)[best], p[np.arange(len(at)), best]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(lang.tolist(), pa.string()), pa.array(score)],
                                             names=["doc_id", "th", "lang_pred", "score"])
    return rows.mapInArrow(run, "doc_id bigint, th string, lang_pred string, score double")


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without the rows that are ``und`` or whose best language has less than ``min_score``."""
    net = fit(docs)
    rejected = identify(docs, net).where((F.col("lang_pred") == UNDETERMINED) | (F.col("score") < min_score))
    return drop_rows(docs, materialize(rejected.select("doc_id", "th").distinct(), "rejected"))


def op5_byte_cnn_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
