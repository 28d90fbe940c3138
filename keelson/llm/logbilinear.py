"""Log-bilinear language model, trained by noise-contrastive estimation, with normalised token probabilities.

Symbols are the end of a text, the most frequent words and ``CLASSES`` classes of all other words (by their last two
bytes).  The representation predicted for the next symbol is bilinear in those of the two symbols before it; its score is the
product with the symbol's own representation, plus a bias.  A word outside the symbols has its class's probability times its own in the class,
from counts with half a count added, so all words together and one unknown word a class have probability 1.

Training: counts cover all training rows.  The network starts as the unigram model (biases; the noise is the unigram
distribution too) and passes once over all training rows, in ``SLICES`` rounds over disjoint slices: in a round each task trains a copy on
its rows, and the copies are averaged by their tokens, block by block in Spark.  What the driver holds is fixed by the
parameters above, whatever the size of the corpus.

Scoring: with two context symbols the sum over all next symbols is the product of a factor of each, so one
matrix product gives the exact normalisers of all pairs of context symbols; a token's log-probability is two look-ups less one.

Counts of words: those with at least one in ``DICTIONARY`` of all tokens are at most ``DICTIONARY`` and are sent to the tasks;
other words are joined by a shuffle, one row per text and word, and no such word has a larger share of the tokens.

Defined cases: a null text counts as empty (its only token is the end); a null doc_id counts as the empty text in the choice of
training rows; rows that repeat a doc_id are scored one by one; without training rows every token is unknown, with base score 0;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import materialize, parallelism, table, text_bytes

SYMBOLS = 1024
CLASSES = 128
DICTIONARY = 1 << 17
DIM = 16
NOISE = 32
BATCH = 2048
SLICES = 3
RATE = 0.2
SEED = 42
#: words counted in a task before their counts are handed on, tokens shuffled together in training, tokens scored together
COUNTED_WORDS = 1 << 17
TRAIN_TOKENS = 1 << 17
SCORE_TOKENS = 1 << 17
#: parameters averaged in one row
BLOCK = 4096
END = 0
HALF = 0.5


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLASSES


class _Outside(dict):
    """-1 less the class, by a word's last two bytes."""

    def __missing__(self, tail: bytes) -> int:
        value = self[tail] = -1 - word_class(tail)
        return value


class Lookup:
    """Numbers of the dictionary's words; a word outside has -1 less its class."""

    def __init__(self, words: list[bytes]):
        self.number = dict(zip(words, range(len(words))))
        self.outside = _Outside()

    def of(self, words: list[bytes]) -> np.ndarray:
        found = np.fromiter(map(self.number.get, words, repeat(-1)), np.int32, len(words))
        missing = np.flatnonzero(found < 0)
        tails = [words[i][-2:] for i in missing.tolist()]
        found[missing] = np.fromiter(map(self.outside.__getitem__, tails), np.int32, len(tails))
        return found


@dataclass
class Vocabulary:
    """Training counts of the dictionary's words (the first are symbols), of the classes and of all tokens."""

    words: list[bytes]
    counts: np.ndarray
    symbols: int  # words that are symbols
    class_tokens: np.ndarray
    class_words: np.ndarray
    ends: int
    tokens: int  # N
    distinct: int  # V

    def symbol_of(self) -> np.ndarray:
        """Symbol of each dictionary word, then of each class from the end (as Lookup numbers them)."""
        of = np.array([1 + word_class(w) for w in self.words] + list(range(CLASSES, 0, -1)), np.int32)
        of[:self.symbols] = 1 + CLASSES + np.arange(self.symbols)
        return of

    def unigram(self) -> np.ndarray:
        """Probability of each symbol, half a count added."""
        c = np.concatenate(([self.ends], self.class_tokens, self.counts[:self.symbols])) + HALF
        return c / c.sum()


@dataclass
class Model:
    """Representations of context symbols (the last is the start of a text) and of predicted ones, position matrices, biases."""

    context: np.ndarray
    position: np.ndarray
    target: np.ndarray
    bias: np.ndarray

    @staticmethod
    def start(vocabulary: Vocabulary, seed: int = SEED) -> Model:
        p = vocabulary.unigram()
        rng = np.random.default_rng(seed)
        return Model(rng.normal(0, 0.3, (len(p) + 1, DIM)).astype(np.float32), np.stack([np.eye(DIM, dtype=np.float32) * 0.5] * 2),
                     np.zeros((len(p), DIM), np.float32), np.log(p).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.context, self.position, self.target, self.bias)])

    def like(self, flat: np.ndarray) -> Model:
        parts, at = [], 0
        for x in (self.context, self.position, self.target, self.bias):
            parts.append(flat[at:at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Model(*parts)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of each next symbol after each last and last but one symbol, and the log normalisers of all pairs."""
        last, before = (self.context @ c @ self.target.T for c in self.position)
        last = last + self.bias
        a, b = last.max(axis=1, keepdims=True), before.max(axis=1, keepdims=True)
        total = np.exp((last - a).astype(np.float64)) @ np.exp((before - b).astype(np.float64)).T
        return last, before, (np.log(total) + a + b.T).astype(np.float32)


def contexts(target: np.ndarray, first: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The last and the last but one symbol before each; ``first`` are the places of the texts' first symbols."""
    last = np.concatenate(([start], target[:-1]))[:len(target)]
    last[first] = start
    before = np.concatenate(([start], last[:-1]))[:len(target)]
    before[first] = start
    return last, before


class Trainer:
    """Noise-contrastive estimation by AdaGrad from a starting model."""

    def __init__(self, model: Model, noise: np.ndarray, seed: list[int]):
        self.m = Model(*(x.copy() for x in (model.context, model.position, model.target, model.bias)))
        self.square = Model(*(np.full_like(x, 1e-2) for x in (model.context, model.position, model.target, model.bias)))
        self.cumulative = np.cumsum(noise)
        self.log_noise = np.log(NOISE * noise).astype(np.float32)
        self.rng = np.random.default_rng(seed)
        self.tokens = 0

    @staticmethod
    def _rows(at: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Different rows and the sums of their gradients."""
        order = np.argsort(at.astype(np.uint16) if at.max() < 1 << 16 else at, kind="stable")   # short numbers are sorted by digits
        at = at[order]
        new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        return at[new], np.add.reduceat(grad[order], new, axis=0)

    def _step(self, param: np.ndarray, square: np.ndarray, at, grad: np.ndarray) -> None:
        square[at] += grad * grad
        param[at] += RATE * grad / np.sqrt(square[at])

    def learn(self, target: np.ndarray, last: np.ndarray, before: np.ndarray) -> None:
        order = self.rng.permutation(len(target))
        self.tokens += len(target)
        for lo in range(0, len(order), BATCH):
            pick = order[lo:lo + BATCH]
            self._batch(target[pick], last[pick], before[pick])

    def _batch(self, w: np.ndarray, last: np.ndarray, before: np.ndarray) -> None:
        m, n = self.m, len(w)
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE)), len(self.cumulative) - 1)
        x, y = m.context[last], m.context[before]
        q = x @ m.position[0] + y @ m.position[1]
        own, other = m.target[w], m.target[noise]
        hit = 1 / (1 + np.exp(np.clip((q * own).sum(axis=1) + m.bias[w] - self.log_noise[w], -30, 30)))
        miss = -1 / (1 + np.exp(np.clip(self.log_noise[noise] - q @ other.T - m.bias[noise], -30, 30)))
        back = (hit[:, None] * own + miss @ other) / n
        hit, miss = hit / n, miss / n
        at, grad = self._rows(np.concatenate((w, noise)), np.concatenate((
            np.column_stack((hit[:, None] * q, hit)), np.column_stack((miss.T @ q, miss.sum(axis=0))))))
        into, slope = self._rows(np.concatenate((last, before)), np.concatenate((back @ m.position[0].T, back @ m.position[1].T)))
        turn = np.stack((x.T @ back, y.T @ back))
        self._step(m.target, self.square.target, at, grad[:, :-1])
        self._step(m.bias, self.square.bias, at, grad[:, -1])
        self._step(m.context, self.square.context, into, slope)
        self._step(m.position, self.square.position, slice(None), turn)


def held_out(doc_id: Column) -> Column:
    return _crc(doc_id) % 5 == 1


def _crc(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def _words(text: pa.Scalar) -> list[bytes]:
    return text.as_py().lower().split()  # of bytes: A-Z; \x20 \x09-\x0D


def word_counts(docs: DataFrame) -> DataFrame:
    """w, k (its class), train and total: tokens of each word in the training rows and in all; the end has the empty word."""
    rows = docs.select(text_bytes(F.col("text")).alias("text"), held_out(F.col("doc_id")).alias("held"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = {False: Counter(), True: Counter()}

        def hand_on():
            words = list(tally[False].keys() | tally[True].keys())
            train, held = (np.fromiter(map(tally[h].get, words, repeat(0)), np.int64, len(words)) for h in (False, True))
            for c in tally.values():
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(train), pa.array(train + held)], names=["w", "train", "total"])
        for batch in batches:
            for text, held in zip(batch.column(0), batch.column(1).to_pylist()):
                ws = _words(text)
                tally[held].update(ws)
                tally[held][b""] += 1
                if len(tally[False]) + len(tally[True]) >= COUNTED_WORDS:
                    yield hand_on()
        yield hand_on()
    counts = rows.mapInArrow(count, "w binary, train bigint, total bigint").groupBy("w").agg(F.sum("train").alias("train"), F.sum("total").alias("total"))
    return counts.select("w", (F.crc32(F.substring("w", -2, 2)) % CLASSES).cast("int").alias("k"), "train", "total")   # word_class


def learn_vocabulary(counts: DataFrame, symbols: int = SYMBOLS, dictionary: int = DICTIONARY) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary and the training counts (w, train) of the words outside its dictionary; ``counts`` is read twice."""
    ends = counts.where(F.octet_length("w") == 0).select("train", "total").first()
    ends_train, ends_total = tuple(ends) if ends else (0, 0)
    words = counts.where(F.octet_length("w") > 0)
    by_class = words.groupBy("k").agg(F.sum("train").alias("train"), F.count_if(F.col("train") > 0).alias("words"), F.sum("total").alias("total")).collect()
    total = ends_total + sum(r.total for r in by_class)
    often = F.col("total") * dictionary >= F.lit(total)  # at most ``dictionary`` words
    known = words.where(often).select("w", "train").toArrow()
    top = sorted(zip((bytes(w) for w in known.column(0).to_pylist()), known.column(1).to_pylist()), key=lambda x: (-x[1], x[0]))
    class_tokens, class_words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in by_class:
        class_tokens[r.k], class_words[r.k] = r.train, r.words
    tokens, distinct = ends_train + int(class_tokens.sum()), (ends_train > 0) + int(class_words.sum())
    chosen = [(w, n) for w, n in top[:max(0, symbols - CLASSES - 1)] if n > 0]
    for w, n in chosen:
        class_tokens[word_class(w)] -= n
        class_words[word_class(w)] -= 1
    vocabulary = Vocabulary([w for w, _ in top], np.array([n for _, n in top], np.int64), len(chosen), class_tokens, class_words,
                            ends_train, tokens, distinct)
    return vocabulary, words.where(~often & (F.col("train") > 0)).select("w", "train")


def _encoded(batches: Iterator[pa.RecordBatch], lookup: Lookup, at_once: int):
    """(columns beside the text, words, dictionary numbers, ends of the texts in them) of about ``at_once`` tokens."""
    others, words, sizes = [], [], []
    for batch in batches:
        for i, text in enumerate(batch.column(0)):
            ws = _words(text)
            others.append(tuple(batch.column(k)[i].as_py() for k in range(1, batch.num_columns)))
            words += ws
            sizes.append(len(ws))
            if len(words) + len(sizes) >= at_once:
                yield others, words, lookup.of(words), np.cumsum(sizes)
                others, words, sizes = [], [], []
    if sizes:
        yield others, words, lookup.of(words), np.cumsum(sizes)


def _with_ends(numbers: np.ndarray, ends: np.ndarray, symbol_of: np.ndarray):
    """Symbols of the texts, each with its end, the places of their first symbols, and of their words."""
    target = np.insert(symbol_of[numbers], ends, END)
    first = np.concatenate(([0], ends[:-1] + np.arange(1, len(ends))))
    at_word = np.ones(len(target), bool)
    at_word[ends + np.arange(len(ends))] = False
    return target, first, at_word


def train(docs: DataFrame, vocabulary: Vocabulary, slices: int = SLICES) -> Model:
    """The model after one pass over the training rows of ``docs``."""
    spark = docs.sparkSession
    noise = vocabulary.unigram()
    model = Model.start(vocabulary)
    symbol_of, start = vocabulary.symbol_of(), len(noise)
    shared = spark.sparkContext.broadcast(vocabulary.words)
    rows = docs.where(~held_out(F.col("doc_id")))
    blocks = parallelism(spark)
    for r in range(slices):
        def learn(batches: Iterator[pa.RecordBatch], r=r, model=model) -> Iterator[pa.RecordBatch]:
            lookup = Lookup(shared.value)
            trainer = Trainer(model, noise, [SEED, r])
            for _, _, numbers, ends in _encoded(batches, lookup, TRAIN_TOKENS):
                target, first, _ = _with_ends(numbers, ends, symbol_of)
                trainer.learn(target, *contexts(target, first, start))
            if trainer.tokens:
                flat = trainer.m.flat()
                parts = [flat[lo:lo + BLOCK].tobytes() for lo in range(0, len(flat), BLOCK)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([float(trainer.tokens)] * len(parts)),
                                                  pa.array(parts, pa.binary())], names=["block", "tokens", "part"])

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, tuple[float, np.ndarray]] = {}
            for batch in batches:
                for block, n, part in zip(*(c.to_pylist() for c in batch.columns)):
                    held, x = sums.get(block, (0.0, 0.0))
                    sums[block] = held + n, x + n * np.frombuffer(part, np.float32).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([(x / n).astype(np.float32).tobytes() for n, x in sums.values()], pa.binary())],
                                             names=["block", "part"])

        part = rows.where(F.floor(_crc(F.col("doc_id")) / 5) % slices == r).select(text_bytes(F.col("text")).alias("text"))
        copies = part.mapInArrow(learn, "block int, tokens double, part binary")
        means = copies.repartition(blocks, "block").mapInArrow(average, "block int, part binary").collect()  # the model, in blocks
        if means:
            model = model.like(np.concatenate([np.frombuffer(m.part, np.float32) for m in sorted(means, key=lambda m: m.block)]))
    return model


def score(docs: DataFrame, vocabulary: Vocabulary, rest: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``."""
    spark = docs.sparkSession
    last, before, normaliser = model.tables()
    symbol_of, start = vocabulary.symbol_of(), len(last) - 1
    base_total = np.log10(vocabulary.tokens + HALF * (vocabulary.distinct + 1))
    class_total = np.log10(vocabulary.class_tokens + HALF * (vocabulary.class_words + 1))
    shared = spark.sparkContext.broadcast((vocabulary.words, last, before, normaliser))
    counts, ends_count, tokens = vocabulary.counts, vocabulary.ends, vocabulary.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, after_last, after_before, log_sums = shared.value
        lookup = Lookup(words)
        # by a word's number; of words outside the dictionary the counts come later
        count_part = np.concatenate((np.log10(counts + HALF), np.zeros(CLASSES)))
        in_class = np.where(symbol_of <= CLASSES, count_part - class_total[np.minimum(symbol_of, CLASSES) - 1], 0.0)
        known = np.concatenate((counts > 0, np.zeros(CLASSES, bool)))
        for others, texts, numbers, ends in _encoded(batches, lookup, SCORE_TOKENS):
            target, first, at_word = _with_ends(numbers, ends, symbol_of)
            one, two = contexts(target, first, start)
            model_part = (after_last[one, target] + after_before[two, target] - log_sums[one, two]).astype(np.float64) / np.log(10)
            model_part[at_word] += in_class[numbers]
            base_part = np.full(len(target), np.log10(ends_count + HALF) - base_total)
            base_part[at_word] = count_part[numbers] - base_total
            is_known = np.full(len(target), ends_count > 0)
            is_known[at_word] = known[numbers]
            n = np.diff(np.append(first, len(target)))
            outside = np.flatnonzero(numbers < 0)
            outside_words = [texts[i] for i in outside.tolist()]
            upto = np.concatenate(([0], np.searchsorted(outside, ends)))   # the words outside in a text and those before
            rare_words, rare_counts, rare_ends = [], [], [0]
            for lo, hi in zip(upto.tolist(), upto[1:].tolist()):
                if hi > lo:
                    c = Counter(outside_words[lo:hi])
                    rare_words += c.keys()
                    rare_counts += c.values()
                rare_ends.append(len(rare_words))
            rare = pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()), pa.array(rare_counts, pa.int64())], names=["w", "n"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in others], pa.int64()), pa.array([o[1] for o in others], pa.int64()), pa.array([o[2] for o in others], pa.bool_()),
                 pa.array(n), pa.array(np.add.reduceat(is_known.astype(np.int64), first)), pa.array(np.add.reduceat(base_part, first)),
                 pa.array(np.add.reduceat(model_part, first)), pa.array(np.diff(upto)),
                 pa.ListArray.from_arrays(pa.array(rare_ends, pa.int32()), rare)],
                names=["doc_id", "rid", "held_out", "n_tokens", "n_known", "base_score", "score", "n_rare", "rare"])

    rows = docs.select(text_bytes(F.col("text")).alias("text"), F.col("doc_id").cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("rid"),
                       held_out(F.col("doc_id")).alias("held_out"))
    part = materialize(rows.mapInArrow(run, "doc_id bigint, rid bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, "
                                            "n_rare bigint, rare array<struct<w:binary,n:bigint>>"), "lm-parts")
    # the words outside the dictionary, a row per text and word
    rare = part.where("n_rare > 0").select("rid", F.inline("rare"))
    found = rare.join(rest.select(F.col("w").alias("word"), "train"), F.col("w") == F.col("word")).groupBy(F.col("rid").alias("row")).agg(
        F.sum("n").alias("seen"), F.sum(F.col("n") * F.log10(F.col("train") + HALF)).alias("logs"))
    seen = F.coalesce("seen", F.lit(0))
    logs = F.coalesce("logs", F.lit(0.0)) + (F.col("n_rare") - seen) * float(np.log10(HALF))
    return part.drop("rare").join(found.hint("shuffle_hash"), F.col("rid") == F.col("row"), "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + seen).alias("n_known"), F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + logs).alias("base_score"), (F.col("score") + logs).alias("score"))


def score_documents(docs: DataFrame) -> DataFrame:
    vocabulary, rest = learn_vocabulary(materialize(word_counts(docs), "lm-counts"))
    return score(docs, vocabulary, rest, train(docs, vocabulary))


def op11_logbilinear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
