"""Boosted regression trees on rows packed into blocks of bin numbers.

The trees are those of Spark ML's ``GBTClassifier`` and ``GBTRegressor``: at most 32 bins a numeric feature, thresholds to try from about
10,000 rows (all, if fewer), variance gain over every feature, the first tree on the labels and the others on the loss's gradient, early stop.  Every tree level is one Spark job over all training rows: a task counts rows and sums gradients by node and bin, the driver
adds these tables (at most 4 nodes x bins a task) and takes the splits.  Of two sister nodes only that with fewer rows is counted, the
other is what remains of their parent; the root's counts are the same for every tree.  A category's one-hot slots are counted from its one
column of indices.  The blocks are written once; every partition of them lies as plain arrays in the scratch folder of the executor that reads it
(:class:`Shelf`), where a level's task maps them into its memory, so no rows pass between the JVM and Python in a level.  Margins are stored
beside them after every ``STORED`` trees; those of the trees since are added where a level counts a row.  A task that does not find its
arrays, since it runs on another executor, says so: its partition is read from the blocks again.
"""

from __future__ import annotations

import mmap
import os
import pickle
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager, suppress
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.plans.materialize import materialize

BINS = 32
SAMPLE = 10_000
STORED = 1
#: trees after which the margins are added up from all trees anew
REBUILD = 1000
#: cells of a table that several columns are counted in together
JOINT = 2048
#: rows of a block that is counted at once
BLOCK = 50_000
#: gains that differ by less of the sums they come from are equal
TIE = 1e-12


@dataclass
class Tree:
    """A complete binary tree in heap order: a row goes right at node i if first[i] <= code < first[i] + many[i] in ``column[i]``."""
    column: np.ndarray
    first: np.ndarray
    many: np.ndarray
    value: np.ndarray   # of the leaves, from the left
    weight: float

    @classmethod
    def empty(cls, depth: int, weight: float) -> Tree:
        nodes = (1 << depth) - 1   # no code passes a node without a split
        return cls(np.zeros(nodes, np.int64), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64), np.zeros(1 << depth), weight)

    def places(self, codes: list[np.ndarray], depth: int) -> np.ndarray:
        """Each row's node of the level ``depth``, counted from its left."""
        place = np.zeros(len(codes[0]), np.uint8)
        for level in range(depth):
            right = np.zeros(len(place), np.uint8)
            for at in range(1 << level):
                node = (1 << level) - 1 + at
                if self.many[node]:
                    code = codes[self.column[node]]
                    goes = (code - code.dtype.type(self.first[node])) < code.dtype.type(self.many[node])   # unsigned: a code below wraps
                    right |= goes & (place == at)
            place = (place << 1) | right
        return place

    def margins(self, codes: list[np.ndarray], depth: int) -> np.ndarray:
        return (self.weight * self.value)[self.places(codes, depth)]


@dataclass
class BoostedTrees:
    """A fitted model: the feature stages, the columns' bins and the trees."""
    stages: PipelineModel      # index, one-hot, assemble
    numeric: list[str]
    categorical: list[str]
    thresholds: list[np.ndarray]   # of the numeric columns
    sizes: list[int]               # the number of codes of every column
    depth: int
    trees: list[Tree]
    leaf_rows: np.ndarray | None = None   # training rows by tree and leaf

    def inputs(self) -> list[Column]:
        return [F.col(c).cast("double") for c in self.numeric] + [F.col(f"{c}__idx") for c in self.categorical]

    def with_margin(self, df: DataFrame, out: str) -> DataFrame:
        thresholds, sizes, trees, depth = self.thresholds, self.sizes, self.trees, self.depth

        @F.pandas_udf("double")
        def margin(*columns: pd.Series) -> pd.Series:
            codes = row_codes(columns, thresholds, sizes)
            total = np.zeros(len(columns[0]))
            for tree in trees:
                total += tree.margins(codes, depth)
            return pd.Series(total)
        indexed = self.stages.stages[0].transform(df)
        return indexed.select(*df.columns, margin(*self.inputs()).alias(out))


def row_codes(columns, thresholds: list[np.ndarray], sizes: list[int]) -> list[np.ndarray]:
    """The bin of every numeric value (missing ones are in the last) and the index of every category."""
    codes = [np.searchsorted(t, c.to_numpy(float, na_value=np.nan), side="left") for c, t in zip(columns, thresholds)]
    codes += [c.to_numpy() for c in columns[len(thresholds):]]
    return [c.astype(np.uint8 if size <= 256 else np.uint32) for c, size in zip(codes, sizes)]


def column_thresholds(values: np.ndarray, weights: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Thresholds between distinct values: all if they are few enough, else those nearest to equal weights."""
    distinct, place = np.unique(values, return_inverse=True)
    if len(distinct) <= bins:
        found = (distinct[:-1] + distinct[1:]) / 2
    else:
        mass = np.bincount(place, weights)
        stride = mass.sum() / bins
        found, seen, target = [], mass[0], stride
        for i in range(1, len(distinct)):
            before, seen = seen, seen + mass[i]
            if abs(before - target) < abs(seen - target):
                found.append((distinct[i - 1] + distinct[i]) / 2)
                target += stride
        found = np.array(found)
    return found[~np.isnan(found)]


def gradient(y: np.ndarray, margin: np.ndarray | None, logistic: bool) -> np.ndarray:
    """What the next tree fits: the labels (classes as -1 and 1) at first, then the loss's negative gradient."""
    if margin is None:
        return y.astype(float)
    return 4.0 * y / (1.0 + np.exp(2.0 * y * margin)) if logistic else 2.0 * (y - margin)


def joint_columns(sizes: list[int]) -> list[list[int]]:
    """Columns that are counted in one table."""
    groups: list[tuple[int, list[int]]] = []
    for c in sorted(range(len(sizes)), key=lambda c: -sizes[c]):
        for g, (cells, columns) in enumerate(groups):
            if cells * sizes[c] <= JOINT:
                groups[g] = (cells * sizes[c], [*columns, c])
                break
        else:
            groups.append((sizes[c], [c]))
    return [columns for _, columns in groups]


def joint_type(cells: int) -> type:
    return np.uint16 if cells <= 1 << 16 else np.uint32


def joint_codes(codes: list[np.ndarray], sizes: list[int]) -> list[np.ndarray]:
    """One code for every row and group of ``joint_columns``: its cell in the group's table."""
    out = []
    for columns in joint_columns(sizes):
        kind = joint_type(int(np.prod([sizes[c] for c in columns])))
        cell = codes[columns[0]].astype(kind)
        for c in columns[1:]:
            cell = cell * kind(sizes[c]) + codes[c]
        out.append(cell)
    return out


class Codes(list):
    """The columns' codes of a block of rows, with those of its groups of columns."""

    def __init__(self, columns: Iterable[np.ndarray], joint: list[np.ndarray]):
        super().__init__(columns)
        self.joint = joint


def added_margins(codes: list[np.ndarray], margin: np.ndarray | None, trees: Sequence[Tree], depth: int) -> np.ndarray | None:
    """The margins after ``trees`` too, added one by one."""
    for tree in trees:
        margin = tree.margins(codes, depth) + (0.0 if margin is None else margin)
    return margin


def level_tables(blocks, tree: Tree, level: int, nodes: list[int] | None, sizes: list[int], class_weights: tuple[float, float] | None, counted: bool,
                 since: Sequence[Tree] = (), depth: int = 0):
    """(kinds, nodes, codes of all columns in a row) over the rows at ``nodes`` (None: all rows, as one): rows, or rows of either class,
    if ``counted``, and at last the sums of gradients.  The blocks' margins lack those of the trees ``since``."""
    classes = class_weights is not None
    groups, kinds, n_nodes = joint_columns(sizes), (3 if classes else 2) if counted else 1, 1 if nodes is None else len(nodes)
    cells = [int(np.prod([sizes[c] for c in columns])) for columns in groups]
    tables = [np.zeros((kinds, n_nodes * n)) for n in cells]
    number = np.full(256, 255, np.uint8)
    number[nodes or []] = np.arange(n_nodes if nodes else 0)
    for codes, y, margin in blocks:
        joint = codes.joint if isinstance(codes, Codes) else joint_codes(codes, sizes)
        at = None
        if nodes is not None:
            place = number[tree.places(codes, level)]
            rows = np.flatnonzero(place != 255)
            at, joint, y, margin = place[rows], [column[rows] for column in joint], y[rows], None if margin is None else margin[rows]
            codes = [column[rows] for column in codes] if since else codes
        late = y > 0 if classes else None
        g = gradient(y, added_margins(codes, margin, since, depth), classes)
        if classes:
            g *= np.where(late, class_weights[1], class_weights[0])
        for column, n, table in zip(joint, cells, tables):
            kind = np.uint16 if 2 * n_nodes * n <= 1 << 16 else np.int64
            here = column if nodes is None else at.astype(kind) * kind(n) + column
            table[-1] += np.bincount(here, g, n_nodes * n)
            if counted and classes:
                table[:2] += np.bincount(here.astype(kind) * kind(2) + late, minlength=2 * n_nodes * n).reshape(-1, 2).T
            elif counted:
                table[0] += np.bincount(here, minlength=n_nodes * n)
    out: list = [None] * len(sizes)
    for columns, table in zip(groups, tables):
        cube = table.reshape(kinds, n_nodes, *[sizes[c] for c in columns])
        for i, c in enumerate(columns):
            out[c] = cube.sum(axis=tuple(2 + k for k in range(len(columns)) if k != i))
    yield np.concatenate(out, axis=2)


def best_split(table: np.ndarray, sizes: list[int], n_numeric: int, class_weights: tuple[float, float] | None):
    """(column, first, many, weight and gradient of both sides, rows of both sides) of the greatest gain, the first of equals; None without gain."""
    found, end = [], 0
    for c, size in enumerate(sizes):
        here, end = table[:, end:end + size], end + size
        g, rows = here[-1], here[:-1].sum(axis=0)
        w = rows if class_weights is None else here[0] * class_weights[0] + here[1] * class_weights[1]
        weighs = rows if class_weights is None else here[0] * (class_weights[0] > 0) + here[1] * (class_weights[1] > 0)
        all_w, all_g, all_weigh = w.sum(), g.sum(), weighs.sum()
        if c < n_numeric:      # to the right: the codes above a threshold
            left_w, left_g, left = w.cumsum()[:-1], g.cumsum()[:-1], weighs.cumsum()[:-1]
            right_w, right_g, right = all_w - left_w, all_g - left_g, all_weigh - left
        else:                  # to the right: one category; the last index is for unknown values and has no slot
            right_w, right_g, right = w[:-1], g[:-1], weighs[:-1]
            left_w, left_g, left = all_w - right_w, all_g - right_g, all_weigh - right
        there = (left > 0) & (right > 0)   # counts are whole numbers, without what rounding leaves
        if not there.any():
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            kept = left_g ** 2 / left_w + right_g ** 2 / right_w
            gain = np.where(there, kept - all_g ** 2 / all_w, -np.inf)
        i = int(np.argmax(gain >= gain.max() - TIE * kept[gain.argmax()]))
        if gain[i] > 1e-14 * kept[i]:
            first, many = (i + 1, size - 1 - i) if c < n_numeric else (i, 1)
            goes = rows[first:first + many].sum()
            found.append((gain[i], kept[i], (c, first, many, ((left_w[i], left_g[i]), (right_w[i], right_g[i])), (rows.sum() - goes, goes))))
    if not found:
        return None
    most, of, _ = max(found, key=lambda f: f[0])
    return next(split for gain, _, split in found if gain >= most - TIE * of)


def grow(rows: Rows, trees: list[Tree], known: np.ndarray | None, sizes: list[int], n_numeric: int, depth: int, weight: float, class_weights) -> tuple[Tree, np.ndarray]:
    """The tree after ``trees``, on the gradients of all rows, a job a level, and the root's counts, ``known`` from the tree before."""
    tree = Tree.empty(depth, weight)

    def tables(level: int, nodes: list[int] | None, counted: bool) -> np.ndarray:
        def count(blocks, since):
            return next(level_tables(blocks, tree, level, nodes, sizes, class_weights, counted, since, depth))
        return sum(rows.run(count, trees))   # one table a task
    root = tables(0, None, True) if known is None else np.concatenate([known, tables(0, None, False)])
    nodes = {0: root[:, 0]}
    n, g = root[:-1, 0, :sizes[0]].sum(axis=1), root[-1, 0, :sizes[0]].sum()
    w = n.sum() if class_weights is None else n @ np.array(class_weights)
    tree.value[:] = g / w if w > 0 else 0.0
    for level in range(depth):
        fewer, rest = [], []   # of the sister nodes
        for at, table in nodes.items():
            split = best_split(table, sizes, n_numeric, class_weights)
            if split is None:
                continue
            node, below = (1 << level) - 1 + at, 1 << (depth - level - 1)   # leaves under either side
            tree.column[node], tree.first[node], tree.many[node] = split[:3]
            for side, (w, g) in enumerate(split[3]):
                start = (2 * at + side) * below
                tree.value[start:start + below] = g / w
            less = int(split[4][1] <= split[4][0])
            fewer.append(2 * at + less)
            rest.append(2 * at + 1 - less)
        if not fewer or level + 1 == depth:
            break
        counted = tables(level + 1, fewer, True)
        nodes = {k: t for i, (a, b) in enumerate(zip(fewer, rest)) for k, t in ((a, counted[:, i]), (b, nodes[a // 2] - counted[:, i]))}
    return tree, root[:-1]


def unpacked(batches: Iterable):
    """Blocks of at least ``BLOCK`` rows, as far as there are any: codes, labels and no margins."""
    def joined(parts):
        return [np.concatenate(column) for column in zip(*(codes for codes, _ in parts))], np.concatenate([y for _, y in parts]), None
    parts, held = [], 0
    for row in batches:
        parts.append(pickle.loads(row.block))
        held += len(parts[-1][1])
        if held >= BLOCK:
            yield joined(parts)
            parts, held = [], 0
    if parts:
        yield joined(parts)


def _advance(blocks, trees: list[Tree], depth: int):
    for codes, y, margin in blocks:
        yield codes, y, added_margins(codes, margin, trees, depth)


def _leaf_rows(blocks, trees: list[Tree], depth: int) -> np.ndarray:
    counts = np.zeros((len(trees), 1 << depth), np.int64)
    for codes, _, _ in blocks:
        for t, tree in enumerate(trees):
            counts[t] += np.bincount(tree.places(codes, depth), minlength=1 << depth)
    return counts


class Shelf:
    """The arrays of one partition in the executor's own scratch folder, which Spark names to its Python workers and deletes with the executor.

    A file is written under another name and then renamed, so it is whole where it is there, also when a task runs twice."""

    def __init__(self, fit: str, part: int):
        folders = os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(",")
        self.folder = os.path.join(folders[part % len(folders)], f"boosting-{fit}", str(part))

    @contextmanager
    def writing(self, name: str):
        os.makedirs(self.folder, exist_ok=True)
        number, path = tempfile.mkstemp(dir=self.folder)
        with os.fdopen(number, "wb") as file:
            yield file
        os.replace(path, os.path.join(self.folder, name))

    def mapped(self, name: str) -> memoryview | mmap.mmap:
        with open(os.path.join(self.folder, name), "rb") as file:
            return mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ) if os.fstat(file.fileno()).st_size else memoryview(b"")

    def fill(self, blocks, sizes: list[int]) -> None:
        """Keeps the rows: a block's codes by column and by group of columns and its labels, each from a multiple of 64 bytes."""
        index, end = [], 0
        with self.writing("rows") as file:
            for codes, y, _ in blocks:
                index.append((len(y), []))
                for array in (*codes, *joint_codes(codes, sizes), y):
                    index[-1][1].append((array.dtype, end))
                    end += file.write(array.tobytes()) + file.write(bytes(-array.nbytes % 64))
        with self.writing("index") as file:
            pickle.dump((index, len(sizes)), file)

    def blocks(self, stored: int) -> Iterator[tuple[Codes, np.ndarray, np.ndarray | None]]:
        """Codes, labels and the margins after ``stored`` trees; FileNotFoundError if they are not here."""
        with open(os.path.join(self.folder, "index"), "rb") as file:
            index, columns = pickle.load(file)
        rows, margins = self.mapped("rows"), self.mapped(f"margins-{stored}") if stored else None

        def found():
            before = 0
            for n, places in index:
                *codes, y = (np.frombuffer(rows, kind, n, at) for kind, at in places)
                yield Codes(codes[:columns], codes[columns:]), y, None if margins is None else np.frombuffer(margins, float, n, 8 * before)
                before += n
        return found()

    def storing(self, trees: int, blocks):
        """The blocks as they are; their margins, after so many trees, are stored."""
        with self.writing(f"margins-{trees}") as file:
            for codes, y, margin in blocks:
                file.write(margin)
                yield codes, y, margin

    def drop(self, trees: int) -> None:
        with suppress(FileNotFoundError):
            os.remove(os.path.join(self.folder, f"margins-{trees}"))

    def clear(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)
        with suppress(OSError):
            os.rmdir(os.path.dirname(self.folder))


class Rows:
    """All training rows: blocks that can be read again (``parts``), their arrays on the executors' shelves, and how far the margins are stored."""

    def __init__(self, parts: RDD, sizes: list[int], depth: int):
        self.parts, self.sizes, self.depth, self.fit = parts, sizes, depth, uuid.uuid4().hex
        self.stored = self.older = 0
        fit = self.fit

        def load(part, rows):
            Shelf(fit, part).fill(unpacked(rows), sizes)
            yield part
        self.held = parts.mapPartitionsWithIndex(load).persist(StorageLevel.MEMORY_AND_DISK)   # a number a partition: tasks go where it was loaded

    def run(self, task: Callable, trees: list[Tree]) -> list:
        """``task(blocks, since)`` for every partition; the blocks' margins lack those of the last trees, ``since``."""
        fit, sizes, depth, stored, older, n = self.fit, self.sizes, self.depth, self.stored, self.older, len(trees)
        store = n > stored and n % STORED == 0
        known = 0 if store and n % REBUILD == 0 else stored
        since = trees[known:]

        def result(shelf: Shelf, blocks, since):
            if store:
                blocks, since = shelf.storing(n, _advance(blocks, since, depth)), ()
                shelf.drop(older)
            return task(blocks, since)

        def there(_, held):
            part, = held   # read to its end: Spark ends a Python worker that leaves rows unread
            shelf = Shelf(fit, part)
            try:
                blocks = shelf.blocks(known)
            except FileNotFoundError:
                blocks = None
            yield part, None if blocks is None else result(shelf, blocks, since)

        def from_all_trees(part, held):
            """As ``there`` on the executor that has the rows, or with the rows loaded again."""
            shelf = Shelf(fit, part)
            try:
                blocks = shelf.blocks(0)
            except FileNotFoundError:
                if not reload:
                    yield part, None
                    return
                shelf.fill(unpacked(held), sizes)
                blocks = shelf.blocks(0)
            if stored:
                blocks = shelf.storing(stored, _advance(blocks, trees[:stored], depth))
            yield part, result(shelf, blocks, trees[stored:])
        found = dict(self.held.mapPartitionsWithIndex(there).collect())   # one result a partition
        for reload, source in ((False, self.held), (True, self.parts)):
            lost = [part for part, one in found.items() if one is None]
            if lost:
                found |= dict(source.context.runJob(source.mapPartitionsWithIndex(from_all_trees), list, lost))
        if store:
            self.stored, self.older = n, stored
        return [found[part] for part in sorted(found)]

    def clear(self) -> None:
        fit = self.fit
        self.held.foreachPartition(lambda parts: [Shelf(fit, part).clear() for part in parts])
        self.held.unpersist()


def fit(train: DataFrame, feature_stages: list, numeric: list[str], categorical: list[str], label: str, logistic: bool,
        n_trees: int, depth: int, step: float, seed: int) -> BoostedTrees:
    """Boosted trees on all rows of ``train``; classes (0 and 1) are weighted so that both weigh the same."""
    spark = train.sparkSession
    stages = Pipeline(stages=feature_stages).fit(train)
    model = BoostedTrees(stages, list(numeric), list(categorical), [], [], depth, [])
    y = F.col(label).cast("double")
    indexed = stages.stages[0].transform(train).select(*[c.alias(f"x{i}") for i, c in enumerate(model.inputs())], y.alias("y"))
    finite = [F.coalesce(F.abs(f"x{i}") < float("inf"), F.lit(False)) for i in range(len(numeric))]   # a missing value is no less
    n, positives, odd = indexed.agg(F.count(F.lit(1)), F.count_if(F.col("y") == 1), F.count_if(~reduce(and_, finite))).collect()[0]
    if odd:
        raise ValueError(f"{odd} rows have a missing or infinite number")
    class_weights = (1.0, (n - positives) / max(positives, 1)) if logistic else None

    some = indexed
    if n > max(SAMPLE, BINS * BINS):   # only the thresholds to try; every row is in every table
        drawn = F.pmod(F.xxhash64(*indexed.columns, F.lit(seed)), F.lit(1 << 40)) < int(max(SAMPLE, BINS * BINS) / n * (1 << 40))
        some = indexed.where(drawn)
    sample = some.select(*[f"x{i}" for i in range(len(numeric))], "y").toPandas()
    weights = np.where(sample["y"] == 1, class_weights[1], class_weights[0]) if logistic else np.ones(len(sample))
    model.thresholds = [column_thresholds(sample[f"x{i}"].to_numpy(float, na_value=np.nan), weights) for i in range(len(numeric))]
    thresholds = model.thresholds
    model.sizes = sizes = [len(t) + 1 for t in thresholds] + [len(labels) + 1 for labels in stages.stages[0].labelsArray]

    def pack(batches):
        for pdf in batches:
            if len(pdf):
                y = pdf.pop("y").to_numpy(float)
                codes = row_codes([pdf[c] for c in pdf.columns], thresholds, sizes)
                yield pd.DataFrame({"block": [pickle.dumps((codes, np.where(y == 1, 1, -1).astype(np.int8) if logistic else y))]})
    blocks = materialize(indexed.mapInPandas(pack, "block binary"), "training-blocks")
    tasks = int(min(spark.sparkContext.defaultParallelism, n // 5000 + 1))
    rows, counts, trees = Rows(blocks.repartition(tasks).rdd, sizes, depth), None, model.trees
    try:
        for t in range(n_trees):
            tree, counts = grow(rows, trees, counts, sizes, len(numeric), depth, 1.0 if t == 0 else step, class_weights)
            trees.append(tree)
        model.leaf_rows = sum(rows.run(lambda blocks, _: _leaf_rows(blocks, trees, depth), trees))   # trees x leaves a task
    finally:
        rows.clear()
    return model
