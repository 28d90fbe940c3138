"""Exact per-row tree contributions for the boosted-tree classifier.

Path-dependent Shapley values (Lundberg et al. 2018) computed leaf by leaf:
for a leaf with distinct path features D (|D| <= depth = 4),
v(S) = value * prod_{i in S} [x meets i's path conditions] * prod_{i in D\\S} cover_i,
phi_i = sum_{S subset D\\{i}} |S|!(|D|-|S|-1)!/|D|! (v(S+i) - v(S)).
The leaf table is taken from the fitted model (small).  A leaf's contributions
depend on a row only through which of its conditions are met, so they are tabled once per
leaf by the bit mask of met conditions (at most 2^depth entries a feature); rows are scored
per Arrow batch in ``mapInPandas``: leaves that share their comparisons are summed by the pattern of these, then one
look-up per pattern and feature.  The log-odds are twice the margin sum_t w_t tree_t(x), so contributions and bias are scaled by 2 w_t.
A split takes one category from the others, so its feature is that category's one-hot slot.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.operators.boosting import BoostedTrees


#: comparisons whose outcomes make one pattern: half a tree of depth 4 has eight
TOGETHER = 8


def _leaves(model: BoostedTrees) -> tuple[list, float]:
    """Leaf records: (scale, value, [(feature, lo, hi, cover), ...]) and the bias."""
    n_numeric = len(model.numeric)
    slots = n_numeric + np.concatenate([[0], np.cumsum([size - 1 for size in model.sizes[n_numeric:]])]).astype(int)   # of each column's categories
    leaves, bias = [], 0.0
    for tree, rows in zip(model.trees, model.leaf_rows):
        scale = 2.0 * tree.weight

        def walk(node: int, start: int, end: int, conds: dict, cover: dict, depth_cover: float):
            """``node`` has the leaves from ``start`` to ``end``."""
            nonlocal bias
            if end - start == 1:
                feats = [(f, lo, hi, cover[f]) for f, (lo, hi) in conds.items()]
                leaves.append((scale, float(tree.value[start]), feats))
                bias += scale * float(tree.value[start]) * depth_cover
                return
            half = (start + end) // 2
            if not tree.many[node]:   # no split: every row is in the leftmost leaf
                return walk(2 * node + 1, start, half, conds, cover, depth_cover)
            column, first = int(tree.column[node]), int(tree.first[node])
            f, at = (column, float(model.thresholds[column][first - 1])) if column < n_numeric else (int(slots[column - n_numeric]) + first, 0.5)
            for child, lo, hi, iv in ((2 * node + 1, start, half, (-math.inf, at)), (2 * node + 2, half, end, (at, math.inf))):
                ratio = float(rows[lo:hi].sum()) / float(rows[start:end].sum())
                lo0, hi0 = conds.get(f, (-math.inf, math.inf))
                walk(child, lo, hi, conds | {f: (max(lo0, iv[0]), min(hi0, iv[1]))}, cover | {f: cover.get(f, 1.0) * ratio}, depth_cover * ratio)

        walk(0, 0, len(tree.value), {}, {}, 1.0)
    return leaves, bias


def mask_table(scaled_value: float, cover: list[float]) -> np.ndarray:
    """phi[j, mask]: the contribution of a leaf's j-th feature for every set of met conditions (bit i: condition i)."""
    m = len(cover)
    met = (np.arange(1 << m)[None, :] >> np.arange(m)[:, None]) & 1
    table = np.zeros((m, 1 << m))
    for j in range(m):
        others = [k for k in range(m) if k != j]
        for size in range(m):
            weight = math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m)
            for sub in itertools.combinations(others, size):
                rest = math.prod(cover[k] for k in others if k not in sub)
                table[j] += weight * rest * np.prod(met[list(sub)], axis=0) * (met[j] - cover[j])
    return scaled_value * table


def leaf_contributions(x: np.ndarray, tables: list) -> np.ndarray:
    """(rows, features) contributions of rows x; ``tables`` has ([(feature, lo, hi), ...], phi by mask) per leaf."""
    columns = np.ascontiguousarray(x.T)
    phi = np.zeros(columns.shape)
    for conditions, table in tables:
        mask = np.zeros(len(x), np.intp)
        for i, (f, lo, hi) in enumerate(conditions):
            mask |= ((columns[f] > lo) & (columns[f] <= hi)).astype(np.intp) << i
        for (f, _, _), by_mask in zip(conditions, table):
            phi[f] += by_mask.take(mask)
    return phi.T


def pattern_tables(tables: list) -> list:
    """Leaves in a row of the list that ask for at most ``TOGETHER`` comparisons, summed by the pattern of these:
    ([(feature, threshold), ...], [(feature, contribution by pattern), ...])."""
    groups: list[tuple[dict, list]] = []
    for conditions, table in tables:
        asked = dict.fromkeys((f, t) for f, lo, hi in conditions for t in (lo, hi) if math.isfinite(t))
        if groups and len(groups[-1][0] | asked) <= TOGETHER:
            groups[-1] = (groups[-1][0] | asked, groups[-1][1])
        else:
            groups.append((asked, []))
        groups[-1][1].append((conditions, table))
    out = []
    for asked, leaves in groups:
        patterns = np.arange(1 << len(asked))
        above = {c: (patterns >> i) & 1 for i, c in enumerate(asked)}
        phi: dict[int, np.ndarray] = {}
        for conditions, table in leaves:
            mask = sum((above.get((f, lo), 1) & (1 - above.get((f, hi), 0))) << i for i, (f, lo, hi) in enumerate(conditions))
            for (f, _, _), by_mask in zip(conditions, table):
                phi[f] = phi.get(f, 0.0) + by_mask[mask]
        out.append((list(asked), list(phi.items())))
    return out


def row_contributions(x: np.ndarray, tables: list, groups: list) -> np.ndarray:
    """As ``leaf_contributions``, with one look-up per group of leaves and feature; rows with missing values go leaf by leaf."""
    return column_contributions(np.ascontiguousarray(x.T), tables, groups).T


def column_contributions(columns: np.ndarray, tables: list, groups: list) -> np.ndarray:
    """(features, rows) contributions of rows given by their columns."""
    phi, found = np.zeros(columns.shape), np.empty(columns.shape[1])
    above: dict[tuple, np.ndarray] = {}
    for asked, by_feature in groups:
        pattern = np.zeros(columns.shape[1], np.uint16)
        for i, c in enumerate(asked):
            if c not in above:
                above[c] = (columns[c[0]] > c[1]).astype(np.uint16)
            pattern |= above[c] << np.uint16(i)
        at = pattern.astype(np.intp)
        for f, by_pattern in by_feature:
            by_pattern.take(at, out=found, mode="clip")   # every pattern is in the table
            phi[f] += found
    missing = np.flatnonzero(np.isnan(columns).any(axis=0))
    if len(missing):
        phi[:, missing] = leaf_contributions(columns[:, missing].T, tables).T
    return phi


def vector_names(meta: dict) -> list[str]:
    """Slot names from the assembled vector's ML attributes: num__X and cat__Column_Value."""
    attrs = meta["ml_attr"]
    names = [""] * int(attrs["num_attrs"])
    for group in attrs.get("attrs", {}).values():
        for a in group:
            n = a.get("name", f"f{a['idx']}")
            if "__ohe_" in n:
                col, val = n.split("__ohe_", 1)
                names[a["idx"]] = f"cat__{col}_{val}"
            else:
                names[a["idx"]] = f"num__{n}"
    return [n or f"f{i}" for i, n in enumerate(names)]


def _leaf_tables(model: BoostedTrees) -> tuple[list, float]:
    """([(feature, lo, hi), ...], phi by mask) of every leaf with a condition, and the bias."""
    leaves, bias = _leaves(model)
    return [([(f, lo, hi) for f, lo, hi, _ in feats], mask_table(scale * value, [c for *_, c in feats]))
            for scale, value, feats in leaves if feats], bias


def tree_contributions(model: BoostedTrees, df: DataFrame, key: str = "Order_ID") -> tuple[DataFrame, float]:
    """(key, contribs array<struct<feature, value, x>>) of log-odds contributions for every row, and the bias."""
    spark = df.sparkSession
    tables, bias = _leaf_tables(model)
    prep = model.stages.transform(df)
    names = vector_names(prep.schema["features"].metadata)
    bc = spark.sparkContext.broadcast((tables, pattern_tables(tables), len(names)))   # trees x 2^depth leaves
    vec = prep.select(key, vector_to_array("features").alias("x"))

    def contrib(batches):
        tabs, groups, d = bc.value
        for pdf in batches:
            x = np.stack(pdf["x"].to_numpy()) if len(pdf) else np.zeros((0, d))
            yield pd.DataFrame({key: pdf[key].to_numpy(), "x": list(x), "value": list(row_contributions(x, tabs, groups))})

    out = vec.mapInPandas(contrib, f"{key} long, x array<double>, value array<double>")
    label = F.array(*[F.lit(n) for n in names])   # one per model feature
    zipped = F.transform(F.arrays_zip(label.alias("feature"), F.col("value"), F.col("x")),
                         lambda s: F.struct(s["feature"].alias("feature"), s["value"].alias("value"), s["x"].alias("x")))
    return out.select(key, zipped.alias("contribs")), bias


def strongest(phi: np.ndarray, order: np.ndarray, k: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The k features of greatest |contribution| of every row and these contributions; of equal ones the first in ``order`` comes first."""
    size = np.ascontiguousarray(np.abs(phi[order]).T)
    rows, features, values = np.arange(phi.shape[1]), [], []
    for _ in range(k):
        at = size.argmax(axis=1)
        features.append(order[at])
        values.append(phi[features[-1], rows])
        size[rows, at] = -1.0
    return features, values


def strongest_contributions(model: BoostedTrees, df: DataFrame, k: int, key: str = "Order_ID") -> tuple[DataFrame, Column]:
    """The k strongest contributions of every row, by |contribution| and then by name, out of the same contributions as ``tree_contributions``:
    (key, f0, v0, f1, v1, ...) with the features' numbers, and the column that makes ``contribs`` array<struct<feature, value>> of them.
    All contributions of a row are computed but only these leave the task, so that a join or shuffle by the key is a small one."""
    tables, _ = _leaf_tables(model)
    names = vector_names(model.stages.transform(df).schema["features"].metadata)
    order = np.array(sorted(range(len(names)), key=lambda i: names[i].encode()))   # as Spark compares texts
    k = min(k, len(names))
    bc = df.sparkSession.sparkContext.broadcast((tables, pattern_tables(tables), order))
    slots = [size - 1 for size in model.sizes[len(model.numeric):]]   # the last index is for unknown values and has no slot
    n_numeric = len(model.numeric)

    def contrib(batches):
        tabs, groups, by_name = bc.value
        for pdf in batches:
            given = [pdf.iloc[:, 1 + i].to_numpy(float, na_value=np.nan) for i in range(n_numeric + len(slots))]
            hot = [(index == slot).astype(float) for index, n in zip(given[n_numeric:], slots) for slot in range(n)]
            features, values = strongest(column_contributions(np.array(given[:n_numeric] + hot), tabs, groups), by_name, k)
            yield pd.DataFrame({key: pdf[key].to_numpy()} | {f"{c}{i}": column for i in range(k) for c, column in (("f", features[i].astype(np.int32)), ("v", values[i]))})

    indexed = model.stages.stages[0].transform(df).select(key, *[c.alias(f"x{i}") for i, c in enumerate(model.inputs())])
    out = indexed.mapInPandas(contrib, f"{key} long, " + ", ".join(f"f{i} int, v{i} double" for i in range(k)))
    label = F.array(*[F.lit(n) for n in names])
    return out, F.array(*[F.struct(label[F.col(f"f{i}")].alias("feature"), F.col(f"v{i}").alias("value")) for i in range(k)])
