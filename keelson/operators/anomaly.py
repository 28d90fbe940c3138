"""Isolation-forest anomalies (U1-U5; Liu, Ting, Zhou 2008) with splits drawn from hashes.

Every random choice is read from an md5 of what it is for: a row's place in a tree's sample from (row, tree), a node's feature and
threshold from (tree, node).  So the forest depends on the rows alone, not on partitions or retries, and SQL can restate it.

Fit: each tree draws its ``PSI`` rows from the whole table (the least hashes), and all trees grow together, a level at a
time: minima, maxima and counts of every (tree, node) are one window aggregation over the samples, from which each row of a node
derives the same split and its own child.  The forest is a node table of at most trees x (2 psi - 1) rows, whatever the table.

Score: a batch of rows walks down a tree at a time, a level of all its rows at once, by look-ups in the broadcast node table;
path lengths are summed on an integer grid, so scores do not depend on the order of the sums.  Splits are uniform between a node's minimum
and maximum and so do not change when a feature is shifted or scaled: features are not standardised.

Missing values go to the right child and take no part in a node's range.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions.stats import exact_percentiles
from keelson.operators.hashed_draws import drawn_below
from keelson.plans.materialize import materialize

# Anomaly feature list, forest size, sub-sample size, contamination.
ANOMALY_NUMERIC = [
    "Base_Lead_Time_Days", "Cost_Per_Kg", "Order_Weight_Kg", "Geopolitical_Risk_Index",
    "Weather_Severity_Index", "Inflation_Rate_Pct", "Shipping_Cost_USD", "Schedule_Buffer_Days",
]
N_TREES = 200
PSI = 256
CONTAMINATION = 0.05
SEED = 42
#: path lengths are whole numbers of this part of an edge
GRID = 1_000_000_000
TWO_POW_32 = 4294967296.0
#: a row's uniforms are the four 32-bit parts of one md5
PARTS = 4


def c_factor(n: float) -> float:
    """Average unsuccessful-search path length in a BST of n items."""
    if n > 2:
        return 2.0 * (math.log(n - 1.0) + 0.5772156649) - 2.0 * (n - 1.0) / n
    return 1.0 if n == 2 else 0.0


def _c_column(n: Column) -> Column:
    d = n.cast("double")
    return F.when(n > 2, 2.0 * (F.log(d - 1.0) + 0.5772156649) - 2.0 * (d - 1.0) / d).when(n == 2, 1.0).otherwise(0.0)


def _part(digest: Column, k: int) -> Column:
    """Eight hex digits of a digest; their order as text is their order as numbers."""
    return F.substring(digest, 8 * k + 1, 8)


def _number(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("bigint")


@dataclass
class Forest:
    nodes: DataFrame          # tree, node (1 at the root, 2i and 2i + 1 below), feature (-1: leaf), threshold, size, depth, path
    psi: int
    n_trees: int

    @property
    def depth(self) -> int:
        return max(1, math.ceil(math.log2(max(self.psi, 2))))


def _values(cols: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in cols])


def draw_samples(df: DataFrame, n_trees: int, psi: int, seed: int, key: str, cols: list[str], rows: int) -> DataFrame:
    """tree and x (the features) of each tree's ``psi`` rows of the least hashes."""
    # about 3 psi rows a tree pass the first test, which needs no order; only they are ranked
    below = min(TWO_POW_32, int(3.0 * psi / max(1, rows) * TWO_POW_32))
    named = df.select(F.col(key).alias("_key"), F.col(key).cast("string").alias("_text"), _values(cols).alias("x"))

    def draw(batches):
        for batch in batches:
            row, tree, h = drawn_below(batch.column(1).to_pylist(), n_trees, PARTS, f"forest|{seed}", below)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(2).take(row), tree, h], ["_key", "x", "tree", "h"])

    drawn = named.mapInArrow(draw, f"_key {df.schema[key].dataType.simpleString()}, x array<double>, tree int, h long")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy("h", "_key"))
    return drawn.withColumn("_rank", rank).where(F.col("_rank") <= psi).select("tree", "x")


def _split(seed: int, width: int) -> list[Column]:
    """feature (-1: no split) and threshold of the node of a row with its node's n, lo and hi."""
    digest = F.md5(F.concat_ws("|", F.lit("split"), F.lit(str(seed)), F.col("tree").cast("string"), F.col("node").cast("string")))
    varying = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.get("hi", i) > F.get("lo", i))
    feature = F.get(varying, (_number(_part(digest, 0)) % F.greatest(F.size(varying), F.lit(1))).cast("int"))
    feature = F.when(F.col("n") > 1, F.coalesce(feature, F.lit(-1))).otherwise(F.lit(-1))
    return [feature.alias("feature"), (_number(_part(digest, 1)).cast("double") / TWO_POW_32).alias("u")]


def fit_forest(df: DataFrame, n_trees: int = N_TREES, psi: int = PSI, seed: int = SEED, key: str = "Order_ID",
               cols: list[str] = ANOMALY_NUMERIC) -> Forest:
    """All trees over their hash-drawn samples, a level at a time."""
    rows = df.count()
    forest = Forest(df, max(1, min(psi, rows)), n_trees)
    at = draw_samples(df, n_trees, forest.psi, seed, key, cols, rows).withColumn("node", F.lit(1).cast("bigint")).withColumn("path", F.array().cast(
        "array<struct<node:bigint,feature:int,threshold:double,size:bigint,depth:int>>"))
    node = Window.partitionBy("tree", "node")
    for depth in range(forest.depth + 1):
        lo = F.array(*[F.min(F.get("x", F.lit(i))).over(node) for i in range(len(cols))])
        hi = F.array(*[F.max(F.get("x", F.lit(i))).over(node) for i in range(len(cols))])
        at = at.select("tree", "node", "x", "path", F.count(F.lit(1)).over(node).alias("n"), lo.alias("lo"), hi.alias("hi"))
        if depth < forest.depth:
            at = at.select("*", *_split(seed, len(cols)))
        else:
            at = at.select("*", F.lit(-1).alias("feature"), F.lit(0.0).alias("u"))
        low, high = F.get("lo", F.col("feature")), F.get("hi", F.col("feature"))
        cut = low + F.col("u") * (high - low)
        # below the maximum, so that neither child is empty
        at = at.withColumn("threshold", F.when(F.col("feature") >= 0, F.when(cut >= high, low).otherwise(cut)).otherwise(0.0))
        here = F.struct(F.col("node"), F.col("feature"), F.col("threshold"), F.col("n").alias("size"), F.lit(depth).alias("depth"))
        right = F.coalesce(F.get("x", F.col("feature")) <= F.col("threshold"), F.lit(False))
        child = F.when((F.col("node").isNotNull()) & (F.col("feature") >= 0), F.col("node") * 2 + F.when(right, 0).otherwise(1))
        at = at.select("tree", child.alias("node"), "x", F.when(F.col("node").isNotNull(), F.concat("path", F.array(here))).otherwise(F.col("path")).alias("path"))
    nodes = at.select("tree", F.inline("path")).distinct()
    length = F.when(F.col("feature") < 0, F.round((F.col("depth") + _c_column(F.col("size"))) * GRID)).otherwise(0).cast("bigint")
    forest.nodes = materialize(nodes.withColumn("length", length), "forest-nodes")   # the fitted model: built once
    return forest


@dataclass
class NodeArrays:
    """The nodes of all trees by place; a leaf is its own child, so that a row that has arrived stays."""
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray         # at 2 place the left one, at 2 place + 1 the right one
    length: np.ndarray


def node_arrays(nodes: DataFrame) -> NodeArrays:
    rows = nodes.select("tree", "node", "feature", "threshold", "length").collect()   # at most trees x (2 psi - 1) rows
    place = {(r.tree, r.node): i for i, r in enumerate(rows)}
    child = [place[r.tree, 2 * r.node + side] if r.feature >= 0 else i for i, r in enumerate(rows) for side in (0, 1)]
    return NodeArrays(np.array([i for i, r in enumerate(rows) if r.node == 1], np.intp), np.array([max(r.feature, 0) for r in rows], np.intp),
                      np.array([r.threshold for r in rows], np.float64), np.array(child, np.intp), np.array([r.length for r in rows], np.int64))


def walked_lengths(x: np.ndarray, nodes: NodeArrays, depth: int) -> np.ndarray:
    """Each row's path lengths summed over the trees; x is (features, rows), a missing value is NaN and goes right."""
    rows = x.shape[1]
    values, own, total = np.ascontiguousarray(x).ravel(), np.arange(rows), np.zeros(rows, np.int64)
    for root in nodes.roots:
        at = np.full(rows, root)
        for _ in range(depth):
            goes_left = values.take(nodes.feature.take(at) * rows + own) <= nodes.threshold.take(at)
            at = nodes.child.take(2 * at + ~goes_left)
        total += nodes.length.take(at)
    return total


def path_scores(df: DataFrame, forest: Forest, carry: tuple[str, ...] = ("Order_ID",), cols: list[str] = ANOMALY_NUMERIC) -> DataFrame:
    """U2 (first half): s = 2^(-E[h(x)] / c(psi)) for every row of ``df``, with the ``carry`` columns (the first is the rows' key)."""
    key = carry[0]
    rows = df.select(F.col(key).alias("_key"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])
    arrays = node_arrays(forest.nodes)
    if not len(arrays.roots):   # fitted on no rows
        rows = rows.limit(0)
    shared, depth, width = df.sparkSession.sparkContext.broadcast(arrays), forest.depth, len(cols)

    def walk(batches):
        nodes = shared.value
        for batch in batches:
            x = np.array([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(width)], np.float64)
            trees = np.full(batch.num_rows, len(nodes.roots), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(walked_lengths(x, nodes, depth)), pa.array(trees)], ["_key", "_len", "_trees"])

    walked = rows.mapInArrow(walk, f"_key {df.schema[key].dataType.simpleString()}, _len long, _trees long")
    total = walked.groupBy("_key").agg(F.sum("_len").alias("_sum"), F.sum("_trees").alias("_n"))
    # rows that repeat a key share the mean of their walks
    mean = F.col("_sum").cast("double") / (F.col("_n").cast("double") * GRID)
    scored = total.select("_key", F.pow(F.lit(2.0), -mean / F.lit(max(c_factor(forest.psi), 1e-9))).alias("s"))
    return df.select(*carry).join(scored, F.col(key).eqNullSafe(F.col("_key"))).select(*carry, "s")


def anomaly_scores(df: DataFrame, forest: Forest, carry: tuple[str, ...] = ("Order_ID",)) -> DataFrame:
    """Anomaly_Score = s - p95(s) over the same table; Is_Anomaly = score > 0."""
    s = materialize(path_scores(df, forest, carry), "forest-scores")   # scored once, read twice
    off = exact_percentiles(s, "s", {"_offset": 1.0 - CONTAMINATION})
    return (s.crossJoin(F.broadcast(off))   # a 1-row statistic
            .select(*carry, (F.col("s") - F.col("_offset")).alias("Anomaly_Score"),
                    (F.col("s") > F.col("_offset")).alias("Is_Anomaly"), F.col("_offset").alias("anomaly_offset")))


def score_requests(requests: DataFrame, forest: Forest, offset: float, key: str = "request_id") -> DataFrame:
    """Score a table of requests against the fitted forest and fitted offset."""
    s = path_scores(requests, forest, (key,))
    return s.select(key, (F.col("s") - F.lit(offset)).alias("anomaly_score"),
                    (F.col("s") > F.lit(offset)).alias("is_anomaly"))


def anomaly_kpis(anomalies: DataFrame) -> DataFrame:
    """U4 over (a filtered part of) the scored rows; the forest was fitted on all of them."""
    return anomalies.agg(F.count_if("Is_Anomaly").alias("anomalies"),
                         F.round(F.avg(F.col("Is_Anomaly").cast("double")) * 100, 1).alias("anomaly_pct"),
                         F.count_if(F.col("Is_Anomaly") & (F.col("Risk_Tier") == "Low")).alias("anomaly_low_tier"))


def flagged_points(anomalies: DataFrame) -> DataFrame:
    """The flagged rows as labelled points of cost/kg against score."""
    label = F.concat(F.col("Route"), F.lit(", "), F.col("Transportation_Mode"), F.lit(", "), F.col("Product_Category"))
    return anomalies.where("Is_Anomaly").select("Order_ID", "Cost_Per_Kg", "Shipment_Risk_Score", "Risk_Tier", "Anomaly_Score",
                                                label.alias("label"))


def top_flagged(anomalies: DataFrame, k: int = 50) -> DataFrame:
    """The k flagged shipments with the highest anomaly score."""
    return (anomalies.where("Is_Anomaly").orderBy(F.desc("Anomaly_Score"), "Order_ID").limit(k)
            .select("Order_ID", "Route", "Transportation_Mode", "Product_Category", "Cost_Per_Kg", "Shipment_Risk_Score",
                    "Risk_Tier", "Anomaly_Score"))
